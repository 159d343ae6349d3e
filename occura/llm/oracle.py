"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from occura.llm import decontaminate, jaccard, prefixes, repetition, setsketch, vectors

_REPEATED = """
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(w[pos:pos + {n} - 1], ' ')) AS times
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS pos FROM words)
  ) WHERE times > 1"""

REPETITION = rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), repeated AS ({_REPEATED.format(n=repetition.MIN_REPEAT)}
), covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM repeated, range({repetition.MIN_REPEAT}) AS r(k) GROUP BY doc_id
), long_ones AS (SELECT DISTINCT doc_id FROM ({_REPEATED.format(n=repetition.MAX_LONGEST + 1)})
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         long_ones.doc_id IS NOT NULL AS too_long
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN long_ones USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT too_long AS kept
FROM (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_COVERED_PERCENT} * n_words AS failed FROM base)
"""


WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), five AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || h[g * 5 + 1:g * 5 + 5] AS BIGINT)) AS v FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> s) & 31) + 1]), '')), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM five
"""

def _links(size: int, percent: int, more: str = "") -> str:
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + {size} - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {size} + 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id{more}
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.a = doc_id
"""


JACCARD = _links(jaccard.SHINGLE_WORDS, jaccard.PERCENT)
SETSKETCH = _links(setsketch.SHINGLE_WORDS, setsketch.PERCENT, ", doc_id <= coalesce(low.b, doc_id) AS kept")

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {decontaminate.WINDOW}) AS n, array_to_string(w[k:k + {decontaminate.WINDOW} - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {decontaminate.WINDOW} + 1) + 1)) AS k FROM i WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), matches AS (SELECT doc_id, p.n, k, item FROM places p JOIN windows v ON v.n = p.n AND v.s = p.s
), hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT doc_id, n, k FROM matches)) GROUP BY doc_id
), found AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM matches GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: CRC-32 of the digits of {x}, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), "
    "lambda c, d: list_reduce(list_prepend(xor(c, d), [0::BIGINT for _ in range(8)]), lambda v, _z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"
)

TRIE = f"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(k := md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), n := length(coalesce(text, '')))
    ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), borrowed AS (SELECT conv_id, t, CAST({_CRC.format(x="conv_id")} % {prefixes.BORROWED} AS BIGINT) AS h FROM turns
), rebuilt AS (
  SELECT b.conv_id, list_concat(coalesce(f.t, [])[1:b.h], b.t[b.h + 1:]) AS t FROM borrowed b LEFT JOIN turns f ON f.conv_id = b.conv_id - b.conv_id % {prefixes.FAMILY}
), members AS (
  SELECT conv_id, d, len(t) AS depth, array_to_string(list_transform(t[1:d], lambda x: x.k), '') AS node,
         CASE WHEN d > 0 THEN array_to_string(list_transform(t[1:d - 1], lambda x: x.k), '') END AS parent, CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS n
  FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
         sha256(coalesce(string_agg(CASE WHEN d = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends
  FROM members GROUP BY node
), kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT a.node, sum(b.saved) AS saved, count(*) FILTER (b.node NOT IN (SELECT node FROM kids)) AS leaves
  FROM nodes a JOIN (SELECT *, unnest(range(0, d + 1)) AS up FROM nodes) b ON a.node = left(b.node, 32 * b.up) GROUP BY a.node
)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes up ON up.node = nodes.parent
"""

_DISTANCE = "list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _codes() -> str:
    """Each round is a pair of CTEs: the nearest entry of every part, and the entries' means."""
    parts = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({vectors.SCALE} * c::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))))",
        f"x AS (SELECT vec_id, label, p, v[p * len(v) // {vectors.PARTS} + 1:(p + 1) * len(v) // {vectors.PARTS}] AS v FROM kept, range({vectors.PARTS}) AS r(p))",
        f"e0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM x QUALIFY k < {vectors.ENTRIES})",
    ]
    for r in range(vectors.ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, x.v, min(struct_pack(far := {_DISTANCE}, k := e.k)) AS best FROM x JOIN e{r} e ON e.p = x.p GROUP BY ALL)")
        if r < vectors.ROUNDS:
            parts += [
                f"m{r} AS (SELECT p, k, list(v ORDER BY i) AS v FROM (SELECT p, best.k AS k, i, CAST(floor(sum(c)::DOUBLE / count(*)) AS BIGINT) AS v FROM (SELECT p, best, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY p, k)",
                f"e{r + 1} AS (SELECT e.p, e.k, coalesce(m.v, e.v) AS v FROM e{r} e LEFT JOIN m{r} m ON m.p = e.p AND m.k = e.k)",
            ]
    last = vectors.ROUNDS
    return f"""
WITH {", ".join(parts)},
coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best.k), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{last} GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM e{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
"""


SQL = {
    "op1_repetition": REPETITION, "op2_warc": WARC, "op5_jaccard": JACCARD, "op6_decontaminate": DECONTAMINATION,
    "op11_prefixes": TRIE, "op12_vectors": _codes(), "op13_setsketch": SETSKETCH,
}
