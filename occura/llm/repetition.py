"""Quality rule by suffix-array repetition within a text.

Words are turned into integers, the suffixes of every text are sorted by prefix doubling, and the
longest common prefixes of neighbours in that order are put together to LCP intervals: the places of one
repeated word sequence.  Those that different words precede are the maximal repeats.  Any other repeat lies
within a longer one, so the union of the maximal repeats' spans is that of each suffix's deepest interval,
which takes linear time.  A text fails where the spans cover too much of it or the longest repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from occura.llm.common import id_type, slices, task, texts_of

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_REPEAT = 5
MIN_WORDS = 10
MAX_COVERED_PERCENT = 20
MAX_LONGEST = 30

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a character outside the white space.
_IS_CHAR = ~_IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)


def suffix_levels(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of many texts at once, and the ranks by the first 1, 2, 4, … words.

    ``text`` numbers the text of each word and never falls; a suffix ends with its text, so
    suffixes of different texts never share a rank.
    """
    n = len(words)
    key = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    levels: list[np.ndarray] = []
    rank = np.empty(n, np.int64)
    live, step = np.arange(n), 0
    while True:
        ranked = key[order[live]] if not levels else joint
        fresh = np.r_[True, ranked[1:] != ranked[:-1]] if len(live) else np.zeros(0, bool)
        heads = live[fresh]
        rank[order[live]] = np.repeat(heads, np.diff(np.r_[np.flatnonzero(fresh), len(live)]))
        levels.append(rank.astype(np.int32))
        shared = ~(fresh & np.r_[fresh[1:], True]) if len(live) else fresh
        live = live[shared]
        if not len(live):
            return order, levels
        step = step * 2 or 1
        at = order[live]
        ahead = np.minimum(at + step, n - 1)
        second = np.where((at + step < n) & (text[ahead] == text[at]), rank[ahead] + 1, 0)
        joint = rank[at] * (n + 1) + second
        by = np.argsort(joint, kind="stable")
        order[live], joint = at[by], joint[by]


def neighbours(words: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and the longest common prefix of each suffix with the one before it in that order; 0 where shorter than ``least``.

    There is one more prefix than suffixes: 0 at both ends.
    """
    n = len(words)
    lcp = np.zeros(n + 1, np.int64)
    if n < 2:
        return np.arange(n), lcp
    order, levels = suffix_levels(words, text)
    deepest = max((k for k in range(len(levels)) if 1 << k <= least), default=0)
    left, right = order[:-1], order[1:]
    near = np.flatnonzero(levels[deepest][left] == levels[deepest][right])
    common, x, y = np.zeros(len(near), np.int64), left[near], right[near]
    for k in range(len(levels) - 1, -1, -1):
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        for part in (common, x, y):
            part[same] += 1 << k
    common[common < least] = 0
    lcp[near + 1] = common
    return order, lcp


def intervals(lcp: np.ndarray) -> np.ndarray:
    """The LCP intervals as rows (words, first, last): the suffixes at these places of the order, and no others, begin with the same words."""
    found: list[tuple[int, int, int]] = []
    opened: list[tuple[int, int]] = []
    places = np.flatnonzero((lcp[1:] > 0) | (lcp[:-1] > 0)) + 1
    for place, words in zip(places.tolist(), lcp[places].tolist(), strict=True):
        first = place - 1
        while opened and opened[-1][0] > words:
            deeper, first = opened.pop()
            found.append((deeper, first, place - 1))
        if words and (not opened or opened[-1][0] < words):
            opened.append((words, first))
    return np.array(found, np.int64).reshape(-1, 3)


def maximal_repeats(words: np.ndarray, text: np.ndarray, order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The intervals whose words cannot be made longer in all their places: different words, or a text's start, stand before them."""
    found = intervals(lcp)
    before = np.where(np.r_[True, text[1:] != text[:-1]][: len(words)], -1, np.r_[-1, words[:-1]][: len(words)])[order]
    changes = np.cumsum(np.r_[False, before[1:] != before[:-1]][: len(words)])
    return found[changes[found[:, 2]] > changes[found[:, 1]]] if len(found) else found


def _measure(texts: list[bytes | None], least: int) -> dict[str, np.ndarray]:
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    ids: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    dup_lines = np.zeros(len(texts), np.int64)
    for k, body in enumerate(texts):
        if not body:
            continue
        found = body.split()
        counts[k] = len(found)
        ids += [number(w, len(seen)) for w in found]
        lines = [x for x in body.split(b"\n") if x.strip()]
        dup_lines[k] = len(lines) - len(set(lines))
    words, text = np.array(ids, np.int64), np.repeat(np.arange(len(texts)), counts)
    order, lcp = neighbours(words, text, least)
    maximal = maximal_repeats(words, text, order, lcp)
    reach = np.zeros(len(words), np.int64)
    reach[order] = np.maximum(lcp[:-1], lcp[1:])
    starts = np.cumsum(counts) - counts
    at = np.flatnonzero(reach)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + reach[at], -1)
    covered = np.cumsum(edge[:-1]) > 0
    longest = np.zeros(len(texts), np.int64)
    of = text[order[maximal[:, 1]]]
    np.maximum.at(longest, of, maximal[:, 0])
    raw = np.frombuffer(b"\n".join(x or b"" for x in texts) + b"\n", np.uint8)
    sizes = np.array([len(x or b"") + 1 for x in texts], np.int64)
    heads = np.cumsum(sizes) - sizes
    in_text = lambda hit: np.add.reduceat(hit[raw].astype(np.int64), heads)
    return {"n_words": counts, "word_chars": in_text(_IS_CHAR), "n_symbols": in_text(_IS_SYMBOL), "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(text[covered], minlength=len(texts)), "longest_repeat": longest, "n_maximal_repeats": np.bincount(of, minlength=len(texts)), "covered": covered, "starts": starts}


def _spans(covered: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
    out = []
    for s, n in zip(starts, counts, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[False, covered[s : s + n], False].astype(np.int8)))
        out.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
    return out


def repetition_rule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_repeat: int = MIN_REPEAT, min_words: int = MIN_WORDS,
    max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST, with_spans: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: the base measures, the covered words, the longest repeat and the verdicts.

    Words are runs of anything but space and \\x09-\\x0D.  ``n_repeat_words`` is the number of words in
    repeats of ``min_repeat`` words or more (the union of the spans, first occurrences included),
    ``longest_repeat`` the words of the longest one, ``n_maximal_repeats`` the number of different word
    sequences that can't be made longer in all their places.  ``with_spans`` adds the spans as word offsets.
    A null or blank text has no words: base_failed, not kept.  Repeated rows and null ids give a row
    each.  Other columns of ``docs`` are not read, so their names can't clash.  The texts are
    handled where they are read: no shuffle, and memory bounded by one slice or one text.
    """
    spans_type = ", repeat_spans array<struct<start: bigint, end: bigint>>" if with_spans else ""
    schema = f"{id_col} {id_type(docs, id_col)}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, longest_repeat bigint, n_maximal_repeats bigint, base_failed boolean, kept boolean{spans_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            m = _measure(texts, min_repeat)
            covered, starts = m.pop("covered"), m.pop("starts")
            over = 100 * m["n_repeat_words"] > max_covered_percent * m["n_words"]
            failed = (m["n_words"] < min_words) | over
            out = [batch.column("id"), *map(pa.array, m.values()), pa.array(failed), pa.array(~failed & (m["longest_repeat"] <= max_longest))]
            names = [id_col, *m, "base_failed", "kept"]
            if with_spans:
                out.append(pa.array(_spans(covered, starts, m["n_words"]), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("repeat_spans")
            yield pa.RecordBatch.from_arrays(out, names)

    return texts_of(docs, id_col, text_col).mapInArrow(task(run), schema)
