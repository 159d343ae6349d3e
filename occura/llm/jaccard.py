"""Exact Jaccard links between shingle sets, filtered by prefixes under several global token orders.

A pair of sets with similarity of at least t shares a token among the first n - ceil(t n) + 1 of each set, whatever
global order the tokens are taken in.  Candidates therefore have to share a prefix token under every one of
several orders; only those that pass all filters are verified on the whole sets.  All orders put tokens that
many different texts hold (common lines and passages) last and differ in the hash that sorts the rest.

Equal sets are one class, compared once.  As the result is the classes' connected components, a bucket of texts with
the same prefix token is first compared with its cleanest text only; pairs that this has connected need no further
comparison, and all pairs of a bucket that are still in different components follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occura.llm.common import Workspace, broadcast_if_small, id_type, lookup, materialize, slices, task, texts_of
from occura.llm.components import components

SHINGLE_WORDS = 3
PERCENT = 90
ORDERS = 3
#: Tokens that the orders put last at most: those that most texts hold.  It is a hint for the orders only.
FREQUENT_TOKENS = 100_000
#: Different texts of one slice that must hold a token for it to be counted as frequent there.
FREQUENT_IN_SLICE = 3
#: Columns of a set's parities, 64 of them each: token counts by a hash of the token, modulo 2.
PARITIES = ("s0", "s1", "s2", "s3")
#: Tokens of sets that a verifying task remembers.
KNOWN_TOKENS = 2_000_000

_ODD = np.random.default_rng(5).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; one for the whole of a shorter text; none without words."""
    out = []
    for body in texts:
        words = (body or b"").lower().split()
        n = len(words)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)  # faster than remembered hashes
        width = min(size, n)
        joint = h[: n - width + 1] * _ODD[0]
        for k in range(1, width):
            joint = (joint ^ (joint >> np.uint64(29))) * _ODD[k % 8] + h[k : n - width + 1 + k] * _ODD[(k + 1) % 8]
        joint = (joint ^ (joint >> np.uint64(32))) * _ODD[8 + width % 8]
        out.append(np.unique(joint))
    return out


def needed(n, percent: int):
    """Shared tokens that a set of n needs with any set similar to it: the ceiling of percent of n."""
    return (percent * n + 99) // 100


def prefixes(tokens: np.ndarray, frequent: np.ndarray, times: np.ndarray, percent: int, orders: int) -> tuple[list[np.ndarray], int]:
    """The prefix of a set under each order, as 32-bit tokens, and how many of its tokens are not frequent."""
    n = len(tokens)
    weight = np.zeros(n, np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        weight = np.where(frequent[at] == tokens, times[at], np.uint64(0))
    length = n - needed(n, percent) + 1
    found = []
    for k in range(orders):
        mixed = (tokens ^ (tokens >> np.uint64(30))) * _ODD[8 + k]
        key = (weight << np.uint64(44)) | (mixed >> np.uint64(20))
        found.append((tokens[np.argsort(key, kind="stable")[:length]] >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return found, int((weight == 0).sum())


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 classes a parity column, the number of the set's tokens in the class modulo 2."""
    classes = ((tokens ^ (tokens >> np.uint64(33))) * _ODD[12] >> np.uint64(32)) % np.uint64(64 * len(PARITIES))
    odd = np.bincount(classes.astype(np.int64), minlength=64 * len(PARITIES)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_BITS = "".join(f", {c} bigint" for c in PARITIES)


def _survey(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (id, n, key) for every document, and rows (token, times) for tokens frequent within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, size)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            new = [s for s, k in zip(sets, keys, strict=True) if k not in met and not met.add(k)]
            tokens, times = np.unique(np.concatenate([*new, np.empty(0, np.uint64)]), return_counts=True)
            often = times >= FREQUENT_IN_SLICE
            rows, more = len(texts), int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column("id"), pa.nulls(more, batch.column("id").type)]), pa.array([len(s) for s in sets] + [None] * more, pa.int64()), pa.array(keys + [None] * more, pa.binary()),
                 pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(tokens[often].view(np.int64))]), pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(times[often].astype(np.int64))])],
                ["id", "n", "key", "token", "times"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(task(run), f"id {id_type(docs, id_col)}, n bigint, key binary, token bigint, times bigint")


def _prefix_table(docs: DataFrame, id_col: str, text_col: str, frequent: DataFrame, size: int, percent: int, orders: int) -> DataFrame:
    """One row per text with a set: (id, key, n, own, parities, p0, p1, …)."""
    rows = frequent.toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    tokens = tokens[order]
    times = np.minimum(rows.column("times").to_numpy().astype(np.int64), (1 << 20) - 1).astype(np.uint64)[order]
    shared = docs.sparkSession.sparkContext.broadcast((tokens, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = shared.value
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, size)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            kept = [k for k, s in enumerate(sets) if len(s)]
            found = [prefixes(sets[k], tokens, times, percent, orders) for k in kept]
            bits = np.array([parities(sets[k]) for k in kept], np.int64).reshape(len(kept), len(PARITIES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(kept, pa.int64())), pa.array([keys[k] for k in kept], pa.binary()), pa.array([len(sets[k]) for k in kept], pa.int64()), pa.array([own for _, own in found], pa.int64()),
                 *map(pa.array, np.ascontiguousarray(bits.T)), *(pa.array([p[k] for p, _ in found], pa.list_(pa.int32())) for k in range(orders))],
                ["id", "key", "n", "own", *PARITIES, *(f"p{k}" for k in range(orders))],
            )

    columns = "".join(f", p{k} array<int>" for k in range(orders))
    return texts_of(docs, id_col, text_col).mapInArrow(task(run), f"id {id_type(docs, id_col)}, key binary, n bigint, own bigint{_BITS}{columns}")


def _postings(prefix: DataFrame) -> DataFrame:
    """(token, id, n, own, at) of the first order's prefix tokens that more than one set has.  Most tokens are in one prefix only."""
    rows = prefix.select(F.posexplode("p0").alias("at", "token"), "id", "n", "own").select("token", "id", F.col("n").cast("int").alias("n"), F.col("own").cast("int").alias("own"), "at")
    several = rows.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").select("token")
    return rows.join(several, "token", "left_semi")


def _bodies_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, body) of the texts whose id is among ``nodes``, compressed: words take less room than their shingles' hashes.  Repeated rows give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = [packed.compress(x) for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(bodies, pa.binary())], ["id", "key", "body"])

    wanted = nodes.select(F.col("id").alias("id_of"), "key")
    chosen = texts_of(docs, id_col, text_col).filter("body is not null").join(broadcast_if_small(wanted), F.col("id") == F.col("id_of")).select("id", "key", "body")
    return chosen.mapInArrow(task(run), f"id {id_type(docs, id_col)}, key binary, body binary")


def _linked(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those (a, b) of the rows (a, ka, x, b, kb, y), with keys and compressed texts, whose sets are similar; a text that hasn't its key's set only shares an id with one that has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        met: dict[bytes, np.ndarray] = {}
        room = KNOWN_TOKENS

        def tokens(body: bytes, key: bytes) -> np.ndarray:
            nonlocal met, room
            found = met.get(key)
            if found is None:
                found = shingle_sets([plain.decompress(body)], size)[0]
                if xxhash.xxh3_128_digest(found.tobytes()) != key:
                    return found[:0]
                if room < len(found):
                    met, room = {}, KNOWN_TOKENS
                met[key], room = found, room - len(found)
            return found

        for batch in batches:
            linked = []
            for ka, x, kb, y in zip(*(batch.column(c).to_pylist() for c in ("ka", "x", "kb", "y")), strict=True):
                one, other = tokens(x, ka), tokens(y, kb)
                common = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(common > 0 and 100 * common >= percent * (len(one) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    kind = id_type(pairs, "a")
    return pairs.mapInArrow(task(run), f"a {kind}, b {kind}")


def _can_match(x: str, y: str, percent: int) -> Column:
    """Whether two sets that first meet at these positions of an order can be similar, by size and by what is left of both; ``x`` and ``y`` are how their columns' names begin."""
    n, m, at, where = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}at"), F.col(f"{y}at")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - at, m - where) >= percent * (n + m))


def _can_differ(x: str, y: str, percent: int) -> Column:
    """Whether two sets can be similar by their parities: each token that only one set has turns one bit, so differing bits are no more than differing tokens."""
    bits = [F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in PARITIES]
    return (100 + percent) * sum(bits[1:], bits[0]) <= (100 - percent) * (F.col(f"{x}n") + F.col(f"{y}n"))


def _stars(postings: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """For each text one pair at most, with the cleanest text of one of its buckets: that with which it shares most tokens.

    A bucket is a token and a class of sizes; the cleanest text has the fewest tokens that are not frequent, as an original
    has of its edited copies.
    """
    rows = postings.select("token", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int").alias("class"), "id", "n", "own", "at")
    heads = rows.groupBy("token", "class").agg(F.min(F.struct("own", "id", "n", "at")).alias("head"), F.count("*").alias("times")).filter("times > 1").select("token", "class", "head")
    pairs = lookup(rows, heads, ["token", "class"], "id").filter(F.col("id") != F.col("head.id")).filter(_can_match("", "head.", percent))
    shared = pairs.groupBy("id", F.col("head.id").alias("h"), F.col("head.own").alias("own")).agg(F.count("*").alias("times"))
    side = lambda s, key: table.select(F.col("id").alias(key), *[F.col(c).alias(f"{s}{c}") for c in ("n", *PARITIES)])
    fit = shared.join(side("x_", "id"), "id").join(side("y_", "h"), "h").filter(_can_differ("x_", "y_", percent))
    return fit.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("times", -F.col("own"), "h")).alias("best")).select(F.col("best.h").alias("a"), "b")


def _mixed(postings: DataFrame, labels: DataFrame, table: DataFrame, work: Workspace) -> DataFrame:
    """The postings of tokens whose texts are still in several components, with the texts' labels and parities."""
    labels = labels.select(F.col("node").alias("id"), "label")
    rows = work.materialize(postings.join(labels, "id", "left").select("token", "id", "n", "at", F.coalesce("label", "id").alias("label")), "labelled")
    several = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    return rows.join(several, "token", "left_semi").join(table.select("id", *PARITIES), "id")


def _verified(pairs: DataFrame, table: DataFrame, work: Workspace, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, orders: int) -> DataFrame:
    """Those of the (a, b) pairs that pass the filters of all orders and then the exact test."""
    own = [f"p{k}" for k in range(1, orders)]
    side = lambda s: table.select(F.col("id").alias(s), *(F.col(p).alias(f"{p}{s}") for p in own))
    filtered = pairs.join(side("a"), "a").join(side("b"), "b")
    for p in own:
        filtered = filtered.filter(F.arrays_overlap(f"{p}a", f"{p}b"))
    left = work.materialize(filtered.select("a", "b"), "candidates")
    nodes = work.materialize(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().join(table.select("id", "key"), "id"), "nodes")
    bodies = work.materialize(_bodies_of(docs, nodes, id_col, text_col), "bodies")
    whole = left.join(bodies.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("body").alias("x")), "a").join(bodies.select(F.col("id").alias("b"), F.col("key").alias("kb"), F.col("body").alias("y")), "b")
    return _linked(whole, size, percent)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE_WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased; the set is the distinct shingles of ``size``
    words, or the whole of a shorter text.  Sets link when the intersection is at least ``percent`` hundredths of the
    union.  A null text or one without words has no set and links with nothing, not even another such text.  Rows
    with a null id link with nothing and get a null component.  Repeated rows give a row each.  Different texts under one id count as
    one document where that id is the smallest of both their groups of equal texts.  Other columns are not read.

    Tokens are 64-bit hashes and sets have 128-bit keys.  Nothing but the FREQUENT_TOKENS most frequent tokens (a
    bounded hint for the orders) comes to the driver.  Tables of keys are broadcast up to a proven number of rows; beyond that
    joins shuffle, and lookups spread the rows of one key.  Pairs of a bucket are made by a shuffled join that adaptive execution can split.
    """
    spark = docs.sparkSession
    survey = materialize(_survey(docs, id_col, text_col, size), "survey")
    rows = survey.filter("key is not null").select("id", "n", "key")
    frequent = survey.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT_TOKENS)
    work = Workspace(spark, "jaccard")
    classes = work.materialize(rows.filter("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("rep")), "classes")
    prefix = _prefix_table(docs, id_col, text_col, frequent, size, percent, orders)
    prefix = work.materialize(prefix.join(classes.select(F.col("rep").alias("id"), "key"), ["id", "key"]), "prefixes")  # a class is its smallest id

    test = lambda pairs: _verified(pairs, prefix, work, docs, id_col, text_col, size, percent, orders)
    postings = work.materialize(_postings(prefix), "postings")
    stars = work.materialize(_stars(postings, prefix, percent), "stars")
    edges = work.materialize(test(stars), "links")
    labels = components(edges, work)
    placed = work.materialize(_mixed(postings, labels, prefix, work), "placed")
    other = placed.select("token", *[F.col(c).alias(f"other_{c}") for c in placed.columns if c != "token"])
    rest = placed.join(other, "token").filter((F.col("id") < F.col("other_id")) & (F.col("label") != F.col("other_label")) & _can_match("", "other_", percent) & _can_differ("", "other_", percent)).select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct()
    rest = work.materialize(rest.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        labels = components(edges.union(test(rest)), work)

    of_class = materialize(classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("key", F.coalesce("label", "rep").alias("label")), "labels_of_classes")
    work.drop()
    found = lookup(rows, of_class, ["key"], "id", "left")
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNull(), None).otherwise(F.col("label"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))

