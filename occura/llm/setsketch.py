"""Near duplicates by SetSketch registers, confirmed on the full sets.

A sketch has REGISTERS one-byte registers.  Each holds the exponent, to BASE, of the smallest of a set's exponentially distributed
hash values, cut off at both ends; the sketch of a union is the registers' maximum, and two sets have equal registers about as often as
their similarity says.  Sets that share the values of at least two bands of registers are candidates.  The counts of higher, lower and equal registers give, by
maximum likelihood with both sets' sizes known, the similarity of a candidate pair; pairs that may reach the threshold are compared on their full sets.

As the result is components, a bucket's texts are first compared with the bucket's most central text, which near copies share
more bands with than with each other.  What remains are pairs of different components in a bucket, and of those only pairs with a text outside its
largest component.  They are filtered block by block, by sizes, parities and registers, and leave a task only if they pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occura.llm import jaccard
from occura.llm.common import Workspace, id_type, lookup, materialize, slices, task, texts_of
from occura.llm.components import components

SHINGLE_WORDS, PERCENT = 4, 80
#: Bands of registers with rows each; bands that candidates share at least.  A pair at 80 % shares fewer with probability 3e-6.
BANDS, ROWS, SHARED = 40, 5, 2
REGISTERS = BANDS * ROWS
#: The registers' base, rate and largest value: sets of 1 to some 10 ** 8 elements are told apart.
BASE, RATE, LARGEST = 1.1, 20.0, 255
#: Standard deviations below the threshold at which an estimate still counts.
MARGIN = 5
#: Bits of a set's parities: token counts by a hash of the token, modulo 2.  Each token that only one of two sets has turns one bit.
PARITY_BITS = 512
#: Texts of a bucket that are held against so many others at once.
BLOCK = 512

_ODD = np.random.default_rng(13).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers, (sets, REGISTERS), of non-empty arrays of distinct 64-bit hashes."""
    out = np.empty((len(sets), REGISTERS), np.uint8)
    if not sets:
        return out
    tokens = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    for k in range(REGISTERS):
        least = np.minimum.reduceat(tokens * _ODD[k], starts)
        share = (least.astype(np.float64) + 0.5) / 2.0**64
        value = -np.log1p(-share) / RATE
        out[:, k] = np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, LARGEST)
    return out


def parities(tokens: np.ndarray) -> bytes:
    return np.packbits((np.bincount((tokens >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def can_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sets can be similar by their sizes and parities (rows of 64-bit words); never wrong where it says no."""
    turned = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * turned <= (100 - percent) * (n + m))


def least_estimate(percent: int) -> float:
    return percent / 100 - MARGIN * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimates(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most likely similarity of pairs of sketches (pairs, REGISTERS) of sets of n and m elements.

    The likelihood is concave in the similarity; the zero of its slope is found by halving, for all pairs at once.
    """
    higher, lower = (x > y).sum(1), (x < y).sum(1)
    equal = x.shape[1] - higher - lower
    u, v = n / (n + m), m / (n + m)
    ratio, log = (BASE - 1) / BASE, math.log(BASE)
    share = lambda z: -np.log1p(-z * ratio) / log
    slope = lambda z: ratio / (log * (1 - z * ratio))
    low, high = np.zeros(len(n)), np.minimum(u / v, v / u)
    for _ in range(40):
        j = (low + high) / 2
        a, b = np.maximum(u - v * j, 1e-300), np.maximum(v - u * j, 1e-300)
        pa_, pb = share(a), share(b)
        rise = equal * (v * slope(a) + u * slope(b)) / np.maximum(1 - pa_ - pb, 1e-300) - higher * v * slope(a) / pa_ - lower * u * slope(b) / pb
        low, high = np.where(rise > 0, j, low), np.where(rise > 0, high, j)
    return (low + high) / 2


def _survey(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, key, sketch) of every row, registers followed by parities; a sketch only once for the equal sets of a task's slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = jaccard.shingle_sets(texts, size)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            first: dict[bytes, int] = {}
            for k, key in enumerate(keys):
                if len(sets[k]):
                    first.setdefault(key, k)
            found: list[bytes | None] = [None] * len(sets)
            for k, registers in zip(first.values(), sketches([sets[k] for k in first.values()]), strict=True):
                found[k] = registers.tobytes() + parities(sets[k])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["id", "n", "key", "sketch"])

    return texts_of(docs, id_col, text_col).mapInArrow(task(run), f"id {id_type(docs, id_col)}, n bigint, key binary, sketch binary")


def _postings(classes: DataFrame) -> DataFrame:
    """(token, band, id, n, times): the bands' values that several sets have, and how many have them."""
    bands = F.array(*(F.xxhash64(F.substring("sketch", 1 + ROWS * k, ROWS), F.lit(k)) for k in range(BANDS)))
    rows = classes.select(F.posexplode(bands).alias("band", "token"), "id", "n")
    return rows.join(rows.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1"), "token")


def _fit(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _stars(postings: DataFrame, percent: int) -> DataFrame:
    """For each set (a, b): of the central sets of its buckets, a bucket being a token and a class of sizes, that with which it shares most."""
    central = postings.groupBy("id").agg(F.sum(F.log("times")).alias("weight"))
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = postings.join(central, "id").select("token", kind.alias("class"), "id", "n", "weight")
    heads = rows.groupBy("token", "class").agg(F.max(F.struct("weight", "id", "n")).alias("head"), F.count("*").alias("times")).filter("times > 1").select("token", "class", "head")
    pairs = lookup(rows.drop("weight"), heads, ["token", "class"], "id").filter((F.col("id") != F.col("head.id")) & _fit("n", "head.n", percent))
    shared = pairs.groupBy("id", F.col("head.id").alias("h"), F.col("head.weight").alias("weight")).agg(F.count("*").alias("times")).filter(F.col("times") >= SHARED)
    return shared.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("times", "weight", "h")).alias("best")).select(F.col("best.h").alias("a"), "b")


def _remaining(postings: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(a, b): pairs of different components that share bands and may be similar, one of each pair being outside the bucket's largest component.

    A bucket's texts are packed in blocks of about BLOCK, those outside its largest component also by themselves; a task holds one block of either kind
    against each other and emits the pairs that pass all filters, each in the first of the bands that it shares.
    """
    of = labels.select(F.col("node").alias("id"), "label")
    rows = work.materialize(postings.join(of, "id", "left").select("token", "band", "id", F.coalesce("label", "id").alias("label")), "labelled")
    counts = rows.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    counts = counts.select("token", F.col("most.label").alias("main"), "all", (F.col("all") - F.col("most.c")).alias("outside"))
    mixed = lookup(rows, work.materialize(counts, "mixed"), ["token"], "id").join(classes.select("id", "n", "sketch"), "id")
    member = F.struct("id", "n", "sketch", F.xxhash64("label").alias("label"), (F.col("label") == F.col("main")).alias("main"), F.xxhash64("id").alias("order"))
    mixed = work.materialize(mixed.select("token", "band", "all", "outside", member.alias("m")), "members")

    def blocks(rows: DataFrame, many: str, name: str) -> DataFrame:
        block = F.pmod("m.order", F.ceil(F.col(many) / BLOCK))
        return rows.groupBy("token", "band", block.alias("block")).agg(F.collect_list("m").alias(name)).drop("block")

    pairs = blocks(mixed.filter("not m.main"), "outside", "xs").join(blocks(mixed, "all", "ys").drop("band"), "token").select("band", "xs", "ys")
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                band, (x, y) = batch.column("band")[k].as_py(), (_members(batch.column(c)[k].values) for c in ("xs", "ys"))
                i, j = np.nonzero((x.label[:, None] != y.label) & (y.main | (x.order[:, None] <= y.order)))
                fit = can_be_similar(x.odd[i], y.odd[j], x.n[i], y.n[j], percent)
                i, j = i[fit], j[fit]
                shared = (x.registers[i] == y.registers[j]).reshape(len(i), BANDS, ROWS).all(2)
                here = (shared.sum(1) >= SHARED) & (shared.argmax(1) == band)
                i, j = i[here], j[here]
                likely = estimates(x.registers[i], y.registers[j], x.n[i].astype(float), y.n[j].astype(float)) >= least
                yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(i[likely])), y.ids.take(pa.array(j[likely]))], ["a", "b"])

    kind = id_type(postings, "id")
    return pairs.mapInArrow(task(run), f"a {kind}, b {kind}")


class _members:
    """The columns of a block's texts."""

    def __init__(self, rows: pa.StructArray):
        raw = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(rows), -1)
        self.registers, self.odd = raw[:, :REGISTERS], np.ascontiguousarray(raw[:, REGISTERS:]).view(np.uint64)
        self.n, self.label, self.order = (rows.field(c).to_numpy() for c in ("n", "label", "order"))
        self.main = rows.field("main").to_numpy(zero_copy_only=False)
        self.ids = rows.field("id")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) that can be similar by parities and whose estimated similarity is not clearly below the threshold."""
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "xy")
                n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
                odd = lambda z: np.ascontiguousarray(z[:, REGISTERS:]).view(np.uint64)
                found = can_be_similar(odd(x), odd(y), n, m, percent) & (estimates(x[:, :REGISTERS], y[:, :REGISTERS], n.astype(float), m.astype(float)) >= least)
                yield batch.select(["a", "b"]).filter(pa.array(found))

    side = lambda key, n, s: classes.select(F.col("id").alias(key), F.col("n").alias(n), F.col("sketch").alias(s))
    kind = id_type(pairs, "a")
    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").mapInArrow(task(run), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links, itself included), kept (id is component_id).

    Words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased; the set is the distinct shingles of ``size`` words, or
    the whole of a shorter text.  Sets link when the intersection is at least ``percent`` hundredths of the union; links are confirmed on full sets.  A null
    text or one without words has no set and links with nothing.  Rows with a null id link with nothing, get a null component and
    are kept.  Repeated rows give a row each.  Different texts under one id count as one document where that id is the smallest of both their
    groups of equal texts.  Other columns are not read; an empty table gives no rows.

    Equal sets are found exactly, by 128-bit keys.  A pair of different sets at the threshold is no candidate with probability 3e-6, and less the
    more similar it is.  Nothing is capped: a bucket's texts meet in blocks, and lookups spread the rows of one key.
    """
    work = Workspace(docs.sparkSession, "setsketch")
    survey = materialize(_survey(docs, id_col, text_col, size), "setsketch_survey")
    classes = work.materialize(survey.filter("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes")
    lone = classes.filter("sketch is null").select("key")  # the sketch came with a row without an id
    if not lone.isEmpty():
        other = survey.filter("id is null and sketch is not null").join(lone, "key").groupBy("key").agg(F.max("sketch").alias("other"))
        classes = work.materialize(classes.join(other, "key", "left").select("key", "id", "n", F.coalesce("sketch", "other").alias("sketch")), "all_classes")

    def linked(left: DataFrame) -> DataFrame:
        nodes = work.materialize(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().join(classes.select("id", "key"), "id"), "nodes")
        bodies = work.materialize(jaccard._bodies_of(docs, nodes, id_col, text_col), "bodies")
        side = lambda key, k, s: bodies.select(F.col("id").alias(key), F.col("key").alias(k), F.col("body").alias(s))
        return jaccard._linked(left.join(side("a", "ka", "x"), "a").join(side("b", "kb", "y"), "b"), size, percent)

    postings = work.materialize(_postings(classes), "postings")
    stars = work.materialize(_stars(postings, percent), "stars")
    edges = work.materialize(linked(work.materialize(_likely(stars, classes, percent), "likely")), "links")
    labels = components(edges, work)
    rest = work.materialize(_remaining(postings, classes, labels, percent, work), "rest")
    if not rest.isEmpty():
        labels = components(edges.union(linked(rest)), work)

    of_class = materialize(classes.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("key", F.coalesce("label", "id").alias("label")), "setsketch_labels")
    work.drop()
    found = lookup(survey.select("id", "n", "key"), of_class, ["key"], "id", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("label"))
    found = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
