"""Benchmark decontamination over a distributed positional inverted index.

The training texts are indexed once, in segments: for each term of a segment, the sorted positions at which its texts hold it.
Any benchmark can then be searched for in the stored index.  Its windows are sequences of terms; only the postings of
those terms are brought together by segment, where the position lists of a window are intersected, each moved back by the
term's offset, from the segment's rarest term on, for all windows at a time.  With a slop, terms may lie that many words off
their places: proximity matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from occura.llm.common import broadcast_if_small, delete, group, new_path, slices, task, texts_of

WINDOW = 10
#: Bytes of text in a segment of the index; bytes of windows that are searched for at a time, and candidates that are intersected at a time.
SEGMENT_BYTES, BLOCK_BYTES, CANDIDATES = 4 << 20, 4 << 20, 1 << 20

#: Lower case for A-Z; space for the ASCII characters that are neither letter nor digit.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(_FOLD).split()


@dataclass
class Index:
    """A stored index: ``segments`` (segment, ids, lengths in words) and ``postings`` (segment, term, n, positions as 32-bit numbers)."""

    segments: DataFrame
    postings: DataFrame


def open_index(spark: SparkSession, path: str) -> Index:
    stored = spark.read.parquet(path)
    return Index(stored.filter("kind = 'segment'").select("segment", "ids", "lengths"), stored.filter("kind = 'posting'").select("segment", "term", "n", "positions"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, segment_bytes: int | None = None) -> Index:
    """Index every term of every whole text, below one folder; returns the index.

    Null texts have no terms but are listed.  Repeated rows and null ids are a text each.  A text lies in one segment, and a
    segment's memory is bounded by ``segment_bytes`` (SEGMENT_BYTES) or one longer text.  No shuffle.
    """
    path = path or new_path(docs.sparkSession, "index")
    texts = texts_of(docs, id_col, text_col)
    limit = segment_bytes or SEGMENT_BYTES
    ids = ArrayType(texts.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch, bodies in slices(batches, limit=limit):
            number: dict[bytes, int] = {}
            lengths, found = np.zeros(len(bodies), np.int64), []
            for k, body in enumerate(bodies):
                words = words_of(body)
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                lengths[k] = len(words)
                found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            tokens, terms = np.concatenate(found), len(number)
            order = np.argsort(tokens, kind="stable").astype("<i4")
            counts = np.bincount(tokens, minlength=terms).astype(np.int64)
            ends = np.r_[0, 4 * np.cumsum(counts)].astype(np.int32)
            lists = pa.BinaryArray.from_buffers(pa.binary(), terms, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(order.tobytes())])
            none = lambda kind: pa.nulls(terms, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["segment", *["posting"] * terms]), pa.array(np.full(terms + 1, part << 33 | row)), pa.array([None, *number], pa.binary()), pa.array([None, *counts.tolist()], pa.int64()), pa.concat_arrays([pa.nulls(1, pa.binary()), lists]),
                 pa.ListArray.from_arrays(pa.array([0, *[len(bodies)] * (terms + 1)], pa.int32()), batch.column("id")), pa.concat_arrays([pa.array([lengths], pa.list_(pa.int64())), none(pa.list_(pa.int64()))])],
                ["kind", "segment", "term", "n", "positions", "ids", "lengths"],
            )
            row += 1

    schema = StructType([*StructType.fromDDL("kind string, segment bigint, term binary, n bigint, positions binary").fields, StructField("ids", ids), *StructType.fromDDL("lengths array<bigint>").fields])
    texts.mapInArrow(task(run), schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(StructType([*schema.fields[1:], schema.fields[0]])).parquet(path)
    return Index(found.filter("kind = 'segment'").select("segment", "ids", "lengths"), found.filter("kind = 'posting'").select("segment", "term", "n", "positions"))


def windows_of(benchmark: DataFrame, item_col: str, item_text: str, size: int) -> DataFrame:
    """(item, window, h): every ``size`` consecutive words of each item, joined by spaces, and a hash of them; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in slices(batches, limit=1 << 16):
            items, found = [], []
            for item, body in zip(batch.column("id").to_pylist(), bodies, strict=True):
                words = words_of(body)
                own = {b" ".join(words[at : at + size]) for at in range(max(1, len(words) - size + 1))} if words else set()
                items += [item] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    items = texts_of(benchmark.withColumn(item_col, F.col(item_col).cast("string")), item_col, item_text).distinct()
    return items.mapInArrow(task(run), "item string, window binary").withColumn("h", F.xxhash64("window"))


class Windows:
    """Distinct windows as rows of term numbers, filled up with -1."""

    def __init__(self, windows: list[bytes], hashes: list[int], size: int):
        self.terms: dict[bytes, int] = {}
        self.rows = np.full((len(windows), size), -1, np.int32)
        for k, window in enumerate(windows):
            for at, w in enumerate(window.split(b" ")):
                self.rows[k, at] = self.terms.setdefault(w, len(self.terms))
        self.lengths = (self.rows >= 0).sum(axis=1)
        self.hashes = np.array(hashes, np.int64)


def intersect(windows: Windows, counts: np.ndarray, positions: np.ndarray, ends: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Matches in one segment as (window, text, start): each term has a place of its own in the text, up to ``slop`` words off start + offset.

    ``counts`` has the length of each term's list, ``positions`` the lists one behind the other, ``ends`` the text ends in words.
    """
    rows, size = windows.rows, windows.rows.shape[1]
    times = np.where(rows >= 0, counts[rows], np.iinfo(np.int64).max)
    alive = np.flatnonzero((times > 0).all(axis=1))
    if not len(alive):
        return
    offset = np.broadcast_to(np.arange(size), rows[alive].shape)
    order = np.lexsort((offset, rows[alive], times[alive]), axis=-1)  # the rarest first; the places of one term in ascending order
    terms, offsets = np.take_along_axis(rows[alive], order, 1).astype(np.int64), order
    total = int(ends[-1]) if len(ends) else 0
    span = total + 1
    lists = np.cumsum(counts) - counts
    keys = np.repeat(np.arange(len(counts)), counts) * span + positions
    rarest = counts[terms[:, 0]] * (2 * slop + 1)
    for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(np.cumsum(rarest) // CANDIDATES)) + 1):
        n = counts[terms[part, 0]]
        win = np.repeat(part, n)
        at = positions[np.repeat(lists[terms[part, 0]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
        text = np.searchsorted(ends, at, side="right")
        low, high = np.r_[0, ends[:-1]][text], ends[text]
        start = at - offsets[win, 0]
        if slop:
            shift = np.arange(-slop, slop + 1)
            win, text, low, high = (np.repeat(x, len(shift)) for x in (win, text, low, high))
            start = (start[:, None] + shift).ravel()
        before = np.full(len(win), -1, np.int64)
        for k in range(size):
            term, goal = terms[win, k], start + offsets[win, k]
            real = term >= 0
            first = np.maximum(goal - slop, low)
            if k:
                again = real & (term == terms[win, k - 1])
                first = np.where(again, np.maximum(first, before + 1), first)
            found = np.searchsorted(keys, term * span + first)
            place = keys[np.minimum(found, len(keys) - 1)] - term * span
            good = ~real | (found < len(keys)) & (place >= first) & (place <= np.minimum(goal + slop, high - 1))
            before = place
            if not good.all():
                win, text, low, high, start, before = (x[good] for x in (win, text, low, high, start, before))
        if len(win):
            one = np.unique(np.stack([alive[win], text, start]), axis=1) if slop else np.stack([alive[win], text, start])
            yield one[0], one[1], one[2]


def search(index: Index, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", *, window: int = WINDOW, slop: int = 0, block_bytes: int | None = None) -> DataFrame:
    """One row per indexed text: id, n_words, n_hit, n_items, items (ids as sorted strings), spans, contaminated.

    Every ``window`` consecutive words of an item are a window; a shorter item is one, one without words (or null) none.  A
    window matches from a start when each of its terms has a place of its own in the text, up to ``slop`` words off its place
    behind the start; the words of the text among the window's length from there are hit.  Null item ids hit but are not listed.

    Distinct windows are taken in blocks of about ``block_bytes`` (BLOCK_BYTES), one after the other: a block is broadcast, its matches are written, and only
    then the next one is read; each reads the stored postings, not the texts.  Items stay in their table and are joined to the windows that match.
    """
    spark = benchmark.sparkSession
    listed = windows_of(benchmark, item_col, item_text, window)
    distinct = listed.select("window", "h").distinct()
    total = distinct.agg(F.sum(F.octet_length("window") + 32).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // (block_bytes or BLOCK_BYTES)))
    path = new_path(spark, "matches")
    for k in range(blocks):  # the driver holds one block at a time
        part, shared = _matches(index, distinct.filter(F.pmod("h", F.lit(blocks)) == k) if blocks > 1 else distinct, window, slop)
        part.write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema(part.schema).parquet(path)
    spans = found.groupBy("segment", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    hit = found.select("segment", "row", F.explode(F.array_distinct("windows")).alias("h"))
    names = hit.join(broadcast_if_small(listed.filter("item is not null").select("h", "item")), "h").groupBy("segment", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    texts = index.segments.select("segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("row", "x")).select("segment", "row", F.col("x.ids").alias("id"), F.col("x.lengths").alias("n_words"))
    keyed = texts.join(broadcast_if_small(spans.join(names, ["segment", "row"], "left")), ["segment", "row"], "left")
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start: bigint, end: bigint>>")
    whole = keyed.select(F.col("id"), "n_words", F.coalesce("items", no_items).alias("items"), F.coalesce("spans", no_spans).alias("spans"))
    return whole.select(F.col("id").alias(id_col), "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def _matches(index: Index, distinct: DataFrame, size: int, slop: int) -> tuple[DataFrame, Broadcast]:
    """(segment, row, spans in words of the text, windows) of the texts that hold windows of one block, and the block's broadcast."""
    block = sorted((bytes(r["window"]), r["h"]) for r in distinct.collect())
    spark = distinct.sparkSession
    windows = Windows([w for w, _ in block], [h for _, h in block], size)
    shared = spark.sparkContext.broadcast(windows)
    terms = spark.createDataFrame([(bytearray(t), k) for t, k in windows.terms.items()], "term binary, number int")
    asked = index.postings.join(F.broadcast(terms), "term").select("segment", "number", "n", "positions")  # no more rows than the block's words

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        windows = shared.value
        lengths = right.column("lengths").combine_chunks().values.to_numpy() if right.num_rows else np.empty(0, np.int64)
        ends = np.cumsum(lengths)
        counts = np.zeros(len(windows.terms), np.int64)
        spans: dict[int, list] = {}
        names: dict[int, list] = {}
        if left.num_rows:
            numbers = left.column("number").to_numpy()
            counts[numbers] = left.column("n").to_numpy()
            packed = left.column("positions").to_pylist()
            positions = np.frombuffer(b"".join([packed[k] for k in np.argsort(numbers).tolist()]), "<i4")
            for win, text, start in intersect(windows, counts, positions, ends, slop):
                begin = ends[text] - lengths[text]
                low, high = np.maximum(start - begin, 0), np.minimum(start - begin + windows.lengths[win], lengths[text])
                for t, a, b, h in zip(text.tolist(), low.tolist(), high.tolist(), windows.hashes[win].tolist(), strict=True):
                    spans.setdefault(t, []).append({"start": a, "end": b})
                    names.setdefault(t, []).append(h)
        rows = sorted(spans)
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array([spans[t] for t in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([names[t] for t in rows], pa.list_(pa.int64()))], names=["segment", "row", "spans", "windows"])

    sizes = index.segments.select(F.col("segment").alias("of"), "lengths")
    return asked.groupBy("segment").cogroup(sizes.groupBy("of")).applyInArrow(group(run), "segment bigint, row int, spans array<struct<start: bigint, end: bigint>>, windows array<bigint>"), shared


def covered(spans: Column) -> Column:
    """Words in the union of [start, end) spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = WINDOW, slop: int = 0, block_bytes: int | None = None) -> DataFrame:
    """Index ``docs`` and search the index for ``benchmark``: one row per row of ``docs`` (see ``build_index`` and ``search``).

    Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased.  Other columns are not read.
    """
    path = new_path(docs.sparkSession, "index")
    found = search(build_index(docs, id_col, text_col, path), benchmark, id_col, item_col, item_text, window=window, slop=slop, block_bytes=block_bytes)
    delete(docs.sparkSession, f"{path}/kind=posting")  # all matches are written by now
    return found


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
