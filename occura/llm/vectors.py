"""Exact integer product codes of vectors, with codebooks trained over all rows.

Each part of the vectors is sorted along a Hilbert curve and cut into flat blocks that store their rows, the smallest box around
them and their sums.  In every round the least and the greatest distance of a box from each codebook entry leave a shortlist
of entries for the block.  A block with one entry on its list counts by its sums; the rows of others are compared with the listed entries by a small
integer kernel.  What the rounds gather is a count and a sum for each entry, so nothing but codebooks passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occura.llm.common import Workspace, id_type, lookup, materialize, pack, small_batches, task, unpack

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block; blocks whose boxes are held against the entries at once.
BLOCK, BOXES = 128, 64
#: Components beyond this are an error: distances and sums of smaller ones are exact in 64 bits.
LARGEST = 1 << 26
#: Bits of a place on the curve, and at most so many of one component.
CURVE_BITS, COMPONENT_BITS = 64, 8


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of ``points``, whose components have ``bits`` bits; bits times components is at most 64."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        low = q - np.uint64(1)
        for i in range(n):
            turned = (x[i] & q) > 0
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swapped)
            x[i] ^= swapped
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flips ^= np.where((x[-1] & q) > 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= flips
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key


def box_distances(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest squared distance between each box and each entry, as (boxes, entries)."""
    below, above = entries[None] - low[:, None], high[:, None] - entries[None]
    out = np.maximum(np.maximum(-below, -above), 0)
    return (out * out).sum(2), (np.maximum(below, above) ** 2).sum(2)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each point's nearest entry, of equally near ones the first, and the squared distance."""
    if np.abs(points).max(initial=0) < 1 << 16 and np.abs(entries).max(initial=0) < 1 << 16 and points.shape[1] < 1 << 16:
        dots = (points.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)  # below 2 ** 53, so exact
    else:
        dots = points @ entries.T
    far = (entries * entries).sum(1) - 2 * dots
    best = far.argmin(1)
    return best, far[np.arange(len(points)), best] + (points * points).sum(1)


def assigned(batch: pa.RecordBatch, part: int, entries: np.ndarray, kind: str, whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(number in the batch, indexes, points, squared distances) of each block of ``part``; where one entry is left, one index without points, unless ``whole``."""
    chosen = np.flatnonzero(batch.column("part").to_numpy() == part)
    width = entries.shape[1]
    for start in range(0, len(chosen), BOXES):
        some = chosen[start : start + BOXES]
        low, high = (np.frombuffer(b"".join(batch.column(c).take(pa.array(some)).to_pylist()), "<i8").reshape(len(some), width) for c in ("low", "high"))
        least, most = box_distances(low, high, entries)
        listed = least <= most.min(1)[:, None]
        for k, at in enumerate(some.tolist()):
            short = np.flatnonzero(listed[k])
            if len(short) == 1 and not whole:
                yield at, short, None, None
                continue
            points = unpack(batch.column("body")[at].as_py(), kind).reshape(-1, width).astype(np.int64)
            best, error = nearest(points, entries[short])
            yield at, short[best], points, error


def _rows(base: DataFrame, id_type_: str, label_type: str, width: int, bits: int, low: float, step: float, kind: str) -> DataFrame:
    """A row for each vector and part: its place on the part's curve and its components; id and label go with the first part."""
    size = width // PARTS
    seen = min(size, CURVE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            points = batch.column("ints").flatten().to_numpy().reshape(n, width)
            for part in range(PARTS):
                own = points[:, part * size : (part + 1) * size]
                cells = np.clip(np.floor((own[:, :seen] - low) / step), 0, (1 << bits) - 1)
                raw = np.ascontiguousarray(own.astype(kind)).tobytes()
                bodies = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(raw) // n), n, [None, pa.py_buffer(raw)]).cast(pa.binary())
                more = [batch.column(c) if part == 0 else pa.nulls(n, batch.column(c).type) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(hilbert_keys(cells, bits).view(np.int64)), batch.column("row"), bodies, *more], ["part", "place", "row", "body", "id", "label"])

    return base.mapInArrow(task(run), f"part int, place bigint, row bigint, body binary, id {id_type_}, label {label_type}")


def _blocks(rows: DataFrame, id_type_: str, label_type: str, size: int, kind: str) -> DataFrame:
    """The sorted rows in blocks of up to BLOCK rows of one part, with box and sums."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        points = np.frombuffer(b"".join(rows.column("body").to_pylist()), kind).reshape(-1, size)
        wide = points.astype(np.int64)
        part = rows.column("part")[0].as_py()
        fields = [x.astype("<i8").tobytes() for x in (wide.min(0), wide.max(0), wide.sum(0))]
        more = [pa.array([rows.column(c).to_pylist() if part == 0 else None], pa.list_(rows.schema.field(c).type)) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(points)], pa.int64()), *(pa.array([x], pa.binary()) for x in (pack(rows.column("row").to_numpy().astype("<i8")), pack(points.reshape(-1)), *fields)), *more],
            ["part", "n", "rows", "body", "low", "high", "sums", "ids", "labels"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            parts = kept.column("part").to_numpy()
            ends = [*(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            start = 0
            for end in ends:
                while end - start >= BLOCK or (end < len(parts) and end > start):
                    n = min(BLOCK, end - start)
                    yield block(kept.slice(start, n))
                    start += n
            kept = kept.slice(start).combine_chunks()
        if kept is not None and kept.num_rows:
            yield block(kept)

    return rows.mapInArrow(task(run), f"part int, n bigint, rows binary, body binary, low binary, high binary, sums binary, ids array<{id_type_}>, labels array<{label_type}>")


def _gathered(blocks: DataFrame, books: list[np.ndarray], kind: str) -> DataFrame:
    """(part, entry, n, s0, s1, …): how many rows of the blocks are nearest to each entry, and their sums."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    size = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for part, entries in enumerate(books):
                codes, points = [], []
                for at, best, own, _ in assigned(batch, part, entries, kind, whole=False):
                    if own is None:
                        counts[part][best[0]] += batch.column("n")[at].as_py()
                        sums[part][best[0]] += np.frombuffer(batch.column("sums")[at].as_py(), "<i8")
                    else:
                        codes.append(best)
                        points.append(own)
                if codes:
                    code, point = np.concatenate(codes), np.concatenate(points)
                    order = np.argsort(code, kind="stable")
                    used, first, times = np.unique(code[order], return_index=True, return_counts=True)
                    counts[part][used] += times
                    sums[part][used] += np.add.reduceat(point[order], first, axis=0)
        for part, (n, total) in enumerate(zip(counts, sums, strict=True)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), *(pa.array(np.ascontiguousarray(total[used, k])) for k in range(size))],
                ["part", "entry", "n", *(f"s{k}" for k in range(size))],
            )

    columns = "".join(f", s{k} bigint" for k in range(size))
    found = blocks.select("part", "n", "body", "low", "high", "sums").mapInArrow(task(run), f"part int, entry int, n bigint{columns}")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(size)))


def _codes(blocks: DataFrame, books: list[np.ndarray], kind: str, id_type_: str, label_type: str) -> DataFrame:
    """(row, part, code, error, id, label) of every row and part."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, entries in enumerate(shared.value):
                for at, best, _, error in assigned(batch, part, entries, kind, whole=True):
                    n = len(best)
                    more = [batch.column(c)[at].values if part == 0 else pa.nulls(n, batch.column(c).type.value_type) for c in ("ids", "labels")]
                    yield pa.RecordBatch.from_arrays([pa.array(unpack(batch.column("rows")[at].as_py(), "<i8")), pa.array(np.full(n, part, np.int32)), pa.array(best.astype(np.int32)), pa.array(error), *more], ["row", "part", "code", "error", "id", "label"])

    return blocks.select("part", "rows", "body", "low", "high", "ids", "labels").mapInArrow(task(run), f"row bigint, part int, code int, error bigint, id {id_type_}, label {label_type}")


def trained(first: list[np.ndarray], gather: Callable[[list[np.ndarray]], list], rounds: int) -> list[np.ndarray]:
    """The codebooks after so many rounds; gather gives (part, entry, n, sums …) of the entries that were nearest to a row."""
    books = first
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for part, entry, n, *sums in gather(books):
            books[part][entry] = np.array(sums, np.int64) // n  # rounds down
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, entries: int = ENTRIES, rounds: int = ROUNDS, work: Workspace | None = None) -> DataFrame:
    """One row per kept vector: id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Rows whose vector is null or empty, or holds null or non-finite components, are dropped.  Components become floor(1024 x).  The codebooks
    begin with the parts of the ``entries`` rows of smallest id; rows that share an id come in the order of their components, rows with a null
    id after all others, and with fewer rows the codebooks are smaller.  A round moves each entry to the rounded-down mean of the
    parts nearest to it; equal distances go to the lower index, so of equal entries the later ones stay as they are.  Repeated rows give a row each,
    null labels are one label, and other columns are not read.  An empty table gives no rows.

    The vectors must have one length, divisible by four, and components below 65536 in size (else ValueError): all arithmetic is exact in 64 bits.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    work = work or Workspace(spark, "vectors")
    kinds = id_type(vectors, id_col), id_type(vectors, label_col)
    size = F.size("v")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(F.col("v").isNotNull() & (size > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))))
    scaled = F.transform("v", lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-2.0 * LARGEST / SCALE)), F.lit(2.0 * LARGEST / SCALE)) * SCALE).cast("int"))
    base = work.materialize(kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", scaled.alias("ints")), "base")
    add = lambda f: F.aggregate("ints", F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    known = base.select(F.size("ints").alias("n"), F.array_min("ints").alias("low"), F.array_max("ints").alias("high"), add(lambda x: x).alias("sum"), add(lambda x: x * x).alias("squares"))
    seen = known.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.avg("sum").alias("sum"), F.avg("squares").alias("squares")).first()
    if seen["least"] is None:
        return base.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = seen["least"]
    if width != seen["most"] or width % PARTS:
        raise ValueError(f"vectors need one length that {PARTS} divides; they have {width} to {seen['most']} components")
    if max(-seen["low"], seen["high"]) >= LARGEST:
        raise ValueError(f"components must lie between {-LARGEST // SCALE} and {LARGEST // SCALE}")
    kind = "<i2" if max(-seen["low"], seen["high"]) < 1 << 15 else "<i4"
    mean = seen["sum"] / width
    spread = max(1.0, (seen["squares"] / width - mean * mean) ** 0.5)
    part_width = width // PARTS
    bits = max(1, min(COMPONENT_BITS, CURVE_BITS // part_width))
    low, step = mean - 2.5 * spread, 5 * spread / (1 << bits)  # where the curve is fine; the ends take what lies beyond

    begin = base.select("id", "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    first = [np.array([r["ints"][p * part_width : (p + 1) * part_width] for r in begin], np.int64) for p in range(PARTS)]
    sorted_rows = _rows(base, *kinds, width, bits, low, step, kind).repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    blocks = work.materialize(_blocks(sorted_rows, *kinds, part_width, kind), "blocks")
    books = trained(first, lambda books: _gathered(blocks, books, kind).collect(), rounds)

    code = F.concat(*(F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("code"))))), 2, "0") for p in range(PARTS)))
    coded = _codes(blocks, books, kind, *kinds).groupBy("row").agg(F.max("id").alias("id"), F.max("label").alias("label"), code.alias("code"), F.sum("error").alias("error"))
    coded = materialize(coded.withColumns({"none": F.col("label").isNull(), "of": F.coalesce(F.col("label").cast("string"), F.lit(""))}), "vector_codes")
    work.drop()
    by_label = coded.groupBy("none", "of").agg(F.sum("error").alias("label_error"))
    found = lookup(coded, by_label, ["none", "of"], "row")
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
