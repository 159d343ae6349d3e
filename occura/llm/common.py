"""What the training-data operators share: tables, the shared folder, and Arrow slices of texts."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python task works on at a time, and bytes of rows that it is handed at a time.
SLICE_BYTES, BATCH_BYTES = 2 << 20, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a new local one where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Intermediate tables of one operator in a folder of their own, which goes when its last result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_path(spark, name)

    def materialize(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written, whatever file system it lies in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def straight_from_files(df: DataFrame, more: tuple[str, ...] = ("Project", "Filter", "SubqueryAlias")) -> bool:
    """Whether df is a scan of files, with nothing above it but deterministic steps of these kinds, which keep each row in its task and in its place."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in more and node.deterministic():
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def steady(df: DataFrame, name: str) -> DataFrame:
    """A table that gives the same rows in the same tasks each time it is read: scans of files, filtered or not, as they are; anything else is written once."""
    return df if straight_from_files(df) else materialize(df, name)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python in batches of BATCH_BYTES, unless the session has a value of its own: texts are long, and a task holds several copies of a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864", "67108864b", "64MB", "64m"):  # Spark's own value
        spark.conf.set(name, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, and what it keeps counts beside the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def task(run: Callable) -> Callable:
    """A function over the batches of a task that gives its memory back in the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def group(run: Callable) -> Callable:
    """A function over one or two groups that gives back the memory of those before it."""

    def one(*tables):
        give_back()
        return run(*tables)

    one.__signature__ = inspect.signature(run)
    return one


def texts_of(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the id (as ``id``), the UTF-8 bytes of the text (as ``body``), and what else is named."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"), *more)


def crc_mod(column: Column, n: int) -> Column:
    """crc32(value as text) mod n; a null counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], body: str = "body", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Record batches put together and cut so that each holds about ``limit`` bytes of text, or one longer text, with the texts as a list."""
    for batch in gathered(batches, body, limit):
        for part in cut(batch, pc.binary_length(batch.column(body)), limit):
            yield part, part.column(body).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], body: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones, up to ``limit`` bytes of text."""
    kept: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        n = pc.sum(pc.binary_length(batch.column(body))).as_py() or 0
        if kept and total + n > limit:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, total = [], 0
        kept.append(batch)
        total += n
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def cut(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    start = total = 0
    for k, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if k > start and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if batch.num_rows:
        yield batch.slice(start)


def keep_rows(df: DataFrame, text_col: str, decide: Callable[[list[bytes | None]], np.ndarray], limit: int = SLICE_BYTES) -> DataFrame:
    """The rows for whose texts ``decide`` says so, with all their columns as they are; each row passes through Python once."""
    at = df.columns.index(text_col)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, pc.binary_length(batch.column(at)), limit):
                yield part.filter(pa.array(decide(part.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))

    return df.mapInArrow(task(run), df.schema)


def carried(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The id (as ``id``), the bytes of the text (as ``body``), and all other columns as one struct ``more``, so that no name clashes."""
    return texts_of(df, id_col, text_col, F.struct(F.lit(0).alias("_"), *more).alias("more"))


@dataclass
class Dealt:
    """Texts as numbers of their distinct items.  The numbers are ranks by frequency, which pack well; the items lie by bucket and rank."""

    lengths: np.ndarray
    tokens: np.ndarray
    ranks: np.ndarray
    items: list[bytes]
    buckets: list[int]
    counts: list[int]

    @classmethod
    def of(cls, texts: Iterator[list[bytes]], buckets: int) -> Dealt:
        number: dict[bytes, int] = {}
        found = []
        for items in texts:
            for x in items:
                if x not in number:
                    number[x] = len(number)
            found.append(np.fromiter(map(number.__getitem__, items), np.uint32, len(items)))
        distinct = list(number)
        bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)) % np.uint64(buckets)
        tokens = np.concatenate(found)
        rank = np.empty(len(distinct), np.uint32)
        rank[np.argsort(-np.bincount(tokens, minlength=len(distinct)), kind="stable")] = np.arange(len(distinct), dtype=np.uint32)
        order = np.lexsort((rank, bucket))
        used, counts = np.unique(bucket, return_counts=True)
        return cls(np.array([len(x) for x in found], np.int64), rank[tokens], rank[order], [distinct[k] for k in order.tolist()], used.astype(np.int64).tolist(), counts.tolist())

    def packed(self) -> list[bytes]:
        return [pack(self.tokens), pack(np.diff(self.ranks, prepend=np.uint32(0)))]

    @staticmethod
    def places(tokens: bytes, ranks: bytes) -> np.ndarray:
        """The texts as places in the list of items."""
        order = np.cumsum(unpack(ranks, "<u4"), dtype=np.uint32)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place[unpack(tokens, "<u4")]

    def groups(self) -> Iterator[tuple[int, int]]:
        """Where each bucket's items begin and end."""
        end = 0
        for n in self.counts:
            end += n
            yield end - n, end


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 3)


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw, width = zstandard.decompress(data), np.dtype(kind).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).tobytes(), kind)


def schema_of(df: DataFrame, names: list[str], more: str) -> StructType:
    """Columns of df, as they are, followed by others."""
    return StructType([df.schema[n] for n in names] + StructType.fromDDL(more).fields)


def is_at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a table proven to have at most ``rows`` narrow rows; else df as it is, for a shuffled join."""
    return F.broadcast(df) if is_at_most(df, rows) else df


#: Tasks over which the rows of one key are spread in a lookup.
SALTS = 64


def lookup(rows: DataFrame, table: DataFrame, key: list[str], by: str, how: str = "inner", small: int = 10_000) -> DataFrame:
    """rows with the columns that ``table`` (one row a key) has for their key, however many rows a key has.

    A small table is broadcast.  Else rows get a salt from the column ``by``; each key and salt that occurs is asked for once, so
    that a key has no more questions than there are salts, and its rows meet the answers in as many tasks.
    """
    if is_at_most(table, small):
        return rows.join(F.broadcast(table), key, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    answers = salted.select(*key, "_salt").distinct().join(table, key)
    return salted.join(answers, [*key, "_salt"], how).drop("_salt")
