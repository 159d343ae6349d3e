"""Folders and small files where Spark's own file systems keep them: scratch folders, committed texts, joined parts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Scratch folders made inside are deleted at the end, so what is read from them has to be written by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            delete(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place that all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to a scratch folder and read back, so that each later use sees the same rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    name, files = _path(spark, path)
    return files.getContentSummary(name).getLength()


def _path(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A file of this text, there as a whole or not at all: written under another name, then moved; an older one gives way."""
    final, files = _path(spark, path)
    temporary, _ = _path(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = files.create(temporary, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.exists(final):
        files.delete(final, False)
    files.rename(temporary, final)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it is not there."""
    name, files = _path(spark, path)
    if not files.exists(name):
        return None
    into = files.open(name)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(into)).decode()
    finally:
        into.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no folder."""
    name, files = _path(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(name)) if files.exists(name) else []


def delete(spark: SparkSession, path: str) -> None:
    name, files = _path(spark, path)
    files.delete(name, True)


def move(spark: SparkSession, path: str, target: str) -> bool:
    """A folder under another name of the same file system; False if it is not there."""
    source, files = _path(spark, path)
    final, _ = _path(spark, target)
    if not files.exists(source):
        return False
    files.mkdirs(final.getParent())
    if files.exists(final) or not files.rename(source, final):
        raise OSError(f"{path} could not become {target}")
    return True


def join_parts(spark: SparkSession, folder: str, target: str, head: str = "", foot: str = "") -> None:
    """One file from the part files of a folder, in the order of their numbers, between a head and a foot.

    The file system joins the parts by reference where it can; else their bytes are copied as a stream, never held whole.
    """
    jvm = spark.sparkContext._jvm
    source, files = _path(spark, folder)
    parts = sorted((f for f in files.listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda f: int(re.match(r"part-(\d+)", f.getPath().getName())[1]))
    parts = [f.getPath() for f in parts if f.getLen()]
    temporary, _ = _path(spark, f"{folder}/_whole")
    out = files.create(temporary, True)
    try:
        out.write(bytearray(head.encode()))
    finally:
        out.close()
    ending, _ = _path(spark, f"{folder}/_foot")
    if foot:
        out = files.create(ending, True)
        try:
            out.write(bytearray(foot.encode()))
        finally:
            out.close()
        parts.append(ending)
    if parts and not _concatenated(spark, files, temporary, parts):
        whole, _ = _path(spark, f"{folder}/_joined")
        out = files.create(whole, True)
        try:
            for part in [temporary, *parts]:
                into = files.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
                finally:
                    into.close()
        finally:
            out.close()
        temporary = whole
    final, _ = _path(spark, target)
    if files.exists(final):
        files.delete(final, True)
    files.mkdirs(final.getParent())
    files.rename(temporary, final)
    files.delete(source, True)


def _concatenated(spark: SparkSession, files, whole, parts: list) -> bool:
    """Whether the file system could append the parts without copying."""
    if files.getScheme() != "hdfs":
        return False
    gateway = spark.sparkContext._gateway
    array = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Path, len(parts))
    for k, part in enumerate(parts):
        array[k] = part
    files.concat(whole, array)
    return True
