"""WARC archives: a writer of whole-file gzip streams and the normaliser that makes them readable record by record.

A monolithic archive is one gzip stream over all its records.  The normaliser inflates that stream once, writes every
record as a gzip member of its own and, beside the archive, an index of offsets; a reader can then take any record
by itself.  Archives lie in the folder that all executors share; each is written under another name and then moved,
so a repeated task replaces it whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura.llm.common import is_at_most, materialize, new_path

#: Bytes of payload after which a task begins another archive, and compression levels.
ARCHIVE_BYTES = 32 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated payloads whose responses are broadcast (about 60 bytes each); with more, pages are shuffled to them, those of
#: one payload dealt over SALT parts.
REPEATED_PAYLOADS = 100_000
SALT = 16


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    """The name of a page's record: its id percent-encoded, so that it holds no line break or bracket; another name for a null id than for an empty one."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(name: str) -> str | None:
    return unquote(name.removeprefix("<urn:page:").removesuffix(">")) if name.startswith("<urn:page:") else None


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    body = http
    if refers_to is None:
        body += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers by lower-case name, the record's block, the record's bytes) of each record of an inflated stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        raw, headers = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line)
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers.get("content-length", 0)))
        yield headers, block, b"".join(raw) + b"\r\n" + block + b"\r\n\r\n"


class Inflated(io.RawIOBase):
    """A gzip stream, of one member or several, read once from front to back in bounded memory."""

    def __init__(self, source, size: int = 1 << 18):
        self.source, self.size, self.left, self.raw = source, size, b"", b""
        self.inflate = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left:
            if self.inflate.eof and (self.raw or self.inflate.unused_data):
                self.raw, self.inflate = self.inflate.unused_data or self.raw, zlib.decompressobj(31)
            data = self.raw or self.source.read(self.size)
            self.raw = b""
            if not data:
                return 0
            self.left = self.inflate.decompress(data, 4 * self.size)
            self.raw = self.inflate.unconsumed_tail
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by: one without is of the default file system, not of each machine's disk."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()


def _place(base: str) -> tuple[fs.FileSystem, str]:
    base = "file://" + base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base
    return fs.FileSystem.from_uri(base)


def _publish(files: fs.FileSystem, temporary: str, final: str) -> None:
    if files.get_file_info(final).type != fs.FileType.NotFound:
        files.delete_file(final)
    files.move(temporary, final)


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row into whole-file gzip archives of about ``archive_bytes`` of payload; one row (archive, records) each.

    The column ``refers_to`` says which rows are revisits.  Nothing is written before the result is used; use it once,
    through a written table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _place(folder)
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        number = size = count = 0
        out = deflate = None

        def end():
            nonlocal out
            out.write(deflate.flush())
            out.close()
            out = None
            final = f"part-{part:06d}-{number:04d}.warc.gz"
            _publish(files, f"{root}/.{final}.{attempt}", f"{root}/{final}")
            return pa.RecordBatch.from_arrays([pa.array([final]), pa.array([count], pa.int64())], ["archive", "records"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, refers = (batch.column(c)[k].as_py() for c in range(4))
                if out is None:
                    out, deflate, size, count = files.open_output_stream(f"{root}/.part-{part:06d}-{number:04d}.warc.gz.{attempt}", compression=None), zlib.compressobj(LEVEL, wbits=31), 0, 0
                out.write(deflate.compress(record(page, url, payload or b"", refers)))
                size, count = size + len(payload or b""), count + 1
                if size >= archive_bytes:
                    yield end()
                    number += 1
        if out is not None:
            yield end()

    rows = pages.select(id_col, F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"), "refers_to")
    return rows.mapInArrow(run, "archive string, records bigint")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record and write ``<archive>.idx`` beside it; one row (archive, offset, length, record_id) per record.

    ``archives`` has a column ``archive``.  The sidecar has a line per record: offset, length, record id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, root), (into, goal) = _place(source), _place(target)
        into.create_dir(goal, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                offset, index = 0, []
                with files.open_input_stream(f"{root}/{name}", compression=None) as raw, into.open_output_stream(f"{goal}/.{name}.{attempt}", compression=None) as out:
                    for headers, _, whole in records(io.BufferedReader(Inflated(raw), 1 << 18)):
                        deflate = zlib.compressobj(LEVEL, wbits=31)
                        member = deflate.compress(whole) + deflate.flush()
                        out.write(member)
                        index.append((offset, len(member), headers.get("warc-record-id", "")))
                        offset += len(member)
                with into.open_output_stream(f"{goal}/.{name}.idx.{attempt}", compression=None) as out:
                    out.write("".join(f"{a} {n} {r}\n" for a, n, r in index).encode())
                _publish(into, f"{goal}/.{name}.{attempt}", f"{goal}/{name}")
                _publish(into, f"{goal}/.{name}.idx.{attempt}", f"{goal}/{name}.idx")
                offsets, lengths, ids = (list(x) for x in zip(*index, strict=True)) if index else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(index)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.string())], ["archive", "offset", "length", "record_id"])

    return archives.select("archive").mapInArrow(run, "archive string, offset bigint, length bigint, record_id string")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Fetch each indexed record by its offset: page (as string), record_type, refers_to (as string), payload_bytes, payload_digest, intact.

    A response's length and digest are those of its payload; a revisit's are what its HTTP and WARC headers say.  ``intact``
    tells that a response's payload has the digest of its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _place(folder)
        name = source = None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, files.open_input_file(f"{root}/{archive}")
                source.seek(offset)
                member = zlib.decompress(source.read(length), wbits=31)
                headers, block, _ = next(records(io.BytesIO(member)))
                http, _, payload = block.partition(b"\r\n\r\n")
                said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                stated = headers["warc-payload-digest"].removeprefix("sha1:")
                revisit = headers["warc-type"] == "revisit"
                found = stated if revisit else payload_digest(payload)
                rows.append((page_of(headers["warc-record-id"]), headers["warc-type"], page_of(headers.get("warc-refers-to", "")), said if revisit else len(payload), found, found == stated))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["page", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"])
        if source:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, "page string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, intact boolean")


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` with ``refers_to``: of rows with equal payloads of ``least_bytes`` or more, the one with the largest id has null, the rest that id.

    Rows that share the largest id are all responses.  Null ids are never the largest; a payload that only they have
    is a response each time.  Payloads are counted in each task first, so a frequent one is no large group.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.withColumn("_key", F.when(F.octet_length(body) >= least_bytes, F.sha1(body.cast("binary"))))
    firsts = rows.filter("_key is not null").groupBy("_key").agg(F.max(id_col).alias("_last"), F.count("*").alias("_n")).filter("_n > 1").select("_key", "_last")
    firsts = materialize(firsts, "firsts")
    if is_at_most(firsts, REPEATED_PAYLOADS):
        found = rows.join(F.broadcast(firsts), "_key", "left")
    else:
        part = F.pmod(F.xxhash64(id_col), F.lit(SALT)).cast("int")
        found = rows.withColumn("_part", part).join(firsts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["_key", "_part"], "left").drop("_part")
    return found.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("_last")), F.col("_last"))).drop("_key", "_last")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and read every record back by the index; one row per row.

    A null payload is an empty one; null urls are empty; an empty table gives no archives and no rows.  Ids of any text, empty, null or with
    line breaks and brackets, come back as they are; repeated rows and ids give a record each.
    """
    spark: SparkSession = pages.sparkSession
    folder = qualified(spark, folder or new_path(spark, "warc"))
    kept = pages.select(id_col, url_col, payload_col)
    written = materialize(write_monolithic(with_revisits(kept, least_bytes, id_col, payload_col), f"{folder}/monolithic", id_col, url_col, payload_col), "archives")
    # A file each is little for a task; as many tasks as there are cores to share them.
    tasks = max(1, min(written.count(), 4 * spark.sparkContext.defaultParallelism))
    index = materialize(normalise(written.repartition(tasks), f"{folder}/monolithic", f"{folder}/archives"), "index")
    kind = pages.schema[id_col].dataType
    return read_records(index, f"{folder}/archives").select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
