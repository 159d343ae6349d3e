"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character, so no merge crosses from one marked word
into the next: the ids of a text are those of its marked words in order.  Three steps:

- The corpus is cut into segments: the distinct chunks of some texts, dealt to buckets by their hash, and the texts as
  packed numbers of chunks.  Chunks and texts go different ways, so the files are read for either; a mark tells that they agree.
- The segments' chunks are brought together by bucket.  All occurrences of a chunk meet there, and the library segments and
  decodes each distinct chunk once.
- The answers go back to their segments, where the texts are joined together by the positions of their chunks.

A chunk is a word with the spaces before it but one.  A text that can't be cut so (it is empty, ends in a space, or holds
the marker itself) is a chunk of its own, as are leading spaces with the word behind them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occura.llm.common import Dealt, group, id_type, pack, schema_of, slices, steady, task, texts_of, unpack

MARK = "▁"
#: Bytes of text in a segment; bytes of all texts for each bucket of chunks.
SEGMENT_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
#: How a chunk stands in a text: behind a space or at the start, or by itself.
INSIDE, ALONE = b"-", b"="
_CHUNK = re.compile(" *[^ ]+")
#: Ends a chunk in a packed list; chunks are written with the byte that UTF-8 never has.
_END = b"\xff"


def pieces_stay_in_chunks(processor: sentencepiece.SentencePieceProcessor) -> bool:
    return not any(MARK in processor.id_to_piece(k).lstrip(MARK) for k in range(processor.get_piece_size()))


def chunks_of(text: bytes) -> list[bytes]:
    """The chunks of a text, each with the byte for how it stands."""
    if not text or text[-1:] == b" " or MARK.encode() in text:
        return [ALONE + text]
    parts = text.split(b" ")
    if b"" in parts:
        found = _CHUNK.findall(text.decode())
        parts = [x.encode() for x in (found[0], *(x[1:] for x in found[1:]))]
    if parts[0][:1] == b" ":  # the marker before the first word stands for no space
        return [ALONE + parts[0], *(INSIDE + x for x in parts[1:])]
    return [INSIDE + x for x in parts]


def segments(texts: DataFrame, buckets: int, whole: bool, segment_bytes: int, chunks: bool) -> DataFrame:
    """(id, body) → per segment one row with its texts, as numbers of chunks, or with ``chunks`` one for each bucket with its chunks in the order of their places.

    ``mark`` is a digest of all the segment's chunks: texts and chunks that go together have the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch, bodies in slices(batches, limit=segment_bytes):
            dealt = Dealt.of((chunks_of(b or b"") if whole else [ALONE + (b or b"")] for b in bodies), buckets)
            joined = [_END.join(dealt.items[a:b]) for a, b in dealt.groups()]
            mark, n = hashlib.blake2b(_END.join(joined), digest_size=16).digest(), len(joined) if chunks else 1
            own = [pa.array([part << 33 | row] * n, pa.int64()), pa.array([mark] * n, pa.binary())]
            row += 1
            if chunks:
                yield pa.RecordBatch.from_arrays([*own, pa.array(dealt.buckets, pa.int64()), pa.array([zstandard.compress(x, 6) for x in joined], pa.binary())], ["segment", "mark", "bucket", "chunks"])
            else:
                ids = pa.ListArray.from_arrays(pa.array([0, len(bodies)], pa.int32()), batch.column("id"))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([x], pa.binary()) for x in dealt.packed()), pa.array([dealt.lengths], pa.list_(pa.int64())), ids], ["segment", "mark", "tokens", "ranks", "lengths", "ids"])

    columns = "bucket bigint, chunks binary" if chunks else f"tokens binary, ranks binary, lengths array<bigint>, ids array<{id_type(texts, 'id')}>"
    return texts.mapInArrow(task(run), f"segment bigint, mark binary, {columns}")


class Library:
    """The library's answers for distinct chunks: their ids, and the text they decode to behind other text, or else behind a space."""

    def __init__(self, model_path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.lead = self.processor.encode("a")
        self.lead_size = len(self.processor.decode(self.lead))

    def answers(self, chunks: list[bytes]) -> tuple[list[list[int]], list[bytes]]:
        ids = self.processor.encode([c[1:].decode() for c in chunks], num_threads=1)
        inside = [c[:1] == INSIDE for c in chunks]
        plain = self.processor.decode([self.lead + x if own else x for x, own in zip(ids, inside, strict=True)], num_threads=1)
        return ids, [(text[self.lead_size :] if own else f" {text}").encode("utf-8", "surrogatepass") for text, own in zip(plain, inside, strict=True)]


def answered(requests: DataFrame, model_path: str) -> DataFrame:
    """(segment, mark, bucket, chunks) → (segment, mark, bucket, sizes and ids, decoded texts), each distinct chunk of a bucket segmented once."""

    def run(table: pa.Table) -> pa.Table:
        library = Library(model_path)
        number: dict[bytes, int] = {}
        lists = []
        for packed in table.column("chunks").to_pylist():
            chunks = zstandard.decompress(packed).split(_END)
            for c in chunks:
                if c not in number:
                    number[c] = len(number)
            lists.append(np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks)))
        distinct, ids, plain = list(number), [], []
        for at in range(0, len(distinct), 20_000):
            own, text = library.answers(distinct[at : at + 20_000])
            ids += [np.array(x, "<u4").tobytes() for x in own]
            plain += text
        out = []
        for numbers in lists:
            own = numbers.tolist()
            sizes = np.array([len(ids[k]) // 4 for k in own], "<u4")
            out.append([pack(sizes), pack(np.frombuffer(b"".join([ids[k] for k in own]), "<u4")), zstandard.compress(_END.join([plain[k] for k in own]), 6)])
        return pa.table([table.column("segment"), table.column("mark"), table.column("bucket"), *(pa.array(list(x), pa.binary()) for x in zip(*out, strict=True))], names=["segment", "mark", "bucket", "sizes", "ids", "plain"])

    return requests.groupBy("bucket").applyInArrow(group(run), "segment bigint, mark binary, bucket bigint, sizes binary, ids binary, plain binary")


def encode_decode(docs: DataFrame, model_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens (with the end id), ids_sha256, decoded_sha256, and with ``with_ids`` the ids and the decoded text.

    A null text is taken as empty: one id, the end.  Repeated rows and null ids give a row each; other columns are not read.
    Where pieces can cross whitespace markers, every whole text is a chunk, so that equal texts are segmented once.

    A segment's memory is bounded by ``segment_bytes`` or one longer text.  A bucket holds a list of its chunks from every segment; the number of
    buckets follows the bytes of all texts, so the lists stay short, but a bucket of chunks that all segments have grows with their number.
    """
    texts = texts_of(steady(docs, "texts"), id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    whole = pieces_stay_in_chunks(sentencepiece.SentencePieceProcessor(model_file=model_path))
    buckets = 1 + total // BUCKET_BYTES
    replies = answered(segments(texts, buckets, whole, segment_bytes, True), model_path)
    of_text = segments(texts, buckets, whole, segment_bytes, False).withColumnRenamed("segment", "of")

    def join(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if {left.column("mark")[0].as_py()} != set(right.column("mark").to_pylist()):
            raise RuntimeError("the texts were not the same when they were read again")
        listed: list[str] = []
        plain: list[bytes] = []
        sizes, flat = [], []
        for k in np.argsort(right.column("bucket").to_numpy()).tolist():
            flat.append(unpack(right.column("ids")[k].as_py(), "<u4"))
            sizes.append(unpack(right.column("sizes")[k].as_py(), "<u4").astype(np.int64))
            plain += zstandard.decompress(right.column("plain")[k].as_py()).split(_END)
            decimal, ends = list(map(str, flat[-1].tolist())), np.cumsum(sizes[-1]).tolist()
            listed += [" ".join(decimal[e - m : e]) for e, m in zip(ends, sizes[-1].tolist(), strict=True)]
        per, ids = np.concatenate(sizes), np.concatenate(flat).astype(np.int32)
        starts, some_empty = np.cumsum(per) - per, bool((per == 0).any())
        tokens = Dealt.places(left.column("tokens")[0].as_py(), left.column("ranks")[0].as_py())
        at, counts, digests, of_plain, streams, decoded = 0, [], [], [], [], []
        for n in left.column("lengths").combine_chunks().values.to_pylist():
            own = tokens[at : at + n]
            at += n
            strings = list(map(listed.__getitem__, own.tolist()))
            text = b"".join(map(plain.__getitem__, own.tolist()))[1:]
            counts.append(int(per[own].sum()) + 1)
            digests.append(hashlib.sha256(" ".join([*filter(None, strings), str(end_id)] if some_empty else [*strings, str(end_id)]).encode()).hexdigest())
            of_plain.append(hashlib.sha256(text).hexdigest())
            if with_ids:
                before = np.cumsum(per[own]) - per[own]
                streams.append(np.r_[ids[np.repeat(starts[own] - before, per[own]) + np.arange(counts[-1] - 1)], np.int32(end_id)])
                decoded.append(text)
        columns = [left.column("ids").combine_chunks().values, pa.array(counts, pa.int64()), pa.array(digests), pa.array(of_plain)]
        if with_ids:
            columns += [pa.array(streams, pa.list_(pa.int32())), pa.array(decoded, pa.binary()).cast(pa.string())]
        return pa.table(columns, names=kinds.names)

    kinds = schema_of(docs, [id_col], "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
    return of_text.groupBy("of").cogroup(replies.groupBy("segment")).applyInArrow(group(join), kinds)
