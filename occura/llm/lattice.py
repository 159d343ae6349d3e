"""Language-model scoring by the lattice of all segmentations into vocabulary pieces.

A text is a sequence of marked words and one end; each word's probability is the sum over all ways to cut it into
pieces of an existing vocabulary, each way weighing the product of its pieces' unigram probabilities, by a forward
recursion in log space.  The vocabulary file has pieces but, being one of merges, ranks in place of probabilities;
those are the smoothed frequencies of the pieces in the training texts, as the library itself segments them.

The corpus is first written as segments: the distinct words of some texts, dealt to buckets by their hash, and the texts as
packed numbers of words.  A word travels once per segment instead of once per occurrence, which also levels very frequent
words; all its counts meet in its bucket, where it is weighed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occura.llm.common import Dealt, group, id_type, materialize, pack, schema_of, slices, task, texts_of, unpack

#: Bytes of text in a segment; bytes of all texts for each bucket of words.
SEGMENT_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
MARK = "▁"


def segments(docs: DataFrame, id_col: str, text_col: str, held_out: Column, buckets: int, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Per segment one row with ids, held-out flags, word counts of its texts and the texts as numbers, and one for each bucket with words and their training counts."""
    rows = texts_of(docs, id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("held"))
    kind = id_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch, bodies in slices(batches, limit=segment_bytes):
            dealt = Dealt.of(((b or b"").lower().split() for b in bodies), buckets)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            train = np.bincount(dealt.tokens[np.repeat(~held, dealt.lengths)], minlength=len(dealt.items)).astype("<u4")[dealt.ranks]
            words = [zstandard.compress(b" ".join(dealt.items[a:b]), 1) for a, b in dealt.groups()]
            counts = [pack(train[a:b]) for a, b in dealt.groups()]
            own, n, texts = part << 33 | row, len(words), len(bodies)
            column = lambda first, others, kind: pa.array([first, *others], kind)  # noqa: E731  one row for the texts, then one for each bucket
            yield pa.RecordBatch.from_arrays(
                [column(own, [own] * n, pa.int64()), *(column(x, [None] * n, pa.binary()) for x in dealt.packed()), column(dealt.lengths, [None] * n, pa.list_(pa.int64())), pa.ListArray.from_arrays(column(0, [texts] * (n + 1), pa.int32()), batch.column("id")),
                 column(held, [None] * n, pa.list_(pa.bool_())), column(None, dealt.buckets, pa.int64()), column(None, words, pa.binary()), column(None, counts, pa.binary())],
                ["segment", "tokens", "ranks", "lengths", "ids", "held", "bucket", "words", "train"],
            )
            row += 1

    return rows.mapInArrow(task(run), f"segment bigint, tokens binary, ranks binary, lengths array<bigint>, ids array<{kind}>, held array<boolean>, bucket bigint, words binary, train binary")


def word_table(requests: DataFrame, model_path: str) -> DataFrame:
    """One row per bucket: its distinct words with their training counts, how many tokens and words these are, and how often the library's segmentation of them uses each piece."""

    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        at, times = [], []
        for words, train in zip(table.column("words").to_pylist(), table.column("train").to_pylist(), strict=True):
            own = zstandard.decompress(words).split(b" ")
            at.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
            times.append(unpack(train, "<u4"))
        counts = np.bincount(np.concatenate(at), weights=np.concatenate(times), minlength=len(number)).astype(np.int64)
        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = np.zeros(processor.get_piece_size(), np.int64)
        distinct, seen = list(number), np.flatnonzero(counts)
        for start in range(0, len(seen), 20_000):
            own = seen[start : start + 20_000]
            ids = processor.encode([distinct[k].decode("utf-8", "replace") for k in own.tolist()], num_threads=1)
            np.add.at(pieces, np.fromiter((k for x in ids for k in x), np.int64), np.repeat(counts[own], [len(x) for x in ids]))
        used = np.flatnonzero(pieces)
        return pa.table([table.column("bucket")[:1], pa.array([zstandard.compress(b" ".join(distinct), 1)], pa.binary()), pa.array([pack(counts)], pa.binary()), pa.array([int(counts.sum())]), pa.array([len(seen)]), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([pieces[used].tolist()], pa.list_(pa.int64()))], names=["bucket", "words", "counts", "tokens", "distinct", "pieces", "times"])

    return requests.groupBy("bucket").applyInArrow(group(run), "bucket bigint, words binary, counts binary, tokens bigint, distinct bigint, pieces array<int>, times array<bigint>")


class PieceLattice:
    """Log10 probabilities of marked words over all segmentations, and of the end of a text.

    A character that no piece covers alone is its bytes' pieces; where the vocabulary has no pieces for bytes, it is the
    unknown piece, which counts as one that was never used.
    """

    def __init__(self, model_path: str, counts: dict[int, int], ends: int):
        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = processor.get_piece_size()
        usable = [k for k in range(size) if not (processor.is_control(k) or processor.is_unknown(k) or processor.is_unused(k))]
        known_bytes = any(processor.is_byte(k) for k in usable)
        total = math.log(sum(counts.values()) + ends + len(usable) + 1 + (not known_bytes))
        log = {k: math.log(counts.get(k, 0) + 1) - total for k in usable}
        self.end = (math.log(ends + 1) - total) / math.log(10)
        self.unknown = None if known_bytes else -total
        self.bytes = [0.0] * 256
        self.pieces: dict[str, float] = {}
        for k, value in log.items():
            piece = processor.id_to_piece(k)
            if processor.is_byte(k):
                self.bytes[int(piece[3:-1], 16)] = value
            else:
                self.pieces[piece] = value
        self.longest = max(map(len, self.pieces), default=1)

    def word(self, text: str) -> float:
        """Forward recursion over a word as the file's clean-up gives it, with its marker."""
        pieces, longest = self.pieces, self.longest
        n = len(text)
        ahead: list[float | None] = [None] * (n + 1)
        ahead[0] = 0.0
        for i in range(n):
            here = ahead[i]
            if here is None:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                p = pieces.get(text[i:j])
                if p is None:
                    if j > i + 1:
                        continue
                    p = self.unknown if self.unknown is not None else sum([self.bytes[b] for b in text[i].encode("utf-8", "surrogatepass")])
                p += here
                before = ahead[j]
                if before is None:
                    ahead[j] = p
                elif before > p:
                    ahead[j] = before + math.log1p(math.exp(p - before))
                else:
                    ahead[j] = p + math.log1p(math.exp(before - p))
        return ahead[n] / math.log(10)


def lattice_scores(docs: DataFrame, model_path: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Tokens are A-Z lower-cased words (anything but space and \\x09-\\x0D) and one end per text.  Counts come from the rows
    that ``held_out`` leaves (a null flag does not hold a row out).  A null text is empty: its one token is the end.  Without
    training rows every count is 0.  Repeated rows count and score each; other columns are not read.

    A segment's memory is bounded by SEGMENT_BYTES or one longer text.  A bucket holds a list of its words from every segment; the number of buckets
    follows the bytes of all texts, so the lists stay short, but a bucket of words that all segments have grows with their number.  Only sums and the piece counts, bounded by the vocabulary, come to the driver.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    store = materialize(segments(docs, id_col, text_col, held_out, 1 + total // BUCKET_BYTES), "segments")
    requests = store.filter("bucket is not null").select("segment", "bucket", "words", "train")
    words = materialize(word_table(requests.select("bucket", "words", "train"), model_path), "words")
    ends = store.select(F.explode("held").alias("held")).filter("not held").count()
    size = words.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    train_tokens, distinct = (size["n"] or 0) + ends, (size["v"] or 0) + (ends > 0)
    used = words.select(F.explode(F.arrays_zip("pieces", "times")).alias("x")).groupBy("x.pieces").agg(F.sum("x.times").alias("n")).collect()  # no more rows than the vocabulary
    lattice = PieceLattice(model_path, {r["pieces"]: r["n"] for r in used}, ends)
    shared = spark.sparkContext.broadcast(lattice)

    def weigh(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Each word of a bucket is weighed once; the answers go to every segment that has it."""
        distinct_words = zstandard.decompress(right.column("words")[0].as_py()).split(b" ")
        processor, score = sentencepiece.SentencePieceProcessor(model_file=model_path), shared.value.word
        number = {w: k for k, w in enumerate(distinct_words)}
        logs = np.array([score(x) for x in processor.normalize([w.decode("utf-8", "replace") for w in distinct_words])])
        counts = unpack(right.column("counts")[0].as_py(), "<i8")
        own = [np.fromiter(map(number.__getitem__, zstandard.decompress(x).split(b" ")), np.int64) for x in left.column("words").to_pylist()]
        return pa.table([left.column("segment"), left.column("bucket"), pa.array([pack(counts[k]) for k in own], pa.binary()), pa.array([pack(logs[k]) for k in own], pa.binary())], names=["segment", "bucket", "counts", "logs"])

    known = words.select(F.col("bucket").alias("of"), "words", "counts")
    replies = requests.select("segment", "bucket", "words").groupBy("bucket").cogroup(known.groupBy("of")).applyInArrow(group(weigh), "segment bigint, bucket bigint, counts binary, logs binary")
    base = lambda c: np.log10((c + 1) / (train_tokens + distinct + 1))
    end_base, end_score = float(base(np.float64(ends))), lattice.end
    kinds = schema_of(docs, [id_col], "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

    def add_up(key, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy()).tolist()
        read = lambda name, kind: np.concatenate([np.empty(0, kind), *(unpack(right.column(name)[k].as_py(), kind) for k in order)])
        counts, logs = read("counts", "<i8"), read("logs", "<f8")
        lengths = left.column("lengths").combine_chunks().values.to_numpy()
        tokens = Dealt.places(left.column("tokens")[0].as_py(), left.column("ranks")[0].as_py())
        n = len(lengths)
        text = np.repeat(np.arange(n), lengths)
        add = lambda x: np.bincount(text, weights=x, minlength=n)
        ids, held = (left.column(c).combine_chunks().values for c in ("ids", "held"))
        return pa.table([ids, held, pa.array(lengths + 1), pa.array(add((counts > 0)[tokens]).astype(np.int64) + (ends > 0)), pa.array(np.full(n, train_tokens, np.int64)), pa.array(add(base(counts)[tokens]) + end_base), pa.array(add(logs[tokens]) + end_score)], names=kinds.names)

    texts = store.filter("tokens is not null").select(F.col("segment").alias("at"), "ids", "held", "lengths", "tokens", "ranks")
    return texts.groupBy("at").cogroup(replies.groupBy("segment")).applyInArrow(group(add_up), kinds)
