"""Content-addressed store of token ids.

Documents are encoded, their id streams cut where a rolling hash of the last ids says so, and every distinct chunk is
stored once under its digest.  A document is a recipe, the digests of its chunks in order with their Merkle
root; recipes lie in ascending order of the document's id.  The manifest has, for each file of recipes, the Merkle root over its
documents, and the store has a root over the manifest.  Reading back recomputes digests, roots, counts and checksums
from the stored bytes and compares them.

Layout below one folder: ``store`` (chunks: key, n, payload, which are ids as little-endian 16 or 32 bits), ``recipes`` (seg,
row, id, keys, sizes, n_tokens, before, root), ``manifest`` (seg, root, documents, tokens) and ``root`` (one row).
"""

from __future__ import annotations

import hashlib
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from occura.llm.common import id_type, new_path, slices, task, texts_of

#: Ids in a chunk: fewest, most; and the bits of the rolling hash that must be 0 for a cut.
LEAST, MOST, CUT_BITS = 64, 2048, 8
ROLLING = 8
KEY_BYTES = 16
#: Distinct words, and word parts, that a Python worker keeps, and distinct chunks of a task.
KNOWN_WORDS, KNOWN_PARTS, KNOWN_CHUNKS = 800_000, 1_200_000, 2_000_000

#: What an empty store has no file to tell.
CHUNKS = "key binary, n bigint, payload binary, sizes binary, kind string"

_GEAR = np.random.default_rng(9).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


class WordIds(dict):
    """Distinct word → its ids as little-endian bytes.  Words are what lies between ASCII white space, which no token crosses.

    Words of visible characters up to U+00FF pass the file's clean-up unchanged but for case; they are cut by the file's own
    pattern, and each distinct part is segmented once by the library's model.  All other words, and all words of files
    with another clean-up or pattern, go through the library's whole encoding.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.marks = regex.compile("|".join([regex.escape(t["content"]) for t in about["added_tokens"]]) or r"(?!)")
        self.tokenize = self.tokenizer.model.tokenize
        self.parts: dict[str, bytes] = {}
        cleaned = [n.get("type") for n in (about.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        steps = (about.get("pre_tokenizer") or {}).get("pretokenizers", [])
        usual = [t.get("type") for t in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if cleaned and usual and about["model"]["type"] == "BPE" and not about["post_processor"] else None
        self.runs = self.pattern is not None and self.pattern.findall("abcxyz.") == ["abcxyz", "."]  # a run of ASCII letters is one part
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.byte_signs = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}  # how byte-level vocabularies write bytes
        self.plain = regex.compile("[!-~¡-ÿ]+")

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            signs = part if part.isascii() else "".join([self.byte_signs[b] for b in part.encode()])
            ids = self.pack([t.id for t in self.tokenize(signs)])
            if len(self.parts) < KNOWN_PARTS:
                self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.runs and word.isalpha():
            ids = self._part(text.lower())
        elif self.runs and word[:-1].isalpha() and text[-1] in ".,":
            ids = self._part(text[:-1].lower()) + self._part(text[-1])
        elif self.pattern is None or not self.plain.fullmatch(text) or self.marks.search(text):
            ids = self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            parts = self.pattern.findall(text.lower())
            ids = self._part(parts[0]) if len(parts) == 1 else b"".join([self._part(p) for p in parts])
        if len(self) < KNOWN_WORDS:
            self[word] = ids
        return ids

    def encode(self, bodies: list[bytes | None]) -> list[bytes]:
        look = self.__getitem__
        return [b"".join(map(look, (b or b"").split())) for b in bodies]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's table for a file: a Python worker serves many tasks, and words that it knows stay known."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def cut_points(ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of id streams that lie one behind the other, each list from its stream's start on."""
    h = _GEAR[ids & 0xFFFF]
    for k in range(1, ROLLING):
        h[k:] += _GEAR[ids[:-k] & 0xFFFF] << np.uint64(k)
    candidates = np.flatnonzero((h >> np.uint64(20)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    starts = np.cumsum(lengths) - lengths
    first = np.searchsorted(candidates, starts + LEAST)
    last = np.searchsorted(candidates, starts + lengths)
    out = []
    for start, n, a, b in zip(starts.tolist(), lengths.tolist(), first.tolist(), last.tolist(), strict=True):
        ends, at = [], 0
        for c in (candidates[a:b] - start).tolist():
            while c - at > MOST:
                at += MOST
                ends.append(at)
            if c - at >= LEAST:
                at = c
                ends.append(c)
        while n - at > MOST:
            at += MOST
            ends.append(at)
        if at < n:
            ends.append(n)
        out.append(ends)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over digests in order; an odd one moves up as it is; none: the digest of nothing."""
    level = leaves
    while len(level) > 1:
        level = [digest(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else digest(b"")


def _split(keys: bytes) -> list[bytes]:
    return [keys[k : k + KEY_BYTES] for k in range(0, len(keys), KEY_BYTES)]


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encode every row's whole text, append the end id, and store; returns the folder.

    A null text is taken as empty.  Repeated rows are a recipe each and share their chunks.  Chunks and recipes move through
    one shuffle, chunks by digest and recipes by id and root, so that rows without an id are no one file.  Equal chunks are dropped in each task before it, but for those that a task has forgotten since
    (it remembers KNOWN_CHUNKS), and all others behind it, where they are neighbours in sorted order.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "castore")
    kind = id_type(docs, id_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met = word_ids(tokenizer_path), set()
        tail, width = np.array([end_id], words.kind).tobytes(), int(words.kind[2])
        for batch, bodies in slices(batches, limit=2 << 20):
            raw = [x + tail for x in words.encode(bodies)]
            lengths = np.array([len(x) // width for x in raw], np.int64)
            keys, sizes, payloads, recipes, counts, roots = [], [], [], [], [], []
            for data, ends in zip(raw, cut_points(np.frombuffer(b"".join(raw), words.kind), lengths), strict=True):
                own, start = [], 0
                for end in ends:
                    payload = data[start * width : end * width]
                    key = digest(payload)
                    own.append(key)
                    if key not in met:
                        if len(met) > KNOWN_CHUNKS:
                            met.clear()
                        met.add(key)
                        keys.append(key)
                        sizes.append(end - start)
                        payloads.append(payload)
                    start = end
                recipes.append(b"".join(own))
                counts.append(np.diff(np.array([0, *ends])).astype("<u4").tobytes())
                roots.append(merkle_root(own))
            a, b = len(bodies), len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["recipe"] * a + ["chunk"] * b), pa.concat_arrays([batch.column("id"), pa.nulls(b, batch.column("id").type)]), pa.array(roots + keys, pa.binary()), pa.array(lengths.tolist() + sizes, pa.int64()), pa.array(recipes + payloads, pa.binary()),
                 pa.array(counts + [None] * b, pa.binary())],
                ["kind", "id", "key", "n", "payload", "sizes"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # equal digests are neighbours
        for batch in batches:
            keys = pc.if_else(pc.equal(batch.column("kind"), "chunk"), batch.column("key"), None).to_pylist()
            before, last = [last, *keys[:-1]], keys[-1] if keys else last
            yield batch.filter(pa.array([k is None or k != b for k, b in zip(keys, before, strict=True)], pa.bool_()))

    schema = f"kind string, id {kind}, key binary, n bigint, payload binary, sizes binary"
    where = F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64(F.col("id").cast("string"), "key"))
    rows = texts_of(docs, id_col, text_col).mapInArrow(task(encode), schema)
    rows.repartition(where).sortWithinPartitions("kind", "key").mapInArrow(task(once), schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/store")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, row, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            start = before + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pa.array([seg] * len(n), pa.int32()), pa.array(range(row, row + len(n)), pa.int64()), batch.column("id"), batch.column("payload"), batch.column("sizes"), batch.column("n"), pa.array(start), batch.column("key")], ["seg", "row", "id", "keys", "sizes", "n_tokens", "before", "root"])
            row, before = row + len(n), before + int(n.sum())

    stored = spark.read.schema(f"id {kind}, {CHUNKS}").parquet(f"{path}/store")
    recipes = stored.filter("kind = 'recipe'").select("id", "key", "n", "payload", "sizes").repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    recipes.mapInArrow(task(number), f"seg int, row bigint, id {kind}, keys binary, sizes binary, n_tokens bigint, before bigint, root binary").write.parquet(f"{path}/recipes")

    sealed = _sealed(spark.read.parquet(f"{path}/recipes"))
    sealed.coalesce(1).write.parquet(f"{path}/manifest")  # a row per file of recipes
    _summary(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/root")
    return path


def _sealed(recipes: DataFrame) -> DataFrame:
    """For each file of recipes the Merkle root over its documents in order, and how many documents and tokens it has."""

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for seg, row, root, n in zip(*(batch.column(c).to_pylist() for c in ("seg", "row", "root", "n_tokens")), strict=True):
                own = found.setdefault(seg, [[], 0])
                own[0].append((row, root))
                own[1] += n
        for seg, (roots, n) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([merkle_root([r for _, r in sorted(roots)])], pa.binary()), pa.array([len(roots)], pa.int64()), pa.array([n], pa.int64())], ["seg", "root", "documents", "tokens"])

    return recipes.select("seg", "row", "root", "n_tokens").repartition("seg").mapInArrow(task(seal), "seg int, root binary, documents bigint, tokens bigint")


def _summary(manifest: DataFrame) -> DataFrame:
    """One row over the manifest: files, documents, tokens, and the digest of the files' roots in order."""
    roots = F.transform(F.array_sort(F.collect_list(F.struct("seg", "root"))), lambda x: F.hex(x["root"]))
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sha2(F.array_join(roots, ","), 256).alias("root"))


class StoreDamaged(ValueError):
    """A store whose files are not those that were written."""


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raise StoreDamaged unless the manifest is the one whose root was written, and each of its files of recipes is there, whole."""
    manifest = spark.read.parquet(f"{path}/manifest")
    written, now = spark.read.parquet(f"{path}/root").first(), _summary(manifest).first()
    if written != now:
        raise StoreDamaged(f"the manifest has changed: {written} was written, {now} is there")
    found = _sealed(spark.read.parquet(f"{path}/recipes"))
    odd = manifest.exceptAll(found).union(found.exceptAll(manifest)).select("seg").distinct().limit(20).collect()
    if odd:
        raise StoreDamaged(f"files of recipes differ from the manifest: {sorted(r['seg'] for r in odd)}")


def _zero_bytes_table() -> np.ndarray:
    """[k, j, v]: what 2^k zero bytes make of a crc32 whose byte j is v."""

    def apply(columns: list[int], value: int) -> int:
        out = 0
        for k in range(32):
            if value >> k & 1:
                out ^= columns[k]
        return out

    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        step = [apply(step, v) for v in step]
    table = np.zeros((LENGTH_BITS, 4, 256), np.uint32)
    for k in range(LENGTH_BITS):
        for j in range(4):
            for bit in range(8):
                has = (np.arange(256) >> bit & 1).astype(bool)
                table[k, j, has] ^= np.uint32(step[8 * j + bit])
        step = [apply(step, v) for v in step]
    return table


#: Bits of the bytes that may follow a chunk in its document.
LENGTH_BITS = 40


class CrcShift:
    """crc32 values as they count in a string that goes on for so many bytes: the string's crc32 is their XOR."""

    def __init__(self) -> None:
        self.table = _zero_bytes_table()

    def __call__(self, crc: np.ndarray, following: np.ndarray) -> np.ndarray:
        out = crc.astype(np.uint32)
        for k in range(int(following.max(initial=0)).bit_length()):
            at = np.flatnonzero(following >> k & 1)
            x, t = out[at], self.table[k]
            out[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        return out


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per stored document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32, verified.

    Chunks are read where they lie and checked against their digests.  Only counts and checksums are joined to the recipes:
    a document's checksum is the XOR of its chunks', each moved on by the bytes that follow it.  ``verified`` is whether every
    chunk was found, matched its digest and size, the recipe its Merkle root and length, and its file of recipes the manifest.
    A lost document can't have a row; ``check_manifest`` raises for it.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, good = [], []
            for key, n, payload in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "payload")), strict=True):
                crc.append(zlib.crc32(_ids(payload, n, "<u4")))
                good.append(digest(payload) == key)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], ["key", "n", "crc", "good"])

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                keys = [_split(k) for k in rows.column("keys").to_pylist()]
                sizes = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows.column("sizes").to_pylist()]
                sound = [merkle_root(k) == root and x.sum() == n for k, x, root, n in zip(keys, sizes, rows.column("root").to_pylist(), rows.column("n_tokens").to_pylist(), strict=True)]
                counts = np.array([len(k) for k in keys], np.int64)
                following = np.concatenate([np.empty(0, np.int64), *(4 * (x.sum() - np.cumsum(x)) for x in sizes)])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat(rows.column(c).to_numpy(), counts)) for c in ("seg", "row")), pa.array([k for own in keys for k in own], pa.binary()), pa.array(np.concatenate([np.empty(0, np.int64), *sizes])), pa.array(following), pa.array(np.repeat(np.array(sound, bool), counts))],
                    ["seg", "row", "key", "size", "following", "sound"],
                )

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = CrcShift()
        for batch in batches:
            moved = shift(batch.column("crc").to_numpy(), batch.column("following").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("seg"), batch.column("row"), batch.column("n"), pa.array(moved.astype(np.int64)), batch.column("good")], ["seg", "row", "n", "crc", "good"])

    stored = spark.read.schema(CHUNKS).parquet(f"{path}/store").filter("kind = 'chunk'").select("key", "n", "payload")
    chunks = stored.mapInArrow(task(check), "key binary, n bigint, crc bigint, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    whole_files = manifest.join(_sealed(recipes), manifest.columns, "left_semi").select("seg", F.lit(True).alias("sealed"))
    starts = manifest.select("seg", F.coalesce(F.sum("tokens").over(Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")).join(whole_files, "seg", "left")
    refs = recipes.select("seg", "row", "keys", "sizes", "root", "n_tokens").mapInArrow(task(refer), "seg int, row bigint, key binary, size bigint, following bigint, sound boolean")
    parts = refs.join(chunks, "key").select("seg", "row", "n", "crc", "following", (F.col("good") & F.col("sound") & (F.col("size") == F.col("n"))).alias("good"))
    whole = parts.mapInArrow(task(move), "seg int, row bigint, n bigint, crc bigint, good boolean").groupBy("seg", "row").agg(F.sum("n").alias("found"), F.bit_xor("crc").alias("crc"), F.bool_and("good").alias("good"))
    numbered = recipes.select("seg", "row", "id", "before", "n_tokens").join(F.broadcast(starts), "seg")  # a row per file of recipes
    return numbered.join(whole, ["seg", "row"], "left").select(F.col("id").alias(id_col), (F.col("base") + F.col("before")).alias("start"), F.coalesce("found", F.lit(0)).alias("n_tokens"), F.col("crc").alias("ids_crc32"), (F.coalesce("sealed", F.lit(False)) & F.coalesce("good", F.lit(False)) & F.coalesce(F.col("found") == F.col("n_tokens"), F.lit(False))).alias("verified"))


def _ids(payload: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype(kind)


def reconstruct(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The id streams themselves: id, ids array<bigint>, from recipes and chunks."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([_ids(p["payload"], p["n"], np.int64) for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int64()))], [id_col, "ids"])

    recipes = spark.read.parquet(f"{path}/recipes")
    position = F.explode(F.sequence(F.lit(0), (F.octet_length("keys") / KEY_BYTES).cast("int") - 1))
    refs = recipes.select("seg", "row", "id", "keys", position.alias("at")).select("seg", "row", "id", "at", F.substring(F.col("keys"), F.col("at") * KEY_BYTES + 1, F.lit(KEY_BYTES)).alias("key"))
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/store").filter("kind = 'chunk'").select("key", "n", "payload")
    parts = refs.join(chunks, "key").groupBy("seg", "row", "id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "payload"))).alias("parts"))
    return parts.select("id", "parts").mapInArrow(task(expand), f"{id_col} {recipes.schema['id'].dataType.simpleString()}, ids array<bigint>")
