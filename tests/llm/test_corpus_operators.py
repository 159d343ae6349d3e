"""Operators over whole tables against brute force: archives, links, decontamination, shards, store, pipeline."""

import base64
import hashlib
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from occura.llm import castore, decontaminate, jaccard, queries, sharding, warc
from occura.llm.common import new_path
from occura.llm.components import components

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- archives


def test_archives_round_trip(spark, make, odd_texts):
    texts = [*odd_texts, "same", "same", None, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"]
    pages = make(texts, "html", "page_id").withColumn("url", F.lit("http://h/\n x"))
    folder = new_path(spark, "warc")
    rows = {r.page_id: r for r in warc.archive_round_trip(pages, folder=folder).collect()}
    assert len(rows) == len(texts)
    last = {}
    for k, t in enumerate(texts):
        last[t or ""] = k
    for k, t in enumerate(texts):
        body, r = (t or "").encode(), rows[k]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        first = last[t or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if first == k else ("revisit", first))
        assert r.intact
    files, root = fs.FileSystem.from_uri(folder)
    mono = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/monolithic")) if f.path.endswith(".gz")]
    inflate = zlib.decompressobj(31)
    whole = inflate.decompress(files.open_input_file(mono[0]).read())
    assert inflate.eof and not inflate.unused_data
    name = mono[0].rsplit("/", 1)[-1]
    raw = files.open_input_file(f"{root}/archives/{name}").read()
    index = files.open_input_file(f"{root}/archives/{name}.idx").read().decode().splitlines()
    members = [zlib.decompress(raw[int(a) : int(a) + int(n)], wbits=31) for a, n, _ in (x.split(" ") for x in index)]
    assert b"".join(members) == whole


def test_archive_ids_come_back_as_they_are(spark):
    ids = ["a", "", None, "line\r\nbreak", "b\nWARC-Type: x", "c>d", "<urn:page:e>", "50%", "é 日", "a"]
    pages = spark.createDataFrame([(i, "u", "same" if k % 2 else f"own {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    rows = warc.archive_round_trip(pages).collect()
    assert sorted((r.page_id is None, r.page_id or "") for r in rows) == sorted((i is None, i or "") for i in ids)
    largest = max(i for k, i in enumerate(ids) if k % 2 and i is not None)
    same = [i for k, i in enumerate(ids) if k % 2]
    assert {r.record_type for r in rows} == {"response", "revisit"}
    assert sorted(r.page_id for r in rows if r.record_type == "revisit") == sorted(i for i in same if i != largest)
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {largest}
    assert all(r.intact for r in rows)


def test_archives_least_bytes_and_many_archives(spark, make):
    pages = make(["ab", "ab", "abcdef", "abcdef"], "html", "page_id").withColumn("url", F.lit(None).cast("string"))
    rows = {r.page_id: r for r in warc.archive_round_trip(pages, least_bytes=3).collect()}
    assert [rows[k].record_type for k in range(4)] == ["response", "response", "revisit", "response"]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_revisits_without_broadcast(spark, make, monkeypatch):
    pages = make(["ab", "ab", None, "", "x"], "html", "page_id")
    first = {r.page_id: r.refers_to for r in warc.with_revisits(pages).collect()}
    monkeypatch.setattr(warc, "REPEATED_PAYLOADS", 0)
    assert {r.page_id: r.refers_to for r in warc.with_revisits(pages).collect()} == first == {0: 1, 1: None, 2: 3, 3: None, 4: None}


# --- links


def brute_components(texts, size=3, percent=90):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    sets = {k: shingles(t) for k, t in texts}
    label = {k: k for k, _ in texts}
    ids = sorted(label)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {k: (len(sets[k]), label[k]) for k in ids}


def near_copies(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = list(rng.choice(vocabulary, 30))
    out = []
    for _ in range(n):
        base = list(rng.choice(vocabulary, rng.integers(20, 120)))
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(rng.integers(1, 7)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = str(rng.integers(0, 10**6))
            out.append(" ".join(copy))
    return [out[k] for k in rng.permutation(len(out))]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_brute_force(spark, make, odd_texts, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_TOKENS", 50)
    texts = list(enumerate([*odd_texts, *near_copies(seed, 25), *["the same text in many rows"] * 40]))
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(texts)).collect()}
    assert rows == brute_components(texts)


def test_links_with_null_and_repeated_ids(spark, make):
    rows = jaccard.jaccard_components(make([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A b c d"), (3, None), (4, "")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (3, 3), (4, 4), (5, 5), (5, 5), (7, 5)]
    assert jaccard.jaccard_components(make([])).count() == 0


def test_links_of_texts_that_share_an_id(spark, make, monkeypatch):
    """Several texts under one id, some without words: they are one document where the id is the smallest of both groups of copies."""
    monkeypatch.setattr(jaccard, "KNOWN_TOKENS", 30)  # sets are forgotten in between
    one = " ".join(f"w{k}" for k in range(60))
    rows = [(1, one), (1, "nothing like it at all"), (1, None), (2, one + " more"), (2, ""), (3, "one of its own kind"), (3, one + " less"), (4, "a kind of its own")]
    found = jaccard.jaccard_components(make(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(1, 0, 1), (1, 3, 1), (1, 58, 1), (2, 0, 2), (2, 59, 1), (3, 3, 1), (3, 59, 1), (4, 3, 4)]


def test_every_prefix_filter_keeps_similar_pairs():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 150))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        b[: int(rng.integers(0, max(1, n // 20 + 1)))] += np.uint64(1)
        a, b = np.unique(a), np.unique(b)
        if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)):
            continue
        frequent = np.sort(rng.choice(a, min(5, len(a)), replace=False))
        times = np.full(len(frequent), 9, np.uint64)
        p, q = (jaccard.prefixes(x, frequent, times, 90, 3)[0] for x in (a, b))
        assert all(set(x) & set(y) for x, y in zip(p, q, strict=True))


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint")
    rows = {r.node: r.label for r in components(chain).collect()}
    assert all(rows[k] == 0 for k in range(41)) and rows[101] == 100


# --- decontamination


def brute_hits(texts, items, window=10):
    windows = []
    for item, body in items:
        w = decontaminate.words_of(body.encode() if body is not None else None)
        windows += [(w[k : k + window], item) for k in range(max(1, len(w) - window + 1))] if w else []
    out = {}
    for k, t in texts:
        w = decontaminate.words_of(t.encode() if t is not None else None)
        hit, found = set(), set()
        for v, item in windows:
            for s in range(len(w) - len(v) + 1):
                if w[s : s + len(v)] == v:
                    hit |= set(range(s, s + len(v)))
                    found.add(str(item))
        out[k] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination_matches_brute_force(spark, make, odd_texts, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = ["an", "be", "co", "do", "el", "fi"]
    long_items = [" ".join(rng.choice(vocabulary, 14)) for _ in range(8)]
    items = list(enumerate([*long_items, "an be", "Be-CO", None, "", "...", "a b c", "é"]))
    texts = list(enumerate([*odd_texts, *(" ".join(rng.choice(vocabulary, 80)) for _ in range(30)), *(f"zz {x.upper()}, end" for x in long_items), " ".join(long_items[0].split()[2:])]))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute_hits(texts, items)
    for limit in (decontaminate.BLOCK_BYTES, 150):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        rows = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(make(texts), benchmark).collect()}
        assert rows == expected


def test_one_index_serves_several_benchmarks(spark, make, odd_texts, tmp_path):
    rng = np.random.default_rng(9)
    vocabulary = ["an", "be", "co", "do", "el"]
    texts = list(enumerate([*odd_texts, *(" ".join(rng.choice(vocabulary, 60)) for _ in range(20))]))
    decontaminate.build_index(make(texts), path=f"file://{tmp_path}/index", segment_bytes=900)
    index = decontaminate.open_index(spark, f"file://{tmp_path}/index")
    assert index.segments.count() > 5
    for items in ([(1, " ".join(rng.choice(vocabulary, 12))), (2, "an be an"), (2, "an be an")], [(7, "quick brown fox"), (8, texts[25][1]), (None, "el do")]):
        benchmark = spark.createDataFrame(items, "item_id bigint, text string")
        expected = brute_hits(texts, items)
        if items[-1][0] is None:
            expected = {k: (n, hit, [x for x in found if x != "None"]) for k, (n, hit, found) in expected.items()}
        for limit in (None, 60):
            assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.search(index, benchmark, block_bytes=limit).collect()} == expected


def test_texts_without_ids_and_repeated_rows(spark, make):
    benchmark = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    rows = decontaminate.contamination(make([(None, "one two"), (3, "one two"), (3, "x"), (3, "one two"), (None, None)]), benchmark).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.contaminated) for r in rows) == [(0, 0, False), (0, 2, True), (3, 1, False), (3, 2, True), (3, 2, True)]


def placed(words, window, start, slop):
    """Whether each word of the window has a place of its own among the words, by trying all."""

    def go(at, used):
        return at == len(window) or any(go(at + 1, used | {p}) for p in range(max(0, start + at - slop), min(len(words), start + at + slop + 1)) if p not in used and words[p] == window[at])

    return go(0, frozenset())


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_matches_brute_force(spark, make, slop):
    rng = np.random.default_rng(slop)
    texts = list(enumerate([" ".join(rng.choice(["an", "be", "co"], int(n))) for n in rng.integers(0, 14, 40)]))
    items = [(1, "an be co an"), (2, "be be"), (3, "co an an be co")]
    rows = {r.doc_id: r for r in decontaminate.contamination(make(texts), spark.createDataFrame(items, "item_id bigint, text string"), window=4, slop=slop).collect()}
    for k, text in texts:
        words, hit, found = text.split(), set(), set()
        for item, body in items:
            w = body.split()
            for v in [w[a : a + 4] for a in range(max(1, len(w) - 3))]:
                for s in range(-slop, len(words) + slop):
                    if placed(words, v, s, slop):
                        hit |= set(range(max(s, 0), min(s + len(v), len(words))))
                        found.add(str(item))
        assert (rows[k].n_hit, list(rows[k]["items"])) == (len(hit), sorted(found)), text


def test_proximity(spark, make):
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    docs = make(["one two three four", "one so two three four", "four three x y z two one", "one two", "one two three x", "four"])
    exact = [r.contaminated for r in decontaminate.contamination(docs, benchmark).orderBy("doc_id").collect()]
    near = [r.contaminated for r in decontaminate.contamination(docs, benchmark, slop=1).orderBy("doc_id").collect()]
    assert exact == [True, False, False, False, False, False] and near == [True, True, False, False, False, False]
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    assert not decontaminate.contamination(docs, benchmark.limit(0)).first().contaminated


# --- shards


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > middle:
                n, at = n + 1, 0
            at += s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize(("shards", "seed"), [(3, 1), (7, 2), (40, 3)])
def test_shards_are_minimax(spark, make, odd_texts, shards, seed, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 16)
    monkeypatch.setattr(sharding, "FINER", 4)
    monkeypatch.setattr(sharding, "UNIT_ROWS", 20)
    rng = np.random.default_rng(seed)
    texts = [*odd_texts, *["hot"] * 60, *("t" * int(rng.integers(0, 400)) for _ in range(150))]
    rows = sharding.minimax_shards(make(texts), shards=shards).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    shard_of, total, slots = {}, {}, {}
    for r in rows:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
        assert shard_of.setdefault(t, r.shard) == r.shard
        total[r.shard] = total.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda t: "-" if t is None else hashlib.md5(t.encode()).hexdigest()
    sizes = {}
    for t in texts:
        sizes[key(t)] = sizes.get(key(t), 0) + len((t or "").encode()) + 16
    assert max(total.values()) == brute_capacity([sizes[k] for k in sorted(sizes)], shards)
    assert set(total) == set(range(shards))  # more groups than shards: none is empty


def test_many_ranges_are_open_at_once(spark):
    """So many groups that over a thousand ranges are open in one pass; a condition naming each was too deep for the planner."""
    n, shards = 200_000, 120
    sums = spark.range(n).select((F.col("id") * 1000 + F.pmod(F.xxhash64("id"), F.lit(1000))).alias("p"))
    p = np.sort(np.array([r.p for r in sums.collect()]))
    capacity, cuts = sharding.minimax_cuts(sums, int(p[-1]), shards)
    assert capacity == brute_capacity(np.diff(p, prepend=0).tolist(), shards)
    assert len(cuts) == shards and cuts[-1] == p[-1] and np.isin(cuts, p).all()
    assert 0 < np.diff(cuts, prepend=0).min() and np.diff(cuts, prepend=0).max() <= capacity


def test_shards_of_nothing(spark, make):
    assert sharding.minimax_shards(make([])).count() == 0


# --- store


def test_store_round_trip(spark, make, odd_texts):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [*odd_texts, "copied text " * 200, "copied text " * 200]
    path = castore.write(make(texts), WORDS)
    rows = castore.read_digests(spark, path).orderBy("doc_id").collect()
    streams = {r.doc_id: list(r.ids) for r in castore.reconstruct(spark, path).collect()}
    start = 0
    for k, (text, r) in enumerate(zip(texts, rows, strict=True)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert streams[k] == ids
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.verified) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/store").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_store_of_nothing_and_repeated_ids(spark, make):
    assert castore.read_digests(spark, castore.write(make([]), WORDS)).count() == 0
    rows = castore.read_digests(spark, castore.write(make([(1, "a b"), (1, "a b"), (None, "c")]), WORDS)).collect()
    assert sorted(r.start for r in rows) == [0, 2, 5] and all(r.verified for r in rows)


def rewritten(spark, path, part, change):
    """A copy of a store with one of its tables changed."""
    out = f"{path}-{part}"
    for name in ("store", "recipes", "manifest", "root"):
        df = spark.read.parquet(f"{path}/{name}")
        df = change(df) if name == part else df
        writer = df.write.mode("overwrite")
        (writer.partitionBy("kind") if name == "store" else writer).parquet(f"{out}/{name}")
    return out


def test_damaged_stores_are_noticed(spark, make):
    rng = np.random.default_rng(11)
    path = castore.write(make([" ".join(rng.choice(["one", "two", "three", "four"], 300)) for _ in range(12)]), WORDS)
    castore.check_manifest(spark, path)

    def verified(where):
        return {r.doc_id: r.verified for r in castore.read_digests(spark, where).collect()}

    assert all(verified(path).values())
    lost = rewritten(spark, path, "recipes", lambda df: df.filter("id <> 5"))
    seg = {r.id: r.seg for r in spark.read.parquet(f"{path}/recipes").collect()}
    assert {k for k, v in verified(lost).items() if not v} == {k for k in seg if seg[k] == seg[5] and k != 5}
    with pytest.raises(castore.StoreDamaged):
        castore.check_manifest(spark, lost)
    swapped = rewritten(spark, path, "recipes", lambda df: df.withColumn("keys", F.expr("case when octet_length(keys) > 32 then concat(substring(keys, 17, 16), substring(keys, 1, 16), substring(keys, 33)) else keys end")))
    long = {r.id for r in spark.read.parquet(f"{path}/recipes").filter("octet_length(keys) > 32").collect()}
    assert long and not any(v for k, v in verified(swapped).items() if k in long)
    altered = rewritten(spark, path, "store", lambda df: df.withColumn("payload", F.when(F.col("kind") == "chunk", F.expr("concat(unhex('0100'), substring(payload, 3))")).otherwise(F.col("payload"))))
    assert not all(verified(altered).values())
    gone = rewritten(spark, path, "store", lambda df: df.filter("kind = 'recipe' or pmod(xxhash64(key), 2) = 0"))
    assert not all(verified(gone).values())
    shorter = rewritten(spark, path, "manifest", lambda df: df.withColumn("documents", F.col("documents") - 1))
    with pytest.raises(castore.StoreDamaged):
        castore.check_manifest(spark, shorter)


def test_cut_points_follow_content():
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 49_000, 20_000).astype(np.uint32)
    alone, moved, none = castore.cut_points(np.r_[ids, ids[:10], ids], np.array([len(ids), len(ids) + 10, 0]))
    sizes = np.diff(np.r_[0, alone])
    assert alone[-1] == len(ids) and sizes[:-1].min() >= castore.LEAST and sizes.max() <= castore.MOST
    assert len({x - 10 for x in moved} & set(alone)) > 0.9 * len(alone)
    assert none == [] and castore.cut_points(ids, np.array([len(ids)])) == [alone]


def test_checksums_join():
    shift = castore.CrcShift()
    parts = [b"", b"abc", b"hello ", b"world" * 1000, b"x"]
    whole = b"".join(parts)
    following = np.cumsum([0, *map(len, parts[::-1])])[:-1][::-1]
    crc = np.array([zlib.crc32(p) for p in parts])
    assert np.bitwise_xor.reduce(shift(crc, following)) == zlib.crc32(whole)


# --- pipeline and queries


def test_pipeline(spark, make):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == docs.columns and after.count() <= kept.count()
        kept = after
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert docs.join(kept, "doc_id", "left_anti").count() > 0


def test_every_query_has_its_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    wanted = {
        "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2": "page_id payload_bytes payload_digest record_type refers_to", "op3": "doc_id held_out score predicted",
        "op4": "doc_id held_out n_tokens n_known train_tokens base_score score", "op5": "doc_id n_shingles component_id", "op6": "doc_id n_words n_hit n_items items_sha256 contaminated", "op7": "doc_id held_out lang_pred score",
        "op8": "doc_id size text_crc32 law shard slot grown_shard", "op9": "doc_id start n_tokens ids_crc32", "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op11": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op12": "vec_id code error label_error codebooks_sha256", "op13": "doc_id n_shingles component_id kept",
    }
    for name, run in queries.queries().items():
        df = run(spark, sf_dir)
        assert set(wanted[name.split("_")[0]].split()) <= set(df.columns)
        table = {"op2": "pages", "op11": None, "op12": "embeddings"}.get(name.split("_")[0], "documents")
        assert table is None or df.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_library_does_not_need_this_subpackage():
    code = "import sys; sys.modules['occura.llm'] = None; import __spark_entry__ as e; assert not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']; assert len(e.queries()) > 80"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
