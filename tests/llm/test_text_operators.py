"""Operators on single texts against brute force: repetition, quality, language, pieces, lattice."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from occura.llm import langid, lattice, pieces, quality, repetition

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words_of(text):
    return (text or "").encode().split()


# --- repetition


def brute_repetition(text):
    w = words_of(text)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
    longest = 0
    for n in range(5, len(w)):
        c = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        if max(c.values()) < 2:
            break
        longest = n
        if n > 60:
            return len(covered), None
    return len(covered), longest


def test_repetition_matches_brute_force(spark, make, odd_texts):
    rng = np.random.default_rng(1)
    texts = odd_texts[:15] + ["word " * 40, *(" ".join(rng.choice(["a", "b", "c", "d"], 60)) for _ in range(20)), "one two three four five six " * 3 + "x y z"]
    rows = repetition.repetition_rule(make(texts), with_spans=True).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for text, r in zip(texts, rows, strict=True):
        covered, longest = brute_repetition(text)
        w = words_of(text)
        assert (r.n_words, r.n_repeat_words) == (len(w), covered)
        assert longest is None or r.longest_repeat == longest
        assert r.word_chars == len(b"".join(w).decode()) and r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert sum(s.end - s.start for s in r.repeat_spans) == covered
        failed = len(w) < 10 or 100 * covered > 20 * len(w)
        assert r.base_failed == failed and r.kept == (not failed and r.longest_repeat <= repetition.MAX_LONGEST)


def brute_maximal(text):
    """Word sequences of five words or more found twice or more that no one word, before or behind, follows in all places."""
    w = words_of(text)
    before, behind = {}, {}
    for k in range(len(w)):
        for end in range(k + 5, len(w) + 1):
            before.setdefault(tuple(w[k:end]), []).append(w[k - 1] if k else (k,))
            behind.setdefault(tuple(w[k:end]), []).append(w[end] if end < len(w) else (k,))
    return sum(len(x) > 1 and len(set(x)) > 1 and len(set(behind[words])) > 1 for words, x in before.items())


def test_maximal_repeats_match_brute_force(spark, make):
    rng = np.random.default_rng(2)
    texts = [None, "", "a", "word " * 30, "x " * 12 + "y " + "x " * 9, "a b c d e f g a b c d e f h a b c d e g", "a b c d e f a b c d e f a b c d e f"]
    texts += [" ".join(rng.choice(["a", "b"], n)) for n in (5, 20, 60, 90)] + [" ".join(rng.choice(list("abc"), 70)) for _ in range(10)]
    rows = repetition.repetition_rule(make(texts)).orderBy("doc_id").collect()
    assert [r.n_maximal_repeats for r in rows] == [brute_maximal(x) for x in texts]
    assert max(r.n_maximal_repeats for r in rows) > 10


def test_repetition_longest_limit_and_lines(spark, make):
    passage = " ".join(f"p{k}" for k in range(31))
    filler = " ".join(f"f{k}" for k in range(400))
    rows = {r.doc_id: r for r in repetition.repetition_rule(make([f"{passage} {filler} {passage}", filler, "a b\n\na b\n \nc\na b"])).collect()}
    assert not rows[0].base_failed and not rows[0].kept and rows[0].longest_repeat == 31
    assert rows[1].kept and rows[2].n_dup_lines == 2


def test_repetition_of_nothing(spark, make):
    assert repetition.repetition_rule(make([])).count() == 0


# --- quality


def labelled(make, n=120):
    rng = np.random.default_rng(2)
    vocabulary = ["amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "haven"]
    good = [" ".join(rng.choice(vocabulary, 30)) for _ in range(n)]
    bad = ["!!! ".join(w.upper() for w in rng.choice(vocabulary, 30)) for _ in range(n)]
    docs = make(good + bad)
    return docs.withColumn("quality", (F.col("doc_id") < n).cast("int"))


def test_quality_learns_and_scores_everything(spark, make, odd_texts):
    model = quality.fit(labelled(make))
    assert [model.vectors.tobytes()] == [quality.fit(labelled(make)).vectors.tobytes()]
    rows = quality.score(make(["amber basin cedar delta", "AMBER!!! BASIN!!! CEDAR!!!", *odd_texts]), model).orderBy("doc_id").collect()
    assert rows[0].score > 0.5 > rows[1].score and all(0 <= r.score <= 1 for r in rows) and len(rows) == 2 + len(odd_texts)
    assert rows[2].score == rows[3].score


def brute_features(text):
    """Buckets of words, neighbouring words, and character n-grams that hold no space inside, each hashed by itself."""
    whole = (1 << 64) - 1
    odd = [int(x) for x in np.random.default_rng(20).integers(1, 1 << 63, 72, dtype=np.uint64) | np.uint64(1)]
    place, gram, mix, pair = odd[:64], odd[64:70], odd[70], odd[71]
    code = {c: (lambda x: x ^ (x >> 29))((ord(" " if c in "\t\n\x0b\x0c\r " else c) + 1) * pair & whole) for c in text + "\n"}
    bucket = lambda h: ((h ^ (h >> 31)) * mix & whole) >> (64 - quality.BUCKET_BITS)
    out, words = [], [sum(code[c] * place[k % 64] for k, c in enumerate(w)) & whole for w in re.split("[\t\n\x0b\x0c\r ]+", text) if w]
    out += [bucket((w + pair) & whole) for w in words]
    out += [bucket(((v ^ w) * place[1] + place[0]) & whole) for v, w in zip(words, words[1:])]
    bordered = f"\n{text}\n"
    for n, g in zip(quality.CHAR_NGRAMS, gram):
        for at in range(len(bordered) - n + 1):
            part = bordered[at : at + n]
            if not re.search("[\t\n\x0b\x0c\r ]", part[1:-1]):
                out.append(bucket((sum(code[c] * place[k + 8 * n % 40] for k, c in enumerate(part)) + g) & whole))
    return out


def test_quality_score_is_that_of_the_plain_mean(make, odd_texts):
    model = quality.fit(labelled(make))
    texts = ["amber basin AMBER!!! x", "a", "basin  amber\nx", *[t for t in odd_texts if t is not None and len(t) < 400]]
    together = model.probabilities([t.encode() for t in texts])
    for text, found in zip(texts, together, strict=True):
        buckets = brute_features(text)
        mean = model.vectors[buckets].mean(axis=0) if buckets else np.zeros(quality.DIMENSION)
        logits = mean @ model.weights + model.bias
        assert found == pytest.approx(np.exp(logits) / np.exp(logits).sum(), abs=1e-5)


def test_long_texts_teach_and_clashing_columns_stay(spark, make, monkeypatch):
    docs = make([(k, ("amber " if k % 2 else "BASIN!!! ") * 8000) for k in range(12)]).withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    model = quality.fit(docs)
    rows = quality.score(make(["amber amber", "BASIN!!! BASIN!!!"]), model, "doc_id", "text", F.col("id"), F.col("body"), F.lit(3).alias("more")).orderBy("doc_id").collect()
    assert rows[0].score > 0.5 > rows[1].score and [(r.id, r.body, r.more) for r in rows] == [("x", "x", 3)] * 2
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1)
    assert quality.fit(docs).classes == [0, 1]


def test_quality_without_labels(spark, make):
    docs = make(["a b", None]).withColumn("quality", F.lit(None).cast("int"))
    model = quality.fit(docs)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), model).count() == 0


# --- language

LANGS = {"aa": "tala mana kilo rana sula ", "bb": "strix brind plocht grund knast "}


def language_docs(make):
    rng = np.random.default_rng(3)
    texts = [(k, " ".join(rng.choice(LANGS[("aa", "bb")[k % 2]].split(), 40))) for k in range(60)]
    return make(texts).withColumn("lang", F.when(F.col("doc_id") % 20 == 19, None).when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))


def test_language(spark, make, odd_texts):
    model = langid.fit(language_docs(make))
    assert model.languages == ["aa", "bb"]
    rows = {r.doc_id: r for r in langid.predict(make(["tala rana sula", "GRUND knast brind", None, "", "12 !?", *odd_texts]), model).collect()}
    assert (rows[0].lang_pred, rows[1].lang_pred) == ("aa", "bb")
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (2, 3, 4))
    assert len(rows) == 5 + len(odd_texts) and all(0 <= r.score <= 1 for r in rows.values())


def test_language_without_labels(spark, make):
    docs = make(["tala", None]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()] == ["und", "und"]
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


# --- pieces


def test_pieces_match_the_library(spark, make, odd_texts):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts + ["ends in space ", "a  b", "  ", "x▁y", "one\n two\n\n three"]
    rows = {r.doc_id: r for r in pieces.encode_decode(make(texts), MODEL, with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = processor.encode(text or "") + [2]
        r = rows[k]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == processor.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()


def test_each_distinct_chunk_is_segmented_once(spark, make, odd_texts, monkeypatch):
    """Over many segments and buckets: every distinct chunk is answered in one bucket only, whatever segments hold it."""
    monkeypatch.setattr(pieces, "BUCKET_BYTES", 5000)
    texts = odd_texts + [f"same words {k} in all  of them" for k in range(60)]
    docs = make(texts).repartition(5)
    store = pieces.segments(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("body")), 7, True, 2000, True)
    unpack = zstandard.ZstdDecompressor()
    where = {}
    for r in store.collect():
        chunks = unpack.decompress(bytes(r.chunks)).split(b"\xff")
        assert len(chunks) == len(set(chunks))
        for c in chunks:
            where.setdefault(c, set()).add(r.bucket)
    assert all(len(x) == 1 for x in where.values()) and {x for y in where.values() for x in y} == set(range(7))
    assert set(where) == {c for t in texts for c in pieces.chunks_of((t or "").encode())}
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in pieces.encode_decode(docs, MODEL, with_ids=True).collect()}
    assert all(rows[k].ids == processor.encode(t or "") + [2] and rows[k].decoded == processor.decode(rows[k].ids) for k, t in enumerate(texts))


def test_pieces_of_nothing(spark, make):
    assert pieces.encode_decode(make([]), MODEL).count() == 0
    rows = pieces.encode_decode(make([(None, None), (1, "a"), (1, "a"), (None, "")]), MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (0, 1), (1, 2), (1, 2)]


# --- lattice


def test_lattice_sums_over_all_segmentations():
    model = lattice.PieceLattice(MODEL, {}, 3)
    model.pieces = {p: math.log(q) for p, q in {"▁": 0.1, "a": 0.2, "b": 0.1, "▁a": 0.05, "ab": 0.07, "▁ab": 0.01}.items()}
    ways = 0.1 * 0.2 * 0.1 + 0.05 * 0.1 + 0.1 * 0.07 + 0.01
    assert model.word("▁ab") == pytest.approx(math.log10(ways))
    assert math.isfinite(model.word("▁日"))


def test_lattice_probabilities_sum_to_one():
    model = lattice.PieceLattice(MODEL, {300: 5, 400: 2}, 3)
    total = sum(math.exp(p) for p in model.pieces.values()) + sum(math.exp(p) for p in model.bytes) + 10**model.end
    assert total == pytest.approx(1)


def test_lattice_counts_and_base(spark, make, odd_texts):
    docs = make(odd_texts)
    rows = {r.doc_id: r for r in lattice.lattice_scores(docs, MODEL, F.col("doc_id") % 3 == 0).collect()}
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t in enumerate(odd_texts)}
    c = Counter(w for k, ws in tokens.items() if k % 3 for w in ws)
    total, distinct = sum(c.values()), len(c)
    for k, ws in tokens.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k % 3 == 0, len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)
    same = [rows[k].score for k in (6, 7, 8)]
    assert same[0] == same[1] == same[2]


def test_lattice_scores_are_sums_over_all_cuts(spark, make):
    """Every cut of every word into pieces or bytes, with probabilities counted here from the training texts."""
    texts = ["ab ab cab", "a  bca\tAb", "caba", None, "", "é b", "日 ab", "c"]
    rows = {r.doc_id: r for r in lattice.lattice_scores(make(texts), MODEL, F.col("doc_id") % 3 == 2).collect()}
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    uses, ends = Counter(), 0
    for k, t in enumerate(texts):
        if k % 3 != 2:
            ends += 1
            for w in (t or "").encode().lower().split():
                uses.update(processor.encode(w.decode()))
    usable = [k for k in range(processor.get_piece_size()) if not (processor.is_control(k) or processor.is_unknown(k) or processor.is_unused(k))]
    total = sum(uses.values()) + ends + len(usable) + 1
    share = {processor.id_to_piece(k): (uses[k] + 1) / total for k in usable}

    def cuts(word):
        if not word:
            return 1.0
        found = sum(share[word[:n]] * cuts(word[n:]) for n in range(1, len(word) + 1) if word[:n] in share)
        if word[0] not in share:
            found += math.prod(share[f"<0x{b:02X}>"] for b in word[0].encode()) * cuts(word[1:])
        return found

    for k, t in enumerate(texts):
        expected = sum(math.log10(cuts("▁" + w.decode())) for w in (t or "").encode().lower().split()) + math.log10((ends + 1) / total)
        assert rows[k].score == pytest.approx(expected)


def test_lattice_of_nothing_and_without_training(spark, make):
    assert lattice.lattice_scores(make([]), MODEL, F.lit(False)).count() == 0
    row = lattice.lattice_scores(make(["a b"]), MODEL, F.lit(True)).first()
    assert (row.n_known, row.train_tokens) == (0, 0) and row.score < 0
