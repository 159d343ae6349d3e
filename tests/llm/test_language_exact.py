"""Cross-parsing against plain substring search, over block borders, rare letters and many languages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from occura.llm import langid


def phrases(text, sample):
    """Greedy longest phrases by plain search."""
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def winner(text, samples):
    clean = langid.letters_only(text or "")
    if not clean:
        return langid.UNDETERMINED, 0.0
    names = sorted(samples)
    rates = [phrases(clean, samples[x]) * math.log2(len(samples[x]) + 2) for x in names]
    best = rates.index(min(rates))
    return names[best], (1 / rates[best]) / sum(1 / r for r in rates)


def random_text(rng, letters, n):
    return "".join(rng.choice(list(letters), n))


@pytest.mark.parametrize(("block", "states"), [(4, 1), (7, 50), (256, 1 << 14)])
def test_parse_is_that_of_plain_search(block, states, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "STATES", states)
    rng = np.random.default_rng(block)
    samples = {"aa": langid.letters_only(random_text(rng, "abc ", 400)), "bb": langid.letters_only(random_text(rng, "abd  ", 300)), "cc": langid.letters_only(random_text(rng, "日本語é ", 200))}
    model = langid.build(samples)
    texts = [None, "", "12 !", "a", samples["aa"], samples["bb"][:150] + samples["aa"][20:200], "zzz", "Ab" * 300, *(random_text(rng, "abcdz é日 !", int(n)) for n in rng.integers(1, 700, 40))]
    best, score = langid.classify([None if t is None else t.encode() for t in texts], model, langid.codes_by_point(model.alphabet))
    for t, b, s in zip(texts, best, score, strict=True):
        name, expected = winner(t, samples)
        assert [*model.languages, langid.UNDETERMINED][b] == name and s == pytest.approx(expected)


def test_phrases_cross_many_blocks(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 8)
    rng = np.random.default_rng(1)
    sample = langid.letters_only(random_text(rng, "abcdefgh ", 3000))
    model = langid.build({"x": sample})
    blocks, owner = langid.in_blocks([sample.encode(), (sample[5:900] + sample[:1000]).encode()], langid.codes_by_point(model.alphabet), langid.FIRST_LETTER + len(model.alphabet))
    found = np.bincount(owner, weights=model.parsers[0].phrases(blocks, np.r_[False, owner[1:] == owner[:-1]]))
    assert found[0] == 1 and found[1] == phrases(langid.letters_only(sample[5:900] + sample[:1000]), sample)


def test_more_letters_than_columns():
    letters = "".join(chr(0x4E00 + k) for k in range(700))
    rng = np.random.default_rng(2)
    samples = {"zh": random_text(rng, letters, 3000), "other": random_text(rng, letters[::-1][:400], 3000)}
    model = langid.build(samples)
    texts = [samples["zh"][50:120], samples["other"][100:300], random_text(rng, letters, 200)]
    best, score = langid.classify([t.encode() for t in texts], model, langid.codes_by_point(model.alphabet))
    assert [(model.languages[b], pytest.approx(s)) for b, s in zip(best, score, strict=True)] == [winner(t, samples) for t in texts]


def test_more_than_256_languages(spark, make):
    rng = np.random.default_rng(3)
    words = [random_text(rng, "abcdefghijklmnop", 9) for _ in range(300)]
    docs = make([(k, f"{w} " * 5) for k, w in enumerate(words)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id")))
    model = langid.fit(docs)
    assert len(model.languages) == 300
    rows = langid.predict(make([(k, words[k]) for k in range(0, 300, 7)]), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id}" for r in rows)


def test_sample_is_that_of_the_labelled_texts(spark, make, odd_texts):
    docs = make(["tala mana", "kilo rana"] * 3 + odd_texts).withColumn("lang", F.when(F.col("doc_id") < 6, "aa"))
    model = langid.fit(docs)
    assert model.languages == ["aa"]
    columns = [F.col("id"), F.col("body"), F.lit("kept").alias("more")]
    rows = {r.doc_id: r for r in langid.predict(docs, model, "doc_id", "text", *columns).collect()}
    assert all((r.id, r.body, r.more) == ("x", "x", "kept") for r in rows.values()) and len(rows) == 6 + len(odd_texts)
