"""The whole pipeline, and the classifier's training, against plain versions of each stage."""

import hashlib
import math
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece
from occura.llm import quality, queries

SF_DIR = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(rows, linked):
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                top[find(i)] = find(j)
    return [find(k) for k in range(len(rows))]


def plain_score(text, model):
    """The softmax of the mean vector of one text's features."""
    buckets = np.concatenate([b for _, b in quality.features([text.encode()])]) if text else np.empty(0, np.int64)
    mean = model.vectors[buckets].astype(float).mean(0) if len(buckets) else np.zeros(model.vectors.shape[1])
    logits = mean @ model.weights + model.bias
    e = [math.exp(x - max(logits)) for x in logits]
    return e[model.classes.index(1)] / sum(e)


def test_pipeline_is_its_stages_done_plainly(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if t is not None and any(c.isalpha() for c in t)]
    after_language = docs.filter(docs.doc_id.isin([i for i, _ in rows]))
    model = quality.fit(queries.labelled(after_language, spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    rows = sorted((i, t) for i, t in rows if plain_score(t, model) >= queries.QUALITY_THRESHOLD)

    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", lower(text))
        n = min(5, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()

    sets = [shingles(t) for _, t in rows]
    similar = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    group = components(sets, similar)
    first = {}
    for k, g in enumerate(group):  # in the order of the ids
        first.setdefault(g, k)
    rows = [rows[k] for k in sorted(first.values())]

    def terms(text):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))

    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = terms(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = terms(text)
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    rows = [(i, t) for i, t in rows if clean(t)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = []
    for i, t in rows:
        ids = [*library.encode(t), library.eos_id()]
        wanted.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    found = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert found == sorted(wanted) and 0 < len(found) < docs.count()


def test_training_is_plain_gradient_descent(monkeypatch):
    """One row after the other, number by number."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    monkeypatch.setattr(quality, "BUCKET_BITS", 5)
    rng = np.random.default_rng(1)
    data = []
    for k in range(12):
        buckets = np.unique(rng.integers(0, 32, 6))
        data.append((int(k % 3 == 0), buckets, rng.integers(1, 4, len(buckets))))
    model = quality.train(data)

    random = np.random.default_rng(quality.SEED)
    vectors = (random.uniform(-1, 1, (32, quality.DIMENSION)) / quality.DIMENSION).tolist()
    weights, bias = random.normal(0, 0.1, (quality.DIMENSION, 2)).tolist(), [0.0, 0.0]
    seen = [sum(y == c for y, _, _ in data) for c in (0, 1)]
    weigh = [math.sqrt(len(data) / seen[c] / 2) for c in (0, 1)]
    done = 0
    for _ in range(2):
        for k in random.permutation(len(data)):
            label, buckets, times = data[k]
            share = [t / sum(times) for t in times]
            mean = [sum(s * vectors[b][d] for s, b in zip(share, buckets, strict=True)) for d in range(quality.DIMENSION)]
            logits = [sum(mean[d] * weights[d][c] for d in range(quality.DIMENSION)) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(logits)) for x in logits]
            rate = quality.RATE * (1 - done / (2 * len(data)))
            step = [(e[c] / sum(e) - (c == label)) * weigh[label] * rate for c in (0, 1)]
            back = [sum(weights[d][c] * step[c] for c in (0, 1)) for d in range(quality.DIMENSION)]
            for d in range(quality.DIMENSION):
                for c in (0, 1):
                    weights[d][c] -= mean[d] * step[c]
                for s, b in zip(share, buckets, strict=True):
                    vectors[b][d] -= s * back[d] * 40
            bias = [bias[c] - 0.05 * step[c] for c in (0, 1)]
            done += 1
    assert np.allclose(model.vectors, vectors, atol=1e-5) and np.allclose(model.weights, weights, atol=1e-5) and np.allclose(model.bias, bias)
