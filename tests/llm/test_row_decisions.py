"""Stages of the pipeline decide by row where ids repeat or are null."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from occura.llm import common, decontaminate, quality, queries, sharding
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

WORDS = [f"word{k}" for k in range(60)]
COPY, CLEAN, OTHER = " ".join(WORDS), " ".join(f"clean{k}" for k in range(40)), " ".join(f"other{k}" for k in range(40))
NEAR = " ".join([*WORDS, "more"])


def kept(stage, spark, docs, sf_dir=""):
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_near_copies_under_shared_ids(spark, make):
    docs = make([(1, COPY), (2, NEAR), (2, CLEAN), (3, CLEAN + " and yet others"), (3, OTHER), (4, ""), (4, "")])
    assert kept(corpus_pipeline.near_copies, spark, docs) == sorted([(1, COPY), (2, CLEAN), (3, OTHER), (4, ""), (4, "")], key=repr)


def test_near_copies_without_ids(spark, make):
    docs = make([(None, NEAR), (7, COPY), (None, OTHER), (None, OTHER), (None, None)])
    assert kept(corpus_pipeline.near_copies, spark, docs) == sorted([(7, COPY), (None, OTHER), (None, None)], key=repr)


@pytest.fixture
def benchmark_dir(spark, tmp_path):
    spark.createDataFrame([("item", COPY)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_decontamination_under_shared_and_null_ids(spark, make, benchmark_dir):
    docs = make([(1, "x " + NEAR), (1, CLEAN), (None, NEAR), (None, OTHER), (2, None)])
    assert kept(corpus_pipeline.decontamination, spark, docs, benchmark_dir) == sorted([(1, CLEAN), (None, OTHER), (2, None)], key=repr)


def test_rows_of_files_have_one_key_each(spark, make, tmp_path):
    docs = make([(1, COPY), (None, NEAR), (2, CLEAN), (2, OTHER)] * 5).repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    rows, key = corpus_pipeline._numbered(read, "rows")
    keys = {(r[key], r.text) for r in rows.collect()}
    assert len({k for k, _ in keys}) == 20 and keys == {(r[key], r.text) for r in rows.repartition(7).collect()}
    assert rows.columns == [*docs.columns, key]
    assert kept(corpus_pipeline.near_copies, spark, read) == sorted([(1, COPY), (2, CLEAN), (2, OTHER)], key=repr)


def test_rows_made_from_one_row_of_a_file_have_keys_of_their_own(spark, make, tmp_path):
    make([(k, f"{CLEAN} {k % 50}") for k in range(200)]).write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    twice = read.withColumn("text", F.explode(F.array("text", F.concat(F.col("text"), F.lit(" "), F.reverse("text")))))
    rows, key = corpus_pipeline._numbered(twice, "rows")
    assert rows.select(key).distinct().count() == rows.count() == 400
    twice.write.parquet(f"{tmp_path}/twice")
    assert kept(corpus_pipeline.near_copies, spark, twice) == kept(corpus_pipeline.near_copies, spark, spark.read.parquet(f"{tmp_path}/twice"))


def test_shuffled_rows_are_not_taken_for_files(spark, make, tmp_path):
    make([(k, COPY) for k in range(9)]).write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    assert common.straight_from_files(read)
    assert common.straight_from_files(read.filter("doc_id > 3").select("doc_id", "text"))
    for df in (read.repartition(3), read.orderBy("doc_id"), read.filter(F.rand() < 0.5), read.select(F.explode(F.array("text")))):
        assert not common.straight_from_files(df)


def test_stages_with_clashing_columns(spark, make, tmp_path, benchmark_dir):
    docs = make([(1, COPY), (2, NEAR), (3, CLEAN), (None, "x " + NEAR)]).withColumns({c: F.lit("own") for c in ("_row", "_file", "_number", "component_id", "_place", "_metadata", "row")})
    docs.write.parquet(f"{tmp_path}/docs")
    for df in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        assert kept(corpus_pipeline.near_copies, spark, df) == sorted([(1, COPY), (3, CLEAN)], key=repr)
        assert kept(corpus_pipeline.decontamination, spark, df, benchmark_dir) == [(3, CLEAN)]


def test_stages_of_empty_tables(spark, make, benchmark_dir):
    empty = make([(1, COPY)]).limit(0)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{benchmark_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.withColumn("lang", F.lit("aa")), benchmark_dir).count() == 0, name


def test_quality_stage_is_the_classifier_on_each_row(spark, make, tmp_path):
    """Null and empty texts, ties, repeated rows, shared ids and clashing names; decisions are those of the scores, row by row."""
    good, bad = "amber basin cedar delta ember fjord", "win cash now click free bonus"
    docs = make([(k, f"{good if k % 2 else bad} {k}") for k in range(60)] + [(7, bad), (7, bad), (None, good), (None, None), (61, ""), (62, bad * 2000)])
    spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(queries.labelled(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    scored = quality.score(docs.withColumnRenamed("id", "own_id"), model).collect()
    by_row = sorted((r.doc_id is None, r.doc_id or 0, r.score >= queries.QUALITY_THRESHOLD) for r in scored)
    left = kept(corpus_pipeline.quality_stage, spark, docs, str(tmp_path))
    assert len(left) == sum(x for *_, x in by_row)
    assert {i for i, _ in left if i is not None and i < 60 and i != 7} == {i for n, i, x in by_row if x and not n and i < 60 and i != 7}
    assert (62, bad * 2000) not in left


def test_encode_is_the_library(spark, make, odd_texts):
    docs = make([*enumerate(odd_texts), (3, "again"), (None, "no id"), (None, None)])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.encode(spark, docs, "").collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = []
    for i, text in [(r.doc_id, r.text) for r in docs.collect()]:
        ids = [*library.encode(text or ""), library.eos_id()]
        wanted.append((i is None, i or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert found == sorted(wanted)


def test_rows_without_ids_are_numbered_and_stored_in_parts(spark, make, monkeypatch):
    monkeypatch.setattr(sharding, "UNIT_ROWS", 100)
    docs = make([(None, "one text")] * 3000 + [(k, f"text {k}") for k in range(50)])
    units, materialize = [], sharding.materialize

    def seen(df, name):
        found = materialize(df, name)
        if name == "units":
            units.extend(r.n for r in found.collect())
        return found

    monkeypatch.setattr(sharding, "materialize", seen)
    rows = sharding.minimax_shards(docs, shards=5).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 3050 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and max(units) < 400


def test_benchmark_blocks_are_read_one_after_the_other(spark, make, monkeypatch):
    """The matches of a block are written before the next block is read; the result is that of one block."""
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(14))) for k in range(12)], "item_id bigint, text string")
    docs = make([(k, f"before {' '.join(f'w{k}x{j}' for j in range(14))} after" if k < 12 else f"clean {k}") for k in range(20)])
    rows = lambda **more: sorted((r.doc_id, r.n_hit, r.items, sorted(map(tuple, r.spans))) for r in decontaminate.contamination(docs, items, **more).collect())
    whole = rows()
    steps, matches = [], decontaminate._matches
    monkeypatch.setattr(decontaminate, "_matches", lambda *a: (steps.append("read"), matches(*a))[1])
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (steps.append("write") if "matches-" in path else None, write(self, path, *a, **k))[1])
    assert rows(block_bytes=1500) == whole
    assert len(steps) > 4 and steps == ["read", "write"] * (len(steps) // 2)
