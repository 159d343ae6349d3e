"""Samples of labelled rows: bounded whatever the ids are, and without leaving a language out."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from occura.llm import langid, quality, queries


@pytest.fixture
def collected(monkeypatch):
    """Sizes of all results that come to the driver."""
    sizes, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    return sizes


def test_language_sample_is_bounded_without_ids(spark, make, collected):
    docs = make([(None, f"tala mana {chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(500)]).withColumn("lang", F.lit("aa"))
    assert langid.fit(docs).languages == ["aa"]
    assert collected and max(collected) <= langid.SAMPLE_DOCS


def test_languages_of_long_texts_only_are_learned(spark, make):
    long = "12 " * 8000 + "strix brind plocht grund " * 900
    docs = make([(1, "tala mana kilo rana " * 30), (2, long)]).withColumn("lang", F.when(F.col("doc_id") == 1, "aa").otherwise("bb"))
    model = langid.fit(docs)
    assert model.languages == ["aa", "bb"]
    assert [r.lang_pred for r in langid.predict(make(["tala rana", "grund brind"]), model).orderBy("doc_id").collect()] == ["aa", "bb"]


def test_no_language_is_left_out(spark, make, monkeypatch):
    docs = make(["tala mana", "strix brind", "zu"]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id")))
    assert langid.fit(docs).languages == ["l0", "l1", "l2"]
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)


def test_whole_texts_are_learned_by_hash_alone(spark, make, monkeypatch):
    """Long texts are neither cut nor put behind short ones; only the number of rows is bounded."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 3)
    docs = make([(k, f"tala{chr(97 + k)} " * (2 if k % 2 else 9000)) for k in range(20)]).withColumn("lang", F.lit("aa"))
    wanted = [r.text for r in docs.orderBy(F.xxhash64("doc_id", "text")).limit(3).collect()]
    model = langid.fit(docs)
    assert model.parsers[0].length == len(langid.letters_only(" ".join(wanted)))


def test_language_stage_keeps_letters_without_labels(spark, make):
    docs = make(["tala", None, "12 !?", "é"]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [0, 3]


def test_quality_sample_is_bounded(spark, make, collected, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 50)
    docs = make([f"amber basin {k}" for k in range(600)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    quality.fit(queries.labelled(docs, labels))
    assert 40 <= max(collected) <= 50
    collected.clear()
    quality.fit(docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(1).alias("quality")))
    assert max(collected) == 50
    collected.clear()
    quality.fit(docs.limit(30).withColumn("quality", F.lit(1)))
    assert max(collected) == 30
