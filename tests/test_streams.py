"""Streams: what is visible when, restarts, and tables that grow."""

import pytest
from pyspark.sql import functions as F

from occura import schema
from occura.plans.base import observations, taxa
from occura.storage import names_in, scratch
from occura.streaming import commits, ingest, upserts

SF_DIR = "/root/testdata/sf0.001"


def feed(spark, path, rows):
    """One more file of (key, seq, value) rows, which is a batch of its own."""
    spark.createDataFrame(rows, "key bigint, seq bigint, value string").coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(spark, path, buckets=4, checkpoint="checkpoint", **more):
    stream = spark.readStream.schema("key bigint, seq bigint, value string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    upserts.upsert_stream(stream, "key", "seq", f"{path}/out", f"{path}/{checkpoint}", buckets=buckets, **more).awaitTermination()
    return {r.key: (r.seq, r.value) for r in upserts.latest_version(spark, f"{path}/out").collect()}


def test_upserts_keep_the_latest_version_over_restarts(spark):
    path, wanted = scratch(spark, "upserts"), {}
    for batch in range(6):
        rows = [(k, (k * 7 + batch * 5) % 11, f"{k} {batch}") for k in range(0, 100, 1 + batch % 3)] + [(None, batch, "null")]
        for k, seq, value in rows:
            wanted[k] = max(wanted.get(k, (-1, "")), (seq, value))
        feed(spark, path, rows)
        assert run(spark, path, most_deltas=2, split_rows=15) == wanted
        assert upserts.latest_version(spark, f"{path}/out").count() == len(wanted)
    listed = commits.last(spark, f"{path}/out")["buckets"]
    assert len(listed) > 4 and max(own["base_rows"] for own in listed.values()) < 60  # buckets were split as they grew
    assert sum(len(names_in(spark, f"{path}/out/data/{v}/{kind}")) for v in names_in(spark, f"{path}/out/data") for kind in ("base", "delta")) < 100  # old folders go


def test_a_batch_reads_no_base_and_another_bucket_count_raises(spark):
    path = scratch(spark, "upserts")
    feed(spark, path, [(k, 0, "a") for k in range(100)])
    run(spark, path)
    feed(spark, path, [(k, 1, "b") for k in range(50)])
    found = run(spark, path)
    assert len(found) == 100 and all(found[k] == ((1, "b") if k < 50 else (0, "a")) for k in found)
    assert all(len(own["deltas"]) == 2 and own["base"] is None for own in commits.last(spark, f"{path}/out")["buckets"].values())
    with pytest.raises(ValueError, match="4 buckets"):
        run(spark, path, buckets=7)
    assert run(spark, path) == found


def test_a_repeated_batch_and_a_new_checkpoint(spark):
    path = scratch(spark, "upserts")
    feed(spark, path, [(k, 0, "a") for k in range(10)])
    first = run(spark, path)
    version, before = commits.begin(spark, f"{path}/out", f"{path}/checkpoint", 0)  # the batch failed after its commit and comes again
    assert version == 0 and before is None
    assert commits.begin(spark, f"{path}/out", f"{path}/checkpoint", 1)[0] == 1
    assert run(spark, path, checkpoint="another") == first  # all files come again, as a later version
    assert commits.versions(spark, f"{path}/out") == [0, 1]


def test_an_ingested_batch_is_visible_as_a_whole(spark, monkeypatch):
    path = scratch(spark, "ingest")
    obs = observations(spark, SF_DIR)
    obs.filter("id % 2 = 0").coalesce(1).write.json(f"{path}/pages")
    read = lambda: ingest.ingest_stream(ingest.read_stream(spark, f"{path}/pages"), taxa(spark, SF_DIR), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    counts = lambda: [ingest.ingested(spark, f"{path}/out", n).count() for n in ingest.TABLES]
    lookups = lambda: [n for n in names_in(spark, spark.conf.get("spark.checkpoint.dir")) if n.startswith("lookup-")]
    with pytest.raises(LookupError):
        ingest.ingested(spark, f"{path}/out", "comments")
    others = lookups()
    read()
    half = counts()
    obs.filter("id % 2 = 1").coalesce(1).write.mode("append").json(f"{path}/pages")
    tables_of = ingest.tables_of

    def failing(obs, taxa):
        found = tables_of(obs, taxa)
        return dict(list(found.items())[:3]) | {"identifications": found["identifications"].withColumn("broken", F.raise_error(F.lit("stop")))}

    monkeypatch.setattr(ingest, "tables_of", failing)
    with pytest.raises(Exception, match="stop"):
        read()
    assert counts() == half and "version=1" in names_in(spark, f"{path}/out/occurrences")
    monkeypatch.setattr(ingest, "tables_of", tables_of)
    read()
    assert lookups() == others  # a batch takes its scratch folders with it
    whole = {n: df.count() for n, df in tables_of(obs, taxa(spark, SF_DIR)).items()}
    assert counts() == [whole[n] for n in ingest.TABLES]
    assert schema.OCCURRENCE_FIELDS == ingest.ingested(spark, f"{path}/out", "occurrences").columns[: len(schema.OCCURRENCE_FIELDS)]


def test_an_ingest_begins_with_a_bounded_number_of_bytes(spark):
    path = scratch(spark, "ingest")
    obs = observations(spark, SF_DIR).persist()
    obs.repartition(3).write.json(f"{path}/pages")
    ingest.ingest_stream(ingest.read_stream(spark, f"{path}/pages", batch_bytes=1), taxa(spark, SF_DIR), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    assert len(commits.versions(spark, f"{path}/out")) == 3  # a file each
    for name, df in ingest.tables_of(obs, taxa(spark, SF_DIR)).items():
        assert ingest.ingested(spark, f"{path}/out", name).count() == df.count()
    obs.unpersist()
