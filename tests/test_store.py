"""Stored archives by core id: results, and plans that leave the stored rows where they are."""

import re

import pytest
from pyspark.sql import functions as F

from occura.operators import merge, nest
from occura.operators.nest import Ext, OccDataset
from occura.plans.base import shop
from occura.sources import store
from occura.storage import scratch

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def large_tables(spark):
    """No side of a join is broadcast, as with tables of a real size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch(spark, "store")
    store.save(shop(spark, SF_DIR), path, buckets=4)
    return store.load(spark, path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_store_has_the_archive(spark, stored):
    ds = shop(spark, SF_DIR)
    assert rows(stored.core) == rows(ds.core) and stored.core_id == ds.core_id and stored.name == ds.name
    assert {n: rows(e.df) for n, e in stored.extensions.items()} == {n: rows(e.df) for n, e in ds.extensions.items()}


def test_nesting_moves_nothing(spark, stored):
    ds = shop(spark, SF_DIR)
    found = store.nested(stored)
    assert "Exchange" not in plan(found)
    assert rows(found) == rows(nest.with_extensions(ds.core, ds, one_page=False))
    assert "Exchange" not in plan(nest.with_extensions(stored.core, stored, one_page=False))


def test_lookup_reads_one_bucket(spark, stored):
    key = stored.core.agg(F.min("occurrenceID")).first()[0]
    found = store.get(stored, key)
    assert rows(found) == rows(nest.get(shop(spark, SF_DIR), key))
    text = plan(found)
    assert "Exchange" not in text and re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", text) == [("1", "4")] * 3
    assert f"EqualTo(occurrenceID,{key})" in text
    with pytest.raises(LookupError):
        store.get(stored, "no such id")


def test_row_groups_have_bloom_filters(spark, stored, tmp_path):
    """A file of many row groups with scattered ids: the filters leave few of them for one id."""
    path = f"file://{tmp_path}/s"
    ds = OccDataset(spark.range(200_000).select(F.sha1(F.col("id").cast("string")).alias("occurrenceID"), F.repeat(F.sha1((F.col("id") * 7).cast("string")), 8).alias("filler")), "occurrenceID")
    store.save(ds, path, buckets=1, row_group_bytes=1 << 20)
    from pyarrow import parquet

    names = [p for p in (tmp_path / "s" / "core").iterdir() if p.suffix == ".parquet"]
    meta = parquet.ParquetFile(names[0]).metadata
    assert len(names) == 1 and meta.num_row_groups > 1
    low = [meta.row_group(k).column(0).statistics.min for k in range(meta.num_row_groups)]
    assert low == sorted(low)  # sorted by id, so that ranges part the row groups as well
    one = store.load(spark, path)
    key = one.core.agg(F.max("occurrenceID")).first()[0]
    assert store.get(one, key).count() == 1


def test_semi_joins_and_replacements_move_the_small_side_only(spark, stored):
    wanted = stored.core.filter("o_orderstatus = 'F'")
    found = nest.semi(stored.extensions["multimedia"].df.hint("merge"), wanted, "occurrenceID", "occurrenceID")
    assert "Exchange hashpartitioning" not in plan(found)
    media = stored.extensions["multimedia"]
    updates = media.df.filter("title = '1'").withColumn("identifier", F.lit("new"))
    gone = spark.createDataFrame([(media.df.agg(F.min("occurrenceID")).first()[0],)], "occurrenceID string")
    after = store.replaced(media, updates, gone)
    assert rows(after) == rows(merge.replace_groups(media.df, updates, "occurrenceID", gone))
    scans = [line for line in plan(after).splitlines() if "Exchange" in line]
    assert all("_id" in line for line in scans)  # only the updates' ids are dealt out


def test_null_ids_repeated_saves_and_missing_stores(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    core = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "id string, n int")
    ext = spark.createDataFrame([("a", "x"), (None, "y"), ("c", "z"), ("a", "x")], "of string, `odd name` string")
    ds = OccDataset(core, "id", {"multimedia": Ext(ext, "of")})
    with pytest.raises(LookupError):
        store.load(spark, path)
    store.save(ds, path)
    with pytest.raises(FileExistsError):
        store.save(ds, path)
    found = {r.n: len(r.multimedia) for r in store.nested(store.load(spark, path)).collect()}
    assert found == {1: 2, 2: 0, 3: 0}
