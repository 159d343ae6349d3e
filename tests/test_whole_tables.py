"""Registered queries that cover their whole tables; their results are compared with their SQL in test_queries."""

import json

import pytest
from pyspark.sql import functions as F

from occura.operators.maps import LIMIT
from occura.plans import registry

SF_DIR = "/root/testdata/sf0.001"


def run(spark, key):
    return registry.queries()[key](spark, SF_DIR)


@pytest.fixture
def lines(spark):
    return spark.read.parquet(f"{SF_DIR}/lineitem.parquet")


def test_every_lineitem_is_nested_scanned_and_joined(spark, lines):
    assert sum(r.n_media for r in run(spark, "nested_extension_counts").collect()) == lines.count()
    assert run(spark, "scan_extension").count() == lines.count()
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").filter("o_orderstatus = 'F'")
    assert run(spark, "semi_filtered_extension").count() == lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_semi").count()
    paths = {r.path for r in run(spark, "media_paths").collect()}
    assert {f"m/{r.l_partkey}" for r in lines.select("l_partkey").distinct().collect()} <= paths


def test_whole_lookups(spark, lines):
    row = run(spark, "point_lookup").first()
    assert row.n_media == lines.filter(lines.l_orderkey == int(row.occurrenceID)).count()
    assert run(spark, "group_with_photo").count() == spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderpriority").distinct().count()


def test_pyramid_has_every_zoom(spark):
    points = spark.read.parquet(f"{SF_DIR}/events.parquet").select(((F.col("event_id") * 7919 % 170000) / 1000.0 - 85.0).alias("lat")).filter(F.abs("lat") <= LIMIT).count()
    rows = run(spark, "tile_features")
    assert set("z x y px py core_id".split()) <= set(rows.columns)
    by_zoom = {r.z: r["count"] for r in rows.groupBy("z").count().collect()}
    assert sorted(by_zoom) == list(range(15)) and all(by_zoom[z] == points for z in range(9, 15))
    counts = {r.z: r.n for r in run(spark, "tile_pyramid_counts").groupBy("z").agg(F.sum("features").alias("n")).collect()}
    assert counts == by_zoom


def test_every_order_is_rendered_with_both_extensions(spark, lines):
    rows = run(spark, "nested_extension_json").collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    assert sum(len(json.loads(r.multimedia)) for r in rows) == lines.count()
    assert sum(len(json.loads(r.audiovisual)) for r in rows) == lines.filter("l_returnflag = 'R'").count()
