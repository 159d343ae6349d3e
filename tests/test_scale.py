"""Operators whose keys may be of any size: results against plain versions, and where the rows of a frequent key go."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from occura.functions.tiles import grid_size
from occura.operators import estimate, lookups, maps, observe
from occura.operators.nest import OccDataset
from occura.operators.running import summed_before


def spread(df) -> list[int]:
    """Rows in each partition."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


# --- lookups


@pytest.fixture
def large(monkeypatch):
    """Tables count as large from three rows on."""
    monkeypatch.setattr(lookups, "SMALL_ROWS", 2)


def test_fetch_finds_the_same_rows_either_way(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else None if k % 2 else f"k{k % 7}") for k in range(300)], "id bigint, key string")
    table = rows.filter("key is not null and key <> 'k3'").groupBy("key").agg(F.count("*").alias(lookups.TIMES), F.max("id").alias("top"))
    found = [sorted(map(tuple, lookups.fetch(rows, table, "key", "id").select("id", "key", "top").collect()))]
    monkeypatch.setattr(lookups, "SMALL_ROWS", 0)
    for frequent in (2, 1000):
        monkeypatch.setattr(lookups, "FREQUENT", frequent)
        found.append(sorted(map(tuple, lookups.fetch(rows, table, "key", "id").select("id", "key", "top").collect())))
    top = {r["key"]: r["top"] for r in table.collect()}
    assert found[0] == found[1] == found[2] == sorted((r.id, r.key, top.get(r.key)) for r in rows.collect())


def test_a_popular_taxon_stays_split(spark, large, monkeypatch):
    """Of 4,000 observations 30 % have one lineage and 30 % none; no partition of the result holds much more than its share."""
    monkeypatch.setattr(lookups, "FREQUENT", 20)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        lists = F.when(F.col("id") % 10 < 3, F.array(F.lit(1), F.lit(2))).when(F.col("id") % 10 >= 6, F.array((F.col("id") % 400 + 10).cast("int")))
        rows = spark.range(4000).select("id", lists.alias("_ids"))
        taxa = spark.createDataFrame([(k, f"name {k}", "genus" if k == 1 else "species", 20.0 if k == 1 else 10.0) for k in range(1, 500)], "id int, name string, rank string, rank_level double")
        found = observe.with_lineage(rows, taxa, "id")
        assert max(spread(found)) < 2 * 4000 / 16
        for r in found.collect():
            names = [f"name {k}" for k in r["_ids"] or []]
            assert r["higher_classification"] == (" | ".join(names) or None) and r["_known"] == bool(names)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- running sums


def test_sums_before_with_ties_nulls_and_one_key(spark):
    rng = np.random.default_rng(1)
    data = [(None if k % 50 == 0 else "hot" if k % 3 else f"b{k % 4}", f"p{k:05d}", None if k % 17 == 0 else int(rng.integers(0, 100)), 7 if k % 2 else int(rng.integers(0, 5))) for k in range(3000)]
    df = spark.createDataFrame(data, "bucket string, path string, size bigint, mtime bigint")
    found = {r.path: r.before for r in summed_before(df.repartition(7), "size", ["mtime", "path"], ["bucket"]).collect()}
    wanted, total = {}, Counter()
    for bucket, path, size, mtime in sorted(data, key=lambda r: (r[3], r[1])):
        wanted[path] = total[bucket]
        total[bucket] += size or 0
    assert found == wanted


def test_files_of_one_time_are_planned_by_many_tasks(spark):
    files = spark.range(20_000).select(F.lit("b").alias("bucket"), F.format_string("f%06d", "id").alias("path"), (F.col("id") % 9 + 1).alias("size"), F.lit(5).alias("mtime"))
    limit = 40_000
    plan = estimate.retention_plan(files, limit)
    total, freed, gone = sum(k % 9 + 1 for k in range(20_000)), 0, 0
    for k in range(20_000):
        if freed >= total - limit:
            break
        freed, gone = freed + k % 9 + 1, gone + 1
    assert plan.filter("evict").count() == gone and plan.filter("evict").agg(F.max("path")).first()[0] == f"f{gone - 1:06d}"
    empty = spark.createDataFrame([], "bucket string, path string, size bigint, mtime bigint")
    assert estimate.retention_plan(empty, 1).count() == 0


# --- maps


@pytest.fixture(scope="module")
def points(spark):
    """Points in cells of all sizes, on their edges too, with repeated places."""
    rng = np.random.default_rng(2)
    at = [(float(np.round(rng.normal(10, 0.4), int(rng.integers(1, 4)))), float(np.round(rng.normal(0.3, 0.4), int(rng.integers(1, 4))))) for _ in range(1500)]
    at += [(0.3, 0.3), (0.305, 0.3), (-0.3, 179.99), (85.05, -180.0), (-85.0, 180.0), (86.0, 0.0)]
    rows = [(f"id{k:05d}", lat, lng, f"n{k % 3}") for k, (lat, lng) in enumerate(at)]
    return rows, OccDataset(spark.createDataFrame(rows, "occurrenceID string, decimalLatitude double, decimalLongitude double, scientificName string"), "occurrenceID")


def tile(lat, lng, z):
    n = 2**z
    inside = lambda v: max(0, min(math.floor(v), n - 1))
    return inside((lng + 180) / 360 * n), inside((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)


@pytest.mark.parametrize("zooms", [range(15), [8, 5, 2], [7, 4, 1, 0], [3], [9, 12], [6, 11]])
def test_pyramid_is_each_zoom_by_itself(points, zooms):
    rows, ds = points
    wanted = set()
    for z in zooms:
        size, best = grid_size(z), {}
        for core_id, lat, lng, _ in rows:
            if abs(lat) <= maps.LIMIT:
                key = (*tile(lat, lng, z), *((math.floor(lat / size), math.floor(lng / size)) if size else (core_id,)))
                best[key] = min(best.get(key, core_id), core_id)
        wanted |= {(z, k[0], k[1], v) for k, v in best.items()}
    found = [(r.z, r.x, r.y, r.core_id) for r in maps.tile_features(ds, zooms).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_large_tiles_have_parts(points):
    rows, ds = points
    found = maps.tile_pyramid(ds, [9, 2], part_features=100).collect()
    assert max(len(r.features) for r in found) < 170
    whole = {(r.z, r.x, r.y): sorted(f.core_id for p in found if (p.z, p.x, p.y) == (r.z, r.x, r.y) for f in p.features) for r in found}
    flat = defaultdict(list)
    for r in maps.tile_features(ds, [9, 2]).collect():
        flat[r.z, r.x, r.y].append(r.core_id)
    assert whole == {k: sorted(v) for k, v in flat.items()} and any(r.part for r in found)


@pytest.mark.parametrize("part_features", [1, 7, 60, 5000])
def test_tiles_are_gathered_whole_beside_crowded_ones(points, part_features):
    rows, ds = points
    flat = defaultdict(list)
    for r in maps.tile_features(ds, range(7, 13)).collect():
        flat[r.z, r.x, r.y].append((r.core_id, r.px, r.py, r.scientificName))
    found = defaultdict(list)
    for r in maps.tile_pyramid(ds, range(7, 13), part_features=part_features).collect():
        assert list(r.features) == sorted(r.features) and (r.part == 0 or len(flat[r.z, r.x, r.y]) > part_features)
        found[r.z, r.x, r.y] += map(tuple, r.features)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in flat.items()}


def test_points_are_moved_once_for_a_size_of_cells_and_once_to_be_gathered(points):
    """15 zooms of 3 sizes are thinned in two exchanges a size (a size's first is reused by the larger ones, but printed there again); the other zooms' points are copied only behind the one exchange."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(maps.tile_features(points[1], range(15))).count("Exchange hashpartitioning") == 1 + 2 + 3 + 3
    lines = plan(maps.tile_pyramid(points[1], range(9, 15))).splitlines()
    moved, copied = ([k for k, line in enumerate(lines) if word in line] for word in ("Exchange", "Generate explode"))
    assert len(moved) == len(copied) == 1 and copied[0] < moved[0]  # a plan's first lines are its last steps


def test_overlaps_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    regions = []
    for k in range(60):
        west, south = float(rng.uniform(-180, 170)), float(rng.uniform(-84, 75))
        size = 10 ** float(rng.uniform(-4, 1.9))
        regions.append((f"r{k}", west, south, min(180.0, west + size), min(85.0, south + size / 2), int(rng.integers(2, 15))))
    regions += [("edge", 0.0, 0.0, 45.0, 40.97989806962013, 14), ("all", -180.0, -85.0, 180.0, 85.0, 14), ("world", None, None, None, None, 4)]
    tiles = [(z, int(rng.integers(0, 2**z)), int(rng.integers(0, 2**z))) for z in range(15) for _ in range(30)] + [(3, 3, 3), (3, 4, 3), (4, 8, 7), (4, 8, 7)]
    for k in range(0, 60, 4):
        tiles += [(z, *tile(regions[k][2] + 1e-5, regions[k][1] + 1e-5, z)) for z in range(0, 15, 3)]
    wanted = set()
    for use in (regions, [r for r in regions if r[0] not in ("all",)]):
        df = spark.createDataFrame(use, "region string, west double, south double, east double, north double, max_zoom int")
        found = [tuple(r) for r in maps.overlap_join(spark.createDataFrame(tiles, "z int, x int, y int"), df).collect()]
        wanted = set()
        for z, x, y in set(tiles):
            west, south, east, north = maps.tile_box(z, x, y)
            mine = {(z, x, y, r[0]) for r in use if r[1] is not None and west <= r[3] and east >= r[1] and south <= r[4] and north >= r[2] and z <= r[5]}
            wanted |= mine or ({(z, x, y, "world")} if z <= 4 else set())
        assert len(found) == len(set(found)) and set(found) == wanted


def test_pages_are_compressed_in_files_of_bounded_size(spark, monkeypatch):
    from occura.plans import base
    from occura.sources.documents import read_observations
    from occura.storage import bytes_of, names_in, scratch

    monkeypatch.setattr(base, "PAGE_ROWS", 500)
    plain, pages = scratch(spark, "plain"), scratch(spark, "pages")
    obs = base.observations(spark, "/root/testdata/sf0.001")
    obs.coalesce(1).write.json(plain)
    base.write_pages(obs.coalesce(1), pages)
    assert len([n for n in names_in(spark, pages) if n.endswith(".json.gz")]) == 3  # 1,500 orders
    assert 4 * bytes_of(spark, pages) < bytes_of(spark, plain)
    assert read_observations(spark, pages).exceptAll(read_observations(spark, plain)).isEmpty() and read_observations(spark, pages).count() == 1500


def test_only_the_lines_own_columns_are_shuffled_for_observations(spark):
    from occura.plans.base import observations

    plan = observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "medium.jpg" not in plan[plan.index("Aggregate") :]
