"""Queries over the map operators; boxes and tiles come from the occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from occura.functions.tiles import tile_bbox, tile_pixel, tile_xy
from occura.operators import maps
from occura.plans.base import SQL, WITH_OCC, occ, occ_rows, query

_COL = 'CAST(greatest(0, least(floor(({lng} + 180e0) / 360e0 * pow(2e0, {z})), pow(2e0, {z}) - 1)) AS INTEGER)'
_ROW = 'CAST(greatest(0, least(floor((1 - asinh(tan(radians({lat}))) / pi()) / 2 * pow(2e0, {z})), pow(2e0, {z}) - 1)) AS INTEGER)'


def _col(lng: str, z) -> str:
    return _COL.format(lng=lng, z=z)


def _row(lat: str, z) -> str:
    return _ROW.format(lat=lat, z=z)


_LAT, _LNG = '"decimalLatitude"', '"decimalLongitude"'
_PX = "CAST(round(greatest(0, least((({lng} + 180e0) / 360e0 * pow(2e0, {z}) - {x}) * 4096, 4095))) AS INTEGER)"
_PY = "CAST(round(greatest(0, least(((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2e0, {z}) - {y}) * 4096, 4095))) AS INTEGER)"


@query("tile_xy", f"""{WITH_OCC} SELECT "occurrenceID", {_col(_LNG, 7)} AS x, {_row(_LAT, 7)} AS y FROM occ""")
def tile_xy_query(spark, sf_dir):
    x, y = tile_xy(F.col("decimalLatitude"), F.col("decimalLongitude"), F.lit(7))
    return occ_rows(spark, sf_dir).select("occurrenceID", x.alias("x"), y.alias("y"))


@query("tile_pixel", f"""{WITH_OCC}, t AS (SELECT *, {_col(_LNG, 5)} AS x, {_row(_LAT, 5)} AS y FROM occ) SELECT "occurrenceID", {_PX.format(lng=_LNG, z=5, x="x")} AS px, {_PY.format(lat=_LAT, z=5, y="y")} AS py FROM t""")
def tile_pixel_query(spark, sf_dir):
    lat, lng, z = F.col("decimalLatitude"), F.col("decimalLongitude"), F.lit(5)
    x, y = tile_xy(lat, lng, z)
    px, py = tile_pixel(lat, lng, z, x, y)
    return occ_rows(spark, sf_dir).select("occurrenceID", px.alias("px"), py.alias("py"))


_TILES = f"""tiles AS (SELECT DISTINCT 6 AS z, {_col(_LNG, 6)} AS x, {_row(_LAT, 6)} AS y FROM occ)"""


def _tiles(spark, sf_dir):
    x, y = tile_xy(F.col("decimalLatitude"), F.col("decimalLongitude"), F.lit(6))
    return occ_rows(spark, sf_dir).select(F.lit(6).alias("z"), x.alias("x"), y.alias("y")).distinct()


_BBOX = "x / 64e0 * 360 - 180 AS west, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 64e0)))) AS south, (x + 1) / 64e0 * 360 - 180 AS east, degrees(atan(sinh(pi() * (1 - 2 * y / 64e0)))) AS north"


@query("tile_bbox", f"""{WITH_OCC}, {_TILES}, b AS (SELECT z, x, y, {_BBOX} FROM tiles) SELECT z, x, y, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM b""")
def tile_bbox_query(spark, sf_dir):
    west, south, east, north = tile_bbox(F.col("z"), F.col("x"), F.col("y"))
    return _tiles(spark, sf_dir).select("z", "x", "y", F.round(west, 6).alias("west"), F.round(south, 6).alias("south"), F.round(east, 6).alias("east"), F.round(north, 6).alias("north"))


_CELL = 'CAST(floor("decimalLatitude" / 1e-1) AS BIGINT), CAST(floor("decimalLongitude" / 1e-1) AS BIGINT)'


@query("grid_sample", f"""{WITH_OCC}, s AS (SELECT min("occurrenceID") AS core_id FROM occ WHERE "decimalLongitude" BETWEEN 0 AND 45 AND "decimalLatitude" BETWEEN 0 AND degrees(atan(sinh(pi() * (1 - 2 * 3 / 8e0)))) GROUP BY {_CELL})
SELECT core_id, "decimalLatitude" AS lat, "decimalLongitude" AS lng, "scientificName" FROM s JOIN occ ON core_id = "occurrenceID" """)
def grid_sample(spark, sf_dir):
    return maps.tile_points(occ(spark, sf_dir), 3, 4, 3)


@query("tile_pyramid_counts", f"""{WITH_OCC}, p AS (SELECT "occurrenceID" AS id, "decimalLatitude" AS lat, "decimalLongitude" AS lng FROM occ WHERE abs("decimalLatitude") <= 85.0511287798066),
t AS (SELECT z, {_col("lng", "z")} AS x, {_row("lat", "z")} AS y, CASE WHEN z <= 2 THEN floor(lat / 1e0) WHEN z <= 5 THEN floor(lat / 1e-1) ELSE floor(lat / 1e-2) END AS r, CASE WHEN z <= 2 THEN floor(lng / 1e0) WHEN z <= 5 THEN floor(lng / 1e-1) ELSE floor(lng / 1e-2) END AS c, id FROM p, (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS z))
SELECT z, x, y, count(*) AS features FROM (SELECT DISTINCT z, x, y, CASE WHEN z < 9 THEN r END AS r, CASE WHEN z < 9 THEN c END AS c, CASE WHEN z >= 9 THEN id END AS id FROM t) GROUP BY z, x, y""")
def tile_pyramid_counts(spark, sf_dir):
    """Features of each tile of zooms 0 to 14, counted without gathering them."""
    return maps.tile_features(occ(spark, sf_dir), range(15)).groupBy("z", "x", "y").agg(F.count("*").alias("features"))


@query("tile_features", f"""{WITH_OCC}, p AS (SELECT "occurrenceID" AS core_id, "decimalLatitude" AS lat, "decimalLongitude" AS lng, "scientificName" FROM occ WHERE abs("decimalLatitude") <= 85.0511287798066),
t AS (SELECT *, {_col("lng", "z")} AS x, {_row("lat", "z")} AS y, CASE WHEN z <= 2 THEN 1e0 WHEN z <= 5 THEN 1e-1 WHEN z <= 8 THEN 1e-2 END AS size FROM p, (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS z)),
f AS (SELECT * FROM t QUALIFY z >= 9 OR core_id = min(core_id) OVER (PARTITION BY z, x, y, floor(lat / size), floor(lng / size)))
SELECT z, x, y, {_PX.format(lng="lng", z="z", x="x")} AS px, {_PY.format(lat="lat", z="z", y="y")} AS py, core_id, "scientificName" FROM f""")
def tile_features(spark, sf_dir):
    """The features of every tile of zooms 0 to 14, a row each."""
    return maps.tile_features(occ(spark, sf_dir), range(15))


@query("tile_pyramid", f"""{SQL["tile_pyramid_counts"].rpartition("SELECT z, x, y, count(*)")[0]}, n AS (SELECT z, x, y, count(*) AS features FROM (SELECT DISTINCT z, x, y, CASE WHEN z < 9 THEN r END AS r, CASE WHEN z < 9 THEN c END AS c, CASE WHEN z >= 9 THEN id END AS id FROM t) GROUP BY z, x, y)
SELECT z, count(*) AS tiles, CAST(sum(features) AS BIGINT) AS features, max(features) AS most, true AS bounded FROM n GROUP BY z""")
def tile_pyramid(spark, sf_dir):
    """The pyramid's tiles in parts of about 500 features, summed up by zoom."""
    parts = maps.tile_pyramid(occ(spark, sf_dir), range(15), part_features=500).select("z", "x", "y", F.size("features").alias("n"))
    tiles = parts.groupBy("z", "x", "y").agg(F.sum("n").alias("n"), F.max("n").alias("part"))
    return tiles.groupBy("z").agg(F.count("*").alias("tiles"), F.sum("n").alias("features"), F.max("n").alias("most"), (F.max("part") < 1000).alias("bounded"))


# Boxes: the quarter around the mean of each type's points, kept within the map.
_BOXES = """boxes AS (SELECT "scientificName" AS region, floor(avg("decimalLongitude")) - 40e0 AS west, floor(avg("decimalLatitude")) - 20e0 AS south, floor(avg("decimalLongitude")) + 40e0 AS east, floor(avg("decimalLatitude")) + 20e0 AS north FROM occ GROUP BY 1)"""


def _boxes(spark, sf_dir):
    lng, lat = F.floor(F.avg("decimalLongitude")), F.floor(F.avg("decimalLatitude"))
    return occ_rows(spark, sf_dir).groupBy(F.col("scientificName").alias("region")).agg((lng - 40.0).alias("west"), (lat - 20.0).alias("south"), (lng + 40.0).alias("east"), (lat + 20.0).alias("north"))


_RANGES = f"""ranges AS (SELECT region, z, {_col("west", "z")} AS x0, {_col("east", "z")} AS x1, {_row("north", "z")} AS y0, {_row("south", "z")} AS y1 FROM boxes, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS z))"""
_TILE_COUNT = "CAST(x1 - x0 + 1 AS BIGINT) * (y1 - y0 + 1)"


@query("tile_counts", f"{WITH_OCC}, {_BOXES}, {_RANGES} SELECT region, z, {_TILE_COUNT} AS tiles, CAST((pow(4e0, z + 1) - 1) / 3 AS BIGINT) AS map_tiles FROM ranges")
def tile_counts(spark, sf_dir):
    return maps.tile_counts(_boxes(spark, sf_dir), 7).select("region", "z", "tiles", "map_tiles")


@query("tile_cover", f"{WITH_OCC}, {_BOXES}, {_RANGES} SELECT region, z, x, CAST(unnest(range(y0, y1 + 1)) AS INTEGER) AS y FROM (SELECT *, CAST(unnest(range(x0, x1 + 1)) AS INTEGER) AS x FROM ranges)")
def tile_cover(spark, sf_dir):
    return maps.tile_cover(_boxes(spark, sf_dir), 7).select("region", "z", "x", "y")


@query("tile_sample", f"""{WITH_OCC}, {_BOXES}, {_RANGES}, few AS (SELECT *, {_TILE_COUNT} <= 16 AS f FROM ranges WHERE z = 6)
SELECT DISTINCT region, z, x, unnest(CASE WHEN f THEN range(y0, y1 + 1) ELSE list_transform(range(4), lambda k: y0 + k * (y1 - y0) // 3) END)::INTEGER AS y
FROM (SELECT *, unnest(CASE WHEN f THEN range(x0, x1 + 1) ELSE list_transform(range(4), lambda k: x0 + k * (x1 - x0) // 3) END)::INTEGER AS x FROM few)""")
def tile_sample(spark, sf_dir):
    return maps.tile_sample(_boxes(spark, sf_dir), 6).select("region", "z", "x", "y")


@query("pyramid_size", f"{WITH_OCC}, {_BOXES}, {_RANGES} SELECT region, CAST(sum({_TILE_COUNT} * CAST(floor(4321e0 * pow(1.5e0, least(7 - z, 5))) AS BIGINT)) AS BIGINT) AS bytes FROM ranges GROUP BY region")
def pyramid_size(spark, sf_dir):
    return maps.pyramid_size(_boxes(spark, sf_dir), 7, 4321.0).select("region", "bytes")


@query("bbox_overlap_join", f"""{WITH_OCC}, {_TILES}, t AS (SELECT z, x, y, {_BBOX.replace('west', 'tw').replace('south', 'ts').replace('east', 'te').replace('north', 'tn')} FROM tiles), {_BOXES},
bounded AS (SELECT z, x, y, region FROM t JOIN boxes ON tw <= east AND te >= west AND ts <= north AND tn >= south)
SELECT * FROM bounded UNION ALL SELECT z, x, y, 'global' FROM tiles WHERE NOT EXISTS (SELECT 1 FROM bounded b WHERE b.x = tiles.x AND b.y = tiles.y)""")
def bbox_overlap_join(spark, sf_dir):
    regions = _boxes(spark, sf_dir).withColumn("max_zoom", F.lit(9))
    world = spark.createDataFrame([("global", None, None, None, None, 14)], regions.schema)
    return maps.overlap_join(_tiles(spark, sf_dir), regions.unionByName(world))
