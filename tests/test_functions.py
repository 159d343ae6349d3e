import math

import pytest
from pyspark.sql import functions as F

from occura import schema
from occura.functions import scalars as S
from occura.functions import text as X
from occura.functions import tiles as T
from occura.operators import estimate, maps
from occura.operators.nest import OccDataset


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("z", "x", "y", "px", "py"), [(1, 0, 0, 2183, 3867), (5, 8, 15, 2166, 430), (10, 272, 483, 3777, 1471)])
def test_tile_pixels(spark, z, x, y, px, py):
    lat, lng = F.lit(10.0176473153), F.lit(-84.0507658571)
    a, b = T.tile_xy(lat, lng, F.lit(z))
    assert (one(spark, a), one(spark, b)) == (x, y)
    a, b = T.tile_pixel(lat, lng, F.lit(z), F.lit(x), F.lit(y))
    assert abs(one(spark, a) - px) <= 1 and abs(one(spark, b) - py) <= 1


def test_tile_boxes_and_counts(spark):
    west, south, east, north = (one(spark, c) for c in T.tile_bbox(F.lit(0), F.lit(0), F.lit(0)))
    assert (west, east) == (-180, 180) and north == pytest.approx(85.051129, abs=1e-6) and south == -north
    assert maps.tile_box(1, 1, 0) == pytest.approx((0, 0, 180, north))
    boxes = maps.box_table(spark, ("a", -10.0, -10.0, 10.0, 10.0))
    rows = {r.z: (r.tiles, r.map_tiles) for r in maps.tile_counts(boxes, 6).collect()}
    assert rows[0] == (1, 1) and rows[1] == (4, 5) and rows[2][1] == 21 and rows[6][1] == 5461
    assert maps.tile_cover(boxes, 6).count() == sum(n for n, _ in rows.values())
    assert maps.tile_sample(boxes, 6).count() == 16 and maps.tile_sample(boxes, 1).count() == 4
    size = maps.pyramid_size(boxes, 6).first()["bytes"]
    assert size == sum(rows[z][0] * math.floor(5000 * 1.5 ** min(6 - z, 5)) for z in range(7))


def test_overlap_prefers_bounded_regions(spark):
    tiles = spark.createDataFrame([(3, 4, 3), (3, 0, 0), (12, 2048, 2040)], "z int, x int, y int")
    regions = spark.createDataFrame([("africa", 0.0, -30.0, 50.0, 30.0, 9), ("global", None, None, None, None, 14)], "region string, west double, south double, east double, north double, max_zoom int")
    rows = {(r.z, r.x): r.region for r in maps.overlap_join(tiles, regions).collect()}
    assert rows == {(3, 4): "africa", (3, 0): "global", (12, 2048): "global"}


def test_pyramid_thins_low_zooms(spark):
    core = spark.createDataFrame([("1", "a", 10.001, 20.001), ("2", "b", 10.002, 20.002), ("3", "c", None, 1.0)], "occurrenceID string, scientificName string, decimalLatitude double, decimalLongitude double")
    rows = {r.z: len(r.features) for r in maps.tile_pyramid(OccDataset(core, "occurrenceID"), [0, 9]).collect()}
    assert rows == {0: 1, 9: 2}


def notes(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("concatenated_attr_val"), F.lit(v).cast("int").alias("vote_score")) for a, v in pairs])


@pytest.mark.parametrize(("pairs", "expected"), [
    ([("Life Stage=Adult", 1), ("Life Stage=Larva", 1)], "larva"), ([("Life Stage=Adult", 2), ("Life Stage=Larva", None)], "adult"), ([("Life Stage=Adult", -1)], None), ([("Life Stage=Adult", 0), ("Life Stage=Odd", 3)], None), ([("Sex=Male", 3)], None),
])
def test_annotations(spark, pairs, expected):
    assert one(spark, S.annotation(notes(*pairs), "Life Stage", schema.LIFE_STAGES)) == expected


def test_sex(spark):
    assert one(spark, S.sex(notes(("Sex=Cannot Be Determined", 0)))) == "undetermined"


def test_points_and_privacy(spark):
    public, private = F.struct(F.array(F.lit(2.0), F.lit(1.0)).alias("coordinates")), F.struct(F.array(F.lit(4.0)).alias("coordinates"))
    nothing = F.lit(None).cast("struct<coordinates: array<double>>")
    assert [one(spark, c) for c in S.point(public, nothing)] == [1.0, 2.0] and [one(spark, c) for c in S.point(public, private)] == [None, None]
    withheld = lambda g, t, p: one(spark, S.information_withheld(F.lit(g).cast("string"), F.lit(t).cast("string"), F.lit(p)))
    assert withheld("open", "private", True) is None and withheld(None, None, True) is None
    assert withheld("private", None, True) == "Coordinates hidden by the observer but included here with the observer's permission"
    assert withheld(None, "obscured", False) == "Coordinates obscured due to iNaturalist taxon geoprivacy"


def test_dates_times_and_paths(spark):
    parts = lambda d: [one(spark, c) for c in S.date_parts(F.lit(d).cast("string"))]
    assert parts("1988-10-25") == [1988, 10, 25] and parts("1967-07") == [None] * 3 and parts("1967-x-01") == [1967, None, 1] and parts(None) == [None] * 3
    assert one(spark, S.time_part(F.lit("2020-01-01T10:00:00ZZ"))) == "10:00:00" and one(spark, S.time_part(F.lit("2020-01-01"))) is None
    path = lambda d: one(spark, S.media_path(F.lit(d).cast("string"), F.lit(7), F.lit("jpg")))
    assert path("2020-01-02-x") == "media/2020/01/02/7.jpg" and path("2020") == path(None) == "media/unknown/7.jpg"
    assert one(spark, S.epithet(F.lit(" Quercus  agrifolia var "), 2)) == "agrifolia" and one(spark, S.epithet(F.lit("Quercus"), 2)) is None


@pytest.mark.parametrize(("query", "expected"), [
    ("?sounds", "sounds=true"), ("taxon_id=1,2&taxon_id=3", "taxon_id=1,2,3"), ("geo=any&page=2&x=1", ""), ("captive=0&d1=2020-01-01&place_id=1,z,2", "place_id=1,2&d1=2020-01-01&captive=false"), ("lat=1.50&lng=2", "lat=1.5&lng=2"), ("q=a%20b+c&list_id=x", "q=a b c"), ("", ""),
])
def test_canonical_queries(spark, query, expected):
    found = one(spark, X.canonical_query(F.lit(query)))
    assert found == expected and one(spark, X.canonical_query(F.lit(found))) == expected


def test_text_pieces(spark):
    assert one(spark, X.place_name(F.lit('{"name": " ", "display_name": ", A , ,B, C"}'))) == "A, B" and one(spark, X.place_name(F.lit("{}"))) is None
    assert one(spark, X.csv_quote(F.lit('a"b'))) == '"a""b"' and one(spark, X.csv_quote(F.lit(None))) == ""
    assert one(spark, X.xml_escape(F.lit('<&"'), quotes=False)) == '&lt;&amp;"' and one(spark, X.term_name(F.lit("http://a/b#c"))) == "c"
    assert one(spark, X.tag_text(F.lit("<para> a </para><para> </para><para>b</para>"), "para")) == ["a", "b"]
    assert one(spark, X.criteria_lines(F.lit("taxon_id=1,2&d1=2020&sounds"))) == ["taxon_id: 1, 2", "observed_after: 2020", "sounds: true"]


def test_retention_matches_the_plain_loop(spark):
    files = [("b", f"p{k}", 10 + k % 3, k // 2) for k in range(60)]
    rows = {r.path: r.evict for r in estimate.retention_plan(spark.createDataFrame(files, "bucket string, path string, size int, mtime int"), 300).collect()}
    total, freed = sum(f[2] for f in files), 0
    for _, path, size, _ in sorted(files, key=lambda f: (f[3], f[1])):
        assert rows[path] == (freed < total - 300)
        freed += size
