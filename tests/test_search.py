import pytest
from occura.operators import groups, nest
from occura.operators import search as O
from occura.operators.nest import Ext, OccDataset
from occura.operators.search import ColumnNotAvailable, SearchSpec


@pytest.fixture(scope="module")
def lat_prefix(spark):
    rows = [(str(k), "s", v, 0.0) for k, v in enumerate([3.0, 3.1, 3.14, 3.141, 30.0, 301.3, 2.9])]
    return spark.createDataFrame(rows, "occurrenceID string, scientificName string, decimalLatitude double, decimalLongitude double")


@pytest.mark.parametrize(("term", "n"), [("3", 4), ("3.1", 3), ("3.14", 2), ("30", 1), ("x", 7), ("1_0", 7)])
def test_numeric_prefix(lat_prefix, term, n):
    assert O.matching(lat_prefix, SearchSpec({"decimalLatitude": term})).count() == n


@pytest.mark.parametrize(("params", "n"), [({"individualCount_min": "100"}, 2), ({"individualCount_max": "10"}, 2), ({"individualCount_min": "10", "individualCount_max": "100"}, 2), ({"individualCount_min": "100", "individualCount_include_blank": "true"}, 3), ({"individualCount_include_blank": "true"}, 5), ({"individualCount_min": "1d"}, 5)])
def test_range(spark, params, n):
    df = spark.createDataFrame([("1", "5"), ("2", "10"), ("3", "100"), ("4", "1000"), ("5", None)], "occurrenceID string, individualCount string")
    assert O.matching(df, SearchSpec.from_dict(params)).count() == n


def test_order_nulls_last_and_unknown_columns(spark):
    df = spark.createDataFrame([("1", 10.5), ("2", -5.3), ("3", 2.1), ("4", -15.7), ("5", None)], "occurrenceID string, decimalLatitude double")
    ids = lambda **k: [r.occurrenceID for r in O.page(df, SearchSpec(**k), "occurrenceID", 9).collect()]
    assert ids(sort_by="decimalLatitude") == ["4", "2", "3", "1", "5"]
    assert ids(sort_by="decimalLatitude", sort_direction="desc") == ["1", "3", "2", "4", "5"]
    assert ids(sort_by="not a field") == ["1", "2", "3", "4", "5"]
    with pytest.raises(ColumnNotAvailable):
        ids(sort_by="family")


def test_reserved_names_and_backslash(spark):
    df = spark.createDataFrame([("1", "Pinales", "Pinopsida", "a\\b"), ("2", "Pinales", "Pinopsida", "50%"), ("3", "Fagales", "Magnoliopsida", None)], "occurrenceID string, `order` string, `class` string, occurrenceRemarks string")
    count = lambda **f: O.matching(df, SearchSpec(f)).count()
    assert (count(order="pin"), count(**{"class": "Pinopsida"}), count(occurrenceRemarks="\\"), count(occurrenceRemarks=""), count(nothing_here="x")) == (2, 2, 1, 2, 3)
    assert [r.value for r in O.suggest(df, "order", "Pin").collect()] == ["Pinales"]
    with pytest.raises(ColumnNotAvailable):
        O.suggest(df, "family", "x")
    with pytest.raises(ColumnNotAvailable):
        O.matching(df, SearchSpec({"family": "x"}))
    assert O.ignored_keys(SearchSpec({"order": "x", "No Such": "y", "foo": "z", "foo_min": "1", "depth_min": "2"})) == ["No Such", "foo", "foo_min"]
    spec = SearchSpec({"order": "pin", "foo": "z", "foo_max": "3"}, sort_by="foo")
    assert [r.occurrenceID for r in O.page(df, spec, "occurrenceID", 9, fields=["occurrenceID", "foo"]).collect()] == ["1", "2"]


def test_spec_from_query_last_wins():
    spec = SearchSpec.from_query("tile://x/1/2/3?order=a&order=b&sort_by=x&nelat=1")
    assert spec == SearchSpec({"order": "b"}, "x", "ASC", {"nelat": "1"})


def test_box_needs_all_corners_and_wraps_on_demand(lat_prefix, spark):
    assert O.matching(lat_prefix, SearchSpec.from_dict({"nelat": "3.1", "swlat": "3"})).count() == 7
    df = spark.createDataFrame([("1", 0.0, 179.0), ("2", 0.0, -179.0), ("3", 0.0, 0.0)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    box = {"nelat": "1", "swlat": "-1", "swlng": "170", "nelng": "-170"}
    assert O.matching(df, SearchSpec.from_dict(box)).count() == 0
    assert O.matching(df, SearchSpec.from_dict(box, wrap=True)).count() == 2


def test_boolean_null_and_dates(spark):
    df = spark.createDataFrame([("1", True), ("2", False), ("3", None)], "occurrenceID string, captive boolean")
    assert [O.matching(df, SearchSpec({"captive": v})).count() for v in ("TRUE", "false", "maybe")] == [1, 1, 3]
    assert O.matching(df, SearchSpec(nulls=("captive",))).count() == 1


def test_render_values(spark):
    df = spark.createDataFrame([("001", 1.5), ("1e3", 2.0), ("nan", None), ("2.50", 0.0), ("x1", 0.0), (None, 0.0), ("1d", 0.0), ("9223372036854775808", 0.0)], "a string, b double")
    assert [r.a for r in O.render_values(df).collect()] == ["1", "1000", None, "2.5", "x1", None, "1d", "9.223372036854776E18"]


def test_keyset_pages_cover_everything(spark):
    df = spark.range(10).toDF("id")
    last, seen = None, []
    while rows := O.page_below(df, "id", last, 4).collect():
        seen += [r.id for r in rows]
        last = seen[-1]
    assert seen == list(range(9, -1, -1))


@pytest.fixture(scope="module")
def oaks(spark):
    core = spark.createDataFrame([("1", "oak"), ("2", "oak"), ("3", "pine"), ("4", None)], "occurrenceID string, scientificName string")
    media = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", "c"), ("9", "z"), (None, "y"), (" ", "w")], "occurrenceID string, identifier string")
    sound = spark.createDataFrame([("4", "s")], "occurrenceID string, accessURI string")
    return OccDataset(core, "occurrenceID", {"multimedia": Ext(media, "occurrenceID"), "audiovisual": Ext(sound, "occurrenceID")})


def test_nested_rows(oaks):
    rows = {r.occurrenceID: r for r in nest.with_extensions(oaks.core, oaks).collect()}
    assert [len(rows[k].multimedia) for k in "1234"] == [2, 1, 0, 0] and [m.identifier for m in rows["1"].multimedia] == ["a", "b"]
    text = {r.occurrenceID: r.multimedia for r in nest.with_extensions(oaks.core, oaks, as_json=True).collect()}
    assert text["3"] == "[]" and text["2"] == '[{"occurrenceID":"2","identifier":"c"}]'
    assert nest.get(oaks, "1").first().scientificName == "oak"
    with pytest.raises(LookupError):
        nest.get(oaks, "99")
    assert nest.semi(oaks.extensions["multimedia"].df, oaks.core, "occurrenceID", "occurrenceID").count() == 3


def test_groups_with_photo(oaks):
    rows = [tuple(r) for r in groups.aggregate_by_field(oaks, "scientificName").collect()]
    assert rows == [("oak", 2, "a"), ("pine", 1, None), (None, 1, "s")]
    with pytest.raises(ColumnNotAvailable):
        groups.group_counts(oaks, "no such")


def test_search_returns_total_and_page(lat_prefix):
    total, page = O.search(lat_prefix, SearchSpec({"decimalLatitude": "3"}, sort_by="decimalLatitude", sort_direction="DESC"), "occurrenceID", 2, 1, ["occurrenceID", "bad field"])
    assert total == 4 and page.columns == ["occurrenceID"] and [r[0] for r in page.collect()] == ["2", "1"]


def test_box_reaches_the_scan(spark, lat_prefix, tmp_path):
    path = f"file://{tmp_path}/core"
    lat_prefix.write.parquet(path)
    found = O.matching(spark.read.parquet(path), SearchSpec.from_dict({"nelat": "4", "nelng": "1", "swlat": "3", "swlng": "-1"}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(decimalLatitude,3.0)" in plan


def test_trigrams_of_a_long_line_take_time_by_its_length(spark):
    import time

    from pyspark.sql import functions as F

    from occura.operators import dictionary

    line = "añ😀B" * 100_000 + "\n"
    rows = spark.createDataFrame([(x,) for x in (line, "ab", "", None, "aB\0c", "aaaa")], "v string").coalesce(1)
    began = time.perf_counter()
    found = {r.v: r.g for r in rows.select("v", dictionary.grams(F.col("v")).alias("g")).collect()}
    assert time.perf_counter() - began < 60  # each character used to lower the whole line again
    low = line.lower()
    assert found[line] == list(dict.fromkeys(low[k : k + 3] for k in range(len(low) - 2)))
    assert (found["ab"], found[""], found[None], found["aB\0c"], found["aaaa"]) == ([], [], [], ["ab\0", "b\0c"], ["aaa"])


def test_a_dictionary_makes_its_trigrams_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from occura.operators import dictionary

    calls, grams = spark.sparkContext.accumulator(0), dictionary.grams

    @F.udf("string")
    def seen(value):
        calls.add(1)
        return value

    monkeypatch.setattr(dictionary, "grams", lambda value: grams(seen(value)))
    rows = spark.range(100).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    dictionary.build(rows, "line", f"file://{tmp_path}/dictionary")
    assert calls.value == 100  # ranges made them again for their bounds
    found = dictionary.load(spark, f"file://{tmp_path}/dictionary")
    assert found.postings.filter("gram = 'lin'").count() == 100 and dictionary.values_with(found, "LINE 7").count() == 11
