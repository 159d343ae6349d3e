import csv
import io
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from occura import schema
from occura.operators import dictionary, estimate, merge, observe, search
from occura.operators.nest import Ext, OccDataset
from occura.operators.search import SearchSpec
from occura.plans.base import scratch
from occura.storage import get_text, names_in
from occura.sinks import exports
from occura.sources import delimited, documents
from occura.sources.manifest import Dialect, ManifestError, local_name, parse_manifest

META = """<archive xmlns="http://rs.tdwg.org/dwc/text/">
<core rowType="http://rs.tdwg.org/dwc/terms/Occurrence" {core}><files>{files}</files>{id}
<field index="1" term="http://rs.tdwg.org/dwc/terms/scientificName"/><field index="0" term="http://rs.gbif.org/terms/1.0/gbifID"/></core>
<extension rowType="http://rs.gbif.org/terms/1.0/Multimedia"><files><location>m.csv</location><location>n.csv</location></files>{coreid}<field index="1" term="http://purl.org/dc/terms/identifier"/></extension>
<extension rowType="http://unknown"><files><location>u.csv</location></files></extension></archive>"""


def meta(core='fieldsTerminatedBy="\\t"', files="<location>a.txt</location><location>b.txt</location>", id='<id index="0"/>', coreid='<coreid index="0"/>'):
    return META.format(core=core, files=files, id=id, coreid=coreid)


def test_manifest():
    m = parse_manifest("﻿" + meta())
    assert m.core.locations == ["a.txt", "b.txt"] and m.core.id_column == "gbifID" and m.core.dialect.delimiter == "\t"
    assert list(m.extensions) == ["multimedia"] and m.extensions["multimedia"].locations == ["m.csv"] and m.extensions["multimedia"].id_column == "coreid"
    assert parse_manifest(meta(id="")).core.id_column == "occurrenceID"
    assert local_name("http://x/y#z") == "z"
    for bad in (meta(files=""), meta(coreid=""), meta(files="<location>_a</location>"), "<archive/>", "<"):
        with pytest.raises(ManifestError):
            parse_manifest(bad)


def put(spark, lines, name="f.csv"):
    path = f"{scratch(spark, 'csv')}/{name}"
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


def test_files_with_and_without_header(spark):
    a, b, c = put(spark, ["id,name", "1,Ann", "2,Bob"]), put(spark, ["3,Cy", "4,Di"]), put(spark, ["name,id", "Ed,5"])
    rows = [tuple(r) for r in delimited.read_files(spark, [a, b, c], Dialect()).orderBy("id").collect()]
    assert rows == [("1", "Ann"), ("2", "Bob"), ("3", "Cy"), ("4", "Di"), ("5", "Ed")]


def test_quotes_breaks_marks_and_tabs(spark):
    path = put(spark, ['﻿id,note', '1,"say ""hi"", ok"', '2,"two', 'lines"', '3,""', "4,"])
    rows = [tuple(r) for r in delimited.read_files(spark, [path], Dialect()).orderBy("id").collect()]
    assert rows == [("1", 'say "hi", ok'), ("2", "two\nlines"), ("3", None), ("4", None)]
    tsv = put(spark, ["id\tnote", "1\ta,b"])
    assert delimited.read_files(spark, [tsv], Dialect("\t")).first().note == "a,b"


def test_types_rename_and_empty_columns(spark):
    df = spark.createDataFrame([("1", "1.5", "true", None), ("2", "1d", "x", "")], "occurrenceID string, decimalLatitude string, captive string, remarks string")
    typed = delimited.apply_types(df, "occurrenceID").orderBy("occurrenceID").collect()
    assert [(r.decimalLatitude, r.captive) for r in typed] == [(1.5, True), (None, None)]
    with pytest.raises(ValueError, match="don't fit"):
        delimited.apply_types(df, "occurrenceID", strict=True)
    with pytest.raises(ValueError, match="must stay text"):
        delimited.apply_types(df, "captive")
    assert delimited.drop_empty(df, "occurrenceID").columns == ["occurrenceID", "decimalLatitude", "captive"]
    assert delimited.rename_by_position(df, [(0, "id"), (1, "captive"), (9, "x")]).columns == ["id", "decimalLatitude", "captive", "remarks"]


@pytest.fixture
def archive(spark):
    core = spark.createDataFrame([("1", "Alga <viridis>", 12.5, -45.25), ("2", 'Alga "s", x', -3.75, 100.5), ("3", None, None, 1.0)], "occurrenceID string, scientificName string, decimalLatitude double, decimalLongitude double")
    media = spark.createDataFrame([("1", "a\\b.jpg"), ("2", "https://x/y"), ("2", " ")], "occurrenceID string, identifier string")
    return OccDataset(core, "occurrenceID", {"multimedia": Ext(media, "occurrenceID")}, "t")


def test_store_is_kept(spark, archive):
    path = scratch(spark, "store")
    delimited.save(archive, path)
    delimited.save(OccDataset(archive.core.limit(0), "occurrenceID"), path)
    back = delimited.load(spark, path)
    assert back.core.count() == 3 and back.extensions["multimedia"].df.count() == 3 and back.core_id == "occurrenceID"
    assert [r.path for r in delimited.media_paths(archive).collect()] == ["a/b.jpg"]


def test_kml(archive):
    rows = {r.core_id: r.value for r in exports.placemarks(archive).collect()}
    assert set(rows) == {"1", "2"} and "<name>Alga &lt;viridis&gt;</name>" in rows["1"] and "<coordinates>-45.25,12.5,0</coordinates>" in rows["1"] and "&quot;s&quot;" in rows["2"]


def test_archive_round_trip(spark, archive):
    path = scratch(spark, "archive")
    exports.export_archive(archive, SearchSpec({"scientificName": "alg"}), path)
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/meta.xml").collect())
    m = parse_manifest(text, path)
    ds = delimited.open_archive(spark, m)
    assert sorted(r.occurrenceID for r in ds.core.collect()) == ["1", "2"] and ds.extensions["multimedia"].df.count() == 3
    assert [t for _, t in m.core.fields] == schema.OCCURRENCE_FIELDS and len(m.extensions["multimedia"].fields) == 16


def test_field_lists():
    assert [len(x) for x in (schema.OCCURRENCE_FIELDS, schema.MULTIMEDIA_FIELDS, schema.AUDIOVISUAL_FIELDS, schema.IDENTIFICATION_FIELDS, schema.COMMENT_FIELDS, schema.LIFE_STAGES, schema.TYPE_OVERRIDES)] == [34, 16, 37, 28, 7, 57, 11]
    assert schema.term_uri("eventDate") == "http://rs.tdwg.org/dwc/terms/eventDate" and schema.term_uri("license") == "http://purl.org/dc/terms/license" and schema.term_uri("accessURI", "audiovisual") == "http://rs.tdwg.org/ac/terms/accessURI"


def test_metadata_documents(spark):
    good = '<?xml version="1.0"?><eml:eml xmlns:eml="x"><dataset><title>T</title><creator><individualName><givenName>A</givenName><surName>B</surName></individualName></creator><abstract><para> p </para><para/></abstract><keywordSet><keyword>k</keyword><keyword>l</keyword></keywordSet><coverage><geographicCoverage><boundingCoordinates><westBoundingCoordinate>-1.5</westBoundingCoordinate></boundingCoordinates></geographicCoverage></coverage></dataset></eml:eml>'
    rows = {r.archive: r for r in documents.eml_table(spark.createDataFrame([("a", good), ("b", "<eml:eml><dataset><title>cut"), ("c", None)], "archive string, content string")).collect()}
    assert rows["a"].title == "T" and rows["a"].creators == ["A B"] and rows["a"].abstract == ["p"] and rows["a"].keywords == ["k", "l"] and rows["a"].west == -1.5
    assert rows["b"].title is None and rows["c"].title is None
    fields = documents.meta_fields(spark.createDataFrame([("a", '<archive><core rowType="r"><field index="0" term="http://x/id"/><field term="http://x/id" default="d" vocabulary="v"/></core></archive>')], "archive string, content string")).collect()
    assert [(f.name, f["index"], f.default, f.vocabulary) for f in fields] == [("id", 0, "d", "v")]


def test_catalogue_of_folders(spark, archive):
    root = scratch(spark, "root")
    exports.write_archive(archive, f"{root}/one", pub_date="2024-05-06", query="taxon_id=1")
    exports.write_archive(OccDataset(archive.core, "occurrenceID", {}, query="a=2"), f"{root}/two", ["comments"])
    written = {r.archive: r for r in documents.catalogue(spark, root).collect()}
    assert set(written) == {"one", "two"} and (written["one"].files, written["one"].pub_date, written["one"].query, written["one"].has_multimedia, written["one"].has_comments) == (5, "2024-05-06", "taxon_id=1", True, False)
    assert (written["two"].query, written["two"].has_multimedia, written["two"].has_comments, written["two"].has_media) == ("a=2", False, True, False)
    files = spark.createDataFrame([("one", "eml.xml", 10, "<pubDate>2024-05-06</pubDate>"), ("one", "media/1.jpg", 5, None), ("one", "multimedia.csv", 1, None), ("two", "query.json", 3, '{"query": "a=1"}')], "archive string, name string, size bigint, content string")
    rows = {r.archive: r for r in documents.catalogue_of(files).collect()}
    assert rows["one"].pub_date == "2024-05-06" and rows["one"].has_media and rows["one"].has_multimedia and not rows["one"].has_comments and rows["one"].bytes == 16
    assert rows["two"].query == "a=1" and rows["two"].pub_date is None


def test_archives_by_value_are_those_of_each_value(spark):
    """One pass for all values writes what a filtered archive of each has; ids of two values, blank ids, nulls and a value without rows."""
    core = spark.createDataFrame([("1", "a", 1.5), ("2", "b", None), ("3", "a", 0.25), ("1", "b", 2.0), ("", "a", 3.0), (None, "a", 4.0), ("5", None, 5.0), ("6", "c", 6.0)], "id string, kind string, decimalLatitude double")
    media = spark.createDataFrame([("1", "x,\n\"q\""), ("1", "x,\n\"q\""), ("2", None), ("", "blank"), (None, "null"), ("5", "five"), ("6", "six"), ("9", "none")], "ref string, identifier string")
    comments = spark.createDataFrame([("2", "t")], "ref string, text string")
    ds = OccDataset(core, "id", {"multimedia": Ext(media, "ref"), "comments": Ext(comments, "ref")}, query="all")
    root, plain = scratch(spark, "split"), scratch(spark, "plain")
    exports.write_archives(ds, "kind", {"a": {"pub_date": "2024-01-01"}, "b": {"query": "kind=b"}, "none": {}}, root)
    for value, about in {"a": {"pub_date": "2024-01-01"}, "b": {"query": "kind=b"}, "none": {"query": "all"}}.items():
        one = exports.filtered_archive(OccDataset(core.filter(F.col("kind") == value), "id", ds.extensions), SearchSpec())
        exports.write_archive(one, f"{plain}/{value}", **({"query": "all"} | about))
        read = lambda base, table: spark.read.options(**exports.CSV, multiLine=True).csv(f"{base}/{value}/{table}.csv")  # noqa: B023, E731
        for table in ("occurrence", "multimedia", "comments"):
            assert read(root, table).columns == read(plain, table).columns
            assert sorted(map(str, read(root, table).collect())) == sorted(map(str, read(plain, table).collect()))
        assert all(get_text(spark, f"{root}/{value}/{name}") == get_text(spark, f"{plain}/{value}/{name}") for name in ("meta.xml", "eml.xml", "query.json"))
    assert names_in(spark, root) == ["a", "b", "none"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    with pytest.raises(FileExistsError):
        exports.write_archives(ds, "kind", {"a": {}}, root)
    with pytest.raises(ValueError):
        exports.write_archives(ds, "kind", {"../a": {}}, root)


def test_archives_of_a_catalogue_shuffle_an_extension_once(spark):
    """Rows shuffled for all archives together: those of the extension and of the core once, whatever number of archives there is."""
    core = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("kind"))
    media = spark.range(9000).select((F.col("id") % 3000).cast("string").alias("ref"), F.lit("x").alias("identifier"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("archives", "archives")
    try:
        exports.write_archives(OccDataset(core, "id", {"multimedia": Ext(media, "ref")}), "kind", {f"k{k}": {} for k in range(3)}, scratch(spark, "once"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("archives") for s in tracker.getJobInfo(j).stageIds}
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) == 12000


def test_line_breaks_decide_how_files_are_read(spark):
    plain, broken = put(spark, ["id,note", '1,"a ""b"""', "2,c"]), put(spark, ["id,note", '1,"a', 'b"'])
    assert not any(delimited.line_facts(spark, plain, Dialect())) and delimited.line_facts(spark, broken, Dialect()) == (True, False)
    assert [tuple(r) for r in delimited.read_files(spark, [broken], Dialect()).collect()] == [("1", "a\nb")]


def test_group_and_kml_files(spark, archive):
    path = scratch(spark, "exports")
    exports.export_groups_csv(archive, "scientificName", None, f"{path}/groups")
    rows = spark.read.options(**exports.CSV).csv(f"{path}/groups").collect()
    assert sorted((r.scientificName or "", r.occurrence_count) for r in rows) == [("", "1"), ("Alga \"s\", x", "1"), ("Alga <viridis>", "1")]
    exports.export_kml(archive, SearchSpec({"scientificName": "viridis"}), f"{path}/kml")
    text = get_text(spark, f"{path}/kml")
    assert ElementTree.fromstring(text.encode()).tag.endswith("kml") and text.count("<Placemark>") == 1 and "-45.25,12.5,0" in text


def test_exports_are_one_file_in_the_order_of_the_search(spark, archive):
    path = scratch(spark, "exports")
    rows = spark.range(3000).select(F.format_string("k%05d", F.pmod(F.col("id") * 7919, F.lit(3000))).alias("occurrenceID"), F.lit('a "b",\nc').alias("scientificName"), F.lit(1.5).alias("decimalLatitude"), F.lit(2.5).alias("decimalLongitude")).repartition(5)
    ds, spec = OccDataset(rows, "occurrenceID"), SearchSpec(sort_by="occurrenceID", sort_direction="DESC")
    exports.export_csv(ds, spec, f"{path}/rows.csv")
    read = list(csv.reader(io.StringIO(get_text(spark, f"{path}/rows.csv"))))
    assert read[0] == rows.columns and [r[0] for r in read[1:]] == [f"k{k:05d}" for k in range(2999, -1, -1)] and read[1][1] == 'a "b",\nc'
    exports.export_kml(ds, spec, f"{path}/rows.kml")
    names = [n.text for n in ElementTree.fromstring(get_text(spark, f"{path}/rows.kml").encode()).iter() if n.tag.endswith("value") and (n.text or "").startswith("k0")]
    assert names == [f"k{k:05d}" for k in range(2999, -1, -1)]
    empty = OccDataset(rows.limit(0), "occurrenceID")
    exports.export_csv(empty, None, f"{path}/none.csv")
    exports.export_kml(empty, None, f"{path}/none.kml")
    assert get_text(spark, f"{path}/none.csv") == ",".join(rows.columns) + "\n" and ElementTree.fromstring(get_text(spark, f"{path}/none.kml").encode()) is not None


def test_archives_of_one_file_a_table(spark, archive):
    path = scratch(spark, "archive")
    exports.write_archive(archive, path, list(schema.EXTENSION_FIELDS), one_file=True)
    for name, fields in {"occurrence": schema.OCCURRENCE_FIELDS, **schema.EXTENSION_FIELDS}.items():
        lines = list(csv.reader(io.StringIO(get_text(spark, f"{path}/{name}.csv"))))
        assert lines[0] == fields and all(len(r) == len(fields) for r in lines)
        assert len(lines) - 1 == (archive.core.count() if name == "occurrence" else archive.extensions[name].df.count() if name in archive.extensions else 0)


def test_dictionary_finds_what_the_column_holds(spark):
    path = scratch(spark, "dictionary")
    texts = ["Quercus robur", "quercus ILEX", "Alga", "al", "", None, "100%_x", "x_y\\z", "Élan vital", "ÉLAN", "abcabc", "a_c", "ab", "İstanbul", "Quercus robur"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, name string")
    dictionary.build(df, "name", path)
    found = dictionary.load(spark, path)
    for term in ["querc", "ROBUR", "que%lex", "a_c", "al", "", "%", "zzz", "quezzz", "élan", "y\\z", "%_x", "abca", "istan", "100%"]:
        wanted = sorted(r.id for r in df.filter(search.substring_filter(F.col("name"), term)).collect())
        assert sorted(r.id for r in dictionary.containing(df, "name", found, term).collect()) == wanted, term
        assert [r.value for r in dictionary.suggest(found, term).collect()] == [r.value for r in search.suggest(df, "name", term, terms=["name"]).collect()]
    read = dictionary.suggest(found, "querc").inputFiles()
    assert read and all(f.startswith(path) and "/values/" in f for f in read)  # neither the column nor all postings


def test_page_estimate(spark):
    obs = spark.createDataFrame([('{"id": 1, "photos": [{"id": 2}, {"id": 3}]}',), ('{"id": 2, "photos": []}',)], "value string").select(F.from_json("value", schema.OBSERVATION).alias("o")).select("o.*")
    assert estimate.page_estimate(obs, 100).first().estimate == 90


def test_archive_update_keeps_its_documents(spark):
    media = lambda *r: spark.createDataFrame(list(r), "name string, size int")
    core = spark.createDataFrame([("1", "a")], "id string, name string")
    old = OccDataset(core, "id", media=media(("media/1", 1), ("media/2", 2)), abstract=("p",), pub_date="2001-01-01", query="q")
    ds = merge.update_archive(old, OccDataset(core, "id", media=media(("media/2", 5)), abstract=("new",), query="updated_since=1"))
    assert sorted(map(tuple, ds.media.collect())) == [("media/1", 1), ("media/2", 5)] and (ds.abstract, ds.query) == (("p",), "q") and ds.pub_date > "2024"
    assert merge.update_archive(OccDataset(core, "id"), OccDataset(core, "id"), today="2030-01-01").media is None


def test_upserts(spark):
    df = lambda *r: spark.createDataFrame(list(r), "id string, name string")
    run = lambda a, b: sorted(map(tuple, merge.upsert(a, b, "id").collect()))
    assert run(df(("1", "Ann"), ("2", "Bob"), ("3", "Cy")), df(("2", "Rob"))) == [("1", "Ann"), ("2", "Rob"), ("3", "Cy")]
    assert run(df(("1", "Ann")), df(("2", "Bob"))) == [("1", "Ann"), ("2", "Bob")]
    assert run(df(("1", "Ann"), ("1", "Old")), df(("1", "x"), ("1", "y"))) == [("1", "y")]
    with pytest.raises(ValueError, match="columns differ"):
        merge.upsert(df(("1", "a")), spark.range(1), "id")
    assert merge.updated_since(spark.createDataFrame([("2026-03-01T10:00:00Z",), ("",)], "updated_at string")).first()[0] == "2026-02-28"
    with pytest.raises(ValueError, match="no value"):
        merge.updated_since(spark.createDataFrame([("",)], "updated_at string"))
    old, new = df(("1", "a"), ("1", "b"), ("2", "c")), df(("1", "z"))
    assert sorted(map(tuple, merge.replace_groups(old, new, "id").collect())) == [("1", "z"), ("2", "c")]
    assert sorted(map(tuple, merge.replace_groups(old, new, "id", df(("2", "")).select("id")).collect())) == [("1", "z")]


def test_observation_pages_round_trip(spark):
    path = scratch(spark, "pages")
    spark.createDataFrame([('{"id": 1, "photos": [{"id": 2, "url": "http://x/square.jpg"}], "comments": [{"id": 3, "hidden": true}], "geojson": {"coordinates": [2.0]}, "user": {"id": 1}}',)], "value string").write.text(path)
    obs = documents.read_observations(spark, path)
    taxa = spark.createDataFrame([], "id int, name string, rank string, rank_level double")
    row = observe.to_occurrences(obs, taxa).first()
    assert row.occurrenceID.endswith("/observations/1") and row.decimalLatitude is None and row.recordedBy == "" and row.establishmentMeans == "native" and row.hasCoordinate is False
    assert observe.to_multimedia(obs).first().identifier == "http://x/original.jpg" and observe.to_comments(obs).count() == 0
