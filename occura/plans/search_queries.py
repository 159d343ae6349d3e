"""Queries over the search operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from occura.functions.text import number
from occura.operators import dictionary
from occura.operators import search as O
from occura.operators.nest import OccDataset
from occura.operators.search import SearchSpec
from occura.plans.base import WITH_OCC, WITH_SHOP, occ, occ_rows, query, scratch, shop, table
from occura.sinks import exports

ID_PAGE = 'SELECT "occurrenceID", "scientificName", "decimalLatitude", "decimalLongitude" FROM occ '
FIELDS = ["occurrenceID", "scientificName", "decimalLatitude", "decimalLongitude"]


def _where(key: str, params: dict, condition: str, **more) -> None:
    @query(key, f"{WITH_OCC} {ID_PAGE} WHERE {condition}")
    def run(spark, sf_dir):
        return O.project(O.matching(occ_rows(spark, sf_dir), SearchSpec.from_dict(params, **more)), FIELDS)


_BOX = {"nelat": "40", "nelng": "100.5", "swlat": "-20", "swlng": "-30"}
_IN_BOX = '"decimalLatitude" BETWEEN -20 AND 40 AND "decimalLongitude" BETWEEN -30 AND 100.5'
_NUM = """CASE WHEN regexp_matches("coordinateUncertaintyInMeters", '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST("coordinateUncertaintyInMeters" AS DOUBLE) END"""
_where("filter_ilike", {"scientificName": "C"}, """ "scientificName" ILIKE '%c%'""")
_where("filter_numeric_prefix", {"decimalLatitude": "-3"}, '"decimalLatitude" >= -3 AND "decimalLatitude" < -2')
_where("filter_boolean", {"captive": "TRUE"}, "captive")
_where("filter_range", {"coordinateUncertaintyInMeters_min": "10", "coordinateUncertaintyInMeters_max": "40"}, f"{_NUM} BETWEEN 10 AND 40")
_where("filter_range_blank", {"coordinateUncertaintyInMeters_min": "50", "coordinateUncertaintyInMeters_include_blank": "true"}, f'({_NUM} >= 50 OR "coordinateUncertaintyInMeters" IS NULL)')
_where("filter_bbox", _BOX, _IN_BOX)
_where("filter_combined", {**_BOX, "captive": "false", "scientificName": "i", "no such key": "x", "recordedBy": "1"}, f"""{_IN_BOX} AND NOT captive AND "scientificName" ILIKE '%i%' AND "recordedBy" ILIKE '%1%'""")


@query("search_unknown_keys", f"""{WITH_OCC} {ID_PAGE} WHERE captive ORDER BY "occurrenceID" LIMIT 300""")
def search_unknown_keys(spark, sf_dir):
    """Keys and a sort field that are no fields of occurrences have no effect."""
    spec = SearchSpec.from_dict({"captive": "true", "foo": "x", "page": "3", "foo_min": "1", "sort_by": "foo", "sort_direction": "DESC"})
    return O.page(occ_rows(spark, sf_dir), spec, "occurrenceID", 300, fields=[*FIELDS, "foo"])


@query("filter_date_prefix", "SELECT event_id, event_type FROM events WHERE strftime(ts, '%Y-%m-%d') LIKE '2024-01%'")
def filter_date_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return rows.filter(O.date_prefix_filter(F.col("day"), "2024-01")).select("event_id", "event_type")


@query("project_fields", f"{WITH_OCC} {ID_PAGE}")
def project_fields(spark, sf_dir):
    return O.project(occ_rows(spark, sf_dir), [*FIELDS, "not a field", "__x"])


@query("render_numeric_text", f"""{WITH_OCC}, t AS (SELECT "occurrenceID", "coordinateUncertaintyInMeters" AS u, '00' || "recordedBy" AS r, "recordedBy" || 'e1' AS e, 'id' || "recordedBy" AS i FROM occ)
SELECT "occurrenceID", u AS uncertainty, CAST(CAST(r AS BIGINT) AS VARCHAR) AS padded, CAST(CAST(CAST(e AS DOUBLE) AS BIGINT) AS VARCHAR) AS power, i AS plain FROM t""")
def render_numeric_text(spark, sf_dir):
    rows = occ_rows(spark, sf_dir).select("occurrenceID", F.col("coordinateUncertaintyInMeters").alias("uncertainty"), F.concat(F.lit("00"), "recordedBy").alias("padded"), F.concat("recordedBy", F.lit("e1")).alias("power"), F.concat(F.lit("id"), "recordedBy").alias("plain"))
    return O.render_values(rows)


@query("reserved_names", """SELECT o_orderpriority AS "order", o_orderstatus AS "group", count(*) AS n FROM orders WHERE o_orderpriority ILIKE '%1%' GROUP BY 1, 2""")
def reserved_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("order"), F.col("o_orderstatus").alias("group"))
    return O.matching(rows, SearchSpec.from_dict({"order": "1"})).groupBy("order", "group").agg(F.count("*").alias("n"))


@query("sort_text", f"""{WITH_OCC} {ID_PAGE} ORDER BY "scientificName" DESC NULLS LAST, "occurrenceID" LIMIT 500""")
def sort_text(spark, sf_dir):
    return O.page(occ_rows(spark, sf_dir), SearchSpec(sort_by="scientificName", sort_direction="desc"), "occurrenceID", 500, fields=FIELDS)


@query("sort_numeric", f"""{WITH_OCC} {ID_PAGE} ORDER BY "decimalLatitude", "occurrenceID" LIMIT 500""")
def sort_numeric(spark, sf_dir):
    return O.page(occ_rows(spark, sf_dir), SearchSpec(sort_by="decimalLatitude"), "occurrenceID", 500, fields=FIELDS)


@query("search_page", f"""{WITH_OCC} {ID_PAGE} WHERE {_IN_BOX} AND "scientificName" ILIKE '%i%' ORDER BY "eventDate" DESC NULLS LAST, "occurrenceID" LIMIT 500 OFFSET 250""")
def search_page(spark, sf_dir):
    spec = SearchSpec.from_dict({**_BOX, "scientificName": "i", "sort_by": "eventDate", "sort_direction": "DESC"})
    return O.page(occ_rows(spark, sf_dir), spec, "occurrenceID", 500, 250, FIELDS)


@query("keyset_page", "SELECT event_id, event_type FROM events WHERE event_id < (SELECT max(event_id) // 2 FROM events) ORDER BY event_id DESC LIMIT 200")
def keyset_page(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return O.page_below(events, "event_id", events.agg(F.max("event_id")).first()[0] // 2)


@query("autocomplete", f"""{WITH_OCC} SELECT DISTINCT "recordedBy" AS value FROM occ WHERE "recordedBy" ILIKE '%1%' ORDER BY 1 LIMIT 50""")
def autocomplete(spark, sf_dir):
    return O.suggest(occ_rows(spark, sf_dir), "recordedBy", "1")


def _dictionary(spark, sf_dir):
    """Comments that no two orders share, as a column of many distinct values."""
    path = scratch(spark, "dictionary")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    dictionary.build(rows, "line", path)
    return rows, dictionary.load(spark, path)


_LINES_OF = "d AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)"


@query("autocomplete_dictionary", f"WITH {_LINES_OF} SELECT DISTINCT line AS value FROM d WHERE line ILIKE '%the%on%' ORDER BY 1 LIMIT 50")
def autocomplete_dictionary(spark, sf_dir):
    """Suggestions from a stored dictionary of first lines; a term with a wildcard."""
    return dictionary.suggest(_dictionary(spark, sf_dir)[1], "THE%on")


@query("substring_dictionary", f"WITH {_LINES_OF} SELECT doc_id FROM d WHERE line ILIKE '%tion%'")
def substring_dictionary(spark, sf_dir):
    """The documents whose first line holds a text, by the values of a stored dictionary."""
    rows, found = _dictionary(spark, sf_dir)
    return dictionary.containing(rows, "line", found, "Tion").select("doc_id")


@query("count_filtered", f"{WITH_OCC} SELECT count(*) AS total FROM occ WHERE {_IN_BOX} AND captive")
def count_filtered(spark, sf_dir):
    return O.matching(occ_rows(spark, sf_dir), SearchSpec.from_dict({**_BOX, "captive": "true"})).agg(F.count("*").alias("total"))


@query("pinned_sort", "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_type) AS place FROM events GROUP BY event_type")
def pinned_sort(spark, sf_dir):
    groups = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.when(F.col("event_type") == "view", 0).otherwise(1), "event_type")  # one row per type
    return O.pinned_sort(groups.withColumn("place", F.row_number().over(order)), "event_type", "view")


@query("export_csv_rows", f"""{WITH_OCC} SELECT "occurrenceID", "scientificName", "recordedBy", "eventDate", coalesce("coordinateUncertaintyInMeters", '') AS "coordinateUncertaintyInMeters", CAST(captive AS VARCHAR) AS captive FROM occ WHERE captive""")
def export_csv_rows(spark, sf_dir):
    """Written as one CSV file and read back as text."""
    ds = occ(spark, sf_dir)
    path = f"{scratch(spark, 'csv')}/rows.csv"
    exports.export_csv(OccDataset(ds.core.drop("decimalLatitude", "decimalLongitude"), ds.core_id), SearchSpec({"captive": "true"}), path)
    back = spark.read.options(header=True, quote='"', escape='"', inferSchema=False).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("export_groups", f"""{WITH_OCC} SELECT coalesce("coordinateUncertaintyInMeters", '') AS "coordinateUncertaintyInMeters", count(*) AS occurrence_count FROM occ GROUP BY "coordinateUncertaintyInMeters" """)
def export_groups(spark, sf_dir):
    return exports.group_rows(occ(spark, sf_dir), "coordinateUncertaintyInMeters")


@query("kml_placemarks", f"""{WITH_OCC} SELECT "occurrenceID" AS core_id, '<Placemark><name>' || "scientificName" || '</name><ExtendedData>' ||
 CASE WHEN "coordinateUncertaintyInMeters" IS NULL THEN '' ELSE '<Data name="coordinateUncertaintyInMeters"><value>' || "coordinateUncertaintyInMeters" || '</value></Data>' END ||
 '<Data name="decimalLatitude"><value>' || CAST("decimalLatitude" AS VARCHAR) || '</value></Data><Data name="decimalLongitude"><value>' || CAST("decimalLongitude" AS VARCHAR) || '</value></Data>' ||
 '<Data name="occurrenceID"><value>' || "occurrenceID" || '</value></Data><Data name="scientificName"><value>' || "scientificName" || '</value></Data></ExtendedData><Point><coordinates>' ||
 CAST("decimalLongitude" AS VARCHAR) || ',' || CAST("decimalLatitude" AS VARCHAR) || ',0</coordinates></Point></Placemark>' AS value
 FROM (SELECT * REPLACE (floor("decimalLatitude") + 0.5e0 AS "decimalLatitude", floor("decimalLongitude") + 0.25e0 AS "decimalLongitude") FROM occ)""")
def kml_placemarks(spark, sf_dir):
    rows = occ_rows(spark, sf_dir).drop("recordedBy", "eventDate", "captive")
    rows = rows.withColumns({"decimalLatitude": F.floor("decimalLatitude") + 0.5, "decimalLongitude": F.floor("decimalLongitude") + 0.25})
    return exports.placemarks(OccDataset(rows, "occurrenceID"))


@query("export_kml_document", f"""{WITH_OCC} SELECT count(*) AS placemarks, true AS in_order, 1 AS documents FROM occ WHERE captive""")
def export_kml_document(spark, sf_dir):
    """One KML document, read back line by line: a head, a foot, and a placemark a line in the order of the ids."""
    path = f"{scratch(spark, 'kml')}/rows.kml"
    exports.export_kml(occ(spark, sf_dir), SearchSpec({"captive": "true"}, sort_by="occurrenceID"), path)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), F.regexp_extract("value", r'name="occurrenceID"><value>([^<]*)', 1).alias("id"))
    before = Window.partitionBy(F.shiftright("at", 33)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # by split
    last = F.coalesce(F.last(F.when(F.col("id") != "", F.col("id")), True).over(before), F.lit(""))
    steps = lines.withColumn("ordered", (F.col("id") == "") | (last <= F.col("id")))
    return steps.agg(F.count_if(F.col("id") != "").alias("placemarks"), F.min("ordered").alias("in_order"), F.count_if(F.col("value").contains("<kml ")).cast("int").alias("documents"))


@query("write_occurrence_fields", f"""{WITH_SHOP} SELECT "occurrenceID", 'x' AS "basisOfRecord", '' AS "scientificName", o_orderstatus AS license, trim(CAST(CAST(o_totalprice * 100 AS BIGINT) AS VARCHAR)) AS cents FROM core""")
def write_occurrence_fields(spark, sf_dir):
    """The 34 written columns, of which the given ones and an empty one are looked at."""
    from occura import schema

    rows = shop(spark, sf_dir).core.select("occurrenceID", F.lit("x").alias("basisOfRecord"), F.col("o_orderstatus").alias("license"), F.col("o_totalprice").alias("decimalLatitude"))
    wide = exports.written_fields(rows, schema.OCCURRENCE_FIELDS)
    return wide.select("occurrenceID", "basisOfRecord", "scientificName", "license", (F.round(number(F.col("decimalLatitude")) * 100)).cast("bigint").cast("string").alias("cents"))
