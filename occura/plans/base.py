"""Registration of queries, the shared folder, and adapters from the test tables to archives and observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occura import schema
from occura.operators.nest import Ext, OccDataset
from occura.storage import scratch as scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under a key, with its SQL for the oracle where SQL can express it."""

    def register(f):
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: str):
    return F.col(c).cast("string")


# Events as occurrences: the same rows in both engines.
OCC = """occ AS (
  SELECT CAST(event_id AS VARCHAR) AS "occurrenceID", event_type AS "scientificName", CAST(user_id AS VARCHAR) AS "recordedBy", strftime(ts, '%Y-%m-%d') AS "eventDate",
         (event_id * 7919 % 170000) / 1000e0 - 85e0 AS "decimalLatitude", (event_id * 104729 % 360000) / 1000e0 - 180e0 AS "decimalLongitude",
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS "coordinateUncertaintyInMeters", event_id % 3 = 0 AS captive
  FROM events)"""
WITH_OCC = f"WITH {OCC} "


def occ_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("occurrenceID"), F.col("event_type").alias("scientificName"), text("user_id").alias("recordedBy"), F.date_format("ts", "yyyy-MM-dd").alias("eventDate"),
        ((e * 7919 % 170000) / F.lit(1000.0) - 85.0).alias("decimalLatitude"), ((e * 104729 % 360000) / F.lit(1000.0) - 180.0).alias("decimalLongitude"),
        F.when(e % 7 != 0, F.floor("value").cast("string")).alias("coordinateUncertaintyInMeters"), (e % 3 == 0).alias("captive"),
    )


def occ(spark: SparkSession, sf_dir: str) -> OccDataset:
    return OccDataset(occ_rows(spark, sf_dir), "occurrenceID", {}, "events")


def shop(spark: SparkSession, sf_dir: str) -> OccDataset:
    """Orders as a core with lineitems as multimedia, and the returned ones as audiovisual media."""
    core = table(spark, sf_dir, "orders").select(text("o_orderkey").alias("occurrenceID"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    items = table(spark, sf_dir, "lineitem")
    url = F.concat(F.lit("m/"), text("l_partkey"))
    media = items.select(text("l_orderkey").alias("occurrenceID"), text("l_linenumber").alias("title"), url.alias("identifier"))
    sound = items.filter("l_returnflag = 'R'").select(text("l_orderkey").alias("occurrenceID"), F.concat(F.lit("a/"), text("l_suppkey")).alias("accessURI"))
    return OccDataset(core, "occurrenceID", {"multimedia": Ext(media, "occurrenceID"), "audiovisual": Ext(sound, "occurrenceID")}, "orders")


SHOP = """core AS (SELECT CAST(o_orderkey AS VARCHAR) AS "occurrenceID", o_orderpriority, o_orderstatus, o_totalprice FROM orders),
media AS (SELECT CAST(l_orderkey AS VARCHAR) AS "occurrenceID", CAST(l_linenumber AS VARCHAR) AS title, 'm/' || l_partkey AS identifier FROM lineitem),
sound AS (SELECT CAST(l_orderkey AS VARCHAR) AS "occurrenceID", 'a/' || l_suppkey AS "accessURI" FROM lineitem WHERE l_returnflag = 'R')"""
WITH_SHOP = f"WITH {SHOP} "


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as species, regions as genera."""
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("id"), F.concat_ws(" ", F.lit("Genus"), F.lower("n_name")).alias("name"), F.lit("species").alias("rank"), F.lit(10.0).alias("rank_level"))
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("int").alias("id"), F.col("r_name").alias("name"), F.lit("genus").alias("rank"), F.lit(20.0).alias("rank_level"))
    return nation.union(region)


TAXA = """taxa AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS id, 'Genus ' || lower(n_name) AS name, 'species' AS rank FROM nation
  UNION ALL SELECT CAST(r_regionkey + 1000 AS INTEGER), r_name, 'genus' FROM region)"""


def _user(key):
    n = key.cast("string")
    return F.struct(key.cast("int").alias("id"), F.concat(F.lit("user"), n).alias("login"), F.when(key % 2 == 0, F.concat(F.lit("Name "), n)).alias("name"), F.when(key % 3 == 0, F.concat(F.lit("orcid"), n)).alias("orcid"))


def _taxon(key):
    n = (key % 25 + 1).cast("int")
    return F.struct(n.alias("id"), F.concat(F.lit("T"), n.cast("string")).alias("name"), F.lit("species").alias("rank"), F.array((n % 5 + 1000).cast("int"), n).alias("ancestor_ids"), F.when(n % 2 == 0, F.concat(F.lit("c"), n.cast("string"))).alias("preferred_common_name"), (n % 7 != 0).alias("is_active"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested observation documents, with arrays made of their lineitems."""
    line = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    odd = lambda x: x["l_linenumber"] % 2 == 1
    even = lambda x: x["l_linenumber"] % 2 == 0
    of = lambda test, struct: F.sort_array(F.transform(F.filter("_lines", test), struct))

    def photo(x):
        p = x["l_partkey"]
        return F.struct(p.cast("int").alias("id"), F.concat(F.lit("http://x/square/"), p.cast("string"), F.lit("/medium.jpg")).alias("url"), x["l_returnflag"].alias("license_code"), x["l_linestatus"].alias("attribution"))

    def sound(x):
        s, flag = x["l_suppkey"], x["l_returnflag"]
        return F.struct(s.cast("int").alias("id"), F.concat(F.lit("http://s/"), s.cast("string")).alias("file_url"), F.when(flag == "A", "audio/mpeg").when(flag == "N", "audio/wav").otherwise("audio/x").alias("file_content_type"), flag.alias("license_code"), (x["l_linestatus"] == "F").alias("hidden"))

    def ident(x):
        k, p, s, flag, status = (x[c] for c in line)
        return F.struct(p.cast("int").alias("id"), _user(s).alias("user"), _taxon(s).alias("taxon"), flag.alias("body"), F.lit(None).cast("string").alias("created_at"), F.element_at(F.array(*[F.lit(v) for v in ("leading", "supporting", "maverick", "improving")]), (k % 4 + 1).cast("int")).alias("category"), (status == "O").alias("current"))

    def comment(x):
        p, s, flag = x["l_partkey"], x["l_suppkey"], x["l_returnflag"]
        return F.struct(p.cast("int").alias("id"), F.concat(F.lit("u"), s.cast("string")).alias("uuid"), _user(s).alias("user"), flag.alias("body"), F.lit(None).cast("string").alias("created_at"), (flag == "R").alias("hidden"))

    def note(x):
        k, p = x["l_linenumber"], x["l_partkey"]
        return F.struct(F.concat(F.lit("Life Stage="), F.when(k % 3 == 0, "Adult").when(k % 3 == 1, "Larva").otherwise("Thing")).alias("concatenated_attr_val"), (p % 5 - 1).cast("int").alias("vote_score"))

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(*line)).alias("_lines"))  # only the lines' own columns are shuffled
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    lat, lng = (o * 7919 % 170000) / F.lit(1000.0) - 85.0, (o * 104729 % 360000) / F.lit(1000.0) - 180.0
    at = lambda a, b: F.struct(F.lit("Point").alias("type"), F.array(a, b).alias("coordinates"))
    moment = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    values = {
        "id": o.cast("int"), "observed_on": F.date_format("o_orderdate", "yyyy-MM-dd"), "observed_on_string": F.date_format("o_orderdate", "yyyy/MM/dd"), "time_observed_at": moment, "updated_at": moment, "description": F.col("o_orderpriority"),
        "captive": F.col("o_orderstatus") == "F", "obscured": o % 2 == 0, "geoprivacy": F.when(o % 5 == 0, "private").when(o % 5 == 1, "obscured").when(o % 5 == 2, "open"), "taxon_geoprivacy": F.when(o % 3 == 0, "private").when(o % 3 == 1, "obscured"),
        "place_guess": F.col("o_orderpriority"), "private_place_guess": F.when(o % 4 == 0, F.concat(F.lit("p"), o.cast("string"))), "positional_accuracy": (o % 100).cast("int"), "public_positional_accuracy": (o % 1000).cast("int"), "license_code": F.lit("cc-by"),
        "geojson": at(lng, lat), "private_geojson": F.when(o % 7 == 0, at(lng + 0.5, lat + 0.5)), "user": _user(c), "taxon": _taxon(c),
        "photos": of(odd, photo), "sounds": of(even, sound), "identifications": of(odd, ident), "comments": of(even, comment), "annotations": F.sort_array(F.transform("_lines", note)),
    }
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema.OBSERVATION).fields])


#: Observations in a file of pages: compressed files are not split.
PAGE_ROWS = 50_000


def write_pages(obs: DataFrame, path: str) -> None:
    """Observations as compressed JSON pages, in files of a bounded size."""
    obs.write.option("maxRecordsPerFile", PAGE_ROWS).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)
