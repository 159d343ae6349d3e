"""Queries over the observation transforms; the oracle works on the flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from occura import schema
from occura.functions import scalars as S
from occura.functions.scalars import SITE
from occura.operators import observe
from occura.plans.base import TAXA, observations, query, scratch, table, taxa, text, write_pages
from occura.sources.documents import read_observations, read_taxa

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_OBS_ID = f"'{SITE}/observations/' || o_orderkey"
_LOGIN = "'user' || {k}"
_NAME = "CASE WHEN {k} % 2 = 0 THEN 'Name ' || {k} END"
_PUBLIC_LAT, _PUBLIC_LNG = "(o_orderkey * 7919 % 170000) / 1000e0 - 85e0", "(o_orderkey * 104729 % 360000) / 1000e0 - 180e0"
_PRIVATE = "o_orderkey % 7 = 0"
_MOMENT = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"


@query("obs_flatten", f"SELECT CAST(o_orderkey AS INTEGER) AS id, count(*) FILTER (l_linenumber % 2 = 1) AS photos, count(*) FILTER (l_linenumber % 2 = 0) AS sounds, count(l_orderkey) AS annotations, 'user' || o_custkey AS login FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def obs_flatten(spark, sf_dir):
    """Observations written as JSON pages and read with the document schema."""
    path = scratch(spark, "pages")
    write_pages(observations(spark, sf_dir), path)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(c)
    return read_observations(spark, path).select("id", *[F.greatest(n(c), F.lit(0)).alias(c) for c in ("photos", "sounds", "annotations")], F.col("user.login").alias("login"))


@query("taxa_scan", f"WITH {TAXA} SELECT * FROM taxa")
def taxa_scan(spark, sf_dir):
    path = scratch(spark, "taxa")
    taxa(spark, sf_dir).write.json(path)
    return read_taxa(spark, path).select("id", "name", "rank")


_FLAT = f"""SELECT CAST(o_orderkey AS INTEGER) AS id, 'user' || o_custkey AS user_login, 'T' || (o_custkey % 25 + 1) AS taxon_name, CAST(o_custkey % 25 + 1 AS INTEGER) AS taxon_id, {_PUBLIC_LAT} AS latitude, {_PUBLIC_LNG} AS longitude,
 CASE WHEN {_PRIVATE} THEN {_PUBLIC_LAT} + 0.5e0 END AS private_latitude, CASE WHEN {_PRIVATE} THEN {_PUBLIC_LNG} + 0.5e0 END AS private_longitude, CAST(o_orderkey % 100 AS INTEGER) AS positional_accuracy, CAST(o_orderkey % 1000 AS INTEGER) AS public_positional_accuracy,
 o_orderkey % 2 = 0 AS obscured, CASE o_orderkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'obscured' WHEN 2 THEN 'open' END AS geoprivacy, CASE o_orderkey % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'obscured' END AS taxon_geoprivacy, {_MOMENT} AS updated_at,
 o_orderstatus = 'F' AS captive, {_MOMENT} AS time_observed_at, strftime(o_orderdate, '%Y/%m/%d') AS observed_on_string, o_orderpriority AS place_guess FROM orders"""


@query("obs_flat_csv", _FLAT)
def obs_flat_csv(spark, sf_dir):
    return observe.observations_flat(observations(spark, sf_dir))


_WITHHELD = f"""CASE WHEN g IS NOT NULL THEN CASE WHEN g IN ('private', 'obscured') THEN 'Coordinates ' || CASE g WHEN 'private' THEN 'hidden' ELSE 'obscured' END || ' by the observer' || CASE WHEN {_PRIVATE} THEN ' but included here with the observer''s permission' ELSE '' END END
 WHEN t IS NOT NULL THEN 'Coordinates ' || CASE t WHEN 'private' THEN 'hidden' ELSE 'obscured' END || ' due to iNaturalist taxon geoprivacy' || CASE WHEN {_PRIVATE} THEN ' but included here with the observer''s permission' ELSE '' END END"""
_PRIVACY = "SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'obscured' WHEN 2 THEN 'open' END AS g, CASE o_orderkey % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'obscured' END AS t, CAST(o_custkey % 25 + 1 AS INTEGER) AS k FROM orders"


@query("obs_to_occurrence", f"""WITH {TAXA}, o AS ({_PRIVACY})
SELECT {_OBS_ID} AS "occurrenceID", 'user' || o_custkey AS "recordedBy", strftime(o_orderdate, '%Y-%m-%d') AS "eventDate", CASE WHEN {_PRIVATE} THEN {_PUBLIC_LAT} + 0.5e0 ELSE {_PUBLIC_LAT} END AS "decimalLatitude", CASE WHEN {_PRIVATE} THEN {_PUBLIC_LNG} + 0.5e0 ELSE {_PUBLIC_LNG} END AS "decimalLongitude",
 'T' || k AS "scientificName", (SELECT name FROM taxa WHERE id = k % 5 + 1000) AS genus, (SELECT name FROM taxa WHERE id = k) AS species, '{SITE}/taxa/' || k AS "taxonID", CASE WHEN o_orderstatus = 'F' THEN 'managed' ELSE 'native' END AS "establishmentMeans",
 CAST(CASE WHEN {_PRIVATE} THEN o_orderkey % 100 ELSE o_orderkey % 1000 END AS DOUBLE) AS "coordinateUncertaintyInMeters", {_WITHHELD} AS "informationWithheld", strftime(o_orderdate, '%H:%M:%S') AS "eventTime", CASE WHEN o_orderkey % 4 = 0 THEN 'p' || o_orderkey ELSE o_orderpriority END AS "verbatimLocality",
 CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day FROM o""")
def obs_to_occurrence(spark, sf_dir):
    rows = observe.to_occurrences(observations(spark, sf_dir), taxa(spark, sf_dir))
    return rows.select("occurrenceID", "recordedBy", "eventDate", "decimalLatitude", "decimalLongitude", "scientificName", "genus", "species", "taxonID", "establishmentMeans", "coordinateUncertaintyInMeters", "informationWithheld", "eventTime", "verbatimLocality", "year", "month", "day")


@query("annotation_winner", f"""WITH n AS (SELECT l_orderkey AS o, 'Life Stage=' || CASE l_linenumber % 3 WHEN 0 THEN 'Adult' WHEN 1 THEN 'Larva' ELSE 'Thing' END AS a, l_partkey % 5 - 1 AS vote FROM lineitem),
w AS (SELECT o, lower(substr(arg_max(a, vote * 100 + CASE a WHEN 'Life Stage=Thing' THEN 3 WHEN 'Life Stage=Larva' THEN 2 ELSE 1 END), 12)) AS v FROM n WHERE vote >= 0 GROUP BY o)
SELECT CAST(o_orderkey AS INTEGER) AS id, CASE WHEN v IN ('adult', 'larva') THEN v END AS life_stage FROM orders LEFT JOIN w ON o = o_orderkey""")
def annotation_winner(spark, sf_dir):
    return observations(spark, sf_dir).select("id", S.annotation(F.col("annotations"), "Life Stage", schema.LIFE_STAGES).alias("life_stage"))


@query("explode_photos", f"""SELECT {_OBS_ID} AS "occurrenceID", 'http://x/original/' || l_partkey || '/original.jpg' AS identifier, 'http://www.inaturalist.org/photos/' || l_partkey AS "references", 'user' || o_custkey AS creator, l_returnflag AS license, 'StillImage' AS type FROM {_LINES} WHERE l_linenumber % 2 = 1""")
def explode_photos(spark, sf_dir):
    return observe.to_photo_multimedia(observations(spark, sf_dir)).select("occurrenceID", "identifier", "references", "creator", "license", "type")


@query("explode_sounds", f"""SELECT {_OBS_ID} AS "occurrenceID", 'http://s/' || l_suppkey AS identifier, '{SITE}/sounds/' || l_suppkey AS "references", CASE l_returnflag WHEN 'A' THEN 'audio/mpeg' WHEN 'N' THEN 'audio/wav' ELSE 'audio/x' END AS format FROM {_LINES} WHERE l_linenumber % 2 = 0 AND l_linestatus <> 'F'""")
def explode_sounds(spark, sf_dir):
    return observe.to_sound_multimedia(observations(spark, sf_dir)).select("occurrenceID", "identifier", "references", "format")


@query("explode_audiovisual", f"""SELECT {_OBS_ID} AS "occurrenceID", '{SITE}/photos/' || l_partkey AS identifier, 'T' || (o_custkey % 25 + 1) AS "scientificName", l_linestatus AS credit, {_PUBLIC_LAT} AS "decimalLatitude", 'http://x/original/' || l_partkey || '/original.jpg' AS "accessURI" FROM {_LINES} WHERE l_linenumber % 2 = 1""")
def explode_audiovisual(spark, sf_dir):
    return observe.to_audiovisual(observations(spark, sf_dir)).select("occurrenceID", "identifier", "scientificName", "credit", "decimalLatitude", "accessURI")


_WHO = f"concat_ws('|', {_LOGIN.format(k='l_suppkey')}, {_NAME.format(k='l_suppkey')})"


@query("explode_identifications", f"""WITH {TAXA}, i AS (SELECT *, CAST(l_suppkey % 25 + 1 AS INTEGER) AS k FROM {_LINES} WHERE l_linenumber % 2 = 1)
SELECT {_OBS_ID} AS "occurrenceID", CAST(l_partkey AS VARCHAR) AS "identificationID", {_WHO} AS "identifiedBy", concat_ws('|', CASE WHEN l_suppkey % 3 = 0 THEN 'orcid' || l_suppkey END, '{SITE}/users/' || l_suppkey) AS "identifiedByID",
 '{SITE}/taxa/' || k AS "taxonID", CASE WHEN k % 7 <> 0 THEN 'active' ELSE 'inactive' END AS "taxonomicStatus", a.name || ' | ' || b.name || ' | ' || a.name AS "higherClassification", b.name AS genus, split_part(a.name, ' ', 2) AS "specificEpithet",
 '{SITE}/terminology/' || ['leading', 'supporting', 'maverick', 'improving'][l_linenumber % 4 + 1] AS "identificationVerificationStatus", l_linestatus = 'O' AS "identificationCurrent"
FROM i JOIN taxa a ON a.id = k JOIN taxa b ON b.id = k % 5 + 1000""")
def explode_identifications(spark, sf_dir):
    rows = observe.to_identifications(observations(spark, sf_dir), taxa(spark, sf_dir))
    return rows.select("occurrenceID", "identificationID", "identifiedBy", "identifiedByID", "taxonID", "taxonomicStatus", "higherClassification", "genus", "specificEpithet", "identificationVerificationStatus", "identificationCurrent")


@query("explode_comments", f"""SELECT {_OBS_ID} AS "occurrenceID", '{SITE}/comments/' || l_partkey || '|u' || l_suppkey AS identifier, {_WHO} AS author, '{SITE}/users/' || l_suppkey AS "authorID", l_returnflag AS text FROM {_LINES} WHERE l_linenumber % 2 = 0 AND l_returnflag <> 'R'""")
def explode_comments(spark, sf_dir):
    return observe.to_comments(observations(spark, sf_dir)).select("occurrenceID", "identifier", "author", "authorID", "text")


@query("visible_only", f"SELECT CAST(o_orderkey AS INTEGER) AS id, count(*) FILTER (l_linenumber % 2 = 0 AND l_linestatus <> 'F') AS sounds, count(*) FILTER (l_linenumber % 2 = 0 AND l_returnflag <> 'R') AS comments FROM {_LINES} GROUP BY o_orderkey")
def visible_only(spark, sf_dir):
    n = lambda c: F.size(S.visible(F.col(c))).cast("bigint").alias(c)
    return observations(spark, sf_dir).filter(F.size("annotations") > 0).select("id", n("sounds"), n("comments"))


@query("union_media", f"SELECT 'StillImage' AS type, count(*) AS n FROM {_LINES} WHERE l_linenumber % 2 = 1 UNION ALL SELECT 'Sound', count(*) FROM {_LINES} WHERE l_linenumber % 2 = 0 AND l_linestatus <> 'F'")
def union_media(spark, sf_dir):
    return observe.to_multimedia(observations(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


# --- lineages of customers: nation as species, region as genus

_LINEAGE = "customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def _customers(spark, sf_dir):
    ids = F.array((F.col("n_regionkey") + 1000).cast("int"), (F.col("c_nationkey") + 1).cast("int"), F.lit(-5))
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("key"), ids.alias("lineage_ids"))


@query("lineage_pivot", f"SELECT c_custkey AS key, r_name AS genus, 'Genus ' || lower(n_name) AS species, CAST(NULL AS VARCHAR) AS family FROM {_LINEAGE}")
def lineage_pivot(spark, sf_dir):
    return observe.lineage(_customers(spark, sf_dir), taxa(spark, sf_dir)).select("key", "genus", "species", "family")


@query("lineage_string", f"SELECT c_custkey AS key, r_name || ' | Genus ' || lower(n_name) AS higher_classification FROM {_LINEAGE}")
def lineage_string(spark, sf_dir):
    return observe.lineage(_customers(spark, sf_dir), taxa(spark, sf_dir)).select("key", "higher_classification")


@query("distinct_lineage_ids", """WITH k AS (SELECT o_custkey % 25 + 1 AS k FROM orders UNION SELECT l_suppkey % 25 + 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 1)
SELECT DISTINCT CAST(i AS INTEGER) AS taxon_id FROM (SELECT k AS i FROM k UNION ALL SELECT k % 5 + 1000 FROM k)""")
def distinct_lineage_ids(spark, sf_dir):
    return observe.taxon_ids(observations(spark, sf_dir))


# --- scalar pieces


@query("uri_build", f"SELECT o_orderkey, '{SITE}/observations/' || o_orderkey AS observation, '{SITE}/taxa/' || o_custkey AS taxon, '{SITE}/users/' || o_custkey AS person, '{SITE}/sounds/' || o_orderkey AS sound FROM orders")
def uri_build(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(o, S.uri("observation", o).alias("observation"), S.uri("taxon", c).alias("taxon"), S.uri("user", c).alias("person"), S.uri("sound", o).alias("sound"))


@query("url_original", "SELECT page_id, replace(replace(replace(replace(url || '/square_large.jpg', 'square', 'original'), 'small', 'original'), 'medium', 'original'), 'large', 'original') AS url FROM pages")
def url_original(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.original_url(F.concat("url", F.lit("/square_large.jpg"))).alias("url"))


@query("join_nonempty", "SELECT c_custkey, concat_ws('|', nullif(c_mktsegment, ''), CASE WHEN c_custkey % 2 = 0 THEN c_name END) AS joined FROM customer")
def join_nonempty(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.join_nonempty(F.col("c_mktsegment"), F.lit(""), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))).alias("joined"))


@query("geojson_point", f"SELECT CAST(o_orderkey AS INTEGER) AS id, CASE WHEN {_PRIVATE} THEN {_PUBLIC_LAT} + 0.5e0 ELSE {_PUBLIC_LAT} END AS lat, CASE WHEN {_PRIVATE} THEN {_PUBLIC_LNG} + 0.5e0 ELSE {_PUBLIC_LNG} END AS lng FROM orders")
def geojson_point(spark, sf_dir):
    lat, lng = S.point(F.col("geojson"), F.col("private_geojson"))
    return observations(spark, sf_dir).select("id", lat.alias("lat"), lng.alias("lng"))


@query("uncertainty_pick", f"SELECT CAST(o_orderkey AS INTEGER) AS id, CAST(CASE WHEN {_PRIVATE} THEN o_orderkey % 100 ELSE o_orderkey % 1000 END AS DOUBLE) AS uncertainty FROM orders")
def uncertainty_pick(spark, sf_dir):
    return observations(spark, sf_dir).select("id", S.uncertainty(F.col("private_geojson"), F.col("positional_accuracy"), F.col("public_positional_accuracy")).alias("uncertainty"))


@query("withheld_text", f"WITH o AS ({_PRIVACY}) SELECT CAST(o_orderkey AS INTEGER) AS id, {_WITHHELD} AS withheld FROM o")
def withheld_text(spark, sf_dir):
    return observations(spark, sf_dir).select("id", S.information_withheld(F.col("geoprivacy"), F.col("taxon_geoprivacy"), F.col("private_geojson").isNotNull()).alias("withheld"))


@query("flag_columns", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'managed' ELSE 'native' END AS means, CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' END AS status FROM events")
def flag_columns(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", S.establishment(F.when(e % 3 != 1, e % 3 == 0)).alias("means"), S.taxon_status(e % 3 != 2, F.when(e % 3 == 1, F.lit(False))).alias("status"))


@query("date_parts", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(year(ts) AS INTEGER) END AS y, CASE WHEN event_id % 4 <> 0 THEN CAST(month(ts) AS INTEGER) END AS m, CASE WHEN event_id % 4 = 1 THEN CAST(day(ts) AS INTEGER) END AS d FROM events")
def date_parts(spark, sf_dir):
    e = F.col("event_id") % 4
    date = F.when(e == 0, F.date_format("ts", "yyyy-MM")).when(e == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-"), F.lit("x")))
    y, m, d = S.date_parts(date)
    return table(spark, sf_dir, "events").select("event_id", y.alias("y"), m.alias("m"), d.alias("d"))


@query("time_part", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%H:%M:%S') END AS t FROM events")
def time_part(spark, sf_dir):
    moment = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'ZZ'"))
    return table(spark, sf_dir, "events").select("event_id", S.time_part(moment).alias("t"))


@query("epithets", "SELECT p_partkey, nullif(regexp_extract(trim(p_name), '^[^ ]+ +([^ ]+)', 1), '') AS second, nullif(regexp_extract(trim(p_name), '^[^ ]+ +[^ ]+ +([^ ]+)', 1), '') AS third FROM part")
def epithets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.epithet(F.col("p_name"), 2).alias("second"), S.epithet(F.col("p_name"), 3).alias("third"))


@query("status_map", f"SELECT l_orderkey, l_linenumber, '{SITE}/terminology/' || CASE l_linenumber WHEN 1 THEN 'leading' WHEN 2 THEN 'supporting' WHEN 3 THEN 'maverick' WHEN 4 THEN 'improving' END AS status FROM lineitem")
def status_map(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("leading", "supporting", "maverick", "improving", "other", "", "none")])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.identification_status(F.try_element_at(names, F.col("l_linenumber").cast("int"))).alias("status"))


_TYPES = {"BUILDING": "audio/mp3", "AUTOMOBILE": "audio/x-m4a", "MACHINERY": "audio/wave", "HOUSEHOLD": "text/plain"}
_MIME = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"


def _mime():
    return F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])[F.col("c_mktsegment")]


@query("mime_ext", f"SELECT c_custkey, CASE {_MIME} WHEN 'audio/mp3' THEN 'mp3' WHEN 'audio/x-m4a' THEN 'm4a' WHEN 'audio/wave' THEN 'wav' ELSE 'bin' END AS ext FROM customer")
def mime_ext(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.sound_extension(_mime()).alias("ext"))


@query("media_kind", f"SELECT c_custkey, c_custkey % 9 = 0 OR coalesce({_MIME}, '') LIKE 'audio/%' AS sound FROM customer")
def media_kind(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.is_sound(F.when(F.col("c_custkey") % 9 == 0, "Sound"), _mime()).alias("sound"))


@query("media_path", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'media/unknown/' ELSE 'media/' || strftime(ts, '%Y/%m/%d') || '/' END || event_id || '.jpg' AS path FROM events")
def media_path(spark, sf_dir):
    date = F.when(F.col("event_id") % 5 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", S.media_path(date, F.col("event_id"), F.lit("jpg")).alias("path"))


@query("media_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NOT NULL THEN 'local/' || p_partkey ELSE 'http://x/' || l_partkey || '/original.jpg' END AS identifier FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 0")
def media_lookup(spark, sf_dir):
    mapping = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("local/"), text("p_partkey")).alias("local"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(mapping, "l_partkey", "left")
    url = S.original_url(F.concat(F.lit("http://x/"), text("l_partkey"), F.lit("/square.jpg")))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", observe.media_identifier(F.col("local"), url).alias("identifier"))
