"""Queries over nesting, groups, merges, estimates and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from occura.operators import estimate, groups, merge, nest
from occura.operators.nest import Ext, OccDataset
from occura.operators.search import SearchSpec
from occura.plans.base import WITH_OCC, WITH_SHOP, observations, occ, occ_rows, query, scratch, shop, table, text
from occura.sinks import exports
from occura.sources import delimited, documents, store
from occura.sources.manifest import Dialect, Manifest, Table

# --- nesting and groups


@query("nested_extension_counts", f"""{WITH_SHOP} SELECT "occurrenceID", CAST((SELECT count(*) FROM media m WHERE m."occurrenceID" = core."occurrenceID") AS INTEGER) AS n_media, CAST((SELECT count(*) FROM sound s WHERE s."occurrenceID" = core."occurrenceID") AS INTEGER) AS n_sound FROM core""")
def nested_extension_counts(spark, sf_dir):
    ds = shop(spark, sf_dir)
    return nest.with_extensions(ds.core, ds, one_page=False).select("occurrenceID", F.size("multimedia").alias("n_media"), F.size("audiovisual").alias("n_sound"))


@query("nested_extension_json", f"""{WITH_SHOP}, m AS (SELECT "occurrenceID", string_agg('{{"occurrenceID":"' || "occurrenceID" || '","title":"' || title || '","identifier":"' || identifier || '"}}', ',' ORDER BY title, identifier) AS rows FROM media GROUP BY 1),
s AS (SELECT "occurrenceID", string_agg('{{"occurrenceID":"' || "occurrenceID" || '","accessURI":"' || "accessURI" || '"}}', ',' ORDER BY "accessURI") AS rows FROM sound GROUP BY 1)
SELECT core."occurrenceID", '[' || coalesce(m.rows, '') || ']' AS multimedia, '[' || coalesce(s.rows, '') || ']' AS audiovisual FROM core LEFT JOIN m ON m."occurrenceID" = core."occurrenceID" LEFT JOIN s ON s."occurrenceID" = core."occurrenceID" """)
def nested_extension_json(spark, sf_dir):
    ds = shop(spark, sf_dir)
    return nest.with_extensions(ds.core, ds, as_json=True, one_page=False).select("occurrenceID", "multimedia", "audiovisual")


@query("point_lookup", f"""{WITH_SHOP} SELECT "occurrenceID", o_orderpriority, (SELECT count(*) FROM media m WHERE m."occurrenceID" = core."occurrenceID") AS n_media FROM core WHERE "occurrenceID" = (SELECT min("occurrenceID") FROM core)""")
def point_lookup(spark, sf_dir):
    ds = shop(spark, sf_dir)
    first = ds.core.agg(F.min("occurrenceID")).first()[0]
    return nest.get(ds, first).select("occurrenceID", "o_orderpriority", F.size("multimedia").cast("bigint").alias("n_media"))


@query("semi_filtered_extension", f"""{WITH_SHOP} SELECT * FROM media WHERE "occurrenceID" IN (SELECT "occurrenceID" FROM core WHERE o_orderstatus = 'F')""")
def semi_filtered_extension(spark, sf_dir):
    ds = shop(spark, sf_dir)
    return nest.semi(ds.extensions["multimedia"].df, ds.core.filter("o_orderstatus = 'F'"), "occurrenceID", "occurrenceID")


@query("group_counts", f"""{WITH_OCC} SELECT "coordinateUncertaintyInMeters" AS value, count(*) AS count, min("occurrenceID") AS first_id FROM occ GROUP BY 1""")
def group_counts(spark, sf_dir):
    return groups.group_counts(occ(spark, sf_dir), "coordinateUncertaintyInMeters")


@query("group_with_photo", f"""{WITH_SHOP}, g AS (SELECT o_orderpriority AS value, count(*) AS count, min("occurrenceID") AS id FROM core GROUP BY 1)
SELECT value, count, coalesce((SELECT min(identifier) FROM media WHERE "occurrenceID" = id), (SELECT min("accessURI") FROM sound WHERE "occurrenceID" = id)) AS photo_url FROM g ORDER BY count DESC, value LIMIT 1000""")
def group_with_photo(spark, sf_dir):
    ds = shop(spark, sf_dir)
    return groups.aggregate_by_field(ds, "o_orderpriority", limit=1000, terms=ds.core.columns)


@query("distinct_on", "SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def distinct_on(spark, sf_dir):
    return groups.distinct_on(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query("top_groups", f"""{WITH_OCC} SELECT "recordedBy" AS value, count(*) AS count FROM occ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def top_groups(spark, sf_dir):
    return groups.top(groups.group_counts(occ(spark, sf_dir), "recordedBy").select("value", "count"), 20)


@query("media_paths", f"{WITH_SHOP} SELECT DISTINCT identifier AS path FROM media UNION SELECT DISTINCT \"accessURI\" FROM sound")
def media_paths(spark, sf_dir):
    return delimited.media_paths(shop(spark, sf_dir))


# --- merges

_OLD, _NEW = "event_id % 10 < 7", "event_id % 10 >= 5"


def _events(spark, sf_dir, new: bool):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return rows.filter(_NEW).withColumn("value", F.col("value") + 1) if new else rows.filter(_OLD)


_MERGED = f"SELECT event_id, event_type, user_id, CASE WHEN {_NEW} THEN value + 1 ELSE value END AS value FROM events"


@query("upsert_rows", _MERGED)
def upsert_rows(spark, sf_dir):
    return merge.upsert(_events(spark, sf_dir, False), _events(spark, sf_dir, True), "event_id")


@query("merge_keep_anti", f"SELECT event_id, event_type, user_id, value FROM events WHERE {_OLD} AND NOT ({_NEW})")
def merge_keep_anti(spark, sf_dir):
    return merge.keep_others(_events(spark, sf_dir, False), _events(spark, sf_dir, True), "event_id")


@query("merge_media", "SELECT 'media/' || event_id AS name, value AS size FROM events WHERE event_id % 10 < 5 UNION ALL SELECT 'media/' || event_id, value + 1 FROM events WHERE event_id % 10 >= 5")
def merge_media(spark, sf_dir):
    media = lambda df: df.select(F.concat(F.lit("media/"), text("event_id")).alias("name"), F.col("value").alias("size"))
    return merge.merge_media(media(_events(spark, sf_dir, False)), media(_events(spark, sf_dir, True)))


_LINES = "l_orderkey, l_linenumber, l_partkey"


@query("replace_groups", f"SELECT {_LINES} FROM lineitem WHERE l_orderkey % 10 < 5 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey + 1 FROM lineitem WHERE l_orderkey % 10 >= 5 AND l_linenumber > 1 UNION ALL SELECT {_LINES} FROM lineitem o WHERE l_orderkey % 10 IN (5, 6) AND NOT EXISTS (SELECT 1 FROM lineitem n WHERE n.l_orderkey = o.l_orderkey AND n.l_linenumber > 1)")
def replace_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return merge.replace_groups(lines.filter("l_orderkey % 10 < 7"), lines.filter("l_orderkey % 10 >= 5 and l_linenumber > 1").withColumn("l_partkey", F.col("l_partkey") + 1), "l_orderkey")


@query("update_archive", f"WITH c AS ({_MERGED}) SELECT 'core' AS part, event_type AS key, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM c GROUP BY 2 UNION ALL SELECT 'media', event_type, count(*), CAST(sum(CASE WHEN event_id % 10 >= 5 THEN 2 ELSE 1 END) AS BIGINT) FROM events GROUP BY 2")
def update_archive(spark, sf_dir):
    def archive(new):
        core = _events(spark, sf_dir, new)
        media = core.select("event_id", "event_type", F.lit(2 if new else 1).alias("version"))
        return OccDataset(core, "event_id", {"multimedia": Ext(media, "event_id")})

    ds = merge.update_archive(archive(False), archive(True))
    core = ds.core.groupBy(F.lit("core").alias("part"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    return core.union(ds.extensions["multimedia"].df.groupBy(F.lit("media"), "event_type").agg(F.count("*"), F.sum("version")))


@query("update_archive_media", """SELECT 'media/' || event_id AS name, value AS size, '2030-01-02' AS pub_date, 'taxon_id=1' AS query, 'old abstract' AS abstract FROM events WHERE event_id % 10 < 5
 UNION ALL SELECT 'media/' || event_id, value + 1, '2030-01-02', 'taxon_id=1', 'old abstract' FROM events WHERE event_id % 10 >= 5""")
def update_archive_media(spark, sf_dir):
    """Media of an updated archive by name, with what its documents then say."""

    def archive(new):
        core = _events(spark, sf_dir, new)
        media = core.select(F.concat(F.lit("media/"), text("event_id")).alias("name"), F.col("value").alias("size"))
        return OccDataset(core, "event_id", {}, media=media, abstract=("new abstract",) if new else ("old abstract",), pub_date="2001-01-01", query="updated_since=x" if new else "taxon_id=1")

    ds = merge.update_archive(archive(False), archive(True), today="2030-01-02")
    return ds.media.select("name", "size", F.lit(ds.pub_date).alias("pub_date"), F.lit(ds.query).alias("query"), F.lit(" ".join(ds.abstract)).alias("abstract"))


@query("high_water_mark", "SELECT strftime(CAST(max(strftime(ts, '%Y-%m-%d')) AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS updated_since FROM events")
def high_water_mark(spark, sf_dir):
    return merge.updated_since(table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at")))


@query("last_wins", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM (SELECT conv_id, turn, max(role) AS role FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def last_wins(spark, sf_dir):
    return merge.last_wins(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("dedup_media", "SELECT kind, id, min(owner) AS owner FROM (SELECT 'photo' AS kind, l_partkey AS id, l_orderkey AS owner FROM lineitem UNION ALL SELECT 'sound', l_suppkey, l_orderkey FROM lineitem) GROUP BY 1, 2")
def dedup_media(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    media = lines.select(F.lit("photo").alias("kind"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("owner")).union(lines.select(F.lit("sound"), "l_suppkey", "l_orderkey"))
    return merge.dedup_media(media)


# --- estimates


@query("media_counts", "SELECT count(*) FILTER (l_linenumber % 2 = 1) AS photos, count(*) FILTER (l_linenumber % 2 = 0 AND l_linestatus <> 'F') AS sounds FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def media_counts(spark, sf_dir):
    return estimate.media_counts(observations(spark, sf_dir))


@query("media_estimate_running", """WITH b AS (SELECT event_type AS download, strftime(ts, '%Y-%m-%d') AS batch, CAST(sum(user_id % 4) AS BIGINT) AS media, count(*) AS observations FROM events GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(media) OVER w AS BIGINT) AS cum_media, CAST(sum(observations) OVER w AS BIGINT) AS cum_observations FROM b WINDOW w AS (PARTITION BY download ORDER BY batch)),
n AS (SELECT *, CAST(round(CAST(cum_media AS DOUBLE) / cum_observations * 100000) AS BIGINT) AS now FROM c)
SELECT download, batch, media, observations, cum_media, cum_observations, max(now) OVER (PARTITION BY download ORDER BY batch) AS estimate FROM n""")
def media_estimate_running(spark, sf_dir):
    batches = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("download"), F.date_format("ts", "yyyy-MM-dd").alias("batch")).agg(F.sum(F.col("user_id") % 4).alias("media"), F.count("*").alias("observations"))
    return estimate.media_estimate(batches, 100_000)


@query("size_estimate", f"""WITH s AS (SELECT o_orderkey AS k FROM orders ORDER BY md5('7:' || CAST(CAST(o_orderkey AS INTEGER) AS VARCHAR)), o_orderkey LIMIT 200),
m AS (SELECT count(*) FILTER (l_linenumber % 2 = 1) AS photos, count(*) FILTER (l_linenumber % 2 = 0 AND l_linestatus <> 'F') AS sounds FROM lineitem JOIN s ON l_orderkey = k)
SELECT CAST(round((SELECT count(*) FROM orders) * (281 * 1.2e0 + CAST(photos AS DOUBLE) / greatest((SELECT count(*) FROM s), 1) * 1800000 + CAST(sounds AS DOUBLE) / greatest((SELECT count(*) FROM s), 1) * 1000000)) AS BIGINT) AS bytes FROM m""")
def size_estimate(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return estimate.size_estimate(obs, obs.count())


@query("retention_plan", """WITH f AS (SELECT lang AS bucket, 'd/' || doc_id AS path, n_chars AS size, doc_id AS mtime FROM documents),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY bucket ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(size) OVER (PARTITION BY bucket) AS total FROM f)
SELECT bucket, path, size, mtime, freed < total - 100000 AS evict FROM s""")
def retention_plan(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket"), F.concat(F.lit("d/"), text("doc_id")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    return estimate.retention_plan(files, 100_000)


# --- stored and delimited tables


def _sparse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("nothing", F.lit(None).cast("string"))


@query("column_fill_counts", "SELECT count(doc_id) AS doc_id, count(nullif(lang, '')) AS lang, count(quality) AS quality, count(toxic) AS toxic, CAST(0 AS BIGINT) AS nothing FROM documents LEFT JOIN labels USING (doc_id)")
def column_fill_counts(spark, sf_dir):
    return delimited.fill_counts(_sparse(spark, sf_dir))


@query("drop_empty", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def drop_empty(spark, sf_dir):
    return delimited.drop_empty(_sparse(spark, sf_dir), "doc_id")


def _csv(df, path, header=True, sep=","):
    df.write.options(**{**exports.CSV, "header": header, "sep": sep}).csv(path)


@query("scan_core", f"{WITH_OCC} SELECT * FROM occ")
def scan_core(spark, sf_dir):
    folder = scratch(spark, "archive")
    _csv(occ_rows(spark, sf_dir), f"{folder}/occurrence.csv")
    manifest = Manifest(folder, Table(["occurrence.csv"], 0, "occurrenceID", [(0, "occurrenceID")], Dialect()))
    return delimited.scan_core(spark, manifest, multi_line=False)


@query("typed_scan", f"{WITH_OCC} SELECT * FROM occ")
def typed_scan(spark, sf_dir):
    rows = occ_rows(spark, sf_dir)
    return delimited.apply_types(rows.select(*[text(c).alias(c) for c in rows.columns]), "occurrenceID", strict=True)


_CUSTOMER = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(text("c_custkey").alias("c_custkey"), "c_name", "c_mktsegment")


@query("union_core_files", _CUSTOMER)
def union_core_files(spark, sf_dir):
    """Three files: with a header, with a reordered one, and without one."""
    rows, folder = _customers(spark, sf_dir), scratch(spark, "files")
    part = lambda k: rows.filter(F.col("c_custkey").cast("bigint") % 3 == k)
    _csv(part(0), f"{folder}/a.csv")
    _csv(part(1).select("c_mktsegment", "c_custkey", "c_name"), f"{folder}/b.csv")
    _csv(part(2), f"{folder}/c.csv", header=False)
    return delimited.read_files(spark, [f"{folder}/{x}.csv" for x in "abc"], Dialect(), multi_line=False)


@query("scan_quoted_breaks", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority || chr(10) || '\"' || o_orderstatus || '\",' || chr(10) AS note, o_orderstatus AS status FROM orders")
def scan_quoted_breaks(spark, sf_dir):
    """A file whose values hold line breaks and quotes, read split by split."""
    folder = scratch(spark, "breaks")
    note = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('",\n'))
    _csv(table(spark, sf_dir, "orders").select(text("o_orderkey").alias("id"), note.alias("note"), F.col("o_orderstatus").alias("status")), f"{folder}/orders.csv")
    return delimited.read_files(spark, [f"{folder}/orders.csv"], Dialect())


@query("dialect_tsv", _CUSTOMER)
def dialect_tsv(spark, sf_dir):
    folder = scratch(spark, "tsv")
    _csv(_customers(spark, sf_dir), f"{folder}/c.tsv", sep="\t")
    return delimited.read_files(spark, [f"{folder}/c.tsv"], Dialect.from_attributes({"fieldsTerminatedBy": "\\t"}))


@query("scan_extension", f"{WITH_SHOP} SELECT * FROM media")
def scan_extension(spark, sf_dir):
    folder = scratch(spark, "archive")
    media = shop(spark, sf_dir).extensions["multimedia"].df.withColumnRenamed("identifier", "photo_url")
    _csv(media, f"{folder}/multimedia.csv")
    ext = Table(["multimedia.csv"], 0, "occurrenceID", [(0, "occurrenceID"), (1, "title"), (2, "identifier")], Dialect())
    return delimited.scan_extensions(spark, Manifest(folder, ext, {"multimedia": ext}), multi_line=False)["multimedia"].df


@query("rename_terms", 'SELECT o_orderkey AS "occurrenceID", o_orderstatus AS status, o_orderpriority FROM orders')
def rename_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return delimited.rename_by_position(rows, [(0, "occurrenceID"), (1, "status"), (2, "occurrenceID")])


@query("roundtrip_parquet", f"{WITH_OCC} SELECT * FROM occ")
def roundtrip_parquet(spark, sf_dir):
    path = scratch(spark, "stored")
    delimited.save(occ(spark, sf_dir), path)
    return delimited.load(spark, path).core


@query("archive_info", f"""{WITH_OCC} SELECT 'events' AS name, count(*) AS core_count, 'occurrenceID' AS core_id_column, 'captive,coordinateUncertaintyInMeters,decimalLatitude,decimalLongitude,eventDate,occurrenceID,recordedBy,scientificName' AS available_columns FROM occ""")
def archive_info(spark, sf_dir):
    return delimited.info(occ(spark, sf_dir)).withColumn("available_columns", F.array_join("available_columns", ","))


@query("catalogue_inventory", """SELECT source AS archive, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, bool_or(doc_id % 4 = 3) AS has_media, bool_or(doc_id % 4 = 1) AS has_multimedia, bool_or(doc_id % 4 = 2) AS has_comments,
 max(CASE WHEN doc_id % 4 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END) AS pub_date FROM documents GROUP BY source""")
def catalogue_inventory(spark, sf_dir):
    """Documents as files of archives: metadata, media tables, comments, media."""
    d = F.col("doc_id")
    name = F.when(d % 4 == 0, "eml.xml").when(d % 4 == 1, "multimedia.csv").when(d % 4 == 2, "comments.csv").otherwise(F.concat(F.lit("media/"), d.cast("string")))
    content = F.when(d % 4 == 0, F.concat(F.lit("<eml><pubDate> 2024-01-"), F.lpad((d % 28 + 1).cast("string"), 2, "0"), F.lit(" </pubDate></eml>")))
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("archive"), name.alias("name"), F.col("n_chars").alias("size"), content.alias("content"))
    return documents.catalogue_of(files).select("archive", "files", "bytes", "has_media", "has_multimedia", "has_comments", "pub_date")


@query("catalogue_written", """SELECT o_orderstatus AS archive, 6 AS files, true AS has_multimedia, true AS has_audiovisual, false AS has_comments, false AS has_media, '2024-05-0' || CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS pub_date,
 'status=' || o_orderstatus AS query, count(*) AS core_rows FROM orders GROUP BY o_orderstatus""")
def catalogue_written(spark, sf_dir):
    """One archive written for each order status, then listed by the catalogue, with the rows of its core as read back."""
    root = scratch(spark, "archives")
    exports.write_archives(shop(spark, sf_dir), "o_orderstatus", {status: {"pub_date": f"2024-05-0{k}", "query": f"status={status}"} for k, status in enumerate("FOP", 1)}, root)
    counts = [spark.read.option("header", True).csv(f"{root}/{status}/occurrence.csv").agg(F.lit(status).alias("archive"), F.count("*").alias("core_rows")).filter("core_rows > 0") for status in "FOP"]
    found = documents.catalogue(spark, root).select("archive", "files", "has_multimedia", "has_audiovisual", "has_comments", "has_media", "pub_date", "query")
    return found.join(counts[0].union(counts[1]).union(counts[2]), "archive")


# --- stores by core id


def _stored(spark, sf_dir):
    path = scratch(spark, "store")
    store.save(shop(spark, sf_dir), path)
    return store.load(spark, path)


_COUNTS = """(SELECT count(*) FROM media m WHERE m."occurrenceID" = core."occurrenceID") AS n_media, (SELECT count(*) FROM sound s WHERE s."occurrenceID" = core."occurrenceID") AS n_sound"""


@query("store_nested", f"""{WITH_SHOP} SELECT "occurrenceID", o_orderstatus, {_COUNTS} FROM core""")
def store_nested(spark, sf_dir):
    """Every order of a stored archive with its extension rows, nested where they lie."""
    return store.nested(_stored(spark, sf_dir)).select("occurrenceID", "o_orderstatus", F.size("multimedia").cast("bigint").alias("n_media"), F.size("audiovisual").cast("bigint").alias("n_sound"))


@query("store_lookup", f"""{WITH_SHOP} SELECT "occurrenceID", o_totalprice, {_COUNTS} FROM core WHERE "occurrenceID" = (SELECT max("occurrenceID") FROM core)""")
def store_lookup(spark, sf_dir):
    """One order of a stored archive by its id."""
    ds = _stored(spark, sf_dir)
    return store.get(ds, ds.core.agg(F.max("occurrenceID")).first()[0]).select("occurrenceID", "o_totalprice", F.size("multimedia").cast("bigint").alias("n_media"), F.size("audiovisual").cast("bigint").alias("n_sound"))


@query("store_semi", f"""{WITH_SHOP} SELECT * FROM sound WHERE "occurrenceID" IN (SELECT "occurrenceID" FROM core WHERE o_orderstatus = 'F')""")
def store_semi(spark, sf_dir):
    """Stored extension rows of the orders that match."""
    ds = _stored(spark, sf_dir)
    return nest.semi(ds.extensions["audiovisual"].df, ds.core.filter("o_orderstatus = 'F'"), "occurrenceID", "occurrenceID")


@query("store_replaced", """SELECT CAST(l_orderkey AS VARCHAR) AS "occurrenceID", CAST(l_linenumber AS VARCHAR) AS title, CASE WHEN l_orderkey % 10 = 0 THEN 'new' ELSE 'm/' || l_partkey END AS identifier FROM lineitem WHERE l_orderkey % 10 <> 0 OR l_linenumber = 1""")
def store_replaced(spark, sf_dir):
    """A stored extension in which every tenth order's rows give way to new ones, or to none."""
    media = _stored(spark, sf_dir).extensions["multimedia"]
    tenth = F.col("occurrenceID").cast("bigint") % 10 == 0
    updates = media.df.filter(tenth & (F.col("title") == "1")).withColumn("identifier", F.lit("new"))
    return store.replaced(media, updates, media.df.filter(tenth).select("occurrenceID"))
