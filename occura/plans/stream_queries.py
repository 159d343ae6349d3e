"""Streams over the test tables, run to the end of what is there; the oracle is the batch result."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occura.plans.base import observations, query, scratch, table, taxa, write_pages
from occura.streaming import ingest, upserts


@query("stream_ingest", """WITH lines AS (SELECT lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'occurrences' AS part, count(*) AS n FROM orders UNION ALL SELECT 'multimedia', count(*) FILTER (l_linenumber % 2 = 1 OR l_linestatus <> 'F') FROM lines UNION ALL SELECT 'audiovisual', count(*) FILTER (l_linenumber % 2 = 1) FROM lines
UNION ALL SELECT 'identifications', count(*) FILTER (l_linenumber % 2 = 1) FROM lines UNION ALL SELECT 'comments', count(*) FILTER (l_linenumber % 2 = 0 AND l_returnflag <> 'R') FROM lines""")
def stream_ingest(spark, sf_dir):
    path = scratch(spark, "ingest")
    write_pages(observations(spark, sf_dir), f"{path}/pages")
    ingest.ingest_stream(ingest.read_stream(spark, f"{path}/pages"), taxa(spark, sf_dir), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    parts = [ingest.ingested(spark, f"{path}/out", n).agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n in ingest.TABLES]
    return functools.reduce(DataFrame.union, parts)


@query("stream_upsert", "SELECT event_id % 1000 AS key, max(event_id) AS latest, count(DISTINCT event_id % 1000) AS n FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    path = scratch(spark, "upsert")
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("key"), F.col("event_id").alias("latest"))
    events.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    upserts.upsert_stream(stream, "key", "latest", f"{path}/out", f"{path}/checkpoint", buckets=16).awaitTermination()
    return upserts.latest_version(spark, f"{path}/out").groupBy("key").agg(F.max("latest").alias("latest"), F.count("*").alias("n"))


@query("stream_dedup", "SELECT kind, id FROM (SELECT 'photo' AS kind, l_partkey AS id FROM lineitem UNION SELECT 'sound', l_suppkey FROM lineitem)")
def stream_dedup(spark, sf_dir):
    path = scratch(spark, "dedup")
    lines = table(spark, sf_dir, "lineitem")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    media = lines.select(F.lit("photo").alias("kind"), F.col("l_partkey").alias("id"), at.alias("ts")).union(lines.select(F.lit("sound"), "l_suppkey", at))
    media.write.parquet(f"{path}/in")
    stream = ingest.dedup_media_stream(spark.readStream.schema(media.schema).parquet(f"{path}/in"))
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("kind", "id")
