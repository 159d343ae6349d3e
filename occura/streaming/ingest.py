"""Streams of observation pages: ingest and media deduplication, on the batch operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from occura import schema
from occura.operators import observe
from occura.storage import temporary
from occura.streaming import commits


#: Bytes of pages, compressed or not, that a batch begins with at most (one file at least): a batch's observations are kept while its tables are written.
BATCH_BYTES = 512 << 20


def read_stream(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    return spark.readStream.schema(schema.OBSERVATION).option("maxBytesPerTrigger", batch_bytes).json(path)


#: Tables that an ingested batch consists of.
TABLES = ("occurrences", "multimedia", "audiovisual", "identifications", "comments")


def ingest_stream(pages: DataFrame, taxa: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Occurrence and extension tables from arriving pages of observations.

    A batch writes a folder for each of the five tables and then commits a list of them, so its tables appear together or not at all
    (``ingested``).  A repeated batch replaces its folders and its list.
    """

    def each(obs: DataFrame, batch: int) -> None:
        spark = obs.sparkSession
        version, _ = commits.begin(spark, out, checkpoint, batch)
        obs = obs.persist()
        try:
            schemas = {}
            with temporary(spark):
                for name, df in tables_of(obs, taxa).items():
                    df.write.mode("overwrite").parquet(f"{out}/{name}/version={version}")
                    schemas[name] = df.schema.json()
        finally:
            obs.unpersist()
        commits.commit(spark, out, version, checkpoint, batch, {"schemas": schemas})

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tables_of(obs: DataFrame, taxa: DataFrame) -> dict[str, DataFrame]:
    return {"occurrences": observe.to_occurrences(obs, taxa), "multimedia": observe.to_multimedia(obs), "audiovisual": observe.to_audiovisual(obs), "identifications": observe.to_identifications(obs, taxa), "comments": observe.to_comments(obs)}


def ingested(spark: SparkSession, out: str, table: str) -> DataFrame:
    """One of the five tables with all committed batches; LookupError before the first."""
    found = commits.versions(spark, out)
    if not found:
        raise LookupError(f"no batch is committed under {out}")
    schema = T.StructType.fromJson(json.loads(commits.read(spark, out, found[-1])["schemas"][table]))
    return spark.read.schema(schema).parquet(*[f"{out}/{table}/version={v}" for v in found])


def dedup_media_stream(media: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("kind", "id"), delay: str = "1 day") -> DataFrame:
    """Each medium once while its first row is within the delay; state older than that is dropped."""
    return media.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
