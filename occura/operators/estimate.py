"""Counts and estimates of media and sizes, and a retention plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from occura.functions.scalars import visible
from occura.operators.nest import small_side
from occura.operators.running import summed_before


def _media() -> list[Column]:
    count = lambda c: F.coalesce(F.sum(F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).cast("bigint")), F.lit(0))
    return [count(F.col("photos")).alias("photos"), count(visible(F.col("sounds"))).alias("sounds")]


def media_counts(obs: DataFrame) -> DataFrame:
    """One row: photos, and sounds that are not hidden."""
    return obs.agg(*_media())


def media_estimate(batches: DataFrame, total: int, key: str = "download", order: str = "batch") -> DataFrame:
    """Running estimate of all media of each download from (media, observations) so far; it never falls."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a batch: a download has few
    rows = batches.withColumn("cum_media", F.sum("media").over(so_far)).withColumn("cum_observations", F.sum("observations").over(so_far))
    now = F.when(F.col("cum_observations") > 0, F.round(F.col("cum_media") / F.col("cum_observations") * F.lit(total))).otherwise(0).cast("bigint")
    return rows.withColumn("_now", now).withColumn("estimate", F.max("_now").over(so_far)).drop("_now")


def page_estimate(obs: DataFrame, total: int) -> DataFrame:
    """Estimate from one page: its density of photos for all observations, less a tenth."""
    return obs.agg(*_media(), F.count("*").alias("n")).select(F.round(F.col("photos") / F.col("n") * total * 0.9).cast("bigint").alias("estimate"))


def size_estimate(obs: DataFrame, observations: int, *, multimedia: bool = True, identifications: bool = True, comments: bool = True, photos: bool = True, sounds: bool = True, sample: int = 200, seed: int = 7) -> DataFrame:
    """Bytes of an export, from the density of media in a sample: rows ordered by a seeded checksum of their id."""
    # Bytes of a record and its extensions, margin, bytes of a photo and of a sound.
    record, media, idents, comment, margin, photo, sound = 79, 16, 146, 40, 1.2, 1_800_000, 1_000_000
    chosen = obs.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), "id").limit(sample)
    each = record + media * multimedia + idents * identifications + comment * comments
    counts = chosen.agg(*_media(), F.count("*").alias("n"))
    per = lambda c: F.col(c) / F.greatest(F.col("n"), F.lit(1))
    return counts.select(F.round(F.lit(observations) * (F.lit(each * margin) + per("photos") * photo * int(photos) + per("sounds") * sound * int(sounds))).cast("bigint").alias("bytes"))


def retention_plan(files: DataFrame, limit_bytes: int, bucket: str = "bucket") -> DataFrame:
    """Files (path, size, mtime and a bucket) with ``evict``: the oldest of each bucket until it is within the limit.

    A file goes if what goes before it frees less than the excess; of one time, paths go in order.  Neither a bucket nor the files of one time are
    sorted in one task.  A null bucket is one, a null size is 0, and files without a time go first.
    """
    totals = files.groupBy(F.col(bucket).alias("_bucket")).agg(F.sum(F.coalesce("size", F.lit(0))).alias("_total"))
    rows = summed_before(files, "size", ["mtime", "path"], [bucket], "_freed")
    return rows.join(small_side(totals), rows[bucket].eqNullSafe(F.col("_bucket"))).select(*files.columns, (F.col("_freed") < F.col("_total") - limit_bytes).alias("evict"))
