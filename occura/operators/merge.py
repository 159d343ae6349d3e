"""Merging updates into stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occura.operators.nest import Ext, OccDataset


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last by ``order``, then by all other columns."""
    rest = [c for c in df.columns if c != key]
    by = [*order, *(c for c in rest if c not in order)]
    return df.groupBy(key).agg(F.max(F.struct(*by)).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(df.columns)


def keep_others(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Existing rows whose key has no update."""
    return existing.join(updates.select(key).distinct(), key, "left_anti").select(existing.columns)


def upsert(existing: DataFrame, updates: DataFrame, key: str, *order: str) -> DataFrame:
    """Existing rows with updated ones replaced and new ones added; of repeated keys in the updates the last counts.  Same columns required."""
    if set(existing.columns) != set(updates.columns):
        raise ValueError(f"columns differ: {sorted(set(existing.columns) ^ set(updates.columns))}")
    once = last_wins(updates, key, *order)
    return keep_others(existing, once, key).unionByName(once)


def replace_groups(existing: DataFrame, updates: DataFrame, key: str, replace_all_ids: DataFrame | None = None) -> DataFrame:
    """All old rows of an updated key give way to its new ones.  Keys of ``replace_all_ids`` lose their old rows even without new ones."""
    keys = updates.select(key) if replace_all_ids is None else updates.select(key).union(replace_all_ids.select(key))
    return keep_others(existing, keys, key).unionByName(updates)


def merge_media(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    return keep_others(old, new, name).unionByName(new)


def updated_since(df: DataFrame, column: str = "updated_at") -> DataFrame:
    """One row: the day before the largest non-empty value's date; ValueError if there is none."""
    found = df.agg(F.max(F.nullif(F.col(column), F.lit(""))).alias("latest"))
    if found.first()["latest"] is None:
        raise ValueError(f"{column} has no value")
    return found.select(F.date_sub(F.to_date(F.substring("latest", 1, 10)), 1).cast("string").alias("updated_since"))


def dedup_media(df: DataFrame) -> DataFrame:
    """Photos and sounds once per (kind, id): the smallest row of each."""
    rest = [c for c in df.columns if c not in ("kind", "id")]
    return df.groupBy("kind", "id").agg(F.min(F.struct(*rest)).alias("_m")).select("kind", "id", *[F.col(f"_m.{c}").alias(c) for c in rest])


def update_archive(ds: OccDataset, updates: OccDataset, *order: str, today: str | None = None) -> OccDataset:
    """Core rows upserted, extension groups replaced; extensions that only one side has are taken over.

    Media that the updates have by name give way to theirs.  The abstract and the saved query stay, the date of publication is
    ``today``'s (that of the session if it is not given).
    """
    media = ds.media if updates.media is None else updates.media if ds.media is None else merge_media(ds.media, updates.media)
    today = today or str(ds.core.sparkSession.range(1).select(F.current_date()).first()[0])
    extensions = dict(ds.extensions)
    for name, ext in updates.extensions.items():
        mine = ds.extensions.get(name)
        extensions[name] = Ext(replace_groups(mine.df, ext.df.withColumnRenamed(ext.core_id, mine.core_id), mine.core_id), mine.core_id) if mine else ext
    return OccDataset(upsert(ds.core, updates.core, ds.core_id, *order), ds.core_id, extensions, ds.name, media, ds.abstract, today, ds.query)

