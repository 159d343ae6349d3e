"""Group counts with a representative row and its photo."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occura.operators.nest import OccDataset
from occura.operators.search import ColumnNotAvailable, SearchSpec, known, matching, quoted


def group_counts(ds: OccDataset, name: str, spec: SearchSpec | None = None, terms: Iterable[str] | None = None) -> DataFrame:
    """(value, count, first_id): rows by the field's value as text, null being one, with the smallest core id."""
    if not known(name, terms):
        raise ColumnNotAvailable(f"{name} is not a known field")
    found = matching(ds.core, spec or SearchSpec(), terms)
    return found.groupBy(quoted(name).cast("string").alias("value")).agg(F.count("*").alias("count"), F.min(quoted(ds.core_id)).alias("first_id"))


def top(groups: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = groups.orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    return ordered if limit is None else ordered.limit(limit)


def first_url(ds: OccDataset, name: str, url: str, ids: DataFrame) -> DataFrame:
    """(first_id, url): of the ids' rows in a media table, the smallest address."""
    ext = ds.extensions[name]
    rows = ext.df.select(F.col(ext.core_id).alias("first_id"), F.col(url).alias(f"{name}_url"))
    return rows.join(ids, "first_id", "left_semi").groupBy("first_id").agg(F.min(f"{name}_url").alias(f"{name}_url"))


def aggregate_by_field(ds: OccDataset, name: str, spec: SearchSpec | None = None, limit: int | None = None, terms: Iterable[str] | None = None) -> DataFrame:
    """(value, count, photo_url) by falling count.  Media are looked up for the groups that are kept only."""
    groups = top(group_counts(ds, name, spec, terms), limit)
    urls = []
    for table, url in (("multimedia", "identifier"), ("audiovisual", "accessURI")):
        if table in ds.extensions:
            groups = groups.join(first_url(ds, table, url, groups.select("first_id")), "first_id", "left")
            urls.append(F.col(f"{table}_url"))
    photo = F.coalesce(*urls) if urls else F.lit(None).cast("string")
    return top(groups.select("value", "count", photo.alias("photo_url")))


def distinct_on(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per value of the key, the smallest by ``order`` and then by all columns; by aggregation, not a window."""
    rest = [c for c in df.columns if c != key]
    first = [*order, *(c for c in rest if c not in order)]
    return df.groupBy(key).agg(F.min(F.struct(*first)).alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])
