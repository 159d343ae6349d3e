"""Extension rows under their core rows, semi-joins, and lookups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be held by the driver and sent to every task.
SMALL = 10_000


@dataclass
class Ext:
    df: DataFrame
    core_id: str


@dataclass
class OccDataset:
    """A core table and the extension tables that refer to it by its id; its media files (name and what else is known), and what its documents say."""

    core: DataFrame
    core_id: str
    extensions: dict[str, Ext] = field(default_factory=dict)
    name: str = ""
    media: DataFrame | None = None
    abstract: tuple[str, ...] = ()
    pub_date: str = ""
    query: str = ""


def once(df: DataFrame, rows: int = SMALL) -> tuple[DataFrame, bool]:
    """A table of up to ``rows`` rows computed once and held as local data, and True; a larger one as it is, and False."""
    found = df.limit(rows + 1).collect()
    return (df.sparkSession.createDataFrame(found, df.schema), True) if len(found) <= rows else (df, False)


def small_side(df: DataFrame) -> DataFrame:
    """The side of a join: broadcast where it is proven small, else for a shuffled join."""
    held, small = once(df)
    return F.broadcast(held) if small else df


def nested(ext: Ext, fields: list[str] | None = None) -> DataFrame:
    """(core id, rows): each id's rows as a sorted array of structs."""
    return ext.df.groupBy(F.col(ext.core_id).alias("_core")).agg(F.sort_array(F.collect_list(F.struct(*(fields or ext.df.columns)))).alias("_rows"))


def with_extensions(page: DataFrame, ds: OccDataset, as_json: bool = False, one_page: bool = True) -> DataFrame:
    """``page`` with an array column per extension, empty where it has no rows.

    One page is computed once, and the extensions are cut to its ids first, so only those rows are grouped.
    """
    held = False
    if one_page:
        page, held = once(page)
    for name, ext in ds.extensions.items():
        own = ext
        if one_page:
            ids = page.select(F.col(ds.core_id).alias("_page_id")).distinct()
            own = Ext(ext.df.join(F.broadcast(ids) if held else ids, ext.df[ext.core_id] == ids["_page_id"], "left_semi"), ext.core_id)
        rows = nested(own)
        value = F.coalesce("_rows", F.array().cast(rows.schema["_rows"].dataType))
        value = F.to_json(value, {"ignoreNullFields": "false"}) if as_json else value
        page = page.join(rows, page[ds.core_id] == rows["_core"], "left").withColumn(name, value).drop("_core", "_rows")
    return page


def get(ds: OccDataset, key: str) -> DataFrame:
    """The row with the id, with its extension rows; LookupError if there is none."""
    found, held = once(ds.core.filter(F.col(ds.core_id) == key))
    if held and found.isEmpty():
        raise LookupError(f"no row with {ds.core_id} {key}")
    return with_extensions(found, ds)


def semi(ext: DataFrame, ids: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows of an extension whose key is among the ids; blank and null keys never are."""
    wanted = ids.select(F.col(id_col).alias("_wanted")).filter("trim(_wanted) <> ''").distinct()
    return ext.join(wanted, ext[key] == wanted["_wanted"], "left_semi")
