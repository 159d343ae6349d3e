"""Delimited tables of an archive as typed DataFrames, and their stored copies."""

from __future__ import annotations

import functools
import json
import warnings
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occura import schema
from occura.functions.text import number
from occura.operators.nest import Ext, OccDataset
from occura.sources.manifest import Dialect, Manifest, Table
from occura.sources.records import read_records


def first_line(spark: SparkSession, path: str, dialect: Dialect) -> list[str]:
    """Values of a file's first record, without a byte-order mark."""
    head = spark.read.options(**dialect.options(multi_line=False)).csv(path).limit(1).collect()
    return [("" if v is None else v).lstrip("﻿") for v in head[0]] if head else []


def line_facts(spark: SparkSession, path: str, dialect: Dialect) -> tuple[bool, bool]:
    """Whether a line of the file has an odd number of quotes, so that a value may go on in the next one, and whether one holds a carriage return before its end; the lines are read in parallel."""
    quote = dialect.options(multi_line=False)["quote"]
    if not dialect.quote:
        return False, False
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    back = F.instr("value", "\r")
    found = spark.read.text(path, lineSep="\n").agg(F.max(quotes % 2 == 1).alias("odd"), F.max((back > 0) & (back < F.length("value"))).alias("back")).first()
    return bool(found["odd"]), bool(found["back"])


def read_files(spark: SparkSession, paths: list[str], dialect: Dialect, multi_line: bool | None = None) -> DataFrame:
    """All files as one table of text columns, named by the first file's header.

    Later files may have the header, a reordered one (then matched by name), or none (matched by position).
    All files are split.  Which of them may have line breaks inside quotes is looked up by a pass over the lines; their records are found split by
    split.  Files with lone carriage returns, and with ``multi_line`` all of them, are read by Spark's multi-line reader, a task each; with ``multi_line=False`` a line is a record.
    """
    names = first_line(spark, paths[0], dialect)
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"repeated column names: {names}")
    parts = []
    for k, path in enumerate(paths):
        head = names if k == 0 else first_line(spark, path, dialect)
        has_header = k == 0 or set(head) == set(names)
        own = head if has_header else names
        odd, back = line_facts(spark, path, dialect) if multi_line is None else (False, False)
        if odd and not back:
            parts.append(read_records(spark, path, dialect, own, has_header).select(*[F.col(f"`{n}`") for n in names]))
            continue
        df = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in own])).options(**dialect.options(odd if multi_line is None else multi_line)).csv(path, header=has_header)
        parts.append(df.select(*[F.col(f"`{n}`") for n in names]))
    return functools.reduce(DataFrame.union, parts)


def apply_types(df: DataFrame, core_id: str, overrides: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """Typed columns for the overrides that the table has; what can't be cast becomes null, or with ``strict`` an error (one pass more)."""
    overrides = schema.TYPE_OVERRIDES if overrides is None else overrides
    if core_id in overrides:
        raise ValueError(f"the core id {core_id} must stay text")
    have = {c: t for c, t in overrides.items() if c in df.columns}
    cast = lambda c, t: number(F.col(f"`{c}`")) if t == "double" else F.col(f"`{c}`").try_cast(t)
    if strict and have:
        failed = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & cast(c, t).isNull()).alias(c) for c, t in have.items()]).first().asDict()
        bad = {c: n for c, n in failed.items() if n}
        if bad:
            raise ValueError(f"values that don't fit their type: {bad}")
    return df.select(*[cast(c, have[c]).alias(c) if c in have else F.col(f"`{c}`") for c in df.columns])


def rename_by_position(df: DataFrame, fields: Iterable[tuple[int, str]]) -> DataFrame:
    """Column at each index gets the declared term, unless a column of that name is there."""
    names = list(df.columns)
    for index, term in fields:
        if index < len(names) and term.lower() not in (n.lower() for n in names):
            names[index] = term
    return df.toDF(*names)


def fill_counts(df: DataFrame) -> DataFrame:
    """One row: values of each column that are neither null nor empty."""
    return df.agg(*[F.count(F.when(F.col(f"`{c}`").cast("string") != "", 1)).alias(c) for c in df.columns])


def drop_empty(df: DataFrame, keep: str) -> DataFrame:
    """Without the columns that hold no value, by one aggregation over all of them."""
    counts = fill_counts(df).first().asDict()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] or c == keep])


def scan_core(spark: SparkSession, manifest: Manifest, *, strict: bool = False, prune: bool = True, rename: bool = False, multi_line: bool | None = None) -> DataFrame:
    table = manifest.core
    df = read_files(spark, [f"{manifest.folder}/{x}" for x in table.locations], table.dialect, multi_line)
    if rename:
        df = rename_by_position(df, table.fields)
    core_id = core_id_of(df, table)
    df = apply_types(df, core_id, strict=strict)
    return drop_empty(df, core_id) if prune else df


def core_id_of(df: DataFrame, table: Table) -> str:
    """The id's column: by the declared name if the file has it, else by its index."""
    return table.id_column if table.id_column in df.columns else df.columns[table.id_index or 0]


def scan_extensions(spark: SparkSession, manifest: Manifest, multi_line: bool | None = None) -> dict[str, Ext]:
    """The extension tables whose files are there, renamed by position to the declared terms."""
    found = {}
    for name, table in manifest.extensions.items():
        try:
            df = read_files(spark, [f"{manifest.folder}/{table.locations[0]}"], table.dialect, multi_line)
        except (AnalysisException, IndexError) as e:
            warnings.warn(f"extension {name} is left out: {e}", stacklevel=2)
            continue
        df = rename_by_position(df, table.fields)
        found[name] = Ext(df, core_id_of(df, table))
    return found


def open_archive(spark: SparkSession, manifest: Manifest, multi_line: bool | None = None, **options) -> OccDataset:
    core = scan_core(spark, manifest, multi_line=multi_line, **options)
    return OccDataset(core, core_id_of(core, manifest.core), scan_extensions(spark, manifest, multi_line), manifest.folder.rstrip("/").rsplit("/", 1)[-1])


def persist(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """Keep what is there already."""
    df.write.mode(mode).parquet(path)


def save(ds: OccDataset, path: str, mode: str = "ignore") -> None:
    """Stored columnar copy; the core lies clustered by coarse map cell and id if it has coordinates, so that boxes skip row groups."""
    core = ds.core
    if {"decimalLatitude", "decimalLongitude"} <= set(core.columns):
        cell = [F.floor(F.col("decimalLatitude") / 5), F.floor(F.col("decimalLongitude") / 5)]
        core = core.repartitionByRange(*cell, F.col(f"`{ds.core_id}`")).sortWithinPartitions(*cell, F.col(f"`{ds.core_id}`"))
    persist(core, f"{path}/core", mode)
    for name, ext in ds.extensions.items():
        persist(ext.df, f"{path}/{name}", mode)
    about = json.dumps({"core_id": ds.core_id, "name": ds.name, "extensions": {n: e.core_id for n, e in ds.extensions.items()}})
    core.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/about")


def load(spark: SparkSession, path: str) -> OccDataset:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return OccDataset(spark.read.parquet(f"{path}/core"), about["core_id"], {n: Ext(spark.read.parquet(f"{path}/{n}"), k) for n, k in about["extensions"].items()}, about["name"])


def info(ds: OccDataset) -> DataFrame:
    """One row: name, core_count, core_id_column, available_columns (sorted)."""
    return ds.core.agg(F.count("*").alias("core_count")).select(F.lit(ds.name).alias("name"), "core_count", F.lit(ds.core_id).alias("core_id_column"), F.array(*[F.lit(c) for c in sorted(ds.core.columns)]).alias("available_columns"))


def media_paths(ds: OccDataset) -> DataFrame:
    """Distinct relative paths of media, with forward slashes."""
    parts = [ds.extensions[n].df.select(F.col(c).alias("path")) for n, c in (("multimedia", "identifier"), ("audiovisual", "accessURI")) if n in ds.extensions]
    rows = functools.reduce(DataFrame.union, parts)
    return rows.filter((F.trim("path") != "") & ~F.col("path").rlike("^https?://")).select(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path")).distinct()
