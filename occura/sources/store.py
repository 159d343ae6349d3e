"""Stored archives whose tables lie together by core id.

The core and every extension are bucketed by the core id with the same number of buckets and sorted by it, and the id has a Parquet bloom
filter.  Spark then nests, semi-joins and replaces by id without moving the stored rows, and a lookup reads the id's bucket only, and of
that the row groups whose filter may hold the id.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occura.operators.nest import Ext, OccDataset
from occura.storage import get_text, names_in, put_text

#: Rows of a bucket that a store is laid out for, and buckets at least and at most.
BUCKET_ROWS, LEAST, MOST = 2_000_000, 8, 20_000
#: Bytes of a row group: what a lookup reads at least where the filters let it.
ROW_GROUP_BYTES = 32 << 20


def buckets_for(rows: int) -> int:
    """A power of two, so that stores of unlike size still divide evenly."""
    n = LEAST
    while n < MOST and rows > n * BUCKET_ROWS:
        n *= 2
    return n


def _name() -> str:
    return f"occura_{uuid.uuid4().hex}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _write(df: DataFrame, path: str, key: str, buckets: int, row_group_bytes: int) -> None:
    """One table, bucketed: each bucket is written by one task, as one sorted file, so that readers need not sort."""
    name = _name()
    placed = df.repartition(buckets, F.col(_quoted(key))).sortWithinPartitions(F.col(_quoted(key)))
    options = {"path": path, f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(row_group_bytes)}
    placed.write.options(**options).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay where they are


def save(ds: OccDataset, path: str, buckets: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Store an archive by core id.  It is there when its description is; a store that is there already is an error.

    ``buckets`` follows from the number of core rows unless it is given.  Ids are stored as text.  All rows of an id are in one bucket, null ids
    in another as one id.
    """
    spark = ds.core.sparkSession
    if get_text(spark, f"{path}/about.json") is not None:
        raise FileExistsError(path)
    buckets = buckets or buckets_for(ds.core.count())
    tables = {"core": (ds.core, ds.core_id)} | {f"ext-{n}": (e.df, e.core_id) for n, e in ds.extensions.items()}
    about = {"name": ds.name, "buckets": buckets, "tables": {}}
    for name, (df, key) in tables.items():
        df = df.withColumn(key, F.col(_quoted(key)).cast("string")).select([F.col(_quoted(c)) for c in df.columns])
        _write(df, f"{path}/{name}", key, buckets, row_group_bytes)
        about["tables"][name] = {"key": key, "schema": df.schema.json()}
    put_text(spark, f"{path}/about.json", json.dumps(about))


def _declared(spark: SparkSession, path: str, table: dict, buckets: int) -> DataFrame:
    """The stored table as Spark's catalogue knows bucketed ones: declared under a name of its own, which goes when the table is resolved."""
    schema, key, name = T.StructType.fromJson(json.loads(table["schema"])), _quoted(table["key"]), _name()
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{where}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external one: its files stay
    return found


def load(spark: SparkSession, path: str) -> OccDataset:
    """The stored archive; LookupError if there is none."""
    text = get_text(spark, f"{path}/about.json")
    if text is None:
        raise LookupError(f"no store under {path}: {names_in(spark, path)}")
    about = json.loads(text)
    read = {n: _declared(spark, f"{path}/{n}", t, about["buckets"]) for n, t in about["tables"].items()}
    keys = {n: t["key"] for n, t in about["tables"].items()}
    return OccDataset(read["core"], keys["core"], {n.removeprefix("ext-"): Ext(df, keys[n]) for n, df in read.items() if n != "core"}, about["name"])


def nested(ds: OccDataset, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """The whole core with an array column per extension, empty where it has no rows; over a store no row leaves its bucket."""
    found = ds.core
    for name, ext in ds.extensions.items():
        columns = (fields or {}).get(name) or ext.df.columns
        rows = ext.df.groupBy(F.col(_quoted(ext.core_id)).alias("_core")).agg(F.sort_array(F.collect_list(F.struct(*[F.col(_quoted(c)) for c in columns]))).alias(name))
        empty: Column = F.array().cast(rows.schema[name].dataType)
        found = found.join(rows, found[_quoted(ds.core_id)] == rows["_core"], "left").drop("_core").withColumn(name, F.coalesce(F.col(_quoted(name)), empty))
    return found


def get(ds: OccDataset, key: str) -> DataFrame:
    """The row with the id, with its extension rows as arrays; LookupError if there is none.  Every table is filtered by the id itself, so only its bucket is read."""
    one = lambda df, column: df.filter(F.col(_quoted(column)) == F.lit(str(key)))
    if one(ds.core, ds.core_id).isEmpty():
        raise LookupError(f"no row with {ds.core_id} {key}")
    return nested(OccDataset(one(ds.core, ds.core_id), ds.core_id, {n: Ext(one(e.df, e.core_id), e.core_id) for n, e in ds.extensions.items()}, ds.name))


def replaced(ext: Ext, updates: DataFrame, replace_all_ids: DataFrame | None = None) -> DataFrame:
    """The extension with all rows of an updated id replaced by its new ones; ids of ``replace_all_ids`` lose their rows even without new ones.  Only the updates are moved."""
    key = _quoted(ext.core_id)
    ids = updates.select(F.col(key).cast("string").alias("_id"))
    ids = ids if replace_all_ids is None else ids.union(replace_all_ids.select(F.col(key).cast("string")))
    kept = ext.df.hint("shuffle_merge").join(ids.distinct(), ext.df[key] == F.col("_id"), "left_anti")
    return kept.unionByName(updates.select([F.col(_quoted(c)).cast(ext.df.schema[c].dataType).alias(c) for c in ext.df.columns]))
