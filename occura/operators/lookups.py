"""Joins that fetch a key's row for many rows, whatever share of them one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occura.storage import bytes_of, delete, scratch

#: Rows and stored bytes of a table that may be sent to every task.
SMALL_ROWS, SMALL_BYTES = 10_000, 8 << 20
#: A key is frequent if it has one of so many rows; there are at most so many such keys.
FREQUENT = 1_000
#: Column in which a table may say how many rows ask for each of its keys.
TIMES = "_times"


def fetch(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """All rows with the columns that ``table`` has for their key (null where it has none); ``table`` has one row a key, and in TIMES the rows that ask for it.

    The table is computed once, into a scratch folder, which a large one is read from by those who use the result.  One of at most SMALL_ROWS rows and SMALL_BYTES bytes is broadcast.  Of a larger one
    the frequent keys' rows are broadcast, if those are as small, and only rows with other keys are dealt out by their key; rows that need no further
    lookup, null keys among them, are dealt out by the column ``by``.
    """
    spark = rows.sparkSession
    path = scratch(spark, "lookup")
    table.write.parquet(path)
    stored = spark.read.schema(table.schema).parquet(path)
    values = [c for c in table.columns if c not in (key, TIMES)]
    if bytes_of(spark, path) <= SMALL_BYTES and stored.count() <= SMALL_ROWS:
        held = spark.createDataFrame(stored.drop(TIMES).collect(), stored.drop(TIMES).schema)
        delete(spark, path)
        return rows.join(F.broadcast(held), key, "left")
    total = stored.agg(F.sum(TIMES)).first()[0] or 0
    frequent = stored.filter(F.col(TIMES) * FREQUENT > total)
    size = frequent.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*stored.columns)))), F.lit(0))).first()[0]
    own = F.struct(*values).alias("_found")
    held = F.broadcast(frequent.select(key, own)) if size <= SMALL_BYTES else frequent.select(key, own)
    first = rows.join(held, key, "left")
    done = F.col("_found").isNotNull() | F.col(key).isNull()
    dealt = first.withColumns({"_key": F.when(~done, F.col(key)), "_deal": F.when(done, F.xxhash64(F.col(by))).otherwise(F.lit(0))})
    zero = F.pmod(F.xxhash64(key), F.lit(1))  # not a literal: the optimizer would take it out of the join's key, and null keys would all meet
    other = stored.filter(F.col(TIMES) * FREQUENT <= total).select(F.col(key).alias("_key"), zero.alias("_deal"), F.struct(*values).alias("_other"))
    found = dealt.join(other, ["_key", "_deal"], "left").withColumn("_found", F.coalesce("_found", "_other"))
    return found.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])
