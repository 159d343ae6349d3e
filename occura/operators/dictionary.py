"""Stored dictionaries of a text column: its distinct values with postings of their trigrams.

Suggestions and substring filters read the dictionary instead of the column.  Of a term's trigrams the rarest name the candidates; the
exact test follows.  Terms without three characters in a row that are no wildcards are tested against the distinct values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occura.operators.nest import small_side
from occura.operators.search import quoted, substring_filter

#: Trigrams of a term that are looked up, the rarest ones.
LOOKED_UP = 3
#: Parts that one trigram's postings are dealt over.
SALTS = 16


def grams(value: Column) -> Column:
    """The distinct trigrams of a lower-cased text; none of a shorter one."""
    none = F.array().cast("array<string>")
    joined = lambda chars, more: F.zip_with(F.slice(chars, 1, F.size(more)), more, lambda a, b: F.concat(a, b))
    after = lambda chars, k: F.slice(chars, k + 1, F.size(chars) - k)
    of = lambda chars: F.when(F.size(chars) >= 3, F.array_distinct(joined(chars, joined(after(chars, 1), after(chars, 2))))).otherwise(none)
    # The lambda binds the characters, which would else be split off again for each of them.
    return F.coalesce(F.transform(F.array(F.split(F.lower(value), "")), of)[0], none)


def term_grams(term: str) -> list[str]:
    """Trigrams that every value holds which holds the term; % and _ are wildcards."""
    parts = [p for p in re.split("[%_]", term) if len(p) >= 3]
    return sorted({p[k : k + 3] for p in parts for k in range(len(p) - 2)})


@dataclass
class Dictionary:
    values: DataFrame
    postings: DataFrame
    counts: DataFrame


def build(df: DataFrame, column: str, path: str) -> None:
    """Store the dictionary of a text column: values by number, postings by trigram, and how many postings a trigram has.  Nulls have no entry."""
    spark = df.sparkSession
    distinct = df.select(quoted(column).alias("value")).filter("value is not null").distinct()
    distinct.repartitionByRange("value").sortWithinPartitions("value").withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{path}/values")
    values = spark.read.parquet(f"{path}/values")
    rows = values.select("number", F.explode(grams(F.col("value"))).alias("gram"))
    # By hash, as ranges would make all trigrams a second time for their bounds; a frequent trigram is dealt over SALTS parts.
    rows.repartition("gram", F.pmod("number", F.lit(SALTS))).sortWithinPartitions("gram", "number").write.option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("times")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def load(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary(*(spark.read.parquet(f"{path}/{n}") for n in ("values", "postings", "counts")))


def values_with(found: Dictionary, term: str) -> DataFrame:
    """(value): the distinct values that hold the term, as the substring filter has it: whatever the case, % and _ as wildcards."""
    spark = found.values.sparkSession
    lowered = spark.range(1).select(F.lower(F.lit(term))).first()[0]  # as the filter lowers it
    wanted = term_grams(lowered)
    test = substring_filter(F.col("value"), term)
    if not wanted:
        return found.values.filter(test).select("value")
    times = {r["gram"]: r["times"] for r in found.counts.filter(F.col("gram").isin(wanted)).collect()}  # a row a trigram of the term
    if len(times) < len(wanted):
        return found.values.filter(F.lit(False)).select("value")
    rarest = sorted(wanted, key=lambda g: (times[g], g))[:LOOKED_UP]
    numbers = found.postings.filter(F.col("gram").isin(rarest)).groupBy("number").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("number")
    return found.values.join(small_side(numbers), "number", "left_semi").filter(test).select("value")


def suggest(found: Dictionary, term: str, limit: int = 50) -> DataFrame:
    """Distinct values that hold the term, sorted: those that ``search.suggest`` finds in the column."""
    return values_with(found, term).orderBy("value").limit(limit)


def containing(df: DataFrame, column: str, found: Dictionary, term: str) -> DataFrame:
    """The rows whose column holds the term, by its values in the dictionary; few values are sent to every task."""
    return df.join(small_side(values_with(found, term).withColumnRenamed("value", "_value")), quoted(column) == F.col("_value"), "left_semi")
