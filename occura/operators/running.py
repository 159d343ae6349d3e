"""Running sums over ordered rows that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occura.storage import written


def summed_before(df: DataFrame, value: str, order: list[str], by: list[str], name: str = "before") -> DataFrame:
    """df with the sum of ``value`` over the rows of the same ``by`` that come earlier in ``order``; nulls count as 0, a null in ``by`` is a value.

    Rows are range partitioned by all these columns, so a key, or one value of the first column of ``order``, can lie in many parts.  A part's sums
    start from the sums of the parts before it, a table of one row for each key and part.  Rows that tie in all of ``order`` lie in one part.
    """
    part, base = "_part", "_base"
    placed = written(df.repartitionByRange(*[F.col(c) for c in (*by, *order)]).withColumn(part, F.spark_partition_id()), "running")
    size = F.coalesce(F.col(value), F.lit(0))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, part).agg(F.sum(size).alias("_sum")).withColumn(base, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col(part).alias("_of"), base)
    within = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(part) == F.col("_of")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = placed.withColumn("_inside", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return inside.join(sums, same).select(*df.columns, (F.col(base) + F.col("_inside")).alias(name))
