"""Minimax contiguous partition of ordered atomic groups into shards, with DataFrame functions only.

Equal texts are one group and stay together.  Groups are ordered by their digest; a shard is a contiguous run.
The smallest capacity with which greedy filling needs no more than the given number of shards is found by
binary search.  Under that capacity each cut is then made as near to an even share of what is left as the rest allows, so
that one large group doesn't leave shards empty.  All of this only asks for the largest prefix sum up to some value, or the smallest from one on, so the driver works on a
bounded summary, the first and last prefix sum in each of many equal ranges; wherever that leaves the answer open, just
those ranges are summarised more finely, until the capacity and the cuts are exact.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from occura.llm.common import materialize

SHARDS = 40
OVERHEAD = 16
#: Ranges of the first summary, and into how many each open range is cut by the next one.
RANGES, FINER = 16_384, 1_024
#: Rows of one numbering unit: a larger group of equal texts is numbered in parts.
UNIT_ROWS = 20_000


class Summary:
    """What is known of the ascending prefix sums: (low, high) ranges whose ends are prefix sums with none between ranges."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.ranges = sorted(ranges)
        self.lows = [a for a, _ in self.ranges]

    def reach(self, x: int) -> tuple[int, int, tuple[int, int] | None]:
        """Bounds of the largest prefix sum up to x (0 counts as one), and the range that leaves it open, if any."""
        k = bisect.bisect_right(self.lows, x) - 1
        if k < 0:
            return 0, 0, None
        low, high = self.ranges[k]
        return (high, high, None) if x >= high else (low, low, None) if x == low else (low, x, (low, high))

    def above(self, x: int) -> tuple[int, tuple[int, int] | None]:
        """An upper bound of the smallest prefix sum of at least x (0 counts as one), and the range that leaves it open, if any."""
        if x <= 0:
            return 0, None
        k = bisect.bisect_right(self.lows, x) - 1
        if k >= 0 and self.ranges[k][0] == x:
            return x, None
        if k >= 0 and x <= self.ranges[k][1]:
            return self.ranges[k][1], None if x == self.ranges[k][1] else self.ranges[k]
        return self.ranges[k + 1][0], None


def _fill(summary: Summary, capacity: int, total: int, shards: int, side: int) -> tuple[bool, list[int], set]:
    """Greedy filling with the low (0) or high (1) bounds: whether it fits, the cuts, and the open ranges it met."""
    at, cuts, open_ranges = 0, [], set()
    for _ in range(shards):
        found = summary.reach(at + capacity)
        if found[2]:
            open_ranges.add(found[2])
        at = found[side]
        cuts.append(at)
        if at >= total:
            return True, cuts, open_ranges
    return False, cuts, open_ranges


def _least(summary: Summary, total: int, shards: int, side: int) -> int:
    low, high = 0, total
    while low < high:
        middle = (low + high) // 2
        if _fill(summary, middle, total, shards, side)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def _even(summary: Summary, capacity: int, total: int, shards: int) -> tuple[list[int], set]:
    """Cuts near to even shares, none beyond the capacity, and the open ranges met."""
    open_ranges = set()

    def reach(x: int) -> int:
        found = summary.reach(x)
        open_ranges.add(found[2])
        return found[0]

    def above(x: int) -> int:
        found = summary.above(x)
        open_ranges.add(found[1])
        return found[0]

    earliest = [total]  # by shards left: the first prefix sum from which they suffice
    for _ in range(shards - 1):
        earliest.append(above(earliest[-1] - capacity))
    at, cuts = 0, []
    for left in range(shards - 1, 0, -1):
        ideal = at + (total - at) // (left + 1)
        low = reach(ideal)
        high = low if ideal >= total else above(ideal + 1)
        cut = high if low <= at or high - ideal < ideal - low else low
        at = max(at, min(max(cut, earliest[left]), reach(at + capacity)))
        cuts.append(at)
    return [*cuts, total], open_ranges - {None}


def _table(spark: SparkSession, ranges: list[tuple[int, int]], width: int) -> DataFrame:
    """Open ranges as a table: low, high, how wide to cut them (``step``), and the first summary's range they lie in (``first``)."""
    rows = json.dumps([{"low": a, "high": b, "step": (b - a) // FINER + 1, "first": a // width} for a, b in ranges])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(rows), "array<struct<low: bigint, high: bigint, step: bigint, first: bigint>>")))


def minimax_cuts(sums: DataFrame, total: int, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity and the shards' last prefix sums, for the ascending column ``p`` of group ends.

    Each pass brings one row per non-empty range to the driver: RANGES at first, then FINER at most for each open range.
    Of these a pass has some hundreds for 40 shards, more for more shards.  They are joined as a table: as one condition
    they would be nested too deeply for the planner.
    """
    if total == 0:
        return 0, []
    width = max(1, -(-total // RANGES))
    first = F.expr(f"p div {width}").alias("first")

    def summarised(df: DataFrame, *keys: Column) -> list[tuple[int, int]]:
        return [(r["a"], r["b"]) for r in df.groupBy(*keys).agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()]

    summary = Summary(summarised(sums, first))
    while True:
        sure, maybe = _least(summary, total, shards, 0), _least(summary, total, shards, 1)
        open_ranges = _fill(summary, sure, total, shards, 0)[2]
        for capacity in range(maybe, sure + 1, max(1, (sure - maybe) // 64)):
            for side in (0, 1):
                open_ranges |= _fill(summary, capacity, total, shards, side)[2]
        if sure == maybe:
            cuts, met = _even(summary, sure, total, shards)
            if not met:
                return sure, cuts
            open_ranges |= met
        inside = sums.select("p", first).join(F.broadcast(_table(sums.sparkSession, sorted(open_ranges), width)), "first").filter("p BETWEEN low AND high")
        summary = Summary([r for r in summary.ranges if r not in open_ranges] + summarised(inside, F.col("low"), F.expr("(p - low) div step")))


def minimax_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard).

    The size is the text's UTF-8 bytes (null: none) plus ``overhead``.  Rows with equal texts share a shard; all null
    texts are one group, and differ from empty ones.  Within a shard, rows follow the groups' order, then parts of
    large groups, then the id; the order among equal ids is open.  Null ids are rows as any other.  An empty
    table gives no rows.  A large group of equal texts is numbered in parts: by a hash of the id, rows
    with a null id by one of where they were read; only rows that share both a text and an id that isn't null are numbered together.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.when(F.col(text_col).isNull(), F.lit("-")).otherwise(F.md5(text.cast("binary"))).alias("group"))
    n = docs.count()
    parts = max(16, -(-n // UNIT_ROWS))
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id())  # rows without an id are told apart by where they were read
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64(F.col("id").cast("string"), place), F.lit(parts))), "rows")
    units = materialize(rows.groupBy("group", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "units")

    # Prefix sums: inside ranges of the groups' digests, on top of the sums of the ranges before.
    bins = max(64, -(-n // UNIT_ROWS))
    units = units.withColumn("bin", F.pmod(F.conv(F.substring(F.when(F.col("group") == "-", "0").otherwise(F.col("group")), 1, 8), 16, 10).cast("bigint") * bins / F.lit(1 << 32), F.lit(bins)).cast("int"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = units.groupBy("bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).select("bin", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    in_bin = Window.partitionBy("bin").orderBy("group")
    whole_groups = in_bin.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("bin").orderBy("group", "part").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select("group", "part", "bin", F.sum("size").over(whole_groups).alias("size1"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n1"))
    placed = materialize(units.join(base, "bin").select("group", "part", (F.col("size0") + F.col("size1")).alias("p"), (F.col("n0") + F.col("n1")).alias("first")), "placed")

    total = placed.agg(F.max("p").alias("p")).first()["p"] or 0
    _, cuts = minimax_cuts(placed.select("p"), total, shards)
    shard: Column = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (F.col("p") > cut).cast("int")
    placed = placed.withColumn("shard", shard)
    starts = placed.groupBy("shard").agg(F.min("first").alias("shard_first"))  # a row per shard
    placed = placed.join(F.broadcast(starts), "shard").select("group", "part", "shard", (F.col("first") - F.col("shard_first")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("group", "part").orderBy("id")) - 1
    return rows.withColumn("k", number).join(placed, ["group", "part"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("k")).alias("slot"))
