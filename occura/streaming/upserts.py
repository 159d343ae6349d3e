"""Streaming upserts into log-structured buckets.

A bucket has a base, which holds each of its keys once, and deltas, the later batches' rows.  A batch appends deltas only; a bucket is merged into
a new base when its deltas are many or outweigh its base, and split in two when it has grown.  Which folders
count is said by the committed list, which also holds the number of buckets the table began with.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from occura.operators import merge
from occura.storage import names_in
from occura.streaming import commits

#: Deltas after which a bucket is merged, the least share of the base's rows that they must reach before that many are there, and rows after which it is split.
MOST_DELTAS, DELTA_SHARE, SPLIT_ROWS = 8, 0.5, 4_000_000
#: What a list says of a bucket without rows.
EMPTY: dict = {"base": None, "base_rows": 0, "deltas": [], "delta_rows": 0}


def _leaf(level: int, number: int) -> str:
    return f"l{level}_{number}"


def _place(leaf: str) -> tuple[int, int]:
    level, _, number = leaf[1:].partition("_")
    return int(level), int(number)


def bucket_of(key: str, leaves: Iterable[str], first: int) -> Column:
    """The bucket of a key: at level n its hash falls into one of ``first`` * 2 ** n places, and a place that has been split is looked up at the next level."""
    hashed = F.xxhash64(F.col(f"`{key}`"))
    places = [_place(x) for x in leaves]
    split = {(level, number % (first * 2**level)) for deep, number in places for level in range(deep)}

    def at(level: int) -> Column:
        number = F.pmod(hashed, F.lit(first * 2**level))
        own = F.concat(F.lit(f"l{level}_"), number.cast("string"))
        divided = sorted(n for x, n in split if x == level)
        return F.when(number.isin(divided), at(level + 1)).otherwise(own) if divided else own

    return at(0)


def upsert_stream(updates: DataFrame, key: str, order: str, out: str, checkpoint: str, buckets: int = 64, *, most_deltas: int = MOST_DELTAS, split_rows: int = SPLIT_ROWS) -> StreamingQuery:
    """The latest version of each key within and over batches; late versions lose to newer ones by ``order``.

    The table under ``out`` keeps the number of buckets that it began with; another one raises ValueError.  A batch writes its rows once, as
    deltas, and reads only buckets that are due to be merged.  It is visible when its list is committed; a repeated batch starts from the list
    before it, and folders that neither of the last two lists names are deleted.
    """
    known = commits.last(updates.sparkSession, out)
    if known and known["first"] != buckets:
        raise ValueError(f"the table has {known['first']} buckets, not {buckets}")

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        version, listed = commits.begin(spark, out, checkpoint, batch)
        state: dict[str, dict] = listed["buckets"] if listed else {_leaf(0, n): dict(EMPTY) for n in range(buckets)}
        for b, (folder, n) in _placed(merge.last_wins(rows, key, order), state, f"data/version={version}/delta").items():
            own = state[b]
            state[b] = own | {"deltas": [*own["deltas"], folder], "delta_rows": own["delta_rows"] + n}
        due = [b for b, own in state.items() if len(own["deltas"]) > most_deltas or (len(own["deltas"]) > 1 and own["delta_rows"] > max(DELTA_SHARE * own["base_rows"], split_rows))]
        if due:
            state = _merged(state, due, rows, version)
        commits.commit(spark, out, version, checkpoint, batch, {"first": buckets, "key": key, "order": order, "schema": rows.schema.json(), "buckets": state})
        commits.expire(spark, out, lambda x: [f for own in x.get("buckets", {}).values() for f in folders_of(own)])

    def _placed(rows: DataFrame, state: dict, folder: str) -> dict[str, tuple[str, int]]:
        """The rows written by bucket; folder and number of rows of each that has some."""
        path = f"{out}/{folder}"
        rows.withColumn("_bucket", bucket_of(key, state, buckets)).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        if not any(n.startswith("_bucket=") for n in names_in(rows.sparkSession, path)):
            return {}
        counts = rows.sparkSession.read.parquet(path).groupBy("_bucket").agg(F.count("*").alias("n")).collect()  # no more than there are buckets
        return {r["_bucket"]: (f"{folder}/_bucket={r['_bucket']}", r["n"]) for r in counts}

    def _merged(state: dict, due: list[str], rows: DataFrame, version: int) -> dict:
        """The list with new bases for the buckets that are due; those with more than ``split_rows`` rows are two afterwards."""
        folders = [f"{out}/{f}" for b in due for f in folders_of(state[b])]
        whole = merge.last_wins(rows.sparkSession.read.schema(rows.schema).parquet(*folders), key, order)
        after = {b: own for b, own in state.items() if b not in due}
        for b in due:
            level, number = _place(b)
            large = state[b]["base_rows"] + state[b]["delta_rows"] > split_rows
            after |= {x: dict(EMPTY) for x in ((_leaf(level + 1, number), _leaf(level + 1, number + buckets * 2**level)) if large else (b,))}
        for b, (folder, n) in _placed(whole, after, f"data/version={version}/base").items():
            after[b] = EMPTY | {"base": folder, "base_rows": n}
        return after

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folders_of(own: dict) -> list[str]:
    return [f for f in [own["base"], *own["deltas"]] if f]


def latest_version(spark: SparkSession, out: str) -> DataFrame:
    """The table after the last committed batch: buckets without deltas as they lie, the rows of others merged by key."""
    listed = commits.last(spark, out)
    if listed is None:
        raise LookupError(f"no batch is committed under {out}")
    schema = T.StructType.fromJson(json.loads(listed["schema"]))
    read = lambda folders: spark.read.schema(schema).parquet(*[f"{out}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)
    whole = [folders_of(own) for own in listed["buckets"].values()]
    done = read([f for own in whole for f in own if len(own) == 1])
    return done.unionByName(merge.last_wins(read([f for own in whole for f in own if len(own) > 1]), listed["key"], listed["order"]))
