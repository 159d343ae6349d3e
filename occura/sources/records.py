"""Records of delimited files whose quoted values hold line breaks, read by as many tasks as the files have splits.

At the start of a line a reader is either between records or inside a quoted value.  Each split is first run from both, which tells what it
turns either state into; taken in order, these give the state in which every split begins.  Each split is then cut into records by itself.  The
record that is open at a split's end is put together with the lines that end it in later splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura.sources.manifest import Dialect


class LineStates:
    """Whether a line ends inside a quoted value, by whether it begins in one."""

    def __init__(self, dialect: Dialect):
        q, d = re.escape(dialect.quote), re.escape(dialect.delimiter)
        quoted = f"{q}(?:[^{q}]|{q}{q})*+"
        field = f"(?:{quoted}{q}(?!{q})(?:(?!{d}).)*+|(?!{q})(?:(?!{d}).)*+)"
        self.open = re.compile(f"(?:{field}{d})*+{quoted}\\Z", re.DOTALL)
        self.rest = re.compile(f"(?:[^{q}]|{q}{q})*+(?P<end>{q}(?:(?!{d}).)*+(?P<more>{d})?)?", re.DOTALL)

    def after(self, line: str, inside: bool) -> bool:
        if not inside:
            return bool(self.open.match(line))
        found = self.rest.match(line)
        if not found["end"]:
            return True
        return bool(found["more"]) and bool(self.open.match(line, found.end()))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, as they lie between line feeds, with the place where their split begins."""
    found = spark.read.text(path, lineSep="\n")
    meta = found.metadataColumn("_metadata")
    return found.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.col("value"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch by split."""
    key = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
    begin = 0
    for k in range(1, len(key) + 1):
        if k == len(key) or key[k] != key[begin]:
            yield *key[begin], batch.slice(begin, k - begin)
            begin = k


@dataclass
class Split:
    """Whether a split begins inside a quoted value; where the record that it begins in began; whether it also ends inside one."""

    inside: bool
    owner: int
    open: bool


def splits(spark: SparkSession, path: str, dialect: Dialect) -> dict[tuple[str, int], Split]:
    """What each split, by file and place, begins and ends in; one small row a split comes to the driver."""
    quote = dialect.quote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = LineStates(dialect)
        ends: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, start, lines in _runs(batch):
                own = ends.setdefault((file, start), [False, True, False])  # from closed, from inside, and whether a line then ended closed
                values = lines.column("value")
                for line in values.filter(pc.match_substring(values, quote)).to_pylist():  # others leave a state as it is
                    own[0], own[1] = states.after(line, own[0]), states.after(line, own[1])
                    own[2] |= not own[1]
        yield _batch([(f, s, *e) for (f, s), e in ends.items()], {"file": pa.string(), "start": pa.int64(), "closed": pa.bool_(), "inside": pa.bool_(), "closes": pa.bool_()})

    found = _lines(spark, path).mapInArrow(run, "file string, start bigint, closed boolean, inside boolean, closes boolean").collect()
    known: dict[tuple[str, int], Split] = {}
    file, state, owner = None, False, 0
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state, owner = r["file"], False, r["start"]
        after = r["inside"] if state else r["closed"]
        known[file, r["start"]] = Split(state, owner, after)
        if not state or r["closes"]:
            owner = r["start"]  # what is open at its end began in it
        state = after
    return known


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


_PIECE = {"file": pa.string(), "start": pa.int64(), "owner": pa.int64(), "first": pa.bool_(), "whole": pa.bool_(), "text": pa.string()}


def records(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """(file, first, text) of every record that isn't empty; ``first`` says whether it is its file's first one."""
    known = splits(spark, path, dialect)
    shared = spark.sparkContext.broadcast(known)
    quote = dialect.quote

    def pieces(whole: bool):
        """The records that lie in one split, or the pieces of those that don't."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states = LineStates(dialect)
            at, split, inside, held, met, carried = None, None, False, [], 0, False

            def piece(done: bool) -> list[tuple]:
                text = "\n".join(held)
                text = text.removesuffix("\r") if done else text
                if not held or (done and not carried) is not whole:
                    return []
                return [(*at, split.owner if carried else at[1], at[1] == 0 and met == 0 and not carried, whole, text)] if text or not whole else []

            for batch in batches:
                found: list[tuple] = []
                for file, start, lines in _runs(batch):
                    if (file, start) != at:
                        found += piece(False)
                        at, split = (file, start), shared.value[file, start]
                        inside, held, met, carried = split.inside, [], 0, split.inside  # carried: what is held began in an earlier split
                    values = lines.column("value")
                    for line, quotes in zip(values.to_pylist(), pc.match_substring(values, quote).to_pylist(), strict=True):
                        held.append(line)
                        inside = states.after(line, inside) if quotes else inside
                        if not inside:
                            found += piece(True)
                            met += bool(carried or len(held) > 1 or held[0].strip("\r"))
                            held, carried = [], False
                yield _batch(found, _PIECE)
            yield _batch(piece(False), _PIECE)

        return run

    schema = "file string, start bigint, owner bigint, first boolean, whole boolean, text string"
    lines = _lines(spark, path)
    done = lines.mapInArrow(pieces(True), schema).select("file", "first", "text")
    edges = [k for k, s in known.items() if s.inside or s.open]
    if not edges:
        return done
    near = spark.createDataFrame(edges, "file string, start bigint")
    broken = lines.join(F.broadcast(near), ["file", "start"], "left_semi").select("file", "start", "value").mapInArrow(pieces(False), schema)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n")
    return done.unionByName(broken.groupBy("file", "owner").agg(F.max("first").alias("first"), joined.alias("text")).select("file", "first", "text"))


def read_records(spark: SparkSession, path: str, dialect: Dialect, names: list[str], header: bool) -> DataFrame:
    """The records as text columns of these names, without the header record."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {k: str(v) for k, v in dialect.options(False).items() if k in ("sep", "quote", "escape", "nullValue")}
    found = records(spark, path, dialect)
    parsed = (found.filter(~F.col("first")) if header else found).select(F.from_csv("text", schema, options).alias("r"))
    return parsed.select(*[F.col("r").getField(n).alias(n) for n in names])
