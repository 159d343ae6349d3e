"""Lists that make a stream's batches visible: a JSON text for each version, written as a whole when all that it names is there.

A list says which batch of which stream it is of.  A batch that is repeated after a failure gets the version it had and starts from the list before it; a
stream with a new checkpoint goes on after the last version.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from occura.storage import delete, get_text, names_in, put_text


def versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the committed versions, in order."""
    return sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{out}/commits") if n.endswith(".json") and not n.startswith("."))


def _path(out: str, version: int) -> str:
    return f"{out}/commits/{version:012d}.json"


def read(spark: SparkSession, out: str, version: int) -> dict:
    return json.loads(get_text(spark, _path(out, version)) or "{}")


def last(spark: SparkSession, out: str) -> dict | None:
    """The list of the last version; None if there is none."""
    found = versions(spark, out)
    return read(spark, out, found[-1]) if found else None


def begin(spark: SparkSession, out: str, stream: str, batch: int) -> tuple[int, dict | None]:
    """The version that a batch of a stream gets, and the list that it starts from."""
    found = versions(spark, out)
    newest = read(spark, out, found[-1]) if found else None
    if newest is None or (newest["stream"], newest["number"]) != (stream, batch):
        return (found[-1] + 1 if found else 0), newest
    return found[-1], read(spark, out, found[-2]) if len(found) > 1 else None


def commit(spark: SparkSession, out: str, version: int, stream: str, batch: int, listed: dict) -> None:
    put_text(spark, _path(out, version), json.dumps(listed | {"stream": stream, "number": batch}))


def expire(spark: SparkSession, out: str, folders_of, keep: int = 2) -> None:
    """Drop all lists but the last ``keep``, and the folders under ``out`` that only those name; a repeated batch still finds the list before it."""
    found = versions(spark, out)
    old, left = found[:-keep], found[-keep:]
    folders = lambda v: set(folders_of(read(spark, out, v)))
    gone = set().union(*map(folders, old)) - set().union(*map(folders, left)) if old else set()
    for folder in sorted(gone):
        delete(spark, f"{out}/{folder}")
    for v in old:
        delete(spark, _path(out, v))
