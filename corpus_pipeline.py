"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.  The
result of each is written as Parquet to the shared folder and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura.llm import decontaminate, jaccard, langid, pieces, quality
from occura.llm.common import broadcast_if_small, free_name, keep_rows, materialize, straight_from_files, table
from occura.llm.queries import QUALITY_THRESHOLD, labelled

#: Files whose names are held by the driver at most.
MOST_FILES = 10_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: drop documents without a language (null, or no letter); those with a letter stay where no language could be learned.

    The decision is on the row: ids may be null or repeated.  An empty table stays empty.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return keep_rows(docs, "text", langid.with_language(docs, model), langid.SLICE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: drop documents scored below the threshold.

    The decision is on the row's text: ids may be null or repeated, and a null text has the score of an empty one.  Without
    labels every score is one half, and all stay.
    """
    model = quality.fit(labelled(docs, table(spark, sf_dir, "labels")))
    return keep_rows(docs, "text", quality.at_least(docs, model, QUALITY_THRESHOLD), 1 << 20)


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a key of their own that stays the same, and the name of its column; ids may repeat or be null.

    Rows of a bare scan of files are known by their file's number and their place in it.  Anything else (a row of a file can then be several
    rows, or lie elsewhere), or a scan of more files than MOST_FILES, is written once with numbers.
    """
    row, file, number = (free_name(docs, x) for x in ("_row", "_file", "_number"))
    if straight_from_files(docs, ("SubqueryAlias",)):
        meta = docs.metadataColumn("_metadata")
        placed = docs.withColumns({file: meta["file_path"], row: meta["row_index"]})
        files = placed.select(file).distinct().limit(MOST_FILES + 1).collect()
        if 0 < len(files) <= MOST_FILES:
            numbers = docs.sparkSession.createDataFrame([(x, k) for k, x in enumerate(sorted(r[0] for r in files))], f"`{file}` string, `{number}` bigint")
            return placed.join(F.broadcast(numbers), file).withColumn(row, F.shiftleft(number, 40) + F.col(row)).select(*[F.col(f"`{c}`") for c in docs.columns], row), row
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8: of each group the row with the smallest id stays, and one without an id only where the group has none; rows without a word stay."""
    rows, key = _numbered(docs, "near_copies_input")
    found = materialize(jaccard.jaccard_components(rows, key, size=5, percent=80).select(F.col(key).alias("row"), "component_id"), "near_copies")
    groups = found.join(broadcast_if_small(found.filter("component_id <> row").select("component_id").distinct()), "component_id", "left_semi").select("row", "component_id")
    groups = materialize(groups, "near_copies_groups")
    placed = rows.select(F.col(key).alias("row"), "doc_id").join(broadcast_if_small(groups), "row").select("component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("place"))
    first = placed.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias("row"))
    dropped = materialize(groups.select("row").join(broadcast_if_small(materialize(first, "near_copies_first")), "row", "left_anti").select(F.col("row").alias(key)), "near_copies_dropped")
    return rows.join(broadcast_if_small(dropped), key, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: drop the rows that hold a passage of the benchmark."""
    rows, key = _numbered(docs, "decontamination_input")
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), key)
    hit = materialize(found.filter("contaminated").select(key), "contaminated")
    return rows.join(broadcast_if_small(hit), key, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: piece ids of each document with the end id, their digest and that of the decoded text."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, segment_bytes=4 << 20).drop("decoded")


STAGES = [("language", language), ("quality", quality_stage), ("near_copies", near_copies), ("decontamination", decontamination), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
