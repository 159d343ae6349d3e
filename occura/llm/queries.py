"""The registered queries of the training-data operators: thin digests over the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura.llm import castore, decontaminate, jaccard, langid, lattice, oracle, pieces, prefixes, quality, repetition, setsketch, sharding, vectors, warc
from occura.llm.common import broadcast_if_small, crc_mod, table

QUALITY_THRESHOLD = 0.3


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rule(table(spark, sf_dir, "documents")).drop("longest_repeat", "n_maximal_repeats")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("intact")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(labelled(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Texts with labels to learn from, without the held-out fold; of many labels, those with the smallest hashes of their ids are joined."""
    known = labels.select("doc_id", label).filter(F.col(label).isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0)).distinct()
    pick = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 11)
    n = known.count()
    if n > 2 * quality.SAMPLE_ROWS:
        known = known.filter(pick < int(2 * quality.SAMPLE_ROWS / n * (1 << 53)))
    return docs.select("doc_id", "text").join(broadcast_if_small(known), "doc_id")


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), held_out)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    return langid.predict(docs, langid.fit(docs.filter(~held_out)), "doc_id", "text", held_out)


def op8_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.minimax_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_castore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = castore.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    castore.check_manifest(spark, path)
    return castore.read_digests(spark, path)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repetition, op2_warc, op3_quality, op4_lattice, op5_jaccard, op6_decontaminate, op7_language, op8_minimax, op9_castore, op10_pieces, op11_prefixes, op12_vectors, op13_setsketch)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
