"""Observation and taxon documents, archive catalogues, and metadata documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occura import schema
from occura.functions.text import pub_date, tag_text


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.OBSERVATION).json(path)


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TAXA).json(path)


# File names of the extension tables in unpacked archives.
EXTENSION_FILES = {"multimedia": "multimedia.csv", "audiovisual": "audiovisual.csv", "identifications": "identification.csv", "comments": "comment.csv"}


def catalogue_of(files: DataFrame) -> DataFrame:
    """Files (archive, name, size, content: text of small documents or null) → one row per archive: what it has, its size, date and saved query."""
    has = lambda test: F.max(test.cast("int")) == 1
    flags = [has(F.col("name").isin(n, f"{k}.csv")).alias(f"has_{k}") for k, n in EXTENSION_FILES.items()]
    return files.groupBy("archive").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), has(F.col("name").startswith("media/")).alias("has_media"), *flags,
        F.max(F.when(F.col("name") == "eml.xml", pub_date(F.col("content")))).alias("pub_date"), F.max(F.when(F.col("name").isin("query.json", "source.json"), F.get_json_object("content", "$.query"))).alias("query"),
    )


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue of the unpacked archives below ``root``: names and sizes of all files, contents of the small documents only.

    An archive is a folder of the root.  Its tables and documents are files, or folders of parts as ``write_archive`` writes them.
    """
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    below = F.substring(F.regexp_replace("path", scheme, ""), F.lit(len(re.sub(scheme, "", root).rstrip("/")) + 2), F.length("path"))
    parts = F.split(below, "/")
    name = F.when(parts[1] == "media", F.array_join(F.slice(parts, 2, 1000), "/")).otherwise(parts[1])
    every = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = every().load(root).select(parts[0].alias("archive"), name.alias("name"), F.col("length").alias("size"))  # content is not read
    sizes = listed.filter("name is not null").groupBy("archive", "name").agg(F.sum("size").alias("size"))
    small = every().option("pathGlobFilter", "{eml.xml,query.json,source.json,part-*.txt}").load(root).select(parts[0].alias("archive"), name.alias("name"), F.col("content").cast("string").alias("content"))
    texts = small.filter(F.col("name").isin("eml.xml", "query.json", "source.json")).groupBy("archive", "name").agg(F.max("content").alias("content"))
    return catalogue_of(sizes.join(texts, ["archive", "name"], "left"))


PERSON = "struct<individualName: struct<givenName: string, surName: string>, organizationName: string, electronicMailAddress: string>"
EML = (
    f"dataset struct<title: string, creator: array<{PERSON}>, contact: array<{PERSON}>, pubDate: string, language: string, abstract: struct<para: array<string>>, "
    "keywordSet: array<struct<keyword: array<string>>>, coverage: struct<geographicCoverage: struct<boundingCoordinates: struct<westBoundingCoordinate: double, eastBoundingCoordinate: double, northBoundingCoordinate: double, southBoundingCoordinate: double>>>>, "
    "additionalMetadata array<struct<metadata: string>>"
)


def _people(c: Column) -> Column:
    name = lambda p: F.coalesce(F.nullif(F.concat_ws(" ", p["individualName"]["givenName"], p["individualName"]["surName"]), F.lit("")), p["organizationName"])
    return F.filter(F.transform(c, name), lambda x: x.isNotNull())


def eml_table(docs: DataFrame, key: str = "archive", text: str = "content") -> DataFrame:
    """Metadata documents as columns; a malformed one gives nulls."""
    rows = docs.select(key, F.from_xml(F.regexp_replace(text, r"<(/?)eml:eml\b", "<$1eml"), EML, {"rowTag": "eml"}).alias("e"))
    d = F.col("e.dataset")
    box = d["coverage"]["geographicCoverage"]["boundingCoordinates"]
    paras = F.filter(F.transform(d["abstract"]["para"], lambda p: F.trim(p)), lambda p: p != "")
    keywords = F.flatten(F.transform(d["keywordSet"], lambda s: s["keyword"]))
    return rows.select(
        key, d["title"].alias("title"), _people(d["creator"]).alias("creators"), _people(d["contact"]).alias("contacts"), paras.alias("abstract"), keywords.alias("keywords"), d["language"].alias("language"), F.trim(d["pubDate"]).alias("pub_date"),
        box["westBoundingCoordinate"].alias("west"), box["southBoundingCoordinate"].alias("south"), box["eastBoundingCoordinate"].alias("east"), box["northBoundingCoordinate"].alias("north"), F.transform("e.additionalMetadata", lambda m: m["metadata"]).alias("additional"),
    )


def meta_fields(docs: DataFrame, key: str = "archive", text: str = "content") -> DataFrame:
    """Fields of manifests: one row per archive, table and term, its index, default and vocabulary merged over the term's elements."""
    field = F.regexp_extract_all(F.col("block"), F.lit(r"<field\b([^>]*)>"), F.lit(1))
    value = lambda name: F.nullif(F.regexp_extract("f", rf'\b{name}="([^"]*)"', 1), F.lit(""))
    blocks = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)<(?:core|extension)\b.*?</(?:core|extension)>"), F.lit(0))).alias("block"))
    rows = blocks.select(key, F.regexp_extract("block", r'rowType="([^"]*)"', 1).alias("row_type"), F.explode(field).alias("f"))
    rows = rows.select(key, "row_type", value("term").alias("term"), value("index").try_cast("int").alias("index"), value("default").alias("default"), value("vocabulary").alias("vocabulary"))
    return rows.groupBy(key, "row_type", "term").agg(F.max("index").alias("index"), F.max("default").alias("default"), F.max("vocabulary").alias("vocabulary")).withColumn("name", F.regexp_extract("term", "([^/#]*)$", 1))


def tag_table(docs: DataFrame, key: str, text: str, tag: str) -> DataFrame:
    return docs.select(key, tag_text(F.col(text), tag).alias(tag))

