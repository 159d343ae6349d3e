"""Exports: CSV, group counts, KML placemarks, and archive directories."""

from __future__ import annotations

import functools
import json
import re
import uuid
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occura import schema
from occura.functions.text import xml_escape
from occura.operators.groups import group_counts, top
from occura.operators.nest import Ext, OccDataset, semi
from occura.operators.search import SearchSpec, matching, quoted, render_values, sort_columns
from occura.storage import delete, join_parts, move, names_in, put_text, scratch

#: CSV by RFC 4180.
CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv_rows(ds: OccDataset, spec: SearchSpec | None = None) -> DataFrame:
    """All columns of the matching rows, values in their plain form, null as empty text."""
    shown = render_values(matching(ds.core, spec or SearchSpec()))
    return shown.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(c) for c in shown.columns])


def _header(columns: list[str]) -> str:
    """The first line of a CSV file."""
    return ",".join('"' + c.replace('"', '""') + '"' if re.search('[",\n\r]', c) else c for c in columns) + "\n"


def _one_csv(rows: DataFrame, path: str) -> None:
    """One file with one header, the rows in their order: numbered parts, joined by the file system."""
    parts = scratch(rows.sparkSession, "csv-parts")
    rows.write.options(**{**CSV, "header": False}).csv(parts)
    join_parts(rows.sparkSession, parts, path, head=_header(rows.columns))


def export_csv(ds: OccDataset, spec: SearchSpec | None, path: str) -> None:
    """The matching rows as one CSV file, in the order that the search asks for."""
    spec = spec or SearchSpec()
    _one_csv(csv_rows(OccDataset(ordered(ds, spec), ds.core_id)), path)


def ordered(ds: OccDataset, spec: SearchSpec) -> DataFrame:
    """The matching rows in the search's order: by range, so that the parts of an export follow each other; as they come if it names no order."""
    found = matching(ds.core, spec)
    return found.orderBy(*sort_columns(ds.core, spec, ds.core_id)) if spec.sort_by else found


def group_rows(ds: OccDataset, name: str, spec: SearchSpec | None = None) -> DataFrame:
    return top(group_counts(ds, name, spec)).select(F.coalesce("value", F.lit("")).alias(name), F.col("count").alias("occurrence_count"))


def export_groups_csv(ds: OccDataset, name: str, spec: SearchSpec | None, path: str) -> None:
    _one_csv(group_rows(ds, name, spec), path)


def placemarks(ds: OccDataset, spec: SearchSpec | None = None) -> DataFrame:
    """One placemark's text per row that has both coordinates; data of non-empty columns sorted by name."""
    rows = matching(ds.core, spec or SearchSpec()).filter("decimalLatitude is not null and decimalLongitude is not null")
    name = F.coalesce(F.nullif(F.col("scientificName"), F.lit("")), quoted(ds.core_id)) if "scientificName" in rows.columns else quoted(ds.core_id)
    scalar = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]

    def data(c: str) -> Column:
        value = quoted(c).cast("string")
        return F.when(value != "", F.concat(F.lit(f'<Data name="{escape(c)}"><value>'), xml_escape(value), F.lit("</value></Data>")))

    details = F.array_join(F.filter(F.array(*[data(c) for c in sorted(scalar)]), lambda x: x.isNotNull()), "")
    where = F.concat(quoted("decimalLongitude").cast("string"), F.lit(","), quoted("decimalLatitude").cast("string"), F.lit(",0"))
    return rows.select(quoted(ds.core_id).alias("core_id"), F.concat(F.lit("<Placemark><name>"), xml_escape(name), F.lit("</name><ExtendedData>"), details, F.lit("</ExtendedData><Point><coordinates>"), where, F.lit("</coordinates></Point></Placemark>")).alias("value"))


def export_kml(ds: OccDataset, spec: SearchSpec | None, path: str) -> None:
    """One KML document with a placemark a line, in the order that the search asks for."""
    # The document's head and foot.
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n'
    foot = "</Document></kml>\n"
    spec, spark = spec or SearchSpec(), ds.core.sparkSession
    parts = scratch(spark, "kml-parts")
    placemarks(OccDataset(ordered(ds, spec), ds.core_id)).select(F.regexp_replace("value", "[\n\r]", "&#10;").alias("value")).write.text(parts)
    join_parts(spark, parts, path, head=head, foot=foot)


def plain_double(c: Column) -> Column:
    """A double's text without exponent or trailing zeros, exact to 15 decimals."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,15)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def written_fields(df: DataFrame, fields: list[str], *more: str) -> DataFrame:
    """The fields in order as text, '' for null and for columns that the table lacks; more columns behind them as they are."""

    def one(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        text = plain_double(quoted(name)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else quoted(name).cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return df.select(*[one(f) for f in fields], *more)


# The frames of ``meta.xml`` and ``eml.xml``, and how their tables are delimited.
def meta_xml(extensions: list[str], own_terms: str = schema.OWN_TERMS) -> str:
    by_name = {v: k for k, v in schema.EXTENSIONS.items()}

    def block(tag: str, row_type: str, file: str, key: str, fields: list[str], ext: str | None) -> str:
        terms = "".join(f'    <field index="{k}" term="{schema.term_uri(f, ext, own_terms)}"/>\n' for k, f in enumerate(fields))
        return f'  <{tag} encoding="UTF-8" fieldsTerminatedBy="," linesTerminatedBy="\\n" fieldsEnclosedBy="&quot;" ignoreHeaderLines="1" rowType="{row_type}">\n    <files><location>{file}</location></files>\n    <{key} index="0"/>\n{terms}  </{tag}>\n'

    body = block("core", schema.DWC + "Occurrence", "occurrence.csv", "id", schema.OCCURRENCE_FIELDS, None)
    body += "".join(block("extension", by_name[e], f"{e}.csv", "coreid", schema.EXTENSION_FIELDS[e], e) for e in extensions)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<archive xmlns="http://rs.tdwg.org/dwc/text/" metadata="eml.xml">\n{body}</archive>\n'


def eml_xml(title: str, abstract: list[str], pub_date: str) -> str:
    paras = "".join(f"<para>{escape(a)}</para>" for a in abstract)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<eml:eml xmlns:eml="eml://ecoinformatics.org/eml-2.1.1"><dataset><title>{escape(title)}</title><pubDate>{pub_date}</pubDate><abstract>{paras}</abstract></dataset></eml:eml>\n'


def write_archive(ds: OccDataset, path: str, extensions: list[str] | None = None, *, title: str = "", abstract: list[str] | None = None, pub_date: str | None = None, query: str | None = None, one_file: bool = False) -> None:
    """An unpacked archive: a directory of parts per table, ``meta.xml``, ``eml.xml`` and the saved query; enabled extensions without rows have a header.

    With ``one_file`` each table is one file with one header, as other readers of archives expect it; its parts are joined by the file system.
    Abstract, date and query are those of the dataset where they are not given.
    """
    write = _one_csv if one_file else lambda rows, where: rows.write.options(**CSV).csv(where)
    abstract, pub_date, query = ds.abstract if abstract is None else abstract, ds.pub_date if pub_date is None else pub_date, ds.query if query is None else query
    spark, names = ds.core.sparkSession, extensions if extensions is not None else list(ds.extensions)
    core = written_fields(ds.core.withColumnRenamed(ds.core_id, "occurrenceID"), schema.OCCURRENCE_FIELDS)
    write(core, f"{path}/occurrence.csv")
    for name in names:
        fields = schema.EXTENSION_FIELDS[name]
        ext = ds.extensions.get(name) or Ext(spark.createDataFrame([], ", ".join(f"`{f}` string" for f in fields)), "occurrenceID")
        rows = written_fields(ext.df.withColumnRenamed(ext.core_id, "occurrenceID"), fields)
        write(rows if name in ds.extensions else rows.coalesce(1), f"{path}/{name}.csv")
    _put_documents(spark, path, names, title, list(abstract), pub_date, query)


def _put_documents(spark: SparkSession, path: str, names: list[str], title: str, abstract: list[str], pub_date: str, query: str) -> None:
    put_text(spark, f"{path}/meta.xml", meta_xml(names))
    put_text(spark, f"{path}/eml.xml", eml_xml(title, abstract, pub_date))
    put_text(spark, f"{path}/query.json", json.dumps({"query": query}))


#: Files that a task writes at once; rows of more archives are sorted by archive first.
WRITERS = 64


def write_archives(ds: OccDataset, by: str, archives: dict[str, dict], root: str) -> None:
    """For each of these values of a core column an archive ``{root}/{value}``, as ``write_archive`` writes one: the value's core rows, and of every extension the rows that refer to one of them.

    Every table is read, joined and written once for all archives.  ``archives`` has each value's title, abstract, pub_date and query; those not given are the dataset's.
    """
    spark, paths = ds.core.sparkSession, [f"{root}/{v}" for v in archives]
    if any(not v or "/" in v or v[0] in "._" for v in archives):
        raise ValueError("an archive's value must do as the name of a folder")
    if set(archives) & set(names_in(spark, root)):
        raise FileExistsError(f"an archive lies in {root} already")
    number = functools.reduce(lambda c, v: c.when(quoted(by) == F.lit(v[1]), v[0]), enumerate(archives), F)
    core = ds.core.withColumn("_archive", number).filter("_archive is not null")
    _split_csv(written_fields(core.withColumnRenamed(ds.core_id, "occurrenceID"), schema.OCCURRENCE_FIELDS, "_archive"), [f"{p}/occurrence.csv" for p in paths], root)
    wanted = core.select(quoted(ds.core_id).alias("_wanted"), "_archive").filter("trim(_wanted) <> ''").repartition("_wanted").distinct()  # dealt by id alone, as the join needs it
    for name, ext in ds.extensions.items():
        rows = ext.df.join(wanted, ext.df[ext.core_id] == wanted["_wanted"]).withColumnRenamed(ext.core_id, "occurrenceID")
        _split_csv(written_fields(rows, schema.EXTENSION_FIELDS[name], "_archive"), [f"{p}/{name}.csv" for p in paths], root)
    for path, about in zip(paths, archives.values(), strict=True):
        told = {"title": "", "abstract": ds.abstract, "pub_date": ds.pub_date, "query": ds.query} | about
        _put_documents(spark, path, list(ds.extensions), told["title"], list(told["abstract"]), told["pub_date"], told["query"])


def _split_csv(rows: DataFrame, paths: list[str], root: str) -> None:
    """Rows to the path of their number, each a directory of parts with headers; one without rows has a header."""
    spark, parts, key = rows.sparkSession, f"{root}/_parts-{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(WRITERS))  # else all rows are sorted by archive, and spilled
    try:
        rows.write.options(**CSV).partitionBy("_archive").csv(parts)
    finally:
        spark.conf.set(key, before)
    for k, path in enumerate(paths):
        if not move(spark, f"{parts}/_archive={k}", path):
            rows.drop("_archive").limit(0).coalesce(1).write.options(**CSV).csv(path)
    delete(spark, parts)


def filtered_archive(ds: OccDataset, spec: SearchSpec) -> OccDataset:
    """The matching core rows, and of every extension the rows that refer to one of them."""
    core = matching(ds.core, spec)
    return OccDataset(core, ds.core_id, {n: Ext(semi(e.df, core, e.core_id, ds.core_id), e.core_id) for n, e in ds.extensions.items()}, ds.name)


def export_archive(ds: OccDataset, spec: SearchSpec, path: str, one_file: bool = False) -> None:
    write_archive(filtered_archive(ds, spec), path, one_file=one_file)
