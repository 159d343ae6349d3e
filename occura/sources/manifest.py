"""The manifest of an archive, ``meta.xml``: files, dialects, ids and terms."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from occura import schema


class ManifestError(ValueError):
    """A manifest that can't be read as an archive."""


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    header_lines: int = 1

    @classmethod
    def from_attributes(cls, attributes: dict[str, str]) -> Dialect:
        escapes = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\\\": "\\"}
        delimiter = attributes.get("fieldsTerminatedBy", ",") or ","
        return cls(escapes.get(delimiter, delimiter), attributes.get("fieldsEnclosedBy", '"'), int(attributes.get("ignoreHeaderLines", "1") or 0))

    def options(self, multi_line: bool = True) -> dict:
        quote = self.quote or "\0"
        return {"sep": self.delimiter, "quote": quote, "escape": quote, "multiLine": multi_line, "nullValue": "", "encoding": "UTF-8", "enforceSchema": True}


@dataclass
class Table:
    locations: list[str]
    id_index: int | None
    id_column: str | None
    fields: list[tuple[int, str]]
    dialect: Dialect
    row_type: str = ""


@dataclass
class Manifest:
    folder: str
    core: Table
    extensions: dict[str, Table] = field(default_factory=dict)


def local_name(term: str) -> str:
    """Text after the last slash and after the last hash."""
    return term.rsplit("/", 1)[-1].rsplit("#", 1)[-1]


def _children(node: ET.Element, tag: str) -> list[ET.Element]:
    return [n for n in node if local_name(n.tag.replace("}", "/")) == tag]


def _table(node: ET.Element, key: str) -> Table:
    locations = [(x.text or "").strip() for f in _children(node, "files") for x in _children(f, "location")]
    for name in locations:
        if name.rsplit("/", 1)[-1][:1] in ("_", "."):
            raise ManifestError(f"{name} can't be read: names that begin with _ or . are hidden")
    fields = sorted((int(f.get("index")), local_name(f.get("term", ""))) for f in _children(node, "field") if f.get("index") is not None)
    own = _children(node, key)
    index = int(own[0].get("index", "0")) if own else None
    named = next((t for k, t in fields if k == index), None) if index is not None else None
    return Table([x for x in locations if x], index, named, fields, Dialect.from_attributes(node.attrib), node.get("rowType", ""))


def parse_manifest(text: str, folder: str = "") -> Manifest:
    """The first core with all its files; the extensions of known row types, each with its first file."""
    try:
        root = ET.fromstring(text.lstrip("﻿"))
    except ET.ParseError as e:
        raise ManifestError(str(e)) from e
    cores = _children(root, "core")
    if not cores:
        raise ManifestError("no core")
    core = _table(cores[0], "id")
    if not core.locations:
        raise ManifestError("the core has no location")
    core.id_column = core.id_column or ("id" if core.id_index is not None else "occurrenceID")
    found = {}
    for node in _children(root, "extension"):
        name = schema.EXTENSIONS.get(node.get("rowType", ""))
        if name is None:
            continue
        table = _table(node, "coreid")
        if table.id_index is None:
            raise ManifestError(f"extension {name} has no coreid")
        table.id_column = table.id_column or "coreid"
        table.locations = table.locations[:1]
        found[name] = table
    return Manifest(folder, core, found)


def read_manifest(spark: SparkSession, folder: str) -> Manifest:
    text = spark.read.text(f"{folder}/meta.xml", wholetext=True).first()
    if text is None:
        raise ManifestError("meta.xml is empty")
    return parse_manifest(text[0], folder)
