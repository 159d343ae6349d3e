"""Text functions: escapes, tags, names, query strings, and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from occura import schema

#: Text that is a decimal number, which engines agree on.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """Double of a decimal number's text; null for any other text (also ``1d``, ``1_000``, ``nan``)."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def rendered(c: Column) -> Column:
    """A number's text as number text: whole ones below 2^63 as integers, others as doubles; NaN and infinities null; any other text as it is."""
    value = number(c)
    whole = (value == F.floor(value)) & (F.abs(value) < 2.0**63)
    odd = c.rlike(r"(?i)^[+-]?(nan|inf|infinity)$")
    return F.when(odd, None).when(value.isNull(), c).when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def term_name(c: Column) -> Column:
    return F.regexp_extract(c, "([^/#]*)$", 1)


def csv_quote(c: Column) -> Column:
    """A field by RFC 4180: quoted where it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def xml_escape(c: Column, quotes: bool = True) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def norm_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def tag_text(c: Column, tag: str) -> Column:
    """Trimmed texts between a tag's ends, empty ones left out."""
    found = F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def pub_date(c: Column) -> Column:
    value = F.trim(F.regexp_extract(c, "(?s)<pubDate>(.*?)</pubDate>", 1))
    return F.when(value != "", value)


def place_name(c: Column) -> Column:
    """Trimmed ``name`` of a geocoder's JSON, else the first two non-empty parts of ``display_name``."""
    name = F.trim(F.get_json_object(c, "$.name"))
    parts = F.filter(F.transform(F.split(F.get_json_object(c, "$.display_name"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(name != "", name).when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 2), ", "))


def _pairs(query: Column) -> Column:
    """Array of (key, value) of a query string: decoded, split at commas, trimmed, without empty and ``any`` ones."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    bare = [k for k, kind in schema.QUERY_KEYS.items() if kind == "boolean"]
    text = F.regexp_replace(query, r"^\?+", "")

    def one(item: Column) -> Column:
        key = decode(F.substring_index(item, "=", 1))
        raw = decode(F.when(F.instr(item, "=") > 0, F.substr(item, F.instr(item, "=") + 1)).otherwise(""))
        value = F.when((raw == "") & key.isin(*bare), "true").otherwise(raw)
        return F.transform(F.split(value, ","), lambda v: F.struct(key.alias("key"), F.trim(v).alias("value")))

    items = F.flatten(F.transform(F.split(text, "&"), one))
    return F.filter(items, lambda p: (p["value"] != "") & (p["value"] != "any"))


def _typed(own: Column, kind: Column) -> Column:
    """Canonical text of a key's values by its kind, or null."""
    whole = r"^[+-]?[0-9]+$"
    first = F.try_element_at(own, F.lit(1))
    ints = F.filter(F.transform(own, lambda v: F.when(v.rlike(whole), v.try_cast("int"))), lambda v: v.isNotNull())
    return (
        F.when(kind == "texts", F.nullif(F.array_join(own, ","), F.lit("")))
        .when(kind == "ints", F.nullif(F.array_join(ints.cast("array<string>"), ","), F.lit("")))
        .when(kind == "int", F.when(first.rlike(whole), first.try_cast("int")).cast("string"))
        .when(kind == "double", F.regexp_replace(number(first).cast("string"), r"\.0$", ""))
        .when(kind == "boolean", F.when(first.isin("true", "1"), "true").when(first.isin("false", "0"), "false"))
        .otherwise(first)
    )


def _known(query: Column, keys: dict[str, str]) -> Column:
    """Array of (key, name, kind, value) of the keys that the query has a fit value for, in the order of ``keys`` (key → name)."""
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(name).alias("name"), F.lit(schema.QUERY_KEYS[k]).alias("kind")) for k, name in keys.items()])

    def of(pairs: Column) -> Column:
        own = lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k["key"]), lambda p: p["value"])
        return F.transform(known, lambda k: F.struct(k["key"].alias("key"), k["name"].alias("name"), k["kind"].alias("kind"), _once(own(k), lambda v: _typed(v, k["kind"])).alias("value")))

    return F.filter(_once(_pairs(query), of), lambda x: x["value"].isNotNull())


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def query_part(url: Column) -> Column:
    """Text after the first ? of an address, without a fragment; empty if there is none."""
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def canonical_query(query: Column) -> Column:
    """Known keys with typed values, in fixed order."""
    return F.array_join(F.transform(_known(query, {k: k for k in schema.QUERY_KEYS}), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "&")


def criteria_lines(query: Column) -> Column:
    """Lines ``name: value`` of the keys that people are shown."""
    shown = lambda x: F.when(x["kind"].isin("texts", "ints"), F.replace(x["value"], F.lit(","), F.lit(", "))).otherwise(x["value"])
    return F.transform(_known(query, schema.CRITERIA), lambda x: F.concat(x["name"], F.lit(": "), shown(x)))
