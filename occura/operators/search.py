"""Search over a core table: spec, predicates, projection, sort, pages, suggestions."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occura import schema
from occura.functions import text

_NUMBER = re.compile(text.NUMBER)
CORNERS = ("nelat", "nelng", "swlat", "swlng")


class ColumnNotAvailable(ValueError):
    """A known field that this table doesn't have, or one unfit for the operation."""


def driver_number(value: str | None) -> float | None:
    return float(value) if value is not None and _NUMBER.match(value) else None


@dataclass(frozen=True)
class SearchSpec:
    """Sort, box and filters of a search; every key but the six reserved ones is a filter.

    ``nulls`` names columns that must be null, which no filter text can say.
    """

    filters: dict[str, str] = field(default_factory=dict)
    sort_by: str | None = None
    sort_direction: str = "ASC"
    box: dict[str, str] = field(default_factory=dict)
    nulls: tuple[str, ...] = ()
    wrap: bool = False

    @classmethod
    def from_dict(cls, params: dict[str, str], **more) -> SearchSpec:
        rest = {k: v for k, v in params.items() if k not in (*CORNERS, "sort_by", "sort_direction")}
        return cls(rest, params.get("sort_by"), params.get("sort_direction", "ASC"), {k: params[k] for k in CORNERS if k in params}, **more)

    @classmethod
    def from_query(cls, uri: str) -> SearchSpec:
        """From an address or a query string; of repeated keys the last counts."""
        query = urlsplit(uri).query if "?" in uri else uri
        return cls.from_dict(dict(parse_qsl(query, keep_blank_values=True)))


def known(name: str, terms: Iterable[str] | None) -> bool:
    """Whether a search may name the field: one of ``terms``, or of the fields of occurrence tables."""
    return name in (schema.SEARCH_FIELDS if terms is None else terms)


def ignored_keys(spec: SearchSpec, terms: Iterable[str] | None = None) -> list[str]:
    """Filter keys that name no known field and so have no effect."""
    base = lambda k: re.sub(r"_(min|max|include_blank)$", "", k)
    return sorted(k for k in spec.filters if not (known(k, terms) or known(base(k), terms)))


def _column(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ColumnNotAvailable(f"{name} is not a column of this table")
    return df.schema[name].dataType


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def substring_filter(c: Column, term: str) -> Column:
    """Case-insensitive; % and _ stay wildcards, a backslash is an ordinary character."""
    return c.ilike("%" + term.replace("\\", "\\\\") + "%")


def numeric_prefix_filter(c: Column, term: str) -> Column | None:
    """``3.1`` stands for [3.1, 3.2): as wide as the last digit written."""
    low = driver_number(term)
    if low is None:
        return None
    digits = len(term.partition(".")[2]) if "." in term else 0
    return (c >= F.lit(low)) & (c < F.lit(low + 10.0**-digits))


def date_prefix_filter(c: Column, term: str) -> Column:
    return c.cast("string").like(term + "%")


def _filter(df: DataFrame, name: str, value: str) -> Column | None:
    kind, c = _column(df, name), quoted(name)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)):
        return numeric_prefix_filter(c, value)
    if isinstance(kind, T.BooleanType):
        return c == F.lit(value.lower() == "true") if value.lower() in ("true", "false") else None
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return date_prefix_filter(c, value)
    return substring_filter(c, value)


def range_filter(df: DataFrame, name: str, low: str | None, high: str | None, include_blank: bool = False) -> Column | None:
    """Inclusive bounds on a column's number; without a bound that is a number there is no filter."""
    low, high = driver_number(low), driver_number(high)
    if low is None and high is None:
        return None
    kind = _column(df, name)
    c = quoted(name) if isinstance(kind, T.NumericType) else text.number(quoted(name))
    test = functools.reduce(operator.and_, [c >= F.lit(low)] * (low is not None) + [c <= F.lit(high)] * (high is not None))
    return test | quoted(name).isNull() if include_blank else test


def box_filter(box: dict[str, str], wrap: bool = False, lat: str = "decimalLatitude", lng: str = "decimalLongitude") -> Column | None:
    """Inclusive box of four corners; ``wrap`` lets a box with its west edge east of its east edge cross the date line."""
    corners = [driver_number(box.get(k)) for k in CORNERS]
    if None in corners:
        return None
    north, east, south, west = corners
    across = (F.col(lng) >= west) | (F.col(lng) <= east) if wrap and west > east else (F.col(lng) >= west) & (F.col(lng) <= east)
    return (F.col(lat) >= south) & (F.col(lat) <= north) & across


def predicate(df: DataFrame, spec: SearchSpec, terms: Iterable[str] | None = None) -> Column:
    """Conjunction of all clauses; unknown keys are left out; without clauses true."""
    clauses: list[Column | None] = [box_filter(spec.box, spec.wrap)] if spec.box else []
    ranged: set[str] = set()
    for key, value in spec.filters.items():
        base = re.sub(r"_(min|max|include_blank)$", "", key)
        if base != key and not (key in df.columns) and known(base, terms):
            ranged.add(base)
        elif known(key, terms):
            clauses.append(_filter(df, key, value))
    for base in sorted(ranged):
        clauses.append(range_filter(df, base, spec.filters.get(f"{base}_min"), spec.filters.get(f"{base}_max"), spec.filters.get(f"{base}_include_blank") == "true"))
    clauses += [quoted(n).isNull() for n in spec.nulls]
    return functools.reduce(operator.and_, [c for c in clauses if c is not None], F.lit(True))


def project(df: DataFrame, fields: Iterable[str] | None, terms: Iterable[str] | None = None) -> DataFrame:
    """The known ones of the fields asked for; all columns if none is left."""
    kept = [f for f in fields or () if known(f, terms)]
    for f in kept:
        _column(df, f)
    return df.select(*[quoted(f) for f in kept]) if kept else df


def sort_columns(df: DataFrame, spec: SearchSpec, core_id: str, terms: Iterable[str] | None = None) -> list[Column]:
    """Nulls last both ways, the core id as tiebreak; an unknown column sorts nothing."""
    tie = quoted(core_id).asc_nulls_last()
    by = spec.sort_by
    if by is None or not known(by, terms):
        return [tie]
    _column(df, by)
    c = quoted(by)
    return [c.desc_nulls_last() if spec.sort_direction.upper() == "DESC" else c.asc_nulls_last(), *([tie] if by != core_id else [])]


def matching(df: DataFrame, spec: SearchSpec, terms: Iterable[str] | None = None) -> DataFrame:
    return df.filter(predicate(df, spec, terms))


def page(df: DataFrame, spec: SearchSpec, core_id: str, limit: int, offset: int = 0, fields: Iterable[str] | None = None, terms: Iterable[str] | None = None) -> DataFrame:
    """Rows offset … offset + limit of the sorted matches: a distributed top-k, without a full sort."""
    found = matching(df, spec, terms).orderBy(*sort_columns(df, spec, core_id, terms))
    return project(found.offset(offset).limit(limit) if offset else found.limit(limit), fields, terms)


def search(df: DataFrame, spec: SearchSpec, core_id: str, limit: int, offset: int = 0, fields: Iterable[str] | None = None) -> tuple[int, DataFrame]:
    return matching(df, spec).count(), page(df, spec, core_id, limit, offset, fields)


def page_below(df: DataFrame, key: str, last, n: int = 200) -> DataFrame:
    """Next page in descending order of the key, below the last one seen; deep pages cost what the first one does."""
    return (df if last is None else df.filter(quoted(key) < F.lit(last))).orderBy(quoted(key).desc()).limit(n)


def suggest(df: DataFrame, column: str, term: str, limit: int = 50, terms: Iterable[str] | None = None) -> DataFrame:
    """Distinct values of a text column that hold the term, sorted."""
    if not known(column, terms):
        raise ColumnNotAvailable(f"{column} is not a known field")
    kind = _column(df, column)
    if not isinstance(kind, T.StringType):
        raise ColumnNotAvailable(f"{column} is {kind.simpleString()}, not text")
    return df.select(quoted(column).alias("value")).filter(substring_filter(F.col("value"), term)).distinct().orderBy("value").limit(limit)


def pinned_sort(df: DataFrame, column: str, first: str) -> DataFrame:
    return df.orderBy(F.when(quoted(column) == first, 0).otherwise(1), quoted(column))


def render_values(df: DataFrame) -> DataFrame:
    """Text columns with numbers in their plain form, other types as they are."""
    one: Callable = lambda f: text.rendered(quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name)
    return df.select(*[one(f) for f in df.schema.fields])
