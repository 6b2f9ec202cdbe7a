"""Blank values, coalescing, sets and partial dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType

#: All Unicode white space at either end.
EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space at the ends, as Unicode defines it."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(value: Column, kind: DataType | None = None) -> Column:
    """Null, or empty: a string without characters, an array or map without entries."""
    if isinstance(kind, (ArrayType, MapType)):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull() | (value == "") if kind is None or isinstance(kind, StringType) else value.isNull()


def first_filled(*values: Column) -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; two empty ones are alike (1.0). Nulls count as empty."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def recall_or_absent(truth: Column, actual: Column) -> Column:
    """Share of ``truth`` found in ``actual``; with an empty truth 1.0 if nothing was claimed, else 0.0."""
    return F.when(F.size(truth) > 0, F.size(F.array_intersect(truth, actual)) / F.nullif(F.size(F.array_distinct(truth)), F.lit(0))).when(F.size(actual) > 0, 0.0).otherwise(1.0)


def date_from_parts(parts: Column) -> Column:
    """``[y, m, d]`` as a date of the precision that is there; nothing is padded in."""
    return (
        F.when(F.size(parts) >= 3, F.format_string("%04d-%02d-%02d", F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)))
        .when(F.size(parts) == 2, F.format_string("%04d-%02d", F.get(parts, 0), F.get(parts, 1)))
        .when(F.size(parts) == 1, F.format_string("%04d", F.get(parts, 0)))
    )


def year_of(date: Column) -> Column:
    """The four digits a partial date starts with, or an empty string."""
    return F.regexp_extract(date, r"^([0-9]{4})", 1)


def plausible_year(year: Column) -> Column:
    return year.rlike(r"^(19|20)[0-9]{2}$")
