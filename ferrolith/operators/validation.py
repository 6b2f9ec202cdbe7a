"""Checks of resources, configurations, documents and ground truth, as rows or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.identifiers import pid_format_ok
from ferrolith.functions.values import strip
from ferrolith.sources.resources import walk

# Words that stand for nothing, and the least length of a real abstract.
PLACEHOLDERS = ["todo", "tbd", "n/a", "na", "xxx", "string", "null", "none", "unknown"]
LEAST_ABSTRACT = 30
#: Order of check results, worst last.
SEVERITY = {"PASS": 0, "WARN": 1, "FAIL": 2}


def _filled(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) != ""


def preflight(title: Column, description: Column, url: Column, doi: Column) -> tuple[Column, Column]:
    """Errors and warnings of a resource before it is processed, as arrays."""
    errors = F.array_compact(F.array(F.when(~(_filled(title) | _filled(description) | _filled(url)), "no title, description or url")))
    address = strip(url)
    scheme = F.lower(F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    place = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1)
    warnings = F.array_compact(F.array(
        F.when(_filled(url) & ~scheme.isin("http", "https"), F.concat(F.lit("scheme not http: "), scheme)),
        F.when(_filled(url) & (place == ""), "no network location"),
        F.when(_filled(doi) & ~strip(doi).rlike(r"^(https?://doi\.org/)?10\."), F.concat(F.lit("not a doi: "), strip(doi))),
    ))
    return errors, warnings


def is_placeholder(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit("")))).isin(*PLACEHOLDERS)


def publishable_checks(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Long rows (doc_id, check, status) for the columns name, creators, dates, year, kind, abstract, keywords of ``docs``."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    year = F.coalesce(F.col("year"), F.lit(""))
    checks = {
        "name": F.when(blank("name") | is_placeholder(F.col("name")), "FAIL").otherwise("PASS"),
        "creators": F.when(F.coalesce(F.col("creators"), F.lit(0)) > 0, "PASS").otherwise("FAIL"),
        "dates": F.when(F.coalesce(F.col("dates"), F.lit(0)) > 0, "PASS").otherwise("WARN"),
        "year": F.when(year.rlike("^(19|20)[0-9]{2}$"), "PASS").when(year == "", "WARN").otherwise("FAIL"),
        "kind": F.when(blank("kind"), "WARN").otherwise("PASS"),
        "abstract": F.when(blank("abstract") | (F.length(strip(F.col("abstract"))) < LEAST_ABSTRACT), "FAIL").when(F.lower(strip(F.col("abstract"))) == F.lower(strip(F.col("name"))), "WARN").otherwise("PASS"),
        "keywords": F.when(F.coalesce(F.col("keywords"), F.lit(0)) > 0, "PASS").otherwise("WARN"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()]))
    return docs.select(doc_id, rows.alias("row")).select(doc_id, "row.check", "row.status")


def worst_status(checks: DataFrame, by: str, status: str = "status") -> DataFrame:
    """The worst status of each group."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return checks.groupBy(by).agg(F.max_by(status, rank[F.col(status)]).alias("worst"))


def pid_problems(pids: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Check rows (scheme, value, location): format first, resolution only where the format holds and ``statuses`` (value, resolved) knows."""
    known = pids.where(F.col("scheme").isin("DOI", "ROR", "ISNI", "ORCID")).withColumn("format_ok", pid_format_ok(F.col("scheme"), F.col("value")))
    if statuses is None:
        joined = known.withColumn("resolved", F.lit(None).cast("boolean"))
    else:
        s = statuses.select(F.col("value").alias("s_value"), F.col("resolved").alias("s_resolved"))
        joined = known.join(s, F.col("value") == F.col("s_value"), "left").withColumn("resolved", F.when(F.col("format_ok"), F.col("s_resolved"))).drop("s_value", "s_resolved")
    problem = F.when(~F.col("format_ok"), F.concat(F.lit("malformed "), "scheme", F.lit(" at "), "location")).when(~F.col("resolved"), F.concat("scheme", F.lit(" does not resolve at "), "location"))
    return joined.withColumn("problem", problem)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose reference names nothing."""
    return rows.join(known.select(F.col(known_key).alias("known_key")).distinct(), F.col(key) == F.col("known_key"), "left_anti")


def disagreeing(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Values that names disagree on: a row for each pair of different values of a key, with the least name of each.

    Pairs are of values, not of names: a hot key with few values makes few rows. Membership is in ``rows`` itself.
    """
    groups = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(name).alias("n"), F.count(F.lit(1)).alias("names"))
    a = groups.select(F.col(key), F.col(value).alias("value_a"), F.col("n").alias("name_a"), F.col("names").alias("names_a"))
    b = groups.select(F.col(key), F.col(value).alias("value_b"), F.col("n").alias("name_b"), F.col("names").alias("names_b"))
    return a.join(b, key).where(F.col("value_a") < F.col("value_b"))


def keys_outside(json: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON object that are not allowed."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def key_differences(json: Column, declared: list[str], disallowed: list[str] = ()) -> Column:
    """Of a JSON object's top-level keys: those that are missing, those that are not declared, and those that must not be there."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    wanted, banned = F.array(*map(F.lit, declared)), F.array(*map(F.lit, disallowed)).cast("array<string>")
    parts = {"missing": F.array_except(wanted, keys), "extra": F.array_except(keys, wanted), "disallowed": F.array_intersect(keys, banned)}
    return F.struct(*[F.array_sort(c).alias(n) for n, c in parts.items()])


def populated_fields(json: Column) -> Column:
    """Top-level keys of a JSON object that hold something: null, an empty list and an empty object are nothing, an empty text is something."""
    held = F.from_json(json, "map<string,variant>")
    return F.array_sort(F.map_keys(F.map_filter(held, lambda k, v: v.isNotNull() & ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("VOID", "OBJECT<>", "ARRAY<VOID>") | (F.try_variant_get(v, "$[0]", "variant").isNotNull()))))


def leaks(docs: DataFrame, key: str, json: str, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """Top-level keys outside ``allowed`` and ``forbidden`` keys at any depth: (key, name, path), each place once."""
    inside = walk(docs, key, json).where(F.col("name").isNotNull())
    top = ~F.contains("path", F.lit(".")) & ~F.contains("path", F.lit("[")) & ~F.col("name").isin(allowed)
    return inside.where(top | F.col("name").isin(forbidden)).select(key, "name", "path")


def retryable(status: Column, kind: Column) -> Column:
    """Whether a failed call is worth another: never for validation, always for rate limits, transport and server failures."""
    return F.when(kind == "validation", False).when(kind == "transport", True).otherwise(F.coalesce(status.isin(429, 500, 502, 503, 504), F.lit(False)))


def merge_warning(gaps: dict[str, Column]) -> Column:
    """Warning that names the required fields that are missing or empty after merging; null for none."""
    missing = F.concat_ws(", ", *[F.when(F.coalesce(gap, F.lit(True)), F.lit(name)) for name, gap in gaps.items()])
    return F.when(missing != "", F.concat(F.lit("missing required fields: "), missing))
