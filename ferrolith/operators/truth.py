"""Checks of curated truth records given as JSON: required keys, identifiers by scheme, and the case of licence ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.identifiers import check_digit_ok

# Keys that a truth record has, and forms of identifiers, bare or as addresses.
REQUIRED = [
    "alternate_identifiers", "audiences", "categories", "citations", "dates", "descriptions", "geo_locations", "languages", "media_files",
    "origin_name", "origin_priority", "publishers", "related_identifiers", "resource", "roles", "subjects", "temporal_events", "titles",
]
FORMS = {
    "ISNI": r"^(https?://isni\.org/isni/)?[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{3}[0-9Xx]$",
    "ROR": r"(?i)^(https?://ror\.org/)?0[a-z0-9]{8}/?$",
    "ORCID": r"(?i)^(https?://orcid\.org/)?[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$",
}
# Fixed pattern: a run of so many digits in a scheme's address is an identifier in the wrong field.
LONG_NUMBER = r"[0-9]{6,}"

#: The parts of a truth record that are checked.
CHECKED = (
    "roles array<struct<name_identifiers:array<struct<name_identifier:string,name_identifier_scheme:string,scheme_uri:string>>,"
    "affiliations:array<struct<affiliation_identifier:string,affiliation_identifier_scheme:string,scheme_uri:string>>>>,"
    "publishers array<struct<publisher_identifier:string,publisher_identifier_scheme:string,publisher_scheme_uri:string>>,"
    "rights array<struct<rights_identifier:string>>"
)


def _entries(items: Column, place, value: str, scheme: str, uri: str) -> Column:
    """(location, value, scheme, uri) of each item of an array; none for a null array."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    one = lambda x, i: F.struct(place(i).alias("location"), blank(x[value]).alias("value"), blank(x[scheme]).alias("scheme"), blank(x[uri]).alias("uri"))
    return F.coalesce(F.transform(items, one), F.array())


def _at(prefix: Column | str, name: str):
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    return lambda i: F.concat(start, F.lit(f"{name}["), i.cast("string"), F.lit("]"))


def truth_problems(records: DataFrame, key: str, json: str) -> DataFrame:
    """Rows (key, location, problem, warning) for everything wrong with a record; a text that is no JSON object lacks all keys."""
    parsed = records.select(key, F.col(json).alias("json"), F.from_json(json, CHECKED).alias("t"))
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), keys))

    def of_role(role: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("roles["), i.cast("string"), F.lit("]."))
        names = _entries(role["name_identifiers"], _at(prefix, "name_identifiers"), "name_identifier", "name_identifier_scheme", "scheme_uri")
        return F.concat(names, _entries(role["affiliations"], _at(prefix, "affiliations"), "affiliation_identifier", "affiliation_identifier_scheme", "scheme_uri"))

    given = F.concat(F.coalesce(F.flatten(F.transform("t.roles", of_role)), F.array()), _entries(F.col("t.publishers"), _at("", "publishers"), "publisher_identifier", "publisher_identifier_scheme", "publisher_scheme_uri"))
    named = F.filter(given, lambda e: (e["value"] != "") & (e["scheme"] != ""))

    def problems(e: Column) -> Column:
        form = F.lit(False)
        for scheme, pattern in FORMS.items():
            form = form | ((e["scheme"] == scheme) & ~e["value"].rlike(pattern))
        digits = F.regexp_replace(F.upper(F.regexp_replace(e["value"], r"^https?://isni\.org/isni/", "")), "[^0-9X]", "")
        digit = F.when((e["scheme"] == "ISNI") & ~form & ~check_digit_ok(digits), "check digit of ISNI")
        found = F.array_compact(F.array(F.when(form, F.concat(F.lit("not the form of "), e["scheme"])), digit, F.when(e["uri"].rlike(LONG_NUMBER), "identifier in scheme address")))
        return F.transform(found, lambda p: F.struct(e["location"].alias("location"), p.alias("problem"), F.lit(False).alias("warning")))

    rights = F.coalesce(F.transform("t.rights", lambda r, i: F.struct(_at("", "rights")(i).alias("location"), F.coalesce(r["rights_identifier"], F.lit("")).alias("id"))), F.array())
    cased = F.filter(rights, lambda r: F.upper(r["id"]).startswith("CC") & (r["id"] != F.upper(r["id"])))
    rows = F.concat(
        F.when(F.size(missing) > 0, F.array(F.struct(F.lit("").alias("location"), F.concat(F.lit("missing: "), F.array_join(missing, ", ")).alias("problem"), F.lit(False).alias("warning")))).otherwise(F.array()),
        F.flatten(F.transform(named, problems)),
        F.transform(cased, lambda r: F.struct(r["location"].alias("location"), F.concat(F.lit("case of "), F.upper(r["id"])).alias("problem"), F.lit(True).alias("warning"))),
    )
    return parsed.select(key, F.explode(rows).alias("r")).select(key, "r.location", "r.problem", "r.warning")


def folder_problems(files: DataFrame) -> DataFrame:
    """``truth_problems`` of every file of a folder (path, value, error): a file that is broken or holds no object is a row, not an exception."""
    broken = files.where(F.col("error").isNotNull()).select("path", F.lit("").alias("location"), F.col("error").alias("problem"), F.lit(False).alias("warning"))
    return truth_problems(files.where(F.col("error").isNull()), "path", "value").unionByName(broken)
