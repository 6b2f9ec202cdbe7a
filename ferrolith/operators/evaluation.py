"""Scores of documents against ground truth: nine measures and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrolith.functions.values import jaccard, recall_or_absent, strip

# Weights of the measures; they add up to 1.
WEIGHTS = {"creators_name": 0.20, "ror_match": 0.15, "subjects": 0.10, "categories": 0.10, "rights": 0.10, "languages": 0.05, "geo_places": 0.10, "media_formats": 0.05, "field_coverage": 0.15}
#: Measures that are set similarities of the columns of the same name.
SETS = ["creators_name", "subjects", "categories", "languages", "geo_places", "media_formats"]


def score_documents(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``pairs`` has for each measure an array column ``t_<measure>`` (truth) and ``a_<measure>`` (actual), ``t_rights``/``a_rights`` strings, ``t_ror_match``, ``t_field_coverage``, ..."""
    scores = {m: jaccard(F.col(f"t_{m}"), F.col(f"a_{m}")) for m in SETS}
    scores["ror_match"] = recall_or_absent(F.col("t_ror_match"), F.col("a_ror_match"))
    scores["rights"] = F.when(F.coalesce("t_rights", F.lit("")) == F.coalesce("a_rights", F.lit("")), 1.0).otherwise(0.0)
    fields = F.col("t_field_coverage")
    scores["field_coverage"] = F.when(F.size(fields) > 0, F.size(F.array_intersect(fields, "a_field_coverage")) / F.nullif(F.size(fields), F.lit(0))).otherwise(0.0)
    named = pairs.select(key, *[c.cast("double").alias(m) for m, c in scores.items()])
    return named.withColumn("overall", sum((F.col(m) * w for m, w in WEIGHTS.items()), F.lit(0.0)))


def rollup(scores: DataFrame, by: str, value: str, threshold: float) -> DataFrame:
    """Mean, least and greatest score by group, failures (null) counted apart, and whether the mean passes."""
    return scores.groupBy(by).agg(F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("failed"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.coalesce(F.avg(value) >= threshold, F.lit(False)).alias("passed"))


def compare_keys(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Similarity by key: 1 or 0 where both have it, 0.0 where only one has."""
    right = b.select(F.col(key).alias("b_key"), F.col(value).alias("b_value"))
    joined = a.select(key, value).join(right, F.col(key) == F.col("b_key"), "full_outer")
    both = F.col(key).isNotNull() & F.col("b_key").isNotNull()
    return joined.select(F.coalesce(key, "b_key").alias(key), F.when(both & F.col(value).eqNullSafe(F.col("b_value")), 1.0).otherwise(0.0).alias("similarity"), F.when(both, "both").when(F.col(key).isNull(), "right").otherwise("left").alias("side"))


# Keys that scoring passes over, and keys of a catalogue's own bookkeeping.
IGNORED_FIELDS = ["schema:dateModified"]
BOOKKEEPING = ["roles", "origin_name", "origin_priority"]

#: A catalogue's ground truth, as far as scores need it.
TRUTH = (
    "struct<roles:array<struct<type:string,role_name:string,contributor_type:string,name_identifiers:array<struct<name_identifier:string,name_identifier_scheme:string>>,"
    "affiliations:array<struct<affiliation_identifier:string,affiliation_identifier_scheme:string>>>>,"
    "publishers:array<struct<publisher_name:string,publisher_identifier:string,publisher_identifier_scheme:string>>,subjects:array<struct<subject_name:string>>,"
    "categories:array<struct<name:string,sub_category:string>>,rights:array<struct<rights_identifier:string>>,languages:array<struct<lang_code:string>>,"
    "geo_locations:array<struct<geo_location_place:string>>,temporal_geo:struct<geo_locations:array<struct<geo_location_place:string>>>,media_files:array<struct<format:string>>,"
    "resource:struct<identifier:string>,titles:array<struct<name:string>>,descriptions:array<struct<description:string,description_type:string>>>"
)


def _norm(c: Column) -> Column:
    return F.lower(strip(c))


def _set(items: Column, value) -> Column:
    """Normalised values of a list's items as a set without blanks; a missing list is empty."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(items, lambda x: _norm(value(x))), lambda s: s.isNotNull() & (s != ""))), F.array().cast("array<string>"))


def adapted_creators(roles: Column) -> Column:
    """Creators and contributors of the roles, as one list; only a contributor keeps its contributor type."""
    wanted = F.filter(roles, lambda r: r["type"].isin("Creator", "Contributor"))
    kind = lambda r: F.when(r["type"] == "Contributor", F.coalesce(r["contributor_type"], F.lit(""))).otherwise("")
    return F.transform(wanted, lambda r: F.struct(F.coalesce(r["role_name"], F.lit("")).alias("creator_name"), kind(r).alias("contributor_type"), r["name_identifiers"].alias("name_identifiers"), r["affiliations"].alias("affiliations")))


def identifier_set(creators: Column, publishers: Column, schemes: list[str]) -> Column:
    """``SCHEME value`` of creators, their affiliations and publishers, for the wanted schemes, values without an address before them."""
    bare = lambda v: F.regexp_replace(_norm(v), r"^https?://[^/]+/", "")
    pair = lambda scheme, value: F.struct(F.upper(strip(scheme)).alias("scheme"), bare(value).alias("value"))
    empty = F.array().cast("array<struct<scheme:string,value:string>>")
    each = lambda items, make: F.flatten(F.transform(creators, lambda c: F.coalesce(F.transform(c[items], make), empty)))
    own = each("name_identifiers", lambda n: pair(n["name_identifier_scheme"], n["name_identifier"]))
    office = each("affiliations", lambda a: pair(a["affiliation_identifier_scheme"], a["affiliation_identifier"]))
    issued = F.transform(publishers, lambda p: pair(p["publisher_identifier_scheme"], p["publisher_identifier"]))
    found = F.concat(*[F.coalesce(x, empty) for x in (own, office, issued)])
    kept = F.filter(found, lambda x: x["scheme"].isin(schemes) & F.coalesce(x["value"] != "", F.lit(False)))
    return F.array_distinct(F.transform(kept, lambda x: F.concat_ws(" ", x["scheme"], x["value"])))


def scoring_sets(t: Column) -> dict[str, Column]:
    """What the measures compare, out of a TRUTH struct."""
    creators = adapted_creators(t["roles"])
    places = F.when(t["temporal_geo"].isNotNull(), t["temporal_geo"]["geo_locations"]).otherwise(t["geo_locations"])
    named = F.filter(t["categories"], lambda c: F.coalesce(strip(c["name"]) != "", F.lit(False)))
    return {
        "creators_name": _set(creators, lambda c: c["creator_name"]),
        "ror_match": identifier_set(creators, t["publishers"], ["ROR"]),
        "subjects": _set(t["subjects"], lambda s: s["subject_name"]),
        "categories": _set(named, lambda c: F.concat(_norm(c["name"]), F.lit("|"), F.coalesce(_norm(c["sub_category"]), F.lit("")))),
        "rights": F.coalesce(F.get(_set(t["rights"], lambda r: r["rights_identifier"]), F.lit(0)), F.lit("")),
        "languages": _set(t["languages"], lambda x: x["lang_code"]),
        "geo_places": _set(places, lambda g: g["geo_location_place"]),
        "media_formats": _set(t["media_files"], lambda m: m["format"]),
    }


def selected_description(descriptions: Column, preferred: str = "Abstract") -> tuple[Column, Column]:
    """The description of the preferred type, else the first one; and whether it is not of that type."""
    liked = F.get(F.filter(descriptions, lambda d: F.coalesce(_norm(d["description_type"]), F.lit("")) == preferred.lower()), F.lit(0))
    text = F.coalesce(liked["description"], F.when(liked.isNull(), F.get(descriptions, F.lit(0))["description"]), F.lit(""))
    return text, liked.isNull()


def minimal_inputs(truth: DataFrame, key: str, t: str) -> DataFrame:
    """What a resource description may tell of its truth: (key, url, title, description, publisher, used_fallback)."""
    text, fallback = selected_description(F.col(t)["descriptions"])
    first = lambda c, name: F.coalesce(F.get(c, F.lit(0))[name], F.lit(""))
    return truth.select(
        key, F.coalesce(F.col(t)["resource"]["identifier"], F.lit("")).alias("url"), first(F.col(t)["titles"], "name").alias("title"),
        text.alias("description"), first(F.col(t)["publishers"], "publisher_name").alias("publisher"), fallback.alias("used_fallback"),
    )


def match_truth(outputs: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Each output (key, output, error) beside its truth: rows without either carry the error, and no score is due for them."""
    t = truth.select(F.col(key).alias("t_key"), "truth")
    joined = outputs.join(t, F.col(key) == F.col("t_key"), "left")
    error = F.when(F.col("t_key").isNull(), "no ground truth").when(F.col("error").isNotNull(), F.col("error")).when(F.col("output").isNull(), "empty output")
    return joined.withColumn("error", error).drop("t_key")


def judged_and_scored(scores: DataFrame, judged: DataFrame, by: str, key: str) -> DataFrame:
    """Structural scores (by, key, overall) and a judge's (by, key, judge) on the inputs that have both, with their difference."""
    j = judged.where(F.col("judge").isNotNull()).select(F.col(by).alias("j_by"), F.col(key).alias("j_key"), "judge")
    both = scores.where(F.col("overall").isNotNull()).join(j, (F.col(by) == F.col("j_by")) & (F.col(key) == F.col("j_key")))
    return both.select(by, key, "overall", "judge", F.abs(F.col("overall") - F.col("judge")).alias("difference"))


def disagreements(both: DataFrame, by: str, key: str, most: int = 5) -> DataFrame:
    """A report of the ``most`` inputs of each model on which scores and judge differ most."""
    order = Window.partitionBy(by).orderBy(F.desc("difference"), F.desc(key))
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def with_titles(results: DataFrame, manifest: DataFrame, key: str, file_name: str, title: str) -> DataFrame:
    """``results`` with the manifest's title of the file, where it has one; of several entries for a file the least title."""
    titles = manifest.groupBy(file_name).agg(F.min(title).alias("title")).withColumnRenamed(file_name, "m_file")
    return results.join(titles, F.col(key) == F.col("m_file"), "left").drop("m_file")


def without_ignored(json: Column, ignored: list[str] = IGNORED_FIELDS) -> Column:
    """A JSON object without the fields that scoring passes over; other JSON and malformed text as it is."""
    fields = F.from_json(json, "map<string,variant>", {"mode": "PERMISSIVE"})
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.to_json(F.map_filter(fields, lambda k, v: ~k.isin(ignored)))).otherwise(json)


def overlap_score(actual: Column, expected: Column) -> Column:
    """A judge's stand-in: of all top-level keys 0.5 for shared ones, 0.3 for extra ones, 0 for missing ones, on average; 0 for malformed text or no keys."""
    a, e = F.json_object_keys(actual), F.json_object_keys(expected)
    total = F.size(F.array_union(a, e))
    score = (0.5 * F.size(F.array_intersect(a, e)) + 0.3 * F.size(F.array_except(a, e))) / F.greatest(total, F.lit(1))
    return F.when(a.isNull() | e.isNull(), 0.0).otherwise(score)


def input_report(inputs: DataFrame, fetched: str = "fetched") -> DataFrame:
    """One row (written, fetch_ok, fetch_failed, fallbacks) over minimal inputs and the pages fetched for them; a blank page is a failure."""
    ok = F.coalesce(strip(F.col(fetched)), F.lit("")) != ""
    return inputs.agg(F.count(F.lit(1)).alias("written"), F.count_if(ok).alias("fetch_ok"), F.count_if(~ok).alias("fetch_failed"), F.count_if("used_fallback").alias("fallbacks"))


def frequencies(rows: DataFrame, value: str) -> DataFrame:
    """How often each value occurs: (value, n)."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
