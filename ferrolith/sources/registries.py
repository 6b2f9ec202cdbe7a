"""Registry dumps and answers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.identifiers import ror_country, ror_display_name, ror_isni, ror_parent


def organisations(dump: DataFrame) -> DataFrame:
    """Registry entries (id, names, external_ids, locations, relationships) as (entry_id, name, isni, country, parent_id, parent_name)."""
    parent = ror_parent(F.col("relationships"))
    return dump.select(F.col("id").alias("entry_id"), ror_display_name(F.col("names")).alias("name"), ror_isni(F.col("external_ids")).alias("isni"), ror_country(F.col("locations")).alias("country"), parent["id"].alias("parent_id"), parent["label"].alias("parent_name"))


def chosen_hits(hits: DataFrame) -> DataFrame:
    """Of affiliation hits (query, chosen, organization) those the registry itself chose."""
    return hits.where(F.coalesce("chosen", F.lit(False)))


def isni_records(answers: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, isni, name, kind) of each record in an answer; an answer that is no XML gives none."""
    local = lambda name: F.xpath(F.col(xml), F.lit(f"//*[local-name()='record']//*[local-name()='{name}'][1]/text()"))
    well_formed = answers.where(F.col(xml).rlike(r"(?s)^\s*<.*>\s*$"))
    rows = well_formed.select(key, F.explode(F.arrays_zip(local("isniUnformatted").alias("isni"), local("mainName").alias("name"), local("organisationType").alias("kind"))).alias("r"))
    return rows.select(key, "r.isni", "r.name", "r.kind", F.concat(F.lit("https://isni.org/isni/"), "r.isni").alias("uri"))


#: A registry of media types: registries within it, each with records of a name, files and references.
REGISTRY = (
    "registry array<struct<_id:string,record:array<struct<name:string,file:array<struct<_type:string,_VALUE:string>>,"
    "xref:array<struct<_type:string,_data:string,_VALUE:string>>>>>>"
)


def _reference(x: Column) -> Column:
    """What a cross-reference reads like, by its type."""
    kind, data, text = x["_type"], F.coalesce(x["_data"], F.lit("")), F.coalesce(F.trim(x["_VALUE"]), F.lit(""))
    rfc = F.when(F.upper(data).startswith("RFC"), F.upper(data)).otherwise(F.concat(F.lit("RFC "), F.substring(data, 4, 1000)))
    return (
        F.when(kind == "rfc", rfc).when(kind == "person", F.replace(data, F.lit("_"), F.lit(" "))).when(kind == "draft", F.replace(data, F.lit("RFC-"), F.lit("")))
        .when(kind == "rfc-errata", F.concat(F.lit("RFC Errata "), data)).when(kind == "registry", F.concat(F.lit("Registry: "), data)).otherwise(F.when(text != "", text).otherwise(data))
    )


def registry_records(texts: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, registry, name, template, reference) out of a registry's XML; a record without a template has its registry and name for one, and
    one without a name is no record. A text that is no XML gives none."""
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "rowTag": "registry"}
    parsed = texts.select(key, F.explode(F.from_xml(F.col(xml), REGISTRY, options)["registry"]).alias("r")).select(key, F.coalesce("r._id", F.lit("unknown")).alias("registry"), F.explode("r.record").alias("x"))
    name = F.trim("x.name")
    template = F.trim(F.get(F.filter("x.file", lambda f: f["_type"] == "template"), 0)["_VALUE"])
    rows = parsed.where(F.coalesce(name, F.lit("")) != "")
    whole = F.coalesce(F.nullif(template, F.lit("")), F.concat("registry", F.lit("/"), name))
    return rows.select(key, "registry", name.alias("name"), whole.alias("template"), F.coalesce(F.array_join(F.transform("x.xref", _reference), "; "), F.lit("")).alias("reference"))


def unambiguous_names(templates: DataFrame) -> DataFrame:
    """(short, template): what stands behind the slash, in lower case, where one template alone has it."""
    distinct = templates.where(F.contains("template", F.lit("/"))).select("template").distinct()
    short = F.lower(F.substring(F.col("template"), F.locate("/", F.col("template")) + 1, F.lit(1000)))
    return distinct.groupBy(short.alias("short")).agg(F.count(F.lit(1)).alias("n"), F.min("template").alias("template")).where("n = 1").drop("n")


def media_types(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates, and the short names that belong to one template only, from rows (name, template)."""
    templates = rows.select(F.lower("template").alias("template_key"), "template", "name").dropDuplicates(["template_key"])
    short = rows.groupBy(F.lower("name").alias("short")).agg(F.count(F.lit(1)).alias("n"), F.min("template").alias("template")).where(F.col("n") == 1).select("short", "template")
    return templates, short


def normalized_media_type(files: DataFrame, format: str, templates: DataFrame, short: DataFrame) -> DataFrame:
    """``files`` with ``media_type``: the template of its format, else of its short name, else the format as it is."""
    wanted = F.lower(F.trim(F.col(format)))
    joined = files.join(templates.select("template_key", F.col("template").alias("exact")), wanted == F.col("template_key"), "left").join(short.select("short", F.col("template").alias("by_name")), wanted == F.col("short"), "left")
    return joined.withColumn("media_type", F.coalesce("exact", "by_name", F.col(format))).drop("template_key", "exact", "short", "by_name")


def fresh_or_bundled(cached: DataFrame, bundled: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Rows of a snapshot (last_updated, ...) that is younger than ``days``, else those bundled."""
    young = cached.where(F.col("last_updated") > now - F.make_dt_interval(F.lit(days)))
    none = young.groupBy().agg(F.count(F.lit(1)).alias("young")).where(F.col("young") == 0).select("young")
    return young.unionByName(bundled.join(none).drop("young"))
