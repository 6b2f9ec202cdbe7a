"""The whole way of a batch: resources and extractors' answers to checked documents, as one plan.

Stages run in a fixed order and each row carries its outcome. A resource that could not be read, or whose extractors
gave nothing, ends with an error; nothing after the merge can fail a row, problems found there are columns beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.web import main_content, resolve_url
from ferrolith.operators.enrichment import enrich
from ferrolith.operators.merging import failure_summary, merge_fields
from ferrolith.operators.storage import settle
from ferrolith.operators.validation import pid_problems
from ferrolith.plans import document
from ferrolith.plans.schema import RECORD
from ferrolith.sources.resources import needs_page

#: Envelope fields, which no extractor may set.
ENVELOPE = ["id", "type", "context", "date_modified", "subject_of"]


def _empty(kind: str) -> Column:
    return F.array().cast(kind) if kind.startswith("array") else F.lit("" if kind == "string" else None).cast(kind)


def records_from_merged(merged: DataFrame, key: str = "resource") -> DataFrame:
    """Rows (key, field, kind, value, items) of ``merge_fields`` as one record for each key; a field of another kind than its column's is left blank.

    Lists become terms, licences, organisations or strings by their names; the identifier is a dict of scheme, value, url.
    """
    at = lambda field, column: F.max(F.when(F.col("field") == field, F.col(column)))
    items = lambda field: F.coalesce(at(field, "items"), F.array().cast("array<struct<key:string,value:string>>"))
    names = lambda field: F.filter(F.transform(items(field), lambda x: x["value"]), lambda x: F.coalesce(x, F.lit("")) != "")
    blank = F.lit("")
    of_dict = lambda field, k: F.coalesce(F.get(F.filter(items(field), lambda x: x["key"] == k), F.lit(0))["value"], blank)
    columns = {}
    for name, kind in RECORD.items():
        if kind == "string":
            columns[name] = F.coalesce(at(name, "value"), blank)
        elif name in ("keywords", "about"):
            columns[name] = F.transform(names(name), lambda x: F.struct(x.alias("name"), blank.alias("scheme"), blank.alias("identifier")))
        elif name == "license":
            columns[name] = F.transform(names(name), lambda x: F.struct(x.alias("name"), blank.alias("url"), blank.alias("identifier")))
        elif name in ("creator", "provider"):
            columns[name] = F.transform(names(name), document.organisation)
        elif name == "publisher":
            columns[name] = document.organisation(at(name, "value"))
        elif name == "identifier":
            columns[name] = F.struct(*[of_dict(name, k).alias(k) for k in ("scheme", "value", "url")])
        elif kind == "array<string>":
            columns[name] = names(name)
        else:
            columns[name] = _empty(kind)
    return merged.groupBy(key).agg(*[c.cast(RECORD[name]).alias(name) for name, c in columns.items()])


def with_pages(resources: DataFrame, pages: DataFrame) -> DataFrame:
    """``parse_resources`` rows with the text of their pages, where a page is wanted: resources with an address, no content yet and no error.

    ``pages`` (url, html) are pages as fetched, one for an address; bare DOIs are looked up under their resolver's address. A page that is not there leaves
    the content as it is.
    """
    wanted = F.col("error").isNull() & needs_page(F.col("fetched_content"), F.col("url"))
    found = pages.select(F.col("url").alias("p_url"), main_content(F.col("html")).alias("p_text"))
    joined = resources.join(found, wanted & (resolve_url(F.col("url")) == F.col("p_url")), "left")
    return joined.withColumn("fetched_content", F.coalesce(F.when(wanted, F.col("p_text")), F.col("fetched_content"))).drop("p_url", "p_text")


def run_batch(
    resources: DataFrame, results: DataFrame, works: DataFrame, organisations: DataFrame, people: DataFrame, today: str, statuses: DataFrame | None = None, allow_partial: bool = True
) -> DataFrame:
    """One row for each of ``resources`` (resource, url, publisher, error): status, error, the record with its envelope, and what checks found.

    ``results`` are extractors' answers as ``merge_fields`` takes them. Status is ``failed`` (with an error; the record's
    columns are null), ``partial`` (some extractors failed) or ``ok``; missing, pid_problems and violations are arrays.
    """
    readable = resources.where(F.col("error").isNull()).select("resource", F.col("url").alias("r_url"), F.col("publisher").alias("r_publisher"))
    summary = failure_summary(results, allow_partial).select(F.col("resource").alias("s_resource"), F.col("status").alias("s_status"), "errors")
    merged = records_from_merged(merge_fields(results, ENVELOPE)).join(readable, "resource", "left_semi")
    records = merged.join(readable, "resource")
    records = document.fill_blanks(records, F.col("r_url"), F.col("r_publisher")).drop("r_url", "r_publisher")
    records = enrich(document.backfill(records, works), organisations, people, "resource")
    whole = settle(document.envelope(records, today, "resource"))
    problems = pid_problems(document.pids_of(whole, "resource"), statuses).where(F.col("problem").isNotNull()).groupBy("resource").agg(F.array_sort(F.collect_list("problem")).alias("pid_problems"))
    broken = document.shape_results(whole, "resource").where(F.col("severity") == "Violation").groupBy("resource").agg(F.array_sort(F.collect_list("shape")).alias("violations"))
    checked = whole.withColumn("missing", document.required_missing()).join(problems, "resource", "left").join(broken, "resource", "left")
    none = F.array().cast("array<string>")
    checked = checked.withColumns({c: F.coalesce(c, none) for c in ("pid_problems", "violations")}).withColumnRenamed("resource", "c_resource")
    rows = resources.select("resource", F.col("error").alias("r_error")).join(summary, F.col("resource") == F.col("s_resource"), "left").join(checked, F.col("resource") == F.col("c_resource"), "left")
    failed = F.col("r_error").isNotNull() | F.col("c_resource").isNull() | (F.col("s_status") == "failed")
    error = F.coalesce(F.concat(F.lit("not read: "), "r_error"), F.when(F.col("s_status") == "failed", F.col("errors")), F.when(F.col("c_resource").isNull(), "no fields"), F.when(F.col("errors") != "", F.col("errors")))
    return rows.select("resource", F.when(failed, "failed").otherwise(F.coalesce("s_status", F.lit("ok"))).alias("status"), error.alias("error"), *[c for c in checked.columns if c != "c_resource"])
