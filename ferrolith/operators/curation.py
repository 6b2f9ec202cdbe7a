"""Curation of organisation identifiers: overrides as a table, what is left to curate, and the files people work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrolith.functions.names import normalize_org
from ferrolith.functions.values import first_filled, strip


def load_overrides(entries: DataFrame, order: str) -> DataFrame:
    """Entries (name, country, ror_id, isni_id) as overrides (name_key, country, name, ror_id, isni_id): nameless ones and those without
    an identifier are skipped, and of one name and country the last in ``order`` counts."""
    country = F.nullif(F.upper(strip(F.col("country"))), F.lit(""))
    rows = entries.select(
        normalize_org(F.col("name")).alias("name_key"), country.alias("country"), "name",
        first_filled(F.col("ror_id")).alias("ror_id"), first_filled(F.col("isni_id")).alias("isni_id"), F.col(order).alias("at"),
    )
    valid = rows.where((F.coalesce("name_key", F.lit("")) != "") & (F.col("ror_id").isNotNull() | F.col("isni_id").isNotNull()))
    last = Window.partitionBy("name_key", "country").orderBy(F.desc("at"))
    return valid.withColumn("n", F.row_number().over(last)).where(F.col("n") == 1).drop("n", "at")


def needs_curation(identifiers: Column) -> Column:
    """Whether none of an organisation's identifiers is of the registry's own scheme."""
    return ~F.exists(F.coalesce(identifiers, F.array().cast("array<struct<scheme:string,value:string>>")), lambda x: F.coalesce(x["scheme"] == "ROR", F.lit(False)))


def curation_counts(entries: DataFrame) -> DataFrame:
    """One row (confident, review, nothing) over entries with ror_candidate and ror_alternatives."""
    sure = F.col("ror_candidate").isNotNull()
    some = F.coalesce(F.size("ror_alternatives") > 0, F.lit(False))
    return entries.agg(F.count_if(sure).alias("confident"), F.count_if(~sure & some).alias("review"), F.count_if(~sure & ~some).alias("nothing"))


def write_review_csv(entries: DataFrame, path: str) -> None:
    """The review table as CSV with a header; the first name carries a byte order mark, so that spreadsheets read it as UTF-8."""
    first, *rest = entries.columns
    entries.select(F.col(first).alias("﻿" + first), *rest).write.csv(path, header=True, mode="overwrite")


def write_overrides_yaml(overrides: DataFrame, path: str) -> None:
    """Overrides as text files of YAML list items below one ``overrides:`` line each; strings are quoted as JSON, which YAML reads."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", "")
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {'- ' if c == 'name' else '  '}{c}: "), quoted(c))) for c in ("name", "country", "ror_id", "isni_id")]
    item = F.concat_ws("\n", *lines)
    head = overrides.sparkSession.createDataFrame([("overrides:", 0)], "value string, at int")
    rows = head.unionByName(overrides.select(item.alias("value"), F.lit(1).alias("at")))
    rows.coalesce(1).sortWithinPartitions("at", "value").select("value").write.mode("overwrite").text(path)


def organisation_entries(mentions: DataFrame, name: str, file: str, identifier: str) -> DataFrame:
    """One row (name, files, ids) for each organisation that files mention: in how many, and with how many different identifiers."""
    return mentions.groupBy(name).agg(F.countDistinct(file).alias("files"), F.countDistinct(identifier).alias("ids"))
