"""Partial results of several extractors to one document, and their accounting.

A result is a row (resource, ord, call, field, kind, value, items, error, prompt, completion): ``ord`` is the order
of arrival, fixed by configuration; ``kind`` is scalar, list or dict; a dict's entries and a list's values are in
``items`` as (key, value), a list's with null keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.shapes import total_tokens


def merge_fields(results: DataFrame, envelope: list[str] = ()) -> DataFrame:
    """One row (resource, field, kind, value, items) by field: lists are joined, of dicts the first filled value of each key stays, of scalars the last.

    Keys of dicts are aggregated one by one, each from its first filled value on. A field's kind is that of its last result; errors, results without a value and envelope fields are passed over.
    """
    given = F.col("error").isNull() & (F.col("value").isNotNull() | F.col("items").isNotNull()) & ~F.col("field").isin(*envelope)
    rows = results.where(given).select("resource", "field", "ord", "kind", "value", "items")
    last = rows.groupBy("resource", "field").agg(F.max_by("kind", "ord").alias("l_kind"), F.max_by("value", "ord").alias("last"))
    parts = rows.join(last.select(F.col("resource").alias("l_resource"), F.col("field").alias("l_field"), "l_kind"), F.col("resource").eqNullSafe(F.col("l_resource")) & (F.col("field") == F.col("l_field")) & (F.col("kind") == F.col("l_kind")))
    items = parts.select("resource", "field", "kind", "ord", F.posexplode("items").alias("pos", "item")).select("*", "item.key", "item.value", F.struct("ord", "pos").alias("at"))
    filled = F.when(F.coalesce(F.col("value"), F.lit("")) != "", F.struct("at", "value"))
    by_key = items.where(F.col("kind") == "dict").groupBy("resource", "field", "key").agg(F.min("at").alias("at"), F.coalesce(F.min(filled)["value"], F.lit("")).alias("value"))
    each = items.where(F.col("kind") == "list").select("resource", "field", "at", "key", "value").unionByName(by_key, allowMissingColumns=True)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "key", "value"))), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    joined = each.groupBy(F.col("resource").alias("i_resource"), F.col("field").alias("i_field")).agg(ordered.alias("items"))
    whole = last.join(joined, F.col("resource").eqNullSafe(F.col("i_resource")) & (F.col("field") == F.col("i_field")), "left")
    none = F.array().cast("array<struct<key:string,value:string>>")
    return whole.select("resource", "field", F.col("l_kind").alias("kind"), F.when(F.col("l_kind") == "scalar", F.col("last")).alias("value"), F.when(F.col("l_kind") != "scalar", F.coalesce("items", none)).alias("items"))


def usage_by_call(results: DataFrame) -> DataFrame:
    """Tokens of each resource, every call counted once however many fields it gave."""
    calls = results.groupBy("resource", "call").agg(F.max("prompt").alias("prompt"), F.max("completion").alias("completion"))
    return calls.groupBy("resource").agg(F.count("call").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), (F.sum("prompt") + F.sum("completion")).alias("total"))


def failure_summary(results: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Status of each resource, with the first three of its different errors: failed if all results failed, or any did and partial results are not allowed."""
    errors = F.concat_ws("; ", F.slice(F.array_sort(F.collect_set("error")), 1, 3))
    all_failed, some_failed = F.bool_and(F.col("error").isNotNull()), F.bool_or(F.col("error").isNotNull())
    status = F.when(all_failed, "failed").when(some_failed, "partial" if allow_partial else "failed").otherwise("ok")
    return results.groupBy("resource").agg(status.alias("status"), errors.alias("errors"))


def models_used(results: DataFrame, agent: str = "agent", model: str = "model") -> DataFrame:
    """A resource's agents with the model of each one's first result that names a model."""
    return results.where(F.col(model).isNotNull()).groupBy("resource", agent).agg(F.min_by(model, "ord").alias(model))


def exit_code(n: Column, succeeded: Column, warnings: Column) -> Column:
    """1: nothing succeeded; 2: something failed or warned; 0: all well."""
    return F.when(succeeded == 0, 1).when((succeeded < n) | (warnings > 0), 2).otherwise(0)


def best_attempt(attempts: DataFrame, by: str, fields: str = "n_fields", attempt: str = "attempt", enough: int = 12) -> DataFrame:
    """The attempt with most fields, the earlier one in a tie; attempts after the first with ``enough`` fields do not count."""
    stop = attempts.where(F.col(fields) >= enough).groupBy(by).agg(F.min(attempt).alias("stop"))
    counted = attempts.join(stop, by, "left").where(F.col("stop").isNull() | (F.col(attempt) <= F.col("stop")))
    return counted.groupBy(by).agg(F.max_by(F.struct(*attempts.columns), F.struct(F.col(fields), -F.col(attempt))).alias("best")).select("best.*")


def overlay(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``base`` with every column that is not null in ``other`` written over it."""
    renamed = other.select([F.col(c).alias(f"o_{c}") for c in other.columns])
    return base.join(renamed, F.col(key) == F.col(f"o_{key}"), "left").select(*[F.coalesce(F.col(f"o_{c}"), F.col(c)).alias(c) if f"o_{c}" in renamed.columns and c != key else F.col(c) for c in base.columns])


def usage_of_rounds(rounds: DataFrame, call: str) -> DataFrame:
    """Tokens of each call over all its rounds of tool use; a round without a total counts its parts."""
    total = total_tokens(F.col("prompt"), F.col("completion"), F.col("total"))
    return rounds.groupBy(call).agg(
        F.count(F.lit(1)).alias("rounds"), F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt"), F.coalesce(F.sum("completion"), F.lit(0)).alias("completion"), F.sum(total).alias("total")
    )
