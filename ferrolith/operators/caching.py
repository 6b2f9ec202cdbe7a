"""Result caches as tables: keys, lookups with a time to live, misses, and entries that say there is nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts, joined by colons; parts that are null are left out."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def cached(requests: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Hits (with value and ``is_negative``) and misses of ``requests`` (key, ...) in ``cache`` (key, value, expires_at)."""
    valid = cache.where(F.col("expires_at") > now).select(F.col("key").alias("c_key"), "value")
    hits = requests.join(valid, F.col("key") == F.col("c_key")).drop("c_key").withColumn("is_negative", F.col("value").isNull())
    misses = requests.join(valid.select("c_key"), F.col("key") == F.col("c_key"), "left_anti")
    return hits, misses


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with rows of the same keys replaced, keys compared null-safely, and new ones added; columns of ``existing``."""
    renamed = new.select([F.col(k).alias(f"n_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        this = F.col(k).eqNullSafe(F.col(f"n_{k}"))
        same = this if same is None else same & this
    return existing.join(renamed, same, "left_anti").unionByName(new.select(*existing.columns))


def stored_data(payload: Column) -> Column:
    """The answer in a stored payload: what stands under ``data`` where ``usage`` stands beside it, and all of it in the older shape."""
    v = F.try_parse_json(payload)
    wrapped = F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, "$.data", "variant").isNotNull() & F.try_variant_get(v, "$.usage", "variant").isNotNull()
    return F.when(wrapped, F.to_json(F.try_variant_get(v, "$.data", "variant"))).otherwise(payload)


def answer_batch(requests: DataFrame, cache: DataFrame, answers: DataFrame, now: Column, expires_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch through the cache: answered requests, keys to call for, and the cache afterwards.

    ``requests`` have key and others, ``cache`` (key, payload, expires_at), ``answers`` (key, payload, tokens) are what calls gave. A key is called for once, however many
    requests have it; a hit costs no tokens, and of a call's requests the least row bears its tokens. Expired entries leave the cache, answers replace entries.
    """
    valid = cache.where(F.col("expires_at") > now)
    held = valid.select(F.col("key").alias("c_key"), "payload").unionByName(answers.join(valid.select("key"), "key", "left_anti").select(F.col("key").alias("c_key"), "payload"))
    calls = requests.select("key").distinct().join(valid.select("key"), "key", "left_anti")
    rest = [F.col(c) for c in requests.columns if c != "key"]
    paid = requests.join(calls, "key").groupBy("key").agg(F.min(F.struct(*rest)).alias("payer")).join(answers.select("key", "tokens"), "key")
    paid = paid.select(F.col("key").alias("p_key"), "payer", "tokens")
    joined = requests.join(held, F.col("key") == F.col("c_key"), "left").join(paid, (F.col("key") == F.col("p_key")) & (F.struct(*rest) == F.col("payer")), "left")
    done = joined.select(*requests.columns, stored_data(F.col("payload")).alias("answer"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return done, calls, upsert(valid, answers.withColumn("expires_at", expires_at), ["key"])
