"""Organisations to identifiers in tiers, each for the names that those before it left open.

1. Overrides, by name and country and then by name, are final.
2. Cached outcomes, found or not, count until they expire.
3. The registry's own pick for an affiliation, taken as it is; a known other country makes it ``review`` with half confidence.
4. Where there is no pick, or one for review: the registry by likeness of names. It replaces a pick only with an ``auto``.
5. The second registry by likeness of names, without countries, unless the match so far is ``auto`` and carries its number.

Matches of both registries are combined (``matching.combine_matches``). Names are resolved once for a batch; every tier is a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.names import normalize_org
from ferrolith.functions.values import strip
from ferrolith.operators.caching import cache_key
from ferrolith.operators.matching import THRESHOLD, best_two_with_gap, combine_matches, name_score, overridden, scored_candidates
from ferrolith.operators.storage import settle

MATCH = ["ror_id", "isni_id", "confidence", "status", "via"]
#: Confidence of a pick from another country than the name's.
DOUBTED = 0.5


def _asked(names: DataFrame) -> DataFrame:
    """Distinct names and countries with the name for comparison, the key of the pair, and that of the cache."""
    country = F.nullif(F.upper(strip(F.col("country"))), F.lit(""))
    pairs = names.select("name", country.alias("country")).distinct()
    keyed = pairs.withColumn("name_key", F.coalesce(normalize_org(F.col("name")), F.lit("")))
    return keyed.withColumns({
        "ask": F.sha2(F.to_json(F.struct("name", "country")), 256),
        "cache_key": cache_key(F.lit("org"), F.col("name_key"), F.coalesce("country", F.lit(""))),
    })


def _by_likeness(open_names: DataFrame, entries: DataFrame, score: Callable[[Column, Column], Column], threshold: float, via: str, with_country: bool) -> DataFrame:
    """The best entry for each open name that reaches the threshold: (l_ask, l_<match columns>)."""
    keyed = entries.withColumn("entry_key", normalize_org(F.col("name"))).drop("name")
    ids = keyed.select(F.struct("ror_id", "isni_id").alias("entry_id"), "entry_key").distinct()
    scored = open_names.select("ask", "name_key", "country").join(scored_candidates(open_names, ids, threshold, score), "name_key")
    countries = keyed.groupBy("ror_id", "isni_id").agg(F.min("country").alias("entry_country")).select(F.struct("ror_id", "isni_id").alias("c_id"), "entry_country")
    scored = scored.join(countries, F.col("entry_id").eqNullSafe(F.col("c_id"))).drop("c_id")
    best = best_two_with_gap(scored, "ask", "entry_id", threshold=threshold, **({"country": "entry_country", "hint": "country"} if with_country else {}))
    found = best.where(F.col("status") != "nomatch")
    return found.select(
        F.col("ask").alias("l_ask"), F.col("entry_id.ror_id").alias("l_ror_id"), F.col("entry_id.isni_id").alias("l_isni_id"),
        (F.col("adjusted") / 100).alias("l_confidence"), F.col("status").alias("l_status"), F.lit(via).alias("l_via"),
    )


def resolve_in_tiers(
    names: DataFrame,
    registry: DataFrame,
    second: DataFrame,
    overrides: DataFrame,
    cache: DataFrame,
    picks: DataFrame,
    now: Column,
    threshold: float = THRESHOLD,
    score: Callable[[Column, Column], Column] = name_score,
) -> DataFrame:
    """``names`` (name, country) to (name, country, cache_key, ror_id, isni_id, confidence, status, via).

    ``registry`` has ror_id, isni_id, name, country; ``second`` isni_id, name; ``overrides`` name_key, country, ror_id, isni_id;
    ``cache`` cache_key, expires_at and the match (a null status: known to have none); ``picks`` name, ror_id.
    Blank names, and those nothing is found for, are ``nomatch``; ``via`` names the tiers.
    """
    asked = _asked(names)
    fixed = overrides.select("name_key", "country", F.struct("ror_id", "isni_id").alias("entry_id"))
    asked = overridden(asked, fixed).withColumnRenamed("entry_id", "fixed")
    valid = cache.where(F.col("expires_at") > now).select(F.col("cache_key").alias("c_key"), F.struct(*MATCH).alias("known"))
    asked = asked.join(valid, (F.col("cache_key") == F.col("c_key")) & F.col("fixed").isNull(), "left").drop("c_key")
    asked = settle(asked)
    done = asked.where(F.col("fixed").isNotNull() | F.col("known").isNotNull() | (F.col("name_key") == ""))
    now_open = asked.where(F.col("fixed").isNull() & F.col("known").isNull() & (F.col("name_key") != "")).drop("fixed", "known")

    pick = picks.select(F.col("name").alias("p_name"), F.col("ror_id").alias("p_id")).join(registry.select(*[F.col(c).alias(f"a_{c}") for c in ("ror_id", "isni_id", "country")]), F.col("p_id") == F.col("a_ror_id"))
    elsewhere = F.coalesce(F.upper("a_country") != F.col("country"), F.lit(False))
    picked = now_open.join(pick.drop("p_id"), F.col("name") == F.col("p_name"), "left").select(
        *now_open.columns, "a_ror_id", "a_isni_id",
        F.when(F.col("a_ror_id").isNotNull(), F.when(elsewhere, DOUBTED).otherwise(1.0)).alias("a_confidence"),
        F.when(F.col("a_ror_id").isNotNull(), F.when(elsewhere, "review").otherwise("auto")).alias("a_status"),
        F.when(F.col("a_ror_id").isNotNull(), "affiliation").alias("a_via"),
    )
    picked = settle(picked)
    unsure = picked.where(F.col("a_status").isNull() | (F.col("a_status") == "review"))
    alike = _by_likeness(unsure, registry, score, threshold, "query", True)
    both = picked.join(alike, F.col("ask") == F.col("l_ask"), "left")
    better = F.col("l_status").isNotNull() & (F.col("a_status").isNull() | (F.col("l_status") == "auto"))
    first = settle(both.select(*now_open.columns, *[F.when(better, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")).alias(f"f_{c}") for c in MATCH]))
    sure = F.coalesce((F.col("f_status") == "auto") & F.col("f_isni_id").isNotNull(), F.lit(False))
    entries = second.select(F.lit(None).cast("string").alias("ror_id"), "isni_id", "name", F.lit(None).cast("string").alias("country"))
    other = _by_likeness(first.where(~sure), entries, score, threshold, "second", False)
    pair = first.join(other, F.col("ask") == F.col("l_ask"), "left")
    combined = combine_matches({c: F.col(f"f_{c}") for c in MATCH}, {c: F.col(f"l_{c}") for c in MATCH})
    resolved = pair.select("name", "country", "cache_key", *[combined[c].alias(c) for c in MATCH])
    decided = done.select(
        "name", "country", "cache_key",
        *[F.coalesce(F.col(f"fixed.{c}"), F.col(f"known.{c}")).alias(c) for c in ("ror_id", "isni_id")],
        F.when(F.col("fixed").isNotNull(), 1.0).otherwise(F.col("known.confidence")).alias("confidence"),
        F.when(F.col("fixed").isNotNull(), "auto").otherwise(F.col("known.status")).alias("status"),
        F.when(F.col("fixed").isNotNull(), "override").when(F.col("known").isNotNull(), F.concat_ws(":", F.lit("cache"), "known.via")).otherwise("").alias("via"),
    )
    return resolved.unionByName(decided).withColumn("status", F.coalesce("status", F.lit("nomatch")))


def to_cache(resolved: DataFrame, expires_at: Column) -> DataFrame:
    """What a batch adds to the cache: one row for each key that went past overrides and cache, also where nothing was found."""
    fresh = resolved.where(~F.col("via").startswith("override") & ~F.col("via").startswith("cache") & (F.coalesce(strip(F.col("name")), F.lit("")) != ""))
    one = fresh.groupBy("cache_key").agg(F.min_by(F.struct(*MATCH), "name").alias("m")).select("cache_key", "m.*")
    return one.withColumns({"status": F.nullif(F.col("status"), F.lit("nomatch")), "expires_at": expires_at})
