"""Configuration as tables: agents (agent, provider, model, fields, needs, context), providers (provider, env), overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.values import first_filled
from ferrolith.operators.storage import settle

#: Variables of an environment that ``expand_variables`` takes.
MOST_VARIABLES = 1_000


def without_deprecated(settings: Column, deprecated: list[str]) -> tuple[Column, Column]:
    """A map of settings without its deprecated keys, and a warning for each that was there."""
    kept = F.map_filter(settings, lambda k, v: ~k.isin(deprecated))
    warnings = F.transform(F.array_sort(F.array_intersect(F.map_keys(settings), F.array(*map(F.lit, deprecated)))), lambda k: F.concat(F.lit("deprecated setting ignored: "), k))
    return kept, warnings


def expand_variables(text: Column, variables: DataFrame, rows: DataFrame, out: str, most: int = MOST_VARIABLES) -> DataFrame:
    """``rows`` with ``${NAME}`` in a text replaced by the variables' values (name, value); a name that is not set becomes nothing.

    Variables are those of one environment and go into the plan as a map; more than ``most`` are an error.
    """
    given = variables.limit(most + 1).collect()
    if len(given) > most:
        raise ValueError(f"more than {most} variables")
    table = F.create_map(*[F.lit(x) for row in given for x in (row["name"], row["value"])]).cast("map<string,string>")
    parts = F.split(text, r"\$\{")
    tail = lambda p: F.concat(F.coalesce(F.try_element_at(table, F.substring_index(p, "}", 1)), F.lit("")), F.regexp_replace(p, r"(?s)^[^}]*\}", ""))
    whole = lambda p: F.when(F.contains(p, F.lit("}")), tail(p)).otherwise(F.concat(F.lit("${"), p))
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), whole), ""))
    return rows.withColumn(out, joined)


def first_existing(candidates: DataFrame, by: str, order: str, exists: str) -> DataFrame:
    """The first candidate, in ``order``, that exists: explicit path, working folder, user folder, environment."""
    return candidates.where(F.col(exists)).groupBy(by).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != by]), order).alias("first")).select(by, "first.*")


def upstream_context(agents: DataFrame, results: DataFrame) -> DataFrame:
    """What each agent may see of earlier results: (resource, agent, field, value) for the fields it declares in ``context``, successful and filled ones only."""
    wanted = agents.select("agent", F.explode("context").alias("w_field"))
    good = results.where(F.col("error").isNull() & F.col("value").isNotNull()).select("resource", "field", "value")
    return good.join(wanted, F.col("field") == F.col("w_field")).select("resource", "agent", "field", "value")


def used_by(agents: DataFrame, providers: DataFrame) -> DataFrame:
    """Every provider with the sorted names of the agents that use it."""
    users = agents.groupBy(F.col("provider").alias("u_provider")).agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    joined = providers.select("provider").distinct().join(users, F.col("provider") == F.col("u_provider"), "left")
    return joined.select("provider", F.coalesce("agents", F.array().cast("array<string>")).alias("agents"))


def missing_keys(agents: DataFrame, providers: DataFrame, environment: DataFrame) -> DataFrame:
    """Providers in use whose key (``env``) is not set or empty in ``environment`` (name, value), with the agents that need it."""
    given = environment.where(F.coalesce("value", F.lit("")) != "").select(F.col("name").alias("e_name"))
    lacking = providers.where(F.coalesce("env", F.lit("")) != "").join(given, F.col("env") == F.col("e_name"), "left_anti")
    needed = lacking.join(agents.select("agent", F.col("provider").alias("a_provider")), F.col("provider") == F.col("a_provider"))
    return needed.groupBy("provider", "env").agg(F.array_sort(F.collect_set("agent")).alias("agents"))


def apply_overrides(agents: DataFrame, overrides: DataFrame, providers: DataFrame) -> DataFrame:
    """Agents with the provider and model of their overrides (agent, provider, model); blanks, and providers that do not exist, change nothing."""
    known = providers.select(F.col("provider").alias("k_provider")).distinct()
    o = overrides.select(F.col("agent").alias("o_agent"), F.col("provider").alias("o_provider"), F.col("model").alias("o_model"))
    o = o.join(known, F.col("o_provider") == F.col("k_provider"), "left").withColumn("o_provider", F.col("k_provider")).drop("k_provider")
    joined = agents.join(o, F.col("agent") == F.col("o_agent"), "left")
    return joined.withColumns({"provider": F.coalesce("o_provider", "provider"), "model": F.coalesce(first_filled(F.col("o_model")), F.col("model"))}).drop("o_agent", "o_provider", "o_model")


def swap_provider(agents: DataFrame, old: str, new: str, model: str) -> DataFrame:
    """All agents of one provider on another, with its model; their former settings stay beside them for ``restore_provider``."""
    mine = F.col("provider") == old
    return agents.withColumns({
        "former": F.when(mine, F.struct("provider", "model")), "provider": F.when(mine, new).otherwise(F.col("provider")), "model": F.when(mine, model).otherwise(F.col("model")),
    })


def restore_provider(agents: DataFrame, new: str, model: str) -> DataFrame:
    """The reverse of ``swap_provider``, for agents that still are as it left them."""
    same = F.col("former").isNotNull() & (F.col("provider") == new) & (F.col("model") == model)
    return agents.withColumns({"provider": F.when(same, F.col("former.provider")).otherwise(F.col("provider")), "model": F.when(same, F.col("former.model")).otherwise(F.col("model"))}).drop("former")


def ancestors(needs: DataFrame) -> DataFrame:
    """Everything a node needs, directly or through others: distinct (node, ancestor) out of (node, needs), cycles included.

    Each round adds the pairs one step further away and is written as a checkpoint; a dependency graph is shallow.
    """
    steps = needs.select("node", F.col("needs").alias("ancestor")).distinct()
    found = frontier = settle(steps)
    onward = steps.select(F.col("node").alias("at"), F.col("ancestor").alias("next"))
    while not frontier.isEmpty():
        further = frontier.join(onward, F.col("ancestor") == F.col("at")).select("node", F.col("next").alias("ancestor")).distinct()
        frontier = settle(further.join(found, ["node", "ancestor"], "left_anti"))
        found = settle(found.unionByName(frontier))
    return found


def context_problems(wanted: DataFrame, needs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Context fields (agent, field) that no agent before it gives: ``wanted`` and ``outputs`` are (agent, field), ``needs`` is (node, needs)."""
    given = ancestors(needs).join(outputs, F.col("ancestor") == F.col("agent")).select(F.col("node").alias("agent"), "field").distinct()
    return wanted.distinct().join(given, ["agent", "field"], "left_anti")


def field_owners(declared: DataFrame, field: str, agent: str, order: str) -> DataFrame:
    """The agent that owns each field: the last in ``order`` that declares it, of equals the greatest."""
    last = declared.groupBy(field).agg(F.max(F.struct(order, agent)).alias("last"))
    return last.select(field, F.col("last")[agent].alias(agent), F.col("last")[order].alias(order))


def most_specific(rows: DataFrame, tiers: list[tuple[str, DataFrame]], default: Column, out: str) -> DataFrame:
    """``rows`` with the setting of the first tier that has one. A tier is a column of ``rows`` and settings (key, value) for its values, one for each."""
    joined, values = rows, []
    for i, (column, given) in enumerate(tiers):
        keyed = given.select(F.col("key").alias(f"t{i}_key"), F.col("value").alias(f"t{i}_value"))
        joined = joined.join(keyed, F.col(column) == F.col(f"t{i}_key"), "left")
        values.append(F.col(f"t{i}_value"))
    return joined.select(*rows.columns, F.coalesce(*values, default).alias(out))


def addable(pool: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """What a pool offers that is not in use yet, each once."""
    return pool.select(key).distinct().join(used.select(F.col(key).alias("u_key")).distinct(), F.col(key) == F.col("u_key"), "left_anti")
