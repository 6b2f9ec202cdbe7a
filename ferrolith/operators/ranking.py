"""Ranks, rank correlation, apportionment, stratified samples, collision names and waves of a dependency graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrolith.operators.storage import settle


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """1-based ranks of the whole column, ties sharing their mean.

    Counts by value are dealt to ranges of values; each range is ranked on its own, and starts after the rows of the
    ranges before it. Only one number for each range is gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = settle(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ranged.groupBy("part").agg(F.max(value).alias("last"), F.sum("n").alias("total"))
    bases = ends.select(F.col("part").alias("b_part"), F.coalesce(F.sum("total").over(Window.orderBy("last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = ranged.withColumn("before", own).join(F.broadcast(bases), F.col("part") == F.col("b_part"))
    ranks = placed.select(F.col(value).alias("r_value"), (F.col("base") + F.col("before") + (F.col("n") + 1) / 2.0).cast("double").alias(out))
    return rows.join(ranks, F.col(value) == F.col("r_value"), "left").drop("r_value")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho): correlation of the ranks, null for fewer than two rows or a constant column."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(both, a, "ra"), b, "rb")
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ra", "rb").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    return sums.select("n", F.when((F.col("n") > 1) & (F.col("sa") > 0) & (F.col("sb") > 0), F.try_divide("c", F.col("sa") * F.col("sb"))).alias("rho"))


def apportion(strata: DataFrame, stratum: str, size: str, target: int) -> DataFrame:
    """``target`` seats by largest remainder, no stratum above its size: (stratum, size, seats). Strata are few."""
    total = F.sum(size).over(Window.partitionBy())
    quota = F.when(total > 0, F.lit(target) * F.col(size) / F.nullif(total, F.lit(0))).otherwise(0.0)
    rows = strata.select(stratum, size, quota.alias("quota")).withColumn("whole", F.least(F.floor("quota"), F.col(size)))
    left = F.lit(target) - F.sum("whole").over(Window.partitionBy())
    room = (F.col(size) > F.col("whole")).cast("int")
    order = Window.orderBy(F.desc(F.col("quota") - F.floor("quota")), stratum)
    extra = F.when((room == 1) & (F.sum(room).over(order) <= left), 1).otherwise(0)
    return rows.select(stratum, size, (F.col("whole") + extra).cast("bigint").alias("seats"))


def stratified_draw(rows: DataFrame, stratum: str, key: Column, seats: DataFrame, pilot: int = 0, reserves: int = 0) -> DataFrame:
    """The first rows of each stratum in the order of ``key`` (a seeded hash): drawn, pilot (its first ones) and reserves."""
    drawn = rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(key)))
    joined = drawn.join(seats.select(F.col(stratum).alias("s_stratum"), "seats"), F.col(stratum) == F.col("s_stratum")).drop("s_stratum")
    kept = joined.where(F.col("place") <= F.col("seats") + reserves)
    return kept.withColumns({"pilot": F.col("place") <= F.least(F.lit(pilot), "seats"), "reserve": F.col("place") > F.col("seats")})


def lettered(place: Column) -> Column:
    """A letter for each of the first 26 places, two letters for those up to 702, and the number after those."""
    two = F.concat(F.chr(96 + F.floor((place - 1) / 26)), F.chr(97 + (place - 1) % 26))
    return F.when(place <= 26, F.chr(96 + place)).when(place <= 702, two).otherwise(place.cast("string"))


def next_character(place: Column) -> Column:
    """The character ``place`` after the one before ``a``, of whatever kind, as the reference counts; the number where characters of two bytes' codes run out."""
    code = F.decode(F.unhex(F.lpad(F.hex(96 + place), 4, "0")), "UTF-16BE")
    return F.when(place < 0xD800 - 96, code).otherwise(place.cast("string"))


def collision_names(rows: DataFrame, name: str, month: str, key: str, suffix: Callable[[Column], Column] = lettered) -> DataFrame:
    """A file name of its own for each row: the name where it is unique, else with the month, else with the ``suffix`` of its place as well."""
    alone, in_month = F.count(F.lit(1)).over(Window.partitionBy(name)), F.count(F.lit(1)).over(Window.partitionBy(name, month))
    place = F.row_number().over(Window.partitionBy(name, month).orderBy(key))
    final = F.when(alone == 1, F.col(name)).when(in_month == 1, F.concat_ws("_", name, month)).otherwise(F.concat(F.concat_ws("_", name, month), suffix(place)))
    return rows.withColumn("final_name", final)


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each node of a dependency graph: (node, wave), wave null for nodes in or behind a cycle.

    ``edges`` are (node, needs). A node's wave comes after those of all it needs; a need that is no node is never met.
    Each round settles one wave, what is done and what is left, as checkpoints: plans do not grow. Rounds are as many as waves.
    """
    left = nodes.select("node").distinct()
    needs = edges.select(F.col("node").alias("of"), "needs").distinct()
    done, wave = None, 0
    while True:
        open_needs = needs if done is None else needs.join(done.select(F.col("node").alias("needs")), "needs", "left_anti")
        ready = left.join(open_needs, F.col("node") == F.col("of"), "left_anti").withColumn("wave", F.lit(wave))
        ready = settle(ready)
        if ready.isEmpty():
            rest = left.withColumn("wave", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else settle(done.unionByName(ready))
        left, wave = settle(left.join(ready.select("node"), "node", "left_anti")), wave + 1


def first_matching(rows: DataFrame, predicate: Column, n: int, seed: int, key: str) -> DataFrame:
    """The first ``n`` rows in a seeded order that satisfy ``predicate``: the shuffled scan of a sampler."""
    return rows.where(predicate).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def redraw(drawn: DataFrame, failed: DataFrame, stratum: str, key: str) -> DataFrame:
    """A stratified draw after some of its rows failed: reserves of the same stratum take their places, in order."""
    lost = failed.select(F.col(key).alias("f_key")).distinct()
    ok = drawn.join(lost, F.col(key) == F.col("f_key"), "left_anti")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("place"))
    return ok.withColumn("place", place).where(F.col("place") <= F.col("seats")).withColumn("reserve", F.lit(False))
