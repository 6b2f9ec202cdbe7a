"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised. The exponent is bisected, between 1 (the
corpus as it is) and 0 (all sources alike), down to the smallest one that still keeps the limit: weights no more
even than ``target_entropy`` (a fraction of the largest possible), or no source repeated more than
``max_repeats`` times. The token budget, if not given, is the smallest that uses every source once in full.
Sources stay a table: the sums that the bisection needs are aggregated for ``GRID`` exponents at a time.

The weights are realised as budgeted block permutations: a source's documents are put in the order of a hash, and the
order is cut into ranges of equal width, the blocks: ``BLOCKS`` of them, or more where a block would hold over
``BLOCK_TOKENS`` tokens, about. Each pass over a source is a permutation of its blocks of its own, and passes go on until the
source's budget is used up. Only the block in which a pass ends is cut between documents, in hash order; the
document that crosses the budget is the last one used.

Tokens are words: maximal runs of characters other than space and control characters 9 to 13.

Defined cases: a null text has no tokens; a null source is a source of its own; sources without tokens are used once;
rows that share a doc_id are documents of their own, told apart by their texts, and if those are equal too they are used alike;
an empty table gives no rows; extra columns pass through ``mix_documents`` unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrolith.llm.common import TMP, materialize

MAX_REPEATS = 2.0
BLOCKS, BLOCK_TOKENS = 256, 1 << 22
#: Exponents that one aggregation tries, and aggregations: the interval shrinks to 1 / GRID ** STEPS.
GRID, STEPS = 32, 10
SEED = 8


@dataclass
class Mixture:
    """Exponent, budget in tokens, and a row for each source: source, tokens, weight, passes."""

    exponent: float
    budget: float
    sources: DataFrame


def solve(counts: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> Mixture:
    """The mixture for ``counts``: a row (source, tokens) for each source."""
    used = F.when(F.col("tokens") > 0, F.col("tokens"))
    total, least, most, positive = counts.agg(F.sum(used), F.min(used), F.max(used), F.count(used)).first()
    if not positive:
        return Mixture(1.0, 0.0, counts.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("passes")))
    log_share = F.log(used / F.lit(float(total)))

    def sums(exponents: list[float], needed: bool) -> list[tuple[float, float]]:
        """For each exponent the sum of the powers, and the entropy of the weights."""
        columns = []
        if not needed:
            return [(math.nan, math.nan)] * len(exponents)
        for e in exponents:
            power = F.exp(log_share * F.lit(e))
            columns += [F.sum(power), F.sum(power * log_share)]
        row = counts.agg(*columns).first()
        return [(z, math.log(z) - e * y / z) for e, z, y in zip(exponents, row[::2], row[1::2], strict=True)]

    def use(exponent: float, z: float) -> float:
        """The budget over the sum of powers and the tokens; by default the largest source, which is used least, is used once."""
        return budget / (z * total) if budget is not None else (most / total) ** (1 - exponent)

    def within(exponent: float, z: float, entropy: float) -> bool:
        if target_entropy is not None:
            return positive < 2 or entropy <= target_entropy * math.log(positive) + 1e-12
        return use(exponent, z) * (least / total) ** (exponent - 1) <= max_repeats * (1 + 1e-12)

    low, high, needed = 0.0, 1.0, target_entropy is not None or budget is not None
    if within(0.0, *sums([0.0], needed)[0]):
        high = 0.0
    else:
        for _ in range(STEPS):
            tried = [low + (high - low) * i / GRID for i in range(1, GRID)]
            met = [within(e, z, h) for e, (z, h) in zip(tried, sums(tried, needed), strict=True)]
            first = met.index(True) if True in met else len(met)
            low, high = ([low, *tried][first], [*tried, high][first])
    z = sums([high], True)[0][0]
    tokens = use(high, z) * z * total
    weight = F.coalesce(F.exp(log_share * F.lit(high)) / F.lit(z), F.lit(0.0))
    passes = F.coalesce(weight * F.lit(tokens) / used, F.lit(1.0))
    return Mixture(high, tokens, counts.select("source", "tokens", weight.alias("weight"), passes.alias("passes")))


def count_tokens(text: Column) -> Column:
    """Number of words, by regular expression on the JVM side."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _deal(docs: DataFrame, seed: int) -> DataFrame:
    """Each document's tokens and its place in hash order."""
    order = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    return docs.select(F.col("doc_id"), F.col("source"), count_tokens(F.col("text")).alias("n_tokens"), order.alias("order"))


def plan_mixture(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None, blocks: int = BLOCKS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED
) -> tuple[DataFrame, Mixture]:
    """One row for each use of a document: doc_id, source, n_tokens, order, block, pass_no, position, weight; and the mixture.

    ``position`` is the block's place in the permutation of its pass.
    """
    dealt = materialize(_deal(docs, seed), "mixing")
    counts = materialize(dealt.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mixing-sources")
    mixture = solve(counts, target_entropy, max_repeats, budget)
    n_blocks = F.greatest(F.lit(blocks), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("bigint")
    n_passes = F.ceil(F.col("passes") - F.lit(1e-9)).cast("int")
    plan = mixture.sources.select(F.col("source").alias("p_source"), "weight", (F.col("tokens") * F.col("passes")).alias("quota"), "passes", n_passes.alias("n_passes"), n_blocks.alias("n_blocks"))
    plan = materialize(plan, "mixing-plan")
    of_source = lambda df: df.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    place = F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53))  # of the hash, from 0 to 1
    dealt = of_source(dealt).withColumn("block", F.floor(place * F.col("n_blocks")).cast("bigint")).select("doc_id", "source", "n_tokens", "order", "block")
    totals = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    each = of_source(totals).where(F.col("n_passes") > 0).withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("n_passes"))))
    permuted = Window.partitionBy("source", "pass_no").orderBy(F.xxhash64("block", "pass_no", F.lit(seed)), "block")
    whole = Window.partitionBy("source", "pass_no")
    placed = each.withColumn("position", F.row_number().over(permuted)).withColumn("before", F.sum("tokens").over(permuted) - F.col("tokens"))
    # what is left of the quota when a block's turn comes; the last block may be cut
    placed = placed.withColumn("left", F.col("quota") - (F.col("pass_no") - 1) * F.sum("tokens").over(whole) - F.col("before"))
    full = F.floor(F.col("passes") + F.lit(1e-9)) >= F.col("pass_no")
    used = placed.where(full | (F.col("left") > 0)).select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "pass_no", "position", "weight", F.when(~full & (F.col("left") < F.col("tokens")), F.col("left")).alias("cut"))
    used = materialize(used, "mixing-blocks")
    match = dealt["source"].eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))
    entire = dealt.join(used.where(F.col("cut").isNull()), match).drop("b_source", "b_block", "cut")
    last = dealt.join(used.where(F.col("cut").isNotNull()), match)
    # one block of each source and pass, of bounded size
    inside = Window.partitionBy("b_source", "pass_no", "b_block").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("done", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where(F.col("done") < F.col("cut")).drop("done", "b_source", "b_block", "cut")
    return entire.unionByName(last), mixture


def mix_documents(docs: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` mixed: each row as often as it is used; columns as they are."""
    plan, _ = plan_mixture(docs, target_entropy, max_repeats, budget, seed=seed)
    uses = plan.select(F.col("doc_id").alias(f"{TMP}id"), F.col("order").alias(f"{TMP}order"), F.col("pass_no").alias(f"{TMP}pass")).distinct()
    uses = uses.groupBy(f"{TMP}id", f"{TMP}order").agg(F.count(F.lit(1)).cast("int").alias(f"{TMP}uses"))
    keyed = docs.withColumn(f"{TMP}key", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)))
    joined = keyed.join(uses, keyed["doc_id"].eqNullSafe(F.col(f"{TMP}id")) & (F.col(f"{TMP}key") == F.col(f"{TMP}order")))
    return joined.withColumn(f"{TMP}n", F.explode(F.sequence(F.lit(1), F.col(f"{TMP}uses")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all ``documents``: one row per use of a document."""
    plan, _ = plan_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "source", "n_tokens", "block", "pass_no", "position", "weight")
