"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is embedded as the numbers of set bits in its 32 two-bit segments. One differing bit changes one of
those numbers by at most one, so the Manhattan distance of two embeddings is at most the Hamming distance of the
fingerprints. Four units of Manhattan distance touch at most four of ``GROUPS`` groups of segments, so two
fingerprints that link agree exactly in at least ``GROUPS - 4`` groups: the grid over each choice of that many
groups puts them into one cell. Pairs that meet in a cell are held against the lower bound and then verified.

No cell's pairs are listed. First neighbours in each cell's sorted order are linked, over ranges of
(cell, fingerprint) that split a cell of any size; components of those links follow. Then only fingerprints of
different components are compared within a cell: those outside its most frequent component against all. What
remains are distinct fingerprints throughout; exact copies are one.

Defined cases: texts that are null or hold no word have fingerprint zero, and zero links like any other; a text of
fewer than four words is one shingle; rows that share a doc_id each give a row, and are linked through their
fingerprints; a row with a null doc_id gets the smallest id in its component, null if there is none; an empty table gives no rows;
other columns are ignored, whatever their names.

Joins whose sides both grow with the documents are merge joins: a broadcast, even one within Spark's threshold, is built on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ferrolith.llm.common import TMP, materialize
from ferrolith.llm.graph import connected_components

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
#: Groups of segments; a grid is over ``GROUPS - MOST_BITS`` of them. More groups: more grids and finer cells.
GROUPS = 7
#: What a chance pair in a cell costs, in rows placed in cells.
PAIR_COST = 10
#: Shingles whose bits are counted in one step.
STEP = 50_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = len(words) - size + 1
    for lo in range(0, n, STEP):
        hi = min(n, lo + STEP)
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(at[lo:hi], at[lo + size : hi + size], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _low_bits() -> Column:
    return F.lit(0x5555555555555555)


def embedding(fp: Column) -> Column:
    """The segments' bit counts 0, 1, 2 as bits 00, 01, 11: differing bits of two such codes are their Manhattan distance."""
    shifted = F.shiftright(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(_low_bits()).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(_low_bits()), 1))


def grid_masks(groups: int = GROUPS, most_bits: int = MOST_BITS) -> list[int]:
    """For each choice of ``groups - most_bits`` groups the bits of their segments, as a signed long."""
    cuts = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    chosen = [sum(c) for c in combinations(masks, groups - most_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def best_groups(n: int, most_bits: int = MOST_BITS) -> int:
    """The number of groups with the least work for ``n`` fingerprints: rows in cells, and pairs that meet by chance.

    A two-bit segment's count tells 1.5 bits apart. Any number of groups finds all links.
    """

    def work(groups: int) -> float:
        grids = comb(groups, most_bits)
        return grids + PAIR_COST * n * grids / 2 ** (1.5 * 32 * (groups - most_bits) / groups)

    return min(range(most_bits + 4, most_bits + 9), key=work)


def cells(points: DataFrame, groups: int = GROUPS) -> DataFrame:
    """A row for each point and grid: grid, cell, then the columns of ``points`` (one is ``fp``)."""
    masks = F.array(*[F.lit(m).cast("long") for m in grid_masks(groups)])
    # every row becomes many: dealt anew first, so that the many are made in as many tasks as there can be
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = points.repartition(tasks, "fp").withColumn("code", embedding(F.col("fp"))).select("*", F.posexplode(masks).alias("grid", "mask"))
    return placed.select("grid", F.col("code").bitwiseAND(F.col("mask")).alias("cell"), *points.columns)


def _linked(a: Column, b: Column) -> Column:
    near = F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= MOST_BITS
    return near & (F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between each row and the two before it in the same cell."""
    tail = [np.empty(0, np.int64)] * 3
    for batch in batches:
        grid, cell, fp = (np.concatenate((t, c.to_numpy().astype(np.int64))) for t, c in zip(tail, batch.columns, strict=True))
        found = []
        for lag in (1, 2):
            same = (grid[lag:] == grid[:-lag]) & (cell[lag:] == cell[:-lag])
            close = same & (np.bitwise_count((fp[lag:] ^ fp[:-lag]).view(np.uint64)) <= MOST_BITS)
            found.append(np.stack([fp[lag:][close], fp[:-lag][close]]))
        a, b = np.concatenate(found, axis=1)
        tail = [grid[-2:], cell[-2:], fp[-2:]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def pairs_across(grouped: DataFrame, groups: int) -> DataFrame:
    """Links (x, xc, fp, comp) between fingerprints of different components (fp, comp) that share a cell.

    Both joins are merge joins at every size: Spark takes the rows of ``cells`` for as few as those they are made of, and would send
    them, dozens of times as many, through the driver.
    """
    placed = cells(grouped, groups)
    # cells that hold several components, and the most frequent of those
    sizes = placed.groupBy("grid", "cell", "comp").agg(F.count("fp").alias("n"))
    mixed = sizes.groupBy("grid", "cell").agg(F.max_by("comp", "n").alias("main"), F.count("comp").alias("comps")).where(F.col("comps") > 1).select("grid", "cell", "main")
    inside = placed.join(mixed.hint("merge"), ["grid", "cell"])
    few = inside.where(F.col("comp") != F.col("main")).select("grid", "cell", F.col("fp").alias("x"), F.col("comp").alias("xc"))
    met = few.join(inside.select("grid", "cell", "fp", "comp").hint("merge"), ["grid", "cell"])
    return met.where((F.col("xc") != F.col("comp")) & _linked(F.col("x"), F.col("fp")))


def link_components(distinct: DataFrame, groups: int | None = None) -> DataFrame:
    """``distinct`` fingerprints (fp): those in components of two or more, with the component's smallest (node, root)."""
    groups = groups or best_groups(distinct.count())
    placed = cells(distinct.select("fp"), GROUPS)
    sorted_cells = placed.repartitionByRange("grid", "cell", "fp").sortWithinPartitions("grid", "cell", "fp")
    first = connected_components(sorted_cells.mapInArrow(_neighbours, "a bigint, b bigint"))
    grouped = materialize(distinct.join(first.hint("merge"), distinct["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("comp")), "fp-components")
    pairs = pairs_across(grouped, groups)
    across = connected_components(pairs.select(F.col("xc").alias("a"), F.col("comp").alias("b")))
    roots = grouped.join(across.hint("merge"), grouped["comp"] == across["node"], "left").select(F.col("fp").alias("node"), F.coalesce("root", "comp").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """doc_id, fp, root and component_id of every document; root names the component, component_id is its smallest doc_id."""
    marked = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-distinct")
    roots = distinct.join(link_components(distinct, groups).hint("merge"), F.col("fp") == F.col("node")).select("fp", "root", "least")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.select("fp", "root").join(ids.hint("merge"), "root")
    return marked.join(named.hint("merge"), "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id; columns as they are.

    Of a group's rows that share the smallest id one stays (the first by text); an id that stands for several groups
    stays once for each. Rows without an id stay, one to a group, where no row of their group has an id.
    """
    found = materialize(near_duplicates(docs, groups), "fp-found")
    ids = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component"))
    lone = ids.where((F.col("n") == 1) & (F.col("doc_id") == F.col("component"))).select(F.col("doc_id").alias(f"{TMP}id"))
    one = docs.join(lone.hint("merge"), F.col("doc_id") == F.col(f"{TMP}id"), "left_semi").select(*docs.columns)
    # rows whose id does not tell them apart: their group is known by the fingerprint
    shared = ids.where(F.col("n") > 1).select(F.col("doc_id").alias(f"{TMP}id"))
    rows = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(shared, F.col("doc_id") == F.col(f"{TMP}id"), "left_semi").select(*docs.columns))
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(f"{TMP}id"), F.col("fp").alias(f"{TMP}fp"), F.col("root").alias(f"{TMP}root")).distinct()
    heads = heads.where(F.col(f"{TMP}id").isNull()).unionByName(heads.join(shared, f"{TMP}id", "left_semi"))  # those of the other rows are not asked for
    plain = rows.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc_row"), "text", F.col("doc_id").alias("own_id"))
    hashed = plain.mapInArrow(_append_fingerprint, StructType([*plain.schema.fields]).add(f"{TMP}own", "long"))
    met = hashed.join(heads, (F.col(f"{TMP}own") == F.col(f"{TMP}fp")) & F.col("own_id").eqNullSafe(F.col(f"{TMP}id")))
    pick = met.groupBy(f"{TMP}root").agg(F.min(F.struct("text", "doc_row")).alias("first")).select("first.doc_row")
    rest = pick.select(*[F.col(f"doc_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return one.unionByName(rest)


def _append_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*batch.schema.names, f"{TMP}own"])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
