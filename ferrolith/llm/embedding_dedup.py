"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one vector kept of a group.

Vectors are compared only within a label. Equal vectors of a label are compared once, with their number. Centres are
fitted by spherical k-means on a bounded sample of the distinct vectors (``FIT_ROWS``), one for about ``CELL_ROWS`` of
them but ``LEAST_CELLS`` at least and ``MOST_CELLS`` at most. Every vector is at home in
the cell of its nearest centre and a guest in each cell that could be the home of a vector it links with: by the
angle between the vector and the plane that halves the way between two centres, and by the angle between the vector and the
cell's centre, which is at most that of the cell's widest member at home and the linking angle. Both bounds are exact, so every link
of a vector is found in its home cell, and no link is lost at a cell's border.

Within a cell, a vector closer to the centre than half the linking angle links with all others that are (the core):
their links are counted, not compared, so that a large group of near copies costs no products within itself. All
other members are compared in blocks of ``BLOCK`` vectors, as products of matrices in double precision; a block gives
counts of links and a forest that spans them, never the pairs. Components of the forests are the groups.

Clustered vectors are guests in few cells. Vectors spread evenly over many dimensions have no near and far cells for
any exact method: they are guests nearly everywhere, and the work is that of all pairs of a label, in blocks.

Defined cases: rows with null label or id, and vectors that are null, empty, all zero or hold a null or a component
that is not finite link with nothing; vectors of different length never link; rows that share an id each give a row and are linked
like other vectors; a component's id is the smallest of its rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.ann import usable
from ferrolith.llm.common import materialize
from ferrolith.llm.graph import connected_components

THRESHOLD = 0.93
#: Distinct vectors that the centres are fitted on, vectors for each cell, about, and bounds of the number of cells.
FIT_ROWS, CELL_ROWS, LEAST_CELLS, MOST_CELLS = 32_768, 16_384, 8, 4096
ITERATIONS = 6
#: Vectors on each side of one product, and rows that are multiplied in one step.
BLOCK, STEP = 2048, 256
#: Slack of the bounds, far above rounding.
SLACK = 1e-7

MEMBER = "label string, cell int, gid bigint, copies bigint, unit binary, home boolean, core boolean"


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit_centres(distinct: DataFrame, dim: int, n: int, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS, seed: int = 10) -> np.ndarray:
    """Unit centres for the distinct vectors of one length, of which there are ``n``."""
    own = distinct.where(F.col("dim") == dim).select("gid", "vector")
    if n > fit_rows:
        own = own.where(F.pmod(F.xxhash64("gid", F.lit(seed)), F.lit(1_000_000)) < max(1, int(1e6 * fit_rows / n)))
    table = own.toArrow()
    if not table.num_rows:
        return np.zeros((0, dim))
    units = _units(table.column("vector").combine_chunks(), dim)
    units = units[np.argsort(table.column("gid").to_numpy())]
    k = max(1, min(MOST_CELLS, max(LEAST_CELLS, n // cell_rows), len(units)))
    centres = units[np.random.default_rng(seed).permutation(len(units))[:k]].copy()
    for _ in range(ITERATIONS):
        near = (units @ centres.T).argmax(axis=1)
        for c in range(k):
            total = units[near == c].sum(axis=0)
            if (length := np.linalg.norm(total)) > 1e-9:
                centres[c] = total / length
    return centres


def _widest(shared):
    """For each cell, the greatest angle between its centre and a vector at home in it, as far as the task has met them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest = np.full(max((first + len(c) for c, first in shared.value.values()), default=0), -1.0)
        for whole in batches:
            dims = whole.column(0).to_numpy()
            for dim in np.unique(dims):
                vectors = whole.column(1).take(pa.array(np.flatnonzero(dims == dim)))
                centres, first = shared.value[int(dim)]
                for lo in range(0, len(vectors), 2000):
                    dots = _units(vectors.slice(lo, 2000), int(dim)) @ centres.T
                    home = dots.argmax(axis=1)
                    np.maximum.at(widest, first + home, np.arccos(np.clip(dots[np.arange(len(home)), home], -1, 1)))
        met = np.flatnonzero(widest >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(widest[met])], names=["cell", "angle"])

    return run


def cell_radii(distinct: DataFrame, shared) -> np.ndarray:
    """The widest angle of each cell; one number for a cell, below zero for one that is no vector's home."""
    found = distinct.select("dim", "vector").mapInArrow(_widest(shared), "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect()
    out = np.full(max((first + len(c) for c, first in shared.value.values()), default=0), -1.0)
    for row in found:
        out[row.cell] = row.angle
    return out


def _members(shared, radii, threshold: float):
    """Each distinct vector's row at home and its rows as a guest."""
    sine, half, link = math.sqrt(1 - threshold**2), math.cos(math.acos(threshold) / 2), math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(3).to_numpy()
            for dim in np.unique(dims):
                rows = whole.take(pa.array(np.flatnonzero(dims == dim)))
                centres, first = shared.value[int(dim)]
                radius = radii.value[first : first + len(centres)]
                reach = np.where(radius >= 0, np.cos(np.minimum(radius + link, math.pi)) - SLACK, 2.0)  # what a guest's cosine is at least
                for lo in range(0, rows.num_rows, 2000):
                    batch = rows.slice(lo, 2000)
                    units = _units(batch.column(4), int(dim))
                    dots = units @ centres.T
                    at = np.arange(len(units))
                    home = dots.argmax(axis=1)
                    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
                    guest = (dots[at, home][:, None] - dots <= (sine + SLACK) * apart[home]) & (dots >= reach)
                    guest[at, home] = True
                    r, c = np.nonzero(guest)
                    data = [u.tobytes() for u in units]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(pa.array(r)), pa.array((c + first).astype(np.int32)), batch.column(0).take(pa.array(r)), batch.column(2).take(pa.array(r)),
                         pa.array([data[i] for i in r], pa.binary()), pa.array(home[r] == c), pa.array(dots[r, c] >= half + SLACK)],
                        names=["label", "cell", "gid", "copies", "unit", "home", "core"],
                    )

    return run


def _compare(threshold: float):
    """Links between the home rows and the member rows of two blocks: counts for the home rows, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("home_side").to_numpy(zero_copy_only=False).astype(bool)
        gid, copies = table.column("gid").to_numpy(), table.column("copies").to_numpy()
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(table.num_rows, -1)
        order = np.argsort(gid, kind="stable")
        a, b = order[side[order]], order[~side[order]]
        counts = np.zeros(len(a), np.int64)
        edge_a, edge_b = [], []
        root = np.arange(len(b))  # of the member rows, within this block
        other, weight = units[b], copies[b]
        for lo in range(0, len(a), STEP):
            rows = a[lo : lo + STEP]
            near = units[rows] @ other.T >= threshold
            near &= gid[rows][:, None] != gid[b][None, :]
            counts[lo : lo + STEP] = near @ weight
            for i in np.flatnonzero(near.any(axis=1)):
                roots = np.unique(root[near[i]])
                edge_a += [gid[rows[i]]] * len(roots)
                edge_b += gid[b[roots]].tolist()
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
        linked = np.flatnonzero(counts)
        n = len(linked)
        return pa.table(
            [pa.array(np.concatenate((gid[a[linked]], np.asarray(edge_a, np.int64)))), pa.array(np.concatenate((np.full(n, -1), np.asarray(edge_b, np.int64)))), pa.array(np.concatenate((counts[linked], np.zeros(len(edge_a), np.int64))))],
            names=["gid", "other", "links"],
        )

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    takes_part = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector"))
    keyed = rows.select("vec_id", F.when(takes_part, F.col("label")).alias("label"), F.when(takes_part, F.col("vector")).alias("vector"))
    distinct = keyed.where(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.count("vec_id").alias("copies"), F.min("vec_id").alias("least"))
    distinct = materialize(distinct.withColumn("gid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")

    # vectors have few lengths; cells are numbered through
    centres, first = {}, 0
    for dim, n in sorted((r[0], r[1]) for r in distinct.groupBy("dim").count().collect()):
        centres[dim] = (fit_centres(distinct, dim, n, cell_rows=cell_rows), first)
        first += max(1, len(centres[dim][0]))
    shared = spark.sparkContext.broadcast(centres)
    radii = spark.sparkContext.broadcast(cell_radii(distinct, shared))
    members = materialize(distinct.select("gid", "label", "copies", "dim", "vector").mapInArrow(_members(shared, radii, threshold), MEMBER), "members")

    # rows of a cell go to blocks of their own kind; a pair of blocks is one product, but for two of the core
    sizes = members.groupBy("label", "cell").agg(
        *[(F.floor(F.count_if(F.col("core") == core) / block) + 1).cast("int").alias(f"all_{core}".lower()) for core in (True, False)],
        *[(F.floor(F.count_if(F.col("home") & (F.col("core") == core)) / block) + 1).cast("int").alias(f"home_{core}".lower()) for core in (True, False)],
        F.sum(F.when(F.col("core"), F.col("copies"))).alias("core_copies"), F.min(F.when(F.col("core"), F.col("gid"))).alias("core_least"), F.count_if("home").alias("n_home"),
    ).where(F.col("n_home") > 0)
    sized = members.join(sizes, ["label", "cell"])
    spread = lambda n: F.pmod(F.xxhash64("gid", F.lit(3)), n).cast("int")
    other = lambda core, wide: F.explode(F.sequence(F.lit(0), F.when(core, F.col(f"{wide}_true")).otherwise(F.col(f"{wide}_false")) - 1))
    columns = ["label", "cell", "home_core", "i", "all_core", "j", "home_side", "gid", "copies", "unit"]
    at_home = sized.where("home").withColumn("all_core", F.explode(F.when(F.col("core"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).withColumns({"home_core": F.col("core"), "home_side": F.lit(True)})
    at_home = at_home.withColumn("i", spread(F.when(F.col("core"), F.col("home_true")).otherwise(F.col("home_false")))).withColumn("j", other(F.col("all_core"), "all")).select(*columns)
    there = sized.withColumn("home_core", F.explode(F.when(F.col("core"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).withColumns({"all_core": F.col("core"), "home_side": F.lit(False)})
    there = there.withColumn("j", spread(F.when(F.col("core"), F.col("all_true")).otherwise(F.col("all_false")))).withColumn("i", other(F.col("home_core"), "home")).select(*columns)
    found = at_home.unionByName(there).groupBy(*columns[:6]).applyInArrow(_compare(threshold), "gid bigint, other bigint, links bigint")
    found = materialize(found, "links")

    in_core = sized.where(F.col("core")).select("gid", "core_least", F.when(F.col("home"), F.col("core_copies") - F.col("copies")).otherwise(0).alias("links"))
    counted = found.where(F.col("other") < 0).select("gid", "links").unionByName(in_core.select("gid", "links")).groupBy("gid").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("other") >= 0).select(F.col("gid").alias("a"), F.col("other").alias("b")).unionByName(in_core.select(F.col("gid").alias("a"), F.col("core_least").alias("b")))
    roots = connected_components(edges)
    named = distinct.join(counted, "gid", "left").join(roots, F.col("gid") == F.col("node"), "left").select("label", "vector", "copies", "least", F.coalesce("root", "gid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(ids, "root").select(F.col("label").alias("k_label"), F.col("vector").alias("k_vector"), "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    joined = keyed.join(known, (keyed["label"] == known["k_label"]) & (keyed["vector"] == known["k_vector"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every row of ``embeddings``."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
