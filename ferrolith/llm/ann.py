"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Rows are dealt to shards by a hash of their id, about ``SHARD_ROWS`` rows each. A shard's graph starts from random
edges; then every point is searched for greedily, and the points that the search visited are its proposed neighbours.
Robust pruning takes the nearest proposal, drops those that are nearer to it by the factor ``alpha`` than to the
point, and goes on, so that the edges kept are diverse; a few random edges stay for reach. Edges are also entered
at their other ends, which are pruned again when full. Queries meet each shard in blocks: a beam search gives the
best of the shard, and the best of all shards are the answer. Equal vectors of a shard are one point of its graph.

Nearness is the inner product. Inside a graph it is turned into a distance: one more coordinate brings all vectors to
the length of the shard's longest, and a query's is zero. Scores are inner products of the original vectors.

The index covers every row and is written to the shared folder. Searching is approximate (``BEAM`` wide); a test
holds its recall against brute force.

Defined cases: rows with a null id, and vectors that are null, empty, all zero or hold a null or a component that is
not finite take no part, neither as query nor as candidate; of rows that share an id the least vector counts; vectors of different length never
meet; equal scores go to the smaller id; a query with fewer than ``k`` candidates gets them all; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrolith.llm.common import materialize

K = 20
#: Rows of a shard and queries of a block, about: bounds of a task's memory. The index is sent once for each block of queries.
SHARD_ROWS, BLOCK_QUERIES = 8192, 32_768
DEGREE, RANDOM_EDGES, ALPHA = 24, 6, 1.2
BUILD_BEAM, BEAM = 48, 128
ENTRIES = 24
#: Points that are searched for or pruned in one step.
STEP = 256
FAR = np.float32(np.inf)

INDEX_SCHEMA = "dim int, shard int, node int, ids array<bigint>, vector array<double>, edges array<int>"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distances(points: np.ndarray, at: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances from each target to its own list of points."""
    x = points[at]
    x -= targets[:, None, :]
    return np.einsum("qkd,qkd->qk", x, x)


def beam_search(points: np.ndarray, edges: np.ndarray, targets: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each target the ``width`` nearest points met, nearest first, and their distances (-1 where there are fewer).

    All targets go one step at a time: each opens its nearest point that is not open yet and meets that point's edges.
    """
    n, q = len(points), len(targets)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    start = np.broadcast_to(entries, (q, len(entries)))
    seen[:, entries] = True
    ids = np.concatenate((start, np.full((q, max(0, width - start.shape[1])), -1)), axis=1).astype(np.int32)
    near = np.full(ids.shape, FAR)
    near[:, : start.shape[1]] = _distances(points, start, targets)
    order = np.argsort(near, axis=1)[:, :width]
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    done = near == FAR
    live = rows
    while len(live):
        first = done[live].argmin(axis=1)
        going = ~done[live, first]
        live, first = live[going], first[going]
        if not len(live):
            break
        done[live, first] = True
        met = edges[ids[live, first]]
        fresh = met >= 0
        np.logical_and(fresh, ~seen[live[:, None], met], out=fresh)
        some = fresh.any(axis=1)
        live_some, met, fresh = live[some], met[some], fresh[some]
        if not len(live_some):
            continue
        r, c = np.nonzero(fresh)
        own = met[r, c]
        seen[live_some[r], own] = True
        x = points[own] - targets[live_some[r]]
        far = np.full(met.shape, FAR)
        far[r, c] = np.einsum("kd,kd->k", x, x)
        all_ids = np.concatenate((ids[live_some], np.where(fresh, met, -1)), axis=1)
        all_near = np.concatenate((near[live_some], far), axis=1)
        all_done = np.concatenate((done[live_some], ~fresh), axis=1)
        order = np.argpartition(all_near, width - 1, axis=1)[:, :width]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(all_near, order, 1), axis=1), 1)
        ids[live_some], near[live_some], done[live_some] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_near, all_done))
    return ids, near


def robust_prune(points: np.ndarray, own: np.ndarray, proposals: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each of the points ``own`` out of its row of proposals (-1: none)."""
    q, c = proposals.shape
    valid = (proposals >= 0) & (proposals != own[:, None])
    ordered = np.sort(np.where(valid, proposals, -1), axis=1)
    valid = ordered >= 0
    valid[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
    x = points[ordered]
    near = x - points[own][:, None, :]
    near = np.where(valid, np.einsum("qkd,qkd->qk", near, near), FAR)
    out = np.full((q, degree), -1, np.int32)
    rows = np.arange(q)
    norms = np.einsum("qkd,qkd->qk", x, x)
    for k in range(degree):
        best = near.argmin(axis=1)
        some = near[rows, best] < FAR
        if not some.any():
            break
        out[some, k] = ordered[rows[some], best[some]]
        chosen = x[rows, best]
        between = norms + norms[rows, best][:, None] - 2 * np.einsum("qkd,qd->qk", x, chosen)
        near = np.where(alpha * alpha * between <= near, FAR, near)
        near[rows, best] = FAR
    return out


def build_graph(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the graph over ``points`` (points x degree, -1: none) and the entry points."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entries = np.unique(np.concatenate((rng.permutation(n)[: ENTRIES - 1], [np.einsum("nd,nd->n", points - points.mean(axis=0), points - points.mean(axis=0)).argmin()]))).astype(np.int32)
    if n <= DEGREE + 1:  # everything is a neighbour of everything
        whole = np.broadcast_to(np.arange(n, dtype=np.int32), (n, n)).copy()
        np.fill_diagonal(whole, -1)
        return np.concatenate((whole, np.full((n, DEGREE + RANDOM_EDGES - n if n < DEGREE + RANDOM_EDGES else 0), -1, np.int32)), axis=1)[:, : DEGREE + RANDOM_EDGES], entries
    random = rng.integers(0, n, (n, RANDOM_EDGES), dtype=np.int32)
    edges = np.concatenate((rng.integers(0, n, (n, DEGREE), dtype=np.int32), random), axis=1)
    order = rng.permutation(n)
    for lo in range(0, n, STEP):
        own = order[lo : lo + STEP]
        ids, _ = beam_search(points, edges, points[own], entries, BUILD_BEAM)
        edges[own, :DEGREE] = robust_prune(points, own, np.concatenate((ids, edges[own]), axis=1), DEGREE, ALPHA)
        # the other ends: a point's new visitors are added, and it is pruned when there are too many
        source = np.repeat(own, DEGREE)
        target = edges[own, :DEGREE].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max())
        visitors = np.full((len(nodes), most), -1, np.int32)
        visitors[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for at in range(0, len(nodes), STEP):
            part = nodes[at : at + STEP]
            wide = np.concatenate((edges[part, :DEGREE], visitors[at : at + STEP]), axis=1)
            edges[part, :DEGREE] = robust_prune(points, part, wide, DEGREE, ALPHA)
    return edges, entries


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def _augmented(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, so that all have the greatest length: near is then a large inner product."""
    square = np.einsum("nd,nd->n", vectors, vectors, dtype=np.float64)
    return np.concatenate((vectors.astype(np.float32), np.sqrt(np.maximum(square.max() - square, 0))[:, None].astype(np.float32)), axis=1)


def _build_shard(table: pa.Table) -> pa.Table:
    """A shard's rows (dim, shard, vec_id, vector) to rows of INDEX_SCHEMA: points with their edges."""
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("vector"), dim)
    by = np.lexsort((*vectors.T[::-1], ids))
    by = by[np.concatenate(([True], ids[by][1:] != ids[by][:-1]))]  # one row for an id
    ids, vectors = ids[by], vectors[by]
    _, first, point = np.unique(vectors + 0.0, axis=0, return_index=True, return_inverse=True)
    point = point.ravel()
    points = vectors[first]
    edges, entries = build_graph(_augmented(points))
    is_entry = np.zeros(len(points), np.int32)
    is_entry[entries] = 1
    order = np.argsort(point, kind="stable")  # ids ascend within a point
    offsets = np.concatenate(([0], np.cumsum(np.bincount(point, minlength=len(points))))).astype(np.int32)
    n = len(points)
    columns = [
        pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n, dtype=np.int32) * 2 + is_entry),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[order])), _lists(points, pa.float64()), _lists(edges, pa.int32()),
    ]
    return pa.table(columns, names=["dim", "shard", "node", "ids", "vector", "edges"])


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def _rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    found = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return found.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(F.size("vector").alias("dim"), "vec_id", "vector")


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of all usable rows, written to the shared folder: a row for each point; ``node`` is twice its number, odd for entry points."""
    rows = _rows(vectors, vec_id, vector)
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int"))
    index = dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build_shard, INDEX_SCHEMA)
    return materialize(index, "ann-index")


def _search_shard(k: int, beam: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        if not index.num_rows or not queries.num_rows:
            return empty
        dim = index.column("dim")[0].as_py()
        index = index.sort_by("node")
        points, edges = _matrix(index.column("vector"), dim), _matrix(index.column("edges"), DEGREE + RANDOM_EDGES, np.int32)
        lists = index.column("ids").combine_chunks()
        offsets, ids = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        entries = np.flatnonzero(index.column("node").to_numpy() & 1).astype(np.int32)
        own, vectors = queries.column("query_id").to_numpy(), _matrix(queries.column("vector"), dim)
        space = _augmented(points)
        targets = np.concatenate((vectors, np.zeros((len(vectors), 1))), axis=1).astype(np.float32)
        width, found = min(beam, max(len(points), 1)), []
        for lo in range(0, len(targets), STEP):
            part = slice(lo, lo + STEP)
            near, far = beam_search(space, edges, targets[part], entries, width)
            q, c = np.nonzero((near >= 0) & (far < FAR))
            node = near[q, c]
            score = np.einsum("kd,kd->k", points[node], vectors[part][q])
            # a point stands for its ids, of which the k + 1 smallest can be in an answer
            many = np.minimum(offsets[node + 1] - offsets[node], k + 1)
            at = np.repeat(offsets[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            q, score, vec = np.repeat(q, many), np.repeat(score, many), ids[at]
            other = vec != own[part][q]
            q, score, vec = q[other], score[other], vec[other]
            by = np.lexsort((vec, -score, q))
            q, score, vec = q[by], score[by], vec[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            best = place < k
            found.append((own[part][q[best]], vec[best], score[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, vec_id: str = "vec_id", vector: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` best of the index for each query, without the query's own id: query_id, rank, vec_id, score."""
    rows = _rows(queries, vec_id, vector)
    rows = materialize(rows.groupBy("dim", F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "ann-queries")
    least = Window.partitionBy("query_id").orderBy("dim")  # of ids with vectors of several lengths, the shortest
    rows = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") == 1).drop("n")
    blocks = max(1, -(-rows.count() // block_queries))
    shards = index.agg(F.max("shard")).first()[0]
    if shards is None:
        return index.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = rows.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(8)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search_shard(k, beam), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` for every row whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.where(F.col("vec_id") % 20 == 0))
