"""A Merkle manifest of a dataset: one tree for each group of rows, one tree over the groups, a proof for each row.

Leaves are sorted by group and key into ranges (``ordering``), and the counts of each group in each range give every leaf its place.
A task climbs from the leaves it meets, in runs of consecutive places of at most 2 ** ``LOCAL`` leaves: it builds all subtrees that lie
whole in its run. Only their tops go on, the ragged ones at the borders of runs too: they are shuffled by coordinate (group and place
above), and a round finishes ``ROUND`` levels more inside each block. Rounds grow with the logarithm of the largest
group. The groups' roots are leaves of the same kind of tree.

A node is the sha256 of its children's digests as hex text; the last node of a level may have one child. A leaf's
proof is the digests beside its path, from its level up to the root; where its path has no neighbour, nothing is added.

Defined cases: a null value is written ``-``, others as UTF-8 length, colon, value; a null group is a group of its own and comes
first, and so does a null key in its group; rows of one key are in order of their digests (equal rows are leaves of
their own); a group of one row has its leaf as root, and so has a single group; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolith.llm.common import TMP, materialize
from ferrolith.llm.ordering import range_sorted, with_places

#: Levels of a tree that are built inside a run of leaves, and in each round after that.
LOCAL, ROUND = 14, 10
#: Which documents the verification tampers with: crc32 of the id, modulo.
TAMPER = 7
PLACE, SIZE = f"{TMP}place", f"{TMP}size"


def parent(children: bytes) -> bytes:
    """The digest over one or two digests, which are hashed as hex text."""
    return hashlib.sha256(hexlify(children)).digest()


def width(size: int, level: int) -> int:
    """Nodes of a level in a tree over ``size`` leaves."""
    return (size + (1 << level) - 1) >> level


def climb(first: int, digests: list[bytes], size: int, most: int) -> list[tuple[int, list[bytes]]]:
    """All nodes that lie whole over the leaves from place ``first`` on: for each level its first index and digests, up to level ``most``."""
    levels = [(first, digests)]
    for level in range(most):
        lo, nodes = levels[-1]
        count = width(size, level)
        if count <= 1:
            break
        odd = lo & 1  # its neighbour lies before the run
        ends = lo + len(nodes) == count
        pairs = nodes[odd:]
        if len(pairs) & 1 and not ends:
            pairs = pairs[:-1]
        if not pairs:
            break
        levels.append(((lo + odd) >> 1, [parent(b"".join(pairs[i : i + 2])) for i in range(0, len(pairs), 2)]))
    return levels


def paths(levels: list[tuple[int, list[bytes]]]) -> tuple[list[bytes], list[int]]:
    """For each leaf of ``climb``: the digests beside its path up to the highest node found, and that node's level."""
    above: list[bytes] = []
    tops: list[int] = []
    lo_above = 0
    for level in range(len(levels) - 1, -1, -1):
        lo, nodes = levels[level]
        path, top = [], []
        for k, _ in enumerate(nodes):
            up = ((lo + k) >> 1) - lo_above
            if 0 <= up < len(above):
                beside = ((lo + k) ^ 1) - lo
                path.append((nodes[beside] if 0 <= beside < len(nodes) else b"") + above[up])
                top.append(tops[up])
            else:
                path.append(b"")
                top.append(level)
        above, tops, lo_above = path, top, lo
    return above, tops


def _run_tops(first: int, digests: list[bytes], size: int, most: int):
    """Path, top level, top index of each leaf of a run, and the top's digest beside the first leaf below it."""
    levels = climb(first, digests, size, most)
    path, level = paths(levels)
    index = [(first + k) >> up for k, up in enumerate(level)]
    top = [levels[up][1][i - levels[up][0]] if k == 0 or (up, i) != (level[k - 1], index[k - 1]) else None for k, (up, i) in enumerate(zip(level, index, strict=True))]
    return path, level, index, top


def _cuts(batch: pa.RecordBatch, last: tuple[int, int, int] | None, most: int) -> np.ndarray:
    """Rows of the batch at which a run begins: places or group go on from elsewhere, or a block of 2 ** most leaves begins."""
    at = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (f"{TMP}part", f"{TMP}first", PLACE)]
    before = [np.concatenate(([x], a[:-1])) for x, a in zip(last or (-1, -1, -2), at, strict=True)]
    return np.flatnonzero((at[0] != before[0]) | (at[1] != before[1]) | (at[2] != before[2] + 1) | (at[2] & ((1 << most) - 1) == 0))


def _local(most: int):
    """Climbs over runs; the rows pass through with path and top beside them."""

    def finish(pending: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
        col = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
        digests = [unhexlify(x) for x in col["leaf"].to_pylist()]
        path, level, index, top = _run_tops(col[PLACE][0].as_py(), digests, col[SIZE][0].as_py(), most)
        extra = {"path": pa.array(path, pa.binary()), "level": pa.array(level, pa.int32()), "index": pa.array(index, pa.int64()), "top": pa.array(top, pa.binary())}
        yield pa.RecordBatch.from_arrays([*rows.columns, *extra.values()], names=[*rows.schema.names, *(f"{TMP}{n}" for n in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            for cut in [*_cuts(batch, last, most).tolist(), batch.num_rows]:
                if cut > at:
                    pending.append(batch.slice(at, cut - at))
                if pending and cut < batch.num_rows:
                    yield from finish(pending)
                    pending = []
                at = cut
            last = tuple(batch.column(batch.schema.get_field_index(c))[-1].as_py() for c in (f"{TMP}part", f"{TMP}first", PLACE))
        if pending:
            yield from finish(pending)

    return run


def _block(goal: int):
    """Finishes a block up to level ``goal``, or the root of its tree: the path of each node in it, and its top."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        size = int(nodes["size"].iloc[0])
        found = {(level, index): digest for level, index, digest in zip(nodes["level"], nodes["index"], nodes["top"], strict=True)}
        begun = {}
        for level, index in found:
            begun.setdefault(level, []).append(index)
        level, now = min(begun), []
        while level < goal and width(size, level) > 1:
            now = sorted({*now, *begun.get(level, [])})
            for up in sorted({i >> 1 for i in now}):
                found[level + 1, up] = parent(b"".join(found[level, i] for i in (2 * up, 2 * up + 1) if (level, i) in found))
            now, level = sorted({i >> 1 for i in now}), level + 1
        path = []
        for at, index in zip(nodes["level"], nodes["index"], strict=True):
            path.append(b"".join(found.get((up, (index >> (up - at)) ^ 1), b"") for up in range(at, level)))
        index = int(nodes["index"].iloc[0]) >> (level - int(nodes["level"].iloc[0]))
        return nodes[["group", "size", "level", "index"]].assign(path=path, up_level=level, up_index=index, up_top=found[level, index])

    return run


def _rounds(nodes: DataFrame, goal: int) -> tuple[DataFrame, DataFrame]:
    """From tops (group, size, level, index, top) to the trees' roots: the rest of each top's path, and the roots (group, size, root)."""
    group_type = nodes.schema["group"].dataType.simpleString()
    shape = f"group {group_type}, size bigint, level int, index bigint, path binary, up_level int, up_index bigint, up_top binary"
    most = nodes.agg(F.max("size")).first()[0] or 0
    rest, chain = None, []
    while True:
        block = F.expr(f"shiftright(index, {goal} - level)")
        rest = materialize(nodes.groupBy("group", block.alias("block")).applyInPandas(_block(goal), shape), "merkle-round")
        chain.append(rest)
        nodes = rest.select("group", "size", F.col("up_level").alias("level"), F.col("up_index").alias("index"), F.col("up_top").alias("top")).distinct()
        if width(most, goal) <= 1:
            break
        goal += ROUND
    rest = chain.pop()
    while chain:
        upper = rest.select(F.col("group").alias("g"), F.col("level").alias("l"), F.col("index").alias("i"), F.col("path").alias("p"))
        lower = chain.pop()
        same = lower["group"].eqNullSafe(F.col("g")) & (F.col("up_level") == F.col("l")) & (F.col("up_index") == F.col("i"))
        rest = materialize(lower.join(upper, same).select("group", "level", "index", F.concat("path", "p").alias("path")), "merkle-paths")
    return rest.select("group", "level", "index", "path"), nodes.select("group", "size", F.col("top").alias("root"))


def _tree(leaves: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over ``leaf`` (hex) of each group: leaves with the lower part of their paths, the tops' upper parts, the roots."""
    placed = with_places(range_sorted(leaves, [F.col(group), *order], "merkle-leaves"), group)
    placed = placed.sortWithinPartitions(f"{TMP}part", f"{TMP}row")  # where the offsets were joined by a shuffle
    shape = T.StructType(placed.schema.fields + T._parse_datatype_string(f"{TMP}path binary, {TMP}level int, {TMP}index bigint, {TMP}top binary").fields)
    low = materialize(placed.mapInArrow(_local(LOCAL), shape), "merkle-low")
    tops = low.where(F.col(f"{TMP}top").isNotNull()).select(
        F.col(group).alias("group"), F.col(SIZE).alias("size"), F.col(f"{TMP}level").alias("level"), F.col(f"{TMP}index").alias("index"), F.col(f"{TMP}top").alias("top")
    )
    return low, *_rounds(tops, LOCAL + ROUND)


def digest(*values: Column) -> Column:
    """sha256, as hex, of the values in a row: ``-`` for null, else length in bytes, colon, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def manifest(leaves: DataFrame, group: str, key: str) -> DataFrame:
    """``leaves`` (group, key, leaf as hex, others) with place, size, subroot, group_place, groups, root and proof.

    ``proof`` is the digests beside the leaf's path in its group's tree and then beside the group's in the upper one, 32 bytes each.
    """
    leaves = materialize(leaves, "merkle-input")
    low, upper, roots = _tree(leaves, group, [F.col(key), F.col("leaf")])
    subroots = roots.select("group", F.lower(F.hex("root")).alias("leaf"), F.lit(0).alias("all"))
    top_low, top_upper, top_root = _tree(subroots, "all", [F.col("group")])
    at = [F.col(f"{TMP}level") == F.col("level"), F.col(f"{TMP}index") == F.col("index")]
    of_group = top_low.join(top_upper.drop("group"), at[0] & at[1]).select(
        F.col("group").alias("g"), F.unhex("leaf").alias("subroot"), F.col(PLACE).alias("group_place"), F.col(SIZE).alias("groups"), F.concat(f"{TMP}path", "path").alias("above")
    )
    root = top_root.select("root").first()
    ends = upper.join(of_group, F.col("group").eqNullSafe(F.col("g"))).drop("g")
    ends = materialize(ends.select(F.col("group").alias(f"{TMP}g"), "level", "index", F.concat("path", "above").alias("rest"), "subroot", "group_place", "groups"), "merkle-ends")
    joined = low.join(ends, F.col(group).eqNullSafe(F.col(f"{TMP}g")) & at[0] & at[1])
    kept = [c for c in leaves.columns]
    return joined.select(
        *kept, F.col(PLACE).alias("place"), F.col(SIZE).alias("size"), F.lower(F.hex("subroot")).alias("subroot"), "group_place", "groups",
        F.lit(root.root.hex() if root else None).cast("string").alias("root"), F.concat(f"{TMP}path", "rest").alias("proof"),
    )


def fold(leaf: bytes, proof: bytes, steps: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its proof give; ``steps`` are place and size in each tree, lowest first."""
    at = 0
    for place, size in steps:
        while size > 1:
            beside = proof[at : at + 32] if place ^ 1 < size else b""
            at += len(beside)
            leaf = parent(beside + leaf if place & 1 else leaf + beside)
            place, size = place >> 1, (size + 1) >> 1
    return leaf


def fold_proofs(rows: DataFrame, leaf: str) -> DataFrame:
    """``manifest`` rows with proof_sha256 and the root folded from the column ``leaf`` and the proof."""
    need = [leaf, "proof", "place", "size", "group_place", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in need]
            sums, folded = [], []
            for start, proof, place, size, group_place, groups in zip(*columns, strict=True):
                sums.append(parent(proof).hex())
                folded.append(fold(unhexlify(start), proof, [(place, size), (group_place, groups)]).hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(folded)], names=[*batch.schema.names, "proof_sha256", "folded_root"])

    text = [T.StructField(n, T.StringType()) for n in ("proof_sha256", "folded_root")]
    return rows.mapInArrow(run, T.StructType(rows.schema.fields + text))


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and the leaf of the tampered row, where the verification tampers with it."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    forged = digest(*columns[:3], F.col("n_chars") + 1, columns[4])
    return docs.select("doc_id", "lang", digest(*columns).alias("leaf"), F.when(chosen & F.col("n_chars").isNotNull(), forged).alias("forged"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by language, and what its proofs say of tampered rows."""
    leaves = document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = manifest(leaves, "lang", "doc_id").withColumn("shown", F.coalesce("forged", "leaf"))
    folded = fold_proofs(rows, "shown")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


#: crc32 of the ids bit by bit, leaves, then levels by recursion: rows are one node a level, with the digests beside each leaf's path.
OP12_SQL = """
with recursive d as (
  select doc_id, lang, n_chars, source, text, ''||doc_id as key, row_number() over (partition by lang order by doc_id) - 1 as place,
    row_number() over () as rid from documents),
steps as (select list(c order by i) as t from (
  select i, list_reduce([i::bigint] || range(8), lambda x, b: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) as c from range(256) r(i))),
bits as (select d.*, xor(list_reduce([4294967295::bigint] || list_transform(string_split(key, ''), lambda c: ascii(c)::bigint),
  lambda x, c: xor(x // 256, t[(xor(x, c) & 255) + 1])), 4294967295) as crc from d, steps),
hashed as (select rid, doc_id, lang, place, crc,
  sha256(enc_id || enc_source || enc_lang || coalesce(strlen(''||n_chars) || ':' || n_chars, '-') || enc_text) as leaf,
  sha256(enc_id || enc_source || enc_lang || coalesce(strlen(''||(n_chars + case when crc % 7 = 0 then 1 else 0 end)) || ':' || (n_chars + case when crc % 7 = 0 then 1 else 0 end), '-') || enc_text) as shown
  from (select *, coalesce(strlen(key) || ':' || key, '-') as enc_id, coalesce(strlen(source) || ':' || source, '-') as enc_source,
    coalesce(strlen(lang) || ':' || lang, '-') as enc_lang, coalesce(strlen(text) || ':' || text, '-') as enc_text from bits)),
nodes as (
  select lang, 0 as level, place, leaf as node, count(*) over (partition by lang) as n from hashed
  union all
  select lang, level + 1, place // 2, sha256(node || coalesce(beside, '')), (n + 1) // 2 from (
    select *, lead(node) over (partition by lang order by place) as beside from nodes where n > 1) where place % 2 = 0),
roots as (select lang, node as subroot, level as height, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as groups from nodes where n = 1),
upper_nodes as (
  select 0 as level, place, subroot as node, groups as n from roots
  union all
  select level + 1, place // 2, sha256(node || coalesce(beside, '')), (n + 1) // 2 from (
    select *, lead(node) over (order by place) as beside from upper_nodes where n > 1) where place % 2 = 0),
folds as (
  select rid, h.lang, 0 as level, h.place, shown as node, ''as proof, r.height, r.place as up, r.height + (select max(level) from upper_nodes) as total
  from hashed h join roots r on h.lang is not distinct from r.lang
  union all
  select f.rid, f.lang, f.level + 1, case when f.level + 1 = f.height then f.up when f.level < f.height then f.place // 2 else f.place // 2 end,
    case when s.node is null then sha256(f.node) when f.place % 2 = 1 then sha256(s.node || f.node) else sha256(f.node || s.node) end,
    f.proof || coalesce(s.node, ''), f.height, f.up, f.total
  from folds f left join (
    select lang, level, place, node, true as low from nodes union all select null, level, place, node, false from upper_nodes) s
  on s.low = (f.level < f.height) and (not s.low or s.lang is not distinct from f.lang)
    and s.level = case when s.low then f.level else f.level - f.height end and s.place = xor(f.place, 1)
  where f.level < f.total)
select h.doc_id, h.leaf, r.subroot, t.node as root, sha256(f.proof) as proof_sha256, f.node as folded_root, f.node = t.node as verified
from folds f join hashed h using (rid) join roots r on h.lang is not distinct from r.lang, (select node from upper_nodes where n = 1) t
where f.level = f.total
"""
