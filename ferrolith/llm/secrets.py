"""Secrets in whole texts: fixed formats, and what looks like them by inferred grammars.

Three fixed patterns (``assign``, ``access``, ``hex``) find credentials whose kind they name. Those are the labelled credentials. For each
kind the prefixes of its values are counted; prefixes are merged where Hoeffding bounds do not tell their
futures apart, until a probabilistic automaton is left; long runs of credential characters outside of any match give the automaton
of ordinary text. Every such run in every text is then scored: the logarithm of the best kind's likelihood over ordinary text's, for
each symbol. A run over its kind's threshold is a span of kind ``like_assign``, ``like_access`` or ``like_hex``.

All distinct values in all texts take part, whole and whatever their number: tasks count prefixes, then every step of every value through the
merged automaton, then scores in narrow bins. The driver and the tasks that merge see only prefixes that enough values share, states and bins.

Thresholds come from values that the automata were not fitted on, one in ``HELD_OUT``: halfway between what ``MISSED`` of the kind's values stay below and
what ``FALSE`` of ordinary runs stay above, but neither under the latter nor under zero.

Parameters: a prefix has a state of its own only if ``FEWEST`` values and one in ``FINEST`` share it, over at most ``sum(WIDTHS)`` symbols, and if its future
differs by over ``APART`` from those of all other states; so that automata stay small, whatever they are counted on. A kind with under ``LEAST`` values has
none and adds nothing. Prefixes are told apart by 64-bit hashes.

Positions are code points, ends exclusive. Letters of keywords match in either ASCII case.

Defined cases: null and empty texts have no spans; a null id passes through; repeated rows are scanned one by one; an empty
table gives no rows; runs of any length are scored whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.buffers import byte_class, runs, steps
from ferrolith.llm.common import TMP, materialize

KINDS = ("assign", "access", "hex")
OTHER = "other"
LIKE = tuple(f"like_{k}" for k in KINDS)
#: Fixed patterns and lengths of the labelled formats.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_MARK = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS_MARK = b"AKIA"
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
#: Characters of a credential.
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-"
CREDENTIAL, ACCESS, HEX = byte_class(SYMBOLS), byte_class(SYMBOLS[:36]), byte_class("0123456789abcdef")
#: Runs of at least so many characters are scored.
CANDIDATE = 16

#: Values that make a kind; values that share a prefix with a state of its own, at least and as a part of all.
LEAST, FEWEST, FINEST = 20, 3, 1_024
#: Symbols by which the counted prefixes grow, round by round.
WIDTHS = (8, 16, 32, 64, 128)
#: One value in so many is held out of the fit and sets the threshold.
HELD_OUT = 4
#: Error of the test that tells two states apart.
ALPHA = 0.01
#: Shares that differ by no more are alike, however many values they come from.
APART = 0.05
#: Scores are counted in bins of one in so many.
BINS = 4_096
MISSED, FALSE = 0.05, 0.001

END = len(SYMBOLS)
CODE = np.full(256, END, np.uint8)
CODE[list(SYMBOLS.encode())] = np.arange(len(SYMBOLS))


@dataclass
class Automaton:
    """Target state and log probability of each symbol in each state; the last column is the end."""

    target: np.ndarray
    logp: np.ndarray


@dataclass
class Tree:
    """Of each node: edges (symbol to [child, count]), visits and ends, and whether what follows it was counted."""

    edges: list[dict[int, list[int]]]
    visits: list[int]
    ends: list[int]
    known: list[bool]


def prefix_tree(values: list[bytes]) -> Tree:
    """The whole tree of some values."""
    edges, visits, ends = [{}], [0], [0]
    for value in values:
        at = 0
        visits[0] += 1
        for symbol in CODE[np.frombuffer(value, np.uint8)].tolist():
            edge = edges[at].get(symbol)
            if edge is None:
                edge = edges[at][symbol] = [len(edges), 0]
                edges.append({})
                visits.append(0)
                ends.append(0)
            edge[1] += 1
            at = edge[0]
            visits[at] += 1
        ends[at] += 1
    return Tree(edges, visits, ends, [True] * len(edges))


def merge(tree: Tree, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Targets and counts of the automaton: nodes, most visited first, are merged with the first state that is compatible.

    A node with an unknown future goes where most that leave the same state go.
    """
    edges, visits, ends, known = tree.edges, tree.visits, tree.ends, tree.known
    reach = (0.5 * np.log(2 / alpha)) ** 0.5

    def compatible(one: int, two: int) -> bool:
        todo = [(one, two)]
        while todo:
            a, b = todo.pop()
            if not (known[a] and known[b]):
                continue
            bound = max(APART, reach * (visits[a] ** -0.5 + visits[b] ** -0.5))
            if bound >= 1:
                continue  # too few visits to tell anything apart, here or below
            if abs(ends[a] / visits[a] - ends[b] / visits[b]) > bound:
                return False
            for symbol in edges[a].keys() | edges[b].keys():
                to_a, to_b = edges[a].get(symbol), edges[b].get(symbol)
                if abs((to_a[1] if to_a else 0) / visits[a] - (to_b[1] if to_b else 0) / visits[b]) > bound:
                    return False
                if to_a and to_b and to_a[0] != to_b[0]:
                    todo.append((to_a[0], to_b[0]))
        return True

    def fold(into: int, node: int) -> None:
        todo = [(into, node)]
        while todo:
            a, b = todo.pop()
            if not known[b]:
                continue
            if not known[a]:
                known[a], visits[a], ends[a] = True, 0, 0
            visits[a] += visits[b]
            ends[a] += ends[b]
            for symbol, (child, count) in edges[b].items():
                edge = edges[a].get(symbol)
                if edge is None:
                    edges[a][symbol] = [child, count]
                else:
                    edge[1] += count
                    todo.append((edge[0], child))

    kept = [0]
    while True:
        inside = set(kept)
        fringe = [(visits[to], state, symbol) for state in kept for symbol, (to, _) in edges[state].items() if to not in inside and known[to]]
        if not fringe:
            break
        _, state, symbol = max(fringe, key=lambda f: (f[0], -f[1], -f[2]))
        new = edges[state][symbol][0]
        match = next((k for k in kept if compatible(k, new)), None)
        if match is None:
            kept.append(new)
        else:
            edges[state][symbol][0] = match
            fold(match, new)
    number = {state: i for i, state in enumerate(kept)}
    target = np.repeat(np.arange(len(kept))[:, None], END + 1, 1)  # a symbol never seen leaves the state as it is
    count = np.zeros((len(kept), END + 1))
    for state, i in number.items():
        count[i, END] = ends[state]
        went = np.zeros(len(kept))
        for to, n in edges[state].values():
            if to in number:
                went[number[to]] += n
        most = int(went.argmax()) if went.any() else i
        for symbol, (to, n) in edges[state].items():
            target[i, symbol], count[i, symbol] = number.get(to, most), n
    return target.astype(np.int32), count


def automaton_of(target: np.ndarray, count: np.ndarray) -> Automaton:
    share = (count + 1 / (END + 1)) / (count.sum(1, keepdims=True) + 1)
    return Automaton(target, np.log(share))


def infer(values: list[bytes], alpha: float = ALPHA) -> Automaton:
    """The automaton of a few values at hand, by their whole tree."""
    return automaton_of(*merge(prefix_tree(values), alpha))


def steps_taken(target: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often the spans [start, end), with their end, leave each state by each symbol."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    state, width = np.zeros(len(at), np.int64), END + 1
    total = np.zeros(len(target) * width, np.int64)
    shared = int(size[min(len(size) - 1, 8)]) if len(size) else 0
    for k in range(shared):
        n = int(np.searchsorted(-size, -k, side="left"))
        symbol = CODE[data[at[:n] + k]]
        np.add.at(total, state[:n] * width + symbol, 1)
        state[:n] = target[state[:n], symbol]
    for i in np.flatnonzero(size > shared).tolist():
        s, left = int(state[i]), CODE[data[at[i] + shared : at[i] + size[i]]]
        for symbol in left.tolist():
            total[s * width + symbol] += 1
            s = int(target[s, symbol])
        state[i] = s
    np.add.at(total, state * width + END, 1)
    return total.reshape(-1, width)


def log_likelihood(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the byte spans [start, end), with their end: all spans advance together, a symbol of each at a time, longest first."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    state, total = np.zeros(len(at), np.int32), np.zeros(len(at))
    shared = int(size[min(len(size) - 1, 8)]) if len(size) else 0  # beyond this length fewer than nine spans go on: one by one
    for k in range(shared):
        n = int(np.searchsorted(-size, -k, side="left"))
        symbol = CODE[data[at[:n] + k]]
        total[:n] += automaton.logp[state[:n], symbol]
        state[:n] = automaton.target[state[:n], symbol]
    if len(size) and size[0] > shared:
        target, logp = automaton.target.tolist(), automaton.logp.tolist()
        for i in np.flatnonzero(size > shared).tolist():
            s, t = int(state[i]), float(total[i])
            for symbol in CODE[data[at[i] + shared : at[i] + size[i]]].tolist():
                t += logp[s][symbol]
                s = target[s][symbol]
            state[i], total[i] = s, t
    out = np.empty(len(at))
    out[order] = total + automaton.logp[state, END]
    return out


@dataclass
class Grammars:
    """Automata by kind, that of ordinary text, and the thresholds by kind; kinds without an automaton are absent."""

    kinds: dict[str, Automaton]
    other: Automaton | None
    thresholds: dict[str, float]

    def ratios(self, kind: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihood of the kind over that of ordinary text, for each symbol."""
        size = ends - starts + 1
        other = log_likelihood(self.other, data, starts, ends) if self.other else -size * np.log(END + 1)
        return (log_likelihood(self.kinds[kind], data, starts, ends) - other) / size


@dataclass
class Found:
    """Spans in a step's bytes: text, kind (by number), start and end; for ``assign`` also where the value starts."""

    text: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray


def base_spans(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Found:
    """Leftmost matches of the fixed patterns that do not overlap, for each kind."""
    found: list[tuple[int, int, int, int, int]] = []
    marked = pc.fill_null(pc.match_substring_regex(texts, ASSIGN_MARK, ignore_case=True), False)
    for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
        at = int(offsets[i])
        for m in ASSIGN.finditer(data[at : offsets[i + 1]].tobytes()):
            if m.end(2) - m.start(2) >= SHORTEST["assign"]:
                found.append((i, 0, at + m.start(), at + m.end(), at + m.start(2)))
    text_of = lambda starts: np.searchsorted(offsets, starts, side="right") - 1
    starts, ends = runs(ACCESS[data], offsets)
    long = ends - starts >= SHORTEST["access"]
    for start, end, i in zip(starts[long].tolist(), ends[long].tolist(), text_of(starts[long]).tolist(), strict=True):
        at = data[start:end].tobytes().find(ACCESS_MARK)
        if 0 <= at <= end - start - SHORTEST["access"]:
            found.append((i, 1, start + at, end, start + at))
    starts, ends = runs(HEX[data], offsets)
    long = ends - starts >= SHORTEST["hex"]
    starts, ends = starts[long], ends[long]
    rows = np.concatenate((np.asarray(found, np.int64).reshape(-1, 5), np.stack((text_of(starts), np.full(len(starts), 2), starts, ends, starts), 1)))
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2]))]
    return Found(*rows.T)


def candidates(data: np.ndarray, offsets: np.ndarray, base: Found) -> tuple[np.ndarray, np.ndarray]:
    """Long runs of credential characters, without full stops around them, that no base span touches."""
    starts, ends = runs(CREDENTIAL[data], offsets)
    long = ends - starts >= CANDIDATE
    starts, ends = starts[long], ends[long]
    dot = np.frombuffer(b".", np.uint8)[0]
    while (at := np.flatnonzero((data[ends - 1] == dot) & (ends > starts))).size:
        ends[at] -= 1
    while (at := np.flatnonzero((ends > starts) & (data[np.minimum(starts, len(data) - 1)] == dot))).size:
        starts[at] += 1
    # base spans are in order of their starts; the furthest end so far tells whether one reaches into a run
    reach = np.concatenate(([0], np.maximum.accumulate(base.end))) if len(base.end) else np.zeros(1, np.int64)
    free = reach[np.searchsorted(base.start, ends, side="left")] <= starts
    free &= ends - starts >= CANDIDATE
    return starts[free], ends[free]


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every value of each kind, whole."""
    for batch in batches:
        texts = batch.column(0)
        for lo, hi, data, offsets in steps(texts):
            base = base_spans(texts.slice(lo, hi - lo), data, offsets)
            kinds = [KINDS[k] for k in base.kind.tolist()]
            values = [data[a:b].tobytes() for a, b in zip(base.value.tolist(), base.end.tolist(), strict=True)]
            values += [data[a:b].tobytes() for a, b in zip(*map(np.ndarray.tolist, candidates(data, offsets, base)), strict=True)]
            kinds += [OTHER] * (len(values) - len(kinds))
            hashes = [xxhash.xxh3_64_intdigest(v) >> 1 for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.binary()), pa.array(hashes, pa.int64())], names=["kind", "value", "hash"])


def labelled_values(docs: DataFrame) -> DataFrame:
    """kind, value, hash: all distinct labelled values of each kind, and runs of ordinary text."""
    return docs.select("text").mapInArrow(_values, "kind string, value binary, hash bigint").distinct()


def _by_kind(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind in a batch (kind, value, ...): its rows, the bytes of its values, and each value's span."""
    for kind in pc.unique(batch.column(0)).to_pylist():
        rows = batch.filter(pc.equal(batch.column(0), kind))
        values = rows.column(1).to_pylist()
        ends = np.cumsum([0, *map(len, values)])
        yield kind, rows, np.frombuffer(b"".join(values), np.uint8), ends[:-1], ends[1:]


def _mixed(node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a prefix and one more symbol."""
    h = (node ^ (symbol.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


NODES = "kind string, parent bigint, node bigint, symbol int, depth int, visits bigint"


def _prefixes(values: DataFrame, front: dict[str, np.ndarray], depth: int, width: int) -> DataFrame:
    """How many of the values go through each prefix of up to ``width`` symbols more than those of the ``front``, of ``depth`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, _, data, starts, ends in _by_kind(batch):
                if kind not in front:
                    continue
                at, left = starts[ends - starts > depth], ends[ends - starts > depth]
                node = np.zeros(len(at), np.uint64)
                for k in range(depth):
                    node = _mixed(node, CODE[data[at + k]])
                inside = np.isin(node, front[kind])
                at, left, node = at[inside] + depth, left[inside], node[inside]
                for k in range(depth + 1, depth + width + 1):
                    symbol, parent = CODE[data[at]], node
                    node = _mixed(node, symbol)
                    found, first, n = np.unique(node, return_index=True, return_counts=True)
                    columns = [pa.array([kind] * len(found), pa.string()), *(pa.array(x.view(np.int64)) for x in (parent[first], found)), pa.array(symbol[first].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(found), k, np.int32)), pa.array(n.astype(np.int64))], names=["kind", "parent", "node", "symbol", "depth", "visits"])
                    at = at + 1
                    more = at < left
                    at, left, node = at[more], left[more], node[more]
                    if not len(at):
                        break

    found = values.select("kind", "value").mapInArrow(run, NODES)
    return found.groupBy("kind", "node").agg(*[F.min(c).alias(c) for c in ("parent", "symbol", "depth")], F.sum("visits").alias("visits")).select("kind", "parent", "node", "symbol", "depth", "visits")


def shared_prefixes(values: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The nodes that enough of all values go through, and their children, whatever these have: ``NODES``, total and known (a node with children)."""
    least = F.create_map(*[F.lit(x) for kind, n in sizes.items() for x in (kind, max(FEWEST, -(-n // FINEST)))])[F.col("kind")]
    total = F.create_map(*[F.lit(x) for kind, n in sizes.items() for x in (kind, n)])[F.col("kind")]
    front, depth, parts = {kind: np.zeros(1, np.uint64) for kind in sizes}, 0, []
    for width in WIDTHS:
        nodes = materialize(_prefixes(values, front, depth, width), "secret-prefixes")
        often = nodes.where(F.col("visits") >= least)
        parents = often.select(F.col("kind").alias(f"{TMP}kind"), F.col("node").alias(f"{TMP}node"))
        below = nodes.where(F.col("depth") > depth + 1).join(parents, (F.col("kind") == F.col(f"{TMP}kind")) & (F.col("parent") == F.col(f"{TMP}node")), "left_semi")
        parts.append(nodes.where(F.col("depth") == depth + 1).unionByName(below))
        depth += width
        ahead: dict[str, list[int]] = {}
        for row in often.where(F.col("depth") == depth).select("kind", "node").collect():  # at most FINEST of a kind
            ahead.setdefault(row.kind, []).append(row.node)
        front = {kind: np.sort(np.asarray(n, np.int64).view(np.uint64)) for kind, n in ahead.items()}
        if not front:
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("*", total.cast("bigint").alias("total"), ((F.col("visits") >= least) & (F.col("depth") < depth)).alias("known"))


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One kind's targets, a row for each state."""
    rows = rows.sort_values(["depth", "parent", "symbol"])
    number = {0: 0} | {node: i for i, node in enumerate(rows["node"].tolist(), 1)}
    tree = Tree([{} for _ in number], [int(rows["total"].iloc[0]), *rows["visits"].tolist()], [], [True, *rows["known"].tolist()])
    for parent, node, symbol, visits in zip(rows["parent"].tolist(), rows["node"].tolist(), rows["symbol"].tolist(), rows["visits"].tolist(), strict=True):
        tree.edges[number[parent]][symbol] = [number[node], visits]
    tree.ends = [v - sum(n for _, n in e.values()) if k else 0 for v, e, k in zip(tree.visits, tree.edges, tree.known, strict=True)]
    target, _ = merge(tree)
    return pd.DataFrame({"kind": [rows["kind"].iloc[0]] * len(target), "state": range(len(target)), "target": list(target)})


def _counted(values: DataFrame, targets: dict[str, np.ndarray]) -> DataFrame:
    """kind, state, symbol, n: how often all the values leave each state by each symbol."""
    shared = values.sparkSession.sparkContext.broadcast(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = {kind: np.zeros((len(target), END + 1), np.int64) for kind, target in shared.value.items()}
        for batch in batches:
            for kind, _, *spans in _by_kind(batch):
                if kind in taken:
                    taken[kind] += steps_taken(shared.value[kind], *spans)
        for kind, n in taken.items():
            state, symbol = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(state), pa.string()), pa.array(state.astype(np.int32)), pa.array(symbol.astype(np.int32)), pa.array(n[state, symbol])], names=["kind", "state", "symbol", "n"])

    return values.select("kind", "value").mapInArrow(run, "kind string, state int, symbol int, n bigint").groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n"))


def fit(values: DataFrame, sizes: dict[str, int]) -> dict[str, Automaton]:
    """The automaton of each kind in ``sizes`` (how many values it has): states from prefixes, probabilities from every step of every value."""
    if not sizes:
        return {}
    own = values.where(F.col("kind").isin(*sizes))
    states = shared_prefixes(own, sizes).groupBy("kind").applyInPandas(_merged, "kind string, state int, target array<int>")
    tables: dict[str, list] = {}
    for row in states.orderBy("kind", "state").collect():
        tables.setdefault(row.kind, []).append(row.target)
    targets = {kind: np.asarray(rows, np.int32) for kind, rows in tables.items()}
    counts = {kind: np.zeros(t.shape) for kind, t in targets.items()}
    for row in _counted(own, targets).collect():  # at most one for each state and symbol
        counts[row.kind][row.state, row.symbol] = row.n
    return {kind: automaton_of(targets[kind], counts[kind]) for kind in targets}


def _binned(values: DataFrame, score: Callable[[str, np.ndarray, np.ndarray, np.ndarray], dict[tuple[str, str], np.ndarray]]) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """The scores of all values by (of, kind): bins in order, and how many scores are in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, _, *spans in _by_kind(batch):
                for (of, by), scores in score(kind, *spans).items():
                    at, n = np.unique(np.floor(scores * BINS).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([of] * len(at), pa.string()), pa.array([by] * len(at), pa.string()), pa.array(at), pa.array(n.astype(np.int64))], names=["of", "kind", "bin", "n"])

    found = values.select("kind", "value").mapInArrow(run, "of string, kind string, bin bigint, n bigint").groupBy("of", "kind", "bin").agg(F.sum("n").alias("n"))
    rows: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for row in found.collect():  # a score is at most some tens either way: bins are bounded
        rows.setdefault((row.of, row.kind), []).append((row.bin, row.n))
    return {key: tuple(np.asarray(sorted(x)).T) for key, x in rows.items()}


def _quantile(bins: np.ndarray, n: np.ndarray, q: float) -> float:
    """As numpy's, over the bins' lower ends."""
    upto = np.cumsum(n)
    place = q * (upto[-1] - 1)
    low, high = (bins[np.searchsorted(upto, int(x), side="right")] / BINS for x in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def _ordinary(found: Grammars, typical: dict[str, float], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which runs are no credentials: those likelier than ordinary text under a kind, and as typical of it as its own values, go."""
    keep = np.ones(len(starts), bool)
    for kind, least in typical.items():
        keep &= (found.ratios(kind, data, starts, ends) <= 0) | (log_likelihood(found.kinds[kind], data, starts, ends) / (ends - starts + 1) < least)
    return keep


def train(docs: DataFrame) -> Grammars:
    """Automata and thresholds from all values in all texts of ``docs``; the driver sees states, their counts and bins of scores.

    The ordinary runs hold the very credentials that no pattern matched, and are fitted again without them.
    """
    values = materialize(labelled_values(docs), "secret-values")
    apart = F.col("hash") % HELD_OUT == 0

    def sizes_of(df: DataFrame) -> dict[str, tuple[int, int]]:
        """By kind: values to fit, and all."""
        return {r.kind: (r.fitted, r.n) for r in df.groupBy("kind").agg(F.count_if(~apart).alias("fitted"), F.count(F.lit(1)).alias("n")).collect()}

    sizes = {kind: fitted for kind, (fitted, n) in sizes_of(values).items() if n >= LEAST and fitted}
    if not any(k in sizes for k in KINDS):
        return Grammars({}, None, {})
    fitted = fit(values.where(~apart), sizes)
    found = Grammars({k: fitted[k] for k in KINDS if k in fitted}, fitted.get(OTHER), {})
    shared = values.sparkSession.sparkContext.broadcast(found)
    held, ordinary = values.where(apart & (F.col("kind") != OTHER)), values.where(F.col("kind") == OTHER)

    def rates(kind: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
        known = shared.value.kinds
        return {("own", kind): log_likelihood(known[kind], data, starts, ends) / (ends - starts + 1)} if kind in known else {}

    typical = {kind: _quantile(*x, MISSED) for (_, kind), x in sorted(_binned(held, rates).items())}
    if found.other and typical:

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, rows, *spans in _by_kind(batch):
                    yield rows.filter(pa.array(_ordinary(shared.value, typical, *spans)))

        ordinary = materialize(ordinary.select("kind", "value", "hash").mapInArrow(clean, values.schema), "secret-ordinary")
        rest = sizes_of(ordinary).get(OTHER, (0, 0))[0]
        if 0 < rest < sizes[OTHER]:
            found.other = fit(ordinary.where(~apart), {OTHER: rest})[OTHER]
    last = values.sparkSession.sparkContext.broadcast(found)

    def ratios(kind: str, *spans: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
        known = last.value
        if kind == OTHER:
            return {(OTHER, k): known.ratios(k, *spans) for k in known.kinds}
        return {("own", kind): known.ratios(kind, *spans)} if kind in known.kinds else {}

    scores = _binned(held.unionByName(ordinary.where(apart)), ratios)
    for kind in found.kinds:
        own, others = scores.get(("own", kind)), scores.get((OTHER, kind))
        above = _quantile(*others, 1 - FALSE) if others else 0.0
        below = _quantile(*own, MISSED) if own else above
        found.thresholds[kind] = max(0.0, above, (above + below) / 2)
    return found


def _spans(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, grammars: Grammars) -> tuple[np.ndarray, np.ndarray]:
    """Spans of a step in order of text, start and kind, in code points: columns text, kind, start, end; and their scores, 0 for base spans."""
    base = base_spans(texts, data, offsets)
    rows, scores = np.stack((base.text, base.kind, base.start, base.end), 1), np.zeros(len(base.text))
    starts, ends = candidates(data, offsets, base)
    if len(starts) and grammars.kinds:
        kinds = list(grammars.kinds)
        ratio = np.stack([grammars.ratios(k, data, starts, ends) for k in kinds])
        over = np.where(ratio > np.asarray([grammars.thresholds[k] for k in kinds])[:, None], ratio, -np.inf)
        best = over.argmax(0)
        taken = np.flatnonzero(np.isfinite(over.max(0)))
        code = len(KINDS) + np.asarray([KINDS.index(k) for k in kinds])[best[taken]]
        text = np.searchsorted(offsets, starts[taken], side="right") - 1
        rows = np.concatenate((rows, np.stack((text, code, starts[taken], ends[taken]), 1)))
        scores = np.concatenate((scores, over.max(0)[taken]))
    if len(rows):
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        before = points[offsets[rows[:, 0]]]
        rows[:, 2], rows[:, 3] = points[rows[:, 2]] - before, points[rows[:, 3]] - before
        order = np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))
        rows, scores = rows[order], scores[order]
    return rows, scores


def find_secrets(docs: DataFrame, grammars: Grammars) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of every whole text, by start and then kind as listed; base spans have no score."""
    shared = docs.sparkSession.sparkContext.broadcast(grammars)  # a few thousand states
    names = pa.array([*KINDS, *LIKE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, data, offsets in steps(texts):
                rows, scores = _spans(texts.slice(lo, hi - lo), data, offsets, shared.value)
                bounds = np.searchsorted(rows[:, 0], np.arange(hi - lo + 1)).astype(np.int32)
                columns = [names.take(pa.array(rows[:, 1])), pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(scores, mask=rows[:, 1] < len(KINDS))]
                spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, ["kind", "start", "end", "score"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), spans], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind string, start bigint, end bigint, score double>>")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the fixed formats, their spans' digest, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs, train(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
