"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A word has a class, a group in the class and a place in the group, ``WAYS`` of each, and its probability is the
product of three softmaxes. Each softmax adds rows of weights: one for the place in the tree alone and hashed ones
for n-gram and skip features of the context (the word before, the one before that, both together). All words beyond
the tree's leaves share one leaf, within which a word has its add-one share; so has, once, any word never met in
training: the probabilities of all known words and of "another word" add up to one.

Training: word counts, the company that makes the classes (words in like company) and the counts of every feature row
cover all training documents. The weights of all rows, hashed ones and the tree's, start as damped logarithms of those
counts and are then fitted by ``ROUNDS`` distributed gradient updates of the conditional likelihood, one for each of as
many batches that all training documents are dealt into by a hash of their id and text. An update is a pass over every token
of its batch, each token's own count left out of its rows; the gradient of a weight is its count in the batch less the
count the model expects there, steps are scaled by those counts, damped where a batch has few, and shrink with the root of the round's
number, so that more rounds do not undo what earlier ones gained.

Tables of counts and gradients leave a task as blocks of rows and are summed by block in steps of at most ``FAN`` tasks'
blocks, so no task reads more as the tasks grow in number; the driver gets one table, of a fixed size. Counts are exact in 64
bits; of a task's gradients the upper 16 bits travel (8 of them significant), which are then summed in 64.

Bounds of the model: words past the tree's leaves (32,767) share the last one and have no context of their own there; classes
come from the company of the ``ANCHORS`` most frequent words.

Scoring runs over batches of whole texts in numpy: gather rows, add, normalise. Counts of the ``TOP_WORDS`` most
frequent words are broadcast (a fixed bound); rarer words meet their counts in a join. A 64-bit hash stands for a word.

Defined cases: a null or empty text is the end token alone; without training tokens the model is the base model;
rows with a null id are not held out and are training rows; repeated rows are counted and scored one by one; an
empty table gives no rows; columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.common import fold, materialize, slices
from ferrolith.llm.textvec import words_of

#: Outcomes of each softmax, levels, leaves of the tree and the leaf of all other words.
WAYS, LEVELS = 32, 3
LEAVES = WAYS**LEVELS
TAIL = LEAVES - 1
#: Word counts that are broadcast: a bound on the broadcast's size.
TOP_WORDS = 1 << 18
#: Feature templates: level, and the distances of the context words that are joined.
TEMPLATES = ((0, (1,)), (0, (2,)), (0, (1, 2)), (1, (1,)), (2, (1,)))
ROW_BITS = 15
ROWS = len(TEMPLATES) << ROW_BITS
#: Rows of counts that travel as one value, and the tasks whose blocks are summed in one step.
BLOCK_ROWS, FAN = 64, 64
#: Tokens for each task that gives tables, at least, once there is a task for each core.
TASK_TOKENS = 2_000_000
#: The tree's rows of each level follow the hashed ones; all trained rows in whole blocks.
TREE_ROWS = (ROWS, ROWS + 1, ROWS + 1 + WAYS)
ALL_ROWS = ROWS + -(-(1 + WAYS + WAYS**2) // BLOCK_ROWS) * BLOCK_ROWS
SMOOTH = 0.05
#: Shares of the logarithms that weights start from: hashed rows, rows of the tree.
START, TREE_START = 0.3, 0.6
ANCHORS = 64
#: Batches of the training texts, each with its gradient update, the counts that hold back rare rows, the longest step of a weight.
ROUNDS, DAMPING, LONGEST = 2, 2.0, 1.0
#: Power of the round's number by which steps shrink. More rounds gain a little more (README) and cost a table of gradients for each task each.
DECAY = 0.5
END = np.uint64(0x9D39247E33776D41)
STEP = 2 << 20
LOG10 = np.log(10)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and where each text begins (one more entry closes the last)."""
    w = words_of(texts)
    starts = w.bounds + np.arange(len(w.bounds))
    out = np.empty(starts[-1], np.uint64)
    ends = np.zeros(len(out), bool)
    ends[starts[1:] - 1] = True
    out[ends], out[~ends] = END, w.hashes
    return out, starts


def token_batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Token hashes and text starts of consecutive texts, a few megabytes at a time."""
    texts = [t.encode("utf-8", "replace") if t else b"" for t in column.to_pylist()]
    for lo, hi in slices(map(len, texts), STEP):
        yield lo, hi, *token_hashes(texts[lo:hi])


class WordTable:
    """Open-addressed lookup of 64-bit hashes: the index of each, or -1."""

    def __init__(self, words: np.ndarray):
        size = 1 << max(10, (4 * len(words)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.index = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, at = np.arange(len(words)), (words & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.index[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.index[slots] = words[left[placed]], left[placed]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & int(self.mask)

    def find(self, words: np.ndarray) -> np.ndarray:
        at = (words & self.mask).astype(np.int64)
        found = self.index[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[at] != words))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            found[wrong] = self.index[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[at[wrong]] != words[wrong])]
        return found


@dataclass
class Vocabulary:
    """Top words (hashes, most frequent first) with counts and leaves; totals over all training tokens."""

    table: WordTable
    counts: np.ndarray
    leaf: np.ndarray
    tokens: int
    distinct: int

    def leaves(self, index: np.ndarray) -> np.ndarray:
        return np.where(index >= 0, self.leaf[index], TAIL)


def contexts(tokens: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words one and two places before each token; zero before a text's first."""
    out, now = [], tokens
    for _ in range(2):
        now = np.concatenate((np.zeros(1, np.uint64), now[:-1]))
        now[starts[:-1]] = 0
        out.append(now)
    return out


def feature_rows(tokens: np.ndarray, starts: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The hashed row of each template (templates x tokens)."""
    before = contexts(tokens, starts)
    prefix = [np.uint64(0), (leaf >> 10).astype(np.uint64), (leaf >> 5).astype(np.uint64)]
    out = np.empty((len(TEMPLATES), len(tokens)), np.int32)
    with np.errstate(over="ignore"):
        for k, (level, places) in enumerate(TEMPLATES):
            h = before[places[0] - 1]
            for p in places[1:]:
                h = h * np.uint64(0x2545F4914F6CDD1D) + before[p - 1]
            h = (h ^ (prefix[level] + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            out[k] = (k << ROW_BITS) + ((h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - ROW_BITS)).astype(np.int32)
    return out


def digits(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return leaf >> 10, (leaf >> 5) & 31, leaf & 31


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in held]), len(words)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for _, _, tokens, _ in token_batches(batch.column(0)):
            held.append(np.unique(tokens, return_counts=True))
            size += len(held[-1][0])
        if size > 3_000_000:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


#: What a task gives of a table: the block's number, the task's, and the block's values.
BLOCKS, BLOCKS_NAMES = "block int, task int, counts binary", ["block", "task", "counts"]


def _company(vocabulary):
    """Counts of frequent neighbours, before and after, of each word that has a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.value.table
        counts = np.zeros(LEAVES * 2 * ANCHORS, np.int32)
        for batch in batches:
            for _, _, tokens, starts in token_batches(batch.column(0)):
                index = table.find(tokens)
                inside = np.ones(len(index) - 1, bool)
                inside[starts[1:-1] - 1] = False
                for a, b, shift in ((index[1:], index[:-1], 0), (index[:-1], index[1:], ANCHORS)):
                    use = inside & (a >= 0) & (a < LEAVES) & (b >= 0) & (b < ANCHORS)
                    counts += np.bincount(a[use] * (2 * ANCHORS) + b[use] + shift, minlength=counts.size)
        yield from _as_blocks(counts.reshape(-1, WAYS))

    return run


def _as_blocks(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that hold anything, as bytes: a task's own counts fit 32 bits, of gradients the upper 16 bits travel."""
    if values.dtype == np.float32:
        values = ((values.view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16)
    blocks, task = values.reshape(-1, BLOCK_ROWS * WAYS), TaskContext.get().partitionId()
    for k in np.flatnonzero(blocks.any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([blocks[k].tobytes()], pa.binary())], BLOCKS_NAMES)


def _values(data: bytes, kind: type) -> np.ndarray:
    """A block's values; 16 bits are the upper half of a float."""
    own = np.frombuffer(data, kind)
    return (own.astype(np.uint32) << np.uint32(16)).view(np.float32) if kind is np.uint16 else own


def _add_blocks(kind: type, wide: type, out: type):
    """Sums by block and group of tasks, one value held for each in the partition, added up as ``wide`` and given as ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, task, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _values(data, kind)
                if (block, task) in sums:
                    sums[block, task] += own
                else:
                    sums[block, task] = own.astype(wide)
        for (block, task), own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([own.astype(out).tobytes()], pa.binary())], BLOCKS_NAMES)

    return run


def _summed(texts: DataFrame, tasks: int, work, rows: int, kind: type = np.int32, wide: type = np.int64) -> np.ndarray:
    """The sum of all tasks' tables that ``work`` makes of the ``tasks`` partitions of ``texts``: added up in 64 bits, given as 32-bit floats, as large as one table."""
    blocks = texts.mapInArrow(work, BLOCKS)
    while True:
        tasks = -(-tasks // FAN)
        out = np.float32 if tasks <= 1 else wide
        groups = blocks.withColumn("task", F.expr(f"task div {FAN}").cast("int"))
        blocks = groups.repartition("block", "task").mapInArrow(_add_blocks(kind, wide, out), BLOCKS)
        kind = wide
        if tasks <= 1:
            break
    sums = np.zeros((rows // BLOCK_ROWS, BLOCK_ROWS * WAYS), np.float32)
    for batch in blocks.select("block", "counts").toArrow().to_batches():
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[k] = np.frombuffer(data.as_buffer(), np.float32)
    return sums.reshape(rows, WAYS)


def assign_leaves(company: np.ndarray, n_words: int, iterations: int = 8) -> np.ndarray:
    """A leaf for each of the most frequent words: classes by spherical k-means of their neighbours, filled in order of frequency."""
    n = min(n_words, TAIL)
    vectors = np.sqrt(company[:n].astype(np.float32))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.maximum(norm, 1e-6)
    known = np.flatnonzero(norm[:, 0] > 0)
    centres = vectors[known[:WAYS]] if len(known) >= WAYS else np.eye(WAYS, vectors.shape[1], dtype=np.float32)
    for _ in range(iterations if len(known) >= WAYS else 0):
        own = (vectors[known] @ centres.T).argmax(axis=1)
        for c in range(WAYS):
            total = vectors[known[own == c]].sum(axis=0)
            if total.any():
                centres[c] = total / np.linalg.norm(total)
    space = np.full(WAYS, LEAVES // WAYS)
    space[-1] -= 1  # the last leaf is the tail's
    leaf = np.empty(n, np.int64)
    wish = np.argsort(-(vectors @ centres.T), axis=1, kind="stable")
    for i in range(n):
        for c in wish[i]:
            if space[c]:
                break
        full = LEAVES // WAYS - (c == WAYS - 1)
        leaf[i] = (int(c) << 10) + full - space[c]
        space[c] -= 1
    return leaf


def _count_features(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(TEMPLATES), WAYS << ROW_BITS), np.int32)
        for batch in batches:
            for _, _, tokens, starts in token_batches(batch.column(0)):
                leaf = vocabulary.value.leaves(vocabulary.value.table.find(tokens))
                rows, d = feature_rows(tokens, starts, leaf), digits(leaf)
                for k, (level, _) in enumerate(TEMPLATES):
                    counts[k] += np.bincount((rows[k] - (k << ROW_BITS)) * WAYS + d[level], minlength=counts.shape[1])
        yield from _as_blocks(counts.reshape(ROWS, WAYS))

    return run


def tree_counts(vocabulary: Vocabulary) -> list[np.ndarray]:
    """Token counts of each outcome by level: rows are the places in the tree above it."""
    leaves = np.zeros(LEAVES)
    n = len(vocabulary.leaf)
    np.add.at(leaves, vocabulary.leaf, vocabulary.counts[:n])
    leaves[TAIL] += vocabulary.tokens - leaves.sum() + 1  # the word never met
    return [leaves.reshape(1, WAYS, -1).sum(axis=2), leaves.reshape(WAYS, WAYS, -1).sum(axis=2), leaves.reshape(-1, WAYS)]


def _log_share(counts: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.float32) + np.float32(SMOOTH)
    counts /= counts.sum(axis=-1, keepdims=True)
    return np.log(counts, out=counts)


def _gradient(vocabulary, counts, weights):
    """What the model expects in the hashed rows and the root's row over the tokens of a task, less what is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hashed, tree), met, size = weights.value, counts.value.reshape(-1), 4096
        out, places, firsts = np.zeros(ALL_ROWS * WAYS, np.float32), np.arange(WAYS), np.arange(size) * WAYS
        sums, terms, cells, ones = np.empty((size, WAYS), np.float32), np.empty((size, WAYS), np.float32), np.empty((size, WAYS), np.int64), np.ones(WAYS, np.float32)
        for batch in batches:
            for _, _, tokens, starts in token_batches(batch.column(0)):
                leaf = vocabulary.value.leaves(vocabulary.value.table.find(tokens))
                rows, d, above = feature_rows(tokens, starts, leaf).astype(np.int64), digits(leaf), (leaf * 0, leaf >> 10, leaf >> 5)
                # the token itself is left out of the rows it was counted in
                without = [np.zeros(len(leaf), np.float32) for _ in range(LEVELS)]
                for k, (level, _) in enumerate(TEMPLATES):
                    cell = rows[k] * WAYS + d[level]
                    c = met[cell]
                    without[level] += np.float32(START) * np.log((c - np.float32(1 - SMOOTH)) / (c + np.float32(SMOOTH)))
                    np.subtract.at(out, cell, np.float32(1))
                for level in range(LEVELS):
                    seen = np.bincount(above[level] * WAYS + d[level], minlength=WAYS ** (level + 1))
                    out[TREE_ROWS[level] * WAYS :][: len(seen)] -= seen
                for lo in range(0, len(leaf), size):
                    part = slice(lo, lo + size)
                    n = len(leaf[part])
                    total, term, cell = sums[:n], terms[:n], cells[:n]
                    for level in range(LEVELS):
                        templates = [k for k, t in enumerate(TEMPLATES) if t[0] == level]
                        np.take(tree[level], above[level][part], axis=0, out=total, mode="clip")
                        for k in templates:
                            total += np.take(hashed, rows[k, part], axis=0, out=term, mode="clip")
                        total.reshape(-1)[firsts[:n] + d[level][part]] += without[level][part]
                        np.clip(total, -80, 80, out=total)
                        np.exp(total, out=total)
                        total /= (total @ ones)[:, None]
                        met_rows = [rows[k, part] for k in templates]
                        if level == 0:
                            out[ROWS * WAYS :][:WAYS] += total.sum(axis=0)
                        else:
                            met_rows.append(above[level][part] + TREE_ROWS[level])
                        for own in met_rows:
                            np.add((own * WAYS)[:, None], places, out=cell)
                            np.add.at(out, cell.reshape(-1), total.reshape(-1))
        yield from _as_blocks(out)

    return run


def _step(weights: np.ndarray, counts: np.ndarray, surplus: np.ndarray, features: int, share: float, gain: float) -> None:
    """One gradient update in place, by the part ``gain``: ``surplus`` is expected less met in a ``share`` of the tokens; ``features`` rows act on each token."""
    for lo in range(0, len(weights), 1 << 13):
        part = slice(lo, lo + (1 << 13))
        over = surplus[part]
        size = np.maximum(counts[part].astype(np.float32, copy=False) * np.float32(share) + over / 2, 0)
        weights[part] -= np.float32(gain) * np.clip(over / (features * size + np.float32(DAMPING)), -LONGEST, LONGEST)


def fit_weights(texts: DataFrame, tasks: int, vocabulary, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weights of the hashed rows and of the tree; each text is in the batch of one round, and steps shrink from round to round."""
    context, above = texts.sparkSession.sparkContext, tree_counts(vocabulary.value)
    hashed, tree = np.float32(START) * _log_share(counts), [np.float32(TREE_START) * _log_share(c) for c in above]
    shared, share = context.broadcast(counts), 1 / max(rounds, 1)
    for k in range(rounds):
        state = context.broadcast((hashed, tree))
        batch = texts.where(F.pmod("draw", F.lit(rounds)) == k).select("text")
        gain = (1 + k) ** -DECAY
        surplus = _summed(batch, tasks, _gradient(vocabulary, shared, state), ALL_ROWS, np.uint16, np.float64)
        state.destroy()
        for level in range(LEVELS):
            templates = [k for k, t in enumerate(TEMPLATES) if t[0] == level]
            for k in templates:
                own = slice(k << ROW_BITS, (k + 1) << ROW_BITS)
                _step(hashed[own], counts[own], surplus[own], 1 + len(templates), share, gain)
            own = slice(TREE_ROWS[level], TREE_ROWS[level] + len(above[level]))
            _step(tree[level], above[level], surplus[own], 1 + len(templates), share, gain)
    shared.destroy()
    return hashed, tree


@dataclass
class LanguageModel:
    """Vocabulary and weights: hashed rows, and rows of the tree by level."""

    vocabulary: Vocabulary
    hashed: np.ndarray
    tree: list[np.ndarray]


def count_words(training: DataFrame) -> DataFrame:
    """Every word of all texts with its count (word hash, n), written to the shared folder."""
    return materialize(training.select("text").mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def train(training: DataFrame, words: DataFrame) -> LanguageModel:
    """The model of the texts of ``training``, whose word counts are ``words``."""
    context, texts = training.sparkSession.sparkContext, training.select("text", F.xxhash64("doc_id", "text").alias("draw"))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("word")).first()
    # each task gives whole tables: many small partitions share a task
    tasks = min(texts.rdd.getNumPartitions(), max(context.defaultParallelism, int(totals[0]) // TASK_TOKENS + 1))
    texts = texts.coalesce(max(1, tasks))
    top = words.orderBy(F.desc("n"), "word").limit(TOP_WORDS).toArrow()
    hashes, counts = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    vocabulary = Vocabulary(WordTable(hashes), counts, np.zeros(0, np.int64), int(totals[0]), int(totals[1]))
    shared = context.broadcast(vocabulary)
    company = _summed(texts, tasks, _company(shared), LEAVES * 2 * ANCHORS // WAYS)
    shared.destroy()
    leaf = assign_leaves(company.reshape(LEAVES, 2 * ANCHORS), len(hashes))
    vocabulary.leaf = np.concatenate((leaf, np.full(len(hashes) + 1 - len(leaf), TAIL)))[: len(hashes)].astype(np.int64)
    if not len(hashes):
        return LanguageModel(vocabulary, np.zeros((ROWS, WAYS), np.float32), [_log_share(c) for c in tree_counts(vocabulary)])
    shared = context.broadcast(vocabulary)
    table = _summed(texts, tasks, _count_features(shared), ROWS)
    hashed, tree = fit_weights(texts, tasks, shared, table)
    shared.destroy()
    return LanguageModel(vocabulary, hashed, tree)


def leaf_log_prob(tokens: np.ndarray, starts: np.ndarray, leaf: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Natural logarithm of the probability of each token's leaf in its context."""
    rows, d, above = feature_rows(tokens, starts, leaf), digits(leaf), (leaf * 0, leaf >> 10, leaf >> 5)
    out, size = np.zeros(len(tokens)), 2048
    sums, terms, ones, at = np.empty((size, WAYS), np.float32), np.empty((size, WAYS), np.float32), np.ones(WAYS, np.float32), np.arange(size)
    for lo in range(0, len(tokens), size):
        part = slice(lo, lo + size)
        n = len(leaf[part])
        total, term = sums[:n], terms[:n]
        for level in range(LEVELS):
            np.take(model.tree[level], above[level][part], axis=0, out=total, mode="clip")
            for k in (k for k, t in enumerate(TEMPLATES) if t[0] == level):
                total += np.take(model.hashed, rows[k, part], axis=0, out=term, mode="clip")
            np.clip(total, -80, 80, out=total)
            out[part] += total[at[:n], d[level][part]]
            out[part] -= np.log(np.exp(total, out=total) @ ones)
    return out


def score_texts(column: pa.Array, model: LanguageModel) -> tuple[np.ndarray, ...]:
    """For each text: tokens, tokens among the top words, sum of log10(c+1) over those, natural log of the leaves' probability, tokens in the tail's leaf, and lists of the other words."""
    n = len(column)
    sizes, top, logs, leaves, tails = (np.zeros(n, t) for t in (np.int64, np.int64, np.float64, np.float64, np.int64))
    tail_logs, rare, rare_sizes = np.zeros(n), [], np.zeros(n, np.int64)
    vocabulary = model.vocabulary
    log_count = np.log10(np.append(vocabulary.counts, 0) + 1.0)
    for lo, hi, tokens, starts in token_batches(column):
        index = vocabulary.table.find(tokens)
        leaf = vocabulary.leaves(index) if len(vocabulary.leaf) else np.full(len(index), TAIL)
        first = starts[:-1]
        own_logs = log_count[index]
        sizes[lo:hi] = np.diff(starts)
        top[lo:hi] = np.add.reduceat((index >= 0).astype(np.int64), first)
        logs[lo:hi] = np.add.reduceat(own_logs, first)
        leaves[lo:hi] = np.add.reduceat(leaf_log_prob(tokens, starts, leaf, model), first)
        tails[lo:hi] = np.add.reduceat((leaf == TAIL).astype(np.int64), first)
        tail_logs[lo:hi] = np.add.reduceat(np.where(leaf == TAIL, own_logs, 0.0), first)
        rare.append(tokens[index < 0])
        rare_sizes[lo:hi] = np.add.reduceat((index < 0).astype(np.int64), first)
    words = np.concatenate([np.zeros(0, np.uint64), *rare]).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rare_sizes))).astype(np.int32)), pa.array(words))
    return sizes, top, logs, leaves, tails, tail_logs, lists


SCORED = "doc_id bigint, n_tokens bigint, top bigint, logs double, leaves double, tails bigint, tail_logs double, rare array<bigint>"


def score_documents(docs: DataFrame, model: LanguageModel, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                *numbers, lists = score_texts(piece.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, numbers), lists], names=["doc_id", "n_tokens", "top", "logs", "leaves", "tails", "tail_logs", "rare"])

    scored = docs.select("doc_id", "text").mapInArrow(run, SCORED)
    v = model.vocabulary
    if v.distinct <= TOP_WORDS:  # every known word is among the top words
        whole = scored.withColumn("more", F.lit(0)).withColumn("more_logs", F.lit(0.0))
    else:
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
        met = scored.select("row", F.explode("rare").alias("word")).join(words.where(F.col("n") <= int(v.counts[-1])), "word")
        more = met.groupBy("row").agg(F.count("word").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
        whole = scored.join(more, "row", "left").fillna(0, ["more", "more_logs"])
    n_leaf = int((v.leaf != TAIL).sum())
    tail_total = (v.tokens - int(v.counts[:n_leaf].sum())) + (v.distinct - n_leaf) + 1
    base = F.col("logs") + F.col("more_logs") - F.col("n_tokens") * float(np.log10(v.tokens + v.distinct + 1))
    score = F.col("leaves") / float(LOG10) + F.col("tail_logs") + F.col("more_logs") - F.col("tails") * float(np.log10(tail_total))
    if not v.tokens:  # nothing was learned
        score = base
    return whole.select("doc_id", "n_tokens", (F.col("top") + F.col("more")).cast("bigint").alias("n_known"), F.lit(v.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the model and its unigram base; the fold 2 of 7 is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    training = docs.where(~fold("doc_id", 7, 2))
    words = count_words(training)
    scored = score_documents(docs, train(training, words), words)
    return scored.select("doc_id", fold("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
