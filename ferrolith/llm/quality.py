"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

Features of a text are its words, its word pairs, the shapes of its words (letter case, digits, trailing sign) and
pairs of shapes, and whether a word repeats the one before it; each is hashed into ``2 ** BUCKET_BITS`` buckets and
weighs its share of the text's features of that kind. Training is FTRL-proximal per coordinate: shards of the
labelled rows run the updates from common state in parallel, their changes are averaged, and this is repeated for
a few epochs. A score is the sigmoid of a sparse dot product, computed for a batch of whole texts at once.

Parameters: ``max_train_docs`` bounds the labelled rows fitted on (chosen by a hash of the id); the state that the
driver sees is bounded by the number of buckets.

Defined cases: null and empty texts have no features and score the sigmoid of the bias; rows with a null id or label,
or outside the training fold, teach nothing; without labelled rows every score is 0.5; repeated rows are scored
one by one (a doc_id labelled twice teaches twice); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.common import fold, materialize, slices
from ferrolith.llm.textvec import mix, words_of

BUCKET_BITS = 18
BIAS = 1 << BUCKET_BITS  # the bucket of the constant feature
MAX_TRAIN_DOCS = 16_000
SHARDS = 8
EPOCHS = 5
#: FTRL-proximal step sizes and penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-3
THRESHOLD = 0.3

#: Byte classes upper (A-Z), lower (a-z and bytes of non-ASCII letters), digit, other.
CLASS = np.full(256, 3, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[128:], CLASS[48:58] = 0, 1, 1, 2


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all feature occurrences, the text of each, and the number of words of each text."""
    w = words_of(texts)
    n = len(w.hashes)
    counts = np.diff(w.bounds)
    kind = CLASS[w.raw]
    first, second, last = kind[w.starts], kind[np.minimum(w.starts + 1, w.ends - 1)], w.raw[w.ends - 1]
    sign = np.where(kind[w.ends - 1] == 3, last, 0).astype(np.uint64)
    doubled = (w.ends - w.starts > 1) & (w.raw[w.ends - 1] == w.raw[w.ends - 2])
    shape = first.astype(np.uint64) | (second.astype(np.uint64) << np.uint64(2)) | (doubled.astype(np.uint64) << np.uint64(4)) | (sign << np.uint64(5))
    with np.errstate(over="ignore"):
        before = np.concatenate((np.zeros(1, np.uint64), w.hashes[:-1]))[:n]
        shape_before = np.concatenate((np.zeros(1, np.uint64), shape[:-1]))[:n]
        inside = np.concatenate((np.zeros(1, bool), w.text[1:] == w.text[:-1]))[:n]
        pair = mix(before * np.uint64(3) + w.hashes)
        shape_one = mix(shape + np.uint64(0x51))
        shape_two = mix(shape_before * np.uint64(1 << 20) + shape + np.uint64(0x5200000000000000))
        again = mix((before == w.hashes).astype(np.uint64) + np.uint64(0x53))
    families = [w.hashes, np.where(inside, pair, w.hashes), shape_one, np.where(inside, shape_two, shape_one), np.where(inside, again, shape_one)]
    return np.stack([(f >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for f in families]), w.text, counts


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    margin = np.full(len(texts), float(weights[BIAS]))
    data = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    for lo, hi in slices(map(len, data), 1 << 20):
        bucket, text, counts = features(data[lo:hi])
        if len(text):
            per_word = weights[bucket].sum(axis=0)
            margin[lo:hi] += np.bincount(text, per_word, hi - lo) / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature vectors of labelled texts: distinct buckets and their shares."""
    for batch in batches:
        rows_b, rows_v = [], []
        for text in batch.column(2).to_pylist():
            bucket, _, counts = features([text.encode("utf-8", "replace") if text else b""])
            own, n = np.unique(bucket, return_counts=True)
            rows_b.append(own.astype(np.int32))
            rows_v.append((n / max(1, counts.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows_b, pa.list_(pa.int32())), pa.array(rows_v, pa.list_(pa.float32()))], names=["doc_id", "label", "bucket", "share"])


def _shard_updates(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z0, n0 = state.value
        z, n, seen = z0.copy(), n0.copy(), 0
        for batch in batches:
            seen += batch.num_rows
            for y, bucket, share in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                at = np.append(bucket.values.to_numpy(), BIAS)
                x = np.append(share.values.to_numpy().astype(np.float64), 1.0)
                w = _weights(z[at], n[at])
                gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
                z[at] += gradient - sigma * w
                n[at] += gradient**2
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (z - z0, n - n0)], names=["dz", "dn"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, epochs: int = EPOCHS, shards: int = SHARDS) -> np.ndarray:
    """Weights fitted on the labelled rows of ``docs`` (doc_id, text), ``labels`` (doc_id, label 0 or 1)."""
    spark = docs.sparkSession
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", "label")
    n = marked.count()
    if n > max_train_docs:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < int(1e6 * max_train_docs / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # max_train_docs or so
    rows = rows.select("doc_id", F.col("label").cast("int").alias("label"), "text")
    vectors = materialize(rows.mapInArrow(_sparse, "doc_id bigint, label int, bucket array<int>, share array<float>"), "quality-vectors")
    parts = vectors.coalesce(shards).sortWithinPartitions(F.xxhash64("doc_id", F.lit(4)))  # no shuffle: the files are the shards
    state = np.zeros((2, BIAS + 1))
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(state)
        changes = parts.mapInArrow(_shard_updates(shared), "dz binary, dn binary").collect()  # two numbers for each bucket and shard
        if changes:
            state = state + np.stack([sum(np.frombuffer(c[i], np.float32).astype(np.float64) for c in changes) / len(changes) for i in (0, 1)])
        shared.unpersist()
    return _weights(state[0], state[1]).astype(np.float32)


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every whole text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores(piece.column(1).to_pylist(), shared.value).astype(np.float64))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    weights = train(docs, labels.where(~fold("doc_id", 5, 0)))
    scored = score_documents(docs, weights)
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
