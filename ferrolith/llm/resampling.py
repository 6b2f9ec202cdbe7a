"""Importance resampling towards a target distribution, on hashed word n-grams.

Bytes of the Arrow text buffers are classed by a lookup table, words are where the class changes, and the CRC-32 registers
of all words of a step advance together, a byte of each at a time, by the table of the polynomial. A pair of words goes
on from the register of its first word. A CRC modulo ``buckets`` is the n-gram's bucket.

Buckets are counted over all documents and all target texts (each task adds up its own first). A bucket's gain is the
logarithm of its share in the target over its share in the corpus, with one added to each count, in thousandths. A document weighs the mean of its
gains; a Gumbel draw from a hash of its id is added, and the highest scores are drawn: a sample without replacement
by importance. The order is found in ranges with offsets (``ordering``), never in one task.

Defined cases: null and empty texts have no words, no features and weight 0; a null id is hashed as an empty one and
comes first among ties; rows that share an id are documents of their own, equal scores among them in order of
features, weight and text hash, and equal rows share what they are given in any order; without target texts or documents the gains
come from the added ones; an empty table gives no rows; words of any length are hashed whole; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.buffers import byte_class, runs, steps
from ferrolith.llm.common import TMP, materialize
from ferrolith.llm.ordering import range_sorted, with_places
from ferrolith.llm.textvec import LOWER

BUCKETS, SEED = 10_000, 7
MIN_WORDS, PERCENT = 20, 25
#: Words are of digits, letters and all bytes beyond ASCII.
WORD = byte_class("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", others=True)
#: Words of more bytes go through zlib one by one.
LONG = 256


def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial, a bit at a time."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


TABLE = _crc_table()


def advance(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the byte spans [start, end): all spans at once, longest first."""
    size = np.minimum(ends - starts, LONG + 1).astype(np.uint16)
    order = np.argsort(size, kind="stable")[::-1]
    now, at, size = register[order], starts[order], size[order]
    most = int(size[0]) if len(size) else 0
    going = len(size) - np.searchsorted(size[::-1], np.arange(min(most, LONG)), side="right")
    n_long = int(np.count_nonzero(size > LONG))
    for k, n in enumerate(going.tolist()):
        part = now[n_long:n]
        now[n_long:n] = TABLE[(part ^ data[at[n_long:n] + k]) & 0xFF] ^ (part >> 8)
    for i in range(n_long):
        span = data[at[i] : ends[order[i]]].tobytes()
        now[i] = zlib.crc32(span, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and the text of each, then of all pairs of consecutive words of a text and the text of each."""
    data = LOWER[data]
    starts, ends = runs(WORD[data], offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    one = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends)
    first = np.flatnonzero(text[1:] == text[:-1])
    space = one[first]
    space = TABLE[(space ^ 0x20) & 0xFF] ^ (space >> 8)
    two = advance(space, data, starts[first + 1], ends[first + 1])
    return (~one) % np.uint32(buckets), text, (~two) % np.uint32(buckets), text[first]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often all texts of ``docs`` hit each bucket; each task sends one row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                one, _, two, _ = features(data, offsets, buckets)
                counts += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain; ``buckets`` numbers, which the driver holds."""
    corpus = bucket_counts(docs, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, buckets).withColumnRenamed("n", "t")
    counts = np.zeros((2, buckets))
    for row in corpus.join(wanted, "bucket", "full").collect():  # one row for each bucket
        counts[:, row.bucket] = row.s or 0, row.t or 0
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and a hash of the text, for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64))  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in steps(batch.column(1)):
                one, of_one, two, of_two = features(data, offsets, len(shared.value))
                words[lo:hi] = np.bincount(of_one, minlength=hi - lo)
                for bucket, text in ((one, of_one), (two, of_two)):
                    total[lo:hi] += np.bincount(text, shared.value[bucket], hi - lo).astype(np.int64)
            n = np.maximum(2 * words - 1, 0)
            weight = np.where(n, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(n), pa.array(weight), batch.column(2)],
                names=["doc_id", "n_words", "n_features", "weight", "text_hash"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, text_hash bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths from the hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, rank and text_hash; the rank of those not drawn is null."""
    weighed = weigh(docs, gain_table(docs, target, buckets))
    fits = (F.col("n_words") >= min_words).alias("fits")
    scored = materialize(weighed.select("*", fits, (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")), "weighed")
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc(), *map(F.col, ("n_features", "weight", "text_hash"))]
    placed = with_places(range_sorted(scored, order, "by-score"), "fits")
    drawn = F.col("fits") & (F.col(f"{TMP}place") < F.floor(F.lit(percent) * F.col(f"{TMP}size") / F.lit(100)))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col(f"{TMP}place") + 1).alias("rank"), "text_hash")


def draw_documents(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``docs``, columns as they are; rows equal in id and text stay or go together."""
    chosen = resample(docs, target, **options).where(F.col("rank").isNotNull())
    same = docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (F.xxhash64(docs["text"]) == chosen["text_hash"])
    return docs.join(chosen, same, "left_semi")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` resampled towards the texts of ``benchmark``."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).drop("text_hash")
