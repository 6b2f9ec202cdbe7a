"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed byte n-grams, learned from labelled documents. A document is a
mixture: each of its words comes from one language, and expectation-maximisation over the words' n-gram
likelihoods estimates the proportions. The set of languages is selected by penalised likelihood: sets of the
1, 2, ... strongest languages, up to all of them, are fitted anew and the set with the best log-likelihood less a
penalty for each language wins; the search ends where no larger set can win. The prediction is the language with the
largest proportion in that set; the score is its proportion in the mixture of all languages, before the selection.

Parameters: ``max_train_docs`` bounds the labelled rows that the n-gram tables are fitted on (chosen by a hash of
the id, so that the choice does not depend on order); ``buckets`` and the number of labels bound the model.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, and so is every text when there
are no labelled rows; a letter is any character for which ``str.isalpha`` holds; rows with null label or null id teach nothing;
repeated rows are scored one by one; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ferrolith.llm.common import TMP, fold, slices
from ferrolith.llm.textvec import SPACE

UNKNOWN = "und"
LETTER = re.compile("[A-Za-z]")

BUCKET_BITS = 16
MAX_TRAIN_DOCS = 20_000
#: Nats a language must add to the log-likelihood, times the logarithm of the number of words.
PENALTY = 2.0
ITERATIONS = 5


@dataclass
class LanguageModel:
    """Languages, and for each language the logarithm of each bucket's share (languages x buckets)."""

    names: list[str]
    log_share: np.ndarray


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case UTF-8 bytes of texts, a line feed before, between and after them, and where each begins and ends."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum(np.fromiter((len(d) + 1 for d in data), np.int64, len(data)))
    raw = np.frombuffer(b"\n".join([b"", *data, b""]), np.uint8)
    return np.where(SPACE[raw], np.uint8(32), raw), np.concatenate(([0], ends))


def ngram_buckets(buffer: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each position on."""
    wide = buffer.astype(np.uint32)
    gram = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            buffer, _ = _buffer([text])
            own = totals.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            if len(buffer) > 2:
                own += np.bincount(ngram_buckets(buffer), minlength=len(own))
    for lang, own in totals.items():
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> LanguageModel:
    """Fit n-gram tables on rows of (doc_id, text, lang), on ``max_train_docs`` of them or so if there are more."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    n = rows.select("doc_id").count()
    if n > max_train_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(1e6 * max_train_docs / n))
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # languages x buckets at the most
    langs = table.column("lang").to_pylist()
    names = sorted(set(langs))
    index = {name: i for i, name in enumerate(names)}
    dense = np.zeros((1 << BUCKET_BITS, len(names)))
    dense[table.column("bucket").to_numpy(), [index[x] for x in langs]] = table.column("n").to_numpy()
    share = (dense + 0.5) / (dense + 0.5).sum(axis=0, keepdims=True)
    return LanguageModel(names, np.ascontiguousarray(np.log(share).T, np.float32))


def _fit(like: np.ndarray, shift: np.ndarray, weight: np.ndarray, counts: np.ndarray, share: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions (languages x texts) of all texts at once; also each text's log-likelihood under them.

    ``like`` holds the words' likelihoods (languages x words), scaled by exp(-shift); each text has ``counts`` words.
    """
    first = np.cumsum(counts) - counts
    total = np.add.reduceat(weight, first)
    for _ in range(iterations):
        joint = [row * np.repeat(own, counts) for row, own in zip(like, share, strict=True)]
        scale = weight / np.maximum(sum(joint), 1e-30)
        share = np.stack([np.add.reduceat(row * scale, first) for row in joint]) / total
    fit = sum(row * np.repeat(own, counts) for row, own in zip(like, share, strict=True))
    return share, np.add.reduceat(np.log(np.maximum(fit, 1e-30)) + shift, first)


def has_letter(text: str) -> bool:
    """Whether any character is a letter; the pattern only saves time."""
    return LETTER.search(text) is not None or any(map(str.isalpha, text))


def mixtures(texts: list[str], model: LanguageModel, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Each text's proportions over the model's languages, after the selection of its set and before; each text holds a letter."""
    buffer, ends = _buffer(texts)
    gram = ngram_buckets(buffer)
    space = buffer == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:])  # the space before a word belongs to it
    starts = starts[starts < len(gram)]
    logs = np.stack([np.add.reduceat(row[gram], starts) for row in model.log_share])
    shift = logs.max(axis=0)
    like = np.exp(np.maximum(logs - shift, np.float32(-60)))
    counts = np.diff(np.searchsorted(starts, ends))
    weight = np.diff(np.append(starts, len(gram))).astype(np.float32)
    k = len(model.names)
    full, _ = _fit(like, shift, weight, counts, np.full((k, len(texts)), 1 / k, np.float32), ITERATIONS)
    order = np.argsort(-full, axis=0, kind="stable")
    cost = penalty * np.log(np.maximum(counts, 2))
    best, best_value = np.zeros_like(full, np.float64), np.full(len(texts), -np.inf)
    most = np.add.reduceat(shift.astype(np.float64), np.cumsum(counts) - counts)  # no mixture is likelier than each word's best language
    for size in range(1, k + 1):
        if not (most - cost * size > best_value).any():
            break
        chosen = np.zeros_like(full)
        np.put_along_axis(chosen, order[:size], 1.0, axis=0)
        start = np.maximum(full, 1e-3) * chosen
        share, fit = _fit(like, shift, weight, counts, (start / start.sum(axis=0)).astype(np.float32), 0 if size == 1 else 2)
        value = fit - cost * size
        better = value > best_value
        best[:, better], best_value[better] = share[:, better], value[better]
    return best.T, full.T


def predict_batch(texts: list[str | None], model: LanguageModel, penalty: float = PENALTY) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.names else []
    per_step = max(1 << 16, (4 << 20) // max(1, len(model.names)))
    for lo, hi in slices((4 * len(texts[i]) if not texts[i].isascii() else len(texts[i]) for i in known), per_step):
        part = known[lo:hi]
        share, full = mixtures([texts[i] for i in part], model, penalty)
        top = share.argmax(axis=1)
        for i, t in zip(part, top, strict=True):
            names[i] = model.names[t]
        scores[part] = full[np.arange(len(part)), top]
    return names, np.clip(scores, 0, 1)


def _predict(model, penalty: float, text: int):
    """Appends prediction and score to each row; ``text`` is the number of the column that holds the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                names, scores = predict_batch(piece.column(text).to_pylist(), model.value, penalty)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*piece.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred and score of every whole text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages
    return docs.select("doc_id", "text").mapInArrow(_predict(shared, penalty, 1), "doc_id bigint, text string, lang_pred string, score double").drop("text")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` with an identified language, or several of whatever proportions; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"{TMP}{i}") for i, c in enumerate(docs.columns)])
    schema = StructType([*plain.schema.fields]).add("lang_pred", "string").add("score", "double")
    scored = plain.mapInArrow(_predict(shared, PENALTY, docs.columns.index("text")), schema)
    kept = scored.where(F.col("lang_pred") != UNKNOWN)
    return kept.select(*[F.col(f"{TMP}{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from documents outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~fold("doc_id", 4, 2)))
    return identify(docs, model).select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
