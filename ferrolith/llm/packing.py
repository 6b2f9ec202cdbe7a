"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two: as many of the longest length as
fit, then the binary digits of the rest, longest first. A piece is a sequence of its own, so no sequence
crosses documents and none is padded; equal lengths share a bucket, from which batches of one shape are drawn.

Defined cases: a null or empty text is a document of the end id only (one piece of length 1); rows that share
a ``doc_id``, or whose ``doc_id`` is null, are packed one by one; an empty table gives no pieces; columns
beyond ``doc_id`` and ``text`` are ignored, whatever their names; texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ferrolith.llm.tokens import encoder

#: Columns of a piece; ids are present on demand.
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int"

#: A sequence's number holds its partition above this many bits of a running number.
SEQUENCE_BITS = 40


def binary_lengths(n: np.ndarray, longest: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of texts of ``n`` ids, longest first: the text each belongs to and its length, a power of two up to ``longest``."""
    whole, rest = n // longest, n % longest
    digits = (rest[:, None] >> np.arange(longest.bit_length() - 2, -1, -1)) & 1
    text, digit = np.nonzero(digits)
    text = np.concatenate((np.repeat(np.arange(len(n)), whole), text))
    length = np.concatenate((np.full(whole.sum(), longest), longest >> (digit + 1)))
    order = np.argsort(text, kind="stable")
    return text[order], length[order]


def _pack(tokenizer: str | None, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = encoder(tokenizer), TaskContext.get().partitionId() << SEQUENCE_BITS
        for batch in batches:
            for lo, hi, ids, n in words.encode_column(batch.column(1)):
                text, size = binary_lengths(n, longest)
                ends = np.cumsum(size)
                begins = ends - size
                data = memoryview(ids).cast("B")
                crc = [crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(text)), pa.array(begins - (np.cumsum(n) - n)[text]), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[text]),
                    pa.array(sequence + np.arange(len(size))), pa.array(np.zeros(len(size), np.int64)), pa.array(np.log2(size).astype(np.int32)),
                ]
                sequence += len(size)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)).astype(np.int32)), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack_documents(docs: DataFrame, longest: int = 4096, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs``: one row per sequence, with its bucket (the length's binary logarithm).

    ``longest`` is a power of two. ``sequence_id`` is unique, and the same in every run over the same input
    partitions; ``with_ids`` adds the ids themselves as a list column.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_pack(tokenizer, longest, with_ids), schema)


def write_buckets(docs: DataFrame, path: str, longest: int = 4096, tokenizer: str | None = None) -> None:
    """Write the sequences with their ids, one folder per length, so that a reader takes batches of one shape."""
    pack_documents(docs, longest, tokenizer, with_ids=True).write.partitionBy("bucket").parquet(path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
