"""Token-ID output: documents as Parquet list columns that allow selective reads of ids and metadata.

``write_tokens`` sorts documents by range, encodes them and writes one file per range with dictionary or
delta encoding, bounded row groups and pages (the writer adds column and offset indexes for pages).
``read_tokens`` opens such a folder and adds each document's global start; the prefix sum over files needs
the metadata columns alone, and the ids of a few documents are found through statistics and page indexes.

Defined cases: a null or empty text is a document of the end id only; a null ``doc_id`` sorts first; rows
that share a ``doc_id`` are ordered by their text and each counts as a document; an empty table gives an
empty folder with the right columns; columns beyond ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.common import new_path
from ferrolith.llm.tokens import encoder

#: File columns: the range's number, where the document starts within the range, its length, its ids.
FILE_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"

#: Parquet writer settings for each list encoding.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def encode_ids(tokenizer: str | None):
    """A function for mapInArrow: (doc_id, text) batches to rows of FILE_SCHEMA, in the order they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, n in words.encode_column(batch.column(1)):
                starts = at + np.cumsum(n) - n
                at += len(ids)
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> None:
    """Encode the whole texts of ``docs`` and write them below ``path`` in ascending ``doc_id`` order."""
    key = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id"), key).sortWithinPartitions(F.asc_nulls_first("doc_id"), key, F.asc_nulls_first("text"))
    rows = ordered.mapInArrow(encode_ids(tokenizer), FILE_SCHEMA)
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows)}
    rows.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder written by ``write_tokens``: doc_id, start, n_tokens and ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row per file reaches the driver: as many as the writer had partitions
    totals = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, before = [], 0
    for part, total in totals:
        bases.append((part, before))
        before += total
    base = F.broadcast(spark.createDataFrame(bases, "base_part int, base bigint"))
    return files.join(base, files["part"] == base["base_part"]).select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _list_crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets, values = lists.offsets.to_numpy(), np.asarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    """Each document's start, length and the CRC-32 of its ids, from the ids that ``tokens`` holds."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_list_crc32, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` written as token files, and the digest of the files read back."""
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digest(read_tokens(spark, path))
