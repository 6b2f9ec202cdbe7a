"""What the operators share: working storage, folds and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of columns that exist only inside an operator.
TMP = "__fl_"


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the session names it.

    Only a local session may leave that unset; a temporary folder is then made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if not existing:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        existing = f"file://{tempfile.mkdtemp(prefix='ferrolith-')}"
        spark.sparkContext.setCheckpointDir(existing)
    return existing.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below ``work_dir``."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) mod ``modulus`` is ``remainder``; false for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges, each of one item or of items whose sizes add up to ``most`` or less."""
    start = total = end = 0
    for end, size in enumerate(sizes, 1):
        if total + size > most and end - 1 > start:
            yield start, end - 1
            start, total = end - 1, 0
        total += size
    if end > start:
        yield start, end
