"""Streams: new page files become records as they arrive, and events are counted by window with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ferrolith.functions.web import clean_html, country


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, country, text) of pages, from a table or a stream alike."""
    return pages.select("page_id", "url", country(F.col("html"), F.col("url")).alias("country"), clean_html(F.col("html")).alias("text"))


def read_pages(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return page_records(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Number and sum by window and event type; events later than ``late`` are not waited for in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
