"""The article pipeline over a stream of page files, with each batch merged into a table of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumix.operators.extraction import extract_pages

SCHEMA = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def articles(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).select("page_id", "title", "extraction", "markdown", "error")


def run(spark: SparkSession, folder: str, results: str, checkpoint: str, skip_existing: bool = True) -> StreamingQuery:
    """Extract what arrives in folder and append it to results, leaving out pages already there."""

    def merge(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["page_id"])
        if skip_existing:
            try:
                there = spark.read.parquet(results).select("page_id")
            except Exception as missing:  # noqa: BLE001  (the first batch finds no table)
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
            else:
                fresh = fresh.join(there, "page_id", "left_anti")
        articles(fresh).write.mode("append").parquet(results)

    query = page_stream(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def hosts_per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per kind and minute, late ones up to a bound: a stream or a table with ts and event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n"))
