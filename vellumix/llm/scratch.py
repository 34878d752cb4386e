"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a local one, but on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="vellumix-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    before = spark.conf.get(_BATCH)
    if rows is not None:
        spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Scratch:
    """Intermediate tables of one call; drop() removes those that no result still reads, the session's end the others."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/vellumix-{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def put(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """df, written and reread; batch_rows bounds the rows that Python code in it gets at once."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        with _batches_of(self.spark, batch_rows):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._vellumix_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._vellumix_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; reads no more than it must to know."""
    return df.limit(most + 1).count() <= most
