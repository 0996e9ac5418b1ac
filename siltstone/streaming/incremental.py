"""Findings of files as they arrive: a stateless stream, so every file is scanned once.

The input is a directory of Parquet batches with the columns of ``schema.FILES`` (what ``sources.tree`` gives,
written by whoever watches the trees). Beyond the batch engine's own range, but the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltstone import schema
from siltstone.plans.pipeline import ScanConfig, kept
from siltstone.plans.scan import public


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema.FILES).parquet(path)


def scan_stream(files: DataFrame, out: str, checkpoint: str, config: ScanConfig | None = None) -> StreamingQuery:
    """Starts the query; each micro-batch appends the public columns of its findings to ``out``."""

    def batch(df: DataFrame, _: int) -> None:
        public(kept(df, config)).write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
