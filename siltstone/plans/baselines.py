"""Baselines as tables: snapshots of fingerprints, bucketed so that comparing with one never moves it.

``save`` writes a table of the catalogue bucketed and sorted by the three columns of a fingerprint; a run joins its findings to it on
those columns, so only the findings are shuffled, into the table's buckets. The JSON file is for import and export.

Defined results: a table is replaced as a whole; a snapshot of no findings is a table without rows, which drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import post
from siltstone.plans import report

SCHEMA = "cwe_id string, file string, code string"
BUCKETS = 64


def save(findings: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """The findings' fingerprints as the baseline ``table``."""
    rows = post.fingerprints(findings).repartition(buckets, *post.FINGERPRINT)
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *post.FINGERPRINT).sortBy(*post.FINGERPRINT).saveAsTable(table)


def load(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).select(*post.FINGERPRINT)


def import_json(spark: SparkSession, path: str, table: str, buckets: int = BUCKETS) -> None:
    """A snapshot file as a table; what is no snapshot is an empty one."""
    save(read_json(spark, path), table, buckets)


def export_json(spark: SparkSession, table: str, path: str) -> None:
    report.write_baseline(load(spark, table), path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The fingerprints of a snapshot file, parsed on an executor; none where it is no snapshot: not UTF-8, no JSON, or an entry that
    is not three strings."""
    text = spark.read.format("binaryFile").load(path).select(F.try_validate_utf8(F.col("content").cast("string")).alias("text"))

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            found = [x for t in b.column(0).to_pylist() for x in report.baseline_rows(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], ["cwe_id", "file", "code"])

    return text.mapInArrow(rows, SCHEMA).distinct()
