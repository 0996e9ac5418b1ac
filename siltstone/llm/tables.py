"""Reading the tables and cutting lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session names none (as in tests), one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shared")).rstrip("/")


_made: list[list[str]] = []


def made(spark: SparkSession, path: str) -> str:
    """Notes a folder that the innermost ``scratch`` is to delete."""
    if _made:
        _made[-1].append(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to a new folder of the shared place and read again: lineage ends here."""
    path = made(df.sparkSession, f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of the operators called inside are deleted at the end: use their results inside, too.

    An operator's result is lazy and reads its last intermediate tables when it is used, so only its caller knows when
    they can go.
    """
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def with_text(df: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` without nulls; other columns, whatever their names, are left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def parts(spark: SparkSession, rows: int, most: int) -> int:
    """How many groups of about ``most`` rows; at least one."""
    return max(1, -(-int(rows) // most))


BITS = 1 << 24


def key_bitmap(keys: DataFrame, column: str):
    """A broadcast bitmap of ``BITS`` bits (2 MB at any size) in which the long keys' bits are set.

    It tells rows that surely have no partner from those that may have one, so that only the latter move in a
    join. With far more keys than bits it tells nothing and costs nothing but its 2 MB.
    """
    import numpy as np

    place = F.pmod(F.col(column), F.lit(BITS))
    words = keys.select(F.shiftright(place, 6).cast("int").alias("word"), place.alias("place")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    if words.num_rows:
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def may_hold(bitmap, keys):
    """For each long key, whether its bit is set."""
    import numpy as np

    place = np.mod(keys, BITS)
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def rows_by_bitmap(df: DataFrame, column: str, bitmap, wanted: bool) -> DataFrame:
    """The rows of ``df`` whose key may be in the bitmap (or surely is not), without a shuffle."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            m = may_hold(bitmap.value, b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(m == wanted))

    return df.mapInArrow(run, df.schema)
