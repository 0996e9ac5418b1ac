"""Facts by content: a store of what has been parsed before, keyed by the digest of a text.

``with_facts`` parses only texts whose digest the store does not have, once each however many files share them, and appends their
facts; files then get theirs by a join on the digest. A tree that is scanned again after a few edits parses the edited files.

A store is a folder of Parquet. Facts of another layout, or of another version of the language, are other facts: they
lie in a folder of their own below it. Runs that add the same digest at the same time do no harm; one of the rows counts.
A digest that many files share (empty files) is brought down to one row in each task before anything is shuffled.

Defined results: as of ``facts``; texts that cannot be parsed are in the store as such, and are not tried again.
"""

from __future__ import annotations

import sys
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.facts import FACTS, facts

SCHEMA = f"digest string, facts {FACTS}"


def folder(store: str) -> str:
    """Where facts of this layout and language are."""
    return f"{store.rstrip('/')}/{zlib.crc32(FACTS.encode()):08x}-py{sys.version_info[0]}{sys.version_info[1]}"


def digest(text: Column, ext: Column) -> Column:
    """Of Python files with a text; null for all else."""
    return F.when(ext == "py", F.sha2(text.cast("binary"), 256))


def known(spark: SparkSession, store: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(store))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder(store))


def unknown(files: DataFrame, store: str) -> DataFrame:
    """(digest, text): each text that the store has no facts of, once."""
    mine = files.select(digest(F.col("text"), F.col("ext")).alias("digest"), "text").where("digest IS NOT NULL")
    return mine.join(known(files.sparkSession, store).select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))


def learn(files: DataFrame, store: str) -> None:
    """Parses what is new and appends it."""
    unknown(files, store).select("digest", facts(F.col("text"), F.lit("py")).alias("facts")).write.mode("append").parquet(folder(store))


def with_facts(files: DataFrame, store: str) -> DataFrame:
    """``files`` with ``facts``, after ``learn``."""
    learn(files, store)
    have = known(files.sparkSession, store).groupBy("digest").agg(F.first("facts").alias("facts"))
    mine = files.withColumn("digest", digest(F.col("text"), F.col("ext")))
    return mine.join(have, "digest", "left").drop("digest")
