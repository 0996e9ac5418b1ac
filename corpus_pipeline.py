"""From raw documents to packed sequences, in five stages.

Each stage is given what its predecessor kept and returns a DataFrame that is written as Parquet and read
again before the next. All but the last return the columns of ``documents``.

1. quality rules - documents that the rules or the n-gram ratio reject go;
2. line dedup - later occurrences of repeated three-line windows are cut out of the texts (``n_chars`` follows);
   a document of which no word is left goes;
3. MinHash near-dedup - documents whose five-word shingles have a similarity of 0.8 or more are linked, and of
   each component the document with the smallest id stays;
4. benchmark decontamination - documents that a benchmark item contaminates go;
5. best-fit packing - the rest as sequences of at most 2048 tokens, one row for each piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import line_windows, minhash_bayes, packing_gga, quality_llr, template_leaks
from siltstone.llm.tables import delete, scratch, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_llr.filter_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the operator's own result columns must not meet the caller's
    apart = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"in_{k}") for k, c in enumerate(docs.columns)])
    cut = line_windows.remove_repeats(apart)
    gone = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    length = lambda k: F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(f"in_{k}"))
    return cut.where(~gone).select(*[F.col(c) if c in ("doc_id", "text") else (length(k) if c == "n_chars" else F.col(f"in_{k}")).alias(c) for k, c in enumerate(docs.columns)])


#: The stage's own bound, 0.8; 35 bands of 5 miss a link at 0.8 with a probability of about 1e-6.
NEAR = minhash_bayes.NearParams(percent=80, shingle=5, bands=35, rows=5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_bayes.drop_near_duplicates(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_leaks.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_gga.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Line windows, near-duplicate components and the evolved packing have no SQL form; the tests of the operators and of
#: the stages hold each against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage but the last wrote on its way is deleted when its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
