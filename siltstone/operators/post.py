"""What happens to findings after detection. Each step returns what stays; the dropped rows are counted by ``dropped``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema

# The marker's pattern, ids that do not matter in tests, names of test directories.
NOSEC = r"(?iUd)#\s*nosec\b(?:\s+([\w,-]+))?"
QUIET_IN_TESTS = ("CWE-798", "CWE-617", "CWE-918", "CWE-770")
TEST_DIRS = ("tests", "test")
FINGERPRINT = ("cwe_id", "file", "code")


def suppressed() -> Column:
    """Whether the finding's line says so: a bare marker takes all ids, one with a list those in it."""
    line = F.coalesce("source", F.lit(""))
    scope = F.filter(F.split(F.upper(F.regexp_extract(line, NOSEC, 1)), ","), lambda x: x != "")
    return F.regexp_like(line, F.lit(NOSEC)) & ((F.size(scope) == 0) | F.array_contains(scope, F.upper("cwe_id")))


def confident(least: str = "LOW") -> Column:
    return F.col("conf_rank") <= schema.CONFIDENCES.index(least)


def is_test_path(file: Column, more: tuple[str, ...] = ()) -> Column:
    parts = F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/", -1)
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    named = (name == "conftest.py") | (name.endswith(".py") & (name.startswith("test_") | name.endswith("_test.py")))
    return named | F.exists(dirs, lambda d: d.isin(*TEST_DIRS, *more))


def quiet_in_tests(more: tuple[str, ...] = ()) -> Column:
    return F.col("cwe_id").isin(*QUIET_IN_TESTS) & is_test_path(F.col("file"), more)


def fingerprints(findings: DataFrame) -> DataFrame:
    """What identifies findings across edits: no line numbers."""
    return findings.select(*FINGERPRINT).distinct()


def not_in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """An anti-join; which side is broadcast, if any, is left to the sizes."""
    return findings.join(baseline.select(*FINGERPRINT).distinct(), list(FINGERPRINT), "left_anti").select(*findings.columns)


def in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select(*FINGERPRINT).distinct(), list(FINGERPRINT), "left_semi").select(*findings.columns)


def first_package(files: DataFrame) -> DataFrame:
    """One row for each path: source files before manifests, then the first package by name."""
    w = Window.partitionBy("path").orderBy(F.col("is_manifest").asc(), F.col("package").asc())
    return files.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def with_locks(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``locked`` of each manifest: a lock file beside it, or a requirements.txt that is not the manifest itself.

    ``listing`` has ``dir`` and ``name`` of files; only lock names of it take part in the join.
    """
    from siltstone.operators.manifest_rules import LOCKFILES

    locks = listing.where(F.col("name").isin(*LOCKFILES, "requirements.txt")).groupBy("dir").agg(F.max(F.col("name").isin(*LOCKFILES)).alias("lock"), F.max(F.col("name") == "requirements.txt").alias("pinned"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    found = files.drop("locked").withColumn("dir", parent).join(locks, "dir", "left").drop("dir")
    return found.withColumn("locked", F.coalesce(F.col("lock") | (F.col("pinned") & (F.col("name") != "requirements.txt")), F.lit(False))).drop("lock", "pinned")


def summary(findings: DataFrame, column: str) -> DataFrame:
    """Counts by severity or confidence, without labels that have none."""
    return findings.groupBy(column).agg(F.count("*").alias("n"))


def in_order(findings: DataFrame) -> DataFrame:
    """The order of JSON reports: path, check, emission."""
    return findings.orderBy(*schema.ORDER)


def by_severity(findings: DataFrame) -> DataFrame:
    """The order of text reports."""
    return findings.orderBy("sev_rank", "file", "line", *schema.ORDER)


def gate(findings: DataFrame, fail_on: str = "HIGH") -> DataFrame:
    """One row: exit_code 1 if any finding is at least as severe, else 0."""
    bad = F.col("sev_rank") <= schema.SEVERITIES.index(fail_on)
    return findings.agg(F.coalesce(F.max(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("int").alias("exit_code"))


def rollup(findings: DataFrame) -> DataFrame:
    """Beyond the scan itself: counts by package and id with subtotals."""
    return findings.rollup("package", "cwe_id").agg(F.count("*").alias("n"))
