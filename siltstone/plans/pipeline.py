"""The whole run: detection, then suppression, confidence, test paths and baseline, in that order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.operators import post
from siltstone.plans.scan import scan
from siltstone.sources.listing import delete, new_folder


@dataclass(frozen=True)
class ScanConfig:
    checks: list[str] | None = None
    confidence_min: str = "LOW"
    include_tests: bool = False
    test_paths: tuple[str, ...] = ()
    fail_on: str = "HIGH"
    advisories: DataFrame | None = None
    store: str | None = None


@dataclass
class ScanResult:
    """``findings`` are read from ``folder``, where the run has written them."""

    findings: DataFrame
    folder: str
    counters: dict[str, int] = field(default_factory=dict)
    worst: int | None = None

    def exit_code(self, fail_on: str = "HIGH") -> int:
        return int(self.worst is not None and self.worst <= schema.SEVERITIES.index(fail_on))

    def done(self) -> None:
        """The findings have been used: their folder can go."""
        delete(self.findings.sparkSession, self.folder)


def classified(files: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """All findings with ``fate``: nosec, confidence, test or kept - each row goes to the first that takes it."""
    c = config or ScanConfig()
    quiet = F.lit(False) if c.include_tests else post.quiet_in_tests(c.test_paths)
    fate = F.when(post.suppressed(), "nosec").when(~post.confident(c.confidence_min), "confidence").when(quiet, "test").otherwise("kept")
    return scan(files, c.checks, c.advisories, c.store).withColumn("fate", fate)


def kept(files: DataFrame, config: ScanConfig | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """The findings of a run, lazily."""
    found = classified(files, config).where("fate = 'kept'").drop("fate")
    return found if baseline is None else post.not_in_baseline(found, baseline)


def run(files: DataFrame, config: ScanConfig | None = None, baseline: DataFrame | None = None) -> ScanResult:
    """Findings, the counts of what was dropped and the worst severity that was kept: one job, which detects, decides, writes what
    stays and observes the counts on the way. Nothing is cached; reports read what was written."""
    rows = classified(files, config)
    if baseline is not None:
        known = baseline.select(*post.FINGERPRINT).distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, list(post.FINGERPRINT), "left").withColumn("fate", F.when((F.col("fate") == "kept") & F.col("known"), "baseline").otherwise(F.col("fate"))).drop("known")
    seen = Observation()
    of = lambda fate: F.coalesce(F.sum(F.when(F.col("fate") == fate, 1)), F.lit(0)).alias(fate)
    watched = rows.observe(seen, of("baseline"), of("nosec"), of("test"), F.min(F.when(F.col("fate") == "kept", F.col("sev_rank"))).alias("worst"))
    kept_rows = watched.where("fate = 'kept'").drop("fate")
    folder = new_folder(files.sparkSession, "findings")
    kept_rows.write.parquet(folder)
    got = seen.get
    return ScanResult(files.sparkSession.read.schema(kept_rows.schema).parquet(folder), folder, {f"{k}_suppressed": got[k] for k in ("baseline", "nosec", "test")}, got["worst"])


def passes(files: DataFrame, config: ScanConfig | None = None, baseline: DataFrame | None = None) -> bool:
    """Whether no finding is severe enough to fail; ends with the first one that is, and counts nothing."""
    c = config or ScanConfig()
    return kept(files, c, baseline).where(F.col("sev_rank") <= schema.SEVERITIES.index(c.fail_on)).limit(1).count() == 0
