"""The command line: scan directories, print a report, and exit by severity."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from siltstone import __version__
from siltstone.operators import advisories
from siltstone.plans import baselines, report
from siltstone.plans.pipeline import ScanConfig, passes, run
from siltstone.sources import discovery, listing
from siltstone.sources.tree import read_tree, tree_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("siltstone", description="Security findings of Python source trees and dependency manifests.")
    p.add_argument("--json", action="store_true", help="report as JSON")
    p.add_argument("--json-lines", metavar="DIR", help="write the findings as JSON lines below DIR, and print no report")
    p.add_argument("--quiet", "-q", action="store_true", help="no banner")
    p.add_argument("--config", type=Path, help="TOML file with a [packages] table")
    p.add_argument("--package", action="append", default=[], metavar="NAME=PATH", help="add or replace a package")
    p.add_argument("--packages", nargs="+", metavar="NAME", help="scan these packages only")
    p.add_argument("--exclude", nargs="+", default=[], metavar="PART", help="leave out paths with this part")
    p.add_argument("--fail-on", default="high", choices=["critical", "high", "medium", "low", "info"], help="least severity that fails the run")
    p.add_argument("--confidence-min", default="low", choices=["high", "medium", "low"], help="least confidence to report")
    p.add_argument("--include-tests", action="store_true", help="report everything in test code too")
    p.add_argument("--test-paths", nargs="+", default=[], metavar="DIR", help="further names of test directories")
    p.add_argument("--baseline", type=Path, help="report only what this snapshot does not have")
    p.add_argument("--write-baseline", type=Path, help="write a snapshot and exit with 0")
    p.add_argument("--baseline-table", metavar="TABLE", help="report only what this table of fingerprints does not have")
    p.add_argument("--write-baseline-table", metavar="TABLE", help="write a table of fingerprints and exit with 0")
    p.add_argument("--advisories", metavar="FILE", help="CSV (with a head) or Parquet of dependency, introduced, fixed, advisory, in place of the built-in table")
    p.add_argument("--fact-store", metavar="DIR", help="keep the facts of parsed files, by content, for the next run")
    p.add_argument("--output", type=Path, metavar="FILE", help="write the report to a file")
    p.add_argument("--gate-only", action="store_true", help="no report: stop at the first finding that fails the run")
    p.add_argument("--version", action="version", version=f"siltstone {__version__}")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, cwd: Path | None = None) -> int:
    args, cwd = parser().parse_args(argv), cwd or Path.cwd()
    try:
        return _main(args, spark, cwd)
    except discovery.UsageError as e:
        print(e, file=sys.stderr)
        return 2


def _main(args: argparse.Namespace, spark: SparkSession | None, cwd: Path) -> int:
    workspace = discovery.workspace_root(cwd)
    exclude, loose = tuple(args.exclude), None
    if args.config is None and not args.package:
        packages, loose = discovery.discover(cwd)
        exclude += discovery.DEFAULT_EXCLUDES
    else:
        packages = discovery.resolve(args.config, args.package, cwd, workspace)
    if not packages:
        raise discovery.UsageError("error: there are no packages to scan")
    packages = discovery.select(packages, args.packages)
    spark = spark or SparkSession.builder.appName("siltstone").getOrCreate()
    with listing.scratch(spark):
        return _scan(args, spark, packages, loose, exclude, workspace)


def _scan(args: argparse.Namespace, spark: SparkSession, packages: dict[str, str], loose: str | None, exclude: tuple[str, ...], workspace: Path | None) -> int:
    files = listing.written(tree_files(spark, packages, loose, exclude, workspace), "files")
    if not args.quiet and not args.json:
        print(f"\n  {'=' * 72}\n  siltstone: {len(packages)} packages, {files.where(files.path.endswith('.py')).count()} files\n  {'=' * 72}\n")
    baseline = None
    if args.baseline_table and not (args.write_baseline or args.write_baseline_table) and spark.catalog.tableExists(args.baseline_table):
        baseline = baselines.load(spark, args.baseline_table)
    elif args.baseline and not (args.write_baseline or args.write_baseline_table):
        try:
            with args.baseline.open("rb") as f:
                f.read().decode("utf-8")
        except (OSError, UnicodeDecodeError) as e:
            raise discovery.UsageError(f"error: baseline {args.baseline} cannot be read: {e}") from e
        baseline = baselines.read_json(spark, args.baseline.resolve().as_uri())
    advised = None
    if args.advisories:
        read = spark.read.parquet if args.advisories.endswith(".parquet") else spark.read.schema(advisories.SCHEMA).option("header", True).csv
        try:
            advised = read(args.advisories).select("dependency", "introduced", "fixed", "advisory")
        except AnalysisException as e:
            raise discovery.UsageError(f"error: advisories {args.advisories} cannot be read: {e}") from e
    config = ScanConfig(None, args.confidence_min.upper(), args.include_tests, tuple(args.test_paths), args.fail_on.upper(), advised, args.fact_store)
    source = read_tree(spark, files, workspace)
    if args.gate_only:
        return 0 if passes(source, config, baseline) else 1
    result = run(source, config, baseline)
    if args.write_baseline:
        try:
            args.write_baseline.touch()
            report.write_baseline(result.findings, str(args.write_baseline.resolve()))
        except OSError as e:
            raise discovery.UsageError(f"error: baseline {args.write_baseline} cannot be written: {e}") from e
    if args.write_baseline_table:
        baselines.save(result.findings, args.write_baseline_table)
    if args.json_lines:
        report.write_lines(result.findings, args.json_lines)
    else:
        kind, write = ("json", report.write_json) if args.json else ("text", report.write_text)
        path = str(args.output.resolve()) if args.output else report.temporary(result.findings, kind)
        write(result.findings, result.counters, path)
        if not args.output:
            for piece in report.streamed(path):
                print(piece, end="")
            print()
    return 0 if args.write_baseline or args.write_baseline_table else result.exit_code(config.fail_on)
