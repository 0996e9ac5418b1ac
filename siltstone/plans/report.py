"""Reports of a run, each written by the tasks that hold the findings (``sources.report_sink``) or as JSON lines."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.operators import post
from siltstone.sources.listing import shared_folder
from siltstone.sources.report_sink import CHUNK, ReportSink, where


def _save(ordered: DataFrame, path: str, kind: str, counters: dict[str, int]) -> None:
    ordered.sparkSession.dataSource.register(ReportSink)
    ordered.write.format("siltstone_report").option("path", path).option("kind", kind).option("counters", json.dumps(counters)).mode("append").save()


def write_json(findings: DataFrame, counters: dict[str, int], path: str) -> None:
    """One JSON document: the findings in report order, their number, and the counters that are not 0."""
    _save(post.in_order(findings).select(*schema.PUBLIC), path, "json", counters)


def write_text(findings: DataFrame, counters: dict[str, int], path: str) -> None:
    """The report for people: the most severe first, counts and covered ids at its end."""
    _save(post.by_severity(findings).select(*schema.PUBLIC), path, "text", counters)


def write_baseline(findings: DataFrame, path: str) -> None:
    """The snapshot file: distinct fingerprints in order."""
    _save(post.fingerprints(findings).orderBy(*post.FINGERPRINT), path, "baseline", {})


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A document of ``write_json`` again: its findings, beside each the document's ``count`` and counters (0 where it names none).

    It is read in splits, by what ends an entry there (a line feed within a string is written as \\n), however large it is."""
    pieces = spark.read.option("lineSep", "\n    }").text(path)
    start, end = "\n    {\n", "\n  ],\n"
    entry = F.concat(F.lit("{"), F.substring_index("value", start, -1), F.lit("}"))
    fields = ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in schema.PUBLIC)
    found = pieces.where(F.contains("value", F.lit(start))).select(F.from_json(entry, fields, {"mode": "FAILFAST"}).alias("f")).select("f.*")
    named = ("count", "baseline_suppressed", "nosec_suppressed", "test_suppressed")
    tail = F.concat(F.lit("{"), F.substring_index("value", end, -1))
    rest = pieces.where(F.startswith("value", F.lit(end))).select(F.from_json(tail, ", ".join(f"{c} long" for c in named), {"mode": "FAILFAST"}).alias("t"))
    return found.crossJoin(F.broadcast(rest.select(*[F.coalesce(f"t.{c}", F.lit(0)).alias(c) for c in named])))


def write_lines(findings: DataFrame, path: str) -> None:
    """JSON lines in report order, a file for each part."""
    post.in_order(findings).select(*schema.PUBLIC).write.json(path)


def streamed(path: str) -> Iterator[str]:
    """A document in pieces, deleted when it has been read."""
    system, name = where(path)
    with system.open_input_stream(name) as source:
        rest = b""
        while block := source.read(CHUNK):
            whole = rest + block
            cut = whole.rfind(b"\n") + 1 or len(whole)
            yield whole[:cut].decode()
            rest = whole[cut:]
        yield rest.decode()
    system.delete_file(name)


def temporary(findings: DataFrame, kind: str) -> str:
    return f"{shared_folder(findings.sparkSession)}/{kind}-{os.urandom(8).hex()}"


def as_json(findings: DataFrame, counters: dict[str, int]) -> str:
    path = temporary(findings, "json")
    write_json(findings, counters, path)
    return "".join(streamed(path))


def as_text(findings: DataFrame, counters: dict[str, int]) -> str:
    path = temporary(findings, "text")
    write_text(findings, counters, path)
    return "".join(streamed(path))


def baseline_json(findings: DataFrame) -> str:
    path = temporary(findings, "baseline")
    write_baseline(findings, path)
    return "".join(streamed(path))


def baseline_rows(text: str) -> list[tuple[str, str, str]]:
    """The fingerprints of a snapshot; none if it is not one."""
    try:
        got = json.loads(text)["fingerprints"]
        if all(isinstance(x, list) and len(x) == 3 and all(isinstance(y, str) for y in x) for x in got):
            return [tuple(x) for x in got]
    except (ValueError, TypeError, KeyError):
        pass
    return []
