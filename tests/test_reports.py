"""Documents written by tasks, counters observed on the way, baselines as tables."""

import json
from pathlib import Path

import pytest

from siltstone import schema
from siltstone.cli import main
from siltstone.operators import post
from siltstone.plans import baselines, layout, pipeline, report
from siltstone.plans.corpus import TEMPLATES
from siltstone.plans.scan import scan
from siltstone.sources.listing import shared_folder
from tests.test_rules import rows
from tests.test_run import tree  # noqa: F401


@pytest.fixture(scope="module")
def findings(spark):
    df = scan(rows(spark, [(t.name or "m.py", t.text + "\n# ünïcode \"quoted\"") for t in TEMPLATES])).cache()
    yield df
    df.unpersist()


def plain(findings, order):
    return [r.asDict() for r in order(findings).select(*schema.PUBLIC).collect()]


@pytest.mark.parametrize("counters", [{}, {"nosec_suppressed": 3, "baseline_suppressed": 0}])
def test_json_is_what_one_writer_would_write(spark, findings, counters, tmp_path):
    for some in (findings, findings.where("severity = 'LOW'"), findings.where("false")):
        want = plain(some, post.in_order)
        payload = {"findings": want, "count": len(want)} | {k: v for k, v in counters.items() if v}
        if want and not counters:
            payload["suppression_hint"] = layout.HINT
        report.write_json(some.repartition(5), counters, str(tmp_path / "r.json"))
        assert (tmp_path / "r.json").read_text() == json.dumps(payload, indent=2, ensure_ascii=False)
    assert report.as_json(findings, counters) and [p.name for p in tmp_path.iterdir()] == ["r.json"]


@pytest.mark.parametrize("split", ["509", "128m"])
def test_json_is_read_in_splits(spark, findings, tmp_path, split):
    from pyspark.sql import functions as F

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    odd = F.concat("code", F.lit('\n    },\n    {\n  ],\n"\\ü'))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        for k, some in enumerate((findings, findings.where("severity = 'LOW'").withColumn("code", odd), findings.limit(1), findings.where("false"))):
            path, want = str(tmp_path / f"{k}.json"), plain(some, post.in_order)
            report.write_json(some, {"nosec_suppressed": 3, "test_suppressed": 0}, path)
            read = report.read_json(spark, path)
            got = [r.asDict() for r in read.collect()]
            key = lambda r: tuple(map(str, r.values()))
            assert sorted(got, key=key) == sorted((r | {"count": len(want), "baseline_suppressed": 0, "nosec_suppressed": 3, "test_suppressed": 0} for r in want), key=key)
            if split != "128m" and k < 2:
                assert read.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_text_has_all_findings_in_order_and_their_counts(findings, tmp_path):
    report.write_text(findings, {"test_suppressed": 2}, str(tmp_path / "r.txt"))
    text, want = (tmp_path / "r.txt").read_text(), plain(findings, post.by_severity)
    assert f"RESULT: {len(want)} finding(s)\n  (2 finding(s) in test code" in text
    assert [x.removeprefix("  File:    ") for x in text.split("\n") if x.startswith("  File:")] == [f"{r['file']}:{r['line']}" for r in want]
    assert [x.removeprefix("  Code:    ") for x in text.split("\n") if x.startswith("  Code:")] == [r["code"] for r in want]
    for label in schema.SEVERITIES:
        n = sum(r["severity"] == label for r in want)
        assert f"{n:>4} × {label}" in text
    assert "checks passed" in report.as_text(findings.where("false"), {}) and layout.HINT in text


def test_snapshot_file(findings):
    want = sorted({(r["cwe_id"], r["file"], r["code"]) for r in plain(findings, post.in_order)})
    assert report.baseline_json(findings) == json.dumps({"fingerprints": [list(x) for x in want]}, indent=2, ensure_ascii=False) + "\n"
    assert report.baseline_json(findings.where("false")) == '{\n  "fingerprints": []\n}\n'
    assert sorted(report.baseline_rows(report.baseline_json(findings))) == want


def test_a_task_that_fails_leaves_nothing(spark, findings, tmp_path):
    from pyspark.sql import functions as F

    bad = findings.withColumn("severity", F.when(F.col("cwe_id") == "CWE-94", "no label").otherwise(F.col("severity")))
    with pytest.raises(Exception, match="no label"):
        report.write_text(bad, {}, str(tmp_path / "r.txt"))
    assert list(tmp_path.iterdir()) == []


def test_counts_come_with_the_run(spark):
    f = rows(spark, [("a.py", "eval(a)  # nosec\neval(b)\nd = f.read()"), ("tests/x.py", 'PASSWORD = "hunter22"'), ("b.py", "eval(b)\nx = y.read()")])
    f = f.withColumn("file", f["path"])
    old = spark.createDataFrame([("CWE-770", "/w/f2/b.py", "x = y.read()"), ("CWE-94", "/w/f0/a.py", "eval(a)  # nosec"), ("CWE-94", "gone", "x")], baselines.SCHEMA)
    r = pipeline.run(f, pipeline.ScanConfig(), old)
    assert r.counters == {"baseline_suppressed": 1, "nosec_suppressed": 1, "test_suppressed": 1}
    assert sorted((x.file, x.line) for x in r.findings.collect()) == [("/w/f0/a.py", 2), ("/w/f0/a.py", 3), ("/w/f2/b.py", 1)]
    assert r.worst == 0 and r.exit_code("CRITICAL") == 1
    r.done()
    group = "counted"
    spark.sparkContext.setJobGroup(group, "one run")
    r = pipeline.run(f)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("rest", "")
    assert len(jobs) <= 2, jobs  # the run, and the broadcast of the table of variants
    assert r.findings.count() == 4
    r.done()
    assert not Path(r.folder.removeprefix("file:")).exists()
    clean = pipeline.run(rows(spark, [("a.py", "x = 1")]))
    assert clean.worst is None and clean.exit_code("INFO") == 0 and clean.findings.count() == 0


def test_gate_without_counts(spark):
    f = rows(spark, [("a.py", "d = f.read()"), ("b.py", "try:\n    f()\nexcept ValueError:\n    pass")])
    assert pipeline.passes(f) and not pipeline.passes(f, pipeline.ScanConfig(fail_on="MEDIUM"))
    worst = scan(f).where("severity = 'MEDIUM'").select(*post.FINGERPRINT)
    assert pipeline.passes(f, pipeline.ScanConfig(fail_on="MEDIUM"), worst)


def test_baseline_table(spark, findings, tmp_path):
    baselines.save(findings.where("severity <> 'HIGH'"), "known_findings", 4)
    table = baselines.load(spark, "known_findings")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, post.fingerprints(findings.where("severity <> 'HIGH'")).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = post.not_in_baseline(findings, table)
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    below = plan[plan.index("Bucketed: true") - 2500 :]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, below
    found = {(r.cwe_id, r.file, r.code) for r in findings.collect() if r.severity != "HIGH"}
    assert {(r.cwe_id, r.file, r.code) for r in left.collect()} == {(r.cwe_id, r.file, r.code) for r in findings.collect()} - found
    baselines.export_json(spark, "known_findings", str(tmp_path / "b.json"))
    baselines.import_json(spark, (tmp_path / "b.json").as_uri(), "again", 3)
    assert sorted(map(tuple, baselines.load(spark, "again").collect())) == sorted(map(tuple, table.collect()))
    for bad in (b"\xff", b"[]", b'{"fingerprints": [["a", "b"]]}', b""):
        (tmp_path / "bad.json").write_bytes(bad)
        assert baselines.read_json(spark, (tmp_path / "bad.json").as_uri()).count() == 0
    for t in ("known_findings", "again"):
        spark.sql(f"DROP TABLE {t}")


def test_command_line_with_tables_and_files(spark, tree, capsys, tmp_path_factory):  # noqa: F811
    out = tmp_path_factory.mktemp("out") / "report.json"
    assert main(["--json", "--output", str(out)], spark, tree) == 1
    assert json.loads(out.read_text())["count"] == 4 and capsys.readouterr().out == ""
    assert main(["--gate-only", "-q"], spark, tree) == 1 and capsys.readouterr().out == ""
    assert main(["--write-baseline-table", "cli_known", "-q"], spark, tree) == 0
    capsys.readouterr()
    assert main(["--baseline-table", "cli_known", "-q"], spark, tree) == 0
    assert "(4 finding(s) that the baseline has already)" in capsys.readouterr().out
    assert main(["--baseline-table", "cli_known", "--gate-only", "-q"], spark, tree) == 0
    spark.sql("DROP TABLE cli_known")
    shared = Path(shared_folder(spark))
    before = {p.name for p in shared.iterdir()}
    assert main(["--package", f"x={tree / 'build'}", "-q"], spark, tree) == 1
    assert {p.name for p in shared.iterdir()} == before and not list(shared.glob("json-*"))


@pytest.mark.parametrize("query", ["baseline_anti_join", "baseline_table"])
def test_a_snapshot_and_what_is_compared_are_one_scan(spark, monkeypatch, query):
    from siltstone import queries

    calls, d = [], "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "scan", lambda *args: calls.append(args) or scan(*args))
    got = sorted(map(tuple, queries.queries()[query](spark, d).collect()))
    assert len(calls) == 1
    found = scan(queries.tree(spark, d))
    want = [tuple(r)[1:] for r in found.select("package", "check_id", *queries.COLUMNS).collect() if r.package not in ("pkg0", "pkg1", "pkg2")]
    assert got == sorted(want) and got
