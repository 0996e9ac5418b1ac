"""Discovery, sources, the steps after detection, reports and the command line."""

import json
import os

import pytest

from siltstone.cli import main
from siltstone.operators import post
from siltstone.plans import pipeline, report
from siltstone.sources import discovery
from siltstone.sources.tree import read_tree
from siltstone.streaming.incremental import read_files, scan_stream
from tests.test_rules import rows


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("a/__init__.py", "eval(x)\n")
    put("a/b.py", "pickle.loads(b)  # nosec\nassert 'admin' in roles\n")
    put("a/tests/test_b.py", 'PASSWORD = "hunter22"\n')
    put("a/bad.py", b"eval(x)\n\xff")
    put("a/requirements.txt", "dask==1.0.0\n")
    put("build/c.py", "eval(x)\n")
    put("empty/readme.md", "x")
    put("loose.py", "d = f.read()\n")
    put("siltstone/operators/text_rules.py", "eval(x)\n")
    return tmp_path


def test_discover(tree):
    packages, loose = discovery.discover(tree)
    assert sorted(packages) == sorted(["a", "siltstone", tree.name]) and loose == tree.name
    files = discovery.file_set(packages, loose, discovery.DEFAULT_EXCLUDES, tree)
    assert sorted(os.path.relpath(p, tree) for p in files) == ["a/__init__.py", "a/b.py", "a/bad.py", "a/requirements.txt", "a/tests/test_b.py", "loose.py"]
    assert files[str(tree / "a/requirements.txt")] == "a"


def test_registry_errors(tree, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    for entry in ("x", "=p", "n=", "n=missing", f"n={other}"):
        with pytest.raises(discovery.UsageError):
            discovery.packages_from_args([entry], tree, None)
    (tree / "c.toml").write_text('[packages]\nq = "a"\n')
    got = discovery.resolve(tree / "c.toml", ["r=build"], tree, None)
    assert {k: os.path.basename(v) for k, v in got.items()} == {"q": "a", "r": "build"}
    (tree / "d.toml").write_text("x = 1")
    with pytest.raises(discovery.UsageError):
        discovery.packages_from_config(tree / "d.toml", tree, None)
    with pytest.raises(discovery.UsageError, match="zz"):
        discovery.select(got, ["q", "zz"])


def test_workspace_and_manifests(tree):
    assert discovery.workspace_root(tree / "a") is None
    (tree / "pyproject.toml").write_text("[tool.uv.workspace]\n")
    assert discovery.workspace_root(tree / "a") == tree
    assert discovery.manifests(str(tree / "build"), tree) == [str(tree / "pyproject.toml")]
    assert discovery.manifest_label(str(tree / "pyproject.toml"), {"a": str(tree / "a")}) == tree.name
    assert not discovery.locked(str(tree / "a/requirements.txt"))
    (tree / "a/uv.lock").write_text("")
    assert discovery.locked(str(tree / "a/requirements.txt"))


def test_source_reads_underscore_files(spark, tree):
    packages, loose = discovery.discover(tree)
    f = read_tree(spark, discovery.file_set(packages, loose, discovery.DEFAULT_EXCLUDES, tree), tree)
    got = {r.file: r for r in f.collect()}
    assert got["a/__init__.py"].text == "eval(x)\n" and got["a/bad.py"].text is None
    assert got["a/requirements.txt"].ext == "txt" and got["loose.py"].package == tree.name


def test_order_is_by_component(spark):
    f = spark.createDataFrame([(p, p.split("/"), p, "k", p, "py", "eval(x)", False) for p in ("a.py", "a-b/c.py", "a/b.py")], rows(spark, [("a.py", "")]).schema)
    assert [r.file for r in post.in_order(pipeline.kept(f)).collect()] == ["a/b.py", "a-b/c.py", "a.py"]


def test_suppression_grammar(spark):
    lines = ["eval(a)  # nosec", "eval(a)  # nosec CWE-1", "eval(a)  # nosec cwe-94,CWE-1", "eval(a)  # nosec -- why", "eval(a)  # nosec: why", "eval(a)  # nosec ,", "eval(a)  #NOSEC", "eval(a)  # nosecure", "eval(a)  # nosec some words"]
    r = pipeline.run(rows(spark, [("a.py", "\n".join(lines))]))
    assert [x.line for x in post.in_order(r.findings).collect()] == [2, 4, 8, 9]
    assert r.counters["nosec_suppressed"] == 5


def test_test_paths(spark):
    names = ["tests/a.py", "test/a.py", "test_a.py", "a_test.py", "conftest.py", "atest/a.py", "test_a.txt", "my/tests.py", "evals/a.py"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    got = df.select(post.is_test_path(df.file).alias("x"), post.is_test_path(df.file, ("evals",)).alias("y")).collect()
    assert [r.x for r in got] == [True] * 5 + [False] * 4 and got[-1].y


def test_baseline(spark):
    f = rows(spark, [("a.py", "eval(a)\neval(b)")])
    first = pipeline.run(rows(spark, [("a.py", "eval(a)")]))
    text = report.baseline_json(first.findings)
    assert json.loads(text) == {"fingerprints": [["CWE-94", "f0/a.py", "eval(a)"]]} and text.endswith("}\n")
    base = spark.createDataFrame(report.baseline_rows(text), "cwe_id string, file string, code string")
    r = pipeline.run(f, None, base)
    assert [x.line for x in r.findings.collect()] == [2] and r.counters["baseline_suppressed"] == 1
    assert report.baseline_rows("{") == report.baseline_rows('{"fingerprints": [1]}') == report.baseline_rows("[]") == []


def test_locks_by_listing(spark):
    f = rows(spark, [("Pipfile", "x"), ("requirements.txt", "x"), ("pyproject.toml", "x")])
    listing = spark.createDataFrame([("/w/f0", "poetry.lock"), ("/w/f1", "requirements.txt"), ("/w/f2", "requirements.txt")], "dir string, name string")
    assert {r.name: r.locked for r in post.with_locks(f, listing).collect()} == {"Pipfile": True, "requirements.txt": False, "pyproject.toml": True}


def test_json_lines(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("lines") / "found"
    assert main(["--json-lines", str(out)], spark, tree) == 1
    got = [json.loads(x) for p in sorted(out.glob("part-*")) for x in p.read_text().splitlines()]
    assert [f["file"].rsplit("/", 1)[-1] for f in got] == ["__init__.py", "b.py", "requirements.txt", "loose.py"]


def test_command_line(spark, tree, capsys):
    assert main(["--json"], spark, tree) == 1
    got = json.loads(capsys.readouterr().out)
    assert [(f["file"].rsplit("/", 1)[-1], f["cwe_id"]) for f in got["findings"]] == [("__init__.py", "CWE-94"), ("b.py", "CWE-617"), ("requirements.txt", "CWE-1104"), ("loose.py", "CWE-770")]
    assert got["count"] == 4 and got["nosec_suppressed"] == 1 and got["test_suppressed"] == 1 and "baseline_suppressed" not in got and "suppression_hint" not in got
    assert list(got["findings"][0]) == ["cwe_id", "cwe_name", "severity", "confidence", "package", "file", "line", "code", "description", "zero_day_relevance"]
    base = str(tree / "base.json")
    assert main(["--write-baseline", base, "-q"], spark, tree) == 0
    capsys.readouterr()
    assert main(["--baseline", base], spark, tree) == 0
    assert "0 findings" in capsys.readouterr().out
    assert main(["--fail-on", "critical", "--package", f"x={tree / 'build'}", "--include-tests"], spark, tree) == 1
    text = capsys.readouterr().out
    assert "CWE-94" in text and "1 × CRITICAL" in text
    assert main(["--baseline", str(tree / "none.json")], spark, tree) == 2
    assert main(["--packages", "nope"], spark, tree) == 2
    assert main([], spark, tree / "empty") == 2


def test_stream(spark, tmp_path):
    f = rows(spark, [("a.py", "eval(a)")])
    f.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        scan_stream(read_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        assert [r.cwe_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["CWE-94"]
