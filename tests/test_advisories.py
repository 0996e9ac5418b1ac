"""Advisories as a table, and facts by content."""

import itertools
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from siltstone.cli import main
from siltstone.functions import fact_store
from siltstone.operators import advisories as A
from siltstone.operators import manifest_rules as M
from siltstone.plans.scan import scan
from tests.test_rules import CASES, rows
from tests.test_run import tree  # noqa: F401

NAMES = ["dask", "requests", "a.b-c_d", "ünï", "urllib3"]


def triple(v):
    parts = (v or "").split(".")
    return tuple(map(int, parts)) if len(parts) == 3 and all(p.isascii() and p.isdigit() and int(p) < 1 << 32 for p in parts) else None


def plain(files, table):
    """Every line against every advisory, by the pattern of the fixed table's rule."""
    out = []
    for (name, text), (dep, low, high, advisory) in itertools.product(files, sorted(set(table), key=str)):
        if name not in M.MANIFESTS or dep is None or (low and not triple(low)) or (high and not triple(high)):
            continue
        for no, line in enumerate(text.split("\n"), 1):
            v = re.search(M.VERSION, line)
            v = triple(v[1]) if v else None
            if v and re.search(M.names(dep.lower()).replace(r"\z", r"\Z"), line.lower()) and (not low or v >= triple(low)) and (not high or v < triple(high)):
                out.append((name, text, no, f"{dep.lower()}{f' >={low}' if low else ''}{f' <{high}' if high else ''}: {advisory}"))
                break
    return sorted(out)


def test_intervals_against_every_pair(spark):
    rng = random.Random(9)
    version = lambda: f"{rng.randrange(3)}.{rng.randrange(12)}.{rng.choice([0, 1, 10, 4294967295, 4294967296])}"
    table = [(rng.choice([*NAMES, "DASK"]), rng.choice([None, version()]), rng.choice([None, version(), "1.2"]), f"ADV-{k}") for k in range(40)]
    table += [table[0], (None, None, None, "x")]
    shape = ["{}=={}", '"{}>={}"', "'{}' < {}", "{}[x]=={}", "x,{}~={}", "my{}=={}", "# {} !={}", "{}:>{}", "<{}=={}", "{} , {} == {}", "=={1}{0}", "{} == {}"]
    line = lambda: (lambda s: s.format(*([rng.choice(NAMES).upper() if rng.random() < 0.2 else rng.choice(NAMES), version()] if s.count("{}") < 3 else [rng.choice(NAMES), rng.choice(NAMES), version()])))(rng.choice(shape))
    files = [(rng.choice([*M.MANIFESTS, "other.txt"]), "\n".join(line() for _ in range(rng.randrange(9)))) for _ in range(60)]
    df, known = rows(spark, files), spark.createDataFrame(table, A.SCHEMA)
    for most in (A.BROADCAST_BYTES, -1):
        got = A.vulnerable(df, known, most).collect()
        assert sorted((files[int(r.file.split("/")[0][1:])] + (r.no, r.detail)) for r in got) == plain(files, table)
    assert len(got) > 100


def test_matches_are_not_shuffled(spark):
    table = [("dask", None, "2.0.0", f"ADV-{k}") for k in range(50)] + [("dask", "1.0.0", None, "x"), ("Requests", None, None, None)]
    text = "dask==1.0.0\nrequests, dask>=3.0.0\ndask==1.0.0 # again\n"
    df, known = rows(spark, [("requirements.txt", text)] * 3), spark.createDataFrame(table, A.SCHEMA)
    for most, together in ((A.BROADCAST_BYTES, A.TOGETHER), (A.BROADCAST_BYTES, 7), (-1, 7)):
        found = A.vulnerable(df, known, most, together)
        above = found._jdf.queryExecution().executedPlan().toString().split("Join", 1)[0]
        assert "Exchange" not in above and "Aggregate" not in above
        want = [(1, "dask==1.0.0", f"dask <2.0.0: ADV-{k}") for k in range(50)] + [(1, "dask==1.0.0", "dask >=1.0.0: x"), (2, "requests, dask>=3.0.0", "requests: ")]
        assert sorted((r.no, r.code, r.detail) for r in found.collect()) == sorted(want * 3)


def test_a_task_repeats_few_advisories(spark):
    """However many advisories a dependency has, a task lists those of a share, in one order for one file after the other."""
    share = 8 << 10
    table = [("dask", None, "2.0.0", f"ADV-{k}") for k in range(1000)] + [(f"lib{k}", None, None, "x") for k in range(20)]
    df = rows(spark, [("requirements.txt", f"dask==1.0.{k % 3}\nlib{k % 20}==1.0.0") for k in range(200)])
    for most in (A.BROADCAST_BYTES, -1):
        found = A.vulnerable(df, spark.createDataFrame(table, A.SCHEMA), most, 64, share)
        got = found.select(F.spark_partition_id().alias("task"), "file", "no", "detail").collect()
        assert len({(r.file, r.no, r.detail) for r in got}) == len(got) == 200 * 1001
        for _, task in itertools.groupby(got, lambda r: r.task):
            listed = [(r.file, r.detail) for r in task if r.no == 1]
            details = {d: k for k, d in enumerate(dict.fromkeys(d for _, d in listed))}
            assert sum(len(d) + 4 for d in details) <= 1.5 * share
            for _, run in itertools.groupby(listed, lambda r: r[0]):
                at = [details[d] for _, d in run]
                assert at == list(range(at[0], at[0] + len(at)))


def test_builtin_table_as_a_table(spark):
    df = rows(spark, [(n, t) for _, n, t, _ in CASES])
    by = lambda f: sorted((r.check_id, r.file, r.line, r.code, r.description, r["at"]) for r in f.collect())
    ordered = A.builtin(spark).selectExpr("*", "CAST(element_at(map_from_arrays(array(" + ",".join(f"'{d}'" for d, _, _ in M.VULNERABLE) + "), sequence(0, 9)), dependency) AS INT) AS ord")
    assert by(scan(df, None, ordered)) == by(scan(df))
    assert by(scan(df, ["check_dependency_cve"], ordered)) == by(scan(df, ["check_dependency_cve"]))
    assert scan(df, ["check_dependency_cve"], A.builtin(spark).limit(0)).count() == 0


def test_facts_are_parsed_once(spark, tmp_path):
    store = str(tmp_path / "store")
    files = [("a.py", "eval(x)")] * 5 + [("b.py", "exec(y)"), ("c.py", "def f(:"), ("d.txt", "eval(x)"), ("e.py", ""), ("f.py", None)]
    df = rows(spark, files)
    key = lambda f: sorted(map(tuple, f.drop("path_key").collect()), key=str)
    want = key(scan(df))
    assert fact_store.unknown(df, store).count() == 4
    assert key(scan(df, store=store)) == want
    assert fact_store.known(spark, store).count() == 4 and fact_store.unknown(df, store).count() == 0
    more = rows(spark, [*files, ("g.py", "compile(z)")])
    assert [r.text for r in fact_store.unknown(more, store).collect()] == ["compile(z)"]
    assert key(scan(more, store=store)) == key(scan(more)) and fact_store.known(spark, store).count() == 5
    fact_store.learn(more, store)
    # the same digests again, as of two runs at once
    fact_store.known(spark, store).limit(3).write.mode("append").parquet(fact_store.folder(store))
    assert key(scan(more, store=store)) == key(scan(more))


def test_command_line(spark, tree, capsys, tmp_path_factory):  # noqa: F811
    out: Path = tmp_path_factory.mktemp("advised")
    (out / "a.csv").write_text("dependency,introduced,fixed,advisory\ndask,1.0.0,1.0.1,MINE-1\ndask,1.0.1,,MINE-2\n")
    assert main(["--advisories", str(out / "a.csv"), "--fact-store", str(out / "facts"), "-q"], spark, tree) == 1
    text = capsys.readouterr().out
    assert "dask >=1.0.0 <1.0.1: MINE-1" in text and "MINE-2" not in text and (out / "facts").exists()
    assert main(["--advisories", str(out / "none.csv"), "-q"], spark, tree) == 2
