"""Listing on executors against plain walks."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.operators import post
from siltstone.sources import discovery, listing
from siltstone.sources.tree import TreeReader, read_tree, tree_files

LOCKS = ("uv.lock", "poetry.lock", "requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "Pipfile.lock")


@pytest.fixture(scope="module")
def forest(tmp_path_factory):
    """A random tree with links, odd names, manifests at all heights and a directory that is hard to read."""
    root, rng = tmp_path_factory.mktemp("forest"), random.Random(7)
    dirs = [root]
    for k in range(120):
        d = rng.choice(dirs) / rng.choice([f"d{k}", f"ü {k}", f".h{k}", "__pycache__", "build", "x.py"])
        d.mkdir(exist_ok=True)
        dirs.append(d)
    for k in range(500):
        (rng.choice(dirs) / rng.choice([f"m{k}.py", "__init__.py", f"n{k}.txt", ".py", f"_p{k}.PY", *LOCKS])).write_text("eval(x)\n" * rng.randrange(3)) if rng.random() < 0.95 else None
    (root / "link").symlink_to(dirs[5])
    (root / "l.py").symlink_to(root / "nowhere")
    return root


def packages_of(root):
    below = sorted(p for p in root.rglob("*") if p.is_dir() and not p.is_symlink())
    return {"whole": str(root), "first": str(below[0]), "deep": str(max(below, key=lambda p: len(p.parts))), "none": str(root / "missing"), "Z": str(below[7]), "a file": str(next(root.rglob("m*.py")))}


@pytest.mark.parametrize("budget", [1, 7, 2000])
def test_files_against_a_walk(spark, forest, budget):
    packages = packages_of(forest)
    for exclude in ((), ("/build/",)):
        got = listing.list_files(spark, packages, "first", exclude, budget).collect()
        want = [(n, p) for n, root in packages.items() for p in discovery.python_files(root, n != "first", exclude)]
        assert sorted((r.package, r.path) for r in got) == sorted(want)
        assert all(r["size"] == (os.path.getsize(r.path) if os.path.exists(r.path) else 0) for r in got)


@pytest.mark.parametrize("bounded", [True, False])
def test_manifests_against_steps_upwards(spark, forest, bounded):
    packages = {n: p for n, p in packages_of(forest).items() if n != "none"}
    ceiling = forest if bounded else None
    roots = spark.createDataFrame(list(packages.items()), "package string, root string")
    names = listing.names_in(listing.chains(roots, ceiling and str(ceiling)))
    got = listing.nearest_manifests(roots, names, ceiling and str(ceiling)).collect()
    want = [(n, p, discovery.manifest_label(p, packages)) for n, root in packages.items() for p in discovery.manifests(root, ceiling)]
    assert sorted((r.package, r.path, r.label) for r in got) == sorted(want)
    locks = {r.path: r.locked for r in post.with_locks(spark.createDataFrame(sorted({(p, os.path.basename(p)) for _, p, _ in want}), "path string, name string"), names).collect()}
    assert locks == {p: discovery.locked(p) for _, p, _ in want}


def test_whole_run_of_files(spark, forest):
    packages = packages_of(forest)
    files = tree_files(spark, packages, "first", ("/build/",), forest)
    want = discovery.file_set(packages, "first", ("/build/",), forest)
    assert {r.path: r.package for r in files.collect()} == want
    got = {r.path: r for r in read_tree(spark, files, forest).collect()}
    plain = {r.path: r for r in read_tree(spark, want, forest).collect()}
    assert got == plain and set(got) == set(want)


def test_chains(spark):
    rows = [("a", "/w/a/b"), ("b", "/w"), ("c", "/"), ("d", "/x/y")]
    df = spark.createDataFrame(rows, "package string, root string")
    got = {r.package: r.d for r in listing.chains(df, "/w").groupBy("package").agg(F.transform(F.sort_array(F.collect_list(F.struct("up", "dir"))), lambda x: x["dir"]).alias("d")).collect()}
    assert got == {"a": ["/w/a/b", "/w/a", "/w"], "b": ["/w"], "c": ["/"], "d": ["/x/y", "/x", "/"]}
    assert [r.up for r in listing.chains(df.limit(1), None).collect()] == [0, 1, 2, 3]


def test_nothing_to_list(spark, tmp_path):
    assert tree_files(spark, {"x": str(tmp_path)}, None, (), tmp_path).count() == 0
    assert read_tree(spark, tree_files(spark, {"x": str(tmp_path)}, None, (), Path(tmp_path))).count() == 0


def test_driver_sees_parts_alone(spark, forest):
    plan = read_tree(spark, tree_files(spark, {"w": str(forest)}, None, (), forest), forest)
    assert plan.count() > 50
    folder = next(Path(listing.shared_folder(spark)).glob("tree-*"))
    reader = TreeReader({"listing": str(folder)})
    assert vars(reader) == {"listing": str(folder), "workspace": None} and all(p.path.endswith(".parquet") for p in reader.partitions())
