"""Lexical search, the Merkle tree and license scans against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from siltstone.llm import lexical_search, license_scan, merkle
from siltstone.llm.lexical_search import SearchParams

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"
EXTRA = ("n", "terms", "counts", "item", "score", "rank", "grp", "up", "pos", "total", "leaf", "path", "f", "w", "t", "d", "places")


def clash(df):
    for c in EXTRA:
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


# ---------------------------------------------------------------- search


def search(docs, items, k=10):
    """Every score, one after another."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    d = [(i, terms(t)) for i, t in docs]
    d = [(i, t) for i, t in d if t]
    n, length = len(d), sum(len(t) for _, t in d)
    df = Counter(x for _, t in d for x in set(t))
    out = []
    for item, text in set(items):
        rows = []
        for doc, t in d:
            tf, m = Counter(t), 25 + 75 * len(t) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms(text) if tf[x])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **p):
    got = lexical_search.search(clash(spark.createDataFrame(docs, DOCS).repartition(3)), clash(spark.createDataFrame(items, "item_id long, text string")), SearchParams(**p))
    return sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def corpus(seed, n, words=60, size=40):
    rng = random.Random(seed)
    some = [f"w{k}" for k in range(words)] + ["É", "Straße", "日本", "x y", "İ"]
    return [(k, " ".join(rng.choices(some, k=rng.randrange(size)))) for k in range(n)]


def test_search_is_every_score(spark):
    docs = corpus(1, 300)
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (5000, ""), (5001, " ,;\n"), (5002, "w1 " * 50_000), (5003, "W1,w2.W3")]
    items = corpus(2, 20) + [(50, None), (51, ""), (52, "nowhere"), (53, docs[7][1].upper()), (53, docs[7][1].upper()), (53, "w3 w3 w3"), (None, "w1 w2 w2")]
    want = search(docs, items)
    assert found(spark, docs, items) == want
    # small tiles, many blocks: the same
    assert found(spark, docs, items, item_tile=3, vocabulary_tile=5, doc_tile=7, block_entries=40) == want


def test_search_of_nothing(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == []


def test_tiles_stay_exact():
    """Large weights are dealt to tiles whose sums stay below 2^53, and nothing is lost."""
    rng = np.random.default_rng(1)
    term, item = np.arange(12) % 6, np.repeat([0, 1], 6)
    value = rng.integers(1, 3 * (lexical_search.EXACT // lexical_search.IMPACT), 12)
    total = np.zeros((2, 6), np.int64)
    for columns, dense in lexical_search.vocabulary_tiles(term, value, item, 4, 2):
        assert dense.sum(axis=1).max() * lexical_search.IMPACT < lexical_search.EXACT and len(columns) <= 4
        total[:, columns] += dense.astype(np.int64)
    assert (total[item, term] == value).all()


def test_ties_at_the_border():
    scores = np.array([[5, 7, 5, 5, 0, 5], [0, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6]])
    r, c = lexical_search.best(scores, 3)
    assert [(int(a), int(b)) for a, b in zip(r, c, strict=True)] == [(0, 0), (0, 1), (0, 2), (2, 3), (2, 4), (2, 5)]


def test_large_numbers_stay_whole():
    n = np.array([10**9, 3])
    assert lexical_search.impacts(np.array([2, 1]), n, 10**12, 10**14).tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * int(x) * 10**12 // 10**14)) for t, x in ((2, n[0]), (1, n[1]))]


# ---------------------------------------------------------------- tree

ROW = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))


def grow(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def sides(tree, k):
    for level in tree[:-1]:
        a = k - k % 3
        yield level[a:k], level[k + 1 : a + 3]
        k //= 3


def whole_tree(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
    trees = {s: grow([leaf_of(r, r[4]) for r in by[s]]) for s in order}
    top = grow([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = [*sides(trees[s], i), *sides(top, k)]
            node = leaf_of(r, r[4])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = leaf_of(r, r[4].replace("\n", ""))
            for before, after in steps:
                node = h([*before, node, *after])
            root = top[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, h(x for a, z in steps for x in (*a, *z)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [7, 2, 1])
def test_tree_against_recursion(spark, height):
    """Also with small blocks, so that there are several storeys."""
    rng = random.Random(height)
    sources = ["a", "", None, "ä", "Z", "b"] + ["hot"] * 6 + [f"s{k}" for k in range(12)]
    rows = [(k, rng.choice(sources), rng.choice(["en", None, "é"]), rng.choice([None, k]), rng.choice([None, "", "a\nb", "x", "\n", "é\n" * 3])) for k in range(260)]
    rows += [rows[3], rows[3], (3, rows[3][1], "en", 1, "other"), (None, "a", None, None, "t\nt"), (None, "a", None, None, None), (-5, "one more", "x", 2, "\n")]
    docs = clash(spark.createDataFrame(rows, ROW).repartition(5))
    got = sorted([tuple(r) for r in merkle.tamper_report(docs, height).collect()], key=str)
    assert got == whole_tree(rows)


def test_versions_copy_only_ancestors(spark):
    from pyspark.sql import functions as F

    rows = [(k, "s" if k < 11 else "t", "en", 1, f"text {k}") for k in range(13)]
    done = merkle.versions(spark.createDataFrame(rows, ROW), F.lit("other"), F.col("doc_id") % 2 == 0, height=1).collect()
    for r in done:
        changed = [(*x[:4], "other") if x[0] == r.doc_id else x for x in rows]
        want = whole_tree(changed)[0][3] if r.doc_id % 2 == 0 else r.root
        assert r.folded_root == want and r.verified == (r.doc_id % 2 == 1)
        # 11 leaves: three levels, and one of sources; 2 leaves: one, and one
        assert len(r.copied) == ((4 if r.source == "s" else 2) if r.doc_id % 2 == 0 else 0)
        assert not r.copied or r.copied[-1] == want


def test_tree_of_few(spark):
    assert merkle.tamper_report(spark.createDataFrame([], ROW)).count() == 0
    one = [(2, "s", "en", 3, "a\nb")]
    assert [tuple(r) for r in merkle.tamper_report(spark.createDataFrame(one, ROW)).collect()] == whole_tree(one)


# ---------------------------------------------------------------- licenses


def scan(text, p):
    """Plain loops: (n_words, places, coverage, labels)."""
    w = license_scan.template_words(text or "")
    places = [(i, label) for phrase, label in p.phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    best, labels = 0.0, set()
    for label, body in p.templates:
        t = license_scan.template_words(body)
        grams = defaultdict(list)
        for q in range(len(t) - p.gram + 1):
            grams[tuple(t[q : q + p.gram])].append(q)
        diagonals = defaultdict(set)
        for i in range(len(w) - p.gram + 1):
            for q in grams.get(tuple(w[i : i + p.gram]), ()):
                diagonals[i - q].add(q)
        groups, last, low = [], None, None
        for d in sorted(diagonals):
            if last is None or d - last > p.gap:
                low = d
                groups.append({})
            elif (d - low) // p.width != (last - low) // p.width:
                groups.append({})
            groups[-1][d] = diagonals[d]
            last = d
        for g in groups:
            if len(set().union(*g.values())) >= p.votes:
                stands = sum(any(0 <= q + d < len(w) and w[q + d] == x for d in g) for q, x in enumerate(t))
                best = max(best, stands / len(t))
                if stands / len(t) >= p.least:
                    labels.add(label)
    base = {x for _, x in places}
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best)


def test_licenses_against_loops(spark):
    p = license_scan.ScanParams()
    rng = random.Random(5)
    texts = [None, "", "   ", "CC BY", "cc-by cc by", "all rights reserved all Rights Reserved", "rights all reserved", "General Public License, GNU general public license"]
    texts += [body for _, body in p.templates]
    for _, body in p.templates:
        w = body.split()
        edited = w[: len(w) // 2] + ["inserted", "words"] + w[len(w) // 2 :]
        texts += ["intro. " + " ".join(edited) + " outro", " ".join(w[: len(w) // 2]), " ".join(x for k, x in enumerate(w) if k % 7 != 3), body.upper().replace(" ", "\n")]
        rng.shuffle(w)
        texts.append(" ".join(w))
    texts += ["ſoftware Kelvin " + p.templates[1][1], "the software the software " * 300, (p.templates[0][1] + ". ") * 60, "日本 " + p.templates[2][1]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, texts[9]), (None, texts[9]), (None, None)]
    got = license_scan.license_report(clash(spark.createDataFrame(rows, DOCS).repartition(3)), p)
    for q in (p, license_scan.ScanParams(broadcast_bytes=-1)):
        got = license_scan.license_report(clash(spark.createDataFrame(rows, DOCS).repartition(3)), q)
        assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([(i, *scan(t, p)) for i, t in rows], key=str)


def test_license_parameters(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three")], DOCS)
    mine = license_scan.ScanParams(templates=(("own", "One, two: THREE four five"),), phrases={"two three": "pair"})
    assert [(r.doc_id, r.base_labels, r.labels, r.score) for r in license_scan.license_report(docs, mine).orderBy("doc_id").collect()] == [(1, "pair", "own,pair", 1.0), (2, "pair", "pair", 1.0)]
    with pytest.raises(ValueError):
        license_scan.license_report(docs, license_scan.ScanParams(templates=(("short", "one two"),)))
    assert license_scan.license_report(spark.createDataFrame([], DOCS)).count() == 0
