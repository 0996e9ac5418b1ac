"""Literals that rules need, and the lines that hold them."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siltstone.functions import literals as L
from siltstone.operators import rules as R
from siltstone.operators.text_rules import DECODE, EXECUTE, TEXT_CHECKS
from siltstone.plans import scan as S
from siltstone.plans.corpus import TEMPLATES
from siltstone.plans.registry import ORDER
from tests.test_rules import CASES, rows
from tests.test_text import lines_of

LINES = [x for t in TEMPLATES for x in t.text.split("\n")] + [x for _, _, t, _ in CASES for x in t.split("\n")]


def has(x, line):
    return x.text in (line.lower() if x.fold else line)


def held(cond, line):
    """Whether a line may meet a condition; facts say no."""
    if isinstance(cond, R.Rx):
        return bool(re.search(cond.pattern, line.lower() if cond.on == "lower" else line.strip() if cond.on == "trim" else line, re.I if cond.fold else 0))
    if isinstance(cond, R.Has):
        return cond.part in (line.lower() if cond.on == "lower" else line)
    if isinstance(cond, R.Named):
        return False
    if isinstance(cond, R.Not):
        return not held(cond.part, line) if not isinstance(cond.part, R.Named) else True
    return (all if isinstance(cond, R.All) else any)(held(p, line) for p in cond.parts)


def test_lines_that_a_rule_fires_on_hold_its_literals():
    conditions = [v.when for t in TEXT_CHECKS for g in t.groups for v in g] + [R.Rx(DECODE), R.Rx(EXECUTE)]
    fired = 0
    for c in conditions:
        need = L.required(c)
        assert need is not None, c
        for line in LINES:
            for x in (line, line.upper(), "é " + line):
                if held(c, x):
                    fired += 1
                    assert any(has(n, x) for n in L.least(need)), (c, x)
    assert fired > 300


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("abc|de", {"abc", "de"}), ("a(?:bc|de)?f", {"abcf", "adef", "af"}), (r"ab\s*cdef", {"cdef"}), ("x*", None), ("(?:abc)+d", {"abc"}), (r"\Aabc\b", {"abc"}), ("[abc]d", {"ad", "bd", "cd"}), ("[^a]bcd", {"bcd"}), ("a{2}bc", {"bc"}), ("a.b", None), ("ab(?!c)de", {"abde"})],
)
def test_required(pattern, want):
    got = L.required(R.Rx(pattern))
    assert (None if got is None else {x.text for x in got}) == want


def test_required_of_conditions():
    a, b, none = R.Rx("abcd"), R.Has("efgh"), R.Rx("x*")
    texts = lambda c: None if (r := L.required(c)) is None else {x.text for x in r}
    assert texts(a | b) == {"abcd", "efgh"} and texts(a & none) == {"abcd"} and texts(a | none) is None and texts(~a) is None
    assert texts(a & ~b) == {"abcd"} and texts((a & ~R.Named("sql_safe")) | R.Named("lxml_line")) == {"abcd"}
    assert {(x.text, x.fold) for x in L.least([L.Literal("abc"), L.Literal("xabcx"), L.Literal("AB", False)])} == {("abc", False), ("AB", False)}
    assert L.Literal("ſ") in L.least([L.Literal("pass", True)])


def test_index_against_search():
    rng = random.Random(3)
    known = L.least([L.Literal(x) for x in ("ab", "==", "abcde", "é!", "‪", "x.y(", "zzz")] + [L.Literal(x, True) for x in ("pass", "kilo")])
    index = L.Index(known)
    parts = [x.text for x in known] + ["\n", "\r\n", "\r", " ", "PASS", "KiLo", "q", "é", "日本", " "]
    texts = ["", None, "\n", "ab", "a\nb", "\r\nab\r", "ab\n"] + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(300)]
    texts += ["n" * (L.BLOCK - 3) + "x.y(" + "m" * (L.BLOCK - 2) + "zzz\nlast", "-" * (2 * L.BLOCK) + "\nab"]
    whole = np.array([k % 7 == 0 for k in range(len(texts))])
    got = L.lines_with(index, pa.array(texts), whole).to_pylist()
    for text, every, lines in zip(texts, whole, got, strict=True):
        want = [(k, x) for k, x in enumerate(lines_of(text or ""), 1) if every or any(has(n, x) for n in known)]
        assert [(r["no"], r["line"]) for r in lines] == want, text


def test_slices_of_batches():
    index = L.Index((L.Literal("ab"),))
    array = pa.array(["ab", "x\nab", "c", "ab\nab"]).slice(1, 2)
    assert L.lines_with(index, array, np.zeros(2, bool)).to_pylist() == [[{"no": 2, "line": "ab"}], []]
    assert L.lines_with(index, array.slice(0, 0), np.zeros(0, bool)).to_pylist() == []


def test_findings_do_not_depend_on_how_lines_are_chosen(spark, monkeypatch):
    rng = random.Random(4)
    files = [(n or f"m{k}.py", "\n".join(rng.choices([*LINES, "plain prose", ""], k=12)) + rng.choice(["", "\n", "\r\n"])) for k, n in enumerate(["setup.py", "Pipfile", "requirements.txt", "a.pth", "b.txt"] * 6 + [""] * 40)]
    # those that can be parsed as well as those that cannot
    files += [(t.name or "m.py", t.text.replace("\n", "\r\n")) for t in TEMPLATES]
    df = rows(spark, files).cache()
    key = lambda checks: sorted(map(tuple, S.scan(df, checks).drop("path_key").collect()), key=str)
    some = [["check_pickle"], ["check_xxe", "check_ssrf"], ["check_dependency_cve"], ["check_eval_exec", "check_pth_startup_hooks"], None]
    quick = [key(c) for c in some]
    monkeypatch.setattr(S, "_rows", lambda checks: S._all_lines())
    assert [key(c) for c in some] == quick and len(quick[-1]) > 200
    df.unpersist()


def test_what_is_looked_for_in_the_jvm(spark, capsys):
    assert len(S._literals({"check_pickle"})) <= S.FEW < len(S._literals(set(ORDER)))
    S.scan(rows(spark, [("a.py", "x")]), ["check_pickle", "check_symlink"]).explain()
    assert "Python" not in capsys.readouterr().out
