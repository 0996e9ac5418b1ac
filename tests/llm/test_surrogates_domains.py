"""Surrogates where a form is full or has nothing to exchange, and a plain version of finding and redrawing."""

import itertools
import random
import re
from collections import Counter, defaultdict

from siltstone.llm import surrogates as S

PII = S.PiiParams(key=b"k")
DOCS = "doc_id long, text string"


def replaced(spark, texts, p=PII):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)
    return [r.text for r in S.replace_entities(df, p).orderBy("doc_id").collect()]


def test_no_fixed_points():
    p = S.Permuter(b"q")
    for n in (2, 3, 4, 5, 17, 64, 65):
        got = [p.permute(i, n, "x") for i in range(n)]
        assert sorted(got) == list(range(n)) and all(a != b for a, b in enumerate(got))
        assert [p.place(p.place(i, n, "y"), n, "y", back=True) for i in range(n)] == list(range(n))
    big = 36**400
    assert p.place(p.place(big - 5, big, "z"), big, "z", back=True) == big - 5


def test_masked_values_stay(spark):
    texts = ['password = "******"', "hello", "secret: '!!!!!!'", 'password = "****a*"']
    got = replaced(spark, texts)
    assert got[:3] == texts[:3] and got[3] != texts[3] and re.fullmatch(r'password = "\*{4}[a-z]\*"', got[3])


def test_every_private_address(spark):
    """All of 192.168.0.0/16: each goes to another one, no two to the same, and the form is listed as crowded."""
    values = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    texts = [" ".join(values[k : k + 64]) for k in range(0, len(values), 64)]
    got = " ".join(replaced(spark, texts)).split(" ")
    assert sorted(got) == sorted(values) and all(a != b for a, b in zip(got, values, strict=True))
    real = S.real_values(spark.createDataFrame([(t,) for t in texts], "text string"), PII)
    assert [(r.kind, r.form, r.n, r["size"]) for r in S.crowded(real).collect()] == [("ip", f"{(192 << 8) | 168}/16", 65536, 65536.0)]


def test_every_short_surname(spark):
    names = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = [x.removeprefix("Herr ") for x in replaced(spark, [f"Herr {n}" for n in names])]
    assert sorted(got) == sorted(names) and all(a != b for a, b in zip(got, names, strict=True))
    assert all(S._SET[a.lower()] == S._SET[b.lower()] for x, y in zip(got, names, strict=True) for a, b in zip(x, y, strict=True))


def found(text):
    """Patterns one after another over a list of taken places; names and their bare mentions last."""
    taken, out = [False] * len(text), []

    def take(a, b, kind):
        if not any(taken[a:b]):
            taken[a:b] = [True] * (b - a)
            out.append((a, b, kind))

    for kind, pattern in S.PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "quoted":
                a, b = m.span("q") if m["q"] else m.span("v")
            if kind != "iban" or re.search(r"\d", text[a + 4 : b]):
                take(a, b, kind)
    kinds = {}
    for m in S.NAMES.finditer(text):
        first, last = ((m[2], m[3]) if m[2] else (m[4], m[5]) if m[4] else (m[6], m[7]))
        at = m.start(2) if m[2] else m.start(4) if m[4] else m.start(6)
        kind = "given" if last or any(first in names for names in S.GIVEN.values()) else "surname"
        take(at, at + len(first), kind)
        kinds.setdefault(first, kind)
        if last:
            end = m.end(3) if m[2] else m.end(5) if m[4] else m.end(7)
            take(end - len(last), end, "surname")
            kinds[last] = "surname"
    for m in S.BARE.finditer(text) if kinds else ():
        if m[0] in kinds:
            take(m.start(), m.end(), kinds[m[0]])
    return sorted(out)


def rewritten(texts, p):
    """Everything in one place: a table of first draws, then of the others, in order of the values."""
    s = S.Surrogates(p.key)
    values = sorted({(k, S.normal(k, t[a:e])) for t in texts for a, e, k in found(t) if not (k == "given" and t[a:e] in S._KNOWN)})
    values = [v for v in values if s.form(*v)[1] > 1]
    first = {v: s.draw(*v, 0) for v in values}
    real, used = set(values), {(k, x) for (k, _), x in first.items()}
    size = {(k, s.form(k, n)[0]): s.form(k, n)[1] for k, n in values}
    held = Counter((k, s.form(k, n)[0]) for k, n in values)
    draws = defaultdict(list)
    for k, n in values:
        form = (k, s.form(k, n)[0])
        if (k, first[k, n]) in real and 4 * held[form] <= size[form]:
            for r in range(1, p.rounds + 1):
                x = (k, s.draw(k, n, r))
                if x not in real and x not in used:
                    draws[x].append((n, r))
    rounds = {}
    for (k, _), owners in draws.items():
        n, r = min(owners)
        rounds[k, n] = min(r, rounds.get((k, n), r))
    out = []
    for t in texts:
        pieces, at = [], 0
        for a, e, k in found(t):
            pieces += [t[at:a], s.replaced(k, t[a:e], rounds)]
            at = e
        out.append("".join([*pieces, t[at:]]))
    return out, len(rounds)


def test_against_one_place(spark):
    """Forms with few strings, so that many first draws are real values."""
    rng = random.Random(12)
    names = ["".join(x) for x in itertools.product("BDFGHKLM", "aei", "blmnrst")]
    text = lambda: rng.choice(["Mr {}", "call +49 (12) 345-{}", "token='{}'", "Dear {} {}", "id 0{}-12-1234", "Name: {}", "see 10.0.0.{}", "{}@ab.de", "DE12 3456 78{}", "Mary {}"])
    fill = lambda: rng.choice([rng.choice(names), f"{rng.randrange(40, 60)}", f"{rng.randrange(1000, 1300)}", "aab1" + rng.choice("ab") * 2 + rng.choice("abc")])
    texts = [" and ".join((t := text()).format(*(fill() for _ in range(t.count("{}")))) for _ in range(rng.randrange(1, 6))) for _ in range(700)]
    assert all(S.find(t) == found(t) for t in texts)
    want, redrawn = rewritten(texts, PII)
    assert redrawn > 2
    for p in (PII, S.PiiParams(key=b"k", broadcast_rows=0)):
        assert replaced(spark, texts, p) == want
