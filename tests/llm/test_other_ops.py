"""Archives, tool calls, benchmark leaks and the pipeline."""

import base64
import hashlib
import json
import random

import pytest

from siltstone.llm import arc_warc, template_leaks, tool_links
from siltstone.llm.components import components
from siltstone.llm.tables import scratch, shared_dir, stored

PAGES = [(1, "http://a/ b", "<p>x</p>"), (2, None, None), (3, "http://c", ""), (4, "http://d", "<p>x</p>"), (5, "http://e", "a\r\n\r\nWARC/1.1\r\n\r\nfiledesc://b"), (6, "http://f", "é" * 70_000), (0, "http://g", "<p>x</p>"), (None, "http://h", "<p>x</p>"), (4, "http://d", "<p>x</p>")]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_pages_through_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    for c in ("value", "archive", "block", "type", "payload_digest", "source_id", "first", "content", "offset"):
        pages = pages.selectExpr("*", f"'clash' AS {c}")
    got = arc_warc.pages_through_archives(pages).collect()
    assert len(got) == len(PAGES)
    html = {i: h for i, _, h in PAGES}
    for r in got:
        raw = (html[r.source_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), sha(html[r.source_id]))
    kinds = sorted((r.source_id if r.source_id is not None else -1, r.type, r.refers_to_source) for r in got)
    assert [k for k in kinds if k[0] in (-1, 0, 1, 4)] == [(-1, "response", None), (0, "revisit", None), (1, "revisit", None), (4, "revisit", None), (4, "revisit", None)]
    assert [k for k in kinds if k[0] in (2, 3)] == [(2, "response", None), (3, "revisit", 2)]
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got) and all(ids[r.refers_to_id].payload_digest == r.payload_digest for r in got if r.type == "revisit")


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    got = arc_warc.pages_through_archives(pages, arc_warc.ArchiveParams(least=1)).collect()
    assert {r.source_id: r.type for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark):
    assert arc_warc.pages_through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_arc_versions():
    def archive(head, version, names, *records):
        block = f"{version} 0 org\n{names}\n".encode()
        return f"{head} {len(block)}\n".encode() + block + b"".join(b"\n" + f"{line} {len(doc)}\n".encode() + doc for line, doc in records) + b"\n"

    v1 = archive("filedesc://x.arc 0.0.0.0 20010101000000 text/plain", 1, arc_warc.V1, ("http://a 1.2.3.4 20010203040506 text/html", b"hello"), ("dns:b 1.2.3.4 20010203040506 text/dns", b"a\nb"))
    v2 = archive("filedesc://x.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 x.arc", 2, arc_warc.V2, ("http://a 1.2.3.4 20010203040506 text/html 404 abc - 9 x.arc", b"hi"))
    got = list(arc_warc.arc_records(v1))
    assert got[0][1]["version"] == "1" and [g[2] for g in got[1:]] == [b"hello", b"a\nb"]
    assert list(arc_warc.arc_records(v2))[1][1]["Result-code"] == "404"
    for bad in (b"http://a 1 2 3 4\n", v1[:-4], v1.replace(b"1 0 org", b"3 0 org"), v2.replace(b" - 9", b"")):
        with pytest.raises(ValueError):
            list(arc_warc.arc_records(bad))
    assert list(arc_warc.arc_records(b"")) == [] and arc_warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_broken_archives_are_set_aside(spark, tmp_path):
    import gzip

    def archive(name, *records, bad=b""):
        block = f"1 0 org\n{arc_warc.V1}\n".encode()
        data = f"filedesc://{name} 0.0.0.0 20010101000000 text/plain {len(block)}\n".encode() + block + b"".join(b"\n" + f"http://{k} 1.2.3.4 20010203040506 text/html {len(doc)}\n".encode() + doc for k, doc in enumerate(records)) + bad
        (tmp_path / f"{name}.arc.gz").write_bytes(gzip.compress(data))

    archive("good", b"HTTP/1.1 200 OK\r\n\r\na", b"b")
    archive("short", b"c", bad=b"\nhttp://x 1.2.3.4 20010203040506 text/html 99\nabc")
    archive("line", b"d", bad=b"\nno record\n")
    archive("bytes", bad=b"\n\xff 1.2.3.4 20010203040506 text/html 1\nx")
    (tmp_path / "none.arc.gz").write_bytes(gzip.compress(b"something else"))
    with pytest.raises(Exception, match="cut short|fields|utf-8|version block"):
        arc_warc.read_arc(spark, str(tmp_path), False).collect()
    got = {r.archive.split(".")[0]: r.reason for r in arc_warc.broken_archives(spark, str(tmp_path)).collect()}
    assert set(got) == {"short", "line", "bytes", "none"} and "cut short" in got["short"]
    out = arc_warc.convert(spark, str(tmp_path), str(tmp_path / "warc"), arc_warc.ArchiveParams(set_aside=True))
    assert sorted(r.payload_bytes for r in arc_warc.read_warc(spark, out).collect() if r.type == "resource") == [1, 1, 1]


# ---------------------------------------------------------------- tool calls


def calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string")


def test_tool_links(spark):
    tools = spark.createDataFrame([("add", ["a"], {"a": "integer", "b": "number", "c": "array"})], "name string, required array<string>, properties map<string,string>")
    c = calls(spark, [(1, "x", 0, "add", '{"b": 1, "a": 2, "c": [{"z": 1, "y": "\\u00e9/\\n"}]}'), (1, "y", 1, "add", '{"a": "$call:x", "q": null}'), (1, "z", 2, "none", "{}"), (1, "w", 3, "add", "[1]"), (1, "v", 4, "add", None), (1, "x", 5, "add", '{"a": 1}'), (2, "p", 0, "add", '{"a": "$call:q"}'), (2, "q", 1, "add", '{"a": "$call:p"}'), (2, "r", 2, "add", '{"a": "$call:nope"}'), (2, None, 3, "add", '{"a": 1}'), (None, "x", 4, "add", '{"a": 1.5}'), (3, "u", 2, "add", '{"a": 1}'), (1, "t", 6, "add", '{"c": ["$call:y", "$call:x"], "a": 3}')])
    r = spark.createDataFrame([(1, "x", 2, "two"), (1, "x", 1, "one"), (1, "o", 9, None), (3, "u", 1, "soon"), (None, "x", 1, "n"), (2, None, 1, "m")], "conv_id long, call_id string, turn long, content string")
    got = {(g.conv_id, g.call_id, g.turn): g for g in tool_links.link(c, r, tools).collect()}
    assert len(got) == 13 + 3
    x = got[1, "x", 0]
    assert (x.status, x.level, x.errors, x.result_turn) == ("linked", 0, "", 1)
    assert x.canonical == '{"arguments":{"a":2,"b":1,"c":[{"y":"é/\\n","z":1}]},"call_id":"x","content":"one","name":"add"}'
    assert (got[1, "y", 1].errors, got[1, "y", 1].level, got[1, "y", 1].status) == ("type:a,unknown:q", 1, "unanswered")
    assert got[1, "z", 2].errors == "tool" and got[1, "w", 3].errors == got[1, "v", 4].errors == "arguments"
    assert got[1, "x", 5].status == "duplicate" and got[1, "t", 6].level == 2
    assert {got[2, k, t].status for k, t in (("p", 0), ("q", 1))} == {"cycle"} and got[2, "p", 0].level is None
    assert got[2, "r", 2].errors == "type:a,dangling:nope" and got[2, None, 3].status == "unanswered"
    assert got[None, "x", 4].errors == "type:a" and got[3, "u", 2].status == "early"
    assert got[1, "o", None].status == "orphan" and json.loads(got[1, "o", None].canonical) == {"arguments": None, "call_id": "o", "content": None, "name": None}


def plain_levels(edges, nodes):
    """Longest path to a node without needs; None in a circle or behind one."""
    needs = {n: [b for a, b in edges if a == n] for n in nodes}
    out = {}
    while ready := [n for n in nodes if n not in out and all(b in out for b in needs[n])]:
        out |= {n: max((out[b] + 1 for b in needs[n]), default=0) for n in ready}
    return {n: out.get(n) for n in nodes}


@pytest.mark.parametrize("seed", [1])
def test_levels_of_mixed_graphs(spark, seed):
    rng, edges, nodes = random.Random(seed), set(), set()
    for conv in range(12):
        n = rng.randint(1, 40)
        nodes |= {(conv, f"n{k}") for k in range(n)}
        for k in range(1, n):
            for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3])):
                edges.add(((conv, f"n{k}"), (conv, f"n{k - rng.randint(1, min(k, 5))}")))
        if conv % 3 == 2:  # a circle somewhere, or a call that needs itself
            a = rng.randrange(n)
            edges.add(((conv, f"n{a}"), (conv, f"n{rng.randrange(a, n)}")))
    e = spark.createDataFrame([(a[0], a[1], b[1], int(b[1][1:])) for a, b in edges], "conv_id long, call_id string, needs string, turn long")
    got = {(r.conv_id, r.call_id): r.level for r in tool_links.levels(spark.createDataFrame(sorted(nodes), "conv_id long, call_id string"), e).collect()}
    assert got == {n: v for n, v in plain_levels(edges, nodes).items() if v is not None}


def test_levels_of_long_chains(spark, monkeypatch):
    n, rounds = 5000, []
    stored = tool_links.stored
    monkeypatch.setattr(tool_links, "stored", lambda df, what: rounds.append(what) or stored(df, what))
    nodes = spark.range(n).selectExpr("1L AS conv_id", "CAST(id AS string) AS call_id")
    edge = lambda back: spark.range(back, n).selectExpr("1L AS conv_id", "CAST(id AS string) AS call_id", f"CAST(id - {back} AS string) AS needs", f"id - {back} AS turn")
    for edges in (edge(1), edge(1).unionByName(edge(2))):  # a second reference that the first implies costs no rounds
        rounds.clear()
        got = tool_links.levels(nodes, edges).collect()
        assert len(got) == n and all(r.level == int(r.call_id) for r in got) and len(rounds) < 22
    circle = edge(1).unionByName(spark.sql("SELECT 1L AS conv_id, '0' AS call_id, '4999' AS needs, 4999L AS turn"))
    assert tool_links.levels(nodes, circle).count() == 0


def test_tool_links_with_clashing_columns(spark):
    tools = spark.createDataFrame([("add", ["a"], {"a": "integer"})], "name string, required array<string>, properties map<string,string>")
    c = calls(spark, [(1, "x", 0, "add", '{"a": 1}'), (1, "y", 2, "add", '{"a": "$call:x"}')])
    r = spark.createDataFrame([(1, "x", 1, "one"), (1, "z", 3, "two")], "conv_id long, call_id string, turn long, content string")
    want = sorted(map(str, tool_links.link(c, r, tools).collect()))
    for name in ("level", "r", "first", "required", "loose", "n_calls", "args", "status", "a", "needs", "properties", "to", "n"):
        c, r, tools = (x if name in x.columns else x.selectExpr("*", f"'clash' AS {name}") for x in (c, r, tools))
    assert sorted(map(str, tool_links.link(c, r, tools).collect())) == want


def test_conversation_turns(spark):
    t = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", None), (2, 5, "assistant", "x"), (3, 1, None, "y")], "conv_id long, turn long, role string, text string")
    c, r = tool_links.conversation_calls(t)
    got = {(g.conv_id, g.call_id): (g.status, g.level, g.errors) for g in tool_links.link(c, r, tool_links.conversation_tools(spark)).collect()}
    assert got == {(1, "1:0"): ("unanswered", 0, ""), (1, "1:1"): ("linked", 0, ""), (1, "1:3"): ("unanswered", 1, ""), (2, "2:4"): ("orphan", None, ""), (3, "3:0"): ("orphan", None, "")}
    c, r = tool_links.conversation_calls(t.limit(0))
    assert tool_links.link(c, r, tool_links.conversation_tools(spark)).count() == 0


# ---------------------------------------------------------------- leaks


QUESTION = "A farmer called Jonas Weber sells 12 kg of apples for 30 dollars to Maria and then 12 kg more; how much does he earn in a week of 7 days?"


def test_leaks(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(n))
    other = QUESTION.replace("Jonas", "Peter").replace("Weber", "Braun").replace("12", "15").replace("30", "99").replace("Maria", "Ida").replace("7", "5")
    docs = [(1, f"{noise(40)}. {QUESTION} {noise(10)}"), (2, f"{noise(40)}. {other} {noise(10)}"), (3, other.replace("15 kg more", "16 kg more")), (4, noise(400)), (5, None), (6, ""), (7, " ".join(QUESTION.split()[:8])), (8, "one two three four five six"), (None, QUESTION), (1, f"{noise(40)}. {QUESTION} {noise(10)}")]
    docs[-1] = docs[0]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' AS key", "'c' AS h", "'c' AS raw")
    items = spark.createDataFrame([(0, QUESTION), (1, "one two three four five six"), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in template_leaks.leaks(df, items).collect()}
    assert set(got) == {(1, 0), (2, 0), (None, 0), (8, 1)}
    assert got[2, 0].n_slots > 0
    left = template_leaks.drop_contaminated(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7]
    small = template_leaks.LeakParams(broadcast_bytes=0)
    assert {(r.doc_id, r.item_id) for r in template_leaks.leaks(df, items, small).collect()} == set(got)
    assert template_leaks.leaks(df.limit(0), items).count() == template_leaks.leaks(df, items.limit(0)).count() == 0


def test_leaks_in_another_case(spark):
    copies = [QUESTION.upper(), QUESTION.lower(), QUESTION.title(), QUESTION.replace(" ", "  "), QUESTION.lower().replace("12", "15"), QUESTION.replace("Jonas", "Peter").replace("Maria", "Ida").replace(" ", "  ")]
    street = "In der großen Straße von Köln wohnt seit vielen Jahren der alte Lehrer Jonas Weber mit seiner Familie"
    docs = [(k, f"Lorem ipsum. {t} dolor.") for k, t in enumerate([*copies, street.upper()])] + [(9, "LOREM IPSUM DOLOR SIT AMET " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for item in (QUESTION, QUESTION.upper()):
        items = spark.createDataFrame([(0, item), (1, street)], "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in template_leaks.leaks(df, items).collect()}
        assert got >= {(k, 0) for k in range(5)} | {(6, 1)} and ((5, 0) in got or item != QUESTION)
        assert not any(i == 9 or (i == 6) != (k == 1) for i, k in got)


def test_leaks_with_edited_values(spark):
    item = QUESTION + " He keeps the rest of the harvest in a cold cellar below the old barn until spring comes."
    edited, equal = item.replace("12 kg more", "16 kg more"), QUESTION.replace("12", "5").replace("7", "5")
    apart = QUESTION.replace("Jonas", "Ida").replace("Maria", "Ida").replace("12", "15").replace("30", "99").replace("7", "5")
    df = spark.createDataFrame([(1, edited), (2, equal), (3, apart)], "doc_id long, text string")
    items = spark.createDataFrame([(0, item), (1, QUESTION)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in template_leaks.leaks(df, items).collect()}
    assert got >= {(1, 0), (2, 0), (2, 1)} and (3, 1) not in got


def test_leaks_in_scripts_without_spaces(spark):
    """Copied as it is, and with other numbers; kana and Thai; a text that shares a few characters stays."""
    item = "小明有12个苹果，他给了朋友小红5个，又从市场买回来8个，请问现在小明一共还有多少个苹果？请写出计算过程。"
    thai = "ในตะกร้ามีส้มอยู่ 24 ผล แม่หยิบออกไป 7 ผล แล้วพ่อใส่เพิ่มอีก 9 ผล ตอนนี้ในตะกร้ามีส้มทั้งหมดกี่ผล"
    kana = "たろうくんはりんごを15こもっています。ともだちに6こあげました。のこりはなんこですか。"
    docs = [(1, "前文。" + item + "后文。"), (2, item.replace("12", "30").replace("5", "9").replace("8", "4")), (3, "abc " + thai.replace("24", "31")), (4, kana), (5, "小明有很多苹果，他很高兴。朋友也很高兴。"), (6, "plain text " * 30)]
    items = spark.createDataFrame([(0, item), (1, thai), (2, kana)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_slots for r in template_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 1), (4, 2)} and got[2, 0] > 0


def test_reparameterised_items(spark):
    """What the query of that name derives, against every alignment."""
    docs = spark.createDataFrame([(k, ["lorem ipsum dolor", None, "Sit amet."][k % 3]) for k in range(24)], "doc_id long, text string")
    items = spark.createDataFrame([(k, "x") for k in range(7)], "item_id long, text string")
    d, b = template_leaks.reparameterised(docs, items)
    got = template_leaks.leaks(d, b).collect()
    want = plain_leaks([tuple(r) for r in d.collect()], [tuple(r) for r in b.collect()], template_leaks.LeakParams())
    assert {(r.doc_id, r.item_id) for r in got} == want == {(k, k % 7) for k in range(24) if k % 5} and all(r.n_slots > 3 for r in got)


def plain_leaks(docs, items, p):
    """All alignments of all documents and items, window by window, for plain ASCII texts."""
    import re

    def tokens(text):
        t = re.sub(r"([A-Za-z0-9,;:)'-]\s+)(?=[A-Z])", "\\1\1", text or "").lower()
        t = re.sub(r"(?<=\d)(\s*)\x01?(" + "|".join(template_leaks.UNITS) + r")(?![a-z0-9])", "\\1 \2\\2", t)
        return re.findall(r"[\1\2]?[a-z]+|\d+(?:[.,:]\d+)*", t)

    kind = lambda x: x[0] if x[0] in "\1\2" else "0" if x[0].isdigit() else ""
    bare = lambda x: x.lstrip("\1\2")
    named = lambda w: tuple(kind(x) or x for x in w)
    folded = lambda w: tuple(bare(x) if kind(x) in ("", "\1") else kind(x) for x in w)
    tells = lambda t: sum(x not in ("\1", "\2", "0") for x in t) >= p.plain
    out = set()
    for k, item in items:
        b = tokens(item)
        size = min(len(b), p.window)
        if size < p.shortest:
            continue
        wins = [(a, b[a : a + size]) for a in range(len(b) - size + 1)]
        total, n_named = sum(tells(folded(w)) for _, w in wins), sum(tells(named(w)) for _, w in wins)
        for i, doc in docs:
            d = tokens(doc)
            for shift in range(-len(b), len(d)):
                at, own, verbatim, pairs = set(), set(), set(), set()
                for a, w in wins:
                    v = d[a + shift : a + shift + size] if a + shift >= 0 else []
                    if len(v) < size:
                        continue
                    hit_named, hit = named(v) == named(w) and tells(named(w)), folded(v) == folded(w) and tells(folded(w))
                    if hit or hit_named:
                        at.add(a)
                        pairs |= {(kind(x), bare(x), bare(y)) for x, y in zip(w, v) if kind(x)}
                        if list(map(bare, w)) == list(map(bare, v)):
                            verbatim.add(a)
                    if hit_named:
                        own.add(a)
                clash = any(len({y for q, x, y in pairs if (q, x) == g}) > 1 for g in {(q, x) for q, x, _ in pairs}) or any(len({x for q, x, y in pairs if (q, y) == g}) > 1 for g in {(q, y) for q, _, y in pairs if q != "0"})
                enough = at and (len(at) >= min(p.least, total) or (n_named and len(own) >= min(p.least, n_named)))
                if enough and (not clash or len(verbatim) >= min(p.least, total)):
                    out.add((i, k))
    return out


def test_leaks_by_first_tokens_of_windows(spark):
    """Windows that begin with no item's token are left out, or not, where there are too many: the same leaks."""
    docs = spark.createDataFrame([(k, f"some words before {k}. And a few more of them") for k in range(10)], "doc_id long, text string")
    items = spark.createDataFrame([(k, "") for k in range(4)], "item_id long, text string")
    asked, made = template_leaks.reparameterised(docs, items)
    got = [sorted(map(tuple, template_leaks.leaks(asked, made, template_leaks.LeakParams(anchors=n)).drop("key").collect())) for n in (1000, 0)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [k for k in range(10) if k % 5]


@pytest.mark.parametrize("seed", [1])
def test_leaks_equal_all_alignments(spark, seed):
    """Planted copies: verbatim, re-parameterised, with slots that contradict each other, cut, in another case."""
    rng = random.Random(seed)
    plain, names = ["buys", "sells", "apples", "how", "many", "are", "left", "for", "the", "of", "and", "then", "each", "week"], ["Anna", "Berta", "Carl", "Dora", "Emil"]
    word = lambda: rng.choice([rng.choice(plain)] * 5 + [rng.choice(names), str(rng.randint(1, 30)), f"{rng.randint(1, 9)} kg"])
    items = [(k, " ".join(word() for _ in range(rng.choice([4, 6, 12, 25, 40])))) for k in range(14)]

    def copy(text):
        w = text.split()
        how = rng.randrange(6)
        if how == 1:  # one consistent substitution
            swap = dict(zip(names, rng.sample(names, 5))) | {str(n): str(n + 7) for n in range(40)}
            w = [swap.get(x, x) for x in w]
        elif how == 2:  # slots at random
            w = [rng.choice(names) if x in names else str(rng.randint(1, 30)) if x.isdigit() else x for x in w]
        elif how == 3:
            w = w[: rng.randint(3, len(w))]
        elif how == 4:
            w = [x.upper() for x in w]
        elif how == 5:
            w[rng.randrange(len(w))] = "zebra"
        return " ".join(w)

    docs = [(i, " ".join([*(word() for _ in range(rng.randint(0, 6))), copy(rng.choice(items)[1]), *(word() for _ in range(rng.randint(0, 6)))])) for i in range(60)]
    got = template_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = plain_leaks(docs, items, template_leaks.LeakParams())
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 15 and got.where("n_slots > 0").count() > 5


# ---------------------------------------------------------------- components and pipeline


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(up)}


def test_pipeline(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.where("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = C.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == kept


def test_scratch_deletes_what_was_stored(spark):
    import os

    there = lambda: set(os.listdir(shared_dir(spark).removeprefix("file:")))
    df = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    components(df).count()
    before = there()
    with scratch(spark):
        assert components(df).count() == 3 and there() > before
    assert there() == before


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and an empty table, through every stage."""
    import corpus_pipeline as C
    from tests.llm.test_documents_ops import AWKWARD, synthetic

    rows = [*AWKWARD, *((1000 + i, t) for i, t in synthetic(40, 3))]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    for c in ("n_lines", "n_removed", "removed_lines", "key", "h", "rep", "kept", "id", "f", "gone", "in_3", "cut", "sid"):
        docs = docs.selectExpr("*", f"'clash' AS {c}")
    sf = "/root/testdata/sf0.001"
    for name, stage in C.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, sf)
            got = out.collect()
            assert (len(got) > 0) == (df is docs)
            if name != "packing":
                assert out.columns == docs.columns and all(r.n_lines == r.n_removed == r.in_3 == "clash" for r in got)
                assert {r.doc_id for r in got} <= {i for i, _ in rows}
    kept = {r.doc_id for r in C.quality_rules(spark, docs, sf).collect()}
    assert not kept & {1, 2, 3, 4, 5, 7}  # under 20 words, or one word over and over
    assert [r.doc_id for r in C.near_dedup(spark, docs.where("doc_id = 6"), sf).collect()] == [6]
    assert C.decontamination(spark, docs, sf).count() == len(rows)


def test_references_are_string_values(spark):
    """Quoted words and keys refer to nothing; escapes are read; numbers stay as written; a repeated key is an error."""
    big = "12345678901234567890123456789012345678901234567890"
    texts = {
        "a": "{}",
        "b": r'{"x": "he said \"$call:9\" and left", "y": "\\", "z": "$call:a"}',
        "c": '{"$call:a": 1, "deep": {"k": [1, ["$call:b", {"$call:zz": null}]]}}',
        "d": r'{"x": "$call:a", "y": "see $call:a", "w": "$call:", "q": "\\\"$call:nope\""}',
        "e": f'{{"n": {big}, "m": 1e2, "i": 1.0, "s": "7 and -3.5", "t": [-0.10, true, null]}}',
        "f": '{"x": "$call:a", "x": "$call:b"}',
        "g": '["$call:a"]',
        "h": '{"x": "$call:nowhere", "y" : "$call:h2"}',
        "h2": "{}",
    }
    calls = spark.createDataFrame([(1, k, i, "t", v) for i, (k, v) in enumerate(texts.items())], "conv_id long, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    tools = spark.sql("SELECT 't' AS name, array() AS required, map('n', 'integer', 'm', 'integer', 'i', 'integer', 's', 'string', 't', 'array') AS properties")
    got = {r.call_id: r for r in tool_links.link(calls, results, tools).collect()}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0, "f": 0, "g": 0, "h": 1, "h2": 0}
    assert {k: [x for x in r.errors.split(",") if not x.startswith("unknown")] for k, r in got.items() if k not in ("f", "g")} == {"a": [""], "b": [], "c": [], "d": [], "e": [""], "h": ["dangling:nowhere"], "h2": [""]}
    assert got["f"].errors == got["g"].errors == "arguments"
    body = lambda k: got[k].canonical.split('{"arguments":', 1)[1].rsplit(',"call_id"', 1)[0]
    assert body("e") == f'{{"i":1.0,"m":1e2,"n":{big},"s":"7 and -3.5","t":[-0.10,true,null]}}'
    assert body("b") == r'{"x":"he said \"$call:9\" and left","y":"\\","z":"$call:a"}' and body("f") == "null"
    assert json.loads(body("c")) == json.loads(texts["c"]) and json.loads(body("d")) == json.loads(texts["d"])
