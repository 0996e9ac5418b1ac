"""Operator 7, benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts become tokens (runs of letters, numbers; punctuation is dropped; of scripts that are written without spaces, such as
Chinese, Japanese and Thai, each letter is a token) and tokens become templates:
numbers, units after a number and names (a capitalised word that does not start a sentence) turn into
typed placeholders, all else is case-folded. A second, folded template has no names: its words are all plain,
so that copies in upper, lower or title case match too. Windows of ``window`` tokens of both templates are
hash-joined with those of the benchmark items. Every match is then checked on the tokens themselves and its slots are
read: along one alignment of document and item, each value of the item must stand for one value of the
document, and for names and units the other way round; different numbers may become equal. An item with other
numbers or names but one consistent substitution is a re-parameterised copy; slots that contradict each other
are not, unless enough windows are verbatim (case apart): a copy with one edited value stays a copy.

A document is contaminated by an item if one alignment has at least ``least`` matching windows (all of
them, where the item has fewer) and consistent slots, or as many verbatim ones. With 8 and 6 that is 13 template tokens in a row, or
as many windows apart. Items shorter than a window, but of at least ``shortest`` tokens, are matched whole.
Windows with fewer than ``plain`` plain tokens say nothing and are left out; an item of which some windows
have too many names is also matched by the others alone. A copy in another case whose names are also changed
is found only by windows without names.

The benchmark side of the join is broadcast if it has been measured to take at most ``broadcast_bytes``,
else it is shuffled like any join; so are the ids of matched documents in the second pass. Matches are verified once for
each text of a window, before they meet the items that share it.

Where all windows of the items begin with at most ``anchors`` different tokens, only windows of documents that begin with one of
these are made; the others have no partner.

Defined results: null or empty texts and items without enough tokens match nothing; rows with equal doc_id
and text are one document; a null doc_id is reported as null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import stored


@dataclass(frozen=True)
class LeakParams:
    window: int = 8
    least: int = 6
    shortest: int = 5
    plain: int = 4
    anchors: int = 1000
    broadcast_bytes: int = 64 << 20


#: Units that count as such after a number.
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "l", "ml", "s", "ms", "h", "min", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "mph", "kmh", "kwh", "w", "kw", "v", "hz", "gb", "mb")
_NAME, _UNIT = "\u0001", "\u0002"
#: Blocks of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, ideographs.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
TOKEN = rf"[{_NAME}{_UNIT}]?[a-z[\p{{L}}&&[^{UNSPACED}]]]+|[\p{{L}}&&[{UNSPACED}]]|\d+(?:[.,:]\d+)*"


def raw_tokens(text: Column) -> Column:
    """Case-folded tokens; names and units carry a mark in front."""
    t = F.lower(F.upper(F.regexp_replace(text, r"([\p{L}\p{N},;:)'-]\s+)(?=\p{Lu})", f"$1{_NAME}")))
    t = F.regexp_replace(t, rf"(?i)(?<=\d)(\s*){_NAME}?(" + "|".join(UNITS) + r")(?![\p{L}\p{N}])", f"$1 {_UNIT}$2")
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def template(tokens: Column) -> Column:
    """Placeholders for marked tokens and numbers; the rest as it is."""
    return F.transform(tokens, _with_names)


def folded(tokens: Column) -> Column:
    """The template without names: they are words like others."""
    return F.transform(tokens, _without_names)


def _typed(x: Column, name: Column) -> Column:
    first = F.ascii(x)
    return F.when(first > 57, x).when(first == 1, name).when(first == 2, F.lit(_UNIT)).when(first >= 48, F.lit("0")).otherwise(x)


def _with_names(x: Column) -> Column:
    return _typed(x, F.lit(_NAME))


def _without_names(x: Column) -> Column:
    return _typed(x, F.substring(x, 2, 1 << 30))


def _bare(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(_NAME), F.lit("")), F.lit(_UNIT), F.lit(""))  # a byte search; translate looks every character up


def _is_slot(x: Column) -> Column:
    return x.isin(_NAME, _UNIT, "0")


def _has_slot(raw: Column) -> Column:
    """Whether a raw token's place in the template is a slot: it begins with a mark or a digit."""
    first = F.ascii(raw)
    return first.isin(1, 2) | first.between(48, 57)


def codes(tokens: Column, typed: Callable[[Column], Column] = lambda x: x) -> Column:
    """A number for each token as ``typed`` makes it, so that windows are hashed over numbers and every token's text once."""
    return F.transform(tokens, lambda x: F.xxhash64(typed(x)))


def window_hashes(codes: Column, places: Column, size: int) -> Column:
    """array<struct<size, at, h>>: place and hash of the windows that begin at ``places``."""
    return F.transform(places, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.xxhash64(F.slice(codes, i, size)).alias("h")))


def all_places(codes: Column, size: int) -> Column:
    """Where a window begins; nowhere in shorter texts."""
    n = F.size(codes) - size + 1
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def named_places(t: Column, f: Column, size: int) -> Column:
    """Where a window begins that the two templates read differently, since it has a name; the others have the same hash by both."""
    n = F.size(t) - size + 1
    names = F.filter(F.transform(F.zip_with(t, f, lambda a, b: a != b), lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(names, lambda i: F.sequence(F.greatest(i - size + 1, F.lit(1)), F.least(i, n)))))
    return F.when((n > 0) & (t != f), near).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, p: LeakParams) -> DataFrame:
    """(item_id, size, named, at, h, t, item, n_windows, n_named): windows of the items by both templates (``named``: by
    that with names); ``t`` is the window's template, ``item`` has its raw tokens, the counts are those of the item's windows by each."""
    b = items.select(F.col("item_id").cast("long").alias("item_id"), raw_tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("raw")).distinct()
    b = b.withColumn("size", F.least(F.size("raw"), F.lit(p.window))).where(F.col("size") >= p.shortest)
    at = F.explode(F.sequence(F.lit(1), F.size("raw") - F.col("size") + 1))
    b = b.select("item_id", "size", "raw", at.alias("at")).select("item_id", "size", "at", F.slice("raw", F.col("at"), F.col("size")).alias("item"))
    b = b.withColumn("t", template(F.col("item"))).withColumn("named", F.lit(True)).unionByName(b.withColumn("t", folded(F.col("item"))).withColumn("named", F.lit(False)))
    b = b.where(F.size(F.filter("t", lambda x: ~_is_slot(x))) >= p.plain)
    # a window that tells enough by the template with names also does by the folded one
    total = b.groupBy("item_id").agg(F.count_if(~F.col("named")).alias("n_windows"), F.count_if("named").alias("n_named"))
    return b.withColumn("h", F.xxhash64(codes(F.col("t")))).join(total, "item_id")


def _bounded(df: DataFrame, most: int, size: Column | int = 64) -> DataFrame:
    """Marked for broadcast if its rows take at most so many bytes; ``size``: those of a row (64: a few numbers in a hash table)."""
    return F.broadcast(df) if (df.agg(F.sum(F.lit(size) if isinstance(size, int) else size)).first()[0] or 0) <= most else df


def leaks(docs: DataFrame, items: DataFrame, params: LeakParams | None = None) -> DataFrame:
    """One row for each document and item that contaminates it: doc_id, key, item_id, n_windows, item_windows, n_slots."""
    p = params or LeakParams()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("key"), text.alias("text"))
    b = stored(item_windows(items, p), "item-windows")
    sizes = sorted(r["size"] for r in b.select("size").distinct().collect())  # at most window values
    probes = _bounded(b.select("size", "h").distinct(), p.broadcast_bytes)
    tokens = d.select("doc_id", "key", raw_tokens(F.col("text")).alias("raw"))
    tokens = tokens.select("doc_id", "key", codes(F.col("raw"), _with_names).alias("t"), codes(F.col("raw"), _without_names).alias("f"))
    t, f = F.col("t"), F.col("f")
    first = [r["c"] for r in b.select(F.xxhash64(F.get("t", F.lit(0))).alias("c")).distinct().limit(p.anchors + 1).collect()]
    begun = lambda c, places: F.filter(places, lambda i: F.get(c, i - 1).isin(first)) if len(first) <= p.anchors else places
    windows = [w for size in sizes or [p.window] for w in (window_hashes(f, begun(f, all_places(f, size)), size), window_hashes(t, begun(t, named_places(t, f, size)), size))]  # of all sizes in one pass
    # the outer form: for the other, the planner asks for the array's size first, and makes all windows once more for that
    hits = tokens.select("doc_id", "key", F.explode_outer(F.concat(*windows)).alias("w")).select("doc_id", "key", "w.size", "w.at", "w.h")
    hits = stored(hits.join(probes, ["size", "h"], "left_semi").distinct(), "hits")

    # second pass: the tokens of matched documents only
    ids = _bounded(hits.select("key").distinct(), p.broadcast_bytes)
    some = d.join(ids, "key", "left_semi").dropDuplicates(["key"]).select("key", raw_tokens(F.col("text")).alias("raw"))
    own = hits.select("key", "doc_id", "size", F.col("at").alias("d_at"), "h").join(some, "key")
    own = own.select("key", "doc_id", "size", "d_at", "h", F.slice("raw", F.col("d_at"), F.col("size")).alias("doc"))
    bytes_of = lambda tokens: F.aggregate(tokens, F.lit(0), lambda n, x: n + F.octet_length(x) + 24)
    form = F.when(F.col("named"), template(F.col("doc"))).otherwise(folded(F.col("doc")))
    each = b.select("size", "h", "named", "t").distinct()
    own = own.join(_bounded(each, p.broadcast_bytes, F.lit(96) + bytes_of("t")), ["size", "h"]).where(form == F.col("t"))
    # a window that is verified has its item's template: no pair is put into that form again
    pairs = own.join(_bounded(b, p.broadcast_bytes, F.lit(96) + bytes_of("item") + bytes_of("t")), ["size", "h", "named", "t"]).drop("t")
    pairs = stored(pairs.withColumn("shift", F.col("d_at") - F.col("at")), "pairs")
    group = ["key", "doc_id", "item_id", "shift"]
    slots = F.filter(F.arrays_zip(F.col("item").alias("i"), F.col("doc").alias("d")), lambda x: _has_slot(x["i"]))
    seen = pairs.select(*group, F.explode(slots).alias("s")).select(*group, _bare(F.col("s.i")).alias("i"), _bare(F.col("s.d")).alias("d"), F.col("s.i").substr(1, 1).alias("kind")).distinct()
    kind = F.when(F.col("kind").isin(_NAME, _UNIT), F.col("kind")).otherwise("0")
    seen = seen.withColumn("kind", kind)
    clash = seen.groupBy(*group, "kind", "i").agg(F.count("*").alias("n")).unionByName(seen.groupBy(*group, "kind", "d").agg(F.when(F.col("kind") == "0", 1).otherwise(F.count("*")).alias("n")).withColumnRenamed("d", "i"))
    slot_stats = clash.groupBy(*group).agg(F.max("n").alias("most"), F.count("*").alias("n_slots"))
    verbatim = _bare(F.array_join("doc", " ")) == _bare(F.array_join("item", " "))  # no token has a space
    # both templates may match at one place: that is one window
    places = pairs.select(*group, "at", "named", verbatim.alias("verbatim"), "n_windows", "n_named").repartition(*group).groupBy(*group, "at").agg(F.max("named").alias("named"), F.max("verbatim").alias("verbatim"), F.first("n_windows").alias("item_windows"), F.first("n_named").alias("item_named"))
    counts = places.groupBy(*group).agg(F.count("*").alias("n_windows"), F.count_if("named").alias("own_named"), F.count_if("verbatim").alias("own_verbatim"), F.first("item_windows").alias("item_windows"), F.first("item_named").alias("item_named"))
    s, c = slot_stats.alias("s"), counts.alias("c")
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    enough = F.col("c.n_windows") >= F.least(F.lit(p.least), F.col("c.item_windows"))
    enough |= (F.col("c.item_named") > 0) & (F.col("c.own_named") >= F.least(F.lit(p.least), F.col("c.item_named")))
    agree = (F.coalesce("s.most", F.lit(1)) <= 1) | (F.col("c.own_verbatim") >= F.least(F.lit(p.least), F.col("c.item_windows")))
    ok = c.join(s, same[0] & same[1] & same[2] & same[3], "left").where(enough & agree)
    return ok.groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.key").alias("key"), F.col("c.item_id").alias("item_id")).agg(F.max("c.n_windows").alias("n_windows"), F.max("c.item_windows").alias("item_windows"), F.max(F.coalesce("s.n_slots", F.lit(0))).alias("n_slots"))


#: A question with slots; {n} and {m} are numbers, {name}, {other} and {again} names; {word} is in every window and tells items apart.
QUESTION = "a {word} farmer called {name} has {n} kg of {word} apples and sells {m} kg of {word} apples to a {word} friend {other} so how many kg of {word} apples does the {word} farmer {again} still have"


def _question(number: Column, shift: int, first: int, contradict: Column) -> Column:
    """The text of question ``number`` with numbers moved by ``shift`` and names from ``first`` on."""
    people = F.array(*[F.lit(x) for x in ("Anna", "Boris", "Clara", "Denis", "Elena", "Fabio", "Greta", "Hanno")])
    who = lambda k: F.element_at(people, (F.pmod(number + k, F.lit(8)) + 1).cast("int"))
    digits = lambda least, range_: (F.pmod(number, F.lit(range_)) + least + shift).cast("string")
    word = F.concat(F.lit("sort"), F.translate(number.cast("string"), "0123456789", "abcdefghij"))
    slots = {"word": word, "name": who(first), "other": who(first + 1), "again": F.when(contradict, who(first + 3)).otherwise(who(first)), "n": digits(100, 90), "m": digits(10, 60)}
    return F.concat(*[slots[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\w+)\}", QUESTION))])


def reparameterised(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of the form of QUESTION, one for each row of ``items``, and ``docs`` with the question of one item in other numbers and
    names behind their texts (every fifth with a name that contradicts itself)."""
    n = items.count()
    made = items.select("item_id", _question(F.col("item_id"), 0, 0, F.lit(False)).alias("text"))
    number = F.pmod("doc_id", F.lit(max(n, 1)))
    asked = _question(number, 7, 3, F.pmod("doc_id", F.lit(5)) == 0)
    return docs.select("doc_id", F.concat_ws(". ", F.col("text").cast("string"), asked).alias("text")), made


def document_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def drop_contaminated(docs: DataFrame, items: DataFrame, params: LeakParams | None = None) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    p = params or LeakParams()
    bad = _bounded(stored(leaks(docs, items, p).select("key").distinct(), "contaminated"), p.broadcast_bytes)
    return docs.join(bad, document_key() == bad["key"], "left_anti")
