"""Operator 4, tool-call linking. DataFrame functions only.

Calls (conv_id, call_id, turn, name, arguments as JSON) and results (conv_id, call_id, turn, content) are
hash-joined by conversation and identifier. Arguments are checked against the schema of the called tool
(required keys, known keys, JSON types), calls are levelled topologically along the references in their arguments - string
values, at any depth, that are ``$call:<id>`` and nothing else; keys and texts that only quote such a word are none - and
each link is serialised as canonical JSON: keys sorted at every depth, no white space, numbers as they are written. A number
without a fraction (``1``, ``1.0``, ``1e2``) is an integer.

A row is one call, or one result without a call; ``level``, ``turn`` and ``call_id`` order a conversation's
rows. Conversations are never gathered: a conversation with a third of all rows is so many rows. Of several
results with one identifier the earliest answers; of several calls with one identifier the earliest is
linked and the others are ``duplicate`` (no level, and their references are not followed); both by
aggregation, so repeated identifiers never multiply.

Status: ``linked``, ``unanswered``, ``early`` (the result comes before its call), ``duplicate``, ``orphan``
(a result without a call), ``cycle`` (references that run in a circle, or lead into one: no level).

Levels: calls with one reference are chains, and a chain of n takes log2(n) rounds of pointer doubling. A reference
that a call's latest one has too is implied and goes first. Calls that still have several are settled when what
they need is, and one that then needs a single other call joins the chains. So there are as many outer
rounds as calls with several references of their own stand one above the other, at most.

Defined results: null ids match nothing (calls are unanswered, results orphans); arguments that are null,
no JSON, no object, or hold an object with a repeated key have the error ``arguments``, refer to nothing and are serialised as
``null`` unless they are JSON; an unknown tool has ``tool``; references to unknown ids
are ``dangling`` errors and do not order; rows that are equal in all columns are linked alike; an empty table
gives an empty result; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import stored

REFERENCE = "$call:"
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
WHOLE = r"-?\d+(?:\.0+)?(?:[eE]\+?\d+)?"
#: Stands before a number that is kept as text; no character of any text.
_TAG = "\uffff#"
# What escapes become while a text is cut at its quotation marks: characters that JSON does not have as they are.
_SLASH, _QUOTE = "\u0001", "\u0002"


def _parts(json: Column) -> Column:
    """JSON cut at the quotation marks that delimit strings: what stands between strings, and their contents, in turn."""
    masked = F.replace(F.replace(json, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.split(masked, '"', -1)


def _unmasked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def references(parts: Column) -> Column:
    """The identifiers that string values of ``_parts`` refer to."""
    is_key = lambda i: F.coalesce(F.ltrim(F.get(parts, i + 1)).startswith(":"), F.lit(False))
    strings = F.filter(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & ~is_key(i), x)), lambda x: x.isNotNull() & (x.startswith(REFERENCE) | x.contains("\\u")))
    plain = F.transform(strings, lambda x: F.get(F.from_json(F.concat(F.lit('["'), _unmasked(x), F.lit('"]')), "array<string>"), F.lit(0)))
    ids = F.filter(plain, lambda x: x.startswith(REFERENCE) & (F.length(x) > len(REFERENCE)))
    return F.array_distinct(F.transform(ids, lambda x: F.substring(x, len(REFERENCE) + 1, (1 << 31) - 1)))


def tagged(parts: Column) -> Column:
    """The JSON of ``_parts`` with its numbers as marked texts."""
    between = lambda x: F.regexp_replace(x, NUMBER, f'"{_TAG}$0"')
    return _unmasked(F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, between(x)).otherwise(x)), '"'))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain conversation table; the identifier of a turn is ``<conv_id>:<turn>``.

    A user turn calls ``reply`` with its text, its position, and a reference ``after`` to the user turn two
    before it where there is one to refer to (turn > 1); a system turn calls ``configure``; any other role's turn
    is the result of the turn before it. By the number of the conversation, some calls are made as agents make
    them: a second reference (``first``, four turns back), a position written as text, a key that the tool does
    not know, no prompt, an identifier used twice, a reference ahead (``until``), a result before its call.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    to = lambda ahead: F.concat(F.lit("$call:"), ident(F.col("turn") + ahead))
    of = lambda n, k: F.coalesce(F.pmod("conv_id", F.lit(n)) == k, F.lit(False))
    second, third = F.col("turn").isin(2, 3), F.col("turn").isin(4, 5)
    after, first = F.when(F.col("turn") > 1, to(-2)).alias("after"), F.when(of(5, 1) & (F.col("turn") > 3), to(-4)).alias("first")
    prompt = F.when(~(of(7, 4) & second), F.col("text")).alias("prompt")
    retry, until = F.when(of(7, 3) & second, F.lit(True)).alias("retry"), F.when(of(11, 6) & second, to(2)).alias("until")
    reply = lambda position: F.to_json(F.struct(after, first, position.alias("position"), prompt, retry, until))
    args = F.when(F.col("role") != "user", F.to_json(F.struct(F.col("text").alias("instructions")))).when(of(7, 2) & second, reply(F.col("turn").cast("string"))).otherwise(reply(F.col("turn")))
    is_call = F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    own = F.when(of(11, 5) & third & (F.col("role") == "user"), ident(F.col("turn") - 2)).otherwise(ident(F.col("turn")))
    calls = t.where(is_call).select("conv_id", own.alias("call_id"), "turn", F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"), args.alias("arguments"))
    results = t.where(~is_call).select("conv_id", ident(F.col("turn") + F.when(of(13, 7), 1).otherwise(-1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def conversation_tools(spark) -> DataFrame:
    """The schemas of ``conversation_calls``."""
    return spark.sql("SELECT * FROM VALUES ('reply', array('position', 'prompt'), map('position', 'integer', 'prompt', 'string', 'after', 'string', 'first', 'string', 'until', 'string')), ('configure', array('instructions'), map('instructions', 'string')) AS t(name, required, properties)")


def _kind(v: Column) -> Column:
    """JSON type of a variant."""
    s = F.schema_of_variant(v)
    text = F.when(s == "STRING", F.try_variant_get(v, "$", "string"))
    number = F.when(F.regexp_like(text, F.lit(rf"\A{_TAG}{WHOLE}\z")), "integer").when(text.startswith(_TAG), "number")
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise(F.coalesce(number, F.lit("string")))


def _errors(args: Column, required: Column, properties: Column) -> Column:
    """Sorted names of what is wrong with the arguments."""
    keys, known = F.map_keys(args), F.map_keys(properties)
    missing = F.transform(F.array_except(required, keys), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))
    want = lambda k: F.element_at(properties, k)
    have = lambda k: _kind(F.element_at(args, k))
    wrong = F.filter(F.array_intersect(keys, known), lambda k: (have(k) != want(k)) & ~((want(k) == "number") & (have(k) == "integer")))
    return F.array_sort(F.concat(missing, unknown, F.transform(wrong, lambda k: F.concat(F.lit("type:"), k))))


KEY = ["conv_id", "call_id"]
LINK = [*KEY, "to", "o", "c", "d"]


def _to(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` to be joined to the ends of links: call_id as ``to``, other columns with ``_to`` behind their names."""
    return df.select("conv_id", F.col("call_id").alias("to"), *[F.col(c).alias(f"{c}_to") for c in columns])


def _followed(c: Column, d: Column) -> list[Column]:
    """A link followed by that of its end, where there is one (columns ``_to``)."""
    on = F.col("to_to").isNotNull()
    return [F.when(on, F.col("to_to")).otherwise(F.col("to")).alias("to"), F.when(on, F.col("o_to")).otherwise(F.col("o")).alias("o"), F.when(on, F.greatest(c, F.col("c_to") + d)).otherwise(c).alias("c"), F.when(on, d + F.col("d_to")).otherwise(d).alias("d")]


def reduced(links: DataFrame) -> DataFrame:
    """Links without those that the latest one of the same node implies: where a needs b and c, and c needs b, then
    the way over c is the longer one. ``n`` is the number of links that a node keeps."""
    latest = links.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.struct("o", "to", "c", "d")).alias("k"))
    own = links.join(latest, KEY)
    over = links.select("conv_id", F.col("call_id").alias("via"), "to", F.col("c").alias("c_to"), F.col("d").alias("d_to"))
    many = own.where("n > 1").withColumn("via", F.col("k.to")).join(over, ["conv_id", "via", "to"], "left")
    implied = (F.col("to") != F.col("via")) & (F.col("k.d") + F.col("d_to") >= F.col("d")) & (F.greatest("k.c", F.col("c_to") + F.col("k.d")) >= F.col("c"))
    kept = many.where(~F.coalesce(implied, F.lit(False))).select(*LINK)
    kept = kept.join(kept.groupBy(*KEY).agg(F.count("*").alias("n")), KEY)
    return own.where("n = 1").select(*LINK, "n").unionByName(kept)


def chains(links: DataFrame) -> DataFrame:
    """Links of nodes that have one each, followed to a node that has none here; nodes that run into a circle go.

    A link says level = max(c, level(to) + d), a form that two links in a row have too.
    """
    links = stored(links.withColumn("moving", F.lit(True)), "links")
    longest = links.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):  # a path inside one conversation is no longer than that, unless it is a circle
        moved = links.where("moving").drop("moving").join(_to(links, "to", "o", "c", "d", "moving"), ["conv_id", "to"], "left")
        moved = moved.select(*KEY, *_followed(F.col("c"), F.col("d")), F.coalesce("moving_to", F.lit(False)).alias("moving"))
        links = stored(links.where("not moving").unionByName(moved), "links")
        if not links.where("moving").limit(1).count():
            break
    return links.where("not moving").select(*LINK)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of each node that no circle holds back.

    edges: call_id needs ``needs``, both nodes; ``turn`` is the needed one's place, any number if there is none.
    """
    left = edges.select(*KEY, F.col("needs").alias("to"), F.col("turn").cast("long").alias("o"), F.lit(0).alias("c"), F.lit(1).alias("d")).distinct()
    left = stored(reduced(stored(left, "edges")), "links")
    done = stored(nodes.select(*KEY).distinct().join(left.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(0)), "levels")
    several = None
    while True:
        single = chains(left.where("n = 1").select(*LINK)).join(_to(done, "level"), ["conv_id", "to"], "left")
        single = stored(single.withColumn("level", F.greatest("c", F.col("level_to") + F.col("d"))).select(*LINK, F.when(F.col("level_to").isNotNull(), F.col("level")).alias("level")), "chains")
        done = done.unionByName(single.where("level is not null").select(*KEY, "level"))
        many, before = left.where("n > 1"), several
        several = many.select(*KEY).distinct().count()
        if not several or several == before:  # the rest, if any, are circles and what they hold back
            return done
        wait = single.where("level is null").select(*LINK)
        step = many.select(*LINK).join(_to(done, "level"), ["conv_id", "to"], "left").join(_to(wait, "to", "o", "c", "d"), ["conv_id", "to"], "left")
        known = F.col("level_to").isNotNull()
        to, o, c, d = _followed(F.col("c"), F.col("d"))
        step = step.select(*KEY, F.when(~known, to).alias("to"), F.when(~known, o).alias("o"), F.when(known, F.greatest("c", F.col("level_to") + F.col("d"))).otherwise(c).alias("c"), d)
        step = stored(step.groupBy(*KEY, "to", "o").agg(F.max("c").alias("c"), F.max("d").alias("d")), "links")
        each = step.groupBy(*KEY).agg(F.count("to").alias("n"), F.max("c").alias("most"))
        done = stored(done.unionByName(each.where("n = 0").select(*KEY, F.col("most").alias("level"))), "levels")
        rest = step.where("`to` is not null").join(each, KEY).select(*KEY, "to", "o", F.greatest("c", "most").alias("c"), "d")
        left = stored(reduced(stored(rest.unionByName(wait), "links")), "links")


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, name, result_turn, level, status, errors, canonical: see the module's text.

    ``tools``: name, required array<string>, properties map<string, string> of JSON types. ``canonical`` is
    null for an orphan's call part; it always is one JSON object.
    """
    key = KEY
    calls = calls.select(*key, "turn", "name", F.col("arguments").cast("string").alias("arguments"))
    results = results.select(*key, "turn", F.col("content").cast("string").alias("content"))
    tools = tools.select("name", "required", "properties")
    answer = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"))
    first = calls.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments")).alias("first"), F.count("*").alias("n_calls"))
    own = calls.join(first, key, "left").join(answer, key, "left")
    named = first.where("call_id is not null and conv_id is not null")
    readable = F.when(F.schema_of_variant(F.try_parse_json("first.arguments")).startswith("OBJECT"), F.col("first.arguments"))
    refs = named.select(*key, _parts(readable).alias("parts")).select(*key, F.explode(references(F.col("parts"))).alias("needs"))
    nodes = named.select(*key)
    known = refs.join(named.select("conv_id", F.col("call_id").alias("needs"), F.col("first.turn").alias("turn")), ["conv_id", "needs"])
    loose = refs.join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti").groupBy(*key).agg(F.sort_array(F.collect_set(F.concat(F.lit("dangling:"), F.col("needs")))).alias("loose"))
    own = own.join(levels(nodes, known), key, "left").join(loose, key, "left").join(tools, "name", "left")

    own = own.withColumn("parts", F.when(F.try_parse_json("arguments").isNotNull(), _parts(F.col("arguments")))).withColumn("json", tagged(F.col("parts")))
    v = F.try_parse_json("json")
    own = own.withColumn("args", F.when(F.schema_of_variant(v).startswith("OBJECT"), F.from_json(F.col("json"), "map<string, variant>")))
    written = F.regexp_replace(F.to_json(v), f'"{_TAG}([^"]*)"', "$1")
    bad = F.when(F.col("args").isNull(), F.array(F.lit("arguments"))).when(F.col("required").isNull(), F.array(F.lit("tool"))).otherwise(_errors(F.col("args"), F.col("required"), F.col("properties")))
    repeat = F.coalesce((F.col("n_calls") > 1) & ~F.struct("turn", "name", "arguments").eqNullSafe(F.col("first")), F.lit(False))
    errors = F.concat(bad, F.when(repeat, None).otherwise(F.col("loose")))
    errors = F.coalesce(errors, bad)
    early = F.col("r.turn") < F.col("turn")
    has_id = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    status = F.when(repeat, "duplicate").when(has_id & F.col("level").isNull(), "cycle").when(F.col("r").isNull(), "unanswered").when(early, "early").otherwise("linked")
    rows = own.select(*key, "turn", "name", F.when(~repeat, F.col("r.turn")).alias("result_turn"), F.when(~repeat, F.col("level")).alias("level"), status.alias("status"), errors.alias("errors"), F.coalesce(written, F.lit("null")).alias("a"), F.when(~repeat, F.col("r.content")).alias("content"))
    orphans = results.join(nodes, key, "left_anti")
    rows = rows.unionByName(orphans.select(*key, F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("name"), F.col("turn").alias("result_turn"), F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("errors"), F.lit("null").alias("a"), "content"))
    plain = F.to_json(F.struct("call_id", "content", "name"), {"ignoreNullFields": "false"})
    canonical = F.concat(F.lit('{"arguments":'), F.col("a"), F.lit(","), F.substring(plain, 2, (1 << 31) - 1))
    return rows.select(*key, "turn", "name", "result_turn", "level", "status", F.array_join("errors", ",").alias("errors"), canonical.alias("canonical"))
