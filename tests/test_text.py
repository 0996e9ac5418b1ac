from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T


def lines_of(text):
    """The line model in plain Python: only \\n ends a line, \\r goes with it, a final empty part does not count."""
    out = text.split("\n")
    last = out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out] + ([last] if last else [])


def test_split_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\r", "a\n\nb\n", "\n", "a\x0cb\u2028c\x85d", None]

    @settings(max_examples=30, deadline=None)
    @given(st.text(alphabet="ab\n\r \u2028"))
    def more(t):
        texts.append(t)

    more()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_lines(F.col("t")).alias("l")).collect()
    for r in got:
        assert r.l == lines_of(r.t or ""), repr(r.t)


def test_dialect(spark):
    rows = [("éin in",), ("\u00a0# x",), ("# y",), ("x # z",), ("\u212a",)]
    got = spark.createDataFrame(rows, "l string").select(T.hit(F.col("l"), r"\bin\b").alias("a"), T.live(F.col("l")).alias("b"), T.trim(F.col("l")).alias("c"), T.hit(F.col("l"), "k", True).alias("d")).collect()
    assert [r.a for r in got] == [True, False, False, False, False]
    assert [r.b for r in got] == [True, False, False, True, True]
    assert got[1].c == "# x" and got[4].d


def test_invalid_text_has_no_lines(spark):
    got = spark.createDataFrame([(b"a\xff",), (b"ok\n",)], "b binary").select(T.split_lines(T.valid_text(F.col("b"))).alias("l")).collect()
    assert [r.l for r in got] == [[], ["ok"]]


def test_quoted(spark):
    got = spark.createDataFrame([('a"\\\u202e',)], "l string").select(T.quoted(F.col("l")).alias("q")).first().q
    assert got == '"a\\"\\\\\\u{202e}"'


def test_quoted_escapes_what_does_not_print(spark):
    from siltstone.functions.text import quoted

    df = spark.createDataFrame([('a\u202eb"\\\t\x07é\u00a0 \u200b\U0001f600',), ("",)], "x string")
    assert [r[0] for r in df.select(quoted(df.x)).collect()] == ['"a\\u{202e}b\\"\\\\\\t\\u{7}é\\u{a0} \\u{200b}\U0001f600"', '""']
