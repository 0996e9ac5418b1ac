"""Advisories as a table: an interval join of manifests with (dependency, introduced, fixed).

A line of a manifest names dependencies (the runs of characters between quotes, commas, operators and white space) and allows a
version (the first ``op a.b.c`` in it). Lines are joined to the advisories of their dependency whose interval holds the version: at
least ``introduced``, below ``fixed``, either of which may be missing. For each file and advisory the first such line counts.

Only lines and advisories are shuffled, never their matches, of which there may be thousands for each file. A file's lines are
brought down to the first for each (dependency, version) and gathered by dependency; advisories of one dependency and interval are
gathered too, at most ``TOGETHER`` in a row. So a file meets an interval in few pairs of rows, whose first line inside holds for all
their advisories, and the pairs are exploded where they stand.

What comes out is documents times advisories, so its order decides how many bytes it takes. The work is cut into tiles, a task
each: a slot of advisories whose details take about ``SHARE`` bytes (less than what columnar writers keep in a dictionary) by one of
``BLOCKS`` parts of the files. A dependency with many advisories has several slots, to each of which its lines are copied; ones with few
share a slot. In a tile up to ``GATHERED`` files stand in a row, and a row of advisories is repeated for all of these before the next
row's turn: runs of one file, and one sequence of details over and over.

The advisories are broadcast if they have been counted to take at most ``BROADCAST_BYTES``. Beyond that they are shuffled, a copy for
each part of the files. A dependency that a third of all lines name is spread over as many tasks as there are parts.

Defined results: a bound that is given but is no ``a.b.c`` below 2^32 makes an advisory that nothing meets, as does a null dependency;
rows that are equal are one advisory; names are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import manifest_rules as M

SCHEMA = "dependency string, introduced string, fixed string, advisory string"
BROADCAST_BYTES = 16 << 20
TOGETHER = 256
SHARE = 640 << 10
BLOCKS = 64
GATHERED = 512
FILE = ("path_key", "file", "package")
#: A name in a lower-case line: what stands before it, and all that cannot be in it.
NAME = r"(?Ud)(?:\A|(?<=[\"'=,\s]))([^\"':,<>=!\s]+)"


def builtin(spark: SparkSession) -> DataFrame:
    """The fixed table, as one of this kind."""
    return spark.createDataFrame([(d, None, fixed, cve) for d, fixed, cve in M.VULNERABLE], SCHEMA)


def ranges(advisories: DataFrame) -> DataFrame:
    """(ord, dependency, low, high, detail): bounds as versions that compare in order. ``ord``, by which a file's findings are listed,
    is a column of that name (a whole number), else a hash, since the table may be of any size."""
    first = [F.col("ord")] if "ord" in advisories.columns else []
    a = advisories.select(*first, F.lower(F.trim(F.col("dependency").cast("string"))).alias("dependency"), *[F.col(c).cast("string").alias(c) for c in ("introduced", "fixed", "advisory")])
    a = a.distinct().withColumn("low", F.expr(M.version("introduced"))).withColumn("high", F.expr(M.version("fixed")))
    good = F.col("dependency").isNotNull() & (F.col("introduced").isNull() | F.col("low").isNotNull()) & (F.col("fixed").isNull() | F.col("high").isNotNull())
    since = F.when(F.col("introduced").isNotNull(), F.concat(F.lit(">="), "introduced"))
    until = F.when(F.col("fixed").isNotNull(), F.concat(F.lit("<"), "fixed"))
    detail = F.concat(F.concat_ws(" ", "dependency", since, until), F.lit(": "), F.coalesce("advisory", F.lit("")))
    place = F.coalesce(F.col("ord").cast("int"), F.lit(0)) if first else F.pmod(F.xxhash64("dependency", "introduced", "fixed", "advisory"), F.lit(2**31 - 1)).cast("int")
    return a.where(good).select(place.alias("ord"), "dependency", "low", "high", detail.alias("detail"))


def allowed(files: DataFrame) -> DataFrame:
    """(path_key, file, package, dependency, v, no, line): the lines of manifests that name a dependency with a version."""
    manifests = files.where(F.col("name").isin(*M.MANIFESTS))
    line = F.posexplode(T.split_lines(F.col("text"))).alias("at", "line")
    found = F.regexp_extract("line", "(?Ud)" + M.VERSION, 1)
    rows = manifests.select(*FILE, line).select("*", found.alias("found")).where("found <> ''")
    rows = rows.select(*FILE, (F.col("at") + 1).alias("no"), "line", F.expr(M.version("found")).alias("v")).where("v IS NOT NULL")
    names = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(NAME), F.lit(1)))).alias("dependency")
    return rows.select(*FILE, names, "v", "no", "line")


def _placed(df: DataFrame, large: list, rest: int) -> DataFrame:
    """With a dependency's first slot and how many it has; of those that are not ``large``, one of the ``rest``."""
    own = [F.struct(F.lit(d).alias("dependency"), F.lit(first).alias("first"), F.lit(parts).alias("parts")) for d, first, parts in large]
    if own:
        df = df.join(F.broadcast(df.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*own)))), "dependency", "left")
    else:
        df = df.withColumns({"first": F.lit(None).cast("int"), "parts": F.lit(None).cast("int")})
    after = large[-1][1] + large[-1][2] if large else 0
    return df.withColumns({"first": F.coalesce("first", (F.pmod(F.xxhash64("dependency"), F.lit(rest)) + after).cast("int")), "parts": F.coalesce("parts", F.lit(1))})


def vulnerable(files: DataFrame, advisories: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, together: int = TOGETHER, share: int = SHARE) -> DataFrame:
    """(path_key, file, package, ord, no, line, code, detail): the first line of each file that an advisory holds for; ``code``: trimmed."""
    known, interval = ranges(advisories).distinct(), ["dependency", "low", "high"]
    text, room = F.sum(F.octet_length("detail") + 4).alias("text"), F.sum(F.length("dependency") + F.length("detail") + 64).alias("room")
    widths = known.groupBy(*interval).agg(F.count("*").alias("n"), text, room).groupBy("dependency").agg(F.max("n").alias("most"), F.sum("text").alias("text"), F.sum("room").alias("room"))
    heavy = F.collect_list(F.when(F.col("text") > share // 4, F.struct("dependency", "text")))  # fewer than four for each share
    most, text, size, heavy = widths.agg(F.max("most"), F.sum("text"), F.sum("room"), heavy).first()
    large, slots = [], 0
    for dependency, bytes_ in sorted(heavy):
        large.append((dependency, slots, -(-bytes_ // share)))
        slots += large[-1][2]
    rest = max(1, -(-((text or 0) - sum(b for _, b in heavy)) * 2 // share))
    blocks = max(BLOCKS, 2 * files.sparkSession.sparkContext.defaultParallelism)
    tiles, tile = (slots + rest) * blocks, (F.col("slot") * blocks + F.col("block")).cast("int").alias("tile")

    lot = F.pmod(F.xxhash64("detail"), F.lit(-(-(most or 1) // (4 * together))))
    known = known.groupBy(*interval, lot.alias("lot")).agg(F.collect_list(F.struct("ord", "detail")).alias("lots"))
    cut = F.transform(F.sequence(F.lit(1), F.size("lots"), F.lit(together)), lambda k: F.slice("lots", k, together))
    known = _placed(known, large, rest).select(*interval, "lot", "first", "parts", F.posexplode(cut).alias("nth", "advisories"))
    known = known.select(*interval, (F.col("first") + F.pmod(F.xxhash64("low", "high", "lot", "nth"), "parts")).cast("int").alias("slot"), "advisories")

    slot = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("slot")
    block = F.pmod(F.xxhash64(*FILE), F.lit(blocks)).cast("int").alias("block")
    each = _placed(allowed(files), large, rest).select("*", slot).select(*FILE, "dependency", "v", "no", "line", "slot", block)
    each = each.select("*", tile).repartitionById(tiles, "tile")
    lines = each.groupBy("tile", "slot", "dependency", *FILE, "v").agg(F.min(F.struct("no", "line")).alias("first"))
    lines = lines.groupBy("tile", "slot", "dependency", *FILE).agg(F.array_sort(F.collect_list(F.struct("first.no", "first.line", "v"))).alias("lines"))
    turn = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / GATHERED).alias("turn")  # of rows that lie in one task
    lines = lines.select("*", turn).groupBy("tile", "slot", "dependency", "turn").agg(F.collect_list(F.struct(*FILE, "lines")).alias("files"))
    if (size or 0) <= broadcast_bytes:
        met = lines.join(F.broadcast(known), ["dependency", "slot"])
    else:
        known = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*interval, "advisories", tile)
        met = lines.join(known.repartitionById(tiles, "tile").hint("shuffle_hash"), ["tile", "dependency"])
    low, high = F.col("low"), F.col("high")
    first = lambda f: F.get(F.filter(f["lines"], lambda x: (low.isNull() | (x["v"] >= low)) & (high.isNull() | (x["v"] < high))), F.lit(0))
    met = met.select(F.inline(F.transform("files", lambda f: F.struct(*[f[c].alias(c) for c in FILE], first(f).alias("first")))), "advisories").where("first IS NOT NULL")
    met = met.select(*FILE, "first.no", "first.line", T.trim(F.col("first.line")).alias("code"), "advisories")  # trimmed once for all
    return met.select(*FILE, "no", "line", "code", F.inline("advisories")).select(*FILE, "ord", "no", "line", "code", "detail")
