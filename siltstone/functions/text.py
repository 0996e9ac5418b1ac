"""Text functions with the dialect that the rules are written in.

``(?U)`` makes classes and word borders Unicode-aware, ``(?d)`` leaves only ``\\n`` as a line end for ``.``.
Lines are the ``\\n``-split parts of a text: a final empty part is dropped and ``\\r`` before ``\\n`` goes with
it; no other character ends a line. A text that is not valid UTF-8 has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIDI = "‪‫‬‭‮⁦⁧⁨⁩"


def hit(text: Column, pattern: str, fold: bool = False) -> Column:
    return F.regexp_like(text, F.lit(("(?iUd)" if fold else "(?Ud)") + pattern))


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def live(line: Column) -> Column:
    """Not a comment from its first visible character on."""
    return ~(line.contains("#") & F.regexp_like(line, F.lit(r"(?U)\A\s*#")))


def valid_text(content: Column) -> Column:
    """Bytes as text, or null."""
    return F.try_validate_utf8(content.cast("string"))


def split_lines(text: Column) -> Column:
    """The lines of a text; none for null or empty text."""
    raw = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    n = F.size(raw)
    whole = F.transform(F.slice(raw, 1, n - 1), lambda x: F.when(x.endswith("\r"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))
    last = F.slice(raw, n, 1)
    return F.when(F.element_at(raw, -1) == "", whole).otherwise(F.concat(whole, last))


def quoted(line: Column) -> Column:
    """The line between quotes; backslashes, quotes and all that does not print (controls, directional and other format
    characters, unusual spaces) escaped."""
    short = {"\\": "\\\\", '"': '\\"', "\t": "\\t", "\r": "\\r", "\0": "\\0"}

    def one(c: Column) -> Column:
        code = F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))
        known = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in short.items()])
        return F.coalesce(known, F.when(F.regexp_like(c, F.lit(r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]")), code), c)

    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(line, F.lit(r"(?s)."), F.lit(0)), one), ""), F.lit('"'))
