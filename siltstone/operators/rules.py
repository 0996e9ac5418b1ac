"""Rules as data.

A *variant* is one kind of finding. A text check is a list of *groups*; in a group the first variant whose
condition holds on a line fires, groups fire independently. Conditions are small trees that are compiled to Catalyst's
expression text here (one text for all rules of a plan, since columns made one by one take the driver seconds), and to
the SQL of the cross-engine tests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


def quote(text: str) -> str:
    """A string literal of Catalyst's expression text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Cond:
    def __and__(self, other: Cond) -> Cond:
        return All((self, other))

    def __or__(self, other: Cond) -> Cond:
        return Any((self, other))

    def __invert__(self) -> Cond:
        return Not(self)


def _alternatives(pattern: str) -> list[str]:
    """The parts between the bars that stand outside of groups and classes."""
    out, depth, inside, k, start = [], 0, False, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside, k = True, k + 1  # a first ] would be a member
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


_PIECE = re.compile(r"(?P<class>\[\]?[^\]]*\])|\\(?P<kind>[A-Za-z])|\\(?P<escaped>.)|(?P<open>\()|(?P<any>[.^$])|(?P<plain>.)", re.S)
_MANY = re.compile(r"[*+?]\??|\{(\d+),?\d*\}")


def needles(pattern: str, fold: bool = False) -> tuple[str, ...]:
    """Texts of which any line that the pattern is found in has one; none if nothing can be said.

    With ``fold`` they are lower case and free of letters that other letters fold to (long s, the Kelvin sign, dotted i).
    """
    out: list[str] = []
    for part in _alternatives(pattern):
        runs, k, groups = [""], 0, []
        while k < len(part):
            m = _PIECE.match(part, k)
            k = m.end()
            if m["open"]:
                depth = k
                while not _closed(part[depth - 1 : k]):
                    k += 1
                inner = part[depth : k - 1]
            text = m["escaped"] or m["plain"] or ""
            many = _MANY.match(part, k)
            least = 1 if not many else 0 if part[k] in "*?" else int(many[1]) if many[1] else 1
            k = many.end() if many else k
            if m["open"] and least and not inner.startswith(("?!", "?<", "?=")):
                groups.append(needles(inner.removeprefix("?:"), fold))
            if text and least:
                runs[-1] += text
            if not text or many:
                runs.append("")
        if fold:
            runs = [x for r in runs for x in re.split("[skiSKI]|[^\\x00-\\x7f]", r.lower())]
        best = max(runs, key=len)
        found = [(best,)] * (len(best) > 2) + [g for g in groups if g]
        if not found:
            return ()
        out += max(found, key=lambda g: min(map(len, g)))
    return tuple(dict.fromkeys(out))


def _closed(group: str) -> bool:
    """Whether the text from an opening bracket on ends with its closing one."""
    depth, inside, k = 0, False, 0
    while k < len(group):
        c = group[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside, k = True, k + 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        k += 1
    return depth == 0


@dataclass(frozen=True)
class Rx(Cond):
    """A pattern found in the line (``on``: line, trim or lower). Lines without any of its needles are not tried."""

    pattern: str
    fold: bool = False
    on: str = "line"

    def expr(self, c: dict[str, str]) -> str:
        found = f"regexp_like({c[self.on]}, {quote(('(?iUd)' if self.fold else '(?Ud)') + self.pattern)})"
        parts = [f"contains({c['lower' if self.fold else self.on]}, {quote(n)})" for n in needles(self.pattern, self.fold)]
        return f"(({' OR '.join(parts)}) AND {found})" if parts else found

    def sql(self) -> str:
        return f"regexp_matches({_SQL[self.on]}, '{self.pattern.replace(chr(39), chr(39) * 2)}'{', ' + chr(39) + 'i' + chr(39) if self.fold else ''})"


@dataclass(frozen=True)
class Has(Cond):
    part: str
    on: str = "line"

    def expr(self, c: dict[str, str]) -> str:
        return f"contains({c[self.on]}, {quote(self.part)})"

    def sql(self) -> str:
        return f"contains({_SQL[self.on]}, '{self.part.replace(chr(39), chr(39) * 2)}')"


@dataclass(frozen=True)
class Named(Cond):
    """A condition over the file's facts: a key of ``columns`` in ``text_rules``."""

    name: str

    def expr(self, c: dict[str, str]) -> str:
        return c[self.name]

    def sql(self) -> str:
        raise NotImplementedError(self.name)


@dataclass(frozen=True)
class All(Cond):
    parts: tuple[Cond, ...]

    def expr(self, c: dict[str, str]) -> str:
        return "(" + " AND ".join(p.expr(c) for p in self.parts) + ")"

    def sql(self) -> str:
        return "(" + " AND ".join(p.sql() for p in self.parts) + ")"


@dataclass(frozen=True)
class Any(Cond):
    parts: tuple[Cond, ...]

    def expr(self, c: dict[str, str]) -> str:
        return "(" + " OR ".join(p.expr(c) for p in self.parts) + ")"

    def sql(self) -> str:
        return "(" + " OR ".join(p.sql() for p in self.parts) + ")"


@dataclass(frozen=True)
class Not(Cond):
    part: Cond

    def expr(self, c: dict[str, str]) -> str:
        return f"(NOT {self.part.expr(c)})"

    def sql(self) -> str:
        return f"(NOT {self.part.sql()})"


_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SQL = {"line": "line", "trim": f"regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g')", "lower": "lower(line)"}
SQL_LIVE = f"NOT regexp_matches(line, '^{_WS}*#')"
SQL_TRIM = _SQL["trim"]


@dataclass(frozen=True)
class Variant:
    """One kind of finding. ``when`` is None for those that syntax and manifest rules raise."""

    check: str
    cwe: str
    cwe_name: str
    severity: str
    detail: str
    when: Cond | None = None
    confidence: str = "MEDIUM"


@dataclass(frozen=True)
class TextCheck:
    check: str
    groups: tuple[tuple[Variant, ...], ...]
    live: bool = True


def any_of(*parts: Cond) -> Cond:
    return Any(parts)
