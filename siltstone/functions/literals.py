"""Lines that may matter, found before any line is cut.

``required(cond)`` works out a set of literal texts of which a line must hold one for the condition to hold: the exact strings that the
parts of a pattern can spell, put together as far as they stay few. ``Index`` looks for all literals of all conditions in
one pass over the bytes of a batch: each literal is known by one of its three-byte blocks, a table tells the places
where a known block stands, and only those are compared (the block-hash scheme for many literals). ``candidates`` gives
the lines that hold one, with their numbers; a text without any never gets an array of lines.

Literals of patterns that ignore case are compared with A-Z folded. The four letters beyond ASCII that fold to ASCII ones
(long s, the Kelvin sign, dotted and dotless i) are literals of their own, so their lines are always looked at.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.operators import rules as R

LINES = "array<struct<no:int,line:string>>"
#: Strings put together at most, and members of a class that count as alternatives.
MOST, MEMBERS = 48, 10
EXOTIC = ("ſ", "K", "İ", "ı")


@dataclass(frozen=True)
class Literal:
    text: str
    fold: bool = False


Strings = frozenset[str]


def _short(s: Strings) -> int:
    """Bytes of the shortest member."""
    return min(len(x.encode()) for x in s)


def _better(a: Strings | None, b: Strings | None) -> Strings | None:
    """The set that tells more: longer shortest member, then fewer members. An empty member tells nothing."""
    return max((s for s in (a, b) if s and _short(s) > 1), key=lambda s: (min(_short(s), 4), -len(s), _short(s)), default=None)


def _spelled(items: Iterable) -> tuple[Strings | None, Strings | None]:
    """Of a parsed pattern: all it can spell, if that is a small set, and the best set of which any match holds one."""
    run: Strings = frozenset(("",))
    best: Strings | None = None
    whole = True

    def cut() -> None:
        nonlocal run, best, whole
        best, run, whole = _better(best, run), frozenset(("",)), False

    for kind, arg in items:
        exact, inner = None, None
        if kind is op.LITERAL:
            exact = frozenset((chr(arg),))
        elif kind is op.IN and len(arg) <= MEMBERS and all(k is op.LITERAL for k, _ in arg):
            exact = frozenset(chr(a) for _, a in arg)
        elif kind is op.SUBPATTERN:
            exact, inner = _spelled(arg[3])
        elif kind is op.BRANCH:
            parts = [_spelled(p) for p in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = frozenset().union(*[e for e, _ in parts])
            some = [b if b is not None else e for e, b in parts]
            inner = frozenset().union(*some) if all(s and _short(s) > 1 for s in some) else None
        elif kind in (op.AT, op.ASSERT_NOT):
            continue
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, sub = arg
            exact, inner = _spelled(sub)
            if low and (high > 1 or low > 1):
                # spelled once at least: it ends what stands before, and what follows starts anew
                if exact is not None and len(run) * len(exact) <= MOST:
                    run = frozenset(a + b for a in run for b in exact)
                best = _better(best, inner)
                cut()
                continue
            if not low:
                exact, inner = (exact | {""}, None) if exact is not None and high == 1 else (None, None)
        best = _better(best, inner)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a in run for b in exact)
        else:
            cut()
            if exact is not None and len(exact) <= MOST:
                run = exact
    return run if whole else None, _better(best, run)


def required(cond: R.Cond) -> frozenset[Literal] | None:
    """Literals of which a line that meets ``cond`` holds one; None if nothing can be said. Conditions over facts count
    as met by no line: lines that facts name are looked at anyway."""
    if isinstance(cond, R.Rx):
        exact, best = _spelled(parser.parse(cond.pattern))
        found = _better(best, exact)
        fold = cond.fold or cond.on == "lower"
        return None if found is None else frozenset(Literal(s.lower() if fold else s, fold) for s in found)
    if isinstance(cond, R.Has):
        return frozenset((Literal(cond.part, cond.on == "lower"),))
    if isinstance(cond, R.Named):
        return frozenset()
    if isinstance(cond, R.Any):
        parts = [required(p) for p in cond.parts]
        return None if any(p is None for p in parts) else frozenset().union(*parts)
    if isinstance(cond, R.All):
        parts = [p for c in cond.parts if not isinstance(c, R.Not) and (p := required(c)) is not None]
        return max(parts, key=lambda s: (not s, min((min(len(x.text.encode()), 4) for x in s), default=0), -len(s)), default=None)
    return None


def least(literals: Iterable[Literal]) -> tuple[Literal, ...]:
    """Without those that hold another one."""
    every = set(literals)
    if any(x.fold for x in every):
        every |= {Literal(x) for x in EXOTIC}
    inside = lambda a, b: a is not b and (a.text in b.text.lower() if a.fold else (not b.fold and a.text in b.text)) and (a.text, a.fold) != (b.text, b.fold)
    return tuple(sorted((b for b in every if not any(inside(a, b) for a in every)), key=lambda x: (x.fold, x.text)))


# Five bits a byte: letters by themselves, case apart; the signs that are frequent in code; the rest shares what is left.
_CLASS = np.zeros(256, np.uint32)
for _k in range(256):
    _CLASS[_k] = _k & 31 if chr(_k).isascii() and chr(_k).isalpha() else 27 + (("._(=\\".index(chr(_k))) if chr(_k) in "._(=\\" else 0) if _k < 128 else 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: How telling a letter is in a block; all else tells more.
_RARE = {c: k / 26 for k, c in enumerate("etaoinshrdlucmfwypvbgkqjxz")}
BLOCK = 1 << 18


class Index:
    """All literals of a plan."""

    def __init__(self, literals: tuple[Literal, ...]):
        self.known = np.zeros(1 << 15, bool)
        self.by_block: dict[int, list[tuple[np.ndarray, int, bool]]] = {}
        for x in literals:
            raw = np.frombuffer(x.text.encode(), np.uint8)
            padded = [int(c) for c in _CLASS[raw]]
            if len(padded) > 2:
                worth = lambda k: sum(_RARE.get(chr(c).lower(), 2.0) for c in raw[k : k + 3])  # noqa: B023, E731
                at = max(range(len(raw) - 2), key=worth)
                blocks = [padded[at] << 10 | padded[at + 1] << 5 | padded[at + 2]]
            else:  # any third byte
                at, blocks = 0, [padded[0] << 10 | padded[1] << 5 | k for k in range(32)]
            for b in blocks:
                self.known[b] = True
                self.by_block.setdefault(b, []).append((raw, at, x.fold))
        self.longest = max((len(x.text.encode()) for x in literals), default=1)

    def find(self, buf: np.ndarray) -> np.ndarray:
        """The places where a literal begins, in order."""
        out, n = [], len(buf)
        for low in range(0, n, BLOCK):
            # a block's literals may begin before it and end after it
            a, b = max(0, low - self.longest), min(n, low + BLOCK + self.longest)
            part = np.concatenate([buf[a:b], np.zeros(2, np.uint8)])
            c = _CLASS[part]
            key = c[:-2] << 10 | c[1:-1] << 5 | c[2:]
            at = np.flatnonzero(self.known[key])
            keys = key[at]
            order = np.argsort(keys, kind="stable")
            own, start = np.unique(keys[order], return_index=True)
            for k, group in zip(own.tolist(), np.split(at[order], start[1:]), strict=True) if len(at) else ():
                for raw, off, fold in self.by_block[k]:
                    first = group - off
                    first = first[(first >= 0) & (first + len(raw) <= b - a)]
                    held = part[first[:, None] + np.arange(len(raw))]
                    first = first[((_LOWER[held] if fold else held) == raw).all(axis=1)]
                    out.append(first[(first >= low - a) & (first < low - a + BLOCK)] + a)
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _bytes(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    column = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = data.to_pybytes()[off[0] : off[-1]] if data is not None else b""
    return raw, np.frombuffer(raw, np.uint8), off - off[0]


def lines_with(index: Index, texts: pa.Array, whole: np.ndarray) -> pa.Array:
    """For each text its lines that hold a literal, or all (``whole``), as (no, line); the line model of ``text``."""
    raw, buf, off = _bytes(texts)
    ends = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], ends + 1]))
    starts = starts[starts < len(buf)]
    row = np.searchsorted(off, starts, "right") - 1
    first = np.searchsorted(starts, off[:-1])  # of each row
    wanted = np.zeros(len(starts), bool)
    wanted[np.searchsorted(starts, index.find(buf), "right") - 1] = True
    wanted |= whole[row]
    at = np.flatnonzero(wanted)
    stop = np.minimum(np.append(starts, len(buf))[at + 1], off[row[at] + 1])
    lines = []
    for a, b in zip(starts[at].tolist(), stop.tolist(), strict=True):
        x = raw[a:b]
        lines.append((x[:-2] if x.endswith(b"\r\n") else x[:-1] if x.endswith(b"\n") else x).decode())
    sizes = np.bincount(row[at], minlength=len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array((at - first[row[at]] + 1).astype(np.int32)), pa.array(lines, pa.string())], ["no", "line"])
    return pa.ListArray.from_arrays(pa.array(offsets), struct)


def candidates(literals: tuple[Literal, ...], text: Column, whole: Column) -> Column:
    """LINES of ``text``: those that hold a literal, or all where ``whole``."""
    index = Index(literals)

    def found(texts: pa.Array, every: pa.Array) -> pa.Array:
        return lines_with(index, texts, every.fill_null(False).to_numpy(zero_copy_only=False))

    return F.arrow_udf(found, LINES)(text, F.coalesce(whole, F.lit(False)))


def holds(literals: tuple[Literal, ...], text: Column) -> Column:
    """Whether a text holds one of a few literals, without leaving the JVM."""
    return reduce(lambda a, b: a | b, [(F.lower(text) if x.fold else text).contains(x.text) for x in literals])
