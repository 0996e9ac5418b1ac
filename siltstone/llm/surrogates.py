"""Operator 1, PII surrogates: keyed, type-consistent replacements.

*Detection* finds e-mail addresses, telephone numbers, payment cards, IPv4 addresses, national ids
(ddd-dd-dddd), IBANs, secrets (long hexadecimal strings, access keys of known prefixes, and values of token/key/secret/password)
and personal names (after a form of address or a cue such as ``Name:``, or a known given name before a capitalised
word; then each later bare mention in the same text). What no title, cue or listed name tells stays.

*Replacement* is a keyed permutation of the set of strings of the same form: a Feistel network over the
mixed-radix number that a value's letters and digits spell, walked until it falls into the set, puts them in a secret
order, and each goes to the one a secret number of steps on. So two different values of one form never share a surrogate, no
value is its own, and equal values share theirs everywhere, without any table. Letters go to letters of the same script, case and kind (vowel or consonant; other letters within their
Unicode block), digits to digits of their script; punctuation stays. Cards keep their first digit, cards and IBANs how
far their check digits are from the right ones, addresses stay public or private, e-mail hosts are replaced by themselves (one host, one
surrogate) under the same top-level domain, listed given names go to other listed ones of the same gender and script
(no name to itself), others keep their last letter, and a surname alone gets the surname it has beside a given name.

*Collision check.* A surrogate that is itself a real value somewhere in the corpus would merge two people.
All distinct real values are gathered (deduplicated in each task before the shuffle); a surrogate that meets one is replaced by
the first of ``rounds`` further draws that is no real value, nobody's first surrogate, and not also drawn for a value before it in
order: all draws of all such values are looked up in one pass. A form can be too full for that (every address of
192.168.0.0/16, all surnames of two letters): where real values take more than a quarter of it, and for a value all of whose
draws are taken, the first surrogate stays. It is still another value than its own and nobody else's surrogate, but
someone's real value; ``crowded`` lists those forms with their numbers. Listed given names are exchanged among themselves
and take no part. The few exceptions are broadcast if counted to be at most ``broadcast_rows``; beyond that they are
joined to the documents that hold them.

Defined results: null text stays null and has no entities; rows with equal doc_id are treated alike, each on
its own; other columns are carried; an empty table gives an empty result; a value without anything to exchange (``******``)
is counted and stays as it is, since nothing can be told from it. The key never appears in the output.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.tables import stored


@dataclass(frozen=True)
class PiiParams:
    key: bytes  # secret: with it, surrogates can be turned back
    broadcast_rows: int = 100_000
    rounds: int = 16


# Forms of address (with gender) and given names, by gender and script.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Paul Andrew Peter Hans Klaus Jürgen Stefan Pierre Jean Luc Carlos Juan Miguel Mohammed Ahmed Ali Omar Hassan Ibrahim Yusuf Wei Ming Jun Hiroshi Kenji Raj Arjun Sanjay Vikram Kwame Piotr Tomasz Lars Sven Erik Marco Luca Mehmet".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Anna Laura Emma Julia Maria Sabine Ursula Monika Claire Sophie Camille Carmen Lucía Elena Isabel Aisha Fatima Zainab Leila Amina Mei Ling Xiu Yuki Sakura Keiko Priya Ananya Lakshmi Amara Agnieszka Ingrid Astrid Giulia Chiara Ayşe Zeynep".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Дмитрий Алексей Николай Михаил Андрей".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα".split(),
}
#: Words before a name.
CUES = ("Name:", "Author:", "Contact:", "Attn:", "Dear", "Sincerely,", "Regards,", "Signed,", "my name is", "My name is")
#: Sets of letters that are exchanged among themselves.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäöüëï", "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρσφχψ", "0123456789")
_SET = {c: s for s in LETTERS for c in s}
_KNOWN = {n: (g, s) for (g, s), names in GIVEN.items() for n in names}
_HEX = "0123456789abcdef"

_GAP = r"[ .\-*%$&#!|]{0,8}"
_UPPER, _SMALL = ("".join(c for c in map(chr, range(0x41, 0x590)) if unicodedata.category(c) == k) for k in ("Lu", "Ll"))
_WORD = rf"(?:[{_UPPER}][{_SMALL}]+|[{_UPPER}](?=['’]))(?:['’-][{_UPPER}]?[{_SMALL}]+)*"
PATTERNS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])")),
    ("access", re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|ghs|glpat|sk|pk|xox[abprs])[-_][A-Za-z0-9_-]{16,})(?![A-Za-z0-9])")),
    ("quoted", re.compile(r"(?i)(?:token|api_?key|secret|password|passwd|pwd)\s*[=:]\s*(?:[\"'](?P<q>[^\"'\s]{6,})[\"']|(?P<v>(?=[^\s\"']*\d)[^\s\"',;]{8,}))")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("phone", re.compile(rf"(?<![\w.])\+\d{{1,3}}{_GAP}\(?\d{{2,4}}\)?{_GAP}\d{{3,4}}{_GAP}\d{{3,4}}(?!\d)|(?<![\w.])\(\d{{3}}\) ?\d{{3}}[- ]\d{{4}}(?!\d)|(?<![\w.-])\d{{3}}-\d{{3}}-\d{{4}}(?![\d-])")),
    ("card", re.compile(r"(?<![\d.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d])")),
    ("national", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
]
NAMES = re.compile(rf"\b(?:({'|'.join(TITLES)})\.?[ \t]+({_WORD})(?:[ \t]+({_WORD}))?|(?:{'|'.join(CUES)})\s+({_WORD})(?:[ \t]+({_WORD}))?|({'|'.join(sorted(_KNOWN, key=len, reverse=True))})[ \t]+({_WORD}))")
BARE = re.compile(rf"(?<![\w'’-]){_WORD}")


@lru_cache(100_000)
def alphabet(c: str) -> str:
    """The letters that ``c`` is exchanged with: one of LETTERS, or those of its script and category in its Unicode
    block of 256; empty for all else. Alphabets do not overlap."""
    if c in _SET:
        return _SET[c]
    if not c.isalpha() or not _plain(c):
        return ""
    like = (unicodedata.category(c), unicodedata.name(c, "").split(" ")[0])
    block = map(chr, range(ord(c) >> 8 << 8, (ord(c) >> 8) + 1 << 8))
    return "".join(x for x in block if x not in _SET and _plain(x) and (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0]) == like)


def _plain(c: str) -> bool:
    """Whether case goes there and back, letter for letter."""
    return c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c


def ascii_digits(value: str) -> str:
    return value if value.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value)


#: Of the Feistel network, each way; a value passes through it twice.
ROUNDS = 4


class Permuter:
    """Keyed permutations of the integers below a size, without fixed points."""

    def __init__(self, key: bytes):
        self.key = key
        self.steps_on = lru_cache(10_000)(self._steps_on)

    def _steps(self, label: str, size: int, half: int, r: int, b: int) -> int:
        d = hmac.digest(self.key, f"{label}|{size}|{r}|{b}".encode(), "sha256")
        if half > 256:
            d = hashlib.shake_256(d).digest(half // 8 + 1)
        return int.from_bytes(d, "big") & ((1 << half) - 1)

    def place(self, x: int, size: int, label: str, back: bool = False) -> int:
        """The place of ``x`` in the secret order, or what stands at a place."""
        half = max(1, (size - 1).bit_length() + 1) // 2
        while True:  # a power of four at most four times the size: few steps
            a, b = x >> half, x & ((1 << half) - 1)
            for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._steps(label, size, half, r, a), a
                else:
                    a, b = b, a ^ self._steps(label, size, half, r, b)
            x = a << half | b
            if x < size:
                return x

    def permute(self, x: int, size: int, label: str) -> int:
        if size < 2:
            return x
        return self.place((self.place(x, size, label) + self.steps_on(label, size)) % size, size, label, back=True)

    def _steps_on(self, label: str, size: int) -> int:
        return 1 + int.from_bytes(hmac.digest(self.key, f"{label}|{size}|on".encode(), "sha256"), "big") % (size - 1)

    def spell(self, text: str, label: str, sets: Callable[[str], str] = alphabet) -> str:
        """The permuted string of the same form; ``text`` in lower case."""
        used = [sets(c) for c in text]
        n, size = 0, 1
        for c, s in zip(text, used, strict=True):
            if s:
                n, size = n * len(s) + s.index(c), size * len(s)
        form = "".join(f"{len(s)}{s[0]}" if s else c for c, s in zip(text, used, strict=True))
        n = self.permute(n, size, f"{label}|{form}")
        out = []
        for c, s in zip(reversed(text), reversed(used), strict=True):
            if s:
                n, k = divmod(n, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))


def shape(text: str, sets: Callable[[str], str] = alphabet) -> tuple[str, int]:
    """The form that ``spell`` keeps, and how many strings have it."""
    used = [sets(c) for c in text]
    return "".join(f"{len(s)}{s[0]}" if s else c for c, s in zip(text, used, strict=True)), prod(len(s) for s in used if s)


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _private(n: int) -> int:
    """0 for a public address, else the number of leading bits that mark its private range."""
    for net, bits in ((10 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (127 << 24, 8), (169 << 24 | 254 << 16, 16)):
        if n >> (32 - bits) == net >> (32 - bits):
            return bits
    return 0


def normal(kind: str, value: str) -> str:
    """What makes two spellings the same entity: lower case, digits 0-9, and for numbers nothing but them."""
    value = ascii_digits(value)
    if kind in ("phone", "card", "national"):
        return "".join(c for c in value if c.isdecimal())
    if kind == "iban":
        return value.replace(" ", "").lower()
    return value.lower()


class Surrogates:
    def __init__(self, key: bytes):
        self.p = Permuter(key)
        self.draw = lru_cache(100_000)(self._draw)
        self.names: dict[str, str] = {}

    def _draw(self, kind: str, norm: str, rnd: int) -> str:
        """The surrogate of a normal form, in normal form."""
        p, label = self.p, f"{kind}|{rnd}"
        if kind == "email":
            local, host = norm.rsplit("@", 1)
            name, top = host.rsplit(".", 1)
            return f"{p.spell(local, label)}@{p.spell(name, 'host')}.{top}"
        if kind == "card":
            body = norm[0] + p.spell(norm[1:-1], label)
            return body + str((luhn(body) + int(norm[-1]) - luhn(norm[:-1])) % 10)
        if kind == "phone":
            keep = max(0, len(norm) - 10)
            return norm[:keep] + p.spell(norm[keep:], f"{label}|{norm[:keep]}")
        if kind == "iban":
            rest = p.spell(norm[4:], label)
            away = int(norm[2:4]) - int(_iban_check(norm[:2], norm[4:]))
            return f"{norm[:2]}{(int(_iban_check(norm[:2], rest)) + away) % 100:02d}{rest}"
        if kind == "ip":
            n = 0
            for o in norm.split("."):
                n = n << 8 | int(o)
            bits = _private(n)
            low = 32 - bits
            m = n & ((1 << low) - 1)
            while True:  # all of the order is one round, so it comes to another address of the kind before it is back
                m = p.permute(m, 1 << low, f"{label}|{n >> low if bits else ''}")
                out = (n >> low << low if bits else 0) | m
                if _private(out) == bits and out != n:
                    break
            return ".".join(str(out >> s & 255) for s in (24, 16, 8, 0))
        if kind == "access":
            return norm[:4] + p.spell(norm[4:], f"{label}|{norm[:4]}")
        if kind == "secret":
            return p.spell(norm, label, lambda c: _HEX if c in _HEX else "")
        if kind == "given":
            return p.spell(norm[:-1], label) + norm[-1]
        return p.spell(norm, label)

    def form(self, kind: str, norm: str) -> tuple[str, int]:
        """What a value shares with all that it can become, and how many those are."""
        if kind == "email":
            local, host = norm.rsplit("@", 1)
            name, top = host.rsplit(".", 1)
            (a, n), (b, m) = shape(local), shape(name)
            return f"{a}@{b}.{top}", n * m
        if kind == "ip":
            n = 0
            for o in norm.split("."):
                n = n << 8 | int(o)
            bits = _private(n)
            return (f"{n >> (32 - bits)}/{bits}" if bits else "public"), 1 << (32 - bits)
        if kind == "secret":
            return shape(norm, lambda c: _HEX if c in _HEX else "")
        head, tail = {"card": (1, 1), "phone": (max(0, len(norm) - 10), 0), "iban": (4, 0), "access": (4, 0), "given": (0, 1)}.get(kind, (0, 0))
        form, size = shape(norm[head : len(norm) - tail])
        kept = norm[:2] if kind == "iban" else norm[:head]
        return f"{kept}|{form}|{norm[-1] if kind == 'given' else ''}", size

    def listed(self, name: str) -> str:
        """Another given name of the same gender and script: a keyed order of them, moved on by one."""
        if name not in self.names:
            names = GIVEN[_KNOWN[name]]
            order = [names[self.p.permute(i, len(names), "given|" + "|".join(_KNOWN[name]))] for i in range(len(names))]
            self.names |= dict(zip(order, order[1:] + order[:1], strict=True))
        return self.names[name]

    def replaced(self, kind: str, value: str, exceptions: dict[tuple[str, str], int]) -> str:
        if kind == "given" and value in _KNOWN:
            return self.listed(value)
        norm = normal(kind, value)
        new = self.draw(kind, norm, exceptions.get((kind, norm), 0))
        if kind != "ip":
            return _dress(new, value)
        zero = next(c for c in value if c.isdecimal())
        return new if zero.isascii() else new.translate({48 + d: chr(ord(zero) - unicodedata.decimal(zero) + d) for d in range(10)})


def _dress(norm: str, like: str) -> str:
    """A normal form in the spelling of ``like``: its case, its digits' script, and its punctuation where the normal form has none."""

    def one(n: str, c: str) -> str:
        if c.isdecimal() and not c.isascii() and n.isdecimal():
            return chr(ord(c) - unicodedata.decimal(c) + int(n))
        return n.upper() if c.isupper() and len(n.upper()) == 1 else n

    if len(norm) == len(like):
        return "".join(map(one, norm, like))
    it = iter(norm)
    return "".join(one(next(it), c) if c.isalnum() else c for c in like)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order and without overlap; earlier patterns win."""
    out: list[tuple[int, int, str]] = []
    taken: list[bytearray] = []

    def add(a: int, b: int, kind: str) -> None:
        if not taken:
            taken.append(bytearray(len(text)))
        if taken[0].find(1, a, b) < 0:
            taken[0][a:b] = b"\1" * (b - a)
            out.append((a, b, kind))

    if "@" in text or re.search(r"\d", text) or "=" in text or ":" in text:
        for kind, pattern in PATTERNS:
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                a, b = m.span() if kind != "quoted" else m.span("q") if m["q"] else m.span("v")
                if kind != "iban" or any(c.isdigit() for c in text[a + 4 : b]):
                    add(a, b, kind)
    names: dict[str, str] = {}
    for m in NAMES.finditer(text):
        k = next(k for k in (2, 4, 6) if m[k])
        first, last = m[k], m[k + 1]
        kind = "given" if last or first in _KNOWN else "surname"
        add(*m.span(k), kind)
        names.setdefault(first, kind)
        if last:
            add(*m.span(k + 1), "surname")
            names[last] = "surname"
    for m in BARE.finditer(text) if names else ():
        if m[0] in names:
            add(*m.span(), names[m[0]])
    return sorted(out)


def rewrite(text: str, s: Surrogates, exceptions: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    out, at, kinds = [], 0, []
    for a, b, kind in find(text):
        out += [text[at:a], s.replaced(kind, text[a:b], exceptions)]
        at = b
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


REAL = "kind string, norm string, form string, size double, surrogate string"


def real_values(docs: DataFrame, p: PiiParams) -> DataFrame:
    """REAL: every distinct value of the corpus that has a surrogate, its form, how many have that form, and its first surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = Surrogates(p.key), set()
        for b in batches:
            new = set()
            for text in b.column(0).to_pylist():
                for a, e, kind in find(text or ""):
                    if (kind != "given" or text[a:e] not in _KNOWN) and (v := (kind, normal(kind, text[a:e]))) not in seen:
                        new.add(v)
            seen |= new
            if len(seen) > 500_000:
                seen = set()
            rows = [(k, v, form, float(min(size, 1 << 1000)), s.draw(k, v, 0)) for k, v in new for form, size in [s.form(k, v)] if size > 1]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)], ["kind", "norm", "form", "size", "surrogate"])

    return docs.select("text").mapInArrow(run, REAL).dropDuplicates(["kind", "norm"])


def crowded(real: DataFrame) -> DataFrame:
    """(kind, form, n, size): forms of which the corpus has more than a quarter, with their numbers of values."""
    return real.groupBy("kind", "form").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("4 * n > size")


def collisions(docs: DataFrame, p: PiiParams) -> DataFrame:
    """(kind, norm, round): the values whose first surrogate, of round 0, is a real value, and the round that gives one which is not;
    without those for which there is none."""
    real = stored(real_values(docs, p), "entities")
    met = real.join(real.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_semi")
    met = met.join(crowded(real), ["kind", "form"], "left_anti").select("kind", "norm")

    def redraw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(p.key)
        for b in batches:
            rows = [(k, v, r, s.draw(k, v, r)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in range(1, p.rounds + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["kind", "norm", "round", "surrogate"])

    drawn = stored(met.mapInArrow(redraw, "kind string, norm string, round int, surrogate string"), "redrawn")
    free = drawn.join(real.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti").join(real.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
    owned = free.groupBy("kind", "surrogate").agg(F.min(F.struct("norm", "round")).alias("first")).select("kind", "first.norm", "first.round")
    return owned.groupBy("kind", "norm").agg(F.min("round").alias("round"))


RESULTS = ("n_entities", "entity_kinds")


def replace_entities(docs: DataFrame, p: PiiParams) -> DataFrame:
    """``docs`` with ``text`` rewritten, n_entities and entity_kinds (in order of place) added; columns with those names are replaced."""
    spark = docs.sparkSession
    K.small_batches(spark)
    found = stored(collisions(docs.select(F.col("text").cast("string").alias("text")), p), "settled")
    few = found.limit(p.broadcast_rows + 1).collect()  # bounded by the parameter
    known = spark.sparkContext.broadcast({(r.kind, r.norm): r["round"] for r in few} if len(few) <= p.broadcast_rows else {})
    own = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in own])
    if len(few) > p.broadcast_rows:
        rows = _with_exceptions(rows, found)
    schema = rows.drop("__own").schema.add("n_entities", "long").add("entity_kinds", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(p.key)
        for b in batches:
            names = b.schema.names
            extra = b.column(names.index("__own")).to_pylist() if "__own" in names else [None] * b.num_rows
            texts, counts, kinds = [], [], []
            for text, mine in zip(b.column(names.index("text")).to_pylist(), extra, strict=True):
                if text is None:
                    new, k = None, []
                else:
                    new, k = rewrite(text, s, known.value if mine is None else {(x["kind"], x["norm"]): x["round"] for x in mine})
                texts.append(new)
                counts.append(len(k))
                kinds.append(",".join(k))
            kept = [n for n in names if n != "__own"]
            cols = [pa.array(texts, b.schema.field(n).type) if n == "text" else b.column(names.index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*kept, *RESULTS])

    return rows.mapInArrow(run, schema)


def _with_exceptions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Many exceptions: each document gets its own, by a join on its values and one on its text."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(h, k, normal(k, t[a:e])) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a, e, k in find(t or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["h", "kind", "norm"])

    h = F.xxhash64("text")
    each = rows.select(h.alias("h"), "text").mapInArrow(values, "h long, kind string, norm string").distinct()
    own = each.join(found, ["kind", "norm"]).groupBy("h").agg(F.collect_list(F.struct("kind", "norm", "round")).alias("__own"))
    empty = F.array().cast("array<struct<kind:string,norm:string,round:int>>")
    return rows.withColumn("h", h).join(own, "h", "left").drop("h").withColumn("__own", F.coalesce("__own", empty))
