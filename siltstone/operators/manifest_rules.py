"""The two checks of dependency manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.rules import Variant, quote

# Manifest and lock file names; dependencies, the version that mends them, and the advisory.
MANIFESTS = ("pyproject.toml", "requirements.txt", "setup.py", "Pipfile")
PIN_MANIFESTS = ("pyproject.toml", "requirements.txt", "Pipfile")
LOCKFILES = ("uv.lock", "poetry.lock", "Pipfile.lock")
VULNERABLE = (
    ("urllib3", "1.26.19", "CVE-2024-37891"),
    ("requests", "2.32.0", "CVE-2024-35195"),
    ("cryptography", "42.0.0", "CVE-2024-26131"),
    ("jinja2", "3.1.5", "CVE-2025-27516"),
    ("werkzeug", "3.0.6", "CVE-2024-49766"),
    ("dask", "2024.8.1", "CVE-2024-45187"),
    ("pyarrow", "15.0.2", "CVE-2024-39135"),
    ("pandas", "2.2.1", "CVE-2024-42992"),
    ("aiohttp", "3.10.11", "CVE-2024-52304"),
    ("fsspec", "2024.10.0", "CVE-2024-40332"),
)
VERSION = r"(?:>=|==|~=|!=|<|>)\s*(\d+\.\d+\.\d+)"
LOWER_BOUND = r"[\"']([\w.-]+)\s*>=\s*(\d+\.\d+(?:\.\d+)?)[\"']"

CVE = Variant("check_dependency_cve", "CWE-1104", "Supply Chain — Dependency with Known Vulnerability", "HIGH", "The version allowed here has a known hole.", None, "HIGH")
PIN = Variant("check_unbounded_pins", "CWE-1104", "Supply Chain — Unbounded Dependency Pin", "LOW", "Any later release satisfies this; set an upper bound.")
PIN_LOCKED = Variant("check_unbounded_pins", "CWE-1104", "Supply Chain — Unbounded Dependency Pin", "INFO", "The lock file decides now; the next upgrade has no bound.")


def version(text: str) -> str:
    """Expression: (a, b, c) of a version's text, which compares in order; null where a part is missing or over 32 bits."""
    parts = [f"try_cast(try_element_at(split({text}, {quote(chr(92) + '.')}), {k}) AS BIGINT)" for k in (1, 2, 3)]
    return f"CASE WHEN {' AND '.join(f'{p} <= 4294967295' for p in parts)} THEN named_struct('a', {parts[0]}, 'b', {parts[1]}, 'c', {parts[2]}) END"


def names(dependency: str) -> str:
    """A lower-case line that names the dependency."""
    return rf"(?:\A|[\"'=,\s]){re.escape(dependency)}(?:[\"':,<>=!\s]|\z)"


def vulnerable_lines() -> Column:
    """array<struct<ord, line, detail>>: for each dependency, its first line (of the column ``rows``) with too low a
    version. No join: the table is in the plan."""
    found = f"regexp_extract(x.line, {quote('(?Ud)' + VERSION)}, 1)"
    lines = f"filter(transform(rows, x -> named_struct('no', x.no, 'lower', x.lower, 'v', {version(found)})), x -> x.v IS NOT NULL)"
    out = []
    for k, (dep, fixed, cve) in enumerate(VULNERABLE):
        a, b, c = fixed.split(".")
        low = f"contains(x.lower, {quote(dep)}) AND regexp_like(x.lower, {quote('(?Ud)' + names(dep))}) AND x.v < named_struct('a', {a}L, 'b', {b}L, 'c', {c}L)"
        out.append(f"transform(slice(filter(lines, x -> {low}), 1, 1), x -> named_struct('ord', {k}, 'line', x.no, 'detail', {quote(f'{dep} <{fixed}: {cve}')}))")
    return F.expr(f"flatten(transform(array({lines}), lines -> concat({', '.join(out)})))")


def unbounded(line: Column) -> Column:
    """A quoted lower bound alone; python's own does not count."""
    t = T.trim(line)
    dep = F.regexp_extract(t, "(?Ud)" + LOWER_BOUND, 1)
    return T.live(line) & (dep != "") & ~dep.isin("python", "requires-python") & ~t.contains("<")


def bound(line: Column) -> Column:
    """The dependency and its lower bound."""
    t = T.trim(line)
    return F.concat(F.regexp_extract(t, "(?Ud)" + LOWER_BOUND, 1), F.lit(">="), F.regexp_extract(t, "(?Ud)" + LOWER_BOUND, 2))
