"""How reports look: head, entries and tail of the three kinds of document."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Callable
from dataclasses import dataclass

from siltstone import schema
from siltstone.plans.registry import VARIANTS

RESET = "\x1b[0m"
# Terminal colours of the severities.
COLOURS = {"CRITICAL": "\x1b[1;31m", "HIGH": "\x1b[31m", "MEDIUM": "\x1b[33m", "LOW": "\x1b[34m", "INFO": "\x1b[37m"}
HINT = "A finding that is no risk can be silenced by '# nosec [CWE-ID]' on its line; what is there already, by --write-baseline and --baseline."

Counts = dict[str, dict[str, int]]
Counters = dict[str, int]


@dataclass(frozen=True)
class Form:
    """``head`` and ``tail`` are given the number of entries, their counts by severity and confidence, and the run's counters."""

    head: Callable[[int, Counts, Counters], str]
    entry: Callable[[dict], str]
    between: str
    tail: Callable[[int, Counts, Counters], str]


def _nested(value: object) -> str:
    return textwrap.indent(json.dumps(value, indent=2, ensure_ascii=False), "    ")


def _json_tail(n: int, counts: Counts, counters: Counters) -> str:
    more = {"count": n} | {k: v for k, v in counters.items() if v}
    if n and not counters.get("baseline_suppressed") and not counters.get("nosec_suppressed"):
        more["suppression_hint"] = HINT
    return ("\n  ]" if n else "]") + ",\n" + json.dumps(more, indent=2, ensure_ascii=False)[2:]


def _list_head(name: str) -> Callable[[int, Counts, Counters], str]:
    return lambda n, counts, counters: f'{{\n  "{name}": [' + ("\n" if n else "")


def _reference() -> list[str]:
    """The ids that the checks cover, with the names of their findings."""
    names: dict[str, str] = {}
    for v in VARIANTS:
        names.setdefault(v.cwe, v.cwe_name)
    return ["Covered ids", *(f"{k:<9} {names[k]}" for k in sorted(names, key=lambda x: int(x[4:])))]


def _notes(counters: Counters) -> list[str]:
    texts = {"baseline_suppressed": "finding(s) that the baseline has already", "nosec_suppressed": "finding(s) silenced by # nosec", "test_suppressed": "finding(s) in test code left out, see --include-tests"}
    return [f"  ({counters[k]} {t})" for k, t in texts.items() if counters.get(k)]


_BAR, _LINE = "=" * 72, "─" * 72


def _text_head(n: int, counts: Counts, counters: Counters) -> str:
    result = f"{n} finding(s)" if n else "all checks passed, 0 findings"
    return "\n".join(["", f"  {_BAR}", f"  RESULT: {result}", *_notes(counters), f"  {_BAR}", *([""] if n else []), ""])


def _text_entry(r: dict) -> str:
    out = [f"  {COLOURS[r['severity']]}[{r['severity']}/{r['confidence']}]{RESET} {r['cwe_id']} — {r['cwe_name']}", f"  File:    {r['file']}:{r['line']}"]
    out += [f"  Package: {r['package']}"] if r["package"] else []
    out += [f"  Code:    {r['code']}", f"  Detail:  {r['description']}"]
    out += [f"  ZeroDay: {r['zero_day_relevance']}"] if r["zero_day_relevance"] else []
    return "\n".join([*out, "", ""])


def _text_tail(n: int, counts: Counts, counters: Counters) -> str:
    if not n:
        return ""
    out = []
    for labels, column, suffix in ((schema.SEVERITIES, "severity", ""), (schema.CONFIDENCES, "confidence", " confidence")):
        out.append(f"  {_LINE}")
        for label in labels:
            if k := counts[column].get(label):
                colour = COLOURS[label] if column == "severity" else ""
                out.append(f"  {colour}{k:>4} × {label}{suffix}{RESET if colour else ''}")
    out += [f"  {_LINE}", ""]
    if not counters.get("baseline_suppressed") and not counters.get("nosec_suppressed"):
        out += [f"  {HINT}", ""]
    return "\n".join(out + _reference())


FORMS = {
    "json": Form(_list_head("findings"), lambda r: _nested({c: r[c] for c in schema.PUBLIC}), ",\n", _json_tail),
    "text": Form(_text_head, _text_entry, "", _text_tail),
    "baseline": Form(_list_head("fingerprints"), lambda r: _nested([r["cwe_id"], r["file"], r["code"]]), ",\n", lambda n, counts, counters: ("\n  ]" if n else "]") + "\n}\n"),
}
