"""Files to findings, as one plan.

A row is a file all the way: its lines, its syntax facts and the hits of every asked-for check are arrays of that
row, and one explode at the end makes findings of the hits. So the source is read once, a file is parsed once
(and not at all where no check asks for its syntax), lines are never copied into rows of their own, and nothing shuffles.

Line rules only see lines that hold one of the literals they need (``functions.literals``): one pass over the text finds
them, and a text without any is never cut into lines.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import literals as L
from siltstone.functions import text as T
from siltstone.functions.fact_store import with_facts
from siltstone.functions.facts import facts
from siltstone.operators import advisories as A
from siltstone.operators import manifest_rules as M
from siltstone.operators import rules as R
from siltstone.operators.ast_rules import AST_CHECKS
from siltstone.operators.relevance import RELEVANCE
from siltstone.operators.text_rules import CHAIN, CHAIN_LINES, DECODE, EXECUTE, PTH_FILE, TEXT_CHECKS, WEAK_TLS
from siltstone.plans.registry import ORDER, VARIANTS, number

_FACT_CHECKS = frozenset(("check_sql_injection", "check_xxe", "check_ssrf", "check_exec_driver_sql"))
_INSIDE = {"sql_safe": "sql_safe", "driver_safe": "driver_safe", "ssrf_safe": "ssrf_safe", "session_line": "session_lines", "session_safe": "session_safe"}
_FILE = ("path_key", "file", "package")
HIT = "array<struct<part:int,at:int,emit:int,line:int,variant:int,code:string,extra:string,source:string>>"


def _firing(checks: set[str]) -> Column:
    """array<struct<row, hits: array<struct<variant, emit>>>>: what fires on each line."""
    c = {k: f"x.{k}" for k in ("line", "trim", "lower", "live")} | {"is_pth": "(ext = 'pth')"}
    c |= {k: f"coalesce(array_contains(facts.{n}, x.no), false)" for k, n in _INSIDE.items()}
    name = f"concat({R.quote(r'(?Ud)\b')}, replace(facts.lxml, '.', {R.quote(r'\.')}), {R.quote(r'\.')})"
    c["lxml_line"] = f"coalesce(contains(x.line, facts.lxml) AND regexp_like(x.line, {name}), false)"
    out = []
    for check in TEXT_CHECKS:
        for emit, group in enumerate(check.groups if check.check in checks else ()):
            first = "CASE " + " ".join(f"WHEN {v.when.expr(c)} THEN {number(v)}" for v in group) + " END"
            out.append(f"named_struct('variant', {f'CASE WHEN x.live THEN {first} END' if check.live else first}, 'emit', {emit})")
    return F.expr(f"transform(rows, x -> named_struct('row', x, 'hits', filter(array({', '.join(out)}), h -> h.variant IS NOT NULL)))")


def _hit(part: Column, at: Column, emit: Column, line: Column, variant: Column, code: Column, source: Column, extra: Column | None = None) -> Column:
    whole = {"part": part, "at": at, "emit": emit, "line": line, "variant": variant}
    return F.struct(*[v.cast("int").alias(k) for k, v in whole.items()], code.alias("code"), (F.lit(None) if extra is None else extra).cast("string").alias("extra"), source.alias("source"))


#: Up to so many literals are looked for one by one in the JVM; more, in one pass over the bytes in Python.
FEW = 12


def _numbered(lines: Column) -> Column:
    """L.LINES with what the rules look at, worked out once."""
    return F.transform(lines, lambda x: F.struct(x["no"].alias("no"), x["line"].alias("line"), T.trim(x["line"]).alias("trim"), F.lower(x["line"]).alias("lower"), T.live(x["line"]).alias("live")))


def _literals(checks: set[str]) -> tuple[L.Literal, ...] | None:
    """What any line that a line rule of ``checks`` fires on holds one of; None if a rule asks for nothing that can be named."""
    conditions = [v.when for c in TEXT_CHECKS if c.check in checks for g in c.groups for v in g]
    if "check_decode_exec_chains" in checks:
        conditions += [R.Rx(DECODE), R.Rx(EXECUTE)]
    found = [L.required(c) for c in conditions]
    return None if any(f is None for f in found) else L.least(frozenset().union(*found))


def _all_lines() -> Column:
    return F.transform(T.split_lines(F.col("text")), lambda x, i: F.struct((i + 1).cast("int").alias("no"), x.alias("line")))


def _rows(checks: set[str]) -> Column:
    """The lines that the rules have to look at: all of manifests, of ``.pth`` files and of files whose facts name lines or an
    alias of lxml; else those with a literal."""
    no: list[Column] = []
    if "check_pth_startup_hooks" in checks:
        no.append(F.col("ext") == "pth")
    if checks & {"check_dependency_cve", "check_unbounded_pins"}:
        no.append(F.col("name").isin(*M.MANIFESTS))
    whole = reduce(lambda a, b: a | b, no, F.lit(False))
    known = _literals(checks)
    named = (F.size("facts.session_lines") > 0) | F.col("facts.lxml").isNotNull() if checks & {"check_ssrf", "check_xxe"} else F.lit(False)
    if known is None:
        return _all_lines()
    if len(known) > FEW:
        return F.when(named, _all_lines()).otherwise(L.candidates(known, F.col("text"), whole))
    none = F.array().cast(L.LINES)
    if not known:
        return F.when(whole | named, _all_lines()).otherwise(none)
    few = F.when(L.holds(known, F.col("text")), F.filter(_all_lines(), lambda x: L.holds(known, x["line"]))).otherwise(none)
    return F.when(whole | named, _all_lines()).otherwise(few)


def _source(line: Column) -> Column:
    """A line that an event names."""
    return F.try_element_at("lines", line.cast("int"))


def _row(no: Column) -> Column:
    """One of ``rows`` by its number."""
    return F.element_at(F.filter("rows", lambda x: x["no"] == no), 1)


def _line_rules(checks: set[str]) -> Column:
    trojan = [number(v) for k in TEXT_CHECKS if k.check == "check_trojan_source" for g in k.groups for v in g]
    weak = [number(v) for k in TEXT_CHECKS if k.check == "check_weak_tls_version" for g in k.groups for v in g]

    def of(f: Column) -> Column:
        x = f["row"]

        def one(h: Column) -> Column:
            code = F.when(h["variant"].isin(trojan), T.quoted(x["line"])).otherwise(x["trim"])
            extra = F.when(h["variant"].isin(weak), F.regexp_extract(x["line"], "(?Ud)" + WEAK_TLS, 0))
            return _hit(F.lit(1), x["no"], h["emit"], x["no"], h["variant"], code, x["line"], extra)

        return F.transform(f["hits"], one)

    return F.flatten(F.transform(F.filter(_firing(checks), lambda f: F.size(f["hits"]) > 0), of))


def _event_rules(checks: set[str]) -> Column:
    wanted = [(c, vs) for c, vs in AST_CHECKS if c in checks]
    risky = [number(v) for c, vs in AST_CHECKS if c == "check_insecure_default" for v, _ in vs]
    chains = [number(v) for c, vs in AST_CHECKS if c == "check_decode_exec_chains" for v, _ in vs]

    def of(e: Column, pos: Column) -> Column:
        fired = [F.coalesce(*[F.when(test(e), F.lit(number(v))) for v, test in vs]) for _, vs in wanted]

        def one(v: Column) -> Column:
            line = F.when(v.isin(risky), F.coalesce(e["at"], e["line"])).otherwise(e["line"])
            field = F.when(e["kind"] == "field", F.concat(e["name"], F.lit(": "), e["inner"]))
            return _hit(F.when(v.isin(chains), 2).otherwise(0), F.when(v.isin(risky), line).otherwise(pos), pos, line, v, F.coalesce(T.trim(_source(line)), F.lit("")), _source(line), field)

        return F.transform(F.array_compact(F.array(*fired)), one)

    return F.flatten(F.transform("facts.events", of))


def _chains() -> Column:
    """Runs over a file's lines with the decode lines in reach that still wait; an exec takes the nearest."""
    decode, execute = (lambda x, p=p, n=R.needles(p): reduce(lambda a, b: a | b, [x["trim"].contains(k) for k in n]) & T.hit(x["trim"], p) for p in (DECODE, EXECUTE))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        no = x["no"]
        reach = F.filter(acc["open"], lambda d: no - d <= CHAIN_LINES)
        waiting = F.when(x["live"] & decode(x), F.concat(reach, F.array(no))).otherwise(reach)
        near = F.when(x["live"] & execute(x), F.array_max(waiting))
        left = F.when(near.isNull(), waiting).otherwise(F.array_remove(waiting, near))
        out = F.when(near.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(near.alias("a"), no.alias("b")))))
        return F.struct(left.alias("open"), out.alias("out"))

    pairs = F.aggregate("rows", start, step, lambda acc: acc["out"])
    text = lambda c: F.concat(F.lit("decode at line "), c["a"].cast("string"), F.lit(", exec at line "), c["b"].cast("string"))
    hits = F.transform(pairs, lambda c: _hit(F.lit(1), c["b"], F.lit(0), c["b"], F.lit(number(CHAIN)), text(c), _row(c["b"])["line"]))
    return F.when(F.exists("rows", lambda x: decode(x)), hits)


def _pth() -> Column:
    code = F.slice(F.filter("rows", lambda x: (x["trim"] != "") & ~x["trim"].startswith("#")), 1, 1)
    return F.when(F.col("ext") == "pth", F.transform(code, lambda x: _hit(F.lit(1), x["no"], F.lit(0), x["no"], F.lit(number(PTH_FILE)), x["trim"], x["line"])))


def _cve() -> Column:
    found = F.transform(M.vulnerable_lines(), lambda x: _hit(F.lit(1), x["ord"], F.lit(0), x["line"], F.lit(number(M.CVE)), _row(x["line"])["trim"], _row(x["line"])["line"], x["detail"]))
    return F.when(F.col("name").isin(*M.MANIFESTS), found)


def _pins() -> Column:
    variant = F.when(F.coalesce("locked", F.lit(False)), number(M.PIN_LOCKED)).otherwise(number(M.PIN))
    loose = F.filter("rows", lambda x: M.unbounded(x["line"]))
    return F.when(F.col("name").isin(*M.PIN_MANIFESTS), F.transform(loose, lambda x: _hit(F.lit(1), x["no"], F.lit(0), x["no"], variant, x["trim"], x["line"], M.bound(x["line"]))))


def _variants(df: DataFrame) -> DataFrame:
    """The fixed table of variants, one row each: small by its definition, so it is broadcast."""
    rank = {c: k for k, c in enumerate(ORDER)}
    rows = [(k, v.check, rank[v.check], v.cwe, v.cwe_name, v.severity, v.confidence, v.detail, RELEVANCE.get(v.check, "")) for k, v in enumerate(VARIANTS)]
    return df.sparkSession.createDataFrame(rows, "variant int, check_id string, check_ord int, cwe_id string, cwe_name string, severity string, confidence string, detail string, zero_day_relevance string")


def _advised(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Hits of the caller's table of advisories."""
    v = A.vulnerable(files, advisories)
    hit = _hit(F.lit(1), F.col("ord"), F.lit(0), F.col("no"), F.lit(number(M.CVE)), F.col("code"), F.col("line"), F.col("detail"))
    return v.select(*_FILE, hit.alias("hit")).select(*_FILE, "hit.*")


def _with_variant(advised: DataFrame) -> DataFrame:
    """They are all of one variant, whose columns need no join."""
    cve = {"check_id": M.CVE.check, "check_ord": ORDER.index(M.CVE.check), "cwe_id": M.CVE.cwe, "cwe_name": M.CVE.cwe_name, "severity": M.CVE.severity, "confidence": M.CVE.confidence, "detail": M.CVE.detail, "zero_day_relevance": RELEVANCE.get(M.CVE.check, "")}
    return advised.withColumns({k: F.lit(v) for k, v in cve.items()})


def scan(files: DataFrame, checks: list[str] | None = None, advisories: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """Findings of ``files`` (see ``schema.FILES``): the public columns, the order columns, ranks, and ``source``, the finding's line.

    ``advisories`` and ``store``: see ``hits``."""
    found = hits(files, checks, advisories, store)
    description = F.when(F.col("extra").isNull(), F.col("detail")).otherwise(F.concat_ws(" — ", "extra", "detail"))
    return found.select("cwe_id", "cwe_name", "severity", "confidence", "package", "file", "line", "code", description.alias("description"), "zero_day_relevance", "check_id", "path_key", "check_ord", "part", "at", "emit", "source", rank("severity", schema.SEVERITIES).alias("sev_rank"), rank("confidence", schema.CONFIDENCES).alias("conf_rank"))


def hits(files: DataFrame, checks: list[str] | None = None, advisories: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """Findings before they are described: ``extra`` is what a finding names of its own, ``detail`` what its variant says.

    ``advisories`` (see ``operators.advisories``) replaces the built-in table of vulnerable dependencies, which is part of the plan;
    ``store`` names a folder of facts by content (see ``functions.fact_store``)."""
    wanted = set(ORDER if checks is None else checks)
    if unknown := wanted - set(ORDER):
        raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}")
    advised = None
    if advisories is not None and "check_dependency_cve" in wanted:
        wanted, advised = wanted - {"check_dependency_cve"}, _advised(files, advisories)
    parts = []
    if wanted & {c.check for c in TEXT_CHECKS}:
        parts.append(_line_rules(wanted))
    if wanted & {c for c, _ in AST_CHECKS}:
        parts.append(_event_rules(wanted))
    for check, rule in (("check_decode_exec_chains", _chains), ("check_pth_startup_hooks", _pth), ("check_dependency_cve", _cve), ("check_unbounded_pins", _pins)):
        if check in wanted:
            parts.append(rule())
    f = files
    if wanted & (_FACT_CHECKS | {c for c, _ in AST_CHECKS}):
        f = with_facts(f, store) if store else f.withColumn("facts", facts(F.col("text"), F.col("ext")))
        f = f.withColumn("lines", F.when(F.size("facts.events") > 0, T.split_lines(F.col("text"))))
    f = f.withColumn("rows", _rows(wanted)).withColumn("rows", _numbered(F.col("rows")))
    none = F.array().cast(HIT)
    found = f.select(*_FILE, F.explode(F.concat(*[F.coalesce(x, none) for x in parts], none)).alias("hit")).select(*_FILE, "hit.*")
    if advised is not None and not parts:
        return _with_variant(advised)
    found = found.join(F.broadcast(_variants(files)), "variant")
    return found if advised is None else found.unionByName(_with_variant(advised))


def rank(column: str, labels: tuple[str, ...]) -> Column:
    return (F.array_position(F.array(*map(F.lit, labels)), F.col(column)) - 1).cast("int")


def public(findings: DataFrame) -> DataFrame:
    return findings.select(*schema.PUBLIC)


def described() -> list[dict]:
    """The variants as plain rows."""
    return [{k: v for k, v in asdict(x).items() if k != "when"} for x in VARIANTS]
