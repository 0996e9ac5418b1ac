"""Registered queries of the engine: every check, and every step after detection, over the synthetic tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import fact_store
from siltstone.functions.text import BIDI
from siltstone.operators import post
from siltstone.operators.ast_rules import AST_CHECKS
from siltstone.operators.rules import SQL_LIVE, SQL_TRIM, Named, TextCheck
from siltstone.operators.text_rules import TEXT_CHECKS
from siltstone.plans import baselines, corpus, pipeline, report
from siltstone.plans.registry import ORDER
from siltstone.plans.scan import hits, scan
from siltstone.sources import listing

Query = Callable[[SparkSession, str], DataFrame]
COLUMNS = ("file", "line", "cwe_id", "severity", "confidence", "code")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


def _check(name: str) -> Query:
    return lambda spark, d: scan(tree(spark, d), [name]).select(*COLUMNS)


def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return scan(tree(spark, d)).select("package", "check_id", *COLUMNS)


def suppress_nosec(spark: SparkSession, d: str) -> DataFrame:
    return scan(tree(spark, d)).where(~post.suppressed()).select("check_id", *COLUMNS)


def filter_confidence(spark: SparkSession, d: str) -> DataFrame:
    return scan(tree(spark, d)).where(post.confident("MEDIUM")).select("check_id", *COLUMNS)


def suppress_test_paths(spark: SparkSession, d: str) -> DataFrame:
    return scan(tree(spark, d)).where(~post.quiet_in_tests()).select("check_id", *COLUMNS)


#: The packages whose findings are the baseline of the queries below.
SNAPSHOT = "package in ('pkg0', 'pkg1', 'pkg2')"


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """All findings, written once: a snapshot and what is compared with it are both read from there."""
    path = report.temporary(tree(spark, d), "scanned")
    scan(tree(spark, d)).select("package", "check_id", *COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def baseline_anti_join(spark: SparkSession, d: str) -> DataFrame:
    found = _scanned(spark, d)
    return post.not_in_baseline(found, post.fingerprints(found.where(SNAPSHOT))).select("check_id", *COLUMNS)


def baseline_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return post.fingerprints(scan(tree(spark, d)))


def summary_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return post.summary(pipeline.kept(tree(spark, d)), "severity")


def summary_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    return post.summary(pipeline.kept(tree(spark, d)), "confidence")


def file_dedupe(spark: SparkSession, d: str) -> DataFrame:
    f = tree(spark, d)
    twice = f.withColumn("package", F.lit("pkg_any")).unionByName(f)
    return post.first_package(twice.withColumn("is_manifest", ~F.col("name").endswith(".py"))).select("file", "package")


def gate_exit_code(spark: SparkSession, d: str) -> DataFrame:
    return post.gate(pipeline.kept(tree(spark, d)))


def report_order(spark: SparkSession, d: str) -> DataFrame:
    """The findings of a text report, in its order."""
    return post.by_severity(pipeline.kept(tree(spark, d))).select("package", *COLUMNS)


def findings_rollup(spark: SparkSession, d: str) -> DataFrame:
    return post.rollup(pipeline.kept(tree(spark, d)))


def manifest_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each package's manifests in the nearest directory upwards, with their labels."""
    docs = spark.read.parquet(f"{d.rstrip('/')}/documents.parquet")
    return listing.nearest_manifests(corpus.packages(docs), corpus.listing(docs), "/repo").select("package", "path", "label")


def manifest_claims(spark: SparkSession, d: str) -> DataFrame:
    """Which package has each manifest when packages share them, and whether a lock file lies beside it."""
    docs = spark.read.parquet(f"{d.rstrip('/')}/documents.parquet")
    names = corpus.listing(docs)
    near = listing.nearest_manifests(corpus.packages(docs), names, "/repo")
    claimed = listing.first_claims(spark.createDataFrame([], "package string, path string"), near)
    return post.with_locks(claimed.withColumn("name", F.element_at(F.split("path", "/"), -1)), names).select("path", "package", "locked")


def advisory_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A table of advisories with lower and upper bounds over manifests of many lines."""
    read = lambda t: spark.read.parquet(f"{d.rstrip('/')}/{t}.parquet")
    found = hits(corpus.requirements(read("documents")), ["check_dependency_cve"], corpus.advisories(read("supplier")))
    return found.select("file", "line", "code", F.col("extra").alias("detail"))


def test_paths_option(spark: SparkSession, d: str) -> DataFrame:
    """With a further name of test directories."""
    return scan(tree(spark, d)).where(~post.quiet_in_tests(("pkg1",))).select("check_id", *COLUMNS)


def report_json(spark: SparkSession, d: str) -> DataFrame:
    """The whole run's JSON document, read again: its findings, and its own count beside each."""
    done = pipeline.run(tree(spark, d))
    path = report.temporary(done.findings, "json")
    report.write_json(done.findings, done.counters, path)
    done.done()
    return report.read_json(spark, path).select("package", *COLUMNS, "count", "nosec_suppressed", "test_suppressed")


def baseline_table(spark: SparkSession, d: str) -> DataFrame:
    """Against the first three packages' snapshot, as a bucketed table."""
    found = _scanned(spark, d)
    baselines.save(found.where(SNAPSHOT), "siltstone_baseline")
    return post.not_in_baseline(found, baselines.load(spark, "siltstone_baseline")).select("check_id", *COLUMNS)


def stored_facts(spark: SparkSession, d: str) -> DataFrame:
    """The syntax checks over facts by content: a third of the tree is learned first, then what is left."""
    store = report.temporary(tree(spark, d), "facts")
    fact_store.learn(tree(spark, d).where("package in ('pkg0', 'pkg3')"), store)
    return scan(tree(spark, d), [c for c, _ in AST_CHECKS], store=store).select("check_id", *COLUMNS)


def document_hits(spark: SparkSession, d: str) -> DataFrame:
    """What the plain line checks say of every line of every document."""
    return scan(corpus.texts(spark.read.parquet(f"{d.rstrip('/')}/documents.parquet"), "doc_id"), list(plain_checks())).select("check_id", *COLUMNS)


def conversation_hits(spark: SparkSession, d: str) -> DataFrame:
    """What they say of every line of every turn."""
    return scan(corpus.texts(spark.read.parquet(f"{d.rstrip('/')}/conversations.parquet"), "conv_id", "turn"), list(plain_checks())).select("check_id", *COLUMNS)


def plain_checks() -> dict[str, TextCheck]:
    """The checks that look at lines alone."""
    return {c.check: c for c in TEXT_CHECKS if not any(_named(v.when) for g in c.groups for v in g) and c.check != "check_parquet_arrow_deserialize"}


def queries() -> dict[str, Query]:
    steps = (manifest_labels, manifest_claims, advisory_ranges, test_paths_option, report_json, baseline_table, stored_facts, document_hits, conversation_hits, scan_all, suppress_nosec, filter_confidence, suppress_test_paths, baseline_anti_join, baseline_fingerprints, summary_by_severity, summary_by_confidence, file_dedupe, gate_exit_code, report_order, findings_rollup)
    return {c: _check(c) for c in ORDER} | {f.__name__: f for f in steps}


# ---------------------------------------------------------------- the same in SQL


def _named(c) -> bool:
    return isinstance(c, Named) or any(_named(p) for p in getattr(c, "parts", ())) or (hasattr(c, "part") and not isinstance(c.part, str) and _named(c.part))


def _code() -> str:
    out = "replace(replace(line, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    for c in BIDI:
        out = f"replace({out}, chr({ord(c)}), '\\u{{{ord(c):x}}}')"
    return f"concat(chr(34), {out}, chr(34))"


def _patterns(check: TextCheck) -> str:
    """The check's patterns run by the other engine over the lines of ``l``."""
    code = _code() if check.check == "check_trojan_source" else SQL_TRIM
    parts = []
    for group in check.groups:
        pick = lambda f: "CASE " + " ".join(f"WHEN {v.when.sql()} THEN '{f(v)}'" for v in group) + " END"  # noqa: B023, E731
        alive = SQL_LIVE if check.live else "TRUE"
        parts.append(f"SELECT '{check.check}' AS check_id, file, CAST(line_no AS INTEGER) AS line, {pick(lambda v: v.cwe)} AS cwe_id, {pick(lambda v: v.severity)} AS severity, {pick(lambda v: v.confidence)} AS confidence, {code} AS code FROM l WHERE {alive}")
    return " UNION ALL ".join(parts)


def _pattern_sql(check: TextCheck) -> str:
    return f"WITH {corpus.SQL_TREE}, {corpus.SQL_LINES}, l AS (SELECT file, line_no, line FROM tree JOIN tpl USING (tmpl)) SELECT * EXCLUDE (check_id) FROM ({_patterns(check)}) WHERE cwe_id IS NOT NULL"


def _text_sql(table: str, name: str) -> str:
    """All plain checks over all lines of a table's texts; a final empty part is no line, and \\r goes with its \\n."""
    return f"""WITH {corpus.SQL_TEMPLATES}, s AS (SELECT concat({name}, '.txt') AS file, string_split(concat_ws(chr(10), text, body), chr(10)) AS parts FROM {table} JOIN templates ON tmpl = {name.split(',')[0]} % {corpus.COUNT}),
p AS (SELECT file, len(parts) AS n, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM s),
l AS (SELECT file, line_no, CASE WHEN line_no < n AND suffix(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS line FROM p WHERE line_no < n OR line <> '')
SELECT * FROM ({' UNION ALL '.join(_patterns(c) for c in plain_checks().values())}) WHERE cwe_id IS NOT NULL"""


_NEAR = """WITH pk AS (SELECT doc_id, concat('p', doc_id) AS package, concat('/repo/pkg', doc_id % 5) AS k, concat('/repo/pkg', doc_id % 5, '/g', doc_id % 37) AS g, concat('/repo/pkg', doc_id % 5, '/g', doc_id % 37, '/d', doc_id) AS root FROM documents),
names AS (SELECT root AS dir, ['pyproject.toml', 'uv.lock', 'notes.md'][doc_id % 3 + 1] AS name FROM pk WHERE doc_id % 11 < 3
  UNION SELECT g, 'requirements.txt' FROM pk WHERE doc_id % 37 % 3 = 0 UNION SELECT g, 'setup.py' FROM pk WHERE doc_id % 37 % 6 = 0 UNION SELECT g, 'poetry.lock' FROM pk WHERE doc_id % 37 % 4 = 0
  UNION SELECT k, 'Pipfile' FROM pk WHERE doc_id % 5 IN (0, 2, 4) UNION SELECT k, 'Pipfile.lock' FROM pk WHERE doc_id % 5 = 4 UNION SELECT '/repo', 'pyproject.toml'),
up AS (SELECT package, 0 AS n, root AS dir FROM pk UNION ALL SELECT package, 1, g FROM pk UNION ALL SELECT package, 2, k FROM pk UNION ALL SELECT package, 3, '/repo' FROM pk),
hit AS (SELECT package, n, dir, name FROM up JOIN names USING (dir) WHERE name IN ('pyproject.toml', 'requirements.txt', 'setup.py', 'Pipfile')),
near AS (SELECT hit.package, hit.dir, hit.name, coalesce(pk.package, regexp_extract(hit.dir, '[^/]+$')) AS label FROM hit LEFT JOIN pk ON pk.root = hit.dir
  WHERE n = (SELECT min(n) FROM hit h WHERE h.package = hit.package))"""

_ADVISED = """WITH m AS (SELECT doc_id, concat('d', doc_id, '/requirements.txt') AS file, unnest([
    {'no': 2, 'dep': concat('lib', doc_id % 7), 'v': [doc_id % 5, doc_id % 11, doc_id % 3], 'code': concat('lib', doc_id % 7, '==', doc_id % 5, '.', doc_id % 11, '.', doc_id % 3)},
    {'no': 3, 'dep': concat('lib', (doc_id + 3) % 9), 'v': [doc_id % 4, doc_id % 13, 0], 'code': concat('LIB', (doc_id + 3) % 9, ' >= ', doc_id % 4, '.', doc_id % 13, '.0')},
    {'no': 5, 'dep': concat('lib', doc_id % 7), 'v': [(doc_id + 1) % 5, 0, 1], 'code': concat('lib', doc_id % 7, '==', (doc_id + 1) % 5, '.0.1')}]) AS l FROM documents),
a AS (SELECT concat('lib', s_suppkey % 9) AS dep, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN [s_suppkey % 3, s_suppkey % 10, 0] ELSE [s_suppkey % 2, 0, s_suppkey % 5] END AS low,
  CASE s_suppkey % 5 WHEN 0 THEN NULL ELSE [s_suppkey % 4 + 1, s_suppkey % 12, 2] END AS high, concat('ADV-', s_suppkey) AS id FROM supplier WHERE s_suppkey % 5 <> 1),
j AS (SELECT file, l.no AS no, l.code AS code, concat(dep, CASE WHEN low IS NULL THEN '' ELSE concat(' >=', array_to_string(low, '.')) END, CASE WHEN high IS NULL THEN '' ELSE concat(' <', array_to_string(high, '.')) END, ': ', id) AS detail
  FROM m JOIN a ON a.dep = l.dep WHERE (low IS NULL OR l.v >= low) AND (high IS NULL OR l.v < high)),
f AS (SELECT *, row_number() OVER (PARTITION BY file, detail ORDER BY no) AS nth FROM j)
SELECT file, CAST(no AS INTEGER) AS line, code, detail FROM f WHERE nth = 1"""

_TRUTH = f"WITH {corpus.SQL_TREE}, {corpus.SQL_TRUTH}"
_ALL = "file, line, cwe_id, severity, confidence, code"
_NOSEC = r"regexp_matches(source, '#\s*nosec\b', 'i') AND (NOT regexp_matches(source, '#\s*nosec\s+[A-Za-z0-9_,-]', 'i') OR list_contains(string_split(upper(regexp_extract(source, '#\s*nosec\s+([A-Za-z0-9_,-]+)', 1, 'i')), ','), cwe_id))"
_QUIET = r"cwe_id IN ('CWE-798', 'CWE-617', 'CWE-918', 'CWE-770') AND regexp_matches(file, '(^|/)tests?/')"
_KEPT = f"NOT ({_NOSEC}) AND NOT ({_QUIET})"
_BASE = "SELECT DISTINCT cwe_id, file, code FROM found WHERE package IN ('pkg0', 'pkg1', 'pkg2')"


def oracle_sql() -> dict[str, str]:
    plain = plain_checks()
    out = {}
    for name in ORDER:
        if name in plain:
            out[name] = _pattern_sql(plain[name])
        else:
            out[name] = f"{_TRUTH} SELECT {_ALL} FROM found WHERE check_id = '{name}'"
    syntax = ", ".join(f"'{c}'" for c, _ in AST_CHECKS)
    return out | {
        "manifest_labels": f"{_NEAR} SELECT package, concat(dir, '/', name) AS path, label FROM near",
        "manifest_claims": f"""{_NEAR} SELECT concat(dir, '/', name) AS path, arg_min(label, package) AS package,
  EXISTS (SELECT 1 FROM names n WHERE n.dir = near.dir AND (n.name IN ('uv.lock', 'poetry.lock', 'Pipfile.lock') OR (n.name = 'requirements.txt' AND near.name <> 'requirements.txt'))) AS locked FROM near GROUP BY dir, name""",
        "advisory_ranges": _ADVISED,
        "test_paths_option": f"{_TRUTH} SELECT check_id, {_ALL} FROM found WHERE NOT ({_QUIET.replace('tests?', '(tests?|pkg1)')})",
        "report_json": f"""{_TRUTH}, k AS (SELECT package, {_ALL} FROM found WHERE {_KEPT}) SELECT *, (SELECT count(*) FROM k) AS count,
  (SELECT count(*) FROM found WHERE {_NOSEC}) AS nosec_suppressed, (SELECT count(*) FROM found WHERE NOT ({_NOSEC}) AND ({_QUIET})) AS test_suppressed FROM k""",
        "baseline_table": f"{_TRUTH}, b AS ({_BASE}) SELECT check_id, {_ALL} FROM found WHERE (cwe_id, file, code) NOT IN (SELECT (cwe_id, file, code) FROM b)",
        "stored_facts": f"{_TRUTH} SELECT check_id, {_ALL} FROM found WHERE check_id IN ({syntax})",
        "document_hits": _text_sql("documents", "doc_id"),
        "conversation_hits": _text_sql("conversations", "conv_id, '-', turn"),
        "scan_all": f"{_TRUTH} SELECT package, check_id, {_ALL} FROM found",
        "suppress_nosec": f"{_TRUTH} SELECT check_id, {_ALL} FROM found WHERE NOT ({_NOSEC})",
        "filter_confidence": f"{_TRUTH} SELECT check_id, {_ALL} FROM found WHERE confidence IN ('HIGH', 'MEDIUM')",
        "suppress_test_paths": f"{_TRUTH} SELECT check_id, {_ALL} FROM found WHERE NOT ({_QUIET})",
        "baseline_anti_join": f"{_TRUTH}, b AS ({_BASE}) SELECT check_id, {_ALL} FROM found WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.cwe_id = found.cwe_id AND b.file = found.file AND b.code = found.code)",
        "baseline_fingerprints": f"{_TRUTH} SELECT DISTINCT cwe_id, file, code FROM found",
        "summary_by_severity": f"{_TRUTH} SELECT severity, count(*) AS n FROM found WHERE {_KEPT} GROUP BY severity",
        "summary_by_confidence": f"{_TRUTH} SELECT confidence, count(*) AS n FROM found WHERE {_KEPT} GROUP BY confidence",
        "file_dedupe": f"WITH {corpus.SQL_TREE} SELECT file, package FROM tree",
        "gate_exit_code": f"{_TRUTH} SELECT CAST(coalesce(max(CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END), 0) AS INTEGER) AS exit_code FROM found WHERE {_KEPT}",
        "report_order": f"{_TRUTH} SELECT package, {_ALL} FROM found WHERE {_KEPT} ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, file, line",
        "findings_rollup": f"{_TRUTH} SELECT package, cwe_id, count(*) AS n FROM found WHERE {_KEPT} GROUP BY ROLLUP (package, cwe_id)",
    }
