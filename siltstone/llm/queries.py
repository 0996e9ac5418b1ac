"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arc_warc, hash_tree, lexical_search, license_scan, line_windows, lm_gru, merkle, minhash_bayes, oracles, packing_gga, quality_llr, surrogates, template_leaks, tool_links
from siltstone.llm.tables import table


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.PiiParams(key=b"the key of this query: its tables are invented"))
    return done.select("doc_id", "n_entities", "entity_kinds", "text")


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "item_windows", "n_slots")


def leaks_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of items with numbers and names, of which every document holds one with other numbers and names: substituted
    consistently, or (every fifth) with a contradiction."""
    docs, items = template_leaks.reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return template_leaks.leaks(docs, items).select("doc_id", "item_id", "n_windows", "item_windows", "n_slots")


def op8_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_bayes.near_classes(table(spark, sf_dir, "documents"))


def op3_lm_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_gru.score(table(spark, sf_dir, "documents"))


def op4_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_links.conversation_calls(table(spark, sf_dir, "conversations"))
    linked = tool_links.link(calls, results, tool_links.conversation_tools(spark))
    return linked.select("conv_id", "call_id", "turn", "name", "result_turn", F.col("level").cast("long").alias("level"), "status", "errors", F.md5(F.col("canonical").cast("binary")).alias("canonical_md5"))


def op5_arc_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = arc_warc.pages_through_archives(table(spark, sf_dir, "pages"))
    return back.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_source").alias("refers_to"))


def op6_packing_gga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_gga.pack(table(spark, sf_dir, "documents"))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_windows.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", "removed_lines").alias("removed_lines"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_surrogates, op2_quality_llr, op3_lm_gru, op4_tool_links, op5_arc_warc, op6_packing_gga, op7_template_leaks, op8_minhash_bayes, op9_line_windows, op10_hash_tree, op11_lexical_search, op12_merkle_paths, op13_license_diagonals, leaks_reparameterised)}


OP9_SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
c AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.pos AS a, e.pos AS b, a.line AS l1, m.line AS l2, e.line AS l3
      FROM c a JOIN c m ON a.doc_id = m.doc_id AND m.k = a.k + 1 JOIN c e ON a.doc_id = e.doc_id AND e.k = a.k + 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, a) AS nth FROM w),
g AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.a AND r.b WHERE r.nth > 1),
x AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
             coalesce(string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos), '') AS removed_lines,
             md5(coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS text_md5
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT * FROM x
"""

OP4_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, turn IN (2, 3) AS two FROM conversations),
c AS (SELECT conv_id, turn, concat(conv_id, ':', CASE WHEN role = 'user' AND conv_id % 11 = 5 AND turn IN (4, 5) THEN turn - 2 ELSE turn END) AS call_id,
             CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name,
             CASE WHEN role = 'user' AND turn > 1 THEN concat(conv_id, ':', turn - 2) END AS a,
             CASE WHEN role = 'user' AND turn > 3 AND conv_id % 5 = 1 THEN concat(conv_id, ':', turn - 4) END AS f,
             CASE WHEN role = 'user' AND two AND conv_id % 11 = 6 THEN concat(conv_id, ':', turn + 2) END AS u,
             CASE WHEN role <> 'user' THEN '' WHEN two AND conv_id % 7 = 2 THEN 'type:position' WHEN two AND conv_id % 7 = 3 THEN 'unknown:retry' WHEN two AND conv_id % 7 = 4 THEN 'missing:prompt' ELSE '' END AS bad, text
      FROM t WHERE role IN ('user', 'system')),
j AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn) AS nth,
             CASE WHEN name = 'configure' THEN concat('{"instructions":', CAST(to_json(text) AS VARCHAR), '}')
             ELSE concat('{', CASE WHEN a IS NOT NULL THEN concat('"after":"$call:', a, '",') ELSE '' END,
                         CASE WHEN f IS NOT NULL THEN concat('"first":"$call:', f, '",') ELSE '' END,
                         '"position":', CASE WHEN bad = 'type:position' THEN concat('"', turn, '"') ELSE CAST(turn AS VARCHAR) END,
                         CASE WHEN bad = 'missing:prompt' THEN '' ELSE concat(',"prompt":', CAST(to_json(text) AS VARCHAR)) END,
                         CASE WHEN bad = 'unknown:retry' THEN ',"retry":true' ELSE '' END,
                         CASE WHEN u IS NOT NULL THEN concat(',"until":"$call:', u, '"') ELSE '' END, '}') END AS args
      FROM c),
k AS (SELECT * FROM j WHERE nth = 1),
r AS (SELECT conv_id, concat(conv_id, ':', CASE WHEN conv_id % 13 = 7 THEN turn + 1 ELSE turn - 1 END) AS call_id, turn, text
      FROM t WHERE role NOT IN ('user', 'system')),
ra AS (SELECT conv_id, call_id, min(struct_pack(turn := turn, content := text)) AS r FROM r GROUP BY ALL),
x AS (SELECT DISTINCT conv_id, call_id, unnest([a, f, u]) AS needs FROM k),
y AS (SELECT x.*, d.call_id IS NOT NULL AS there FROM x LEFT JOIN k d ON d.conv_id = x.conv_id AND d.call_id = x.needs WHERE needs IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM k GROUP BY conv_id),
w(conv_id, call_id, cur, level) AS (
  SELECT conv_id, call_id, call_id, 0 FROM k
  UNION SELECT w.conv_id, w.call_id, y.needs, w.level + 1 FROM w JOIN y ON y.conv_id = w.conv_id AND y.call_id = w.cur AND y.there JOIN n ON n.conv_id = w.conv_id WHERE w.level < n.n),
lv AS (SELECT w.conv_id, call_id, CASE WHEN max(level) < max(n.n) THEN max(level) END AS level FROM w JOIN n USING (conv_id) GROUP BY ALL),
lo AS (SELECT conv_id, call_id, string_agg(concat('dangling:', needs), ',' ORDER BY concat('dangling:', needs)) AS loose FROM y WHERE NOT there GROUP BY ALL)
SELECT j.conv_id, j.call_id, j.turn, j.name, CASE WHEN nth = 1 THEN ra.r.turn END AS result_turn, CAST(CASE WHEN nth = 1 THEN lv.level END AS BIGINT) AS level,
       CASE WHEN nth > 1 THEN 'duplicate' WHEN lv.level IS NULL THEN 'cycle' WHEN ra.r IS NULL THEN 'unanswered' WHEN ra.r.turn < j.turn THEN 'early' ELSE 'linked' END AS status,
       concat_ws(',', nullif(j.bad, ''), CASE WHEN nth = 1 THEN lo.loose END) AS errors,
       md5(concat('{"arguments":', j.args, ',"call_id":"', j.call_id, '","content":', CASE WHEN nth = 1 THEN coalesce(CAST(to_json(ra.r.content) AS VARCHAR), 'null') ELSE 'null' END, ',"name":"', j.name, '"}')) AS canonical_md5
FROM j LEFT JOIN ra USING (conv_id, call_id) LEFT JOIN lv USING (conv_id, call_id) LEFT JOIN lo USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, r.turn, NULL, 'orphan', '',
       md5(concat('{"arguments":null,"call_id":"', r.call_id, '","content":', CAST(to_json(r.text) AS VARCHAR), ',"name":null}'))
FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = r.conv_id AND k.call_id = r.call_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_tool_links": OP4_SQL, "op9_line_windows": OP9_SQL, "op11_lexical_search": oracles.OP11_SQL, "op12_merkle_paths": oracles.OP12_SQL, "op13_license_diagonals": oracles.op13_sql()}
