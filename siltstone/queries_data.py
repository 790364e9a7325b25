"""Queries of the general data problems 1, 2, 4 and 7, each with its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import hierarchy, incremental, multivalue, orphans
from siltstone.runtime import table


def _orphan_tables(spark: SparkSession, d: str):
    return table(spark, d, "document_relations"), table(spark, d, "store_documents"), table(spark, d, "document_deletes")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rows(*_orphan_tables(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_orphan_tables(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.due_documents(*(table(spark, d, t) for t in ("store_documents", "embed_attempts", "embed_runs")))


def _hierarchy(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    return hierarchy.Hierarchy(hierarchy.parent_links(table(spark, d, "store_documents"), table(spark, d, "document_relations")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestor_pairs(table(spark, d, "store_documents"), table(spark, d, "document_relations"))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every document, those without a link too."""
    s = table(spark, d, "store_documents")
    return hierarchy.Hierarchy(hierarchy.parent_links(s, table(spark, d, "document_relations")), hierarchy.node_keys(s)).nodes().drop("name")


def p4_cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).cycle_members()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.explode_values(table(spark, d, "store_documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p4_found, p4_nodes, p4_cycle_nodes, p7_found)}

_ORPHANS = """
WITH refs AS (
  SELECT 'document_relations' AS ref_table, id AS row_id, 'source_id' AS ref_field, lower(trim(source_id)) AS k, created_at FROM document_relations
  UNION ALL SELECT 'document_relations', id, 'target_id', lower(trim(target_id)), created_at FROM document_relations
  UNION ALL SELECT 'store_documents', id, 'parent_id', lower(trim(parent_id)), created_at FROM store_documents),
live AS (SELECT lower(trim(id)) AS k, min(created_at) AS since FROM store_documents GROUP BY 1),
dead AS (SELECT DISTINCT lower(trim(document_id)) AS k FROM document_deletes),
miss AS (SELECT r.*, CASE WHEN l.k IS NOT NULL THEN 'created_later' WHEN d.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM refs r LEFT JOIN live l ON r.k = l.k LEFT JOIN dead d ON r.k = d.k
  WHERE r.k <> '' AND (l.k IS NULL OR l.since > r.created_at))
"""

_LINKS = """
d AS (SELECT id, lower(trim(id)) AS k, lower(trim(parent_id)) AS p FROM store_documents),
e AS (SELECT k AS node, p AS parent FROM d WHERE p <> ''
  UNION SELECT lower(trim(source_id)), lower(trim(target_id)) FROM document_relations WHERE lower(trim(relation_type)) = 'child_of'
  UNION SELECT lower(trim(target_id)), lower(trim(source_id)) FROM document_relations WHERE lower(trim(relation_type)) = 'parent_of'),
links AS (SELECT DISTINCT node, parent FROM e WHERE node IN (SELECT k FROM d) AND parent IN (SELECT k FROM d)),
reach AS (SELECT node, parent AS ancestor FROM links UNION SELECT r.node, l.parent FROM reach r JOIN links l ON r.ancestor = l.node)
"""

# one match a value: delimiter (one is put before the field), blanks, an optional quoted span, the rest up to the next delimiter
_TOKEN = r"""[,;|\t\r\n][ ]*(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')?[^,;|\t\r\n]*"""

ORACLE = {
    "p1_found": _ORPHANS + "SELECT DISTINCT ref_table, row_id, ref_field FROM miss",
    "p1_report": _ORPHANS
    + "SELECT ref_table, ref_field, kind, strftime(created_at, '%Y-%m') AS month, count(DISTINCT row_id) AS orphans FROM miss GROUP BY ALL",
    "p2_found": """
SELECT DISTINCT id FROM store_documents s WHERE coalesce(vectorize, true) AND updated_at IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM embed_attempts a JOIN embed_runs r USING (run_id)
  WHERE r.status = 'success' AND a.outcome = 'done' AND lower(trim(a.document_id)) = lower(trim(s.id)) AND a.version_ms = epoch_us(s.updated_at) // 1000)""",
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT a.id AS ancestor_id, n.id AS node_id FROM reach r JOIN d a ON r.ancestor = a.k JOIN d n ON r.node = n.k",
    "p4_cycle_nodes": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT node FROM reach WHERE node = ancestor",
    "p4_nodes": f"""
WITH RECURSIVE {_LINKS},
first AS (SELECT node, min(parent) AS parent FROM links WHERE node <> parent GROUP BY 1),
way AS (SELECT node, parent AS ancestor FROM first UNION SELECT w.node, f.parent FROM way w JOIN first f ON w.ancestor = f.node),
heads AS (SELECT a.node FROM way a WHERE a.node = a.ancestor AND a.node = (SELECT min(b.ancestor) FROM way b WHERE b.node = a.node)),
forest AS (SELECT * FROM first WHERE node NOT IN (SELECT node FROM heads)),
walk AS (SELECT k AS node, k AS root, 0 AS depth, k AS path FROM d WHERE k NOT IN (SELECT node FROM forest)
  UNION ALL SELECT f.node, w.root, w.depth + 1, w.path || '/' || f.node FROM walk w JOIN forest f ON f.parent = w.node),
n AS (SELECT ancestor, count(*) AS descendants, bool_or(node = ancestor) AS on_cycle FROM (SELECT DISTINCT node, ancestor FROM reach) GROUP BY 1)
SELECT w.node, root, depth, path, coalesce(on_cycle, false) AS on_cycle, coalesce(descendants, 0) AS descendants FROM walk w LEFT JOIN n ON w.node = n.ancestor""",
    "p7_found": rf"""
WITH f AS (SELECT id, regexp_replace(tags, '^\s+|\s+$', '', 'g') AS t FROM store_documents),
v AS (SELECT id, t, CASE WHEN t LIKE '[%]' AND json_valid(t) THEN CAST(json_extract_string(t, '$[*]') AS VARCHAR[]) END AS js,
  regexp_extract_all(',' || CASE WHEN t LIKE '[%]' OR t LIKE '{{%}}' THEN substr(t, 2, length(t) - 2) ELSE t END, '{_TOKEN}') AS tok FROM f WHERE t <> ''),
w AS (SELECT id, coalesce(js, list_transform(tok, lambda x: regexp_replace(regexp_replace(x, '^[,;|\t\r\n]', ''), '^\s+|\s+$', '', 'g'))) AS a, js IS NULL AS delimited FROM v),
u AS (SELECT id, list_filter(list_transform(a, lambda x: trim(CASE
  WHEN delimited AND regexp_matches(x, '^"(?:[^"]|"")*"') THEN replace(substr(regexp_extract(x, '^"(?:[^"]|"")*"'), 2, length(regexp_extract(x, '^"(?:[^"]|"")*"')) - 2), '""', '"') || regexp_replace(x, '^"(?:[^"]|"")*"', '')
  WHEN delimited AND regexp_matches(x, '^''(?:[^'']|'''')*''') THEN replace(substr(regexp_extract(x, '^''(?:[^'']|'''')*'''), 2, length(regexp_extract(x, '^''(?:[^'']|'''')*''')) - 2), '''''', '''') || regexp_replace(x, '^''(?:[^'']|'''')*''', '')
  ELSE x END)), lambda x: x IS NOT NULL AND x <> '') AS tags FROM w)
SELECT id, unnest(range(len(tags)))::INT AS pos, unnest(tags) AS tag FROM u""",
}
