"""Queries of the general data-pipeline problems (1, 2 and 6), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators.nested import dewey_nodes, related_tables, schema_path
from evalweave.operators.packed import packed_items
from evalweave.operators.references import orphan_references, orphans_by_month
from evalweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_items(table(spark, sf_dir, "gt_records"), table(spark, sf_dir, "legend"))


def p1_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields hold how many values."""
    items = p1_found(spark, sf_dir)
    fields = items.groupBy("gt_id", "section_name", "isolate_pos", "field_name").agg(F.count(F.lit(1)).alias("n_values"))
    return fields.groupBy("section_name", "field_name", "n_values").agg(F.count(F.lit(1)).alias("n_fields"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = dewey_nodes(table(spark, sf_dir, "gt_records"), "gt_records", "gt_id", "gt_json", "json")
    return gt.unionByName(dewey_nodes(table(spark, sf_dir, "articles"), "articles", "article_id", "raw_xml", "xml"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir)


def p2_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per schema path."""
    return _nodes(spark, sf_dir).groupBy("root_table", schema_path(F.col("node_path")).alias("schema_path")).agg(F.count(F.lit(1)).alias("n_nodes"))


def _flat(name: str, doc: str):
    source = ("gt_records", "gt_id", "gt_json", "json") if name in ("isolates", "envelopes", "antibiotics") else ("articles", "article_id", "raw_xml", "xml")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = dewey_nodes(table(spark, sf_dir, source[0]), *source)
        return related_tables(nodes)[name].select("root_id", "parent_path", "node_path", "node_name")

    query.__name__, query.__doc__ = f"p2_{name}", doc
    return query


_FLAT = [
    _flat("isolates", "Linked isolates as a table of their own."),
    _flat("envelopes", "Susceptibility envelopes, each under its isolate."),
    _flat("antibiotics", "Antibiotics, each under its envelope."),
    _flat("sections", "Sections of articles of any depth, each under the one around it."),
    _flat("tables", "Tables of articles, each under its section."),
    _flat("table_rows", "Rows of tables, each under its table."),
]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*(table(spark, sf_dir, t) for t in ("record_results", "articles", "xml_files")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id")


def p6_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_month(_orphans(spark, sf_dir)).select("table_name", "month", "orphans")


QUERIES = {f.__name__: f for f in (p1_found, p1_value_counts, p2_found, p2_schema, *_FLAT, p6_found, p6_by_month)}

_PMCID = (
    "CASE WHEN regexp_matches({0}, '(?i)^\\s*(PMC)?[^0-9A-Za-z]*[0-9]+(\\.[0-9]+)?\\s*$') THEN 'PMC' || "
    "regexp_replace(regexp_extract({0}, '(?i)^\\s*(?:PMC)?[^0-9A-Za-z]*([0-9]+)', 1), '^0+([0-9])', '\\1') ELSE nullif(upper(trim({0})), '') END"
)
_FILE = "nullif(lower(trim(regexp_extract({0}, '([^/\\\\]*)$', 1))), '')"

_ORPHANS = f"""
WITH refs AS (
  SELECT DISTINCT 'record_results' AS table_name, result_id AS row_id, {_PMCID.format("pmcid")} AS k, evaluated_at AS t FROM record_results
  UNION ALL
  SELECT DISTINCT 'articles', article_id, {_FILE.format("xml_filepath")}, loaded_at FROM articles
), targets AS (
  SELECT 'record_results' AS table_name, {_PMCID.format("pmcid")} AS k, loaded_at AS a, withdrawn_at AS z FROM articles
  UNION ALL
  SELECT 'articles', {_FILE.format("file_path")}, arrived_at, removed_at FROM xml_files
), found AS (
  SELECT table_name, row_id, t FROM refs WHERE k IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM targets WHERE targets.table_name = refs.table_name AND targets.k = refs.k
      AND targets.a <= refs.t AND (targets.z IS NULL OR targets.z > refs.t))
)
"""

# names and numbers as they are written; trailing commas are taken out of texts that can't be read with them
_JSON_NODES = """
WITH d AS (SELECT DISTINCT gt_id, gt_json AS j FROM gt_records WHERE gt_json IS NOT NULL),
f AS (SELECT gt_id, CASE WHEN json_valid(j) THEN j ELSE regexp_replace(j, ',(\\s*[}\\]])', '\\1', 'g') END AS j FROM d),
v AS (SELECT gt_id, json_extract(j::JSON, '$.isolates_with_linking') AS l FROM f WHERE json_valid(j)),
lists AS (SELECT gt_id, unnest(from_json(l, '["JSON"]')) AS b, unnest(range(1, json_array_length(l)::BIGINT + 1)) AS k FROM v WHERE json_type(l) = 'ARRAY'),
maps AS (SELECT gt_id, unnest(json_keys(l)) AS n, unnest(range(1, len(json_keys(l)) + 1)) AS k, l FROM v WHERE json_type(l) = 'OBJECT'),
isolates AS (
  SELECT gt_id, k, b, CASE WHEN json_type(b, '$.isolate_id') IN ('ARRAY', 'OBJECT', 'NULL') THEN '' ELSE coalesce(json_extract_string(b, '$.isolate_id'), '') END AS name FROM lists WHERE json_type(b) = 'OBJECT'
  UNION ALL SELECT gt_id, k, b, n FROM (SELECT gt_id, k, n, map_extract(from_json(l, '{"k": "JSON"}'::JSON)::MAP(VARCHAR, JSON), n)[1] AS b FROM maps) WHERE json_type(b) = 'OBJECT'),
"""
_JSON_NODES = _JSON_NODES.replace("map_extract(from_json(l, '{\"k\": \"JSON\"}'::JSON)::MAP(VARCHAR, JSON), n)[1]", "json_extract(l, '$.\"' || n || '\"')") + """a AS (SELECT gt_id, k, json_extract(b, '$.ast_data') AS x FROM isolates),
e0 AS (SELECT gt_id, k, unnest(from_json(x, '["JSON"]')) AS b FROM a WHERE json_type(x) = 'ARRAY'
  UNION ALL SELECT gt_id, k, x FROM a WHERE json_type(x) = 'OBJECT' AND (json_exists(x, '$.Serotype') OR json_exists(x, '$.Antibiotics'))),
e1 AS (SELECT * FROM a LEFT JOIN LATERAL (SELECT 1) ON true)
"""

def _json_name(at: str) -> str:
    return f"CASE WHEN json_type(b, '$.{at}') IN ('ARRAY', 'OBJECT', 'NULL') THEN '' ELSE coalesce(json_extract_string(b, '$.{at}'), '') END"


def _members(rows: str, x: str) -> str:
    return f"SELECT s.*, t.value AS m, t.id AS o FROM ({rows}) s, json_each(s.{x}) t WHERE json_type(s.{x}) = 'ARRAY' AND json_type(t.value) = 'OBJECT'"


# trailing commas are taken out of texts that can't be read with them
_JSON_NODES = f"""
WITH d AS (SELECT DISTINCT gt_id, gt_json AS j FROM gt_records WHERE gt_json IS NOT NULL),
f AS (SELECT gt_id, CASE WHEN json_valid(j) THEN j ELSE regexp_replace(j, ',(\\s*[}}\\]])', '\\1', 'g') END AS j FROM d),
v AS (SELECT gt_id, json_extract(j, '$.isolates_with_linking') AS l FROM f WHERE json_valid(j)),
n AS (SELECT gt_id, t.key AS key, t.value AS b, json_type(l) AS kind, row_number() OVER (PARTITION BY gt_id ORDER BY t.id) AS i FROM v, json_each(l) t WHERE json_type(l) IN ('ARRAY', 'OBJECT')),
isolates AS (SELECT gt_id, '' AS parent_path, 'i' || i AS node_path, CASE WHEN kind = 'OBJECT' THEN key ELSE {_json_name("isolate_id")} END AS node_name, b FROM n WHERE json_type(b) = 'OBJECT'),
a AS (SELECT gt_id, node_path AS p, json_extract(b, '$.ast_data') AS x FROM isolates),
e AS ({_members("SELECT * FROM a", "x")} UNION ALL SELECT *, x, 0 FROM a WHERE json_type(x) = 'OBJECT' AND (json_exists(x, '$.Serotype') OR json_exists(x, '$.Antibiotics'))),
envelopes AS (SELECT gt_id, p AS parent_path, p || '.e' || row_number() OVER (PARTITION BY gt_id, p ORDER BY o) AS node_path, {_json_name("Serotype")} AS node_name, b FROM (SELECT gt_id, p, o, m AS b FROM e)),
g AS (SELECT gt_id, node_path AS p, json_extract(b, '$.Antibiotics') AS x FROM envelopes),
h AS ({_members("SELECT * FROM g", "x")} UNION ALL SELECT *, x, 0 FROM g WHERE json_type(x) = 'OBJECT'),
antibiotics AS (SELECT gt_id, p AS parent_path, p || '.a' || row_number() OVER (PARTITION BY gt_id, p ORDER BY o) AS node_path, {_json_name("Name")} AS node_name FROM (SELECT gt_id, p, o, m AS b FROM h))
"""

# Problem 1 from tokens: names are runs of tokens, and what cuts a value is told by the tokens before it.
_SEP = r",;|&/+、，；·•\t\r\n"
_TOKEN = rf"\([^()]*\)|\[[^\[\]]*\]|[{_SEP}\s\p{{Z}}]+|[\p{{L}}\p{{N}}]+|(?s:.)"
_QUOTE = '"“”„‟«»‹›'
_VALUES = rf"""
WITH d AS (SELECT DISTINCT gt_id, gt_json AS j FROM gt_records WHERE gt_json IS NOT NULL),
f AS (SELECT gt_id, CASE WHEN json_valid(j) THEN j ELSE regexp_replace(j, ',(\s*[}}\]])', '\1', 'g') END AS j FROM d),
v AS (SELECT gt_id, json_extract(j, '$.isolates_with_linking') AS l, json_extract(j, '$.no_isolates_only_assayinformation') AS o FROM f WHERE json_valid(j)),
bodies AS (SELECT gt_id, 'iwl' AS section_name, row_number() OVER (PARTITION BY gt_id ORDER BY t.id)::INTEGER AS isolate_pos, t.value AS b FROM v, json_each(l) t WHERE json_type(l) IN ('ARRAY', 'OBJECT')
  UNION ALL SELECT gt_id, 'nioai', 0, o FROM v),
fields AS (SELECT gt_id, section_name, isolate_pos, field_name, json_extract(b, '$.' || field_name) AS x FROM bodies, (VALUES ('ast_data'), ('amr')) n(field_name) WHERE json_type(b) = 'OBJECT'),
parts AS (SELECT *, 1 AS part, json_extract_string(x, '$') AS s FROM fields WHERE json_type(x) = 'VARCHAR'
  UNION ALL SELECT p.*, t.id, json_extract_string(t.value, '$') FROM fields p, json_each(p.x) t WHERE json_type(p.x) = 'ARRAY' AND json_type(t.value) = 'VARCHAR'
    AND NOT list_has_any(list_transform(from_json(p.x, '["JSON"]'), lambda m: json_type(m)), ['OBJECT', 'ARRAY'])),
marked AS (SELECT * EXCLUDE (x, s), regexp_replace(regexp_replace(regexp_replace(s, '[{_QUOTE}]', chr(1), 'g'), '(^|[\s\p{{Z}}{_SEP}])''([^\s''])', '\1' || chr(1) || '\2', 'g'), '([^\s''(])''($|[\s\p{{Z}}{_SEP}])', '\1' || chr(1) || '\2', 'g') AS m FROM parts),
pieces AS (SELECT * EXCLUDE (m), string_split(m, chr(1)) AS ps FROM marked),
piece AS (SELECT * EXCLUDE (ps), len(ps) AS n_pieces, unnest(range(len(ps))) AS k, unnest(ps) AS piece FROM pieces),
toks AS (SELECT *, k % 2 = 1 AND k < n_pieces - 1 AS literal, regexp_extract_all(piece, '{_TOKEN}') AS t FROM piece),
names AS (SELECT DISTINCT lower(trim(n)) AS n, regexp_extract_all(lower(trim(n)), '{_TOKEN}') AS t FROM (SELECT unnest([abbrev, full_name]) AS n FROM legend) WHERE trim(n) <> ''),
single AS (SELECT * EXCLUDE (t), unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w, t FROM toks WHERE NOT literal),
starts AS (SELECT s.gt_id, section_name, isolate_pos, field_name, part, k, i, max(len(names.t)) AS n FROM single s JOIN names ON lower(w) = names.t[1] AND list_transform(s.t[i:i + len(names.t) - 1], lambda z: lower(z)) = names.t GROUP BY ALL),
kept AS (SELECT * FROM starts a WHERE NOT EXISTS (SELECT 1 FROM starts b WHERE b.gt_id = a.gt_id AND b.section_name = a.section_name AND b.isolate_pos = a.isolate_pos AND b.field_name = a.field_name AND b.part = a.part AND b.k = a.k AND b.i < a.i AND b.i + b.n > a.i)),
tokens AS (
  SELECT gt_id, section_name, isolate_pos, field_name, part, k, 0 AS i, 'n' AS kind, trim(piece, ' ') AS t FROM toks WHERE literal AND trim(piece, ' ') <> ''
  UNION ALL SELECT gt_id, section_name, isolate_pos, field_name, part, k, i, 'n', array_to_string(t[i:i + n - 1], '') FROM kept JOIN single USING (gt_id, section_name, isolate_pos, field_name, part, k, i)
  UNION ALL SELECT gt_id, section_name, isolate_pos, field_name, part, k, i, CASE WHEN regexp_full_match(w, '(?i)(?:[{_SEP}\s\p{{Z}}]+|-|and)') THEN 's' ELSE 'w' END, w FROM single s
    WHERE NOT EXISTS (SELECT 1 FROM kept b WHERE b.gt_id = s.gt_id AND b.section_name = s.section_name AND b.isolate_pos = s.isolate_pos AND b.field_name = s.field_name AND b.part = s.part AND b.k = s.k AND b.i <= s.i AND b.i + b.n > s.i)),
placed AS (SELECT *, row_number() OVER w AS p FROM tokens WINDOW w AS (PARTITION BY gt_id, section_name, isolate_pos, field_name, part ORDER BY k, i)),
seen AS (SELECT *, count(*) FILTER (kind = 'n') OVER w AS named, max(p) FILTER (kind <> 's') OVER w AS word_at, last_value(CASE WHEN kind <> 's' THEN t END IGNORE NULLS) OVER w AS word,
  max(p) FILTER (kind = 's' AND NOT regexp_full_match(t, '[ \p{{Zs}}]*')) OVER w AS apart_at FROM placed
  WINDOW w AS (PARTITION BY gt_id, section_name, isolate_pos, field_name, part ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (SELECT *, sum(CASE WHEN kind = 'n' AND named > 0 AND NOT (ends_with(word, ':') AND coalesce(apart_at < word_at, true)) THEN 1 ELSE 0 END) OVER (PARTITION BY gt_id, section_name, isolate_pos, field_name, part ORDER BY p) AS g FROM seen),
ends AS (SELECT *, min(p) FILTER (kind <> 's') OVER w AS a, max(p) FILTER (kind <> 's') OVER w AS z FROM cuts WINDOW w AS (PARTITION BY gt_id, section_name, isolate_pos, field_name, part, g)),
items AS (SELECT gt_id, section_name, isolate_pos, field_name, part, g, regexp_replace(string_agg(t, '' ORDER BY p), '^[\s\p{{Z}}\x01]+|[\s\p{{Z}}\x01]+$', '', 'g') AS item_value FROM ends WHERE p BETWEEN a AND z GROUP BY ALL),
found AS (SELECT gt_id, section_name, isolate_pos, field_name, row_number() OVER (PARTITION BY gt_id, section_name, isolate_pos, field_name ORDER BY part, g)::INTEGER AS item_pos, item_value FROM items WHERE item_value <> '')
"""

ORACLE = {
    "p1_found": _VALUES + "SELECT * FROM found",
    "p1_value_counts": _VALUES + "SELECT section_name, field_name, n_values, count(*) AS n_fields FROM (SELECT gt_id, section_name, isolate_pos, field_name, count(*) AS n_values FROM found GROUP BY ALL) GROUP BY ALL",
    **{f"p2_{t}": _JSON_NODES + f"SELECT gt_id AS root_id, parent_path, node_path, node_name FROM {t}" for t in ("isolates", "envelopes", "antibiotics")},
    "p6_found": _ORPHANS + "SELECT table_name, row_id FROM found",
    "p6_by_month": _ORPHANS + "SELECT table_name, strftime(t, '%Y-%m') AS month, count(*) AS orphans FROM found GROUP BY ALL",
}
