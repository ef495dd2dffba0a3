"""Items derived from ``lineitem`` by integer arithmetic, so that Spark and SQL agree on the inputs.

An order is a document; a line is a cell of an isolate. The extracted side is
spelled otherwise, loses lines and renames isolates, all by fixed remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import normalise as N
from evalweave.session import table

_POS = "l_linenumber * 100000000L + l_partkey * 1000 + l_suppkey"
_NAME = "element_at(array('Typhimurium', 'Enteritidis', 'Kentucky'), cast(l_suppkey % 3 as int) + 1)"
_FIELD = "element_at(array('Serovar', 'ST', 'AMR_Genes', 'Plasmids'), cast(l_linenumber % 4 as int) + 1)"
_GT = f"""case l_linenumber % 4 when 0 then 'Salmonella ' || {_NAME} when 1 then 'ST-' || (l_partkey % 20)
  when 2 then 'bla_TEM-' || (l_partkey % 9) || 'B' else 'Inc ' || (l_suppkey % 7) || ' (copy)' end"""
_EXT = f"""case l_linenumber % 4 when 0 then case when (l_orderkey + l_linenumber) % 3 = 0 then 'S. ' || {_NAME} || ' var' else lower({_NAME}) end
  when 1 then cast(l_partkey % 20 as string) when 2 then 'blaTEM' || (l_partkey % 9) || 'b' else 'inc-' || (l_suppkey % 7) end"""
_ISO = "'iso' || (l_partkey % 5)"
_EXT_ISO = f"case when (l_orderkey * 3 + l_partkey) % 5 = 0 then 'x' || {_ISO} else {_ISO} end"


def _items(lines: DataFrame, iso: str, raw: str) -> DataFrame:
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.expr(iso).alias("iso_id"), N.field_name(F.expr(_FIELD)).alias("field"), F.expr(raw).alias("raw"), F.expr(_POS).alias("pos"))
    rows = rows.withColumn("norm", N.scalar_value(F.col("field"), F.col("raw")))
    return rows.groupBy("doc_id", "iso_id", "field").agg(F.min("pos").alias("pos"), F.max_by("norm", "pos").alias("norm"))


def items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ground-truth and extracted items, one row per document, isolate and field."""
    lines = table(spark, sf_dir, "lineitem")
    return _items(lines, _ISO, _GT), _items(lines.where("(l_orderkey + l_partkey) % 7 <> 0"), _EXT_ISO, _EXT)


_S_NAME = "(['Typhimurium', 'Enteritidis', 'Kentucky'])[l_suppkey % 3 + 1]"
_S_GT = f"""CASE l_linenumber % 4 WHEN 0 THEN 'Salmonella ' || {_S_NAME} WHEN 1 THEN 'ST-' || (l_partkey % 20)
  WHEN 2 THEN 'bla_TEM-' || (l_partkey % 9) || 'B' ELSE 'Inc ' || (l_suppkey % 7) || ' (copy)' END"""
_S_EXT = f"""CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'S. ' || {_S_NAME} || ' var' ELSE lower({_S_NAME}) END
  WHEN 1 THEN CAST(l_partkey % 20 AS VARCHAR) WHEN 2 THEN 'blaTEM' || (l_partkey % 9) || 'b' ELSE 'inc-' || (l_suppkey % 7) END"""
_S_FIELD = "(['serotype', 'mlst', 'amr', 'plasmid'])[l_linenumber % 4 + 1]"
_S_NORM = """CASE field WHEN 'serotype' THEN lower(regexp_replace(raw, '^(?i)(salmonella\\s+|s\\.\\s+)', ''))
  WHEN 'mlst' THEN CASE WHEN regexp_matches(raw, '^(?i)(st[- ]?)?[0-9]+$') THEN 'st' || regexp_extract(raw, '([0-9]+)$', 1) ELSE lower(replace(replace(raw, '-', ''), ' ', '')) END
  WHEN 'amr' THEN lower(replace(replace(replace(raw, '-', ''), '_', ''), ' ', ''))
  ELSE replace(replace(replace(regexp_replace(lower(raw), '\\s*\\([^)]*\\)', '', 'g'), '-', ''), '_', ''), ' ', '') END"""


def _sql_items(iso: str, raw: str, where: str) -> str:
    return f"""SELECT doc_id, iso_id, field, min(pos) AS pos, arg_max(norm, pos) AS norm FROM (
  SELECT *, {_S_NORM} AS norm FROM (
    SELECT l_orderkey AS doc_id, {iso} AS iso_id, {_S_FIELD} AS field, {raw} AS raw,
      l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS pos FROM lineitem WHERE {where}))
  GROUP BY ALL"""


SQL_ITEMS = f"""WITH gt AS ({_sql_items(_ISO, _S_GT, "true")}),
ext AS ({_sql_items(_EXT_ISO, _S_EXT, "(l_orderkey + l_partkey) % 7 <> 0")}),
ex AS (SELECT e.*, g.iso_id IS NOT NULL AS exact FROM ext e LEFT JOIN gt g USING (doc_id, iso_id, field, norm)),
rep AS (SELECT doc_id, field, norm, arg_min(iso_id, pos) AS rep_iso FROM gt GROUP BY ALL),
w AS (SELECT ex.*, rep_iso,
    min(CASE WHEN exact AND ex.iso_id = rep_iso THEN ex.pos END) OVER (PARTITION BY ex.doc_id, ex.field, ex.norm) AS taken,
    row_number() OVER (PARTITION BY ex.doc_id, ex.field, ex.norm, exact ORDER BY ex.pos) AS turn
  FROM ex LEFT JOIN rep USING (doc_id, field, norm)),
e AS (SELECT *, NOT exact AND rep_iso IS NOT NULL AND turn = 1 AND (taken IS NULL OR taken > pos) AS lenient FROM w),
used AS (SELECT doc_id, iso_id, field FROM e WHERE exact UNION SELECT doc_id, rep_iso, field FROM e WHERE lenient),
g AS (SELECT gt.*, u.iso_id IS NOT NULL AS hit FROM gt LEFT JOIN used u USING (doc_id, iso_id, field)),
counts AS (
  SELECT doc_id, field, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT doc_id, field, CASE WHEN exact OR lenient THEN 1 ELSE 0 END AS tp, CASE WHEN exact OR lenient THEN 0 ELSE 1 END AS fp, 0 AS fn FROM e
    UNION ALL SELECT doc_id, field, 0, 0, 1 FROM g WHERE NOT hit) GROUP BY ALL)
"""
