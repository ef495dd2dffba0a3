"""Queries of the training-text problems (3, 4, 5, 7, 8 and 9), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.keys import plain_pmcid
from evalweave.llm.bpe import decoded, token_count, token_ids
from evalweave.llm.charforms import inconsistent_values
from evalweave.llm.mixing import Blend
from evalweave.llm.overlap import cross_split_overlaps, overlap_counts
from evalweave.llm.residue import with_residue
from evalweave.llm.truncation import cut_off_share, scored
from evalweave.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistent_values(table(spark, sf_dir, "gt_records"))


def p3_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inconsistent values per section and field."""
    return p3_found(spark, sf_dir).groupBy("section_name", "field_name").agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("gt_id").alias("n_records"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "extraction_results"), "extraction_id", "raw_model_output", ["model_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("cut_off").select("extraction_id").distinct()


def p4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model's outputs were cut off."""
    return cut_off_share(_scored(spark, sf_dir), "model_id")


_SPLIT_TABLES = ("record_results", "gepa_experiments", "split_catalog", "documents")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_split_overlaps(*(table(spark, sf_dir, t) for t in _SPLIT_TABLES))
    return found.select("split_name", F.least("eval_pmcid", "train_pmcid").alias("pmcid_a"), F.greatest("eval_pmcid", "train_pmcid").alias("pmcid_b")).distinct()


def p5_by_split_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated articles that overlap with training, per split and source of their text."""
    found = overlap_counts(*(table(spark, sf_dir, t) for t in _SPLIT_TABLES)).withColumnRenamed("eval_pmcid", "k")
    documents = table(spark, sf_dir, "documents").where("doc_type = 'article'")
    sources = documents.select(plain_pmcid(F.col("pmcid")).alias("k"), "source").where("k is not null").groupBy("k").agg(F.min("source").alias("source"))
    joined = found.join(sources, "k", "left")
    return joined.groupBy("split_name", "source").agg(F.count(F.lit(1)).alias("n_articles"), F.sum("n").alias("n_overlaps"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per language."""
    counted = table(spark, sf_dir, "documents").select("lang", token_count(F.col("text")).alias("n"))
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").cast("bigint").alias("n_tokens"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language, and how many of them their ids decode to; null decodes to the empty text."""
    ids = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text"), token_ids(F.col("text")).alias("ids"))
    same = ids.select("lang", F.col("text").eqNullSafe(decoded(F.col("ids"))).alias("same"))
    return same.groupBy("lang").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("same").alias("n_same"))


def _blend(spark: SparkSession, sf_dir: str) -> Blend:
    return Blend(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blend(spark, sf_dir).rows()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blend(spark, sf_dir).shares()


def p8_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the largest blend in which no cap binds."""
    return Blend(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total_tokens="exact").shares()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_residue(table(spark, sf_dir, "documents").select("doc_id", "text")).where("residue is not null").select("doc_id")


def p9_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left out of the corpus, by source and kind of residue."""
    found = with_residue(table(spark, sf_dir, "documents").select("source", "text")).where("residue is not null")
    return found.groupBy("source", "residue").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus that is left: all columns of the documents that hold no residue."""
    return with_residue(table(spark, sf_dir, "documents")).where("residue is null").drop("residue")


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_by_field, p4_found, p4_share, p5_found, p5_by_split_and_source, p7_ids, p7_counts, p7_round_trip, p8_blend, p8_shares, p8_shares_exact, p9_found, p9_by_source, p9_corpus)
}

_PMCID = "'PMC' || nullif(regexp_replace(regexp_extract({0}, '(?i)^\\s*(?:PMC)?[^0-9A-Za-z]*([0-9]+)(?:\\.[0-9]+)?\\s*$', 1), '^0+([0-9])', '\\1'), '')"

_NEAR = f"""
WITH ex AS (SELECT DISTINCT experiment_id, split_name FROM gepa_experiments WHERE experiment_id IS NOT NULL AND split_name IS NOT NULL),
m AS (SELECT DISTINCT {_PMCID.format("pmcid")} AS k, split_name, split_role FROM record_results JOIN ex USING (experiment_id)
  JOIN (SELECT DISTINCT split_name, split_role FROM split_catalog) USING (split_name)),
ev AS (SELECT k, split_name FROM m WHERE split_role = 'eval' AND k IS NOT NULL),
tr AS (SELECT DISTINCT k FROM m WHERE split_role = 'train' AND k IS NOT NULL),
w AS (SELECT {_PMCID.format("pmcid")} AS k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM documents WHERE doc_type = 'article' AND text IS NOT NULL),
s AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3 AND k IS NOT NULL)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT x.k AS a, y.k AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.k < y.k GROUP BY ALL),
near AS (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 2 * o >= x.n + y.n - o)
"""

_P5 = (
    _NEAR
    + """SELECT DISTINCT split_name, pmcid_a, pmcid_b FROM (
  SELECT split_name, k AS pmcid_a, k AS pmcid_b FROM ev JOIN tr USING (k)
  UNION ALL SELECT split_name, a, b FROM near JOIN ev ON ev.k = a JOIN tr ON tr.k = b
  UNION ALL SELECT split_name, a, b FROM near JOIN ev ON ev.k = b JOIN tr ON tr.k = a)"""
)

_P5_COUNTS = (
    _NEAR
    + f""", found AS (SELECT split_name, k, k AS t FROM ev JOIN tr USING (k)
  UNION ALL SELECT split_name, a, b FROM near JOIN ev ON ev.k = a JOIN tr ON tr.k = b
  UNION ALL SELECT split_name, b, a FROM near JOIN ev ON ev.k = b JOIN tr ON tr.k = a),
src AS (SELECT {_PMCID.format("pmcid")} AS k, min(source) AS source FROM documents WHERE doc_type = 'article' GROUP BY ALL)
SELECT split_name, source, count(DISTINCT k) AS n_articles, count(*) AS n_overlaps FROM found LEFT JOIN src USING (k) GROUP BY ALL"""
)

#: The other queries are beyond SQL and tested against brute force, a library, round trips or held-out values.
ORACLE: dict[str, str] = {"p5_found": _P5, "p5_by_split_and_source": _P5_COUNTS, "p7_round_trip": "SELECT lang, count(*) AS n_documents, count(*) AS n_same FROM documents GROUP BY ALL"}
