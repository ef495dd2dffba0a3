"""Queries of the evaluation operators and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions import dates, text
from evalweave.functions.keys import file_key, plain_pmcid
from evalweave.operators import accession, ast_formats, budget, feedback, items, maintain, matching, ordered, resolve, scoring, stats
from evalweave.operators.packed import packed_items
from evalweave.operators.xmltext import article
from evalweave.plans import bridge
from evalweave.session import checkpointed, table
from evalweave.sources import files

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bridge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, ext = bridge.items(spark, sf_dir)
    return matching.hit_counts(matching.linked_cells(gt, ext), "doc_id", "field")


# --- matching and scoring over derived items ---------------------------------------------------------------


@query(bridge.SQL_ITEMS + "SELECT doc_id, cast(sum(tp) AS BIGINT) AS tp, cast(sum(fp) AS BIGINT) AS fp, cast(sum(fn) AS BIGINT) AS fn FROM counts GROUP BY ALL")
def match_linked(spark, sf_dir):
    """J-08, J-09: exact and lenient matches per document."""
    return _bridge_counts(spark, sf_dir).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query(
    bridge.SQL_ITEMS
    + """SELECT field, cast(sum(tp) AS BIGINT) AS tp, cast(sum(fp) AS BIGINT) AS fp, cast(sum(fn) AS BIGINT) AS fn,
  round(2 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM counts GROUP BY ALL"""
)
def match_by_field(spark, sf_dir):
    """J-10, AGG-05: counts and F1 per field."""
    rows = _bridge_counts(spark, sf_dir).groupBy("field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return rows.withColumn("f1", F.round(scoring.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


@query(
    bridge.SQL_ITEMS
    + """SELECT e.doc_id, e.field, e.iso_id AS iso_id, e.norm, list_contains(list_distinct(string_split(e.norm, ' ')), 'x') AS has_x FROM e WHERE NOT exact AND NOT lenient"""
)
def match_wrong_items(spark, sf_dir):
    """SRT-04: the extracted items that match nothing."""
    gt, ext = bridge.items(spark, sf_dir)
    e, _ = matching.linked_matches(gt, ext)
    return e.where("not hit").select("doc_id", "field", "iso_id", "norm", F.array_contains(F.array_distinct(F.split("norm", " ")), "x").alias("has_x"))


# greedy: each wrong item in turn takes the first missed one that is still free and whose words it holds, or is held by
_WORDS_OF = "list_distinct(string_split({0}, ' '))"
_HELD = f"CASE WHEN len({_WORDS_OF.format('f')}) <= len({_WORDS_OF.format('x[1]')}) THEN list_has_all({_WORDS_OF.format('x[1]')}, {_WORDS_OF.format('f')}) ELSE list_has_all({_WORDS_OF.format('f')}, {_WORDS_OF.format('x[1]')}) END"
_TAKEN = f"coalesce(nullif(list_position(list_transform(free, lambda f: {_HELD}), true), 0), len(free) + 1)"


@query(
    bridge.SQL_ITEMS
    + f""", missed AS (SELECT doc_id, field, list(norm ORDER BY pos, norm) AS missed FROM g WHERE NOT hit GROUP BY ALL),
wrong AS (SELECT doc_id, field, list([norm] ORDER BY pos, norm) AS wrong FROM e WHERE NOT exact AND NOT lenient GROUP BY ALL),
r AS (SELECT doc_id, field, len(missed) - len(list_reduce(list_prepend(missed, wrong), lambda free, x: list_concat(free[:{_TAKEN} - 1], free[{_TAKEN} + 1:]))) AS recovered FROM missed JOIN wrong USING (doc_id, field))
SELECT doc_id, field, recovered FROM r WHERE recovered > 0"""
)
def match_recovered(spark, sf_dir):
    """J-13, TXT-10: wrong items that hold the tokens of a missed one, greedily one to one."""
    gt, ext = bridge.items(spark, sf_dir)
    e, g = matching.linked_matches(gt, ext)
    return matching.recovered(g.where("not hit"), e.where("not hit")).where("recovered > 0")


@query(
    bridge.SQL_ITEMS
    + """, gs AS (SELECT DISTINCT doc_id, lower(iso_id) AS norm FROM gt), es AS (SELECT DISTINCT doc_id, lower(iso_id) AS norm FROM ext)
SELECT coalesce(gs.doc_id, es.doc_id) AS doc_id, count(gs.norm) FILTER (es.norm IS NOT NULL) AS tp, count(*) FILTER (gs.norm IS NULL) AS fp, count(*) FILTER (es.norm IS NULL) AS fn
FROM gs FULL JOIN es ON gs.doc_id = es.doc_id AND gs.norm = es.norm GROUP BY ALL"""
)
def match_id_sets(spark, sf_dir):
    """SET-01, SET-05: intersection and differences of the sets of isolate ids per document."""
    gt, ext = bridge.items(spark, sf_dir)
    ids = lambda df: df.select("doc_id", F.lower("iso_id").alias("norm"))
    return matching.id_sets(ids(gt), ids(ext))


@query(
    bridge.SQL_ITEMS
    + """, m AS (SELECT doc_id, true AS ex, EXISTS (SELECT 1 FROM gt WHERE gt.doc_id = ext.doc_id AND gt.field = ext.field AND gt.norm = ext.norm) AS hit FROM ext
  UNION ALL SELECT doc_id, false, EXISTS (SELECT 1 FROM ext WHERE gt.doc_id = ext.doc_id AND gt.field = ext.field AND gt.norm = ext.norm) FROM gt)
SELECT doc_id, count(*) FILTER (ex AND hit) AS tp, count(*) FILTER (ex AND NOT hit) AS fp, count(*) FILTER (NOT ex AND NOT hit) AS fn FROM m GROUP BY ALL"""
)
def match_bare(spark, sf_dir):
    """J-11: items matched by field and value alone, as fields without isolates are."""
    gt, ext = bridge.items(spark, sf_dir)
    return matching.hit_counts(matching.bare_cells(gt, ext), "doc_id")


@query(
    bridge.SQL_ITEMS
    + """, k AS (SELECT doc_id, field, norm, iso_id, count(*) FILTER (s = 'g') AS g, count(*) FILTER (s = 'e') AS e FROM
  (SELECT doc_id, field, norm, iso_id, 'g' AS s FROM gt UNION ALL SELECT doc_id, field, norm, iso_id, 'e' FROM ext) GROUP BY ALL),
d AS (SELECT doc_id, sum(least(g, e))::BIGINT AS tp, sum(e - least(g, e))::BIGINT AS fp, 0 AS up, sum(g - least(g, e))::BIGINT AS fn FROM k GROUP BY ALL)
SELECT doc_id, tp, fp, up::BIGINT AS up, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM d"""
)
def match_pilot(spark, sf_dir):
    """J-14: the pilot's one-to-one match by field, value and id."""
    gt, ext = bridge.items(spark, sf_dir)
    rows = matching.pilot_match(gt, ext).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "up", "fn")])
    return rows.withColumn("f1", F.round(scoring.pilot_f1(F.col("tp"), F.col("fp"), F.col("up"), F.col("fn"))[1], 9))


@query()
def pilot_scores(spark, sf_dir):
    """J-14, AGG-08: the pilot's match of outputs with ground truth; wrong values that stand in the article are uncertain. Its three F1 scores."""
    _, gt, ext = _both_items(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").where("doc_type = 'article' and text is not null").select(plain_pmcid(F.col("pmcid")).alias("doc_id"), "text")
    named = lambda df: df.withColumn("iso_id", F.coalesce("iso_id", F.lit("NO_ISOLATE_ID")))
    rows = matching.pilot_match(named(gt), named(ext), texts)
    low, mid, high = scoring.pilot_f1(F.col("tp"), F.col("fp"), F.col("up"), F.col("fn"))
    return rows.withColumns({"conservative_f1": low, "primary_f1": mid, "optimistic_f1": high})


# --- the pipeline over ground truth and raw output ---------------------------------------------------------


def _both_items(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest ground truth and output of each document that has both: the documents with raw, and both item tables.

    The latest are found by their ids, so texts only meet their own id, are read
    where they lie, and nothing but items is kept.
    """

    def last(name: str, id_col: str, text_col: str, time: str) -> DataFrame:
        rows = table(spark, sf_dir, name).where(F.col(text_col).isNotNull()).select(plain_pmcid(F.col("pmcid")).alias("doc_id"), id_col, time).where("doc_id is not null")
        return rows.groupBy("doc_id").agg(F.max_by(id_col, F.struct(time, id_col)).alias(id_col))

    ids = checkpointed(last("gt_records", "gt_id", "gt_json", "updated_at").join(last("extraction_results", "extraction_id", "raw_model_output", "created_at"), "doc_id"))
    gt = table(spark, sf_dir, "gt_records").where("gt_json is not null").select("gt_id", "gt_json").join(ids.select("doc_id", "gt_id"), "gt_id")
    out = table(spark, sf_dir, "extraction_results").select("extraction_id", F.col("raw_model_output").alias("raw")).where("raw is not null").join(ids.select("doc_id", "extraction_id"), "extraction_id")
    # repeats of a row give the same items
    return out.dropDuplicates(["doc_id"]), checkpointed(items.ground_truth_items(gt, "doc_id", "gt_json")), checkpointed(items.output_items(out, "doc_id", "raw"))


@query()
def score_documents(spark, sf_dir):
    """FLT-01, JSN-02, J-08 to J-13, AGG-01, AGG-06: latest outputs against latest ground truth, per document."""
    return scoring.score_documents(*_both_items(spark, sf_dir))


@query()
def score_by_category(spark, sf_dir):
    """AGG-02, AGG-03 over the scored documents: the flagship."""
    return scoring.aggregate(scoring.score_documents(*_both_items(spark, sf_dir)), "gt_category")


@query()
def ground_truth_items(spark, sf_dir):
    """FLT-01, NRM-01 to NRM-07: canonical items of the ground truth."""
    return items.ground_truth_items(table(spark, sf_dir, "gt_records").dropDuplicates(["gt_id"]), "gt_id", "gt_json")


@query()
def output_categories(spark, sf_dir):
    """JSN-06 to JSN-08: stated or inferred category of each output, with parse failures."""
    return items.output_categories(table(spark, sf_dir, "extraction_results").dropDuplicates(["extraction_id"]), "extraction_id", "raw_model_output")


@query()
def feedback_messages(spark, sf_dir):
    """UDX-02, P-09 to P-12, J-15, TXT-19: what went wrong, per document."""
    docs, gt, ext = _both_items(spark, sf_dir)
    scores = scoring.score_documents(docs, gt, ext)
    texts = table(spark, sf_dir, "documents").where("doc_type = 'article' and text is not null").select(plain_pmcid(F.col("pmcid")).alias("doc_id"), "text")
    gap = feedback.table_gap(gt.where("section = 'iwl'"), ext.where("section = 'iwl'"), texts)
    sections = items.output_categories(docs, "doc_id", "raw").select("doc_id", "iwl", "iwol", "bare")
    truth = items.categories(gt).select("doc_id", F.col("category").alias("gt_category"))
    linking = feedback.linking_failure(sections.join(truth, "doc_id")).select("doc_id", "linking")
    fields = feedback.unknown_fields(items.output_fields(docs, "doc_id", "raw"))
    return feedback.composed(scores, table_gap=gap, linking=linking, fields=fields, formulas=feedback.missed_formulas(gt, ext), population=feedback.population_values(ext))


# --- reports over stored results ---------------------------------------------------------------------------

_PLAIN = "'PMC' || nullif(regexp_replace(regexp_extract(pmcid, '(?i)^\\s*(?:PMC)?[^0-9A-Za-z]*([0-9]+)(?:\\.[0-9]+)?\\s*$', 1), '^0+([0-9])', '\\1'), '')"
_RESULTS = """WITH r AS (SELECT DISTINCT * FROM record_results), s AS (SELECT *, coalesce(gt_category, '') AS cat FROM r)
"""


def _results(spark, sf_dir) -> DataFrame:
    """Stored results, repeats dropped."""
    return table(spark, sf_dir, "record_results").distinct()


@query(
    _RESULTS
    + f"""SELECT CASE WHEN grouping(cat) = 1 THEN NULL ELSE cat END AS cat, count(*) AS n, round(avg(primary_f1), 9) AS mean_f1, median(primary_f1) AS median_f1,
  round(coalesce(stddev_samp(primary_f1), 0), 6) AS stdev_f1, min(primary_f1) AS min_f1, max(primary_f1) AS max_f1,
  cast(coalesce(sum(tp), 0) AS BIGINT) AS total_tp, cast(coalesce(sum(fp), 0) AS BIGINT) AS total_fp, cast(coalesce(sum(fn), 0) AS BIGINT) AS total_fn,
  round(coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS micro_f1, round(avg(loose_f1), 9) AS loose_mean_f1 FROM s GROUP BY ROLLUP (cat)"""
)
def report_summary(spark, sf_dir):
    """AGG-02, AGG-03: scores per category and over all (a rollup)."""
    results = _results(spark, sf_dir).withColumn("cat", F.coalesce("gt_category", F.lit("")))
    r = lambda c, n=6: F.round(c, n).alias(c)
    return scoring.aggregate(results, "cat").select(
        "cat", "n", r("mean_f1", 9), "median_f1", r("stdev_f1"), "min_f1", "max_f1", "total_tp", "total_fp", "total_fn", r("micro_f1"), r("loose_mean_f1", 9)
    )


@query(_RESULTS + "SELECT gt_category, ext_category, count(*) AS n FROM r GROUP BY ALL")
def report_confusion(spark, sf_dir):
    """AGG-04: documents per pair of categories."""
    return scoring.confusion(_results(spark, sf_dir))


@query(_RESULTS + "SELECT gt_category, ext_category, count(*) AS n FROM r GROUP BY ALL ORDER BY n DESC, gt_category NULLS FIRST, ext_category NULLS FIRST LIMIT 10")
def report_confusion_top(spark, sf_dir):
    """SRT-06: the ten commonest pairs (a top-k report)."""
    return scoring.confusion(_results(spark, sf_dir)).orderBy(F.desc("n"), F.asc_nulls_first("gt_category"), F.asc_nulls_first("ext_category")).limit(10)


@query(
    _RESULTS
    + f"""SELECT experiment_id, count(*) FILTER (primary_f1 = 0) AS zero, count(*) FILTER (primary_f1 > 0 AND primary_f1 < 0.5) AS below_half,
  count(*) FILTER (primary_f1 >= 0.5) AS half_or_more, round(avg(primary_f1), 9) AS mean_f1 FROM r GROUP BY ALL"""
)
def report_buckets(spark, sf_dir):
    """AGG-13: buckets of F1 per experiment."""
    return scoring.score_buckets(_results(spark, sf_dir), "experiment_id").withColumn("mean_f1", F.round("mean_f1", 9))


@query(_RESULTS + "SELECT result_id, primary_f1 FROM r WHERE primary_f1 IS NOT NULL ORDER BY primary_f1, result_id LIMIT 15")
def report_worst(spark, sf_dir):
    """SRT-01 to SRT-03: the worst fifteen (a top-k report)."""
    return _results(spark, sf_dir).where("primary_f1 is not null").select("result_id", "primary_f1").orderBy("primary_f1", "result_id").limit(15)


@query(
    _RESULTS
    + """SELECT result_id, CASE WHEN ext_category = 'NIOAI' THEN 1 WHEN ext_category = 'IWOL' THEN 2 ELSE 3 END AS pattern FROM r
WHERE gt_category = 'IWL' AND (ext_category IN ('NIOAI', 'IWOL') OR (ext_category = 'IWL' AND tp = 0))"""
)
def report_failure_patterns(spark, sf_dir):
    """P-04: the three ways linked truth was missed."""
    return scoring.failure_pattern(_results(spark, sf_dir)).select("result_id", "pattern")


@query(
    _RESULTS
    + """SELECT result_id, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS p, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS r,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM r"""
)
def report_rescored(spark, sf_dir):
    """AGG-01: precision, recall and F1 from stored counts."""
    rows = scoring.with_f1(_results(spark, sf_dir).select("result_id", "tp", "fp", "fn"))
    return rows.select("result_id", F.round("precision", 9).alias("p"), F.round("recall", 9).alias("r"), F.round("primary_f1", 9).alias("f1"))


@query(
    _RESULTS
    + f"""SELECT experiment_id, avg(CASE WHEN category_correct THEN 1 ELSE 0 END) AS accuracy, count(*) AS n, count(DISTINCT {_PLAIN}) AS n_pmcids,
  count(*) FILTER (error_message IS NOT NULL) AS n_errors FROM r GROUP BY ALL"""
)
def report_accuracy(spark, sf_dir):
    """AGG-04, AGG-10: category accuracy and distinct ids per experiment."""
    return _results(spark, sf_dir).groupBy("experiment_id").agg(
        F.avg(F.when(F.col("category_correct"), 1).otherwise(0)).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.count_distinct(plain_pmcid(F.col("pmcid"))).alias("n_pmcids"), F.count_if(F.col("error_message").isNotNull()).alias("n_errors")
    )


@query(
    _RESULTS
    + f"""SELECT gt_category, count(primary_f1) AS n, round(avg(primary_f1), 9) AS mean, quantile_cont(primary_f1, 0.25) AS q1, quantile_cont(primary_f1, 0.5) AS median,
  quantile_cont(primary_f1, 0.75) AS q3, round(quantile_cont(primary_f1, 0.75) - quantile_cont(primary_f1, 0.25), 9) AS iqr FROM r GROUP BY ALL"""
)
def report_descriptives(spark, sf_dir):
    """STA-05: quartiles of F1 per category."""
    rows = stats.descriptives(_results(spark, sf_dir), "primary_f1", "gt_category")
    return rows.withColumns({"mean": F.round("mean", 9), "iqr": F.round("iqr", 9)})


@query(
    _RESULTS
    + """SELECT CASE WHEN primary_f1 <= 0 THEN 0 WHEN primary_f1 < 0.2 THEN 1 WHEN primary_f1 < 0.4 THEN 2 WHEN primary_f1 < 0.6 THEN 3 WHEN primary_f1 < 0.8 THEN 4 ELSE 5 END AS bin,
  count(*) AS n FROM r WHERE primary_f1 IS NOT NULL GROUP BY ALL"""
)
def report_score_bins(spark, sf_dir):
    """STA-09: six bins of F1."""
    return _results(spark, sf_dir).where("primary_f1 is not null").groupBy(stats.score_bin(F.col("primary_f1")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _RESULTS
    + """, g AS (SELECT experiment_id, count(*) AS n, stddev_samp(primary_f1) AS s FROM r WHERE primary_f1 IS NOT NULL GROUP BY ALL)
SELECT experiment_id, n, round(coalesce(1.96 * s / sqrt(n), 0), 6) AS half_width FROM g"""
)
def report_intervals(spark, sf_dir):
    """STA-08: normal half-widths of mean F1 per experiment."""
    g = _results(spark, sf_dir).where("primary_f1 is not null").groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("primary_f1").alias("s"))
    return g.select("experiment_id", "n", F.round(stats.half_width(F.col("s"), F.col("n")), 6).alias("half_width"))


# --- selection, resolution, merging ------------------------------------------------------------------------

_KEYS = """WITH a AS (SELECT DISTINCT article_id, lower(trim(regexp_extract(xml_filepath, '([^/\\\\]*)$', 1))) AS k FROM articles WHERE xml_filepath IS NOT NULL AND trim(xml_filepath) <> ''),
f AS (SELECT lower(trim(regexp_extract(file_path, '([^/\\\\]*)$', 1))) AS k, file_path, CASE WHEN file_path LIKE '/mnt/%' THEN 1 ELSE 0 END AS golden FROM xml_files WHERE file_path IS NOT NULL),
m AS (SELECT k, min(file_path) AS p FROM f WHERE golden = 0 GROUP BY ALL), g AS (SELECT k, min(file_path) AS p FROM f WHERE golden = 1 GROUP BY ALL)
"""


def _listings(spark, sf_dir):
    files = table(spark, sf_dir, "xml_files").where("file_path is not null").withColumn("k", file_key(F.col("file_path")))
    golden = F.col("file_path").startswith("/mnt/")
    one = lambda cond: resolve.first_by_priority(files.where(cond), "k", "file_path")
    ids = table(spark, sf_dir, "articles").select("article_id", file_key(F.col("xml_filepath")).alias("k")).where("k is not null").distinct()
    return ids, one(~golden), one(golden)


@query(_KEYS + "SELECT article_id, coalesce(m.p, g.p) AS path FROM a LEFT JOIN m USING (k) LEFT JOIN g USING (k)")
def resolve_paths(spark, sf_dir):
    """J-01, J-03, J-05: main folder first, the other as fallback."""
    ids, main, golden = _listings(spark, sf_dir)
    return resolve.with_fallbacks(ids, "k", "path", main, golden).select("article_id", "path")


@query(_KEYS + "SELECT article_id, CASE WHEN article_id % 3 = 0 THEN coalesce(g.p, m.p) ELSE coalesce(m.p, g.p) END AS path FROM a LEFT JOIN m USING (k) LEFT JOIN g USING (k)")
def resolve_golden_first(spark, sf_dir):
    """J-02: an explicit set prefers the golden folder."""
    ids, main, golden = _listings(spark, sf_dir)
    return resolve.with_fallbacks(ids, "k", "path", main, golden, prefer=F.col("article_id") % 3 == 0).select("article_id", "path")


@query(_KEYS + "SELECT article_id FROM a WHERE k NOT IN (SELECT k FROM f)")
def resolve_missing(spark, sf_dir):
    """J-06: ids without a file."""
    ids, main, golden = _listings(spark, sf_dir)
    return resolve.missing(ids, main.select("k").unionByName(golden.select("k")), "k").select("article_id")


@query(f"""WITH x AS (SELECT DISTINCT extraction_id, {_PLAIN} AS pmcid, run_status FROM extraction_results)
SELECT DISTINCT pmcid FROM x WHERE pmcid IS NOT NULL AND pmcid NOT IN (SELECT pmcid FROM x WHERE run_status = 'completed' AND pmcid IS NOT NULL)""")
def resume_remaining(spark, sf_dir):
    """J-25, STR-02: ids that no run has completed."""
    rows = table(spark, sf_dir, "extraction_results").withColumn("pmcid", plain_pmcid(F.col("pmcid"))).where("pmcid is not null")
    return resolve.remaining(rows.select("pmcid").distinct(), rows.where("run_status = 'completed'"), "pmcid")


@query(f"""WITH x AS (SELECT DISTINCT extraction_id, {_PLAIN} AS pmcid, model_id, created_at FROM extraction_results)
SELECT pmcid, model_id, max(extraction_id) AS extraction_id FROM x JOIN (SELECT pmcid, model_id, max(created_at) AS created_at FROM x WHERE pmcid IS NOT NULL GROUP BY ALL) USING (pmcid, model_id, created_at) GROUP BY ALL""")
def latest_extractions(spark, sf_dir):
    """STR-03, W-05: the last extraction per document and model."""
    rows = table(spark, sf_dir, "extraction_results").select(plain_pmcid(F.col("pmcid")).alias("pmcid"), "model_id", "created_at", "extraction_id").where("pmcid is not null and model_id is not null")
    return resolve.latest(rows, ["pmcid", "model_id"], "created_at", "extraction_id").select("pmcid", "model_id", "extraction_id")


@query("""WITH e AS (SELECT DISTINCT experiment_id, split_name FROM gepa_experiments), r AS (SELECT DISTINCT result_id, experiment_id FROM record_results)
SELECT result_id FROM r JOIN e USING (experiment_id) JOIN (SELECT DISTINCT split_name, split_role FROM split_catalog) USING (split_name) WHERE split_role = 'eval'""")
def holdout_results(spark, sf_dir):
    """J-21, SET-06: results of evaluation splits."""
    results = table(spark, sf_dir, "record_results").select("result_id", "experiment_id").distinct()
    return resolve.of_roles(results, table(spark, sf_dir, "gepa_experiments"), table(spark, sf_dir, "split_catalog"), "eval").select("result_id")


@query("""WITH r AS (SELECT DISTINCT result_id, experiment_id, split_name FROM record_results LEFT JOIN (SELECT DISTINCT experiment_id, split_name FROM gepa_experiments) USING (experiment_id))
SELECT split_name, count(*) AS n FROM r GROUP BY ALL""")
def split_sizes(spark, sf_dir):
    """SRC-14 to SRC-16, SET-04: results per split, null for none."""
    return resolve.split_counts(table(spark, sf_dir, "record_results").select("result_id", "experiment_id").distinct(), table(spark, sf_dir, "gepa_experiments"))


@query(f"""WITH g AS (SELECT {_PLAIN} AS id, max(gt_json IS NOT NULL) AS has FROM gt_records GROUP BY ALL),
t AS (SELECT {_PLAIN} AS id, max(text) AS text FROM documents WHERE doc_type = 'article' GROUP BY ALL),
x AS (SELECT DISTINCT {_PLAIN} AS id FROM articles)
SELECT coalesce(CASE WHEN coalesce(trim(text, ' '), '') = '' THEN 'no text' WHEN NOT coalesce(has, false) THEN 'no ground truth' END, 'ready') AS reason, count(*) AS n FROM x LEFT JOIN g USING (id) LEFT JOIN t USING (id) WHERE id IS NOT NULL GROUP BY ALL""")
def examples_by_reason(spark, sf_dir):
    """J-07: loaded articles that have text and ground truth, and why the others can't serve as examples."""
    key = plain_pmcid(F.col("pmcid")).alias("id")
    ids = table(spark, sf_dir, "articles").select(key).where("id is not null")
    texts = table(spark, sf_dir, "documents").where("doc_type = 'article'").select(key, "text").groupBy("id").agg(F.max("text").alias("text"))
    gt = table(spark, sf_dir, "gt_records").where("gt_json is not null").select(key).where("id is not null").distinct().withColumn("gt", F.lit(True))
    good, rest = resolve.examples(ids, texts, gt, "id", "text", "gt")
    return good.select(F.lit("ready").alias("reason")).unionByName(rest.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- budgets, costs, counters ------------------------------------------------------------------------------


@query("""SELECT event_id, cast(sum(cast(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM
(SELECT event_id, user_id, ts, value FROM events)""")
def budget_window(spark, sf_dir):
    """W-03: tokens used in the hour up to each event (the window is a parameter)."""
    ledger = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    return budget.used_in_window(ledger, "user_id", "ts", "tokens", 3600).select("event_id", "used")


@query("""WITH r AS (SELECT event_id, user_id AS u, cast(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, cast(value * 100 AS BIGINT) AS n FROM events),
t AS (SELECT u, s, sum(n) AS n FROM r GROUP BY ALL),
c AS (SELECT u, s, sum(n) OVER (PARTITION BY u ORDER BY s) AS c, sum(n) OVER (PARTITION BY u ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS w FROM t),
f AS (SELECT x.u, x.s, min(y.s) AS freed FROM c x JOIN c y ON x.u = y.u AND y.c >= x.c - 5000 WHERE x.w > 5000 GROUP BY ALL)
SELECT event_id, CASE WHEN w <= 5000 THEN 0 ELSE freed + 3601 - r.s END AS wait_s FROM r JOIN c USING (u, s) LEFT JOIN f USING (u, s)""")
def budget_waits(spark, sf_dir):
    """W-04: the wait until 5,000 tokens fit under 10,000 an hour."""
    ledger = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    return budget.waits(ledger, "user_id", "ts", "tokens", 10_000, 5_000, 3600).select("event_id", "wait_s")


@query("""WITH x AS (SELECT DISTINCT extraction_id, model_id, token_count_input, token_count_output FROM extraction_results),
p(price, usd_in, usd_out) AS (VALUES ('small', 1.0::DOUBLE, 5.0::DOUBLE), ('medium', 3.0, 15.0), ('large', 5.0, 25.0)),
y AS (SELECT *, CASE WHEN model_id LIKE '%mini%' OR model_id LIKE '%8b%' THEN 'small' WHEN model_id LIKE '%flash%' THEN 'medium' WHEN model_id LIKE '%large%' THEN 'large' ELSE 'none' END AS price FROM x)
SELECT model_id, count(*) AS n, cast(sum(token_count_input) AS BIGINT) AS tokens_in, cast(sum(token_count_output) AS BIGINT) AS tokens_out,
  round(sum(coalesce((coalesce(token_count_input, 0) * usd_in + coalesce(token_count_output, 0) * usd_out) / 1e6, 0)), 6) AS usd FROM y LEFT JOIN p USING (price) GROUP BY ALL""")
def cost_by_model(spark, sf_dir):
    """MTH-01, AGG-09: tokens and cost per model."""
    m = F.col("model_id")
    price = F.when(m.like("%mini%") | m.like("%8b%"), "small").when(m.like("%flash%"), "medium").when(m.like("%large%"), "large").otherwise("none")
    rows = table(spark, sf_dir, "extraction_results").select("extraction_id", "model_id", "token_count_input", "token_count_output").distinct().withColumn("price", price)
    prices = spark.createDataFrame(budget.PRICES, "price string, usd_in double, usd_out double")
    priced = rows.join(F.broadcast(prices), "price", "left")
    usd = budget.cost(F.col("token_count_input"), F.col("token_count_output"), F.col("usd_in"), F.col("usd_out"))
    return priced.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count_input").alias("tokens_in"), F.sum("token_count_output").alias("tokens_out"), F.round(F.sum(usd), 6).alias("usd"))


@query("""WITH x AS (SELECT DISTINCT extraction_id, model_id, run_status FROM extraction_results)
SELECT model_id, count(*) AS total, count(*) FILTER (run_status IN ('success', 'found', 'completed')) AS found, count(*) FILTER (run_status IN ('failed', 'fetch_failed')) AS failed,
  count(*) FILTER (run_status = 'not_found') AS not_found, count(*) FILTER (run_status IS NULL) AS not_attempted,
  round(count(*) FILTER (run_status IN ('success', 'found', 'completed')) * 100.0 / count(*), 6) AS rate FROM x GROUP BY ALL""")
def status_by_model(spark, sf_dir):
    """AGG-12, MTH-04: statuses and success rate per model."""
    rows = table(spark, sf_dir, "extraction_results").select("extraction_id", "model_id", "run_status").distinct()
    return budget.status_counts(rows, "run_status", "model_id").withColumn("rate", F.round("rate", 6))


@query("""WITH x AS (SELECT row_number() OVER (ORDER BY extraction_id) AS i, processing_time_ms AS ms, token_count_output AS t FROM (SELECT DISTINCT extraction_id, processing_time_ms, token_count_output FROM extraction_results)),
s AS (SELECT i, sum(ms) OVER (ORDER BY i) AS ms, sum(t) OVER (ORDER BY i) AS t, max(i) OVER () AS m FROM x)
SELECT i, cast(i AS BIGINT) AS n, cast(ms AS BIGINT) AS ms, cast(t AS BIGINT) AS t FROM s WHERE i % 10 = 0 OR i = m""")
def running_progress(spark, sf_dir):
    """W-06, AGG-19: totals after every ten documents."""
    rows = table(spark, sf_dir, "extraction_results").select("extraction_id", F.col("processing_time_ms").alias("ms"), F.col("token_count_output").cast("bigint").alias("t")).distinct()
    return budget.running_totals(ordered.numbered(rows, "extraction_id"), "i", 10, "ms", "t")


@query("""SELECT source, count(*) AS n_documents, cast(sum(length(text) // 4) AS BIGINT) AS n_tokens, round(sum(length(text) // 4)::DOUBLE / count(*), 6) AS mean_tokens FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def size_by_source(spark, sf_dir):
    """AGG-20, TXT-04: documents and estimated tokens per source."""
    rows = table(spark, sf_dir, "documents").select("source", text.estimated_tokens(F.col("text")).alias("tokens"))
    return budget.size_summary(rows, "tokens", "source").withColumn("mean_tokens", F.round("mean_tokens", 6))


# --- statistics --------------------------------------------------------------------------------------------

_PAIRS = f"""WITH r AS (SELECT DISTINCT * REPLACE ({_PLAIN} AS pmcid) FROM record_results), b AS (SELECT pmcid, max(primary_f1) FILTER (result_id % 2 = 0) AS a, max(primary_f1) FILTER (result_id % 2 = 1) AS b,
  bool_or(category_correct) FILTER (result_id % 2 = 0) AS ca, bool_or(category_correct) FILTER (result_id % 2 = 1) AS cb FROM r WHERE pmcid IS NOT NULL GROUP BY ALL),
p AS (SELECT * FROM b WHERE a IS NOT NULL AND b IS NOT NULL AND ca IS NOT NULL AND cb IS NOT NULL)
"""


def _pairs(spark, sf_dir):
    even = F.col("result_id") % 2 == 0
    pick = lambda f, c, cond: f(F.when(cond, F.col(c)))
    rows = _results(spark, sf_dir).withColumn("pmcid", plain_pmcid(F.col("pmcid"))).where("pmcid is not null").groupBy("pmcid").agg(
        pick(F.max, "primary_f1", even).alias("a"), pick(F.max, "primary_f1", ~even).alias("b"), pick(F.bool_or, "category_correct", even).alias("ca"), pick(F.bool_or, "category_correct", ~even).alias("cb")
    )
    return rows.dropna(subset=["a", "b", "ca", "cb"])


@query(
    _PAIRS
    + """, d AS (SELECT round(a - b, 12) AS d FROM p WHERE round(a - b, 12) <> 0), k AS (SELECT abs(d) AS s, count(*) AS k, count(*) FILTER (d > 0) AS plus FROM d GROUP BY ALL),
q AS (SELECT *, coalesce(sum(k) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0 AS rank FROM k)
SELECT cast(sum(k) AS BIGINT) AS n, round(sum(rank * plus)::DOUBLE, 3) AS w_plus, round(sum(rank * (k - plus))::DOUBLE, 3) AS w_minus FROM q"""
)
def paired_wilcoxon(spark, sf_dir):
    """STA-01: signed-rank sums of paired scores."""
    return stats.wilcoxon(_pairs(spark, sf_dir), "a", "b").select("n", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"))


@query(_PAIRS + "SELECT count(*) FILTER (ca AND NOT cb) AS only_a, count(*) FILTER (NOT ca AND cb) AS only_b, count(*) FILTER (ca = cb) AS concordant FROM p")
def paired_mcnemar(spark, sf_dir):
    """STA-03: discordant categories."""
    return stats.mcnemar(_pairs(spark, sf_dir), "ca", "cb")


@query(f"""WITH r AS (SELECT experiment_id AS c, {_PLAIN} AS e, max(primary_f1) AS s FROM record_results WHERE experiment_id IS NOT NULL AND primary_f1 IS NOT NULL GROUP BY ALL),
b AS (SELECT e, max(s) AS s FROM r WHERE e IS NOT NULL GROUP BY ALL)
SELECT c AS experiment_id, count(*) AS n_best FROM r JOIN b USING (e, s) GROUP BY ALL""")
def pareto_experiments(spark, sf_dir):
    """UDX-09: experiments that are best on some article, the pool a prompt search draws from."""
    rows = table(spark, sf_dir, "record_results").where("experiment_id is not null").select("experiment_id", plain_pmcid(F.col("pmcid")).alias("e"), "primary_f1").where("e is not null")
    return stats.pareto_candidates(rows, "experiment_id", "e", "primary_f1")


@query()
def paired_bootstrap(spark, sf_dir):
    """STA-02: interval of the mean difference by 10,000 reproducible rounds."""
    pairs = _pairs(spark, sf_dir).withColumn("d", F.col("a") - F.col("b"))
    return stats.bootstrap_interval(pairs, "pmcid", "d", rounds=10_000)


@query()
def stratified_splits(spark, sf_dir):
    """STA-06: nested splits stratified by the number of items, per document."""
    sizes = items.ground_truth_items(table(spark, sf_dir, "gt_records").dropDuplicates(["gt_id"]), "gt_id", "gt_json").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return stats.nested_splits(sizes, "doc_id", "n")


def _md5(c, seed: int):
    """60 bits of a hash that SQL engines have, too."""
    return F.conv(F.left(F.md5(F.concat(c.cast("string"), F.lit(f"-{seed}"))), F.lit(15)), 16, 10).cast("bigint")


@query("""WITH d AS (SELECT doc_id, length(text) AS n, ('0x' || md5(doc_id || '-17')[:15])::BIGINT AS h, ('0x' || md5(doc_id || '-18')[:15])::BIGINT AS g FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, ntile(4) OVER (ORDER BY n, h, doc_id) AS stratum FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY g, doc_id) AS i, count(*) OVER (PARTITION BY stratum) AS k FROM s)
SELECT doc_id, stratum::INTEGER AS stratum, (CASE WHEN i <= ceil(k * 10 / 100) THEN 10 WHEN i <= ceil(k * 20 / 100) THEN 20 WHEN i <= ceil(k * 30 / 100) THEN 30 END)::INTEGER AS share FROM p""")
def stratified_documents(spark, sf_dir):
    """STA-06: nested splits of documents, stratified by length."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    return stats.nested_splits(rows, "doc_id", "n", hashed=_md5).select("doc_id", "stratum", "share")


# --- text, XML, accessions ---------------------------------------------------------------------------------


@query("""SELECT doc_id, length(text)::BIGINT AS n, CASE WHEN length(text) > 400 THEN left(text, 280) || '~' || right(text, 120) ELSE text END AS cut,
  cast(floor(length(text) / 4) AS INTEGER) AS tokens, CASE WHEN length(text) > 400 THEN left(text, 280) || '~' || right(text, 70) ELSE text END AS fitted, right(text, 40) AS tail, translate(text, '‒–—―−', '-----') AS dashes FROM documents""")
def text_cuts(spark, sf_dir):
    """TXT-02 to TXT-04, TXT-06, TXT-14: cuts, estimates and dashes of document texts."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).cast("bigint").alias("n"), text.head_and_tail(t, 400, marker="~").alias("cut"), text.estimated_tokens(t).alias("tokens"), text.fit_tokens(t, 100, marker="~").alias("fitted"), text.tail(t, 40).alias("tail"), text.unify_dashes(t).alias("dashes")
    )


@query("""SELECT article_id, md5(trim(regexp_replace(regexp_replace(raw_xml, '<[^>]+>', ' ', 'g'), '[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x{85}\\x{2028}\\x{2029}\\x0B]+', ' ', 'g'))) AS h FROM articles WHERE raw_xml IS NOT NULL""")
def text_stripped(spark, sf_dir):
    """TXT-01, SRC-04: article XML without tags, blanks collapsed."""
    return table(spark, sf_dir, "articles").where("raw_xml is not null").select("article_id", F.md5(text.strip_tags(F.col("raw_xml"))).alias("h"))


@query("""WITH v(kind, code) AS (VALUES ('deleted', 8203), ('deleted', 8204), ('deleted', 8205), ('deleted', 8206), ('deleted', 8207), ('deleted', 8234), ('deleted', 8235), ('deleted', 8236),
  ('deleted', 8237), ('deleted', 8238), ('deleted', 8288), ('deleted', 8294), ('deleted', 8295), ('deleted', 8296), ('deleted', 8297), ('deleted', 65279),
  ('deleted', 173), ('deleted', 8224), ('spelled', 160), ('spelled', 8201), ('spelled', 8239), ('spelled', 12288), ('spelled', 8216), ('spelled', 8217), ('spelled', 8220),
  ('spelled', 8221), ('spelled', 8208), ('spelled', 8209), ('spelled', 8211), ('spelled', 8212), ('spelled', 8722), ('spelled', 8210), ('spelled', 215), ('spelled', 8232),
  ('spelled', 8233), ('spelled', 8482))
SELECT lang, kind, printf('U+%04X', code) AS character, cast(sum(length(text) - length(replace(text, chr(code), ''))) AS BIGINT) AS n, count(*) AS n_texts
FROM documents CROSS JOIN v WHERE contains(text, chr(code)) GROUP BY ALL""")
def text_characters(spark, sf_dir):
    """AGG-17, SRT-07, TXT-05: occurrences of every problem character per language, by code point."""
    return maintain.character_issues(table(spark, sf_dir, "documents"), "text", "lang").orderBy(F.desc("n"), "character", "lang")


@query()
def article_sections(spark, sf_dir):
    """XML-01 to XML-04, TXT-18: sections, tables and composed input of each article."""
    rows = table(spark, sf_dir, "articles").select("article_id", article(F.col("raw_xml")).alias("a"))
    return rows.select("article_id", "a.title", F.size("a.sections").alias("n_sections"), F.size("a.tables").alias("n_tables"), text.composed_input(F.col("a.sections"), F.col("a.tables")).alias("input"))


_CODES = f"""WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{accession.CANDIDATE}', 1))) AS code FROM documents)
"""
_RULES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in accession.rule_rows())
_OWN = ", ".join(repr(r[0]) for r in accession.rule_rows() if r[0] == r[1] and len(r[0]) > 2)
_REFSEQ = ", ".join(map(repr, accession.REFSEQ))


@query(
    _CODES
    + f""", d AS (SELECT doc_id, code, regexp_extract(code, '^([A-Z]+)', 1) AS prefix, length(regexp_extract(regexp_replace(code, '\\.\\d+$', ''), '(\\d+)$', 1))::INTEGER AS n_digits,
  cast(nullif(regexp_extract(code, '\\.(\\d+)$', 1), '') AS INTEGER) AS version, contains(code, '_') AS is_refseq FROM c),
u AS (SELECT * FROM d WHERE prefix NOT IN ('DO', 'EO', 'GI')), r(lo, hi, n, least, most, partner, seq_type) AS (VALUES {_RULES}), s(prefix, seq_type) AS (VALUES {_REFSEQ})
SELECT u.*, partner, seq_type FROM u JOIN r ON length(prefix) = n AND prefix BETWEEN lo AND hi AND n_digits BETWEEN least AND coalesce(most, 12)
  WHERE NOT is_refseq AND (lo = hi OR prefix NOT IN ({_OWN}))
UNION ALL SELECT u.*, 'NCBI', seq_type FROM u JOIN s USING (prefix) WHERE is_refseq"""
)
def accessions_found(spark, sf_dir):
    """ACC-01 to ACC-05: accession numbers of document texts by rule, with partner and kind."""
    return accession.classified(accession.candidates(table(spark, sf_dir, "documents"), "doc_id", "text"), spark)


@query(_CODES + "SELECT doc_id, code FROM c")
def accession_codes(spark, sf_dir):
    """ACC-05, SET-02: all letter-digit codes of each text, each once."""
    return accession.candidates(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "code")


@query("""WITH r AS (SELECT o_orderkey, 'MH' || lpad(cast(o_orderkey AS VARCHAR), 6, '0') || '–MH' || lpad(cast(o_orderkey + o_custkey % 7 AS VARCHAR), 6, '0') AS rng, o_custkey % 7 AS k FROM orders)
SELECT o_orderkey, rng, 'MH' || lpad(cast(o_orderkey + unnest(range(0, k + 1)) AS VARCHAR), 6, '0') AS accession FROM r""")
def accession_ranges(spark, sf_dir):
    """ACC-06: ranges as single accessions."""
    n = lambda e: F.lpad(F.expr(e).cast("string"), 6, "0")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("MH"), n("o_orderkey"), F.lit("–MH"), n("o_orderkey + o_custkey % 7")).alias("rng"))
    return accession.expanded(rows, "rng")


@query(f"""WITH x AS (SELECT DISTINCT extraction_id, regexp_replace(raw_model_output, '\\r', '', 'g') AS t FROM extraction_results),
l AS (SELECT extraction_id, unnest(regexp_extract_all(t, '{accession.LIST_LINE.replace("'", "''")}', 1)) AS line FROM x)
SELECT DISTINCT extraction_id, unnest(regexp_extract_all(upper(line), '[A-Z]+_?[A-Z]*\\d+(?:\\.\\d+)?')) AS accession FROM l""")
def output_accessions(spark, sf_dir):
    """JSN-10: accessions listed in raw outputs of any form."""
    rows = table(spark, sf_dir, "extraction_results").select("extraction_id", accession.listed_in_output(F.col("raw_model_output")).alias("a"))
    return rows.where(F.size("a") > 0).distinct().select("extraction_id", F.explode("a").alias("accession"))


@query("""WITH x AS (SELECT DISTINCT extraction_id, raw_model_output AS t FROM extraction_results WHERE raw_model_output IS NOT NULL),
v AS (SELECT extraction_id, trim(unnest(regexp_split_to_array(t, '[,\n\r]')), ' ') AS value FROM x)
SELECT extraction_id, count(*) AS n_values, count(DISTINCT value) AS n_distinct FROM v WHERE value <> '' GROUP BY ALL""")
def output_values(spark, sf_dir):
    """JSN-09: outputs read as plain lists, cut at commas and lines."""
    rows = table(spark, sf_dir, "extraction_results").where("raw_model_output is not null").select("extraction_id", "raw_model_output").distinct()
    v = rows.select("extraction_id", accession.parsed_list(F.col("raw_model_output")).alias("v")).where(F.size("v") > 0)
    return v.select("extraction_id", F.size("v").cast("bigint").alias("n_values"), F.size(F.array_distinct("v")).cast("bigint").alias("n_distinct"))


# --- susceptibility notations, legend, maintenance ---------------------------------------------------------


@query()
def ast_formats_found(spark, sf_dir):
    """AST-00 to AST-F10, J-17, P-14: notation and drugs of each packed susceptibility value."""
    legend = table(spark, sf_dir, "legend")
    names = ast_formats.legend_map(legend)
    values = packed_items(table(spark, sf_dir, "gt_records"), legend).where("field_name = 'ast_data'").drop("field_name")
    rows = values.withColumn("form", ast_formats.detected_format(F.col("item_value")))
    return rows.withColumn("drugs", ast_formats.drugs(F.col("item_value"), names, F.col("form")))


@query("""SELECT DISTINCT abbrev, full_name, lower(full_name) AS low FROM legend WHERE abbrev IS NOT NULL""")
def legend_lookup(spark, sf_dir):
    """J-17, J-18: names of codes, a disc amount in the code ignored."""
    legend = table(spark, sf_dir, "legend").where("abbrev is not null")
    names = ast_formats.legend_map(legend)
    return legend.select("abbrev", ast_formats.legend_name(F.concat("abbrev", F.lit("-30")), names).alias("full_name"), F.lower("full_name").alias("low")).distinct()


@query()
def cleaning_plan(spark, sf_dir):
    """P-05, TXT-06, JSN-12, SNK-15: what cleaning the ground truth would change, a dry run."""
    gt = table(spark, sf_dir, "gt_records").dropDuplicates(["gt_id"])
    return maintain.cleaning_plan(gt, "gt_id", "gt_json").select("gt_id", "before_hash", "after_hash", "dropped", "changed")


_STEPS = """WITH m AS (SELECT 'PMC' || s_suppkey AS pmcid, (['obsolete', 'golden', 'supp'])[s_suppkey % 3 + 1] AS action FROM supplier WHERE s_suppkey % 5 <> 0),
l AS (SELECT 'PMC' || s_suppkey AS pmcid, 'main' AS place, '/main/PMC' || s_suppkey AS path FROM supplier WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT 'PMC' || s_suppkey, 'golden', '/golden/PMC' || s_suppkey FROM supplier WHERE s_suppkey % 6 = 0)
"""
_STATUS = """CASE WHEN a.path IS NULL THEN 'NOT_FOUND' WHEN b.path IS NOT NULL THEN 'SKIPPED' ELSE 'PLANNED' END AS status
FROM m LEFT JOIN l a ON a.pmcid = m.pmcid AND a.place = 'main' LEFT JOIN l b ON b.pmcid = m.pmcid AND b.place = m.action"""


def _steps(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    pid = F.expr("'PMC' || s_suppkey").alias("pmcid")
    manifest = s.select(pid, F.expr("case when s_suppkey % 5 = 0 then 'unknown' else element_at(array(' Obsolete', 'golden', 'SUPP '), cast(s_suppkey % 3 as int) + 1) end").alias("action"))
    listing = s.where("s_suppkey % 4 <> 0").select(pid, F.lit("main").alias("place"), F.expr("'/main/PMC' || s_suppkey").alias("path"))
    listing = listing.unionByName(s.where("s_suppkey % 6 = 0").select(pid, F.lit("golden").alias("place"), F.expr("'/golden/PMC' || s_suppkey").alias("path")))
    good, _ = maintain.valid_manifest(manifest)
    return maintain.move_plan(good, listing)


@query(_STEPS + "SELECT m.pmcid, m.action, " + _STATUS)
def move_steps(spark, sf_dir):
    """J-24, SRC-17: routed file steps with their status."""
    return _steps(spark, sf_dir).select("pmcid", "action", "status")


@query(_STEPS + "SELECT action, status, count(*) AS n FROM (SELECT m.action, " + _STATUS + ") GROUP BY ALL")
def move_counts(spark, sf_dir):
    """AGG-18: steps per action and status."""
    return maintain.step_counts(_steps(spark, sf_dir))


@query("""SELECT o_orderkey, (date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE AS first, (date_trunc('month', o_orderdate) - INTERVAL 1 DAY)::DATE AS last FROM orders""")
def previous_months(spark, sf_dir):
    """DT-01, STR-05: the month before each date."""
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.previous_month(F.col("o_orderdate").cast("date")).alias("m")).select("o_orderkey", "m.first", "m.last")


@query("""SELECT i, coalesce(c, last_value(c IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS filled FROM
(SELECT o_orderkey AS i, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS c FROM orders)""")
def filled_down(spark, sf_dir):
    """W-02, SRC-21: blank cells take the last value above them."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.expr("case when o_orderkey % 5 = 0 then o_orderpriority else ' ' end").alias("filled"))
    return resolve.filled_down(rows, "filled", "i")


@query("""WITH x AS (SELECT regexp_extract(file_path, '([^/\\\\]*)$', 1) AS name FROM (SELECT DISTINCT file_id, file_path FROM xml_files))
SELECT lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext, count(*) AS n FROM x GROUP BY ALL""")
def file_endings(spark, sf_dir):
    """AGG-11: files per ending."""
    rows = table(spark, sf_dir, "xml_files").select("file_id", "file_path").distinct()
    return files.endings(rows.withColumn("ext", files.ending(F.col("file_path"))))
