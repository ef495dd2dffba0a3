"""Scores per document, field and category, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.operators.items import categories
from evalweave.operators.matching import bare_cells, hit_counts, id_sets, linked_cells, recovered


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def with_f1(df: DataFrame) -> DataFrame:
    c = F.col
    out = df.withColumns({"precision": precision(c("tp"), c("fp")), "recall": recall(c("tp"), c("fn")), "primary_f1": f1(c("tp"), c("fp"), c("fn"))})
    return out.withColumn("loose_f1", f1(c("loose_tp"), c("loose_fp"), c("loose_fn"))) if "loose_tp" in df.columns else out


def pilot_f1(tp: Column, fp: Column, up: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Conservative (uncertain ones are wrong), primary (they don't count), optimistic (they are right)."""
    return f1(tp, fp + up, fn), f1(tp, fp, fn), f1(tp + up, fp, fn)


def field_counts(gt_items: DataFrame, ext_items: DataFrame) -> DataFrame:
    """tp, fp, fn and loose recoveries per document, section and field."""
    part = lambda df, s: df.where(F.col("section") == s)
    out = None
    for section, match in (("iwl", linked_cells), ("nioai", bare_cells)):
        cells = match(part(gt_items, section), part(ext_items, section))
        e = F.col("extracted")
        loose = recovered(cells.where(~e & ~F.col("hit")), cells.where(e & ~F.col("hit")))
        rows = hit_counts(cells, "doc_id", "field").join(loose, ["doc_id", "field"], "left")
        rows = rows.select("doc_id", F.lit(section).alias("section"), "field", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "recovered")])
        out = rows if out is None else out.unionByName(rows)
    return out


def score_documents(doc_ids: DataFrame, gt_items: DataFrame, ext_items: DataFrame) -> DataFrame:
    """One row per document: categories, counts, strict and loose scores.

    doc_ids: doc_id of every document to score. The ground truth's category says
    which section counts: linked cells, unlinked ids, or bare fields; with empty
    ground truth every extracted item is wrong.
    """
    g = categories(gt_items).select("doc_id", F.col("category").alias("gt_category"), F.col("item_count").alias("gt_item_count"))
    e = categories(ext_items).select("doc_id", F.col("category").alias("ext_category"), F.col("item_count").alias("ext_item_count"))
    docs = doc_ids.select("doc_id").distinct().join(g, "doc_id", "left").join(e, "doc_id", "left")
    docs = docs.na.fill({"gt_category": "EMPTY", "ext_category": "EMPTY", "gt_item_count": 0, "ext_item_count": 0})

    fields = field_counts(gt_items, ext_items)
    sums = fields.groupBy("doc_id", "section").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "recovered")])
    ids = id_sets(gt_items.where("section = 'iwol'"), ext_items.where("section = 'iwol'"))
    sums = sums.unionByName(ids.withColumn("section", F.lit("iwol")).withColumn("recovered", F.lit(0)))
    counted = F.when(F.col("gt_category").isin("IWL", "IWL+IWOL"), "iwl").when(F.col("gt_category") == "IWOL", "iwol").when(F.col("gt_category") == "NIOAI", "nioai")
    rows = docs.withColumn("section", counted).join(sums, ["doc_id", "section"], "left").drop("section")
    rows = rows.na.fill(0, ["tp", "fp", "fn", "recovered"])
    rows = rows.withColumn("fp", F.when(F.col("gt_category") == "EMPTY", F.col("ext_item_count")).otherwise(F.col("fp")))
    rows = rows.withColumns({"loose_tp": F.col("tp") + F.col("recovered"), "loose_fp": F.col("fp") - F.col("recovered"), "loose_fn": F.col("fn") - F.col("recovered")})
    return with_f1(rows.drop("recovered")).withColumn("category_correct", F.col("gt_category") == F.col("ext_category"))


def field_scores(fields: DataFrame) -> DataFrame:
    """Per document and field: counts and F1."""
    return fields.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def aggregate(results: DataFrame, *by: str) -> DataFrame:
    """Count, mean, median, least, greatest, deviation of F1, totals and micro scores per group.

    With ``by`` also the total over all groups, where the group is null (a rollup).
    """
    c = F.col
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    grouped = results.rollup(*by) if by else results.groupBy()
    return grouped.agg(
        *([F.grouping_id().cast("int").alias("level")] if by else []),
        F.count(F.lit(1)).alias("n"),
        F.avg("primary_f1").alias("mean_f1"),
        F.median("primary_f1").alias("median_f1"),
        F.min("primary_f1").alias("min_f1"),
        F.max("primary_f1").alias("max_f1"),
        F.coalesce(F.stddev_samp("primary_f1"), F.lit(0.0)).alias("stdev_f1"),
        F.coalesce(tp, F.lit(0)).alias("total_tp"),
        F.coalesce(fp, F.lit(0)).alias("total_fp"),
        F.coalesce(fn, F.lit(0)).alias("total_fn"),
        precision(tp, fp).alias("micro_precision"),
        recall(tp, fn).alias("micro_recall"),
        f1(tp, fp, fn).alias("micro_f1"),
        F.avg(c("loose_f1")).alias("loose_mean_f1"),
        F.median(c("loose_f1")).alias("loose_median_f1"),
    )


def confusion(results: DataFrame) -> DataFrame:
    """Documents per pair of categories."""
    return results.groupBy("gt_category", "ext_category").agg(F.count(F.lit(1)).alias("n"))


def score_buckets(results: DataFrame, *by: str) -> DataFrame:
    s = F.col("primary_f1")
    return results.groupBy(*by).agg(F.count_if(s == 0).alias("zero"), F.count_if((s > 0) & (s < 0.5)).alias("below_half"), F.count_if(s >= 0.5).alias("half_or_more"), F.avg(s).alias("mean_f1"))


def failure_pattern(results: DataFrame) -> DataFrame:
    """Linked truth taken for bare (1), for unlinked (2), or linked but all missed (3)."""
    linked = F.col("gt_category") == "IWL"
    p = F.when(linked & (F.col("ext_category") == "NIOAI"), 1).when(linked & (F.col("ext_category") == "IWOL"), 2).when(linked & (F.col("ext_category") == "IWL") & (F.col("tp") == 0), 3)
    return results.withColumn("pattern", p).where("pattern is not null")
