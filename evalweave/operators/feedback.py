"""What went wrong with an extraction: detectors over items and article text, and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.normalise import ASSAY_FIELDS
from evalweave.functions.text import message_lines, sample_label, strip
from evalweave.session import checkpointed

# How antigenic formulas and population-level values are written.
ANTIGENIC_FORMULA = r"^\d[\d,\[\]]*:\w[\w,\-]*:[\w,\-]*$"
POPULATION = r"(?i)\d+\.?\d*\s*%|\d+/\d+|\b(?:proportion|prevalence|frequency)\b"


def _first(rows: DataFrame, value: Column, k: int, *order: str) -> DataFrame:
    """The first ``k`` values of each document by ``order``: doc_id, sample. The rest never leaves its task."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    kept = rows.withColumn("_place", place).where(F.col("_place") <= k)
    return kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", value.alias("v")))), lambda x: x["v"]).alias("sample"))


def table_gap(gt_ids: DataFrame, ext_ids: DataFrame, texts: DataFrame, sample: int = 5) -> DataFrame:
    """Isolates that stand in the article but weren't extracted: doc_id, n, sample.

    In: doc_id, iso_id on both sides; texts: doc_id, text. Ids are looked for in
    their own document only.
    """
    missed = gt_ids.select("doc_id", "iso_id").distinct().join(ext_ids.select("doc_id", "iso_id").distinct(), ["doc_id", "iso_id"], "left_anti")
    there = missed.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", "iso_id")).select("doc_id", "iso_id")
    return there.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(_first(there, F.col("iso_id"), sample, "iso_id"), "doc_id")


def linking_failure(rows: DataFrame) -> DataFrame:
    """``full`` or ``partial``: ids without links though the truth has them. In: gt_category, iwl, iwol, bare (counts)."""
    wanted = F.col("gt_category").isin("IWL", "IWL+IWOL") & (F.col("iwol") > 0) & (F.col("iwl") == 0)
    return rows.withColumn("linking", F.when(wanted & (F.col("bare") > 0), "full").when(wanted, "partial"))


def missed_formulas(gt_items: DataFrame, ext_items: DataFrame, sample: int = 3) -> DataFrame:
    """Serotypes of the truth written as antigenic formulas that weren't extracted."""
    values = lambda df: df.where("field = 'serotype'").select("doc_id", F.explode(F.split("norm", r"\|")).alias("v")).distinct()
    gone = values(gt_items).join(values(ext_items), ["doc_id", "v"], "left_anti").where(F.col("v").rlike(ANTIGENIC_FORMULA))
    return _first(gone, F.col("v"), sample, "v")


def population_values(ext_items: DataFrame, sample: int = 3) -> DataFrame:
    """Shares and prevalences given as values of single isolates."""
    rows = ext_items.where(F.col("section") == "iwl").where(F.col("orig").rlike(POPULATION))
    label = sample_label(F.concat_ws(".", "iso_id", "field"), F.col("orig"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(_first(rows, label, sample, "pos", "iso_id", "field", "orig"), "doc_id")


def unknown_fields(raw_fields: DataFrame) -> DataFrame:
    """Field names as given that are no assay fields, whatever the case; aliases count as unknown. In: doc_id, field_raw."""
    unknown = ~F.lower(strip(F.col("field_raw"))).isin(ASSAY_FIELDS)
    return raw_fields.where(unknown).groupBy("doc_id").agg(F.array_sort(F.collect_set("field_raw")).alias("fields"))


def composed(scores: DataFrame, **found: DataFrame) -> DataFrame:
    """One message text per document.

    scores: doc_id, gt_category, ext_category, fp, fn, loose_tp, tp; found:
    table_gap, linking, formulas, population, fields as the detectors give them, each optional.
    """
    df = scores
    for name, rows in found.items():
        df = df.join(rows.select("doc_id", *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "doc_id"]), "doc_id", "left")
    c = F.col
    lines = [
        F.when(c("gt_category") != c("ext_category"), F.format_string("Category: %s given, %s expected.", "ext_category", "gt_category")),
        F.when(c("fn") > 0, F.format_string("%s item(s) were missed.", c("fn").cast("string"))),
        F.when(c("fp") > 0, F.format_string("%s item(s) are not in the ground truth.", c("fp").cast("string"))),
        F.when(c("loose_tp") > c("tp"), F.format_string("%s item(s) are right but wordier than expected.", (c("loose_tp") - c("tp")).cast("string"))),
    ]
    if "table_gap" in found:
        lines.append(F.when(c("table_gap_n") > 0, F.concat(F.lit("In the text but not extracted: "), F.array_join("table_gap_sample", ", "))))
    if "linking" in found:
        lines.append(F.when(c("linking_linking") == "full", "Isolates and assay data were given but not linked.").when(c("linking_linking") == "partial", "Isolates were given without links, linked ones are expected."))
    if "formulas" in found:
        lines.append(F.when(F.size("formulas_sample") > 0, F.concat(F.lit("Antigenic formulas are serotypes: "), F.array_join("formulas_sample", ", "))))
    if "population" in found:
        lines.append(F.when(c("population_n") > 0, F.concat(F.lit("Shares of populations are no values of isolates: "), F.array_join("population_sample", "; "))))
    if "fields" in found:
        lines.append(F.when(F.size("fields_fields") > 0, F.concat(F.lit("Unknown fields: "), F.array_join("fields_fields", ", "))))
    text = message_lines(*lines)
    return df.select("doc_id", F.when(text == "", "Extraction correct.").otherwise(text).alias("feedback"))


def values_in_text(values: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether a value stands in its document's text, whatever the case. In: doc_id, value; doc_id, text."""
    low = texts.select("doc_id", F.lower("text").alias("_t"))
    return values.join(low, "doc_id", "left").withColumn("in_text", F.coalesce(F.contains("_t", F.lower("value")), F.lit(False))).drop("_t")


def assay_metric(rows: DataFrame, id_col: str, gt_col: str, raw_col: str, with_feedback: bool = False) -> DataFrame:
    """Strict F1 of each raw output against its ground truth: id, score, and with it the feedback text.

    One row an id; null texts on either side score 0. This is the metric that a
    prompt search calls, over as many examples as it likes at once.
    """
    from evalweave.operators import items, scoring

    docs = checkpointed(rows.select(F.col(id_col).alias("doc_id"), F.col(gt_col).alias("gt"), F.col(raw_col).alias("raw")))
    gt, ext = checkpointed(items.ground_truth_items(docs, "doc_id", "gt")), checkpointed(items.output_items(docs, "doc_id", "raw"))
    scores = scoring.score_documents(docs, gt, ext)
    out = scores.select(F.col("doc_id").alias(id_col), F.col("primary_f1").alias("score"))
    if not with_feedback:
        return out
    sections = items.output_categories(docs, "doc_id", "raw").select("doc_id", "iwl", "iwol", "bare")
    truth = items.categories(gt).select("doc_id", F.col("category").alias("gt_category"))
    found = {
        "linking": linking_failure(sections.join(truth, "doc_id")).select("doc_id", "linking"),
        "fields": unknown_fields(items.output_fields(docs, "doc_id", "raw")),
        "formulas": missed_formulas(gt, ext),
        "population": population_values(ext),
    }
    return out.join(composed(scores, **found).withColumnRenamed("doc_id", id_col), id_col)
