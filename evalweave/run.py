"""From files to reports: ``python -m evalweave.run COMMAND ...``.

Runs can be stopped and started again: what is done lies in tables under the
output folder, and only the rest is done. Failed documents are tried again.
Commands that change files are dry runs unless ``--apply`` is given.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.keys import plain_pmcid
from evalweave.operators import ast_formats, items, maintain, resolve, scoring, sheets
from evalweave.session import checkpointed
from evalweave.sources import adapters, files, sinks

_RAW = "doc_id string, raw_output string, status string, error string, ms bigint, at timestamp"


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of an earlier run, None before the first."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _named(rows: DataFrame) -> DataFrame:
    """Texts of files with the plain article number of their names."""
    return rows.select(plain_pmcid(F.regexp_extract(files.file_name(F.col("path")), r"(?i)((?:PMC)?\d+)", 1)).alias("doc_id"), "text").where("doc_id is not null").dropDuplicates(["doc_id"])


def _wanted(rows: DataFrame, spark: SparkSession, ids: str | None) -> DataFrame:
    if ids is None:
        return rows
    listed = files.id_list(spark, ids).select(plain_pmcid(F.col("id")).alias("doc_id"))
    return rows.join(listed, "doc_id", "left_semi")


def extract(spark: SparkSession, xml: str, out: str, extractor: adapters.Extractor, ids: str | None = None, attempts: int = 3) -> DataFrame:
    """Raw outputs of the articles of a folder that aren't done yet, appended to ``out``/raw; returns all of them."""
    texts = _wanted(_named(files.texts(spark, xml, "*.xml")), spark, ids)
    done = _table(spark, f"{out}/raw")
    todo = texts if done is None else resolve.remaining(texts, done.where("status = 'completed'"), "doc_id")
    got = adapters.extract(todo, "doc_id", "text", extractor, attempts)
    status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce(F.trim("raw"), F.lit("")) == "", "empty").otherwise("completed")
    rows = got.select(F.col("id").alias("doc_id"), F.col("raw").alias("raw_output"), status.alias("status"), "error", "ms", F.current_timestamp().alias("at"))
    sinks.append_table(rows, f"{out}/raw")
    return resolve.latest(spark.read.schema(_RAW).parquet(f"{out}/raw"), ["doc_id"], "at")


def raw_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Raw outputs of a folder: a table that ``extract`` wrote, or one JSON file a document."""
    found = _table(spark, f"{folder}/raw")
    if found is not None:
        return resolve.latest(found, ["doc_id"], "at").where("raw_output is not null").select("doc_id", F.col("raw_output").alias("raw"))
    stored = files.stored_extraction(spark, folder)
    return stored.select(plain_pmcid(F.col("pmcid")).alias("doc_id"), F.col("raw_output").alias("raw")).where("doc_id is not null and raw is not null").dropDuplicates(["doc_id"])


def evaluate(spark: SparkSession, gt: str, raw: str, out: str, label: str, ids: str | None = None) -> DataFrame:
    """Scores of the outputs that have ground truth, those of earlier runs kept; written with the report to ``out``."""
    truth = _wanted(_named(files.texts(spark, gt, "*.json")).withColumnRenamed("text", "gt_json"), spark, ids)
    both = raw_outputs(spark, raw).join(truth, "doc_id")
    done = _table(spark, f"{out}/scores")
    todo = checkpointed(both if done is None else resolve.remaining(both, done, "doc_id"))
    found = checkpointed(items.ground_truth_items(todo, "doc_id", "gt_json")), checkpointed(items.output_items(todo, "doc_id", "raw"))
    scores = scoring.score_documents(todo, *found).withColumnRenamed("doc_id", "pmcid")
    unread = items.output_categories(todo, "doc_id", "raw").where("not parsed").select(F.col("doc_id").alias("pmcid"), F.lit("the output can't be read").alias("error_message"))
    rows = scores.join(unread, "pmcid", "left").withColumnRenamed("pmcid", "doc_id")
    sinks.append_table(rows, f"{out}/scores")
    results = spark.read.parquet(f"{out}/scores").withColumnRenamed("doc_id", "pmcid")
    sinks.write_report(results, out, label)
    sinks.write_run_metadata(f"{out}/run.json", label, gt=gt, raw=raw, ids=ids)
    return results


def convert(spark: SparkSession, sheet: str, legend: str, out: str, apply: bool = False) -> DataFrame:
    """Ground truth of a sheet: id, gt_json; written as one table only with ``apply``."""
    names = ast_formats.legend_map(files.legend_csv(spark, legend))
    found = sheets.sheet_documents(files.sheet(spark, sheet), names)
    if apply:
        found.write.mode("overwrite").parquet(out)
    return found


def clean(spark: SparkSession, gt: str, out: str, apply: bool = False) -> int:
    """How many ground-truth documents cleaning changes; their new content is written only with ``apply``."""
    plan = maintain.cleaning_plan(_named(files.texts(spark, gt, "*.json")), "doc_id", "text")
    return sinks.write_changed(plan, out, apply)


def holdout(spark: SparkSession, results: str, splits: str, split: str, out: str, label: str) -> DataFrame:
    """The results of one split of a splits file, with their report."""
    ids = files.splits(spark, splits).where(F.col("split") == split).select(plain_pmcid(F.col("id")).alias("pmcid"))
    rows = spark.read.parquet(f"{results}/scores").withColumnRenamed("doc_id", "pmcid").join(ids, "pmcid", "left_semi")
    sinks.write_report(rows, out, label)
    return rows


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evalweave.run", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [c := sub.add_parser(name), *[c.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?")) for o in options]][0]
    add("extract", "xml", "out", "ids?")
    add("evaluate", "gt", "raw", "out", "label", "ids?")
    add("convert", "sheet", "legend", "out").add_argument("--apply", action="store_true")
    add("clean", "gt", "out").add_argument("--apply", action="store_true")
    add("holdout", "results", "splits", "split", "out", "label")
    return p


def main(argv: list[str] | None = None) -> int:
    a = vars(_parser().parse_args(argv))
    command = a.pop("command")
    spark = SparkSession.builder.appName(f"evalweave {command}").getOrCreate()
    if command == "extract":
        done = extract(spark, extractor=adapters.RuleExtractor(), **a)
        done.groupBy("status").count().show()
    elif command == "clean":
        print(f"{clean(spark, **a)} documents change")
    else:
        rows = {"evaluate": evaluate, "convert": convert, "holdout": holdout}[command](spark, **a)
        sinks.print_summary(rows) if command != "convert" else print(f"{rows.count()} documents")
    return 0


if __name__ == "__main__":
    sys.exit(main())
