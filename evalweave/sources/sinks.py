"""Writers of results, reports, logs and plans.

Tables are written by Spark; only small reports of a fixed number of rows are
made on the driver. Everything that changes or moves files is a dry run unless
``apply`` is set.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import shortened_message
from evalweave.operators.scoring import aggregate, confusion

# The columns of a results file.
RESULT_COLUMNS = "pmcid gt_category ext_category category_correct tp fp fn precision recall primary_f1 loose_tp loose_fp loose_fn loose_f1 gt_item_count ext_item_count error_message".split()


def as_text(results: DataFrame) -> DataFrame:
    """Result rows with scores as text of four decimals, worst first."""
    scores = ("precision", "recall", "primary_f1", "loose_f1")
    cols = [F.format_string("%.4f", c).alias(c) if c in scores else F.col(c) for c in RESULT_COLUMNS if c in results.columns]
    return results.orderBy("primary_f1", "pmcid").select(*cols)


def write_results_csv(results: DataFrame, path: str) -> None:
    as_text(results).write.mode("overwrite").option("header", "true").csv(path)


def write_results_json(results: DataFrame, path: str, **metadata) -> None:
    """All records as JSON lines, and what is known of the run beside them (``path``.metadata.json)."""
    results.write.mode("overwrite").json(path)
    write_json({**metadata, "total_records": results.count()}, f"{path}.metadata.json")


def summary(results: DataFrame, label: str, top: int = 10) -> dict:
    """Metadata, overall and per-category scores, accuracy and the commonest confusions."""
    rows = [r.asDict() for r in aggregate(results, "gt_category").collect()]  # one row per category and the total
    named = {r["gt_category"] or "": r for r in rows if r["level"] == 0}
    accuracy = results.agg(F.avg(F.col("category_correct").cast("int")).alias("a")).first()["a"]
    common = [r.asDict() for r in confusion(results).orderBy(F.desc("n"), "gt_category", "ext_category").limit(top).collect()]
    return {
        "metadata": {"run_label": label, "timestamp": datetime.now(timezone.utc).isoformat()},
        "overall": next((r for r in rows if r["level"] == 1), {}),
        "by_category": dict(sorted(named.items())),
        "category_accuracy": accuracy or 0.0,
        "confusion": common,
    }


def write_json(value: dict, path: str) -> None:
    """A small report, on the driver; folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, default=str, sort_keys=True)


def print_summary(results: DataFrame, worst: int = 5) -> None:
    aggregate(results, "gt_category").show(truncate=False)
    results.orderBy("primary_f1", "pmcid").select("pmcid", "gt_category", "ext_category", "primary_f1").limit(worst).show(truncate=False)
    results.where("error_message is not null").select("pmcid", "error_message").orderBy("pmcid").limit(10).show(truncate=False)


def write_report(results: DataFrame, folder: str, label: str) -> None:
    """CSV and JSON of all records and the summary. ``results`` is read several times; persist it if it is costly."""
    write_results_csv(results, f"{folder}/results_csv")
    write_results_json(results, f"{folder}/results_json", run_label=label)
    write_json(summary(results, label), f"{folder}/summary.json")


def append_table(rows: DataFrame, path: str, *partitions: str) -> None:
    """Raw extractions, run events, change logs and missing ids: append-only tables."""
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def write_pipe_csv(rows: DataFrame, list_col: str, path: str) -> None:
    """A list column as one comma-joined column, columns between bars."""
    rows.withColumn(list_col, F.concat_ws(",", list_col)).write.mode("overwrite").option("header", "true").option("sep", "|").csv(path)


def write_changed(plan: DataFrame, path: str, apply: bool = False) -> int:
    """New content of changed documents only; returns how many there are."""
    changed = plan.where("changed")
    if apply:
        changed.write.mode("overwrite").parquet(path)
    return changed.count()


def save_text(text: str, path: str, gzip_above: int = 1 << 20) -> str:
    """A text file unless it exists, gzipped above a size; returns its path."""
    raw = text.encode("utf-8")
    target = path + ".gz" if len(raw) > gzip_above else path
    if not os.path.exists(target):
        os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
        with gzip.open(target, "wb") if target.endswith(".gz") else open(target, "wb") as f:
            f.write(raw)
    return target


def run_moves(steps: list[dict], roots: dict[str, str], apply: bool = False, copy: bool = False) -> list[dict]:
    """Planned file steps carried out on the driver: MOVED, DRY_RUN, SKIPPED (taken) or NOT_FOUND."""
    done = []
    for step in steps:
        target = os.path.join(roots[step["target"]], os.path.basename(step["path"] or ""))
        status = step["status"]
        if status == "PLANNED":
            if not os.path.exists(step["path"]):
                status = "NOT_FOUND"
            elif os.path.exists(target):
                status = "SKIPPED"
            elif not apply:
                status = "DRY_RUN"
            else:
                os.makedirs(roots[step["target"]], exist_ok=True)
                (shutil.copy2 if copy else shutil.move)(step["path"], target)
                status = "MOVED"
        done.append({**step, "status": status})
    return done


def append_changelog(entries: list[dict], path: str) -> int:
    """Entries added to a JSON list; a file that can't be read is started afresh."""
    try:
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
        old = old if isinstance(old, list) else []
    except (OSError, ValueError):
        old = []
    old += entries
    with open(path, "w", encoding="utf-8") as f:
        json.dump(old, f, ensure_ascii=False, indent=1, default=str)
    return len(old)


# Columns of a manifest, and of the short one.
MANIFEST = "pmcid gt_category ext_category primary_f1 tp fp fn gt_item_count ext_item_count gt_found ext_found xml_found".split()
SHORT_MANIFEST = "pmcid gt_found xml_found".split()


def write_manifest(rows: DataFrame, path: str, short: bool = False, apply: bool = False) -> int:
    """A manifest of records as CSV, only with ``apply``; returns the number of rows."""
    out = rows.select(*(SHORT_MANIFEST if short else MANIFEST))
    if apply:
        out.write.mode("overwrite").option("header", "true").csv(path)
    return out.count()


def write_run_metadata(path: str, run: str, **settings) -> dict:
    """What a run was started with, as one JSON file."""
    value = {"run": run, "timestamp": datetime.now(timezone.utc).isoformat(), "settings": settings}
    write_json(value, path)
    return value


def write_predictions(rows: DataFrame, path: str, status_col: str = "status") -> None:
    """Predictions as JSON lines, their status in lower case (``pending`` where there is none)."""
    rows.withColumn(status_col, F.lower(F.coalesce(F.col(status_col), F.lit("pending")))).write.mode("overwrite").json(path)


def log_entries(events: DataFrame) -> DataFrame:
    """Run events as lines of a log: at, line. In: at, id, status (ok, failed, other), message (null: none).

    Long messages lose their middle. Lines are a table, so a log of any length is appended and read in parts.
    """
    mark = F.when(F.col("status") == "ok", "OK").when(F.col("status") == "failed", "FAILED").otherwise(F.upper(F.coalesce("status", F.lit("note"))))
    return events.select("at", F.concat_ws(" ", F.col("at").cast("string"), mark, F.coalesce("id", F.lit("-")), shortened_message(F.regexp_replace(F.coalesce("message", F.lit("")), r"[\r\n]+", " "))).alias("line"))


def log_footer(events: DataFrame) -> str:
    """The last line of a log: how many entries, and how many failed."""
    n = events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed")).first()
    return f"{n['n']} entries, {n['failed']} failed"


def append_missing(ids: DataFrame, path: str, day: str, reason: str) -> None:
    """Ids that weren't found, appended under their day."""
    append_table(ids.withColumns({"reason": F.lit(reason), "day": F.lit(day)}), path, "day")


def status_text(counts: dict[str, int | float], title: str) -> str:
    """Status counts as a short report."""
    width = max(map(len, counts), default=0)
    return "\n".join([title, "=" * len(title), *[f"{k.ljust(width)}  {v:.1f}" if isinstance(v, float) else f"{k.ljust(width)}  {v}" for k, v in counts.items()]]) + "\n"


def save_program(path: str, name: str, program: dict, results: dict) -> None:
    """A prompt program with its results, beside the earlier ones of a registry file; the last one of a name counts."""
    append_changelog([{"name": name, "saved_at": datetime.now(timezone.utc).isoformat(), "program": program, "results": results}], path)


def load_program(path: str, name: str) -> dict | None:
    """The last program saved under a name, None where there is none."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        found = [e for e in json.load(f) if e.get("name") == name]
    return found[-1]["program"] if found else None
