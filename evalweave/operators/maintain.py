"""Keeping the ground truth: cleaning, re-keying, change detection and move plans.

Plans are DataFrames; nothing is written or moved unless ``sinks`` is told to.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.gtjson import read_json
from evalweave.functions.text import problem_characters

# Metadata of isolates that isn't kept (names as they occur), and where actions move files.
METADATA = ("isolate_country", "isolate_date", "isolate_source", "location", "location_offical_name")
ROUTES = [("obsolete", "main", "obsolete"), ("golden", "main", "golden"), ("supp", "main", "supp"), ("golden_supp", "main", "golden"), ("golden_supp", "main", "supp")]
ACTIONS = tuple(dict.fromkeys(a for a, *_ in ROUTES))
_DASHES = str.maketrans("‒–—", "---")


def _walk(v, change):
    if isinstance(v, dict):
        return {change(k): _walk(x, change) for k, x in v.items()}
    if isinstance(v, list):
        return [_walk(x, change) for x in v]
    return change(v) if isinstance(v, str) else v


def merged(a, b):
    """Two values of a field as one: lists joined without repeats, maps updated, scalars as a list."""
    if a in (None, "", [], {}, "null"):
        return b
    if b in (None, "", [], {}, "null"):
        return a
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **b}
    if isinstance(a, list) or isinstance(b, list):
        left, right = (x if isinstance(x, list) else [x] for x in (a, b))
        return left + [x for x in right if x not in left]
    return [a, b]


def clean_document(doc: dict) -> tuple[dict, int]:
    """Metadata of isolates dropped and dashes unified, in keys too; with the number dropped."""
    dropped = 0
    linked = doc.get("isolates_with_linking")
    bodies = list(linked.values()) if isinstance(linked, dict) else linked if isinstance(linked, list) else []
    for body in [*bodies, doc.get("no_isolates_only_assayinformation")]:
        if isinstance(body, dict):
            for k in METADATA:
                dropped += body.pop(k, None) is not None
    return _walk(doc, lambda s: s.translate(_DASHES)), dropped


def unlink(doc: dict, isolate_ids: list[str] | None = None) -> dict:
    """Isolates (all, or the named ones) folded into the bare fields, which they replace."""
    linked = doc.get("isolates_with_linking")
    rows = list(linked.items()) if isinstance(linked, dict) else [(x.get("isolate_id"), x) for x in linked or [] if isinstance(x, dict)]
    bare: dict = {}
    kept = []
    for iso, body in rows:
        if isinstance(body, dict) and (isolate_ids is None or iso in isolate_ids):
            for k, v in body.items():
                if k != "isolate_id":
                    bare[k] = merged(bare.get(k), v)
        else:
            kept.append((iso, body))
    doc = dict(doc)
    doc["isolates_with_linking"] = dict(kept) if isinstance(linked, dict) else [b for _, b in kept]
    if bare:
        doc["no_isolates_only_assayinformation"] = bare
    return doc


def rekeyed(doc: dict, old_id: str, field: str | None = None, value=None, new_id: str = "NO_ISOLATE_ID") -> dict:
    """One isolate under another id, a field filled where it is empty."""
    linked = doc.get("isolates_with_linking")
    out = []
    for iso, body in list(linked.items()) if isinstance(linked, dict) else [(x.get("isolate_id"), x) for x in linked or [] if isinstance(x, dict)]:
        if iso == old_id and isinstance(body, dict):
            body = dict(body)
            iso = new_id
            if not isinstance(linked, dict):
                body["isolate_id"] = new_id
            if field and body.get(field) in (None, "", [], {}, "null"):
                body[field] = value
        out.append((iso, body))
    return {**doc, "isolates_with_linking": dict(out) if isinstance(linked, dict) else [b for _, b in out]}


def content_hash(doc) -> str:
    """The same for equal content, whatever the order of keys."""
    return hashlib.sha256(json.dumps(doc, sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


_PLAN = "struct<before_hash:string,after_hash:string,dropped:int,new_json:string>"


def cleaning_plan(gt: DataFrame, id_col: str, json_col: str, fixes: DataFrame | None = None) -> DataFrame:
    """What cleaning would change: before_hash, after_hash, dropped, new_json, changed.

    fixes (optional): ``id_col``, old_ids (array), field, value. One old id is
    given the id of no isolate, several are folded into the bare fields.
    Unparsable documents have null hashes and are never changed.
    """

    @F.arrow_udf(_PLAN)
    def plan(texts: pa.Array, ids: pa.Array, fields: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for t, old, field, value in zip(texts, ids, fields, values):
            doc = read_json(t.as_py())
            if not isinstance(doc, dict):
                out.append(None)
                continue
            before = content_hash(doc)
            doc, dropped = clean_document(doc)
            old = old.as_py() or []
            doc = rekeyed(doc, old[0], field.as_py(), value.as_py()) if len(old) == 1 else unlink(doc, old) if old else doc
            out.append({"before_hash": before, "after_hash": content_hash(doc), "dropped": dropped, "new_json": json.dumps(doc, ensure_ascii=False)})
        return pa.array(out, pa.struct([("before_hash", pa.string()), ("after_hash", pa.string()), ("dropped", pa.int32()), ("new_json", pa.string())]))

    rows = gt.select(id_col, json_col)
    if fixes is not None:
        rows = rows.join(fixes.select(id_col, "old_ids", "field", "value"), id_col, "left")
    else:
        rows = rows.select("*", F.lit(None).cast("array<string>").alias("old_ids"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    done = rows.select(id_col, plan(json_col, "old_ids", "field", "value").alias("p")).select(id_col, "p.*")
    return done.withColumn("changed", F.coalesce(F.col("before_hash") != F.col("after_hash"), F.lit(False)))


def character_issues(rows: DataFrame, text_col: str, *by: str) -> DataFrame:
    """How often each problem character occurs, and in how many texts; one pass, one row per character and group."""
    t = F.col(text_col)
    dims = problem_characters()
    counted = rows.where(t.rlike(r"[^\x00-\x7F]")).select(*by, F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(f"U+{ord(c):04X}").alias("character"), (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).alias("n")) for kind, c, _ in dims])).alias("x"))
    return counted.select(*by, "x.*").where("n > 0").groupBy(*by, "kind", "character").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_texts"))


def valid_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a known action (lower case), and the rejected rest."""
    clean = rows.select(F.upper(F.trim("pmcid")).alias("pmcid"), F.lower(F.trim("action")).alias("action"))
    good = F.coalesce((F.col("pmcid") != "") & F.col("action").isin(*ACTIONS), F.lit(False))
    return clean.where(good), clean.where(~good)


def move_plan(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Steps per action with status: PLANNED, SKIPPED where the target is taken, NOT_FOUND.

    manifest: pmcid, action; listing: pmcid, place, path (one per pmcid and place).
    """
    spark = manifest.sparkSession
    routes = F.broadcast(spark.createDataFrame(ROUTES, "action string, source string, target string"))
    steps = manifest.join(routes, "action")
    src = listing.select("pmcid", F.col("place").alias("source"), "path")
    dst = listing.select("pmcid", F.col("place").alias("target"), F.lit(True).alias("taken")).distinct()
    out = steps.join(src, ["pmcid", "source"], "left").join(dst, ["pmcid", "target"], "left")
    status = F.when(F.col("path").isNull(), "NOT_FOUND").when(F.col("taken"), "SKIPPED").otherwise("PLANNED")
    return out.select("pmcid", "action", "source", "target", "path", status.alias("status"))


def fix_rows(definitions: Column) -> Column:
    """Fix definitions (JSON with ``single`` and ``multi``) as rows of pmcid, old_ids, field, value."""
    single = F.from_json(F.get_json_object(definitions, "$.single"), "map<string,struct<old_id:string,ensure_field:string,ensure_value:string>>")
    multi = F.from_json(F.get_json_object(definitions, "$.multi"), "map<string,struct<old_ids:array<string>>>")
    one = F.transform(F.map_entries(F.coalesce(single, F.create_map().cast("map<string,struct<old_id:string,ensure_field:string,ensure_value:string>>"))), lambda e: F.struct(e["key"].alias("pmcid"), F.array(e["value"]["old_id"]).alias("old_ids"), e["value"]["ensure_field"].alias("field"), e["value"]["ensure_value"].alias("value")))
    many = F.transform(F.map_entries(F.coalesce(multi, F.create_map().cast("map<string,struct<old_ids:array<string>>>"))), lambda e: F.struct(e["key"].alias("pmcid"), e["value"]["old_ids"].alias("old_ids"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")))
    return F.concat(one, many)


def orphan_fixes(fixes: DataFrame, gt: DataFrame, id_col: str) -> DataFrame:
    """Fixes for documents that don't exist."""
    return fixes.join(gt.select(id_col).distinct(), id_col, "left_anti")


def of_day(tracker: DataFrame, date_col: str, day: str) -> DataFrame:
    """Rows of a tracker that were written on a day (yyyy-MM-dd), whatever time is written with it."""
    return tracker.where(F.contains(F.col(date_col).cast("string"), F.lit(day)))


def step_counts(steps: DataFrame) -> DataFrame:
    """How many steps each action and status has: action, status, n."""
    return steps.groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"))
