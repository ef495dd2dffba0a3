"""Isolate sheets as ground-truth documents.

A sheet is a table of text columns, one row an isolate, in the order of its
``_row``; it comes from CSV (``sources.files.sheet``) or any other reader. The
documents are JSON text, as the readers of ground truth take them. Rows of one
document are gathered; a document is bounded by its article.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import safe_text, split_list
from evalweave.operators.ast_formats import JSON, detected_format, drugs, years
from evalweave.operators.resolve import filled_down

# Columns of the sheet of all articles that must be there.
REQUIRED = ("PMCID", "isolate_id", "AST_Data")
# Texts and lists of an isolate, by the columns they may stand in.
_TEXTS = {"isolate_id": ("isolate_id", "Isolate_ID"), "isolate_source": ("isolate_source", "Isolate Source"), "isolate_country": ("isolate_country", "Isolate Country")}
_LISTS = {"serotype": ("Serotype",), "mlst": ("MLST",), "spi": ("SPI",), "amr": ("AMR",), "plasmid": ("Plasmid",), "snp": ("SNP",), "virulence_genes": ("Virulence Genes",)}
_DATES, _ACCESSIONS = ("isolate_date", "Isolate Date"), ("Accession Numbers", "Accession Numbers_merge")
# What a row's category says about where it belongs; anything else is linked.
UNLINKED, ASSAY_ONLY = ("unlinked", "isolate_without_linking"), ("assay_only", "no_isolates_only_assayinformation")


def _cell(rows: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.col(f"`{n}`") for n in names if n in rows.columns]
    return F.coalesce(*found).cast("string") if found else F.lit(None).cast("string")


def susceptibility(cell: Column, serotype: Column, legend: Column) -> Column:
    """A cell as the JSON text of its envelopes: JSON as it is (one object as a list), other notations read, else []."""
    text = F.trim(cell)
    given = F.to_json(F.try_parse_json(F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)))
    found = drugs(cell, legend)
    members = F.transform(found, lambda d: F.struct(d["name"].alias("Name"), F.coalesce(d["mic"], F.lit("null")).alias("MIC"), d["interpretation"].alias("Interpretation")))
    made = F.to_json(F.array(F.struct(serotype.alias("Serotype"), members.alias("Antibiotics"))), {"ignoreNullFields": "false"})
    return F.coalesce(F.when(detected_format(cell) == JSON, given).when(F.size(found) > 0, made), F.lit("[]"))


def isolates(rows: DataFrame, legend: Column) -> DataFrame:
    """Each row's isolate: id, _row, section, isolate (JSON text), ast (JSON text), lists and accessions.

    In: id (null where the row has none) and the columns of a sheet.
    """
    lists = {k: split_list(F.coalesce(_cell(rows, names), F.lit(""))) for k, names in _LISTS.items()}
    texts = {k: safe_text(_cell(rows, names)) for k, names in _TEXTS.items()}
    category = F.lower(safe_text(_cell(rows, ("category",))))
    section = F.when(category.isin(*UNLINKED), "iwol").when(category.isin(*ASSAY_ONLY), "nioai").otherwise("iwl")
    flat = rows.select(
        "id", "_row", section.alias("section"), *[c.alias(k) for k, c in (texts | lists).items()],
        years(_cell(rows, _DATES)).alias("isolate_date"),
        susceptibility(_cell(rows, ("AST_Data",)), F.get(lists["serotype"], F.lit(0)), legend).alias("ast"),
        F.concat(*[split_list(F.coalesce(_cell(rows, (c,)), F.lit(""))) for c in _ACCESSIONS]).alias("accessions"),
    )
    head = F.to_json(F.struct("isolate_id", "isolate_source", "isolate_date", "isolate_country", *_LISTS))
    whole = F.concat(F.left(head, F.length(head) - 1), F.lit(',"ast_data":'), F.col("ast"), F.lit("}"))
    return flat.withColumn("isolate", whole)


def _in_order(what: Column, where: Column) -> Column:
    kept = F.filter(F.array_sort(F.collect_list(F.when(where, F.struct("_row", what.alias("v"))))), lambda x: x.isNotNull())
    return F.transform(kept, lambda x: x["v"])


def documents(found: DataFrame) -> DataFrame:
    """id and gt_json: isolates by section, bare lists run on over rows, accessions each once in their order."""
    is_ = lambda s: F.col("section") == s
    bare = {k: F.flatten(_in_order(F.col(k), is_("nioai"))) for k in ("amr", "serotype", "mlst")}
    doc = found.groupBy("id").agg(
        _in_order(F.col("isolate"), is_("iwl")).alias("linked"), _in_order(F.col("isolate"), is_("iwol")).alias("loose"),
        F.filter(F.transform(_in_order(F.col("ast"), is_("nioai")), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), lambda x: x != "").alias("asts"),
        F.count_if(is_("nioai")).alias("n_bare"), *[c.alias(k) for k, c in bare.items()],
        F.array_distinct(F.flatten(_in_order(F.col("accessions"), F.lit(True)))).alias("accessions"),
    )
    some = lambda k: F.when(F.size(k) > 0, F.concat(F.lit(f',"{k}":'), F.to_json(k))).otherwise("")
    bare_json = F.when(F.col("n_bare") > 0, F.concat(F.lit('{"ast_data":['), F.array_join("asts", ","), F.lit("]"), *[some(k) for k in bare], F.lit("}"))).otherwise("{}")
    quoted = F.to_json(F.array("id"))
    text = F.concat(
        F.lit('{"pmcid":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2),
        F.lit(',"isolate_without_linking":['), F.array_join("loose", ","),
        F.lit('],"no_isolates_only_assayinformation":'), bare_json,
        F.lit(',"isolates_with_linking":['), F.array_join("linked", ","), F.lit("]"),
        F.when(F.size("accessions") > 0, F.concat(F.lit(',"merge_accession_number":'), F.to_json("accessions"))).otherwise(""), F.lit("}"),
    )
    return doc.select("id", text.alias("gt_json"))


def sheet_documents(rows: DataFrame, legend: Column) -> DataFrame:
    """The sheet of all articles: a blank PMCID is that of the row above; rows before the first one are left out."""
    if lacking := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"the sheet lacks the columns {lacking}")
    filled = filled_down(rows.withColumn("id", F.col("PMCID").cast("string")), "id", "_row").where("id is not null").withColumn("id", F.trim("id"))
    return documents(isolates(filled, legend))


def paired_files(listing: DataFrame, isolates_end: str = "Isolates_with_linking", others_end: str = "others") -> DataFrame:
    """The two files of an article: id, isolates_path, others_path (null where there is none), in order of ids. In: path."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    named = lambda end, col: listing.where(F.endswith(stem, F.lit(end))).select(F.left(stem, F.length(stem) - len(end)).alias("id"), F.col("path").alias(col)).groupBy("id").agg(F.min(col).alias(col))
    return named(isolates_end, "isolates_path").join(named(others_end, "others_path"), "id", "left").orderBy("id")


def _literal(text: str | None, empty: str) -> str:
    if not text or not text.strip():
        return empty
    for read in (json.loads, ast.literal_eval):
        try:
            return json.dumps(read(text.strip()), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return empty


def literal(cell: Column, empty: str) -> Column:
    """A cell that holds JSON, or a list or map as Python writes it, as JSON text; ``empty`` where it can't be read."""

    @F.arrow_udf("string")
    def read(cells: pa.Array) -> pa.Array:
        return pa.array([_literal(t.as_py(), empty) for t in cells], pa.string())

    return read(cell)


def other_sections(rows: DataFrame) -> DataFrame:
    """The first row of each article's second sheet: id, isolate_without_linking, no_isolates_only_assayinformation (JSON text)."""
    first = rows.groupBy("id").agg(F.min_by(F.struct(_cell(rows, ("Isolate_without_linking",)).alias("a"), _cell(rows, ("No_isolates_only_assayinformation",)).alias("b")), "_row").alias("r"))
    return first.select("id", literal(F.col("r.a"), "[]").alias("isolate_without_linking"), literal(F.col("r.b"), "{}").alias("no_isolates_only_assayinformation"))


def paired_documents(rows: DataFrame, others: DataFrame, legend: Column) -> DataFrame:
    """Articles with a sheet of isolates each and a sheet of the rest: id, gt_json."""
    linked = isolates(rows, legend).groupBy("id").agg(_in_order(F.col("isolate"), F.lit(True)).alias("linked"))
    both = linked.join(other_sections(others), "id", "left")
    quoted = F.to_json(F.array("id"))
    text = F.concat(
        F.lit('{"pmcid":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2),
        F.lit(',"isolate_without_linking":'), F.coalesce("isolate_without_linking", F.lit("[]")),
        F.lit(',"no_isolates_only_assayinformation":'), F.coalesce("no_isolates_only_assayinformation", F.lit("{}")),
        F.lit(',"isolates_with_linking":['), F.array_join("linked", ","), F.lit("]}"),
    )
    return both.select("id", text.alias("gt_json"))
