"""Deeply nested records as flat, related tables (Dewey labelling).

Every node gets the path of its ordinals (``i2.e1.a3``: third antibiotic of the
first envelope of the second isolate). The parent's path is the path without
its last step, so parent-child links need no join to derive, and the letters of
a path name the schema path, hence the table, that a node belongs to.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.gtjson import isolates, name, read_json

_NODES = "array<struct<node_path:string,node_name:string>>"
_ARROW = pa.list_(pa.struct([("node_path", pa.string()), ("node_name", pa.string())]))


def _json_nodes(text: str | None) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for k, (isolate, body) in enumerate(isolates(read_json(text)), 1):
        if body is None:
            continue
        out.append((f"i{k}", isolate or ""))
        ast = body.get("ast_data")
        if isinstance(ast, dict):
            envelopes = [ast] if "Serotype" in ast or "Antibiotics" in ast else []
        else:
            envelopes = [x for x in ast if isinstance(x, dict)] if isinstance(ast, list) else []
        for e, envelope in enumerate(envelopes, 1):
            out.append((f"i{k}.e{e}", name(envelope, "Serotype") or ""))
            drugs = envelope.get("Antibiotics")
            drugs = [drugs] if isinstance(drugs, dict) else drugs if isinstance(drugs, list) else []
            for a, drug in enumerate((d for d in drugs if isinstance(d, dict)), 1):
                out.append((f"i{k}.e{e}.a{a}", name(drug, "Name") or ""))
    return out


def _tag(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2]


def _label(el: ET.Element, tag: str) -> str:
    for child in el:
        if _tag(child) == tag:
            return " ".join("".join(child.itertext()).split())
    return ""


def _xml_nodes(text: str | None) -> list[tuple[str, str]]:
    if not text or not text.strip():
        return []
    try:
        root = ET.fromstring(text.lstrip())
    except (ET.ParseError, ValueError):
        return []
    if _tag(root) != "article":
        return []
    out: list[tuple[str, str]] = []
    todo = [(body, "") for body in root if _tag(body) == "body"][:1]
    while todo:
        el, path = todo.pop()
        lead = f"{path}." if path else ""
        s = t = 0
        for child in el:
            tag = _tag(child)
            if tag == "sec":
                s += 1
                own = f"{lead}s{s}"
                out.append((own, _label(child, "title")))
                todo.append((child, own))
            elif tag == "table-wrap":
                t += 1
                own = f"{lead}t{t}"
                out.append((own, _label(child, "label")))
                rows = (r for b in child.iter() if _tag(b) == "tbody" for r in b if _tag(r) == "tr")
                out.extend((f"{own}.r{k}", _label(r, "td")) for k, r in enumerate(rows, 1))
    return out


def _nodes(text: Column, parse) -> Column:
    @F.arrow_udf(_NODES)
    def nodes(texts: pa.Array) -> pa.Array:
        values, offsets = [], [0]
        for t in texts:  # one text at a time: a batch of very long texts isn't held twice
            values.extend(parse(t.as_py()))
            offsets.append(len(values))
        paths, names = zip(*values) if values else ((), ())
        flat = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string())], ["node_path", "node_name"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return nodes.asNondeterministic()(text)  # or a filter on the nodes would parse every text again


def dewey_nodes(source: DataFrame, root_table: str, id_col: str, text_col: str, kind: str) -> DataFrame:
    """Flat nodes of the ``json`` or ``xml`` texts of a table.

    Columns: root_table, root_id, parent_path, node_path, node_name. A repeated
    row counts once. Null, empty and unparsable texts have no nodes; a missing
    name is ''. Rows are cut per document; nothing is gathered by key.
    """
    parse = {"json": _json_nodes, "xml": _xml_nodes}[kind]
    found = source.select(F.col(id_col).cast("bigint").alias("root_id"), _nodes(F.col(text_col), parse).alias("nodes"))
    found = found.where(F.size("nodes") > 0).withColumn("_h", F.xxhash64("nodes"))
    nodes = found.dropDuplicates(["root_id", "_h"]).select("root_id", F.inline("nodes"))
    parent = F.regexp_replace("node_path", r"\.?[^.]*$", "")
    return nodes.select(F.lit(root_table).alias("root_table"), "root_id", parent.alias("parent_path"), "node_path", "node_name")


def schema_path(node_path: Column) -> Column:
    """The path's letters, ``i.e.a``: the table that a node belongs to."""
    return F.regexp_replace(node_path, r"\d+", "")


def related_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame for each kind of node, keyed by root and path.

    Section nesting has no bound, so every depth of sections is one table.
    """
    kinds = {"isolates": r"^i\d+$", "envelopes": r"\.e\d+$", "antibiotics": r"\.a\d+$", "sections": r"(^|\.)s\d+$", "tables": r"(^|\.)t\d+$", "table_rows": r"\.r\d+$"}
    return {k: nodes.where(F.col("node_path").rlike(p)) for k, p in kinds.items()}
