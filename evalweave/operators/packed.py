"""Several values packed in one field: one row per value, position kept.

Method: the text is split on its quote characters; odd pieces are literals,
even pieces are cut into names, brackets, separators and words, and a fold over
that array puts the values together again in order. The known names say where a
value starts, so a separator that belongs to a name (``sulfonamides, combined``,
``strA/strB``) or to an amount doesn't cut it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.functions.gtjson import isolates, read_json

#: The most names that may be compiled into the pattern; the legend is a fixed dimension.
MAX_NAMES = 5000

_FIELDS = ("ast_data", "amr")
_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("section_name", T.StringType()),
            T.StructField("isolate_pos", T.IntegerType()),
            T.StructField("field_name", T.StringType()),
            T.StructField("parts", T.ArrayType(T.StringType())),
        ]
    )
)

#: Characters that separate values, and quotes other than the apostrophe.
_SEPARATORS = ",;|&/+、，；·•\\t\\r\\n"
_QUOTES = '"“”„‟«»‹›'


def _parts(v) -> list[str] | None:
    if isinstance(v, str):
        return [v]
    if isinstance(v, list) and v and not any(isinstance(x, (dict, list)) for x in v):
        return [x for x in v if isinstance(x, str)]
    return None


def _packed_fields(text: str | None) -> list[dict]:
    doc = read_json(text)
    if not isinstance(doc, dict):
        return []
    bodies = [("iwl", k, body) for k, (_, body) in enumerate(isolates(doc), 1)]
    bodies.append(("nioai", 0, doc.get("no_isolates_only_assayinformation")))
    return [
        {"section_name": s, "isolate_pos": k, "field_name": f, "parts": p}
        for s, k, body in bodies
        if isinstance(body, dict)
        for f in _FIELDS
        if (p := _parts(body.get(f)))
    ]


def packed_fields(gt: DataFrame, id_col: str = "gt_id", json_col: str = "gt_json") -> DataFrame:
    """One row per packed field of a ground-truth document, repeats of a row dropped.

    A field is packed when it is a string or an array of strings (null elements
    are skipped). Documents that are null or can't be parsed give no row.
    """

    @F.arrow_udf(_FOUND)
    def fields(texts: pa.Array) -> pa.Array:
        return pa.array([_packed_fields(t.as_py()) for t in texts], type=_ARROW)

    fields = fields.asNondeterministic()  # or the filter below would read every document again
    found = gt.select(F.col(id_col).alias("gt_id"), fields(F.col(json_col)).alias("fields"))
    found = found.where(F.size("fields") > 0).withColumn("_h", F.xxhash64("fields"))
    return found.dropDuplicates(["gt_id", "_h"]).select("gt_id", F.inline("fields"))


_ARROW = pa.list_(
    pa.struct([("section_name", pa.string()), ("isolate_pos", pa.int32()), ("field_name", pa.string()), ("parts", pa.list_(pa.string()))])
)


def _any_of(names: list[str]) -> str:
    """A pattern for the longest of ``names`` at a place: common beginnings are tried once."""
    trie: dict = {}
    for n in names:
        node = trie
        for c in n:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.sub(r"([^\w\s])", r"\\\1", c) + pattern(node[c]) for c in sorted(node) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)}){'?' if '' in node else ''}" if len(ways) > 1 or "" in node else ways[0]

    return pattern(trie)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


#: How many values the fold gathers before it puts them away.
_BATCH = 64


def split_values(text: Column, names: list[str]) -> Column:
    """The values packed in ``text``, in order, without outer blanks and quotes.

    ``names``: the names a value can start with, in any case; a code and a colon
    may stand before one. A piece without a name belongs to the value before it.
    With no names at all, every piece between separators is a value. Null gives
    null, blank text an empty array. The fold notes where values begin and end, and
    each is put together once. Spark copies what a fold has gathered at every step,
    so the time grows with the number of values in a text times its words: 20,000
    values in one text take some 10 s, 80,000 some 150 s.
    """
    if len(names) > MAX_NAMES:
        raise ValueError(f"{len(names)} names; the pattern is meant for a fixed list of at most {MAX_NAMES}")
    known = sorted({n.strip().lower() for n in names if n and n.strip()})
    name = rf"(?<![\p{{L}}\p{{N}}])(?:{_any_of(known)})(?![\p{{L}}\p{{N}}])" if known else rf"[^{_SEPARATORS}\s][^{_SEPARATORS}]*"
    token = rf"(?isu){name}|\([^()]*\)|\[[^\[\]]*\]|[{_SEPARATORS}\s\p{{Z}}]+|[\p{{L}}\p{{N}}]+|."
    # an apostrophe is a quote only at the outer side of a value: genes have their own
    marked = F.regexp_replace(text, rf"[{_QUOTES}]", "\u0001")
    marked = F.regexp_replace(marked, rf"(?<![^\s\p{{Z}}{_SEPARATORS}])'(?=[^\s'])|(?<=[^\s'(])'(?![^\s\p{{Z}}{_SEPARATORS}])", "\u0001")
    kinds = "array<struct<kind:string,t:string>>"

    def kind(t: Column) -> Column:
        is_name = F.lower(t).isin(known) if known else t.rlike(rf"^[^{_SEPARATORS}\s]")
        return F.when(is_name, "n").when(t.rlike(rf"^(?iU)(?:[{_SEPARATORS}\s\p{{Z}}]+|-|and)$"), "s").otherwise("w")

    def tokens(pieces: Column) -> Column:
        def of(piece: Column, k: Column) -> Column:
            literal = (k % 2 == 1) & (k < F.size(pieces) - 1)
            as_literal = F.array(F.struct(F.lit("n").alias("kind"), F.trim(piece).alias("t")))
            return F.when(literal, F.when(F.trim(piece) == "", F.array().cast(kinds)).otherwise(as_literal)).otherwise(
                F.transform(F.regexp_extract_all(piece, F.lit(token), F.lit(0)), lambda t: F.struct(kind(t).alias("kind"), t.alias("t")))
            )

        return F.flatten(F.transform(pieces, of))

    # places count from 1; first is 0 before the first word; blank: nothing but blanks since the last word
    spans = "array<struct<first:int,last:int>>"
    state = f"struct<full:array<{spans}>,spans:{spans},at:int,first:int,last:int,named:boolean,colon:boolean,blank:boolean>"

    def fold(a: Column, x: Column) -> Column:
        at, apart = a["at"] + 1, x["kind"] == "s"
        cut = (x["kind"] == "n") & a["named"] & ~(a["colon"] & a["blank"])
        more = F.concat(a["spans"], F.array(F.struct(a["first"], a["last"])))
        away = cut & (F.size(a["spans"]) >= _BATCH - 1)
        return F.struct(
            F.when(away, F.concat(a["full"], F.array(more))).otherwise(a["full"]).alias("full"),
            F.when(away, F.array().cast(spans)).when(cut, more).otherwise(a["spans"]).alias("spans"),
            at.alias("at"),
            F.when(cut | (~apart & (a["first"] == 0)), at).otherwise(a["first"]).alias("first"),
            F.when(apart, a["last"]).otherwise(at).alias("last"),
            (a["named"] | (x["kind"] == "n")).alias("named"),
            F.when(apart, a["colon"]).otherwise(F.endswith(x["t"], F.lit(":"))).alias("colon"),
            F.when(apart, a["blank"] & x["t"].rlike(r"^[ \p{Zs}]*$")).otherwise(F.lit(True)).alias("blank"),
        ).cast(state)

    def values(found: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{spans}>"), F.array().cast(spans), F.lit(0), F.lit(0), F.lit(0), F.lit(False), F.lit(False), F.lit(True)).cast(state)
        rest = lambda a: F.when(a["first"] == 0, a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct(a["first"], a["last"]).cast("struct<first:int,last:int>"))))
        placed = F.aggregate(found, start, fold, lambda a: F.flatten(F.concat(a["full"], F.array(rest(a)))))
        return F.transform(placed, lambda p: F.array_join(F.transform(F.slice(found, p["first"], p["last"] - p["first"] + 1), lambda t: t["t"]), ""))

    edge = r"(?U)^[\s\p{Z}\x01]+|[\s\p{Z}\x01]+$"
    done = _let(F.split(marked, "\u0001"), lambda pieces: _let(tokens(pieces), values))
    return F.filter(F.transform(done, lambda v: F.regexp_replace(v, edge, "")), lambda v: v != "")


def legend_names(legend: DataFrame) -> list[str]:
    """Codes and full names of the legend; its size is checked before it is collected."""
    both = legend.select(F.explode(F.array("abbrev", "full_name")).alias("n")).where("n is not null").distinct()
    names = [r["n"] for r in both.limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        raise ValueError(f"the legend holds more than {MAX_NAMES} names")
    return names


def packed_items(gt: DataFrame, legend: DataFrame) -> DataFrame:
    """One row per value of every packed field.

    Columns: gt_id, section_name, isolate_pos, field_name, item_pos, item_value.
    Positions run on across the elements of an array; empty pieces don't count.
    Work per row only: one shuffle drops repeated rows, no field is gathered.
    """
    names = legend_names(legend)
    fields = packed_fields(gt).withColumn("items", F.flatten(F.transform("parts", lambda p: split_values(p, names))))
    out = fields.select("gt_id", "section_name", "isolate_pos", "field_name", F.posexplode_outer("items").alias("p", "item_value"))
    # an inner explode would make the planner test size(items) > 0, and so fold every field twice
    return out.where("item_value is not null").select("gt_id", "section_name", "isolate_pos", "field_name", (F.col("p") + 1).alias("item_pos"), "item_value")
