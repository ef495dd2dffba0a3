"""Matching extracted items with ground truth: exact, lenient and by contained tokens.

All joins are equi-joins on the document and the field or value; the order
rules of the lenient match have a closed form in two windows, and the greedy
match by contained tokens folds over the arrays of one document's field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.text import tokens_contained


def linked_cells(gt: DataFrame, ext: DataFrame) -> DataFrame:
    """Cells of linked isolates of both sides in one table: the columns of both, with extracted, exact and hit.

    In: doc_id, iso_id, field, norm, pos; one row per (doc_id, iso_id, field).
    An extracted cell hits its own cell of equal value, whether used or not.
    Else it hits the first ground-truth cell of equal field and value, unless
    something earlier has hit that cell. All of that happens among the cells of
    one value of a document's field, so one exchange serves both sides.
    """
    sides = gt.withColumn("extracted", F.lit(False)).unionByName(ext.withColumn("extracted", F.lit(True)), allowMissingColumns=True)
    value = ["doc_id", "field", "norm"]
    rows = sides.repartition(*value)
    known = F.col("doc_id").isNotNull() & F.col("field").isNotNull() & F.col("norm").isNotNull()
    same, cell = Window.partitionBy(*value), Window.partitionBy(*value, "iso_id")
    e, here = F.col("extracted"), F.struct("pos", "iso_id")
    own = F.col("iso_id").isNotNull() & known
    rows = rows.withColumns(
        {
            "_e": F.bool_or(e).over(cell) & own,
            "_g": F.bool_or(~e).over(cell) & own,
            "_first": F.when(known, F.min(F.when(~e, here)).over(same)),  # the cell that a lenient match would take
        }
    )
    rows = rows.withColumn("exact", e & F.col("_g"))
    rows = rows.withColumns(
        {
            "_taken": F.min(F.when(F.col("exact") & (F.col("iso_id") == F.col("_first.iso_id")), F.col("pos"))).over(same),
            "_turn": F.min(F.when(e & ~F.col("exact"), here)).over(same),  # the first that has no cell of its own
        }
    )
    lenient = F.col("_first").isNotNull() & F.col("_turn").isNotNull() & (F.col("_taken").isNull() | (F.col("_taken") > F.col("_turn.pos")))
    hit = F.when(e, F.col("exact") | (lenient & (here == F.col("_turn")))).otherwise(F.col("_e") | (lenient & F.coalesce(F.col("iso_id") == F.col("_first.iso_id"), F.lit(False))))
    return rows.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_e", "_g", "_first", "_taken", "_turn")


def linked_matches(gt: DataFrame, ext: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of linked isolates: (extracted with hit and exact, ground truth with hit), as ``linked_cells`` has them."""
    cells = linked_cells(gt, ext)
    found = cells.where("extracted").select("doc_id", "iso_id", "field", "norm", "pos", "exact", "hit", *[c for c in ("orig",) if c in ext.columns])
    return found, cells.where("not extracted").select(*gt.columns, "hit")


def hit_counts(cells: DataFrame, *by: str) -> DataFrame:
    """tp, fp and fn of cells (extracted, hit)."""
    e, hit = F.col("extracted"), F.col("hit")
    return cells.groupBy(*by).agg(F.count_if(e & hit).alias("tp"), F.count_if(e & ~hit).alias("fp"), F.count_if(~e & ~hit).alias("fn"))


def bare_cells(gt: DataFrame, ext: DataFrame) -> DataFrame:
    """Fields without isolates, of both sides in one table: equal field and value in the same document. With extracted and hit."""
    sides = gt.withColumn("extracted", F.lit(False)).unionByName(ext.withColumn("extracted", F.lit(True)), allowMissingColumns=True)
    same, e = Window.partitionBy("doc_id", "field", "norm"), F.col("extracted")
    known = F.col("doc_id").isNotNull() & F.col("field").isNotNull() & F.col("norm").isNotNull()
    rows = sides.withColumns({"_e": F.bool_or(e).over(same), "_g": F.bool_or(~e).over(same)})
    return rows.withColumn("hit", known & F.when(e, F.col("_g")).otherwise(F.col("_e"))).drop("_e", "_g")


def bare_matches(gt: DataFrame, ext: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields without isolates: (extracted with hit, ground truth with hit)."""
    cells = bare_cells(gt, ext)
    return cells.where("extracted").select(*ext.columns, "hit"), cells.where("not extracted").select(*gt.columns, "hit")


def recovered(missed_gt: DataFrame, extra_ext: DataFrame) -> DataFrame:
    """How many wrong items of a document's field hold the tokens of a missed one.

    Wrong items take, in their order, the first missed item that is still free.
    In: doc_id, field, norm, pos. Out: doc_id, field, recovered. The arrays are
    those of one field of one document.
    """
    per = lambda df, name: df.groupBy("doc_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]).alias(name))
    both = per(extra_ext, "wrong").join(per(missed_gt, "missed"), ["doc_id", "field"])

    def take(used: Column, w: Column) -> Column:
        free = F.filter(F.sequence(F.lit(1), F.size("missed")), lambda k: ~F.array_contains(used, k) & tokens_contained(F.element_at("missed", k), w))
        return F.when(F.size(free) > 0, F.concat(used, F.slice(free, 1, 1))).otherwise(used)

    used = F.aggregate("wrong", F.array().cast("array<int>"), take)
    return both.select("doc_id", "field", F.size(used).alias("recovered"))


def id_sets(gt: DataFrame, ext: DataFrame) -> DataFrame:
    """Unlinked isolate ids as sets: doc_id, tp, fp, fn."""
    side = lambda df, name: df.select("doc_id", "norm").distinct().withColumn(name, F.lit(1))
    both = side(gt, "g").join(side(ext, "e"), ["doc_id", "norm"], "full")
    return both.groupBy("doc_id").agg(
        F.count_if(F.col("g").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("e").isNull()).alias("fn")
    )


def pilot_match(gt: DataFrame, ext: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The pilot's one-to-one match by field and value, ids equal in canonical form or a wildcard.

    Extracted items take, in order, a free ground-truth item of the same
    document, field and value whose id is equal; items without isolate
    (NO_ISOLATE_ID) take any. Out: doc_id, tp, fp, up, fn; up are wrong items
    whose value stands in the document's text (texts: doc_id, text).
    """
    from evalweave.functions.text import isolate_key

    key = ["doc_id", "field", "norm"]
    g = gt.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", isolate_key(F.col("iso_id")).alias("k")))), lambda x: x["k"]).alias("ids"))
    e = ext.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", isolate_key(F.col("iso_id")).alias("k"), "iso_id"))), lambda x: F.struct(x["k"], x["iso_id"])).alias("asks"))

    def take(used: Column, a: Column) -> Column:
        fits = lambda k: ~F.array_contains(used, k) & ((F.element_at("ids", k) == a["k"]) | (a["iso_id"] == "NO_ISOLATE_ID"))
        free = F.filter(F.sequence(F.lit(1), F.size("ids")), fits)
        return F.when(F.size(free) > 0, F.concat(used, F.slice(free, 1, 1))).otherwise(used)

    both = g.join(e, key, "full")
    hits = F.when(F.col("ids").isNull() | F.col("asks").isNull(), 0).otherwise(F.size(F.aggregate("asks", F.array().cast("array<int>"), take)))
    asked, there = (F.when(F.col(c).isNull(), 0).otherwise(F.size(c)) for c in ("asks", "ids"))
    rows = both.select(*key, hits.alias("tp"), (asked - hits).alias("wrong"), (there - hits).alias("fn"))
    if texts is not None:
        rows = rows.join(texts.select("doc_id", F.lower("text").alias("_t")), "doc_id", "left")
        rows = rows.withColumn("up", F.when(F.coalesce(F.contains("_t", "norm"), F.lit(False)), F.col("wrong")).otherwise(0)).drop("_t")
    else:
        rows = rows.withColumn("up", F.lit(0))
    return rows.groupBy("doc_id").agg(F.sum("tp").alias("tp"), F.sum(F.col("wrong") - F.col("up")).alias("fp"), F.sum("up").alias("up"), F.sum("fn").alias("fn"))
