"""Which file or record serves an id: ordered fallbacks, missing lists, selective runs.

Everything is a join on the id; nothing is looked up row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.operators.ordered import ranged


def first_by_priority(listing: DataFrame, id_col: str, path_col: str, *order: Column) -> DataFrame:
    """One path per id: the first by ``order``, then by path."""
    keys = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(path_col).alias("path"))
    return listing.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(path_col, keys).alias(path_col))


def exact_first_then_last(listing: DataFrame, id_col: str, name_col: str, suffix: str = ".xml") -> DataFrame:
    """The file named exactly after the id, else the lexicographically last one."""
    exact = F.lower(F.col(name_col)) == F.lower(F.concat(F.col(id_col), F.lit(suffix)))
    best = F.max_by(F.col(name_col), F.struct(exact.cast("int").alias("e"), F.col(name_col).alias("n")))
    return listing.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(best.alias(name_col))


def with_fallbacks(ids: DataFrame, id_col: str, out_col: str, *listings: DataFrame, prefer: Column | None = None) -> DataFrame:
    """``out_col`` from the first listing that has the id.

    listings: (id, path), one path per id. ``prefer``: a condition under which
    the last listing comes first (an explicit golden set).
    """
    df, found = ids, []
    for k, listing in enumerate(listings):
        df = df.join(listing.toDF(id_col, f"_p{k}"), id_col, "left")
        found.append(F.col(f"_p{k}"))
    chain = F.coalesce(*found)
    if prefer is not None:
        chain = F.when(prefer, F.coalesce(found[-1], *found[:-1])).otherwise(chain)
    return df.withColumn(out_col, chain).drop(*[f"_p{k}" for k in range(len(listings))])


def runnable(resolved: DataFrame, *needed: str) -> DataFrame:
    return resolved.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed]))


def missing(ids: DataFrame, have: DataFrame, id_col: str) -> DataFrame:
    """Ids without a counterpart; null ids are kept as missing."""
    return ids.join(have.select(id_col).distinct(), id_col, "left_anti")


def run_list(resolved: DataFrame, targets: list[str] | None, id_col: str) -> DataFrame:
    """The ids to run: all resolved ones, or the named ones among them; ``ALL`` names all."""
    if not targets or targets == ["ALL"]:
        return resolved
    return resolved.where(F.upper(id_col).isin([t.upper() for t in targets]))


def remaining(ids: DataFrame, completed: DataFrame, id_col: str) -> DataFrame:
    """What a resumed run still has to do; failed ids are tried again."""
    return ids.join(completed.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col, "left_anti")


def merge_rerun(existing: DataFrame, new: DataFrame, id_list: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """New results over existing ones, for the ids of the list, in its order."""
    kept = existing.join(new.select(id_col).distinct(), id_col, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).join(id_list.select(id_col, pos_col), id_col)


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key (an upsert); null keys form one."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*[F.col(c) for c in order], F.xxhash64(*rows.columns)))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best.alias("_b")).select("_b.*")


def upsert(tracker: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The tracker with changes merged in; of one key the latest change counts."""
    old = tracker.select("*", F.lit(0).alias("_new"))
    return latest(old.unionByName(changes.select("*", F.lit(1).alias("_new")), allowMissingColumns=True), key, "_new", order).drop("_new")


def filled_down(rows: DataFrame, col: str, order: str, by: str | None = None) -> DataFrame:
    """Blank cells take the last value above them (of the same ``by``).

    Two levels, so rows without a key are never all in one task: within a range
    of ``order`` first, then from the last value of earlier ranges.
    """
    part = [by] if by else []
    cell = F.when(F.trim(col) != "", F.col(col))
    inside = Window.partitionBy(*part, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = ranged(rows.withColumn("_c", cell), *part, order).withColumn("_f", F.last("_c", ignorenulls=True).over(inside))
    blocks = marked.groupBy(*part, "_r").agg(F.max_by("_c", F.when(F.col("_c").isNotNull(), F.col(order))).alias("_l"))
    earlier = Window.partitionBy(*(part or [F.lit(1)])).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    blocks = blocks.select(*[F.col(c).alias("_by") for c in part], F.col("_r").alias("_q"), F.last("_l", ignorenulls=True).over(earlier).alias("_e"))
    same = F.col("_r") == F.col("_q")
    joined = marked.join(blocks, same & F.col(by).eqNullSafe(F.col("_by")) if by else same, "left")
    return joined.withColumn(col, F.coalesce("_f", "_e")).select(*rows.columns)


def of_roles(results: DataFrame, experiments: DataFrame, catalog: DataFrame, *roles: str) -> DataFrame:
    """Results whose experiment belongs to a split of one of the roles, once each."""
    names = catalog.where(F.col("split_role").isin(*roles)).select("split_name")
    runs = experiments.join(names, "split_name", "left_semi").select("experiment_id").distinct()
    return results.join(runs, "experiment_id", "left_semi")


def split_counts(results: DataFrame, experiments: DataFrame) -> DataFrame:
    """Results per split; null for those without experiment or split."""
    runs = experiments.select("experiment_id", "split_name").distinct()
    return results.join(runs, "experiment_id", "left").groupBy("split_name").agg(F.count(F.lit(1)).alias("n"))


def with_supplements(ids: DataFrame, supplements: DataFrame, id_col: str) -> DataFrame:
    """Ids that have at least one supplementary file."""
    return ids.join(supplements.select(id_col), id_col, "left_semi")


def examples(ids: DataFrame, texts: DataFrame, gt: DataFrame, id_col: str, text_col: str, gt_col: str) -> tuple[DataFrame, DataFrame]:
    """Ids with text and ground truth; and why the others are left out: id, reason (no text, no ground truth)."""
    joined = ids.select(id_col).distinct().join(texts.select(id_col, text_col), id_col, "left").join(gt.select(id_col, gt_col), id_col, "left")
    reason = F.when(F.coalesce(F.trim(text_col), F.lit("")) == "", "no text").when(F.col(gt_col).isNull(), "no ground truth")
    marked = joined.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select(id_col, "reason")


def mapped_ids(ids: DataFrame, links: DataFrame, id_col: str, to_col: str) -> tuple[DataFrame, DataFrame]:
    """Ids with the id they are linked to (the least one where there are several), and the ids without a link."""
    one = links.where(F.col(to_col).isNotNull()).groupBy(id_col).agg(F.min(to_col).alias(to_col))
    both = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(one, id_col, "left")
    return both.where(F.col(to_col).isNotNull()), both.where(F.col(to_col).isNull()).select(id_col)


def split_by_list(ids: DataFrame, listed: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Ids that aren't on a list, and those that are."""
    names = listed.select(id_col).distinct()
    return ids.join(names, id_col, "left_anti"), ids.join(names, id_col, "left_semi")


def flagged(rows: DataFrame, id_col: str, lists: dict[str, list[str]]) -> DataFrame:
    """``rows`` with the names of the lists (of known issues, say) that their id is on."""
    named = [F.when(F.col(id_col).isin(ids), F.lit(name)) for name, ids in sorted(lists.items()) if ids]
    return rows.withColumn("flags", F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"))


def first_files(listing: DataFrame, n: int, path_col: str = "path") -> DataFrame:
    """The first ``n`` files by name (that is the feature)."""
    return listing.orderBy(F.regexp_extract(path_col, r"([^/\\]*)$", 1), path_col).limit(n)
