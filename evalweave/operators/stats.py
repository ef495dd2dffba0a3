"""Paired statistics, intervals and splits, reproducible by hash instead of chance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.operators.ordered import ranged
from evalweave.session import checkpointed


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums of a - b, zero differences dropped: n, w_plus, w_minus, rank_biserial, z.

    Ranks are averages over ties; they come from counts per distinct difference,
    so only distinct sizes are ordered, range by range. z is the normal approximation with tie correction.
    """
    d = F.round(F.col(a) - F.col(b), 12)
    sizes = pairs.select(d.alias("d")).where("d <> 0").groupBy(F.abs("d").alias("s")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("d") > 0).alias("plus"))
    sizes = ranged(sizes, "s")
    ranges = sizes.groupBy("_r").agg(F.sum("k").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.select("_r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("_r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.join(F.broadcast(starts), "_r").withColumn("rank", F.col("start") + F.coalesce(F.sum("k").over(within), F.lit(0)) + (F.col("k") + 1) / 2)
    k, n = F.col("k").cast("double"), F.sum("k").cast("double")
    out = ranked.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("rank") * F.col("plus")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * (F.col("k") - F.col("plus"))), F.lit(0.0)).alias("w_minus"),
        (n * (n + 1) * (2 * n + 1) / 24 - F.sum(k * k * k - k) / 48).alias("v"),
    )
    mean = F.col("n") * (F.col("n") + 1) / 4
    z = F.when(F.col("v") > 0, (F.col("w_plus") - mean) / F.sqrt("v"))
    return out.select("n", "w_plus", "w_minus", F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus")).alias("rank_biserial"), z.alias("z"))


def wilcoxon_exact_p(w_plus: float, n: int) -> float:
    """Two-sided exact p of a signed-rank sum without ties, by counting subsets; for n up to some 100."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(counts) - 1, r - 1, -1):
            counts[s] += counts[s - r]
    w = min(w_plus, n * (n + 1) / 2 - w_plus)
    return min(1.0, 2 * sum(counts[: int(math.floor(w)) + 1]) / 2**n)


def bootstrap_interval(values: DataFrame, id_col: str, col: str, rounds: int = 10_000, level: float = 0.95, seed: int = 17, block: int = 4096) -> DataFrame:
    """Percentile interval of the mean: n, mean, low, high. In each round n rows are drawn with replacement.

    Equal values are counted first: how often each is drawn is multinomial, the
    same as drawing the rows (so ``id_col`` doesn't matter). The distinct values
    lie in blocks of about ``block``; a round's draws are split over the blocks,
    then within each block, by generators seeded with round and block, so every
    run gives the same interval and no task holds all values.
    """
    v = values.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    distinct = checkpointed(v.groupBy("v").agg(F.count(F.lit(1)).alias("k")))
    j = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(max(1, math.ceil(distinct.count() / block)))).alias("j")
    pairs = F.array_sort(F.collect_list(F.struct("v", "k")))  # about ``block`` values
    held = checkpointed(distinct.groupBy(j).agg(F.sum("k").alias("n"), pairs.alias("p")).select("j", "n", F.col("p.v").alias("v"), F.col("p.k").alias("k")))
    sizes = {r["j"]: r["n"] for r in held.select("j", "n").collect()}  # one row per block
    n = sum(sizes.values())
    if not n:
        return v.agg(F.count(F.lit(1)).alias("n"), *[F.avg("v").alias(c) for c in ("mean", "low", "high")])
    chances = np.array([sizes.get(k, 0) / n for k in range(max(sizes) + 1)])

    @F.arrow_udf("array<bigint>")
    def split(b: pa.Array) -> pa.Array:
        return pa.array([np.random.default_rng([seed, r]).multinomial(n, chances) for r in b.to_pylist()], pa.list_(pa.int64()))

    @F.arrow_udf("array<double>")
    def sums(j: pa.Array, b: pa.Array, t: pa.Array, v: pa.Array, k: pa.Array) -> pa.Array:
        out = []
        for j1, b1, t1, v1, k1 in zip(j.to_pylist(), b.to_pylist(), t.to_pylist(), v, k):
            x, w = (np.array(c.values, dtype=float) for c in (v1, k1))
            w /= w.sum()
            out.append([float((np.random.default_rng([seed, r, j1]).multinomial(m, w) * x).sum()) for r, m in zip(b1, t1)])
        return pa.array(out, pa.list_(pa.float64()))

    batch = 100  # rounds in a row
    tasks = max(1, math.ceil(rounds / batch / 4))
    drawn = distinct.sparkSession.range(0, rounds, 1, tasks).select("id", F.posexplode(split("id")).alias("q", "t"))
    drawn = drawn.groupBy(F.col("q").cast("bigint").alias("j"), F.floor(F.col("id") / batch).alias("g")).agg(F.array_sort(F.collect_list(F.struct("id", "t"))).alias("x"))
    rows = drawn.join(held.drop("n"), "j").repartition(min(10_000, tasks * len(sizes)), "j", "g")
    each = rows.select("j", "x.id", sums("j", "x.id", "x.t", "v", "k").alias("s")).select("j", F.inline(F.arrays_zip("id", "s")).alias("id", "s"))
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("j", "s"))), F.lit(0.0), lambda a, x: a + x["s"])  # in one order; one per block
    tails = each.groupBy("id").agg((added / n).alias("m")).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    one = distinct.agg(F.sum("k").alias("n"), (F.sum(F.col("v") * F.col("k")) / n).alias("mean"))
    return one.withColumn("_k", F.lit(1)).join(tails.withColumn("_k", F.lit(1)), "_k").drop("_k")


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two booleans: only_a, only_b, concordant."""
    x, y = F.col(a), F.col(b)
    return pairs.agg(F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(x == y).alias("concordant"))


def binomial_two_sided(b: int, c: int) -> float:
    """Exact p of McNemar's test."""
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n) if n else 1.0


def holm(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down thresholds: with rank, threshold and rejected. Ties are ordered by name.

    tests: name and p-value, one row per test (a few).
    """
    whole = Window.partitionBy(F.lit(1))
    order = whole.orderBy(p, "name")
    ranked = tests.withColumn("rank", F.row_number().over(order)).withColumn("threshold", F.lit(alpha) / (F.count(F.lit(1)).over(whole) - F.col("rank") + 1))
    passed = F.min((F.col(p) <= F.col("threshold")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("rejected", passed == 1)


def half_width(stdev: Column, n: Column, z: float = 1.96) -> Column:
    return F.coalesce(F.try_divide(F.lit(z) * stdev, F.sqrt(n)), F.lit(0.0))


def descriptives(rows: DataFrame, col: str, *by: str) -> DataFrame:
    q = lambda x: F.percentile(col, x)
    return rows.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr"))


def score_bin(c: Column) -> Column:
    """Six bins: zero, then fifths."""
    return F.when(c <= 0, 0).when(c < 0.2, 1).when(c < 0.4, 2).when(c < 0.6, 3).when(c < 0.8, 4).otherwise(5)


def nested_splits(rows: DataFrame, id_col: str, size_col: str, shares: tuple[int, ...] = (10, 20, 30), seed: int = 17, width: int = 10_000, hashed=None) -> DataFrame:
    """Stratified, nested splits: with stratum (quarter by size) and the smallest share a row is in, null for the rest.

    Strata are as ntile(4) makes them, rows of equal size in the order of a hash,
    so they stay balanced whatever the ties. Of each stratum the first rows by
    another hash are taken, for a share of x percent x percent of its rows,
    rounded up, so no stratum is left out. Rows without size are in no split.
    Places come from counts per range of the hash first (of about ``width``
    rows), so neither a stratum nor a frequent size is ever in one task.
    ``hashed`` gives a 62-bit hash of (id column, seed) instead of the built-in one.
    """
    rows = checkpointed(rows)
    known = rows.where(F.col(size_col).isNotNull())
    total = known.count()
    step = (1 << 62) // max(1, math.ceil(total / width)) + 1

    def placed(df: DataFrame, key: str, seed: int, whole: Window) -> DataFrame:
        """With _i, the place from 1 by the hash (within ``key``, or by ``key`` first): ``whole`` says where counting starts."""
        h = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 2) if hashed is None else hashed(F.col(id_col), seed)
        r = df.withColumn("_p", h).withColumn("_b", F.expr(f"_p div {step}L"))
        counts = r.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_k"))
        before = F.coalesce(F.sum("_k").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per key and range of the hash
        inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy("_p", id_col))
        starts = counts.select(key, "_b", before.alias("_s"))
        return r.withColumn("_j", inside).join(starts, [key, "_b"]).withColumn("_i", F.col("_s") + F.col("_j")).drop("_p", "_b", "_s", "_j")

    q, more = divmod(total, 4)  # the first ``more`` strata have q + 1 rows
    cut = more * (q + 1)
    stratum = F.expr(f"case when _i <= {cut} then (_i - 1) div {q + 1} + 1 else {more} + (_i - 1 - {cut}) div {max(q, 1)} + 1 end").cast("int")
    ranked = placed(known, size_col, seed, Window.partitionBy(F.lit(1)).orderBy(size_col, "_b"))
    strata = checkpointed(ranked.withColumn("stratum", stratum).drop("_i"))
    size = F.when(F.col("stratum") <= more, q + 1).otherwise(q)
    share = F.coalesce(*[F.when(F.col("_i") <= F.ceil(size * x / 100), x) for x in sorted(shares)])
    split = placed(strata, "stratum", seed + 1, Window.partitionBy("stratum").orderBy("_b")).withColumn("share", share.cast("int"))
    rest = rows.where(F.col(size_col).isNull()).withColumns({"stratum": F.lit(None).cast("int"), "share": F.lit(None).cast("int")})
    return split.select(*rows.columns, "stratum", "share").unionByName(rest)


def pareto_candidates(scores: DataFrame, candidate: str, example: str, score: str) -> DataFrame:
    """Candidates that are best on at least one example, and on how many: the pool a prompt search draws from.

    In: one score a candidate and example (the best one counts where there are more).
    """
    best = scores.groupBy(example).agg(F.max(score).alias("_best"))
    own = scores.where(F.col(score).isNotNull() & F.col(candidate).isNotNull()).groupBy(candidate, example).agg(F.max(score).alias("_s"))
    return own.join(best, example).where("_s = _best").groupBy(candidate).agg(F.count(F.lit(1)).alias("n_best"))


def eligible(items: DataFrame, texts: DataFrame, least_fields: int = 2) -> DataFrame:
    """Documents fit for a holdout: all their isolate ids stand in the text, and they have so many kinds of fields.

    items: doc_id, section, iso_id, field; texts: doc_id, text (one each).
    """
    ids = items.where("section in ('iwl', 'iwol') and iso_id is not null and iso_id <> 'NO_ISOLATE_ID'").select("doc_id", "iso_id").distinct()
    there = ids.join(texts.select("doc_id", "text"), "doc_id", "left").withColumn("hit", F.coalesce(F.contains("text", "iso_id"), F.lit(False)))
    whole = there.groupBy("doc_id").agg(F.bool_and("hit").alias("all_in_text"), F.count(F.lit(1)).alias("n_ids"))
    fields = items.where("field <> ''").groupBy("doc_id").agg(F.count_distinct("field").alias("n_fields"))
    return whole.join(fields, "doc_id").where(F.col("all_in_text") & (F.col("n_fields") >= least_fields)).select("doc_id", "n_ids", "n_fields")


def population(rows: DataFrame, by: list[str], result: str) -> DataFrame:
    """Shares of resistant, intermediate and susceptible isolates per group: total, present (with a result), r, i and s in percent."""
    n = F.count(result)
    share = lambda x: F.coalesce(F.try_divide(F.count_if(F.upper(result) == x) * F.lit(100.0), n), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), n.alias("present"), share("R").alias("r_percent"), share("I").alias("i_percent"), share("S").alias("s_percent"))
