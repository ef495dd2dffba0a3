"""Token budgets, costs and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.operators.ordered import SPAN_US, totals_at
from evalweave.session import checkpointed

# US dollars per million tokens, input and output, of the price groups.
PRICES = [("small", 1.0, 5.0), ("medium", 3.0, 15.0), ("large", 5.0, 25.0)]


def used_in_window(ledger: DataFrame, key: str, ts: str, tokens: str, seconds: int = 60) -> DataFrame:
    """Tokens used in the ``seconds`` up to each row, an age of exactly that long no longer counts.

    Uses are added when they come and taken off when they leave, so windows of
    any length cost the same and no key's history meets in one task. Null times
    give null, null tokens count as 0.
    """
    rows = _rows(ledger, key, tokens, F.unix_micros(F.col(ts).cast("timestamp")))
    uses = rows.where("_at is not null").select("_k", "_at", "_n")
    gone = uses.select("_k", (F.col("_at") + seconds * 1_000_000).alias("_at"), (-F.col("_n")).alias("_n"))
    used = totals_at(uses.unionByName(gone), "_k", "_at", "_n").select(F.col("_k").alias("_k2"), F.col("_at").alias("_t"), F.col("total").alias("used"))
    return _with(rows.join(used, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_at") == F.col("_t")), "left"), ledger, F.col("used"), "used")


def _rows(ledger: DataFrame, key: str, tokens: str, at: Column) -> DataFrame:
    """The ledger's rows as one column, so that no name of theirs clashes: _row, _k, _at, _n."""
    return ledger.select(F.struct("*").alias("_row"), F.col(key).alias("_k"), at.alias("_at"), F.coalesce(F.col(tokens), F.lit(0)).alias("_n"))


def _with(rows: DataFrame, ledger: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.select(*[F.col("_row")[c].alias(c) for c in ledger.columns if c != name], value.alias(name))


def waits(ledger: DataFrame, key: str, ts: str, tokens: str, limit: int, need: int, seconds: int = 60) -> DataFrame:
    """Seconds to wait after each row until ``need`` tokens fit under ``limit``.

    Oldest uses leave the window first; the wait ends a second after the one
    that frees enough. 0 where there is room, null where the need never fits.
    The use that frees enough is the first one whose running total reaches the
    present total plus need less limit, so it is looked up along the totals,
    again in two levels.
    """
    rows = _rows(ledger, key, tokens, F.unix_seconds(F.col(ts).cast("timestamp")))
    uses = rows.where("_at is not null").select("_k", F.col("_at").alias("_s"), "_n")
    gone = uses.select("_k", (F.col("_s") + seconds).alias("_s"), (-F.col("_n")).alias("_n"))
    second = SPAN_US // 1_000
    sums = totals_at(uses, "_k", "_s", "_n", second)
    held = totals_at(uses.unionByName(gone), "_k", "_s", "_n", second).withColumnRenamed("total", "held")
    both = checkpointed(sums.join(held.select(F.col("_k").alias("_k2"), F.col("_s").alias("_s2"), "held"), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_s") == F.col("_s2"))).drop("_k2", "_s2"))

    points = both.select("_k", F.col("total").alias("v"), F.col("_s").alias("at"), F.lit(None).cast("bigint").alias("ask"))
    asks = both.where(F.col("held") + need > limit).select("_k", (F.col("total") + (need - limit)).alias("v"), F.lit(None).cast("bigint").alias("at"), F.col("_s").alias("ask"))
    line = points.unionByName(asks).withColumn("b", F.expr(f"floor(v / {64 * max(1, limit)})"))
    after = Window.partitionBy("_k", "b").orderBy("v", F.col("ask").isNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    firsts = line.where("at is not null").groupBy("_k", "b").agg(F.min("at").alias("first"))
    parts = line.select("_k", "b").distinct().join(firsts.select(F.col("_k").alias("_k2"), F.col("b").alias("b2"), "first"), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("b") == F.col("b2")), "left").drop("_k2", "b2")
    later = Window.partitionBy("_k").orderBy("b").rowsBetween(1, Window.unboundedFollowing)  # one row per stretch of totals
    parts = parts.select(F.col("_k").alias("_k2"), F.col("b").alias("b2"), F.first("first", ignorenulls=True).over(later).alias("next"))
    found = line.withColumn("here", F.first("at", ignorenulls=True).over(after)).where("ask is not null")
    found = found.join(parts, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("b") == F.col("b2")), "left").select(F.col("_k").alias("_k3"), F.col("ask").alias("_s3"), F.coalesce("here", "next").alias("_freed"))
    out = rows.join(found, F.col("_k").eqNullSafe(F.col("_k3")) & (F.col("_at") == F.col("_s3")), "left")
    wait = F.when(F.col("_at").isNull(), None).when(F.col("_s3").isNull(), 0).when(F.lit(need) > limit, None).otherwise(F.col("_freed") + F.lit(seconds) - F.col("_at") + 1)
    return _with(out, ledger, wait.cast("bigint"), "wait_s")


def cost(tokens_in: Column, tokens_out: Column, usd_in: Column, usd_out: Column) -> Column:
    """Dollars for token counts at prices per million; unknown prices cost 0."""
    return F.coalesce((F.coalesce(tokens_in, F.lit(0)) * usd_in + F.coalesce(tokens_out, F.lit(0)) * usd_out) / F.lit(1e6), F.lit(0.0))


def optimisation_cost(evals: int, usd_in: float, usd_out: float, minibatch: int = 3, reflection_usd: float = 0.345, sgd: float = 1.35) -> dict[str, float]:
    """Estimated cost of a prompt search: full evaluations, then two reflections for each."""
    extraction = (12_000 * usd_in + 2_000 * usd_out) / 1e6
    iterations = 2 * evals
    usd = evals * extraction * minibatch + iterations * reflection_usd
    return {"extraction_usd": evals * extraction * minibatch, "reflection_usd": iterations * reflection_usd, "total_usd": usd, "total_sgd": usd * sgd}


def pilot_cost(mode: str, examples: int, usd_per_call: float) -> float:
    """Fixed multipliers of calls per example for the three search budgets."""
    return {"light": 12, "medium": 25, "heavy": 50}[mode] * examples * usd_per_call


def backoff(attempt: int, base: float = 2.0, most: float = 120.0, rate_limited: bool = False) -> float:
    """Delay before a retry: doubled each time up to ``most``, at least 30 s after a rate limit."""
    delay = min(base * 2**attempt, most)
    return max(delay, 30.0) if rate_limited else delay


def status_counts(rows: DataFrame, status: str, *by: str) -> DataFrame:
    """Totals and rates per status; ``success`` and ``found`` both count as found."""
    s = F.col(status)
    found, failed = F.count_if(s.isin("success", "found", "completed")), F.count_if(s.isin("failed", "fetch_failed"))
    total = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        total.alias("total"),
        found.alias("found"),
        failed.alias("failed"),
        F.count_if(s == "not_found").alias("not_found"),
        F.count_if(s.isNull()).alias("not_attempted"),
        F.coalesce(F.try_divide(found * F.lit(100.0), total), F.lit(0.0)).alias("rate"),
    )


def running_totals(rows: DataFrame, order: str, every: int, *sums: str) -> DataFrame:
    """Totals so far at every ``every``-th row.

    Ranges of rows are summed first, then the ranges' totals run on, so the
    order over all rows needs no single task. ``order`` must be a dense number from 1.
    """
    block = F.floor((F.col(order) - 1) / every)
    parts = rows.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias(order), *[F.sum(c).alias(c) for c in sums])
    wide = F.floor(F.col("b") / 1000)
    inner = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = parts.withColumn("g", wide)
    totals = groups.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    outer = Window.partitionBy(F.lit(1)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row per 1000 * every rows
    before = totals.select("g", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_{c}") for c in ("n", *sums)])
    out = groups.join(before, "g")
    return out.select(F.col(order), *[(F.col(f"_{c}") + F.sum(c).over(inner)).alias(c) for c in ("n", *sums)])


def size_summary(rows: DataFrame, tokens: str, *by: str) -> DataFrame:
    """Documents, tokens and tokens a document; documents without a count are left out."""
    known = rows.where(F.col(tokens).isNotNull())
    n, total = F.count(F.lit(1)), F.coalesce(F.sum(tokens), F.lit(0))
    return known.groupBy(*by).agg(n.alias("n_documents"), total.alias("n_tokens"), F.try_divide(total.cast("double"), n).alias("mean_tokens"))
