"""Orders and running totals without a single task for all rows, or for all rows of a key.

Both work in two levels: totals per part run on over the parts, of which there are
few, and within each part over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.session import checkpointed

#: Microseconds of a span: 16 seconds, about the root of a decade.
SPAN_US = 16_000_000


def micros(ntz: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone; an interval, unlike a cast, doesn't depend on the session's zone."""
    seconds = (ntz - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def totals_at(changes: DataFrame, key: str, at: str, change: str, span: int = SPAN_US) -> DataFrame:
    """Per key and distinct time the sum of all changes up to then: key, at, total.

    ``at`` is a whole number; ``span`` the width of a part, best near the root of
    the range of ``at``. Rows of one key and time are summed before they meet.
    """
    # names of its own, whatever those of the input
    times = changes.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(change).alias("d")).groupBy("k", "t").agg(F.sum("d").alias("d")).withColumn("span", F.expr(f"floor(t / {span})"))
    spans = times.groupBy("k", "span").agg(F.sum("d").alias("net"))
    earlier = Window.partitionBy("k").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(F.col("k").alias("k2"), F.col("span").alias("span2"), F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("before"))
    so_far = Window.partitionBy("k", "span").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = times.join(starts, F.col("k").eqNullSafe(F.col("k2")) & F.col("span").eqNullSafe(F.col("span2")))
    return joined.select(F.col("k").alias(key), F.col("t").alias(at), (F.col("before") + F.sum("d").over(so_far)).alias("total"))


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with _r, the number of a range of ``order``: all of a lower range come first. Kept as a table, so it stays the same."""
    return checkpointed(rows.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()))


def numbered(rows: DataFrame, order: str, out: str = "i") -> DataFrame:
    """With a dense number from 1 by ``order`` (unique values)."""
    r = ranged(rows, order)
    sizes = r.groupBy("_r").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_r", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(order))
    return r.withColumn("_i", inside).join(F.broadcast(starts), "_r").withColumn(out, F.col("_s") + F.col("_i")).drop("_r", "_i", "_s")
