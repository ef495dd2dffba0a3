"""Incremental runs as Structured Streaming.

Sources are files or tables; all jobs run to completion with the availableNow
trigger and keep their state in the checkpoint location given.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalweave.operators.resolve import latest
from evalweave.session import checkpointed


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind (an extension); rows later than ``late`` don't count."""
    at = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    counted = at.groupBy(F.window("_t", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")


def once(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows of keys not seen before, within the watermark: idempotent intake."""
    return events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def budget_decisions(ledger: DataFrame, key: str, ts: str, tokens: str, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """A sliding token budget per key: for each use, the tokens in the window and whether it fits.

    State is the uses of the last ``seconds`` and their sum, nothing older; a use
    that doesn't fit isn't recorded, and each is looked at twice at most. When the
    watermark (``late`` behind) has passed the last of them, the key's state ends.
    Out: key, at_us, tokens, used, fits.
    """
    width = seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(zip(*state.get)) if state.exists else deque()
        used, out = sum(n for _, n in held), []
        rows = pd.concat(list(batches)).sort_values(["at_us", "tokens"])
        for t, n in zip(rows["at_us"].to_list(), rows["tokens"].to_list()):
            while held and held[0][0] <= t - width:
                used -= held.popleft()[1]
            out.append((k[0], t, n, used, used + n <= limit))
            if used + n <= limit:
                held.append((t, n))
                used += n
        if held:
            state.update(([t for t, _ in held], [n for _, n in held]))
            state.setTimeoutTimestamp(max((held[-1][0] + width) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "at_us", "tokens", "used", "fits"])

    at = F.col(ts).cast("timestamp")
    rows = ledger.select(F.col(key).cast("string").alias("key"), at.alias("_t"), F.unix_micros(at).alias("at_us"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("tokens"))
    return rows.where("_t is not null").withWatermark("_t", late).groupBy("key").applyInPandasWithState(
        step, "key string, at_us bigint, tokens bigint, used bigint, fits boolean", "at array<bigint>, size array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """The stream to its present end, into a parquet table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def run_upserts(changes: DataFrame, tracker_path: str, checkpoint: str, key: list[str], order: str, buckets: int = 64) -> None:
    """Changes merged into a tracker table, micro-batch by micro-batch.

    The tracker lies in ``buckets`` by a hash of its key (the same number for its
    whole life). A batch writes new versions of the buckets that it touches and
    then names them in the ``CURRENT`` table; a batch that is run again reads what
    stood before it and writes the same versions again. Versions that nothing
    names any more are deleted, except the last ones before the batch.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = checkpointed(batch.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")))
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return
        before = _versions(spark, tracker_path, batch_id)
        old = _read(spark, tracker_path, {b: v for b, v in before.items() if b in touched})
        rows = fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)
        merged = latest(rows, [*key, "_bucket"], order)
        merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{tracker_path}/v{batch_id}")
        spark.createDataFrame([(b, batch_id) for b in touched], "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{tracker_path}/CURRENT/batch={batch_id}")
        _forget(spark, tracker_path, {*before.values(), batch_id}, batch_id)

    query = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _versions(spark: SparkSession, tracker_path: str, before: int | None = None) -> dict[int, int]:
    """The version that each bucket has, of the batches before one."""
    try:
        named = spark.read.parquet(f"{tracker_path}/CURRENT")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    if before is not None:
        named = named.where(F.col("version") < before)
    return {r["bucket"]: r["version"] for r in named.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _read(spark: SparkSession, tracker_path: str, versions: dict[int, int]) -> DataFrame | None:
    out = None
    for v in sorted(set(versions.values())):  # at most one read a bucket
        part = spark.read.parquet(f"{tracker_path}/v{v}").where(F.col("_bucket").isin([b for b, w in versions.items() if w == v]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _forget(spark: SparkSession, tracker_path: str, keep: set[int], batch_id: int) -> None:
    """Deletes versions before a batch that no bucket had when it began."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(tracker_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) < batch_id and int(name[1:]) not in keep:
            fs.delete(status.getPath(), True)


def current(spark: SparkSession, tracker_path: str) -> DataFrame | None:
    """The tracker as it stands, None before the first batch."""
    rows = _read(spark, tracker_path, _versions(spark, tracker_path))
    return None if rows is None else rows.drop("_bucket")
