"""References to records that do not exist, or not at the time they were used.

Method: a broadcast Bloom filter of the parent keys proves definite orphans;
only references that pass it are checked exactly.

The exact check asks how many targets of a key are present at a time. It is a
sweep in two levels over the distinct times of a key, so a key with a third of
all rows never meets in one task: changes are summed per key and time first, then
per key and span of 16 seconds; running totals over the spans give the number
present when one begins, and running totals within a span the number at a time.
A span has at most 16 million distinct times and a decade 20 million spans. Both
sides may repeat a key or a time as often as they like; no pairs of references
and targets are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.keys import file_key, plain_pmcid
from evalweave.operators.bloom import bloom_filter, with_might_contain, words_for
from evalweave.operators.ordered import micros, totals_at
from evalweave.session import checkpointed

_NEVER = "9999-12-31 23:59:59"


def orphans(refs: DataFrame, targets: DataFrame, words: int | None = None) -> DataFrame:
    """The references with no target present at their time, once each.

    refs: row_id, key, at. A null key is no reference; a null time stands for
    the end of time (only targets that are never removed count).
    targets: key, start, end. Present from start, inclusive, to end, exclusive;
    a null end never comes, and without a start a target was never present.
    Result: row_id, at, proven (true: by the Bloom filter alone). Empty inputs
    are fine: without targets all references are orphans. ``words``: the size of
    the filter; by default it follows the number of keys, up to a limit.
    """
    end_of_time = F.to_timestamp_ntz(F.lit(_NEVER))
    ref = refs.where("key is not null").select("row_id", "key", F.col("at").cast("timestamp_ntz").alias("at"))
    target = targets.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    target = target.where("key is not null and start is not null and (end is null or end > start)")

    target = checkpointed(target)  # keys are read off their texts once
    words = words or words_for(target, "key")
    marked = checkpointed(with_might_contain(ref, "key", bloom_filter(target, "key", words), "maybe", words))
    proven = marked.where(~F.col("maybe")).select("row_id", "at", F.lit(True).alias("proven"))

    moves = target.select("key", micros(F.col("start")).alias("t"), F.lit(1).alias("d")).unionByName(
        target.where("end is not null").select("key", micros(F.col("end")).alias("t"), F.lit(-1).alias("d"))
    )
    asks = marked.where("maybe").select("row_id", "key", "at", micros(F.coalesce("at", end_of_time)).alias("t"))
    # a time that is only asked for changes nothing
    present = totals_at(moves.unionByName(asks.select("key", "t", F.lit(0).alias("d"))), "key", "t", "d")
    late = asks.join(present.where("total <= 0"), ["key", "t"], "left_semi").select("row_id", "at", F.lit(False).alias("proven"))
    return proven.unionByName(late).dropDuplicates(["row_id", "at"])


def _article_key(c: Column) -> Column:
    """The plain article number; other non-blank text is a reference as it is written."""
    return F.coalesce(plain_pmcid(c), F.nullif(F.upper(F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit("")))


def orphan_references(record_results: DataFrame, articles: DataFrame, xml_files: DataFrame, words: int | None = None) -> DataFrame:
    """Orphans of record_results (to articles) and of articles (to xml_files).

    Columns: table_name, row_id, month (of the reference's time), proven.
    """
    by_article = orphans(
        record_results.select(F.col("result_id").alias("row_id"), _article_key(F.col("pmcid")).alias("key"), F.col("evaluated_at").alias("at")),
        articles.select(_article_key(F.col("pmcid")).alias("key"), F.col("loaded_at").alias("start"), F.col("withdrawn_at").alias("end")),
        words,
    )
    by_file = orphans(
        articles.select(F.col("article_id").alias("row_id"), file_key(F.col("xml_filepath")).alias("key"), F.col("loaded_at").alias("at")),
        xml_files.select(file_key(F.col("file_path")).alias("key"), F.col("arrived_at").alias("start"), F.col("removed_at").alias("end")),
        words,
    )
    both = by_article.withColumn("table_name", F.lit("record_results")).unionByName(by_file.withColumn("table_name", F.lit("articles")))
    return both.select("table_name", "row_id", F.date_format("at", "yyyy-MM").alias("month"), "proven")


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Orphans per table and month, and how many the filter alone had proven."""
    return found.groupBy("table_name", "month").agg(F.count(F.lit(1)).alias("orphans"), F.count_if("proven").alias("proven_by_filter"))
