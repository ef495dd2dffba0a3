"""A Bloom filter made of DataFrame operations, small enough to broadcast.

The filter is a table of at most ``words`` rows (``word``, ``bits``): a key sets
a few bits of one 64-bit word. It is built by one partial-then-final aggregate
and probed by a hash join on the word, both inside generated code. ``words_for``
sizes it for a number of keys up to a limit; with more keys than it has room
for, more keys pass as possible members and none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^17 words: 8.4 million bits, about 3 MB as a broadcast hash table; room for 500,000 keys.
DEFAULT_WORDS = 1 << 17
#: 2^22 words: 268 million bits, about 100 MB as a broadcast hash table; room for 17 million keys.
MAX_WORDS = 1 << 22
_KEYS_PER_WORD = 4


def words_for(keys: DataFrame, key_col: str, least: int = 1 << 10, most: int = MAX_WORDS) -> int:
    """Words for the distinct keys of a table, a power of two: some 3 percent of other keys pass, more only beyond ``most``."""
    n = keys.agg(F.approx_count_distinct(key_col).alias("n")).first()["n"]
    return min(most, max(least, 1 << max(0, (n // _KEYS_PER_WORD)).bit_length()))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(17))
    bits = [F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int") for k in range(3)]
    one = [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in bits]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2])


def bloom_filter(keys: DataFrame, key_col: str, words: int = DEFAULT_WORDS) -> DataFrame:
    """The filter's table. Null keys are no members; no keys give no rows."""
    k = F.col(key_col)
    return keys.where(k.isNotNull()).groupBy(_word(k, words).alias("word")).agg(F.bit_or(_mask(k)).alias("bits"))


def with_might_contain(df: DataFrame, key_col: str, bloom: DataFrame, out_col: str, words: int = DEFAULT_WORDS) -> DataFrame:
    """``df`` with ``out_col``: false proves that the key isn't a member.

    ``bloom`` has at most ``words`` rows, so it may be broadcast. Null keys give false.
    """
    k = F.col(key_col)
    small = F.broadcast(bloom.select(F.col("word").alias("_bw"), F.col("bits").alias("_bits")))
    probed = df.withColumn("_w", _word(k, words)).join(small, F.col("_w") == F.col("_bw"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(_mask(k)) == _mask(k), F.lit(False)) & k.isNotNull()
    return probed.withColumn(out_col, hit).drop("_w", "_bw", "_bits")
