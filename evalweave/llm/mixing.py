"""Mixing sources to target weights, small sources repeated a capped number of times.

Method: each source's tokens are packed into blocks of a fixed length; counts
per source are drawn for every output shard from one multinomial distribution;
slots are mapped through a pseudorandom permutation of each source's block
numbers, a new one for each pass; and blocks are joined to slots by number.

Caps are resolved before the draws, which gives each source's number of slots.
Draws stray from those by about their root, so the slots that a source draws
beyond its number go to the sources that drew fewer: the blend has each share as
nearly as whole blocks allow, and no cap is passed.

Every step is distributed. A shard's draw follows from the seed and the shard's
number, a slot's block from the seed, the source's name and the slot's number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.bpe import token_ids
from evalweave.session import checkpointed

#: Targets are a small fixed table; more rows than this are an error.
MAX_SOURCES = 1000
#: Shards are counted in so many groups, which bounds the rows of their running totals.
_GROUPS = 1024
#: Feistel rounds.
_ROUNDS = 6
#: Slots, and shares of shards, that a Python worker holds at once.
_AT_ONCE = 1 << 18


@dataclass
class SourcePlan:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    blocks: int
    slots: int = 0


def allocate(total: int, shares: list[float], room: list[int]) -> list[float]:
    """``total`` split by shares, none above its room.

    What a full source can't take goes to the others in proportion to their
    shares, which keeps every other share as near its target as the caps allow.
    """
    given = [0.0] * len(shares)
    full: set[int] = {k for k in range(len(shares)) if shares[k] <= 0 or room[k] <= 0}
    while len(full) < len(shares):
        left = total - sum(given[k] for k in full)
        weight = sum(shares[k] for k in range(len(shares)) if k not in full)
        over = [k for k in range(len(shares)) if k not in full and left * shares[k] / weight >= room[k]]
        if not over:
            for k in range(len(shares)):
                if k not in full:
                    given[k] = left * shares[k] / weight
            break
        for k in over:
            given[k] = float(room[k])
            full.add(k)
    return given


class Blend:
    """A blend of ``documents`` by ``targets``.

    documents: doc_id, text, source; documents without a target source, without
    a source or without tokens are not part of it. targets: source,
    target_share, max_repeats (null or below 1: not used). The blend's size is
    ``total_tokens``, by default the tokens of all target sources together, where
    capped sources fall short; ``"exact"`` is the largest size at which no cap
    binds and all sources that have tokens keep the proportions of their targets.
    A source is packed in parts of about ``part_tokens``, so it is never in one
    task however big it is.
    """

    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        total_tokens: int | str | None = None,
        block_tokens: int = 512,
        slots_per_shard: int = 1024,
        part_tokens: int = 1 << 23,
        seed: int = 17,
        vocabulary: str | None = None,
    ) -> None:
        self.spark, self.block_tokens, self.seed = documents.sparkSession, block_tokens, seed
        rows = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} target sources")
        wanted = {r["source"]: (float(r["share"] or 0), max(0, r["repeats"] or 0)) for r in rows if r["source"] is not None}

        docs = documents.where(F.col("source").isin(list(wanted))).select("doc_id", "source", token_ids(F.col("text"), vocabulary).alias("ids"))
        self.docs = checkpointed(docs.where(F.size("ids") > 0).withColumn("n", F.size("ids")))
        have = {r["source"]: r["n"] for r in self.docs.groupBy("source").agg(F.sum("n").alias("n")).collect()}
        self.parts = self.spark.createDataFrame([(s, math.ceil(n / part_tokens)) for s, n in have.items()], "source string, parts int")  # at most MAX_SOURCES rows

        plans = [SourcePlan(s, w, m, have.get(s, 0), math.ceil(have.get(s, 0) / block_tokens)) for s, (w, m) in sorted(wanted.items())]
        usable = [p for p in plans if p.target_share > 0 and p.tokens * p.max_repeats > 0]
        if total_tokens == "exact":
            weight = sum(p.target_share for p in usable)
            total = int(min((p.tokens * p.max_repeats * weight / p.target_share for p in usable), default=0))
        else:
            total = sum(p.tokens for p in plans) if total_tokens is None else total_tokens
        for p, given in zip(plans, allocate(total, [p.target_share for p in plans], [p.tokens * p.max_repeats for p in plans])):
            # a source's last block is short, so its blocks are a little less than block_tokens on average
            p.slots = min(round(given / p.tokens * p.blocks), p.blocks * p.max_repeats) if p.tokens else 0
        self.plans, self.slots_per_shard = plans, slots_per_shard
        self.n_slots = sum(p.slots for p in plans)

    def _draws(self) -> DataFrame:
        """How many slots each shard draws of each source: shard, s (number of the source), k, at (slots before)."""
        per_shard, n_slots, seed = self.slots_per_shard, self.n_slots, self.seed
        weights = np.array([p.slots for p in self.plans], float)
        shares = weights / max(1.0, weights.sum())
        schema = pa.schema([("shard", pa.int64()), ("s", pa.int32()), ("k", pa.int32()), ("at", pa.int32())])

        def run(batches):
            step = max(1, _AT_ONCE // max(1, len(shares)))
            for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
                shards = batch.column(0).to_numpy()
                sizes = np.minimum(per_shard, n_slots - shards * per_shard)
                k = np.stack([np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(n, shares) for shard, n in zip(shards.tolist(), sizes.tolist())])
                at = np.cumsum(k, axis=1) - k
                row, s = np.nonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array(shards[row]), pa.array(s.astype(np.int32)), pa.array(k[row, s].astype(np.int32)), pa.array(at[row, s].astype(np.int32))], schema=schema)

        return self.spark.range(math.ceil(n_slots / per_shard)).mapInArrow(run, "shard bigint, s int, k int, at int")

    def slots(self) -> DataFrame:
        """Every slot of the blend: shard, slot, source, pass, block."""
        draws = checkpointed(self._draws()).withColumn("g", F.expr(f"shard div {max(1, math.ceil(self.n_slots / self.slots_per_shard / _GROUPS))}"))
        # running numbers of slots in two levels: groups of shards, then the shards of a group
        groups = draws.groupBy("s", "g").agg(F.sum("k").alias("k"))  # at most _GROUPS rows a source
        totals = {r["s"]: r["k"] for r in groups.groupBy("s").agg(F.sum("k").alias("k")).collect()}
        over_groups = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
        bases = groups.select("s", "g", F.coalesce(F.sum("k").over(over_groups), F.lit(0)).alias("base"))
        over_shards = Window.partitionBy("s", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        placed = draws.withColumn("within", F.coalesce(F.sum("k").over(over_shards), F.lit(0))).join(F.broadcast(bases), ["s", "g"])
        placed = placed.select("shard", "s", "k", "at", (F.col("base") + F.col("within")).alias("first"))

        per_shard, n_slots, seed = self.slots_per_shard, self.n_slots, self.seed
        drawn = np.array([totals.get(s, 0) for s in range(len(self.plans))], np.int64)
        wanted, blocks = (np.array(x, np.int64) for x in ([p.slots for p in self.plans], [p.blocks for p in self.plans]))
        keys = np.array([xxhash.xxh64_intdigest(p.source, seed & 0xFFFFFFFF) for p in self.plans], np.uint64)
        surplus, lack = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
        surplus_at, lack_at = np.cumsum(surplus) - surplus, np.cumsum(lack) - lack
        names = pa.array([p.source for p in self.plans], pa.string())
        schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source", pa.string()), ("pass", pa.int32()), ("block", pa.int64())])

        def run(batches):
            step = max(1, _AT_ONCE // per_shard)  # a row has at most ``per_shard`` slots
            for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
                shard, s, k, at, first = (c.to_numpy() for c in batch.columns)
                row = np.repeat(np.arange(len(k)), k)
                j = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                source, number = s[row], first[row] + j
                over = number >= wanted[source]  # beyond the source's number: given to one that drew fewer
                q = surplus_at[source[over]] + number[over] - wanted[source[over]]
                taker = np.searchsorted(lack_at, q, side="right") - 1
                source[over], number[over] = taker, drawn[taker] + q - lack_at[taker]
                size = np.minimum(per_shard, n_slots - shard[row] * per_shard)
                slot = permuted(at[row] + j, size, mixed(shard[row].astype(np.uint64) + np.uint64(seed)))
                turn, index = np.divmod(number, blocks[source])
                block = permuted(index, blocks[source], mixed(keys[source] + turn.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array((slot + 1).astype(np.int32)), names.take(pa.array(source)), pa.array((turn + 1).astype(np.int32)), pa.array(block)], schema=schema)

        return placed.mapInArrow(run, "shard bigint, slot int, source string, pass int, block bigint")

    def blocks(self) -> DataFrame:
        """The packed sources: source, block, n_tokens, ids (the last one may be short)."""
        size = self.block_tokens
        docs = self.docs.join(F.broadcast(self.parts), "source").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.col("parts")))
        sums = docs.groupBy("source", "part").agg(F.sum("n").alias("n"))
        by_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
        bases = sums.select("source", "part", F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("base"))
        order = Window.partitionBy("source", "part").orderBy(F.xxhash64("doc_id", F.lit(self.seed + 1)), "doc_id")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = docs.withColumn("before", before).join(bases, ["source", "part"]).withColumn("off", F.col("base") + F.col("before"))
        piece = F.explode(F.sequence(F.expr(f"off div {size}"), F.expr(f"(off + n - 1) div {size}")))
        cut = placed.select("source", "off", "n", "ids", piece.alias("block")).select(
            "source",
            "block",
            F.expr(f"greatest(off, block * {size})").alias("from"),
            F.expr(f"slice(ids, cast(greatest(block * {size} - off, 0) + 1 as int), {size} - cast(greatest(off - block * {size}, 0) as int))").alias("part"),
        )
        # a block holds at most ``block_tokens`` pieces
        joined = cut.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("from", "part"))).alias("parts"))
        ids = F.flatten(F.col("parts.part"))
        return joined.select("source", "block", F.size(ids).alias("n_tokens"), ids.alias("ids"))

    def rows(self) -> DataFrame:
        """The blend: shard, slot, source, pass, block, n_tokens, ids."""
        return self.slots().join(self.blocks(), ["source", "block"]).select("shard", "slot", "source", "pass", "block", "n_tokens", "ids")

    def shares(self) -> DataFrame:
        """Per target source: its share and repeats in the blend against the wanted ones."""
        plan = self.spark.createDataFrame(
            [(p.source, p.target_share, p.max_repeats, p.tokens, p.blocks) for p in self.plans],
            "source string, target_share double, max_repeats int, source_tokens bigint, blocks bigint",
        )
        size = self.block_tokens
        tail = F.when(F.col("block") == F.col("blocks") - 1, F.col("source_tokens") - F.col("block") * size).otherwise(F.lit(size))
        used = self.slots().join(F.broadcast(plan), "source").groupBy("source").agg(F.sum(tail).alias("blend_tokens"), F.max("pass").alias("passes"))
        out = plan.join(used, "source", "left")
        blend = F.coalesce("blend_tokens", F.lit(0))
        whole = Window.partitionBy(F.lit(1))  # over one row per target source
        return out.select(
            "source",
            "target_share",
            F.coalesce(F.try_divide(blend, F.sum(blend).over(whole)), F.lit(0.0)).alias("actual_share"),
            "max_repeats",
            F.coalesce("passes", F.lit(0)).alias("passes"),
            F.coalesce(F.try_divide(blend, F.col("source_tokens")), F.lit(0.0)).alias("repeats"),
            "source_tokens",
            blend.alias("blend_tokens"),
        )


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``x`` by a pseudorandom permutation of range(n), chosen by ``key``; all of one length, n below 2^62.

    A Feistel network over two halves of about the root of n, so products stay
    below 2^63 and no two neighbours keep a fixed distance. Numbers that fall
    beyond n are sent through again until they don't.
    """
    out, n = x.astype(np.uint64), n.astype(np.uint64)
    b = np.maximum(np.ceil(np.sqrt(n.astype(float))), 1).astype(np.uint64)
    a = (n + b - np.uint64(1)) // b
    todo = np.arange(len(out))
    while len(todo):
        left, right = np.divmod(out[todo], b[todo])
        for r in range(_ROUNDS):
            k = key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            if r % 2:
                left = (left + mixed(right ^ k) % a[todo]) % a[todo]
            else:
                right = (right + mixed(left ^ k) % b[todo]) % b[todo]
        out[todo] = left * b[todo] + right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)
