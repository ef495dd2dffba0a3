"""Same or near-same records across splits.

Method: an exact prefix-filter bipartite join on rare shingles. The shingles of
a text are ordered from rare to frequent; of two texts with Jaccard similarity
t or more, the first shingle they share lies within the first
n - ceil(t * n) + 1 of both. So only those prefixes are joined, evaluation side
against training side, with length and position filters. Prefixes are longer by a few shingles
than that, and as many common ones are asked for, which leaves hardly any pair
that isn't one; those are verified on the whole shingle sets.

Any order of shingles is exact; a good one is only faster. The order comes from
a sketch of counts of fixed size (``sketch_bits``), which grows with nothing and
may be broadcast. A shingle that the sketch proves to occur once can't be shared
and leaves the prefix. Texts with equal shingle sets are one class and are
joined once. All hashes, of shingles and of sets, are 64 bits wide.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.keys import plain_pmcid
from evalweave.operators.bloom import bloom_filter, with_might_contain
from evalweave.session import checkpointed

#: 2^24 counters of one byte: 16 MB at the driver and in each Python worker.
SKETCH_BITS = 24
_SLICE = 1 << 16
_FAN = 64
#: Common shingles asked for in the prefixes.
_COMMON = 4
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_REMEMBERED = 300_000


class Shingler:
    """Distinct hashes of the word sequences of a text, in ascending order."""

    def __init__(self, width: int) -> None:
        self.width, self._words = width, {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        n = len(words) - self.width + 1
        if n < 1:
            return np.empty(0, np.int64)
        known = self._words
        if len(known) > _REMEMBERED:
            known.clear()
        codes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            codes.append(h)
        one = np.array(codes, np.uint64)
        mixed = one[:n].copy()
        for k in range(1, self.width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[k : k + n]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _signature(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


def _scan(texts: DataFrame, width: int, bits: int) -> DataFrame:
    """Per text the hash of its shingle set; per partition its sketch, in slices."""
    schema = pa.schema([("id", pa.string()), ("class", pa.int64()), ("slice", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])

    def rows(ids=(), classes=(), slices=(), part=0, blobs=()):
        k, m = len(ids), len(slices)
        columns = [pa.array(ids or [None] * m, pa.string()), pa.array(classes or [None] * m, pa.int64())]
        columns += [pa.array(slices or [None] * k, pa.int32()), pa.array([part] * (k or m), pa.int32()), pa.array(blobs or [None] * k, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        shingler, counts = Shingler(width), None
        for batch in batches:
            ids, classes, sets = [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                h = shingler.hashes(text.as_py())
                if len(h):
                    ids.append(key.as_py())
                    classes.append(_signature(h))
                    sets.append(h)
            if sets:
                counts = np.zeros(1 << bits, np.uint8) if counts is None else counts
                at, c = np.unique(_buckets(np.concatenate(sets), bits), return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + c, 255)
                yield rows(ids, classes, part=part)
        if counts is not None:
            slices = counts.reshape(-1, min(_SLICE, 1 << bits))
            used = [k for k in range(len(slices)) if slices[k].any()]
            yield rows(slices=used, part=part, blobs=[zlib.compress(slices[k].tobytes(), 1) for k in used])

    return texts.select("id", "text").mapInArrow(run, "id string, class bigint, slice int, part int, blob binary")


def _merge(slices: DataFrame, n_parts: int) -> DataFrame:
    """Slices of all partitions summed, never more than 64 blobs in one group.

    Sums are kept as four-byte counters until ``_rank`` makes them bytes.
    """

    def add(table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column("blob"):
            raw = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8 if first else np.uint32)
            total = raw.astype(np.uint32) if total is None else total + raw
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([table.column("part")[0].as_py() // _FAN], pa.int32()), "blob": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    first = True
    while True:
        grouped = slices.groupBy("slice", F.expr(f"part div {_FAN}").alias("g"))
        slices = grouped.applyInArrow(add, "slice int, part int, blob binary")
        n_parts = -(-n_parts // _FAN)
        if n_parts <= 1:
            return slices
        slices = checkpointed(slices)
        first = False


def _rank(slices: DataFrame, bits: int) -> np.ndarray:
    """The sketch as one byte per counter: 0 none, 1 once, above that a log scale."""
    ranks = np.zeros(1 << bits, np.uint8).reshape(-1, min(_SLICE, 1 << bits))
    for r in slices.select("slice", "blob").collect():  # 2^bits counters whatever the data
        counts = np.frombuffer(zlib.decompress(r["blob"]), np.uint32)
        ranks[r["slice"]] = np.where(counts <= 1, counts, np.minimum(2 + 8 * np.log2(np.maximum(counts, 2) / 2), 255)).astype(np.uint8)
    return ranks.reshape(-1)


def _prefixes(texts: DataFrame, width: int, bits: int, threshold: float, ranks: np.ndarray) -> DataFrame:
    """Shingles of the prefix that may be shared, per text.

    Columns: h (shingle), class, packed: the set's size, the shingle's place and
    the text's sides in 31, 31 and 2 bits.
    """
    shared = texts.sparkSession.sparkContext.broadcast(ranks)  # 2^bits bytes
    schema = pa.schema([("class", pa.int64()), ("h", pa.list_(pa.int64())), ("packed", pa.list_(pa.int64()))])

    def run(batches):
        shingler, rank, seen = Shingler(width), shared.value, set()
        for batch in batches:
            classes, hashes, packed, offsets = [], [], [], [0]
            for text, side in zip(batch.column(0), batch.column(1)):
                h = shingler.hashes(text.as_py())
                once = (_signature(h), side.as_py())
                if not len(h) or once in seen:  # a copy's prefix is its class's prefix
                    continue
                if len(seen) > _REMEMBERED:
                    seen.clear()
                seen.add(once)
                r = rank[_buckets(h, bits)]
                order = np.lexsort((h, r))[: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + _COMMON]
                keep = np.flatnonzero(r[order] != 1)
                if len(keep):
                    classes.append(once[0])
                    hashes.append(h[order[keep]])
                    packed.append((np.int64(len(h)) << np.int64(33)) | (keep.astype(np.int64) << np.int64(2)) | np.int64(once[1]))
                    offsets.append(offsets[-1] + len(keep))
            if classes:
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), *(pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (hashes, packed))], schema=schema)

    found = texts.select("text", "side").mapInArrow(run, "class bigint, h array<bigint>, packed array<bigint>")
    return found.select("class", "packed", F.posexplode("h").alias("k", "h")).select("h", "class", F.expr("packed[k]").alias("packed"))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    @F.arrow_udf("array<bigint>")
    def shingles(column: pa.Array) -> pa.Array:
        shingler = Shingler(width)
        found = [shingler.hashes(t.as_py()) for t in column]
        offsets = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *found])))

    return texts.select("id", shingles("text").alias("shingles"))


def near_same(texts: DataFrame, sides: DataFrame, threshold: float = 0.8, width: int = 5, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """Near-same texts across two sides, as pairs of classes and their members.

    texts: id, text (unique ids; null texts and texts shorter than ``width``
    words have no shingles and match nothing). sides: id, left, right (booleans;
    a text may be on both). Similarity is Jaccard's over distinct sequences of
    ``width`` lower-case words, everything but letters and digits read as blank.

    Returns (pairs, members). members: id, class_id for every text with
    shingles that is on a side; equal shingle sets are one class, named after
    its least id. pairs: class_a <= class_b, similarity, for all classes one of
    which has a member on the left and the other one on the right; class_a =
    class_b where a class holds more than one text.
    """
    left = bloom_filter(sides.where("left"), "id")
    right = bloom_filter(sides.where("right"), "id")
    marked = with_might_contain(with_might_contain(texts.select("id", "text"), "id", left, "_l"), "id", right, "_r")
    # a text that the filters pass by mistake is dropped when classes are joined to their sides
    texts = marked.where("_l or _r").select("id", "text", (F.col("_l").cast("int") + F.col("_r").cast("int") * 2).alias("side"))

    scanned = checkpointed(_scan(texts, width, sketch_bits))
    parts = 1 + (scanned.agg(F.max("part").alias("m")).first()["m"] or 0)
    ranks = _rank(_merge(scanned.where("slice is not null").select("slice", "part", "blob"), parts), sketch_bits)
    sized = scanned.where("slice is null").select("id", "class").join(sides, "id")
    classes = sized.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("k"), F.bool_or("left").alias("left"), F.bool_or("right").alias("right"))
    classes = checkpointed(classes)
    members = sized.join(classes.select("class", "class_id"), "class").select("id", "class_id")

    # copies of a set meet in their task before the shuffle, and the rest after it
    rows = _prefixes(texts, width, sketch_bits, threshold, ranks).repartition("h").groupBy("h", "class").agg(F.bit_or("packed").alias("packed"))
    rows = rows.select("h", "class", F.expr("cast(packed >> 33 as int)").alias("n"), F.expr("cast((packed >> 2) & 2147483647 as int)").alias("i"), F.expr("cast(packed & 3 as int)").alias("side"))
    index = rows.where("side & 1 = 1").select("h", F.col("class").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"))
    probe = rows.where("side & 2 = 2").select("h", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    need = F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)
    left_over = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))  # places count from 0
    fits = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    met = index.join(probe, "h").where((F.col("a") != F.col("b")) & fits & (left_over >= need - (_COMMON - 1)))
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.first(need).alias("need"))
    likely = counted.where(F.col("common") >= F.least(F.lit(_COMMON), F.col("need"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda x: classes.select(F.col("class").alias(x), F.col("class_id").alias(f"class_{x}"), F.col("left").alias(f"l{x}"), F.col("right").alias(f"r{x}"))
    named = likely.join(of("a"), "a").join(of("b"), "b").where("(la and rb) or (lb and ra)")
    candidates = checkpointed(named.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")))

    wanted = candidates.select(F.explode(F.array("class_a", "class_b")).alias("id"))
    sets = _sets(with_might_contain(texts.select("id", "text"), "id", bloom_filter(wanted, "id"), "_c").where("_c").drop("_c"), width)
    of_a, of_b = sets.toDF("class_a", "x"), sets.toDF("class_b", "y")
    both = candidates.join(of_a, "class_a").join(of_b, "class_b").withColumn("o", F.size(F.array_intersect("x", "y")))
    similarity = F.col("o") / (F.size("x") + F.size("y") - F.col("o"))
    verified = both.select("class_a", "class_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    copies = classes.where(F.col("left") & F.col("right") & (F.col("k") > 1))
    return verified.unionByName(copies.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.lit(1.0).alias("similarity"))), members


def split_memberships(records: DataFrame, experiments: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per article number: the evaluation splits it has records in, and whether it has any in a training split.

    Records without an article number, an experiment or a split don't count.
    """
    named = experiments.where("split_name is not null and experiment_id is not null").select("experiment_id", "split_name").distinct()
    roles = named.join(catalog.select("split_name", F.col("split_role").alias("role")).distinct(), "split_name").where("role in ('train', 'eval')")
    rows = records.where("experiment_id is not null").select("experiment_id", plain_pmcid(F.col("pmcid")).alias("id")).where("id is not null").join(roles, "experiment_id")
    flat = rows.select("id", F.when(F.col("role") == "eval", F.col("split_name")).alias("split_name")).distinct()
    # as many names as there are evaluation splits
    return flat.groupBy("id").agg(F.collect_set("split_name").alias("eval_splits"), F.bool_or(F.col("split_name").isNull()).alias("in_train"))


def _near(records: DataFrame, experiments: DataFrame, catalog: DataFrame, documents: DataFrame, threshold: float, width: int, sketch_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memberships of the articles in splits; the classes of their texts; and the classes that are near one another, both ways."""
    members_of = checkpointed(split_memberships(records, experiments, catalog))
    texts = documents.where("doc_type = 'article' and text is not null").select(plain_pmcid(F.col("pmcid")).alias("id"), "text").where("id is not null")
    sides = members_of.select("id", (F.size("eval_splits") > 0).alias("left"), F.col("in_train").alias("right"))
    pairs, members = near_same(texts, sides, threshold, width, sketch_bits)
    ways = pairs.select(F.col("class_a").alias("ce"), F.col("class_b").alias("ct"), "similarity").unionByName(
        pairs.where("class_a <> class_b").select(F.col("class_b").alias("ce"), F.col("class_a").alias("ct"), "similarity")
    )
    return members_of, members, ways


def cross_split_overlaps(records: DataFrame, experiments: DataFrame, catalog: DataFrame, documents: DataFrame, threshold: float = 0.5, width: int = 3, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """All overlaps of evaluation splits with training splits, in plain article numbers.

    Columns: split_name, eval_pmcid, train_pmcid, similarity (1.0 where both are
    the same number). The result names every pair of articles, copies included,
    since that is its definition; the join before it works on classes.
    """
    members_of, members, ways = _near(records, experiments, catalog, documents, threshold, width, sketch_bits)
    known = members.join(members_of, "id")
    evals = known.where(F.size("eval_splits") > 0).select(F.col("class_id").alias("ce"), F.col("id").alias("eval_pmcid"), "eval_splits")
    trains = known.where("in_train").select(F.col("class_id").alias("ct"), F.col("id").alias("train_pmcid"))
    near = ways.join(evals, "ce").join(trains, "ct").where("eval_pmcid <> train_pmcid").select(F.explode("eval_splits").alias("split_name"), "eval_pmcid", "train_pmcid", "similarity")
    same = members_of.where(F.col("in_train")).select(F.explode("eval_splits").alias("split_name"), F.col("id").alias("eval_pmcid"), F.col("id").alias("train_pmcid"), F.lit(1.0).alias("similarity"))
    return near.unionByName(same)


def overlap_counts(records: DataFrame, experiments: DataFrame, catalog: DataFrame, documents: DataFrame, threshold: float = 0.5, width: int = 3, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """How many training articles each evaluation article overlaps with, from the sizes of classes.

    Columns: split_name, eval_pmcid, n (1 or more). Counts what
    ``cross_split_overlaps`` lists, without making its pairs.
    """
    members_of, members, ways = _near(records, experiments, catalog, documents, threshold, width, sketch_bits)
    in_class = members.join(members_of.where("in_train").select("id"), "id", "left_semi").groupBy(F.col("class_id").alias("ct")).agg(F.count(F.lit(1)).alias("k"))
    # a class that is near itself counts the article itself where that is in training, too
    near = ways.join(in_class, "ct").groupBy("ce").agg(F.sum("k").alias("k"), F.bool_or(F.col("ce") == F.col("ct")).alias("own"))
    rows = members_of.where(F.size("eval_splits") > 0).join(members.select("id", F.col("class_id").alias("ce")), "id", "left").join(near, "ce", "left")
    itself = F.when(F.col("in_train") & ~F.coalesce("own", F.lit(False)), 1).otherwise(0)
    counted = rows.select(F.explode("eval_splits").alias("split_name"), F.col("id").alias("eval_pmcid"), (F.coalesce("k", F.lit(0)) + itself).alias("n"))
    return counted.where("n > 0")
