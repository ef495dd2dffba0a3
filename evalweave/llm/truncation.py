"""Texts that were cut off: found, and counted per source.

Method: a bounded sample of values is cut artificially to make positives; the
values themselves are the negatives, without the few that fits on other values
tell for cut. A logistic regression on hashed features (closing
characters, punctuation, what the end leaves open, distance to the lengths at
which many values end) is trained on them, and every record is scored. No rule
says which values are intact.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted on at most this many values, the first by hash.
SAMPLE = 3000
#: A length is a limit when at least one value in so many has it, so there are no more limits than that.
LIMIT_SHARE = 1000
#: Cuts made of each sampled value.
_CUTS = 2
#: Rounds in which negatives that the other folds tell for cut are left out.
_REFITS = 3
_FOLDS = 5
_BITS = 14

_MARK = re.compile(r"(?:\s*(?:\[(?:output |response |text )?(?:truncated|cut off|cut|incomplete)\]|<(?:cut|truncated|eot)>|\((?:truncated|cut off)\)|…|\.{3,}|�))+\s*$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+\S", re.M)
_TOTAL = re.compile(r"^\s*total\s*[:=]\s*(\d+)\s*$", re.I | re.M)
_END = re.compile(r"[.!?。！？][\"'”’»)\]]*$|[.!?]\s*\[\d+(?:[,–-]\s*\d+)*\]\.?$")


#: Distances of this power of two and more are far from a limit, as are lengths above all limits.
_FAR = 6


def to_limit(length: int, limits: list[int]) -> str:
    """How far a length is below the next of the ascending limits: 0, a power of two, or far."""
    k = bisect.bisect_left(limits, length)
    power = (limits[k] - length).bit_length() if k < len(limits) else _FAR
    return str(power) if power < _FAR else "far"


def features(text: str, limits: list[int]) -> list[str]:
    """Names of the features of a text's end and of what it leaves open."""
    body = text.rstrip()
    mark = _MARK.search(body)
    inner = body[: mark.start()].rstrip() if mark else body
    fences = body.count("```")
    curly, square, quotes = (text.count(a) - text.count(b) for a, b in ("{}", "[]", ("“", "”")))
    brace = text.find("{")
    structured = brace >= 0
    # a list of plain items, or prose
    items = 0 if structured else len(_ITEM.findall(body))
    kind = "json" if structured else "list" if items >= 2 or (items == 1 and len(body) < 120) else "prose"
    last = body[-1:]
    shape = "9" if last.isdigit() else "a" if last.isalpha() else last
    clip = lambda x: max(-2, min(3, x))
    opened = structured and (curly > 0 or square > 0)
    closed_json = structured and not opened
    after = body[body.rfind("}") + 1 :].strip(" \t\r\n`") if structured else ""
    out = [
        "bias",
        f"kind={kind}",
        f"{kind}:last={shape}",
        f"{kind}:curly={clip(curly)}",
        f"{kind}:square={clip(square)}",
        f"fence={fences % 2}",
        f"{kind}:fence={fences % 2}",
        f"{kind}:ticks={len(body) - len(body.rstrip('`'))}",
        f"quotes={quotes > 0}",
        f"mark={bool(mark)}",
        f"limit={to_limit(len(text), limits)}",
        f"{kind}:limit={to_limit(len(text), limits) == '0'}",
        f"opened={opened}",
    ]
    if structured:
        out.append(f"json:dquote={text.count(chr(34)) % 2}:{opened}")
        out.append(f"json:after={bool(after)}")
    if closed_json and after or kind == "prose":
        tail = after if closed_json else inner
        out.append(f"tail:end={bool(_END.search(tail)) and not mark}")
        out.append(f"tail:last={shape}:{tail[-2:-1] in '.!?'}")
        out.append(f"tail:paren={clip(tail.count('(') - tail.count(')'))}")
        out.append(f"tail:mark={bool(mark)}")
    if kind == "list":  # such a list closes with its total
        total = _TOTAL.search(body[body.rfind("\n") + 1 :])
        out.append(f"list:total={'none' if not total else 'right' if int(total[1]) == items else 'wrong'}")
    return out


# Traces that a break may leave.
_TRACES = ["", "", "", "", "", "", "", "…", "...", " ...", "[output truncated]", " [truncated]", " <cut>", "�", "\n"]


def _cut(text: str, rng: random.Random, limits: list[int]) -> str | None:
    """The value broken off somewhere, more often near the end or at a limit; None where nothing is left."""
    n = len(text.rstrip())
    if n < 2:
        return None
    at = limits[: bisect.bisect_left(limits, n)]
    where = rng.choice(at) if at and rng.random() < 0.3 else max(1, n - 1 - int(rng.expovariate(8 / n))) if rng.random() < 0.3 else rng.randrange(1, n)
    piece = text[:where]
    return piece + rng.choice(_TRACES) if piece.strip() else None


def _index(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode()) & ((1 << _BITS) - 1) for x in names]


def training_rows(text: str, limits: list[int], seed: int) -> list[tuple[bool, list[int]]]:
    """Whether cut, and the features, of a value as it is (at times padded) and of cuts of it."""
    if not text.strip():
        return []
    rng = random.Random(seed)

    def row(cut: bool, shown: str, at_limit: float) -> tuple[bool, list[int]]:
        # cuts are often made at a limit, and whole values may have that length by chance
        return cut, _index(features(shown, sorted({*limits, len(shown)}) if rng.random() < at_limit else limits))

    rows = [row(False, text + rng.choice(["", "", "", " ", "\n", "\n\n  "]), 0.1)]
    return rows + [row(True, p, 0.3) for _ in range(_CUTS) if (p := _cut(text, rng, limits))]


class Classifier:
    """Logistic regression on hashed features."""

    def __init__(self, weights: np.ndarray, limits: list[int]) -> None:
        self.weights, self.limits = weights, limits

    @classmethod
    def fit(cls, rows: list[tuple[bool, list[int]]], limits: list[int]) -> Classifier | None:
        """From labelled rows of features; None where no value could be cut, so that there is nothing to learn from."""
        if not any(cut for cut, _ in rows):
            return None
        groups = sorted(Counter((cut, tuple(sorted(x))) for cut, x in rows).items())  # equal rows are one with a weight
        used = sorted({k for (_, x), _ in groups for k in x})
        column = {k: c for c, k in enumerate(used)}
        x = np.zeros((len(groups), len(used)))
        for r, ((_, found), _) in enumerate(groups):
            x[r, [column[k] for k in found]] = 1.0
        y, n = np.array([float(cut) for (cut, _), _ in groups]), np.array([float(k) for _, k in groups])
        # equal rows are spread over the folds, so that a fit misses them only where there is a single one
        share = np.array([[(int(k) + (r + f) % _FOLDS) // _FOLDS for f in range(_FOLDS)] for r, k in enumerate(n)], float)
        keep = np.ones(len(groups), bool)
        for _ in range(_REFITS):  # a value is judged by fits that haven't seen it
            z = np.zeros(len(groups))
            for k in range(_FOLDS):
                others = keep & (n > share[:, k])
                z += share[:, k] * (x @ _newton(x[others], y[others], (n - share[:, k])[others]))
            keep = (y > 0) | (z <= 0)
        w = _newton(x[keep], y[keep], n[keep])
        weights = np.zeros(1 << _BITS)
        weights[used] = w
        return cls(weights, limits)

    def score(self, text: str | None) -> float | None:
        """The probability that a text was cut off; null for null and blank texts."""
        if text is None or not text.strip():
            return None
        z = float(sum(self.weights[k] for k in _index(features(text, self.limits))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _newton(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a ridge on rows that occur ``n`` times, both classes weighing the same."""
    balance = n * np.where(y > 0, 0.5 / max(1, (n * y).sum()), 0.5 / max(1, (n * (1 - y)).sum())) * n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (balance * (y - p)) - 0.3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def common_lengths(texts: DataFrame, text_col: str) -> DataFrame:
    """Lengths that far more values have than the lengths around them: likely limits.

    At least five values and one in LIMIT_SHARE have each, so they are few.
    """
    lengths = texts.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).groupBy(F.length(text_col).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    around = lengths.withColumn("band", F.expr("n div 50")).groupBy("band").agg(F.sum("k").alias("all"))
    near = lengths.withColumn("band", F.expr("n div 50")).join(around, "band")
    total = lengths.agg(F.sum("k").alias("k")).first()["k"] or 0
    rest = (F.col("all") - F.col("k")) / F.lit(49.0)
    return near.where((F.col("k") >= 5) & (F.col("k") >= 6 * rest) & (F.col("k") * LIMIT_SHARE >= total)).select("n", "k")


def fit(values: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> Classifier | None:
    """A classifier from a bounded sample of the values of a table, of any length.

    None without values, or where none can be cut. The sample's features are made
    where the values lie; no text goes to the driver.
    """
    limits = sorted(r["n"] for r in common_lengths(values, text_col).collect())  # at most LIMIT_SHARE
    hashed = values.where(F.trim(text_col) != "").select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"), F.col(text_col).alias("_t"))
    last = hashed.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h").alias("h")).first()["h"]
    if last is None:
        return None

    def rows(batches):
        for batch in batches:
            made = [r for h, t in zip(batch.column(0).to_pylist(), batch.column(1)) for r in training_rows(t.as_py(), limits, h)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.bool_()), pa.array([x for _, x in made], pa.list_(pa.int32()))], names=["cut", "x"])

    drawn = hashed.where(F.col("_h") <= last).dropDuplicates(["_h"]).mapInArrow(rows, "cut boolean, x array<int>")
    found = sorted((r["cut"], r["x"]) for r in drawn.collect())  # at most (1 + _CUTS) x sample rows of small numbers
    return Classifier.fit(found, limits)


def cut_off_score(text: Column, classifier: Classifier | None) -> Column:
    """The probability that a text was cut off; without a classifier null."""
    if classifier is None:
        return F.lit(None).cast("double")

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([classifier.score(t.as_py()) for t in texts], pa.float64())

    return score.asNondeterministic()(text)  # or a filter on the score would read every text again


def scored(values: DataFrame, id_col: str, text_col: str, keep: list[str], threshold: float = 0.5, classifier: Classifier | None = None) -> DataFrame:
    """Every record with its score and whether it was cut off; repeated rows count once.

    Columns: ``id_col``, ``keep``, score, cut_off. Null and blank values have a
    null score and aren't cut off. Whole texts are read; one shuffle of the small
    result drops repeats.
    """
    classifier = classifier or fit(values, id_col, text_col)
    rows = values.select(id_col, *keep, cut_off_score(F.col(text_col), classifier).alias("score"))
    return rows.withColumn("cut_off", F.coalesce(F.col("score") > threshold, F.lit(False))).distinct()


def cut_off_share(rows: DataFrame, source_col: str) -> DataFrame:
    """Per source: records with a text, cut ones, and their share."""
    with_text = rows.where("score is not null")
    return with_text.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut_off").alias("n_cut_off"), F.avg(F.col("cut_off").cast("int")).alias("share"))
