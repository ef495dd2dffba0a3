"""External services behind small interfaces, with stand-ins that work offline.

An extractor maps texts to raw outputs; a fetcher maps ids to documents. Both
run per Arrow batch on executors and return (value, error), so one failure
never fails a job.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.budget import backoff


class Extractor(Protocol):
    """Texts in, raw outputs out, in the same order; may raise."""

    def __call__(self, texts: list[str]) -> list[str]: ...


class Replay:
    """Recorded answers by text; unknown texts raise."""

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = answers

    def __call__(self, texts: list[str]) -> list[str]:
        return [self.answers[t] for t in texts]


class RuleExtractor:
    """Accessions by pattern: a deterministic stand-in for a model."""

    pattern = re.compile(r"\b[A-Z]{2}\d{6,8}\b|\bPRJ[A-Z]{2}\d+\b|\bSAM[A-Z]{1,2}\d+\b")

    def __call__(self, texts: list[str]) -> list[str]:
        found = [list(dict.fromkeys(self.pattern.findall(t))) for t in texts]
        return ["Accessions\n" + "".join(f"- {a}\n" for a in x) + f"Total: {len(x)}" for x in found]


def with_retry(call: Callable[[], list[str]], attempts: int = 3, sleep: Callable[[float], None] = time.sleep, usable: Callable[[list[str]], bool] = lambda _: True) -> tuple[list[str] | None, list[str]]:
    """The first usable result and the outcomes of the attempts before it."""
    outcomes: list[str] = []
    for k in range(attempts):
        try:
            got = call()
            if usable(got):
                return got, outcomes
            outcomes.append("empty")
        except Exception as e:
            outcomes.append(f"{type(e).__name__}: {e}"[:200])
        if k + 1 < attempts:
            sleep(backoff(k, rate_limited="429" in outcomes[-1]))
    return None, outcomes


def extract(rows: DataFrame, id_col: str, text_col: str, extractor: Extractor, attempts: int = 1, batch: int = 16) -> DataFrame:
    """id, raw, error and ms per text; null texts aren't sent."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            ids, sent = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(ids), batch):
                part = [t for t in sent[k : k + batch] if t is not None]
                began = time.monotonic()
                got, outcomes = with_retry(lambda part=part: extractor(part), attempts) if part else ([], [])
                ms = int((time.monotonic() - began) * 1000)
                answers = iter(got or [None] * len(part))
                raw = [next(answers) if t is not None else None for t in sent[k : k + batch]]
                error = outcomes[-1] if got is None and outcomes else None
                n = len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + n], b.column(0).type), pa.array(raw, pa.string()), pa.array([error] * n, pa.string()), pa.array([ms] * n, pa.int64())], ["id", "raw", "error", "ms"])

    id_type = dict(rows.dtypes)[id_col]
    return rows.select(id_col, text_col).mapInArrow(run, f"id {id_type}, raw string, error string, ms bigint")


def token_usage(history: DataFrame, json_col: str) -> DataFrame:
    """Tokens in and out of a call's history as JSON, under any of the known names, and whether they are real."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(json_col, f"$.{p}").try_cast("int") for p in paths])
    places = [f"{a}{b}" for a in ("usage.", "response.usage.") for b in ("{}",)]
    tin = get(*[p.format(n) for p in places for n in ("prompt_tokens", "input_tokens")])
    tout = get(*[p.format(n) for p in places for n in ("completion_tokens", "output_tokens")])
    return history.withColumns({"tokens_in": tin, "tokens_out": tout, "is_actual": tin.isNotNull() & tout.isNotNull()})


def endpoint(service: str, **params: str) -> str:
    """The address of a literature service's search, link or fetch call."""
    from urllib.parse import urlencode

    return f"https://eutils.ncbi.nlm.nih.gov/entrez/eutils/{service}.fcgi?{urlencode(sorted(params.items()))}"


def provider(model: str) -> str:
    """Whose credentials a model name needs: the part before its slash."""
    return model.split("/", 1)[0] if "/" in model else "local"


class Chat:
    """A language model behind one call: prompts or message lists in, texts out.

    ``send`` maps a list of messages (role, content) to a text, or to its pieces
    where the service streams them.
    """

    def __init__(self, send: Callable[[list[dict]], str | Iterable[str]]) -> None:
        self.send = send

    def __call__(self, texts: list[str | list[dict]]) -> list[str]:
        return [joined(self.send([{"role": "user", "content": t}] if isinstance(t, str) else t)) for t in texts]


def joined(answer: str | Iterable[str | None]) -> str:
    """A streamed answer as one text; pieces without text are skipped."""
    return answer if isinstance(answer, str) else "".join(p for p in answer if p)


class Http:
    """Addresses in, documents out; a status other than 200 raises, so ``with_retry`` tries again."""

    def __init__(self, get: Callable[[str], tuple[int, str]] | None = None, pause: float = 0.34) -> None:
        self.get, self.pause = get or _get, pause

    def __call__(self, urls: list[str]) -> list[str]:
        out = []
        for url in urls:
            status, body = self.get(url)
            if status != 200:
                raise ConnectionError(f"{status} for {url}")
            out.append(body)
            time.sleep(self.pause)
        return out


def _get(url: str) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=30) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, ""


def links(ids: DataFrame, id_col: str, fetcher: Extractor, attempts: int = 3) -> DataFrame:
    """The PMC id that the link service names for each id: id, linked (null where there is none), error."""
    asked = ids.select(F.col(id_col).cast("string").alias("id")).distinct()
    url = F.concat(F.lit(endpoint("elink", dbfrom="pubmed", db="pmc", retmode="json") + "&id="), F.col("id"))
    got = extract(asked.withColumn("url", url), "id", "url", fetcher, attempts)
    first = F.get_json_object("raw", "$.linksets[0].linksetdbs[0].links[0]")
    return got.select("id", F.when(first.isNotNull(), F.concat(F.lit("PMC"), F.regexp_extract(first, r"(\d+)", 1))).alias("linked"), "error")


def labels(rows: DataFrame, id_col: str, text_col: str, extractor: Extractor, attempts: int = 1) -> DataFrame:
    """The class, 1 to 3, that a model gives an article: id, label (null where the answer names none), error."""
    got = extract(rows, id_col, text_col, extractor, attempts)
    return got.select("id", F.regexp_extract("raw", r"\b([123])\b", 1).try_cast("int").alias("label"), "error")


def with_attachments(texts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Article texts followed by the texts of their attachments, each under its name: id, text. Attachments without text are left out."""
    blocks = attachments.where("text is not null and error is null").groupBy("id").agg(F.array_sort(F.collect_list(F.concat(F.upper("name"), F.lit("\n"), F.col("text")))).alias("more"))
    joined_up = texts.select("id", "text").join(blocks, "id", "left")
    return joined_up.select("id", F.array_join(F.concat(F.array("text"), F.coalesce("more", F.array().cast("array<string>"))), "\n\n").alias("text"))
