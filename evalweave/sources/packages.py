"""Attachments and packages of articles: text of attached files, members of tar archives."""

from __future__ import annotations

import io
import re
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.sources.files import PACKAGE_ENDINGS, ending, file_name

# Endings of attachments that are text.
TEXT_ENDINGS = ("csv", "tsv", "txt")


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Attached files as text: id (their folder), name, text, error (``empty`` or ``unsupported``, else null).

    Binary kinds need a reader of their own; they come out as unsupported, not dropped.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = ending(F.col("path"))
    text = F.when(kind.isin(*TEXT_ENDINGS), F.decode("content", "UTF-8"))
    rows = rows.select(F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+$", 1).alias("id"), file_name(F.col("path")).alias("name"), text.alias("text"), kind.alias("kind"))
    error = F.when(~F.col("kind").isin(*TEXT_ENDINGS), "unsupported").when(F.trim("text") == "", "empty")
    return rows.select("id", "name", "text", error.alias("error"))


def is_supplement(member: str) -> bool:
    """A member with an ending of a supplement or ``supp`` in its path, never XML."""
    end = member.rsplit(".", 1)[-1].lower() if "." in member else ""
    return end not in ("xml", "nxml") and (end in PACKAGE_ENDINGS or "supp" in member.lower())


def _free(name: str, taken: set[str]) -> str:
    stem, dot, end = name.rpartition(".")
    stem, end = (stem, dot + end) if dot else (name, "")
    k, out = 1, name
    while out in taken:
        out, k = f"{stem}_{k}{end}", k + 1
    taken.add(out)
    return out


def _members(data: bytes) -> list[tuple[str, str, bytes]]:
    out, taken = [], set()
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for m in tar:
            if m.isfile() and is_supplement(m.name):
                out.append((m.name, _free(re.sub(r"^.*/", "", m.name), taken), tar.extractfile(m).read()))
    return out


def package_members(packages: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """Supplements in tar archives: id, member, name (renamed where it is taken), size, content, error.

    An archive that can't be read gives one row with its error. Archives are read
    one at a time where they lie.
    """
    schema = pa.schema([("id", pa.string()), ("member", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [(key, m, n, len(c), c, None) for m, n, c in _members(data.as_py() or b"")] or [(key, None, None, None, None, None)]
                except (tarfile.TarError, EOFError, OSError) as e:
                    rows = [(key, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return packages.select(F.col(id_col).cast("string").alias("id"), F.col(content_col)).mapInArrow(run, "id string, member string, name string, size bigint, content binary, error string")


def package_manifest(members: DataFrame) -> DataFrame:
    """Per package whether it was read, its members and their size: id, status, n_files, n_bytes, error."""
    bad = F.max("error")
    return members.groupBy("id").agg(F.when(bad.isNull(), "success").otherwise("failed").alias("status"), F.count("member").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), bad.alias("error"))
