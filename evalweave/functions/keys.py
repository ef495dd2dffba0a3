"""Reference keys: one plain form for article numbers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_pmcid(c: Column) -> Column:
    """``PMC`` and the digits of an article number, whatever way it is written.

    Case, blanks, separators, a missing prefix and a version ending (``.1``)
    don't matter. Null, blank and text without such a number give null.
    """
    digits = F.regexp_extract(c, r"(?iU)^[\s\p{Z}]*(?:PMC)?[\s\p{Z}\p{P}]*(\d+)(?:\.\d+)?[\s\p{Z}]*$", 1)
    digits = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def file_key(c: Column) -> Column:
    """The last component of a path in lower case; ``/`` and ``\\`` both separate.

    Null and blank paths, and paths that end in a separator, give null.
    """
    name = F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name != "", name)
