"""Scalar text functions as Column expressions.

All take and return Columns, stay inside generated code, and give null for null
unless they say otherwise. Blank handling follows Unicode, not ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"
_BLANKS = r"(?U)[\s\p{Z}]+"


def strip(c: Column) -> Column:
    """Without outer blanks, non-breaking ones included."""
    return F.regexp_replace(c, _EDGE, "")


def collapse(c: Column) -> Column:
    """Every run of blanks as one blank, none outside."""
    return strip(F.regexp_replace(c, _BLANKS, " "))


def strip_tags(c: Column) -> Column:
    """Markup tags become blanks, blanks collapse."""
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def head_and_tail(c: Column, limit: int, front: float = 0.7, marker: str = "\n[... truncated ...]\n") -> Column:
    """The first 70 % and last 30 % of ``limit`` characters around a marker; shorter texts stay."""
    a = int(limit * front)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(a)), F.lit(marker), F.right(c, F.lit(limit - a)))).otherwise(c)


def fit_tokens(c: Column, tokens: int, front: float = 0.7, marker: str = "\n\n[... content omitted ...]\n\n") -> Column:
    """Cut to about ``tokens`` tokens of four characters, keeping both ends."""
    limit = 4 * tokens
    a = int(limit * front)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(a)), F.lit(marker), F.right(c, F.lit(max(1, limit - a - 50))))).otherwise(c)


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def unify_dashes(c: Column) -> Column:
    """Figure, en, em, horizontal dashes and the minus sign as hyphens."""
    return F.translate(c, "‒–—―−", "-----")


# Code point, what it is, and its plain spelling; '' where it is deleted.
PROBLEM_CHARACTERS = [
    (0x00A0, "no-break space", " "),
    (0x200B, "zero-width space", ""),
    (0x200C, "zero-width non-joiner", ""),
    (0x200D, "zero-width joiner", ""),
    (0x200E, "left-to-right mark", ""),
    (0x200F, "right-to-left mark", ""),
    (0x202A, "left-to-right embedding", ""),
    (0x202B, "right-to-left embedding", ""),
    (0x202C, "end of embedding", ""),
    (0x202D, "left-to-right override", ""),
    (0x202E, "right-to-left override", ""),
    (0x2060, "word joiner", ""),
    (0xFEFF, "byte order mark", ""),
    (0x00AD, "soft hyphen", ""),
    (0x2028, "line separator", "\n"),
    (0x2029, "paragraph separator", "\n"),
    (0x2019, "right quote", "'"),
    (0x2018, "left quote", "'"),
    (0x201C, "left double quote", '"'),
    (0x201D, "right double quote", '"'),
    (0x2010, "hyphen", "-"),
    (0x2011, "no-break hyphen", "-"),
    (0x2012, "figure dash", "-"),
    (0x2013, "en dash", "-"),
    (0x2014, "em dash", "-"),
    (0x2212, "minus sign", "-"),
    (0x2020, "dagger", ""),
    (0x2122, "trade mark", "(TM)"),
    (0x00D7, "multiplication sign", "x"),
    # beyond those: more blanks, and marks that isolate a direction
    (0x2009, "thin space", " "),
    (0x202F, "narrow no-break space", " "),
    (0x3000, "ideographic space", " "),
    (0x2066, "left-to-right isolate", ""),
    (0x2067, "right-to-left isolate", ""),
    (0x2068, "first strong isolate", ""),
    (0x2069, "end of isolate", ""),
]


def plain_characters(c: Column) -> Column:
    """Invisible characters deleted, typographic ones as ASCII."""
    single = {chr(p): plain for p, _, plain in PROBLEM_CHARACTERS if len(plain) == 1}
    deleted = "".join(chr(p) for p, _, plain in PROBLEM_CHARACTERS if not plain)
    out = F.translate(c, "".join(single) + deleted, "".join(single.values()))
    for p, _, plain in PROBLEM_CHARACTERS:
        if len(plain) > 1:
            out = F.replace(out, F.lit(chr(p)), F.lit(plain))
    return out


def occurrences(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what)))) / F.lit(len(what))).cast("int")


def problem_characters() -> list[tuple[str, str, str]]:
    """The dimension of characters that are counted: kind, character, spelling."""
    return [("spelled" if plain else "deleted", chr(p), plain) for p, _, plain in PROBLEM_CHARACTERS]


def safe_text(c: Column) -> Column:
    """Stripped, dashes unified; null is ''."""
    return F.coalesce(unify_dashes(strip(c)), F.lit(""))


def split_list(c: Column) -> Column:
    """Values between commas, stripped, without blank ones."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def plain_superscript(c: Column) -> Column:
    """Superscript markup removed, phenotype pairs joined (``NAL CIP`` marks), upper case."""
    bare = F.regexp_replace(c, r"\^\{?-?|[{}]", "")
    return F.upper(F.regexp_replace(strip(bare), r"(?i)\b(NR|NAL|SXT)[\s-]*(CIP)\b", "$1$2"))


def tokens_contained(a: Column, b: Column) -> Column:
    """Whether all tokens of the shorter value are tokens of the longer one; false where one has none."""

    def toks(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(c, _BLANKS), lambda x: x != ""))

    x, y = toks(a), toks(b)
    small, large = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) > F.size(y), x).otherwise(y)
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_except(small, large)) == 0), F.lit(False))


def isolate_key(c: Column) -> Column:
    """Isolate ids without a leading word for strain and a leading p before the id proper."""
    low = F.lower(strip(c))
    return F.regexp_replace(F.regexp_replace(low, r"^(?:strain|isolate|str)[-_ ]", ""), r"^p(?=[a-z0-9])", "")


def same_isolate(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | (isolate_key(a) == isolate_key(b)), F.lit(False))


def safe_file_name(c: Column, fallback: str = "unnamed") -> Column:
    """A name any file system takes: no path, no reserved signs or names, at most 200 characters with its ending."""
    base = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r'[<>:"|?*\x00-\x1f]', "_")
    base = F.regexp_replace(base, r"^[ .]+|[ .]+$", "")
    base = F.when(F.upper(F.regexp_extract(base, r"^([^.]*)", 1)).rlike(r"^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), base)).otherwise(base)
    ending = F.regexp_extract(base, r"(\.[^.]{1,20})$", 1)
    stem = F.left(base, F.length(base) - F.length(ending))
    short = F.when(F.length(base) > 200, F.concat(F.left(stem, F.lit(200) - F.length(ending)), ending)).otherwise(base)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit(fallback))


def tail(c: Column, n: int = 300) -> Column:
    return F.right(c, F.lit(n))


def sample_label(key: Column, value: Column, n: int = 50) -> Column:
    return F.concat(key, F.lit("="), F.left(value, F.lit(n)))


def shortened_message(c: Column, limit: int = 2000, front: int = 1000, back: int = 500) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(front)), F.lit(" ... "), F.right(c, F.lit(back)))).otherwise(c)


def labelled_messages(messages: Column) -> Column:
    """An array of (role, text) as blocks with role labels; unknown roles are left out."""
    known = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant"))
    return F.array_join(F.transform(known, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.coalesce(m["text"], F.lit("")))), "\n\n")


def composed_input(sections: Column, tables: Column) -> Column:
    """Sections (name, text) with upper-case headers, then numbered tables."""
    heads = F.transform(sections, lambda s: F.concat(F.upper(s["name"]), F.lit("\n"), s["text"]))
    rows = F.transform(tables, lambda t, i: F.concat(F.lit("TABLE "), (i + 1).cast("string"), F.lit("\n"), t))
    return F.array_join(F.concat(heads, rows), "\n\n")


def message_lines(*messages: Column) -> Column:
    """The messages that aren't null, one a line."""
    return F.array_join(F.array_compact(F.array(*messages)), "\n")


def title_case(c: Column) -> Column:
    """A capital after everything that is no letter, small letters elsewhere."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.initcap(x)), "")


def search_query(pathogen: str, terms: list[str]) -> str:
    """A boolean search over title and abstract for a pathogen and any of the terms."""
    either = " OR ".join(f'"{t}"[Title/Abstract]' for t in terms)
    return f'("{pathogen}"[Title/Abstract]) AND ({either}) AND open access[filter]'


# Fixed value: what an output says that doesn't go through with its task.
_GIVES_UP = "will be extremely"


def self_truncated(c: Column) -> Column:
    """Whether an output stops of its own accord: it ends in dots or says that it would get too long; false for null."""
    return F.coalesce(F.endswith(F.rtrim(F.regexp_replace(c, r"\s+$", "")), F.lit("...")) | F.contains(c, F.lit(_GIVES_UP)), F.lit(False))


def metadata_only(c: Column) -> Column:
    """Whether an article's XML has neither abstract nor body; true for null."""
    return ~F.coalesce(F.contains(c, F.lit("<body>")) | F.contains(c, F.lit("<abstract>")), F.lit(False))


def conversation(messages: Column) -> Column:
    """An array of (role, text) as blocks under upper-case roles; the middle of long texts is left out."""
    blocks = F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(F.coalesce(m["role"], F.lit("unknown"))), F.lit("]\n"), shortened_message(F.coalesce(m["text"], F.lit("")))))
    return F.array_join(blocks, "\n\n")


def reasoning(c: Column) -> Column:
    """The reasoning of an answer, '' where there is none."""
    return F.coalesce(c, F.lit(""))


def require_text(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows``, if the columns are text; values that can't be compared as text are an error of the schema."""
    kinds = dict(rows.dtypes)
    if wrong := [c for c in columns if kinds[c] != "string"]:
        raise TypeError(f"not text: {wrong}")
    return rows
