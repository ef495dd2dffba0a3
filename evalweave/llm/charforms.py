"""Visually identical text with different characters, brought to one form.

Method: a precomputed, conflict-checked mapping for widths, accents, blanks,
invisible and look-alike characters is compiled into a transducer over grapheme
clusters, which passes over a value once and takes the longest match: the whole
cluster, or else its base and its marks.

Three sources make the mapping. Unicode's compatibility decompositions give
widths, fonts, ligatures and Roman numerals; forms that are visibly different
(raised, lowered, circled, squared) are left out. Unicode's confusables (UTS 39),
read from ICU4J, which is part of Spark, give letters of other scripts and signs;
letters only become letters, signs only signs. A short list says what those two
don't. Letters of scripts that run from right to left don't stand where a Latin
letter would and stay. Invisible characters are transparent: they give nothing
and don't part a letter from its accent.
"""

from __future__ import annotations

import unicodedata
import zlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.gtjson import isolates, name, read_json

# Signs that look like the ASCII sign before the colon and aren't in the other sources, or otherwise.
_SIGNS = {"-": "—―", "!": "ǃ", "|": "ǀ"}
# Letters that look like the Latin letter before the colon and aren't in the other sources, or otherwise.
_LETTERS = {"g": "ɡ", "l": "ӏ"}

#: Compatibility forms that only differ by width, font or spacing from their plain characters.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<compat>")
#: Format characters with a shape of their own.
_SHOWN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Characters that may look like others; ideographs and syllables of Hangul don't.
_POINTS = (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1F000))
_LATIN = regex.compile(r"\p{Latin}")
#: Clusters that a transducer remembers; then it starts anew. Bounds memory only.
_REMEMBERED = 100_000


def _add(table: dict[str, str], key: str, value: str) -> None:
    if table.setdefault(key, value) != value:
        raise ValueError(f"{key!r} would become both {table[key]!r} and {value!r}")


def invisible_characters() -> frozenset[str]:
    """Characters without a shape: format and control characters, fillers and variation selectors."""
    fillers = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180E), 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    shapeless = (c for c in range(0x110000) if c not in _SHOWN_FORMATS and unicodedata.category(chr(c)) in ("Cf", "Cc"))
    return frozenset(map(chr, [*fillers, *shapeless])) - frozenset("\t\n\v\f\r\x85")


def skeletons(spark: SparkSession) -> dict[str, str]:
    """The skeleton of each ASCII sign and of each character that may look like one, by ICU4J."""
    points = [*map(chr, range(0x21, 0x7F)), *(chr(c) for c in _POINTS if unicodedata.category(chr(c))[0] in "LPS")]
    builder = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder
    found = builder().build().getSkeleton("\n".join(points)).split("\n")
    return {c: k for c, k in zip(points, found, strict=True) if c.isascii() or k.isascii()}


def _look_alikes(skeleton: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Signs and letters that have the skeleton of an ASCII sign or letter."""
    classes: dict[str, list[str]] = {}
    for c, k in skeleton.items():
        if c.isascii():
            classes.setdefault(k, []).append(c)
    signs, letters = {}, {}
    for c, k in skeleton.items():
        if c.isascii() or k not in classes or _LATIN.match(c) or unicodedata.bidirectional(c) in ("R", "AL", "AN"):
            continue
        kind = unicodedata.category(c)
        as_signs = [a for a in classes[k] if not a.isalnum()]
        as_letters = [a for a in classes[k] if a.isalpha()]
        if kind[0] == "P" or kind in ("Sm", "Sk", "Lm"):
            if as_signs:
                signs[c] = as_signs[0]
        elif kind in ("Lu", "Ll", "Lo") and as_letters:
            upper = kind == "Lu" or (kind == "Lo" and k.isupper()) or regex.match(r"\p{Lisu}", c)
            letters[c] = next((a for a in as_letters if a.isupper() == bool(upper)), as_letters[0])
    return signs, letters


def build_mapping(skeleton: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """What becomes what in every value, and in values with Latin letters besides.

    Raises where two sources disagree, or where a result would be mapped again.
    """
    always: dict[str, str] = {}
    letters: dict[str, str] = {}
    for plain, alike in _SIGNS.items():
        for c in alike:
            _add(always, c, plain)
    for plain, alike in _LETTERS.items():
        for c in alike:
            _add(letters, c, plain)
    for c in map(chr, range(0x80, 0x20000)):
        tag = unicodedata.decomposition(c).partition(" ")[0]
        if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\x85\u2800":
            _add(always, c, " ")
        elif tag in _SAME_LOOK and c not in always and c != "ſ":
            plain = unicodedata.normalize("NFKC", c)
            shown = tag != "<compat>" or unicodedata.category(c)[0] in "LP" or unicodedata.category(c) == "Nl"
            if plain.isascii() and plain.strip() and " " not in plain and shown:
                _add(always, c, plain)
    for c in "\t\n\v\f\r":
        _add(always, c, " ")
    signs, alike = _look_alikes(skeleton)
    for c, plain in signs.items():
        if c not in always:  # the sources before say more
            _add(always, c, plain)
    for c, plain in alike.items():
        if c not in always and c not in letters:
            _add(letters, c, plain)
    for c in map(chr, range(0x1D400, 0x1D800)):  # letters of other scripts in mathematical fonts
        if (plain := letters.get(unicodedata.normalize("NFKC", c))) and c not in always:
            letters.setdefault(c, plain)
    for table in (always, letters):
        for c, plain in table.items():
            if any(x in always or x in letters for x in plain):
                raise ValueError(f"{c!r} becomes {plain!r}, which is mapped again")
    if both := always.keys() & letters.keys():
        raise ValueError(f"both a sign and a letter: {sorted(both)}")
    return always, letters


class Transducer:
    """The compiled mapping; ``clean`` gives the consistent form of a value."""

    def __init__(self, always: dict[str, str], letters: dict[str, str]) -> None:
        self._tables = {False: always, True: always | letters}
        self._known: dict[bool, dict[str, str]] = {False: {}, True: {}}
        self._invisible = invisible_characters()
        hidden = "".join(map(regex.escape, sorted(self._invisible)))
        # marks that follow a cluster behind invisible characters belong to it
        self._cluster = regex.compile(rf"\X(?:[{hidden}]+\p{{M}}+)*")
        self._latin = regex.compile(rf"[\p{{Latin}}{''.join(c for c, plain in always.items() if plain.isalpha())}]")
        self._plain = regex.compile(r"[\x20-\x7e]*")

    def _resolve(self, cluster: str, table: dict[str, str]) -> str:
        """The arc of a cluster: its base and marks, mapped and composed."""
        shown = "".join(c for c in cluster if c not in self._invisible)
        whole = table.get(shown)
        if whole is not None:
            return whole
        return unicodedata.normalize("NFC", "".join(table.get(c) or "".join(table.get(x, x) for x in unicodedata.normalize("NFD", c)) for c in shown))

    def clean(self, text: str) -> str:
        """Values without any Latin letter keep the letters of their script."""
        if self._plain.fullmatch(text):
            return text
        latin = bool(self._latin.search(text))
        table, known, out = self._tables[latin], self._known[latin], []
        if len(known) > _REMEMBERED:
            known.clear()
        for cluster in self._cluster.findall(text):
            piece = known.get(cluster)
            if piece is None:
                piece = self._resolve(cluster, table)
                if len(cluster) < 16:
                    known[cluster] = piece
            out.append(piece)
        return "".join(out)


_shared: dict[int, Transducer] = {}


def compiled(mapping: tuple[dict[str, str], dict[str, str]]) -> Transducer:
    """One per Python process and mapping."""
    key = zlib.crc32(repr(mapping).encode())
    if key not in _shared:
        _shared[key] = Transducer(*mapping)
    return _shared[key]


_FOUND = "array<struct<section_name:string,isolate_pos:int,field_name:string,value_pos:int,clean_value:string>>"
_ARROW = pa.list_(
    pa.struct(
        [("section_name", pa.string()), ("isolate_pos", pa.int32()), ("field_name", pa.string()), ("value_pos", pa.int32()), ("clean_value", pa.string())]
    )
)

def _values(doc):
    for k, (isolate, body) in enumerate(isolates(doc), 1):
        yield "iwl", k, "isolate_id", 1, isolate
        serotype = (body or {}).get("serotype")
        for p, v in enumerate(serotype if isinstance(serotype, list) else [serotype], 1):
            yield "iwl", k, "serotype", p, v
    loose = doc.get("isolate_without_linking") if isinstance(doc, dict) else None
    for k, v in enumerate(loose if isinstance(loose, list) else [], 1):
        yield "iwol", k, "isolate_id", 1, name(v, "isolate_id") if isinstance(v, dict) else v


def inconsistent_values(gt: DataFrame, id_col: str = "gt_id", json_col: str = "gt_json") -> DataFrame:
    """Isolate ids and serotypes that differ from their consistent form.

    Columns: gt_id, section_name, isolate_pos, field_name, value_pos,
    clean_value. Null or unparsable documents give no row, repeated rows count
    once. Documents of plain ASCII characters without escapes can't hold a case
    and never reach Python. The mapping has some thousand entries, whatever the data.
    """
    mapping = build_mapping(skeletons(gt.sparkSession))

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        clean, out = compiled(mapping).clean, []
        for t in texts:
            doc = read_json(t.as_py())
            out.append([(*at, c) for *at, v in _values(doc) if isinstance(v, str) and (c := clean(v)) != v] if doc else [])
        keys = [f.name for f in _ARROW.value_type]
        return pa.array([[dict(zip(keys, row)) for row in rows] for rows in out], type=_ARROW)

    found = found.asNondeterministic()  # or the filter below would read every document again
    may = gt.where(F.col(json_col).rlike(r"[^\x00-\x7E]|\\[utnrbf]"))
    rows = may.select(F.col(id_col).alias("gt_id"), found(F.col(json_col)).alias("v")).where(F.size("v") > 0)
    return rows.withColumn("_h", F.xxhash64("v")).dropDuplicates(["gt_id", "_h"]).select("gt_id", F.inline("v"))
