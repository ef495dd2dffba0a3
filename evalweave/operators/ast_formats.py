"""The notations susceptibility data are written in: told apart and read.

A value is cut into entries, and every entry is read once into its parts: the
code before a colon, the name, the disc amount in it, the link and the mark
(``TET: tetracycline - Resistant``, ``CIP-5-S``). A notation is a number, what its
entries' parts must be like, and how drugs are made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import plain_superscript, strip, title_case

# What keywords stand for: (name, interpretation), * the legend's name of SXT.
KEYWORDS = {
    "NR": [("Pansusceptible", "S")],
    "PANSUSCEPTIBLE": [("Pansusceptible", "S")],
    "SENSIBLE": [("Pansusceptible", "S")],
    "NRCIP": [("ciprofloxacin", "I")],
    "NALCIP": [("nalidixic acid", "R"), ("ciprofloxacin", "I")],
    "SXTCIP": [("*", "R"), ("ciprofloxacin", "I")],
}
# Words for interpretations, and words that point to another place.
WORDS = {"susceptible": "S", "sensible": "S", "resistant": "R", "intermediate": "I"}
ELSEWHERE = ("pls refer", "please refer", "the mlst", "refer to")
# The numbers of the notations.
JSON, KEYWORD, UNKNOWN = 100, 0, -1
CODE_DISC_MARK, CODE_MARK, NAME_COLON_MARK, NAME_MARK, LINES_WITH_CODE, NAME_AND_WORD, CODES, LAST_MARKED, CODES_HYPHENED, NAMES_HYPHENED = range(1, 11)

DRUGS = "array<struct<name:string,mic:string,interpretation:string>>"
#: What follows some words and says nothing.
_NOTE = r"\s+constant\s+\d+$"
_PARTS = r"^(?:([A-Z]{1,6}):\s+(?=.*\s-\s))?(.+?)(\s+-\s+|\s*:\s*|-)([A-Za-z]+)$"


def _pieces(c: Column, at: str) -> Column:
    return F.filter(F.transform(F.split(c, at), strip), lambda e: e != "")


def _read(entry: Column) -> Column:
    """The parts of an entry; those it hasn't are ''."""
    plain = F.regexp_replace(entry, _NOTE, "")
    lead, name, link, mark = (F.regexp_extract(plain, _PARTS, k) for k in (1, 2, 3, 4))
    amount = F.regexp_extract(name, r"-(\.?\d+\.?\d*)$", 1)
    code = F.when(amount != "", F.left(name, F.length(name) - F.length(amount) - 1)).otherwise(name)
    return F.struct(lead.alias("lead"), strip(name).alias("name"), code.alias("code"), amount.alias("amount"), F.trim(link).alias("link"), mark.alias("mark"))


def _reads(entries: Column) -> Column:
    return F.transform(entries, _read)


def _all(parts: Column, fits) -> Column:
    return (F.size(parts) > 0) & F.forall(parts, fits)


def _marked(e: Column, any_case: bool = False) -> Column:
    return (F.upper(e["mark"]) if any_case else e["mark"]).isin("S", "I", "R")


def _letters(c: Column, least: int, most: int) -> Column:
    return F.length(c).between(least, most) & c.rlike("^[A-Za-z]+$")


def _is_code(c: Column) -> Column:
    """Up to eight letters and a digit at most, or four letters and more."""
    return c.rlike(r"^[A-Za-z]{1,8}\d?$") | c.rlike(r"^[A-Za-z]{4,}$")


class _Value:
    """A value's views that the notations are told by."""

    def __init__(self, c: Column) -> None:
        self.text = t = strip(c)
        self.entries, self.lines = _pieces(t, ","), _pieces(t, r"\n")
        self.first_lines = F.slice(self.lines, 1, 3)
        self.several_lines = t.contains("\n")
        self.hyphened = t.contains("-") & ~t.contains(",")
        self.words = _pieces(t, r"\s+")
        # slashes at an end belong to the next part of a list
        self.parts = _pieces(F.regexp_replace(F.regexp_replace(t, _NOTE, ""), r"/\s*-\s*", "/"), "-")


# Each notation: its number and whether a value is written in it; the first that fits counts.
_NOTATIONS = [
    (JSON, lambda v: F.left(v.text, F.lit(1)).isin("{", "[")),
    (KEYWORD, lambda v: plain_superscript(v.text).isin(*KEYWORDS)),
    (UNKNOWN, lambda v: F.exists(F.array(*map(F.lit, ELSEWHERE)), lambda w: F.contains(F.lower(v.text), w))),
    (LINES_WITH_CODE, lambda v: v.several_lines & _all(_reads(v.first_lines), lambda e: (e["lead"] != "") & (e["link"] == "-"))),
    (NAME_AND_WORD, lambda v: v.several_lines & F.exists(v.first_lines, lambda e: F.exists(_titled(), lambda w: F.endswith(e, w)))),
    (NAME_COLON_MARK, lambda v: v.text.contains(": ") & (2 * F.size(F.filter(_reads(v.entries), lambda e: (e["link"] == ":") & _marked(e))) > F.size(v.entries))),
    (NAME_AND_WORD, lambda v: F.exists(_titled(), lambda w: F.contains(v.text, F.concat(F.lit(" - "), w)))),
    (CODE_DISC_MARK, lambda v: F.exists(_reads(v.entries), lambda e: (e["amount"] != "") & (e["link"] == "-") & _marked(e, True) & _letters(e["code"], 1, 6))),
    (CODE_MARK, lambda v: _all(_reads(v.entries), lambda e: (e["link"] == "-") & _marked(e, True) & _letters(e["name"], 1, 8))),
    (LAST_MARKED, lambda v: _all(_reads(F.transform(v.entries, lambda e: F.element_at(F.split(e, r"\s+"), -1))), lambda e: (e["link"] == "-") & (e["mark"] == "R") & _letters(e["name"], 2, 6))),
    (NAMES_HYPHENED, lambda v: v.hyphened & (F.contains(F.lower(v.text), F.lit("constant")) | F.contains(F.array_join(v.parts, "-"), F.lit("/")))),
    (CODES_HYPHENED, lambda v: v.hyphened & ~v.text.contains(" ") & _all(_pieces(v.text, "-"), lambda e: e.rlike(r"^[A-Za-z]{2,5}\d?$"))),
    (NAME_MARK, lambda v: _all(_reads(v.entries), lambda e: (e["link"] == "-") & _marked(e))),
    (CODES, lambda v: _all(F.when(v.text.contains(","), v.entries).otherwise(v.words), _is_code)),
]


def _titled() -> Column:
    """Interpretations as they are written out."""
    return F.array(*[F.lit(w.capitalize()) for w in WORDS if w != "sensible"])


def detected_format(c: Column) -> Column:
    """The number of the notation; null and blank give null."""
    v = _Value(c)
    form = F.lit(UNKNOWN)
    for number, fits in reversed(_NOTATIONS):
        form = F.when(fits(v), number).otherwise(form)
    return F.when(v.text != "", form)


def legend_name(code: Column, legend: Column) -> Column:
    """Full name of a code: as it is, without a disc amount, else the code."""
    up = F.upper(strip(code))
    return F.coalesce(F.try_element_at(legend, up), F.try_element_at(legend, F.regexp_replace(up, r"[\s-]?\.?\d+\.?\d*$", "")), code)


def _drug(name: Column, interpretation: Column, mic: Column | None = None) -> Column:
    return F.struct(name.alias("name"), (F.lit(None).cast("string") if mic is None else mic).alias("mic"), interpretation.alias("interpretation"))


def _result(mark: Column) -> Column:
    """The letter of a word; letters and other words in upper case."""
    words = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, F.lower(mark)), F.upper(mark))


def drugs(c: Column, legend: Column, form: Column | None = None) -> Column:
    """Drugs with interpretation, in the order written; [] where there are none or for JSON.

    legend: a map of upper-case codes to names (a fixed dimension).
    """
    v = _Value(c)
    form = detected_format(c) if form is None else form
    none = F.array().cast(DRUGS)

    def each(entries: Column, keep, name) -> Column:
        return F.transform(F.filter(_reads(entries), keep), lambda e: _drug(name(e), _result(e["mark"])))

    def resistant(names: Column) -> Column:
        return F.transform(names, lambda n: _drug(legend_name(n, legend), F.lit("R")))

    by_code = lambda e: legend_name(e["code"], legend)
    by_name = lambda e: title_case(e["name"])
    combined = F.coalesce(F.try_element_at(legend, F.lit("SXT")), F.lit("sulfamethoxazole/trimethoprim"))
    keyword = none
    for word, pairs in KEYWORDS.items():
        made = F.array(*[_drug(combined if n == "*" else F.lit(n), F.lit(i)) for n, i in pairs])
        keyword = F.when(plain_superscript(v.text) == word, made).otherwise(keyword)
    unmarked = F.transform(F.flatten(F.transform(v.entries, lambda e: _pieces(e, r"\s+"))), lambda x: F.regexp_replace(x, "-R$", ""))
    made = {
        KEYWORD: keyword,
        CODE_DISC_MARK: each(v.entries, lambda e: (e["link"] == "-") & _marked(e) & _letters(e["code"], 1, 6), by_code),
        CODE_MARK: each(v.entries, lambda e: (e["link"] == "-") & _marked(e, True) & _letters(e["name"], 1, 8), by_code),
        NAME_COLON_MARK: each(v.entries, lambda e: (e["link"] == ":") & _marked(e), by_name),
        NAME_MARK: each(v.entries, lambda e: (e["link"] == "-") & _marked(e), by_name),
        LINES_WITH_CODE: each(v.lines, lambda e: (e["lead"] != "") & (e["link"] == "-"), by_name),
        # outside of lines with codes a code counts as part of the name
        NAME_AND_WORD: each(_pieces(v.text, r"[\n,]"), lambda e: e["link"] == "-", lambda e: title_case(F.concat(F.when(e["lead"] != "", F.concat(e["lead"], F.lit(": "))).otherwise(""), e["name"]))),
        CODES: resistant(F.when(v.text.contains(","), v.entries).otherwise(v.words)),
        LAST_MARKED: resistant(unmarked),
        CODES_HYPHENED: resistant(_pieces(v.text, "-")),
        NAMES_HYPHENED: F.transform(v.parts, lambda n: _drug(title_case(n), F.lit("R"))),
    }
    out = none
    for number, drugs_of in made.items():
        out = F.when(form == number, drugs_of).otherwise(out)
    return F.coalesce(out, none).cast(DRUGS)


def legend_map(legend: DataFrame, most: int = 5000) -> Column:
    """The legend as a map literal; a fixed dimension whose size is checked."""
    rows = legend.where("abbrev is not null and full_name is not null").select(F.upper("abbrev").alias("a"), "full_name").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the legend holds more than {most} codes")
    pairs = {r["a"]: r["full_name"] for r in rows}
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]) if pairs else F.create_map().cast("map<string,string>")


def invalid_drugs(rows: DataFrame, id_col: str, drugs_col: str) -> DataFrame:
    """What is wrong with drugs: empty names, unknown interpretations, one named twice."""
    flat = rows.select(id_col, F.posexplode(drugs_col).alias("pos", "d")).select(id_col, (F.col("pos") + 1).alias("pos"), "d.*")
    blank = flat.where("name is null or trim(name) = ''").select(id_col, "pos", F.lit("empty name").alias("problem"))
    wrong = flat.where("interpretation is not null and interpretation not in ('S', 'I', 'R', 'null')").select(id_col, "pos", F.lit("invalid interpretation").alias("problem"))
    twice = flat.where("trim(name) <> ''").groupBy(id_col, F.lower("name").alias("n")).agg(F.max("pos").alias("pos"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return blank.unionByName(wrong).unionByName(twice.select(id_col, "pos", F.lit("named twice").alias("problem")))


def years(c: Column) -> Column:
    """All years of 19.. and 20.. in a text, as integers in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
