"""Sections, tables and plain text of article XML.

Mixed content (text around nested tags) is beyond the built-in XML functions,
so documents are read by the C parser of Python in Arrow batches.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = pa.struct([("name", pa.string()), ("text", pa.string())])
_SCHEMA = pa.struct([("title", pa.string()), ("sections", pa.list_(_PAIR)), ("tables", pa.list_(pa.string())), ("text", pa.string())])
_DDL = "struct<title:string,sections:array<struct<name:string,text:string>>,tables:array<string>,text:string>"


def _plain(el: ET.Element | None) -> str:
    return " ".join(" ".join(t.strip() for t in el.itertext() if t.strip()).split()) if el is not None else ""


def _table(wrap: ET.Element, rule: int = 40) -> str:
    label, caption = _plain(wrap.find("label")), _plain(wrap.find("caption"))
    lines = [f"{label}: {caption}" if label and caption else label or caption]
    for tr in wrap.iterfind(".//thead/tr"):
        lines += [" | ".join(_plain(c) for c in tr if c.tag == "th"), "-" * rule]
    lines += [" | ".join(_plain(c) for c in tr if c.tag == "td") for tr in wrap.iterfind(".//tbody/tr")]
    return "\n".join(x for x in lines if x)


def read_article(text: str | None) -> dict:
    """Title, sections in order (a nested one also stands by itself), tables as text, whole text."""
    empty = {"title": None, "sections": [], "tables": [], "text": None}
    if not text or not text.strip():
        return empty
    try:
        root = ET.fromstring(text.lstrip())
    except (ET.ParseError, ValueError):
        return empty
    sections = [{"name": "abstract", "text": t} for a in root.iterfind(".//abstract") if (t := _plain(a))]
    for part in ("body", "back"):
        for sec in root.iterfind(f"./{part}//sec"):
            sections.append({"name": _plain(sec.find("title")).lower() or part, "text": _plain(sec)})
    return {"title": _plain(root.find(".//article-title")) or None, "sections": sections, "tables": [_table(w) for w in root.iter("table-wrap")], "text": _plain(root)}


def article(xml: Column) -> Column:
    """A struct of title, sections, tables and text; empty where XML can't be parsed."""

    @F.arrow_udf(_DDL)
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([read_article(t.as_py()) for t in texts], type=_SCHEMA)

    return read(xml)


def id_list(xml: Column) -> Column:
    """Ids of a search answer."""
    return F.xpath(xml, F.lit("//IdList/Id/text()"))


def total_count(xml: Column) -> Column:
    return F.xpath_int(xml, F.lit("/eSearchResult/Count"))


def publication_date(xml: Column) -> Column:
    """Year, then month and day as far as they are given, with hyphens."""
    part = lambda p: F.nullif(F.xpath_string(xml, F.lit(f"(//PubDate/{p})[1]")), F.lit(""))
    y, m, d = part("Year"), part("Month"), part("Day")
    return F.when(y.isNotNull(), F.concat_ws("-", y, m, F.when(m.isNotNull(), d)))


def labelled_abstract(xml: Column) -> Column:
    return F.array_join(F.xpath(xml, F.lit("//Abstract/AbstractText/text()")), " ")
