"""Small operators without a query of their own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from evalweave.functions import dates, normalise, text
from evalweave.operators import accession, budget, feedback, items, resolve, xmltext
from evalweave.sources import adapters, files, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_id_sources(spark, tmp_path):
    listing = spark.createDataFrame([("/a/pmc12_x.json",), ("/b/PMC12.xml",), ("/c/none.txt",)], "path string")
    assert [r.id for r in files.ids_of_names(listing).collect()] == ["PMC12"]
    (tmp_path / "oa.csv").write_text("2024-01-01\noa_package/1.tar.gz,c,PMC1,t,1,CC\noa_package/2.tar.gz,c,pmc1 ,t,1,CC\noa_x,c,nan,t,1,CC\nother,c,PMC3,t,1,CC\n")
    assert [tuple(r) for r in files.oa_index(spark, str(tmp_path / "oa.csv")).collect()] == [("PMC1", "oa_package/2.tar.gz")]
    assert files.rules_text(spark, str(tmp_path / "none.md")) is None
    (tmp_path / "r.md").write_text("| a |\nb")
    assert files.rules_text(spark, str(tmp_path / "r.md")) == "| a |\nb"
    names = spark.createDataFrame([(["x/a.CSV", "supp.xml", "Supp_note", "b.bin"],)], "n array<string>")
    assert names.select(files.from_package(F.col("n"))).first()[0] == ["x/a.CSV", "Supp_note"]


def test_results_files(spark, tmp_path):
    rec = {"pmcid": "PMC1", "gt_category": "IWL", "ext_category": "IWL", "category_correct": True, "tp": 2, "fp": 1, "fn": 0, "precision": 0.67, "recall": 1.0, "primary_f1": 0.8}
    (tmp_path / "r.json").write_text(json.dumps({"metadata": {"run_label": "x"}, "records": [rec, {**rec, "pmcid": "PMC2", "loose_tp": 3, "loose_f1": 1.0}]}))
    rows = {r.pmcid: r for r in files.results_json(spark, str(tmp_path / "r.json")).collect()}
    assert (rows["PMC1"].loose_tp, rows["PMC1"].loose_f1) == (2, 0.8) and (rows["PMC2"].loose_tp, rows["PMC2"].loose_fp, rows["PMC2"].loose_f1) == (3, 1, 1.0)
    results = files.results_json(spark, str(tmp_path / "r.json"))
    sinks.print_summary(results)
    sinks.write_pipe_csv(spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "id string, l array<string>"), "l", str(tmp_path / "pipe"))
    back = spark.read.option("header", "true").option("sep", "|").csv(str(tmp_path / "pipe"))
    assert {(r.id, r.l or "") for r in back.collect()} == {("a", "x,y"), ("b", "")}


def test_runs_over_a_list(spark):
    resolved = spark.createDataFrame([("PMC1", "x", "g"), ("PMC2", None, "g"), ("PMC3", "y", "g")], "pmcid string, xml string, gt string")
    assert {r.pmcid for r in resolve.runnable(resolved, "xml", "gt").collect()} == {"PMC1", "PMC3"}
    assert resolve.run_list(resolved, ["ALL"], "pmcid").count() == 3 and [r.pmcid for r in resolve.run_list(resolved, ["pmc3", "PMC9"], "pmcid").collect()] == ["PMC3"] and resolve.run_list(resolved, None, "pmcid") is resolved
    old = spark.createDataFrame([("a", 1), ("b", 1), ("x", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    order = spark.createDataFrame([(1, "c"), (2, "b"), (3, "a")], "pos int, id string")
    assert [(r.id, r.v) for r in resolve.merge_rerun(old, new, order, "id", "pos").orderBy("pos").collect()] == [("c", 2), ("b", 2), ("a", 1)]


def test_text_functions(spark):
    pairs = spark.createDataFrame([("Strain-pK1", "k1"), ("x", "y"), (None, "y")], "a string, b string")
    assert [r[0] for r in pairs.select(text.same_isolate(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert one(spark, "v" * 60, lambda c: text.sample_label(F.lit("amr"), c)) == "amr=" + "v" * 50
    messages = spark.sql("select array(named_struct('role', 'system', 'text', 'a'), named_struct('role', 'tool', 'text', 'b'), named_struct('role', 'user', 'text', null)) m")
    assert messages.select(text.labelled_messages(F.col("m"))).first()[0] == "System: a\n\nUser: "
    assert text.search_query("Shigella", ["AMR", "MLST"]) == '("Shigella"[Title/Abstract]) AND ("AMR"[Title/Abstract] OR "MLST"[Title/Abstract]) AND open access[filter]'
    assert one(spark, " ST-1  x ", normalise.loose_number) == "st1 x"
    values = spark.createDataFrame([(1, "MIC 8"), (1, "zz"), (2, "a")], "doc_id int, value string")
    texts = spark.createDataFrame([(1, "the mic 8 was")], "doc_id int, text string")
    assert {(r.value, r.in_text) for r in feedback.values_in_text(values, texts).collect()} == {("MIC 8", True), ("zz", False), ("a", False)}


def test_answers_of_services(spark):
    search = "<eSearchResult><Count>2</Count><IdList><Id>1</Id><Id>2</Id></IdList></eSearchResult>"
    assert one(spark, search, xmltext.id_list) == ["1", "2"] and one(spark, search, xmltext.total_count) == 2
    paper = "<A><PubDate><Year>2024</Year><Month>05</Month><Day>7</Day></PubDate><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract></A>"
    assert one(spark, paper, xmltext.publication_date) == "2024-05-7" and one(spark, paper, xmltext.labelled_abstract) == "One. Two."
    assert one(spark, "<A/>", xmltext.publication_date) is None
    assert adapters.provider("openai/x") == "openai" and adapters.provider("x") == "local"
    assert adapters.endpoint("esearch", term="a b", db="pmc").endswith("esearch.fcgi?db=pmc&term=a+b")


def test_dates_and_costs(spark):
    now = F.lit(dt.datetime(2024, 5, 10)).cast("timestamp")
    rows = spark.createDataFrame([(dt.datetime(2024, 5, 3),), (dt.datetime(2024, 5, 4),), (None,)], "t timestamp")
    assert [r[0] for r in rows.select(dates.is_stale(F.col("t"), now)).collect()] == [True, False, True]
    assert budget.pilot_cost("medium", 10, 0.1) == pytest.approx(25.0)
    with pytest.raises(KeyError):
        budget.pilot_cost("none", 1, 1.0)
    assert one(spark, None, accession.listed) == []


def test_files_of_an_id(spark, tmp_path):
    listing = spark.createDataFrame([("/m/PMC1.json",), ("/m/PMC1.backup.json",), ("/s/PMC2/a.csv",), ("/s/PMC2/sub/b.csv",), ("/s/PMC2/x/y/c.csv",), ("/s/pmc3_t.csv",), ("/s/pmc3_t.csv",), ("/s/.hidden",)], "path string")
    assert {r.id: r.paths for r in files.grouped_by_name(listing).where("id like 'PMC1'").collect()} == {"PMC1": ["/m/PMC1.backup.json", "/m/PMC1.json"]}
    ids = spark.createDataFrame([("PMC2",), ("PMC3",), ("PMC3",), (None,)], "id string")
    assert sorted(tuple(r) for r in files.supplement_sources(listing, ids).collect()) == [("PMC2", "/s/PMC2/a.csv"), ("PMC2", "/s/PMC2/sub/b.csv"), ("PMC3", "/s/pmc3_t.csv")]
    for k in (2, 1, 3):
        (tmp_path / f"PMC{k}.xml").write_text(f"<a>{k}</a>")
    assert [r.text for r in files.xml_texts(spark, str(tmp_path), 2).collect()] == ["<a>1</a>", "<a>2</a>"] and files.xml_texts(spark, str(tmp_path)).count() == 3


def test_models_over_articles(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, t string")
    answers = adapters.Replay({"a": "Class: 2 (of 3)", "b": "unclear"})
    assert {r.id: r.label for r in adapters.labels(df, "id", "t", answers).collect()} == {1: 2, 2: None, 3: None}
    texts = spark.createDataFrame([("x", "body"), ("y", "alone")], "id string, text string")
    attached = spark.createDataFrame([("x", "b.csv", "2", None), ("x", "a.csv", "1", None), ("x", "c.pdf", None, "unsupported")], "id string, name string, text string, error string")
    assert {r.id: r.text for r in adapters.with_attachments(texts, attached).collect()} == {"x": "body\n\nA.CSV\n1\n\nB.CSV\n2", "y": "alone"}
    rows = spark.createDataFrame([(1, "amr", "x"), (1, "amr", "x"), (1, "", "u")], "doc_id int, field string, orig string")
    assert [tuple(r) for r in items.field_values(rows).collect()] == [(1, "amr", "x")]
