"""Runs from files to reports, sheets, packages and the small operators around them, on files written by hand."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from evalweave import run
from evalweave.functions import text
from evalweave.operators import ast_formats, budget, feedback, items, maintain, resolve, sheets, stats
from evalweave.sources import adapters, files, packages, sinks


def _write(folder, **named):
    folder.mkdir(exist_ok=True)
    for name, value in named.items():
        (folder / name.replace("__", ".")).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(folder)


GT = {"isolates_with_linking": {"a": {"mlst": "ST1", "amr": ["tetA"]}}, "isolate_without_linking": [], "no_isolates_only_assayinformation": {}}


def test_from_files_to_report(spark, tmp_path):
    gt = _write(tmp_path / "gt", PMC1__json=GT, PMC2__json=GT, PMC3__json="{")
    raw = _write(tmp_path / "stored", PMC1__json={"pmcid": "PMC1", "raw_output": json.dumps({"category": "IWL", **GT})}, PMC2__json={"pmcid": "pmc 2", "raw_output": "no JSON at all"})
    out = str(tmp_path / "out")
    rows = {r.pmcid: r for r in run.evaluate(spark, gt, raw, out, "first").collect()}
    assert set(rows) == {"PMC1", "PMC2"} and rows["PMC1"].primary_f1 == 1.0 and (rows["PMC2"].fn, rows["PMC2"].error_message) == (2, "the output can't be read")
    # a later run adds what is new and keeps what is done
    _write(tmp_path / "stored", PMC1__json={"pmcid": "PMC1", "raw_output": "changed"}, PMC3__json={"pmcid": "PMC3", "raw_output": json.dumps({"category": "IWL", **GT})})
    rows = {r.pmcid: r for r in run.evaluate(spark, gt, raw, out, "second").collect()}
    assert set(rows) == {"PMC1", "PMC2", "PMC3"} and rows["PMC1"].primary_f1 == 1.0 and rows["PMC3"].gt_category == "EMPTY"
    summary = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert summary["metadata"]["run_label"] == "second" and summary["overall"]["n"] == 3
    assert json.loads((tmp_path / "out" / "results_json.metadata.json").read_text())["total_records"] == 3
    assert files.results_csv(spark, f"{out}/results_csv").count() == 3 and json.loads((tmp_path / "out" / "run.json").read_text())["settings"]["gt"] == gt
    splits = _write(tmp_path / "splits", s__json={"holdout": ["PMC1", "PMC9"]}) + "/s.json"
    assert [r.pmcid for r in run.holdout(spark, out, splits, "holdout", str(tmp_path / "held"), "h").collect()] == ["PMC1"]
    assert run.clean(spark, gt, str(tmp_path / "clean")) >= 0 and not (tmp_path / "clean").exists()


def test_extraction_resumes(spark, tmp_path):
    xml = _write(tmp_path / "xml", PMC1__xml="<article>see AB123456</article>", PMC2__xml="<article>none</article>")

    def failing(texts):
        raise OSError("down")

    out = str(tmp_path / "out")
    assert {(r.doc_id, r.status, r.error) for r in run.extract(spark, xml, out, failing, attempts=1).collect()} == {("PMC1", "failed", "OSError: down"), ("PMC2", "failed", "OSError: down")}
    assert {r.doc_id: (r.status, r.raw_output) for r in run.extract(spark, xml, out, adapters.RuleExtractor(), attempts=1).collect()} == {"PMC1": ("completed", "Accessions\n- AB123456\nTotal: 1"), "PMC2": ("completed", "Accessions\nTotal: 0")}
    # what is completed isn't asked for again
    assert {r.raw_output for r in run.extract(spark, xml, out, failing, attempts=1).collect()} == {"Accessions\n- AB123456\nTotal: 1", "Accessions\nTotal: 0"}
    assert run.raw_outputs(spark, out).count() == 2 and spark.read.parquet(f"{out}/raw").count() == 4


SHEET = '''PMCID,category,isolate_id,isolate_source,isolate_date,isolate_country,Serotype, MLST ,AST_Data,AMR,Accession Numbers,Accession Numbers_merge,
PMC1,,i1,milk,May 2019,Chile,"Derby, Hadar",ST1,"AMP-R, SXT-S",tetA,"AB123456, AB123457",AB123456,x
,unlinked,i2,,,,,,,,,,
,assay_only,,,,,Derby,ST2,AMP: R,sul1,AB1,,
PMC2,odd,i3,"a ""b""",,,,,"{""Serotype"": ""X"", ""Antibiotics"": []}",,,,
'''


def test_sheet_conversion(spark, tmp_path):
    folder = _write(tmp_path / "s", sheet__csv=SHEET, legend__csv="Abbreviation,Full_Name\namp,Ampicillin\nSXT,Trimethoprim/Sulfamethoxazole\n,x\n")
    rows = {r.id: json.loads(r.gt_json) for r in run.convert(spark, f"{folder}/sheet.csv", f"{folder}/legend.csv", str(tmp_path / "docs"), apply=True).collect()}
    one = rows["PMC1"]
    assert [x["isolate_id"] for x in one["isolates_with_linking"]] == ["i1"] and [x["isolate_id"] for x in one["isolate_without_linking"]] == ["i2"]
    first = one["isolates_with_linking"][0]
    assert first["serotype"] == ["Derby", "Hadar"] and first["isolate_date"] == [2019] and first["mlst"] == ["ST1"]
    assert first["ast_data"] == [{"Serotype": "Derby", "Antibiotics": [{"Name": "ampicillin", "MIC": "null", "Interpretation": "R"}, {"Name": "trimethoprim/sulfamethoxazole", "MIC": "null", "Interpretation": "S"}]}]
    bare = one["no_isolates_only_assayinformation"]
    assert bare["amr"] == ["sul1"] and bare["ast_data"][0]["Antibiotics"][0]["Name"] == "Amp" and bare["mlst"] == ["ST2"]
    assert one["merge_accession_number"] == ["AB123456", "AB123457", "AB1"]
    assert rows["PMC2"]["isolates_with_linking"][0]["ast_data"] == [{"Serotype": "X", "Antibiotics": []}] and rows["PMC2"]["isolates_with_linking"][0]["isolate_source"] == 'a "b"'
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 2
    with pytest.raises(ValueError):
        sheets.sheet_documents(spark.createDataFrame([(1, "x")], "_row bigint, PMCID string"), F.create_map().cast("map<string,string>"))


def test_paired_sheets(spark):
    listing = spark.createDataFrame([("/x/PMC1Isolates_with_linking.csv",), ("/x/PMC1others.csv",), ("/x/PMC2Isolates_with_linking.csv",), ("/x/other.txt",)], "path string")
    assert [(r.id, r.others_path is None) for r in sheets.paired_files(listing).collect()] == [("PMC1", False), ("PMC2", True)]
    rows = spark.createDataFrame([("PMC1", 1, "e1", "O1:H1", '[{"Antibiotics": []}]'), ("PMC1", 0, "e0", None, None), ("PMC2", 0, "e2", "", "")], "id string, _row bigint, Isolate_ID string, Serotype string, AST_Data string")
    others = spark.createDataFrame([("PMC1", 0, "['a', 'b']", '{"amr": "x"}'), ("PMC1", 1, "ignored", None)], "id string, _row bigint, Isolate_without_linking string, No_isolates_only_assayinformation string")
    got = {r.id: json.loads(r.gt_json) for r in sheets.paired_documents(rows, others, F.create_map().cast("map<string,string>")).collect()}
    assert [x["isolate_id"] for x in got["PMC1"]["isolates_with_linking"]] == ["e0", "e1"] and got["PMC1"]["isolate_without_linking"] == ["a", "b"] and got["PMC1"]["no_isolates_only_assayinformation"] == {"amr": "x"}
    assert got["PMC2"]["isolate_without_linking"] == [] and got["PMC2"]["isolates_with_linking"][0]["ast_data"] == []
    assert sheets._literal("not a literal", "[]") == "[]"


def test_packages_and_attachments(spark, tmp_path):
    _write(tmp_path / "PMC1", a__csv="x,y", b__txt=" ", c__pdf="%PDF")
    got = {r.name: (r.id, r.text, r.error) for r in packages.attachments(spark, str(tmp_path / "PMC1")).collect()}
    assert got == {"a.csv": ("PMC1", "x,y", None), "b.txt": ("PMC1", " ", "empty"), "c.pdf": ("PMC1", None, "unsupported")}
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for name in ("p/a.nxml", "p/t.csv", "q/t.csv", "p/supp_1.bin", "p/x.bin"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    df = spark.createDataFrame([("k", bytearray(data.getvalue())), ("bad", bytearray(b"no tar")), ("none", None)], "id string, content binary")
    members = packages.package_members(df)
    assert {(r.id, r.name) for r in members.where("name is not null").collect()} == {("k", "t.csv"), ("k", "t_1.csv"), ("k", "supp_1.bin")}
    assert {r.id: (r.status, r.n_files, r.n_bytes) for r in packages.package_manifest(members).collect()} == {"k": ("success", 3, 9), "bad": ("failed", 0, 0), "none": ("failed", 0, 0)}


def test_selection(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "id string")
    texts, gt = spark.createDataFrame([("a", "t"), ("b", " ")], "id string, text string"), spark.createDataFrame([("a", "{}"), ("b", "{}")], "id string, gt string")
    good, rest = resolve.examples(ids, texts, gt, "id", "text", "gt")
    assert [r.id for r in good.collect()] == ["a"] and {(r.id, r.reason) for r in rest.where("id is not null").collect()} == {("b", "no text"), ("c", "no text")}
    linked, missing = resolve.mapped_ids(ids, spark.createDataFrame([("a", "PMC2"), ("a", "PMC1"), ("b", None)], "id string, pmcid string"), "id", "pmcid")
    assert [tuple(r) for r in linked.collect()] == [("a", "PMC1")] and {r.id for r in missing.collect()} == {"b", "c"}
    out, on = resolve.split_by_list(ids.distinct().where("id is not null"), texts, "id")
    assert {r.id for r in out.collect()} == {"c"} and {r.id for r in on.collect()} == {"a", "b"}
    assert resolve.with_supplements(ids, texts, "id").count() == 3
    assert {r.id: r.flags for r in resolve.flagged(texts, "id", {"late": ["a"], "odd": ["a", "b"], "none": []}).collect()} == {"a": ["late", "odd"], "b": ["odd"]} and resolve.flagged(texts, "id", {}).first()["flags"] == []
    assert [r.path for r in resolve.first_files(spark.createDataFrame([("/z/a",), ("/a/c",), ("/b/b",)], "path string"), 2).collect()] == ["/z/a", "/b/b"]
    fixes = spark.createDataFrame([("a", 1), ("zz", 2)], "id string, n int")
    assert [r.id for r in maintain.orphan_fixes(fixes, texts, "id").collect()] == ["zz"]
    days = spark.createDataFrame([("2024-05-01 10:00",), ("2024-05-02",), (None,)], "d string")
    assert maintain.of_day(days, "d", "2024-05-01").count() == 1


def test_text_checks(spark):
    rows = [(1, "so on ...\n", "<body>"), (2, "This will be extremely long", "<x/>"), (3, "done.", "<abstract>"), (4, None, None)]
    df = spark.createDataFrame(rows, "i int, o string, x string")
    assert [r[0] for r in df.orderBy("i").select(text.self_truncated(F.col("o"))).collect()] == [True, True, False, False]
    assert [r[0] for r in df.orderBy("i").select(text.metadata_only(F.col("x"))).collect()] == [False, True, False, True]
    assert df.orderBy("i").select(text.reasoning(F.col("o"))).collect()[3][0] == ""
    messages = spark.sql("select array(named_struct('role', 'user', 'text', 'hi'), named_struct('role', null, 'text', repeat('x', 3000))) as m")
    shown = messages.select(text.conversation(F.col("m"))).first()[0]
    assert shown.startswith("[USER]\nhi\n\n[UNKNOWN]\nx") and len(shown) < 1600
    with pytest.raises(TypeError):
        text.require_text(df, "o", "i")
    assert text.require_text(df, "o") is df
    with pytest.raises(Exception, match="MALFORMED"):
        spark.createDataFrame([("{",)], "j string").select(files.strict_json(F.col("j"))).collect()


def test_counts(spark):
    gt = spark.createDataFrame([(1, json.dumps({"isolates_with_linking": [{"isolate_id": "a", "amr": ["x", "y"], "mlst": "1", "spi": ""}], "no_isolates_only_assayinformation": {"amr": ["z"]}})), (2, "{"), (3, None)], "i int, j string")
    assert {r.doc_id: r.points for r in items.assay_points(gt, "i", "j").collect()} == {1: 4, 2: 0, 3: 0}
    rows = spark.createDataFrame([(1, "iwl", 1, "a", "mlst"), (1, "iwol", 2, "u", ""), (1, "iwol", 3, "v", ""), (1, "nioai", 4, None, "amr")], "doc_id int, section string, pos int, iso_id string, field string")
    assert [r.iso_id for r in items.pilot_items(rows).orderBy("pos").collect()] == ["a", "UNLINKED_0", "UNLINKED_1", "NO_ISOLATE_ID"]
    texts = spark.createDataFrame([(1, "a and u and v")], "doc_id int, text string")
    assert [tuple(r) for r in stats.eligible(rows, texts).collect()] == [(1, 3, 2)] and stats.eligible(rows, texts, 3).count() == 0
    sizes = budget.size_summary(spark.createDataFrame([(5,), (7,), (None,)], "n int"), "n").first()
    assert (sizes.n_documents, sizes.n_tokens, sizes.mean_tokens) == (2, 12, 6.0)
    scores = spark.createDataFrame([("p", 1, 0.5), ("q", 1, 0.9), ("p", 2, 0.4), ("q", 2, 0.4), ("r", 2, 0.1), ("r", 3, None)], "c string, e int, s double")
    assert {r.c: r.n_best for r in stats.pareto_candidates(scores, "c", "e", "s").collect()} == {"p": 1, "q": 2}
    results = spark.createDataFrame([("g", "R"), ("g", "s"), ("g", None), ("h", None)], "g string, r string")
    assert {r.g: (r.total, r.present, r.r_percent, r.s_percent) for r in stats.population(results, ["g"], "r").collect()} == {"g": (3, 2, 50.0, 50.0), "h": (1, 0, 0.0, 0.0)}


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01", "a", "ok", "x\ny"), ("2024-01-02", None, "failed", "z" * 3000)], "at string, id string, status string, message string")
    lines = [r.line for r in sinks.log_entries(events).orderBy("at").collect()]
    assert lines[0] == "2024-01-01 OK a x y" and lines[1].startswith("2024-01-02 FAILED - zzz") and len(lines[1]) < 1600 and sinks.log_footer(events) == "2 entries, 1 failed"
    sinks.write_predictions(spark.createDataFrame([("a", "COMPLETED"), ("b", None)], "id string, status string"), str(tmp_path / "p"))
    assert {r.id: r.status for r in spark.read.json(str(tmp_path / "p")).collect()} == {"a": "completed", "b": "pending"}
    rows = spark.createDataFrame([("PMC1", True, False)], "pmcid string, gt_found boolean, xml_found boolean")
    assert sinks.write_manifest(rows, str(tmp_path / "m"), short=True) == 1 and not (tmp_path / "m").exists()
    sinks.write_manifest(rows, str(tmp_path / "m"), short=True, apply=True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "m")).columns == sinks.SHORT_MANIFEST
    for day in ("2024-01-01", "2024-01-02"):
        sinks.append_missing(rows.select("pmcid"), str(tmp_path / "missing"), day, "no link")
    assert spark.read.parquet(str(tmp_path / "missing")).where("day = '2024-01-02'").count() == 1
    assert sinks.status_text({"found": 3, "rate": 50.0}, "Downloads") == "Downloads\n=========\nfound  3\nrate   50.0\n"
    path = str(tmp_path / "programs.json")
    assert sinks.load_program(path, "p") is None
    for k in (1, 2):
        sinks.save_program(path, "p", {"k": k}, {"f1": 0.5})
    assert sinks.load_program(path, "p") == {"k": 2} and sinks.load_program(path, "q") is None


def test_services(spark):
    chat = adapters.Chat(lambda m: [m[-1]["content"], None, "!"])
    assert chat(["hi", [{"role": "user", "content": "yo"}]]) == ["hi!", "yo!"]
    with pytest.raises(ConnectionError):
        adapters.Http(lambda u: (429, ""), 0)(["u"])
    answers = {"1": '{"linksets": [{"linksetdbs": [{"links": ["77"]}]}]}'}
    http = adapters.Http(lambda u: (200, answers.get(u.rsplit("=", 1)[1], "{}")), 0)
    got = {r.id: r.linked for r in adapters.links(spark.createDataFrame([(1,), (2,)], "pmid int"), "pmid", http, 1).collect()}
    assert got == {"1": "PMC77", "2": None}
    legend = ast_formats.legend_map(spark.createDataFrame([], "abbrev string, full_name string"))
    assert spark.range(1).select(F.size(legend)).first()[0] == 0


def test_the_metric_of_a_prompt_search(spark):
    good, loose = json.dumps({"category": "IWL", **GT}), json.dumps({"category": "IWOL", "isolate_without_linking": ["a"], "no_isolates_only_assayinformation": {"odd": "x"}})
    df = spark.createDataFrame([("x", json.dumps(GT), good), ("y", json.dumps(GT), loose), ("z", json.dumps(GT), None), ("n", None, None)], "id string, g string, r string")
    got = {r.id: r for r in feedback.assay_metric(df, "id", "g", "r", with_feedback=True).collect()}
    assert {k: r.score for k, r in got.items()} == {"x": 1.0, "y": 0.0, "z": 0.0, "n": 0.0} and got["x"].feedback == "Extraction correct."
    assert "not linked" in got["y"].feedback and "Unknown fields: odd" in got["y"].feedback
    assert {r.id: r.score for r in feedback.assay_metric(df, "id", "g", "r").collect()} == {k: r.score for k, r in got.items()}
