"""Evaluation operators: tables of cases, small models of the rules, and invariants."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from evalweave.functions import dates, text
from evalweave.functions import normalise as N
from evalweave.operators import accession, ast_formats, budget, feedback, items, maintain, matching, resolve, scoring, stats
from evalweave.operators.xmltext import read_article
from evalweave.plans import evaluation
from evalweave.sources import adapters, files, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "f, raw, want",
    [
        (N.serotype, "Salmonella Typhimurium", "typhimurium"),
        (N.serotype, "S. Enteritidis", "enteritidis"),
        (N.serotype, "ser. Kentucky", "ser. kentucky"),
        (N.serotype, "Salmonella enterica subsp. enterica serovar Hadar ", "hadar"),
        (N.mlst, "ST34", "st34"),
        (N.mlst, "ST-34", "st34"),
        (N.mlst, "34", "st34"),
        (N.mlst, "new-1 a", "new1a"),
        (N.amr, "blaTEM-1B", "blatem1b"),
        (N.amr, "aac(6')-Ib", "aac(6')ib"),
        (N.generic, "IncFII (predicted)_x", "incfiix"),
        (N.field_name, " Serovar ", "serotype"),
        (N.interpretation, "Susceptible", "s"),
        (N.antibiotic, "SXT", "trimethoprim/sulfamethoxazole"),
        (N.ast_entry, "AMP-x-R", "amp-x:r"),
        (text.strip_tags, "<p>a <b>b</b>\u00a0</p>", "a b"),
        (text.title_case, "a/b o'neil 3rd", "A/B O'Neil 3Rd"),
        (text.safe_file_name, "../CON.txt", "_CON.txt"),
        (text.safe_file_name, "", "unnamed"),
        (text.isolate_key, "Strain-pX1", "x1"),
        (text.plain_characters, "a\u200bb\u2013c", "ab-c"),
        (text.plain_superscript, "NR^{CIP}", "NRCIP"),
    ],
)
def test_scalars(spark, f, raw, want):
    assert one(spark, raw, f) == want
    assert one(spark, None, f) in (None, "unnamed")


def test_phrases_and_lists(spark):
    assert one(spark, "Resistant to ampicillin, SXT and azm. Colistin: S", N.pilot_phrases) == ["ampicillin:r", "azithromycin:r", "colistin:s", "trimethoprim/sulfamethoxazole:r"]
    assert one(spark, " a, ,b ", text.split_list) == ["a", "b"]


def test_contained_tokens(spark):
    rows = [("dysenteriae 1", "dysenteriae serotype 1", True), ("st1", "st10", False), ("", "a", False), ("a b", "b", True)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert df.where(text.tokens_contained(F.col("a"), F.col("b")) != F.col("w")).count() == 0


def _sequential(gt, ext):
    """The rule, one item after another."""
    keys = {(i, f): n for i, f, n, _ in gt}
    first = {}
    for i, f, n, _ in gt:
        first.setdefault((f, n), (i, f))
    used, tp, fp = set(), 0, 0
    for i, f, n, _ in ext:
        if keys.get((i, f)) == n:
            tp += 1
            used.add((i, f))
        elif (f, n) in first and first[f, n] not in used:
            tp += 1
            used.add(first[f, n])
        else:
            fp += 1
    return tp, fp, len(set(keys) - used)


def test_linked_matches_follow_the_sequential_rule(spark):
    rng = random.Random(5)
    g, e, want = [], [], {}
    for d in range(300):
        side = lambda n: [(i, f, rng.choice("uvw"), p) for p, (i, f) in enumerate(rng.sample([(i, f) for i in "abcd" for f in "xy"], n))]
        gt, ext = side(rng.randrange(7)), side(rng.randrange(7))
        want[d] = _sequential(gt, ext)
        g += [(d, *r) for r in gt]
        e += [(d, *r) for r in ext]
    ddl = "doc_id int, iso_id string, field string, norm string, pos int"
    found, truth = matching.linked_matches(spark.createDataFrame(g, ddl), spark.createDataFrame(e, ddl))
    hits = {r.doc_id: (r.tp, r.fp) for r in found.groupBy("doc_id").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp")).collect()}
    miss = {r.doc_id: r.n for r in truth.where("not hit").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all((*hits.get(d, (0, 0)), miss.get(d, 0)) == w for d, w in want.items())


def test_recovered_is_greedy(spark):
    ddl = "doc_id int, field string, norm string, pos int"
    missed = spark.createDataFrame([(1, "s", "a b", 1), (1, "s", "a", 2), (1, "t", "q", 3)], ddl)
    wrong = spark.createDataFrame([(1, "s", "a x", 1), (1, "s", "b a c", 2), (1, "s", "a", 3), (1, "t", "z", 4)], ddl)
    assert {(r.field, r.recovered) for r in matching.recovered(missed, wrong).collect()} == {("s", 2), ("t", 0)}


def test_outputs_are_read():
    good = {"category": "IWL", "isolates_with_linking": {"a": {"mlst": "ST1"}}}
    for raw in (json.dumps(good), "```json\n" + json.dumps(good) + "\n```", "Here: " + json.dumps(good) + " end", json.dumps(good)[:-1] + ",}"):
        assert items.read_output(raw) == good
    assert items.read_output('say\n```json {"a": 1}```') == {"a": 1} and items.without_stray_commas('{"a": "x, ]", "b": [1 , ],}', strings=True) == '{"a": "x, ]", "b": [1 ]}'
    assert items.balanced('x {"a": "}"} y') == '{"a": "}"}' and items.balanced('x {"a": "}"} y', strings=False) == '{"a": "}' and items.balanced('{"a": "open } ') is None
    assert items.read_output('{"a": 1') == {} and items.read_output(None) == {} and items.read_output(" ") == {}
    assert items.read_output('{"a": {"b": 1}, "c": {"d": 2', pilot=True) == {"a": {"b": 1}}
    assert items.standard_sections({"i1": {"mlst": "1"}})["category"] == "IWL"
    assert items.standard_sections({"NO_ISOLATE_ID": {"mlst": "1"}})["category"] == "NIOAI"
    assert items.standard_sections({"isolates_with_linking": [1], "isolate_without_linking": ["x"]})["category"] == "IWOL"


def test_ground_truth_is_repaired_outside_strings_only(spark):
    df = spark.createDataFrame([(1, '{"no_isolates_only_assayinformation": {"odd": "x, ]", "mlst": "1",},}')], "id int, j string")
    assert {(r.field, r.orig) for r in items.ground_truth_items(df, "id", "j").collect()} == {("odd", "x, ]"), ("mlst", "1")}


def test_serotypes(spark):
    cases = {
        "Salmonella Typhimurium": "typhimurium", "S. Enteritidis": "enteritidis", "ser. Kentucky": "ser. kentucky", "Salmonella enterica subsp. enterica serovar Hadar": "hadar", "salmonella  enterica Ser Derby x": "derby x",
        "Salmonella serovar 4,[5],12:i:-": "4,[5],12:i:-", "Salmonella enterica": "enterica", "Salmonella": "salmonella", "Salmonella enterica subsp. enterica Derby": "subsp. enterica derby", "Salmonella serovar": "serovar", " S.  x ": "x", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.s for r in df.select("v", N.serotype(F.col("v")).alias("s")).collect()} == cases


def test_ground_truth_items(spark):
    listed = {"isolates_with_linking": [{"isolate_id": "a", "Serovar": ["S. Hadar", "Derby"], "st": "ST-7", "ast_data": [{"Antibiotics": [{"name": "AMP", "Interpretation": "Resistant"}]}], "title": "x", "odd": "y"}, {"mlst": "1"}], "isolate_without_linking": ["Z ", {"isolate_id": "q"}]}
    mapped = {"isolates_with_linking": {"a": {"ast_data": {"AMP": {"interpretation": "S"}}, "amr": ["bla-1", ""]}}, "no_isolates_only_assayinformation": {"odd": "y-1", "mlst": []}}
    df = spark.createDataFrame([(1, json.dumps(listed)), (2, json.dumps(mapped)), (3, None), (4, "{")], "id int, j string")
    got = {(r.doc_id, r.section, r.iso_id, r.field, r.norm) for r in items.ground_truth_items(df, "id", "j").collect()}
    assert got == {
        (1, "iwl", "a", "serotype", "derby|hadar"), (1, "iwl", "a", "mlst", "st7"), (1, "iwl", "a", "ast_data", "amp:r"), (1, "iwol", "Z", "", "z"), (1, "iwol", "q", "", "q"),
        (2, "iwl", "a", "ast_data", "amp:s"), (2, "iwl", "a", "amr", "bla1"), (2, "nioai", None, "odd", "y1"),
    }


def test_scores_and_invariants(spark):
    g = {"isolates_with_linking": {"a": {"mlst": "ST1", "serotype": "dysenteriae 1"}, "b": {"mlst": "ST2"}}}
    e = {"isolates_with_linking": {"x": {"mlst": "1"}, "a": {"serotype": "dysenteriae serotype 1"}, "c": {"amr": "q"}}}
    df = spark.createDataFrame([(1, json.dumps(g), json.dumps(e)), (2, "{}", json.dumps(e)), (3, json.dumps({"isolate_without_linking": ["A", "b"]}), json.dumps({"isolate_without_linking": ["a", "c"]}))], "id int, g string, e string")
    rows = {r.doc_id: r for r in scoring.score_documents(df.select(F.col("id").alias("doc_id")), items.ground_truth_items(df, "id", "g"), items.output_items(df, "id", "e")).collect()}
    assert (rows[1].tp, rows[1].fp, rows[1].fn, rows[1].loose_tp) == (1, 2, 2, 2)
    assert (rows[2].gt_category, rows[2].fp) == ("EMPTY", 3) and (rows[3].tp, rows[3].fp, rows[3].fn) == (1, 1, 1)
    assert all(r.loose_tp >= r.tp and r.loose_tp + r.loose_fp == r.tp + r.fp for r in rows.values())
    total = [r for r in scoring.aggregate(spark.createDataFrame(list(rows.values())), "gt_category").collect() if r.level == 1]
    assert total[0].n == 3 and total[0].total_tp == 2


def test_ast_formats(spark):
    cases = [
        ("AMP-10-R,SXT-5-S", 1, [("ampicillin", "R"), ("trimethoprim/sulfamethoxazole", "S")]), ("AMP-R, SXT-S", 2, [("ampicillin", "R"), ("trimethoprim/sulfamethoxazole", "S")]),
        ("Ampicillin: R, colistin: S", 3, [("Ampicillin", "R"), ("Colistin", "S")]), ("nalidixic acid-R, amoxicillin/x-S", 4, [("Nalidixic Acid", "R"), ("Amoxicillin/X", "S")]),
        ("AMP: ampicillin - Resistant\nSXT: cotrim x - Susceptible", 5, [("Ampicillin", "R"), ("Cotrim X", "S")]), ("ampicillin - Susceptible\ncolistin - Resistant", 6, [("Ampicillin", "S"), ("Colistin", "R")]),
        ("AMP, SXT", 7, [("ampicillin", "R"), ("trimethoprim/sulfamethoxazole", "R")]), ("AMP-SXT", 9, [("ampicillin", "R"), ("trimethoprim/sulfamethoxazole", "R")]), ("ampicillin-ticarcillin/ - clavulanic acid constant 2", 10, [("Ampicillin", "R"), ("Ticarcillin/Clavulanic Acid", "R")]),
        ("NALCIP", 0, [("nalidixic acid", "R"), ("ciprofloxacin", "I")]), ("[1]", 100, []), ("please refer to table 2", -1, []), (None, None, []), (" ", None, []),
    ]
    legend = spark.createDataFrame([("AMP", "ampicillin"), ("SXT", "trimethoprim/sulfamethoxazole")], "abbrev string, full_name string")
    m = ast_formats.legend_map(legend)
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    rows = df.select("i", ast_formats.detected_format(F.col("v")).alias("f"), ast_formats.drugs(F.col("v"), m).alias("d")).orderBy("i").collect()
    for r, (raw, form, drugs) in zip(rows, cases):
        assert r.f == form, raw
        assert [(d["name"], d["interpretation"]) for d in r.d] == drugs, raw
    bad = spark.createDataFrame([(1, [("", None, "R"), ("a", None, "X"), ("A", None, "S")])], f"id int, d {ast_formats.DRUGS}")
    assert {(r.pos, r.problem) for r in ast_formats.invalid_drugs(bad, "id", "d").collect()} == {(1, "empty name"), (2, "invalid interpretation"), (3, "named twice")}
    assert one(spark, "1999, in 2020 and 18000", ast_formats.years) == [1999, 2020]


def test_accessions(spark):
    df = spark.createDataFrame([(1, "MH548440.2, SRR123456, SAMN01234567, PRJNA12345678, TP53, NM_001234567.3, DO123456, AAAA02012345, AB123456, GJ123456, ZQ123456, SAMEA1234567")], "id int, t string")
    got = {r.code: (r.partner, r.seq_type) for r in accession.classified(accession.candidates(df, "id", "t"), spark).collect()}
    assert got == {
        "MH548440.2": ("NCBI", "Direct submissions"), "SRR123456": ("NCBI", "SRA runs"), "SAMN01234567": ("NCBI", "BioSample"), "PRJNA12345678": ("NCBI", "BioProject"), "NM_001234567.3": ("NCBI", "mRNA"),
        "AAAA02012345": ("NCBI", "WGS"), "AB123456": ("DDBJ", "Direct submissions"), "GJ123456": ("NCBI", "TPA CON"), "SAMEA1234567": ("EBI", "BioSample"),
    }
    table = "| Prefix | Partner | Type | Format |\n| ZAAA-ZZZZ | DDBJ | TLS | 4+8 or more |\n\n| Prefix | Partner | Notes |\n| MH, MK | XX | Direct |"
    given = {(r.prefix_lo, r.n_letters): r for r in accession.rules(spark, table).collect()}
    assert given["MH", 2].partner == "XX" and given["MH", 2].min_digits == 6 and given["ZAAA", 4].max_digits is None and given["AB", 2].partner == "DDBJ"
    assert len({(r[0], r[2], r[3]) for r in accession.rule_rows()}) == len(accession.rule_rows()) > 400
    ranges = spark.createDataFrame([("MH548440–MH548519", 1), ("AB1-AC3", 2), ("X9", 3), ("Q000001-200000", 4), (None, 5)], "r string, _n int")
    got = accession.expanded(ranges, "r")
    assert {r["_n"]: r["count"] for r in got.groupBy("_n").count().collect()} == {1: 80, 2: 1, 3: 1, 4: 200_000, 5: 1} and got.columns == ["r", "_n", "accession"]
    assert got.where("_n = 4").agg(F.min("accession"), F.max("accession")).first()[:] == ("Q000001", "Q200000") and got.where("_n = 2").first()["accession"] == "AB1-AC3"
    listed = "```\r\n accessions:\r\n1. zq1234567\r\n- ZQ1234568.1, 'AB123456'\r\nWe found ZQ7654321 in a table.\r\nTotal: 3\r\n```"
    assert one(spark, listed, accession.listed_in_output) == ["ZQ1234567", "ZQ1234568.1", "AB123456"] and one(spark, None, accession.listed_in_output) == []
    assert one(spark, "11AB1, b2,,\n0c0", accession.parsed_list) == ["11AB1", "b2", "0c0"]
    assert one(spark, "- ab123456 note|x\nnone found\nAB123456, q", accession.listed) == ["AB123456"]


def test_budget(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 59, 30) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("k", at(0), 10), ("k", at(59), 20), ("k", at(60), 30), ("k", at(200), 5)], "k string, ts timestamp_ntz, n bigint")
    assert [r.used for r in budget.used_in_window(df, "k", "ts", "n").orderBy("ts").collect()] == [10, 30, 50, 5]
    assert [r.wait_s for r in budget.waits(df, "k", "ts", "n", 60, 40).orderBy("ts").collect()] == [0, 2, 61, 0]
    far = [(k, dt.datetime(2024, 3, 31) + dt.timedelta(hours=h), h + 1) for k in ("x", None) for h in (0, 2.5, 2.5, 5.5, 100)]
    hours = spark.createDataFrame([(k, t, int(n), "q") for k, t, n in far], "k string, ts timestamp_ntz, n int, _k string")
    got = budget.used_in_window(hours, "k", "ts", "n", 3 * 3600).orderBy("k", "ts").collect()
    assert [r.used for r in got] == [1, 7, 7, 6, 101] * 2
    assert [r.wait_s for r in budget.waits(hours, "k", "ts", "n", 4, 2, 3 * 3600).orderBy("k", "ts").collect()] == [0, 3 * 3600 + 1, 3 * 3600 + 1, 3 * 3600 + 1, 3 * 3600 + 1] * 2
    assert budget.backoff(0) == 2 and budget.backoff(9) == 120 and budget.backoff(0, rate_limited=True) == 30
    assert round(budget.optimisation_cost(5, 1.0, 5.0)["total_usd"], 3) == 3.78


def test_resolution(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    main, golden = (spark.createDataFrame(r, "id string, path string") for r in ([("a", "m/a"), ("b", "m/b")], [("b", "g/b"), ("c", "g/c")]))
    got = resolve.with_fallbacks(ids, "id", "p", main, golden, prefer=F.col("id") == "b")
    assert {(r.id, r.p) for r in got.collect()} == {("a", "m/a"), ("b", "g/b"), ("c", "g/c")}
    old = spark.createDataFrame([("a", 1, "x"), (None, 1, "n")], "id string, t int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 1, "z"), ("a", 3, "w")], "id string, t int, v string")
    assert {(r.id, r.v) for r in resolve.upsert(old, new, ["id"], "t").collect()} == {("a", "w"), ("b", "z"), (None, "n")}
    names = spark.createDataFrame([("PMC1", "PMC1.xml"), ("PMC1", "PMC1_z.xml"), ("PMC2", "PMC2_a.xml"), ("PMC2", "PMC2_b.xml")], "id string, name string")
    assert {r.name for r in resolve.exact_first_then_last(names, "id", "name").collect()} == {"PMC1.xml", "PMC2_b.xml"}


def test_statistics(spark):
    pairs = spark.createDataFrame([(0.5, 0.2), (0.1, 0.4), (0.9, 0.1), (0.3, 0.3)], "a double, b double")
    r = stats.wilcoxon(pairs, "a", "b").first()
    assert (r.n, r.w_plus, r.w_minus) == (3, 4.5, 1.5)
    assert stats.wilcoxon_exact_p(6, 3) == 0.25 and stats.binomial_two_sided(0, 3) == 0.25 and stats.binomial_two_sided(0, 0) == 1.0
    tests = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.02)], "name string, p double")
    assert {t.name: t.rejected for t in stats.holm(tests, "p").collect()} == {"x": True, "z": True, "y": True}
    values = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("v"))
    b = stats.bootstrap_interval(values, "id", "v", rounds=200).first()
    assert b.n == 200 and b.mean == 4.5 and 3.9 < b.low < 4.5 < b.high < 5.1
    assert stats.wilcoxon(pairs.limit(0), "a", "b").first().n == 0


def test_every_problem_character_of_the_reference_is_counted(spark):
    # check_encoding.py:40-73
    removed = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\ufeff\u00ad\u2020"
    spelled = {"\xa0": " ", "\u2028": "\n", "\u2029": "\n", "\u2019": "'", "\u2018": "'", "\u201c": '"', "\u201d": '"', "\u2122": "(TM)", "\u00d7": "x"} | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212", "-")
    want = dict.fromkeys(removed, "") | spelled
    assert len(want) == 29 and want.items() <= {c: p for _, c, p in text.problem_characters()}.items()
    df = spark.createDataFrame([("en", "a" + 2 * c + "b") for c in want], "lang string, t string")
    got = {r.character: (r.n, r.n_texts) for r in maintain.character_issues(df, "t", "lang").collect()}
    assert got == {f"U+{ord(c):04X}": (2, 1) for c in want}
    assert {r.p for r in df.select(text.plain_characters(F.col("t")).alias("p")).collect()} == {"a" + 2 * p + "b" for p in want.values()}


def test_the_query_reports_every_problem_character(spark, tmp_path):
    every = [c for _, c, _ in text.problem_characters()]
    spark.createDataFrame([("en", c) for c in every], "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.character for r in evaluation.text_characters(spark, str(tmp_path)).collect()} == {f"U+{ord(c):04X}" for c in every}


@pytest.mark.parametrize("sizes", [[7] * 103, [1] * 60 + list(range(2, 45)), [3, 1, 2], [5, 5, 5, 5, 5]])
def test_splits_are_balanced_in_every_stratum(spark, sizes):
    df = spark.createDataFrame([*enumerate(sizes), (-1, None)], "id int, n int")
    rows = stats.nested_splits(df, "id", "n").collect()
    assert sorted(r.id for r in rows) == list(range(-1, len(sizes)))
    assert [(r.stratum, r.share) for r in rows if r.n is None] == [(None, None)]
    by = {k: [r for r in rows if r.stratum == k] for k in range(1, 5)}
    assert [len(v) for v in by.values()] == [len(sizes) // 4 + (k < len(sizes) % 4) for k in range(4)]
    in_order = [n for v in by.values() for n in sorted(r.n for r in v)]
    assert in_order == sorted(sizes)
    for v in by.values():
        for x in (10, 20, 30):
            assert sum(r.share is not None and r.share <= x for r in v) == -(-len(v) * x // 100)
    assert set(stats.nested_splits(df, "id", "n", width=9).collect()) == set(rows)


def test_bootstrap_draws_as_many_rows_as_there_are(spark):
    # two pairs: a resample's mean is 0, 1/2 or 1, with chances 1/4, 1/2, 1/4
    two = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id int, v double")
    ends = lambda level, **more: tuple(stats.bootstrap_interval(two, "id", "v", level=level, **more).first())
    assert ends(0.95) == (2, 0.5, 0.0, 1.0) and ends(0.46) == (2, 0.5, 0.5, 0.5) and ends(0.95, block=1) == (2, 0.5, 0.0, 1.0)
    many = spark.range(3000).select("id", (F.col("id") / 3000).alias("v"))
    for block in (4096, 200):
        r = stats.bootstrap_interval(many, "id", "v", block=block).first()
        assert r.n == 3000 and abs(r.low - (r.mean - 0.01033)) < 3e-4 and abs(r.high - (r.mean + 0.01033)) < 3e-4
    none = stats.bootstrap_interval(two.limit(0), "id", "v").first()
    assert tuple(none) == (0, None, None, None)


def test_bootstrap_query_runs_the_rounds_of_the_reference(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(evaluation, "_pairs", lambda *_: spark.createDataFrame([("a", 0.5, 0.25)], "pmcid string, a double, b double"))
    monkeypatch.setattr(evaluation.stats, "bootstrap_interval", lambda *_, rounds: asked.append(rounds))
    evaluation.paired_bootstrap(spark, "")
    assert asked == [10_000]


def test_feedback(spark):
    ids = spark.createDataFrame([(1, "iso9"), (1, "iso7")], "doc_id int, iso_id string")
    texts = spark.createDataFrame([(1, "only iso9 here")], "doc_id int, text string")
    gap = feedback.table_gap(ids, ids.limit(0), texts)
    assert gap.first().sample == ["iso9"]
    scores = spark.createDataFrame([(1, "IWL", "IWOL", 2, 1, 0, 0), (2, "IWL", "IWL", 0, 0, 1, 1)], "doc_id int, gt_category string, ext_category string, fp int, fn int, loose_tp int, tp int")
    got = {r.doc_id: r.feedback for r in feedback.composed(scores, table_gap=gap).collect()}
    assert got[2] == "Extraction correct." and "iso9" in got[1] and got[1].startswith("Category")
    link = spark.createDataFrame([("IWL", 0, 2, 1), ("IWL", 0, 2, 0), ("IWL", 1, 2, 1), ("IWOL", 0, 2, 1)], "gt_category string, iwl int, iwol int, bare int")
    assert [r.linking for r in feedback.linking_failure(link).collect()] == ["full", "partial", None, None]


def test_feedback_query_names_linking_failures_and_unknown_fields(spark, tmp_path):
    linked, loose, bare = "isolates_with_linking", "isolate_without_linking", "no_isolates_only_assayinformation"
    truth = {linked: {"a": {"mlst": "ST1"}}}
    outputs = {
        "PMC1": {loose: ["a"], bare: {"mlst": "ST1"}},
        "PMC2": {loose: ["a"], bare: {"mlst": ""}},
        "PMC3": {linked: {"a": {"mlst": "ST1", " Host": None, "Serovar": ""}}, bare: {"MLST ": "", "year": []}},
        "PMC4": truth,
        "PMC5": {linked: {"b": {"mlst": "ST1"}}, loose: ["a"]},
    }
    gt = [(k, i, json.dumps(truth), dt.datetime(2024, 1, 1)) for i, k in enumerate(outputs)]
    ext = [(k, i, json.dumps(v), dt.datetime(2024, 1, 1)) for i, (k, v) in enumerate(outputs.items())]
    spark.createDataFrame(gt, "pmcid string, gt_id bigint, gt_json string, updated_at timestamp").write.parquet(str(tmp_path / "gt_records.parquet"))
    spark.createDataFrame(ext, "pmcid string, extraction_id bigint, raw_model_output string, created_at timestamp").write.parquet(str(tmp_path / "extraction_results.parquet"))
    spark.createDataFrame([("PMC9", "article", "x")], "pmcid string, doc_type string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = evaluation.feedback_messages(spark, str(tmp_path)).collect()
    got = {r.doc_id[-1]: r.feedback.split("\n") for r in rows}
    full, partial = "Isolates and assay data were given but not linked.", "Isolates were given without links, linked ones are expected."
    assert len(rows) == 5 and {k for k, v in got.items() if full in v} == {"1"} and {k for k, v in got.items() if partial in v} == {"2"}
    assert {k: x for k, v in got.items() for x in v if x.startswith("Unknown")} == {"3": "Unknown fields:  Host, Serovar, year"}
    assert got["4"] == ["Extraction correct."]


def test_maintenance(spark):
    doc = {"isolates_with_linking": [{"isolate_id": "a", "mlst": ["1"], "isolate_country": "x"}, {"isolate_id": "b", "mlst": ["2", "1"], "amr": "q\u2013r"}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"b": 1, "a": 2}'), (3, "{"), (4, None)], "id int, j string")
    rows = {r.id: r for r in maintain.cleaning_plan(df, "id", "j").collect()}
    assert (rows[1].changed, rows[1].dropped) == (True, 1) and not rows[2].changed and rows[3].before_hash is None and not rows[4].changed
    fixes = spark.createDataFrame([(1, ["a", "b"], None, None)], "id int, old_ids array<string>, field string, value string")
    new = json.loads({r.id: r for r in maintain.cleaning_plan(df, "id", "j", fixes).collect()}[1].new_json)
    assert new["no_isolates_only_assayinformation"] == {"mlst": ["1", "2"], "amr": "q-r"} and new["isolates_with_linking"] == []
    assert maintain.content_hash({"a": 1, "b": 2}) == maintain.content_hash({"b": 2, "a": 1})
    assert maintain.merged("x", "x") == ["x", "x"]
    fix = spark.createDataFrame([('{"single": {"P1": {"old_id": "o", "ensure_field": "f", "ensure_value": "v"}}, "multi": {"P2": {"old_ids": ["a", "b"]}}}',)], "j string")
    assert {(r.pmcid, tuple(r.old_ids)) for r in fix.select(F.inline(maintain.fix_rows(F.col("j")))).collect()} == {("P1", ("o",)), ("P2", ("a", "b"))}


def test_article_text():
    a = read_article("<article><front><article-title>T</article-title><abstract><p>Ab</p></abstract></front><body><sec><title>Aim</title><p>x <i>y</i> z</p><table-wrap><label>T1</label><caption><p>c</p></caption><table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table></table-wrap></sec></body></article>")
    assert [s["name"] for s in a["sections"]] == ["abstract", "aim"] and a["tables"] == ["T1: c\nh\n" + "-" * 40 + "\n1 | 2"]
    assert read_article("<a>")["sections"] == [] and read_article(None)["text"] is None


def test_dates(spark):
    assert one(spark, dt.date(2024, 3, 31), dates.previous_month, "date") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert one(spark, "Feb 2023", dates.month_range) == (dt.date(2023, 2, 1), dt.date(2023, 2, 28))
    assert one(spark, "13/2023", dates.month_range) is None and one(spark, "june 1800", dates.month_range) is None


def test_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("PMC2\n\n# c\npmcid\n PMC1 \nPMC2\n")
    assert [r.id for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["PMC1", "PMC2"]
    assert [r.id for r in files.id_list_as_written(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == ["PMC2", "PMC1", "PMC2"]
    (tmp_path / "ids.csv").write_text("x,PMC ID\n1,123\n2,PMC9\n3,bad\n")
    assert {r.id for r in files.id_csv(spark, str(tmp_path / "ids.csv")).collect()} == {"PMC123", "PMC9"}
    (tmp_path / "bare.csv").write_text("PMC5,x\nPMC6,y\n")
    assert {r.id for r in files.id_csv(spark, str(tmp_path / "bare.csv")).collect()} == {"PMC5", "PMC6"}
    xml = tmp_path / "xml"
    xml.mkdir()
    for n in ("PMC1_a.xml", "PMC1_b.xml", "PMC2.xml", "x.txt"):
        (xml / n).write_text("<a/>")
    assert {(r.id, r.path[-10:]) for r in files.xml_listing(spark, str(xml)).collect()} == {("PMC1", "PMC1_b.xml"), ("PMC2", "l/PMC2.xml")}
    assert files.xml_listing(spark, str(tmp_path / "none")).count() == 0
    layouts = [{"metadata": {}, "holdout_test_set": {"golden": ["a"], "total": 1}, "validation_set": {"pmcids": ["b"]}}, {"split_indices": {"split_10": ["a"]}}, {"splits": {"s": {"files": ["c"]}}}]
    want = [{("holdout_test_set", "golden", "a"), ("validation_set", "pmcids", "b")}, {("split_10", "all", "a")}, {("s", "files", "c")}]
    for k, (v, w) in enumerate(zip(layouts, want)):
        (tmp_path / f"s{k}.json").write_text(json.dumps(v))
        assert {tuple(r) for r in files.splits(spark, str(tmp_path / f"s{k}.json")).collect()} == w
    assert files.tracker(spark, str(tmp_path / "none.csv")).count() == 0
    sup = tmp_path / "sup" / "PMC1"
    sup.mkdir(parents=True)
    for n in ("a.PNG", "b.pdf", "c.exe"):
        (sup / n).write_bytes(b"x" * 2048)
    m = files.file_manifest(files.supplementary_files(spark, str(tmp_path / "sup"))).first()
    assert m.id == "PMC1" and [f["name"] for f in m.files] == ["b.pdf", "a.PNG"] and m.files[0]["size_kb"] == 2.0


def test_sinks(spark, tmp_path):
    ddl = "pmcid string, gt_category string, ext_category string, category_correct boolean, tp int, fp int, fn int, primary_f1 double, loose_f1 double, error_message string"
    rows = spark.createDataFrame([("a", "IWL", "IWL", True, 1, 0, 0, 1.0, 1.0, None), ("b", "", "IWL", False, 0, 1, 0, 0.0, 0.0, "bad")], ddl)
    sinks.write_report(rows, str(tmp_path / "out"), "run")
    s = json.loads((tmp_path / "out/summary.json").read_text())
    assert s["overall"]["n"] == 2 and set(s["by_category"]) == {"", "IWL"} and s["category_accuracy"] == 0.5
    assert [r.pmcid for r in sinks.as_text(rows).collect()] == ["b", "a"]
    assert sinks.append_changelog([{"a": 1}], str(tmp_path / "log.json")) == 1 and sinks.append_changelog([{"a": 2}], str(tmp_path / "log.json")) == 2
    src = tmp_path / "f.txt"
    src.write_text("x")
    step = [{"path": str(src), "target": "t", "status": "PLANNED"}]
    assert sinks.run_moves(step, {"t": str(tmp_path / "t")})[0]["status"] == "DRY_RUN" and sinks.run_moves(step, {"t": str(tmp_path / "t")}, apply=True)[0]["status"] == "MOVED"
    assert sinks.save_text("y" * 10, str(tmp_path / "z.xml"), 5).endswith(".gz")


def test_adapters(spark):
    df = spark.createDataFrame([(1, "see AB123456"), (2, None), (3, "none")], "id int, t string")
    got = {r.id: (r.raw, r.error) for r in adapters.extract(df, "id", "t", adapters.RuleExtractor()).collect()}
    assert got[1][0].endswith("Total: 1") and got[2] == (None, None) and got[3][0] == "Accessions\nTotal: 0"
    failed = adapters.extract(df.where("id = 1"), "id", "t", adapters.Replay({}), 2).first()
    assert failed.raw is None and "KeyError" in failed.error
    h = spark.createDataFrame([('{"usage": {"prompt_tokens": 5, "completion_tokens": 2}}',), ('{"response": {"usage": {"input_tokens": 7}}}',), ("x",)], "j string")
    assert [(r.tokens_in, r.is_actual) for r in adapters.token_usage(h, "j").collect()] == [(5, True), (7, False), (None, False)]


def test_streams(spark, tmp_path):
    from evalweave.streaming import jobs

    t = dt.datetime(2024, 1, 1)
    ddl = "k string, ts timestamp, n bigint"
    rows = [("a", t, 6), ("a", t + dt.timedelta(seconds=10), 6), ("a", t + dt.timedelta(seconds=70), 6), ("b", t, 1)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), ddl)
    jobs.run_into_table(jobs.budget_decisions(stream, "k", "ts", "n", 10), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.key, r.used, r.fits) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, True), ("a", 0, True), ("a", 6, False), ("b", 0, True)]
    jobs.run_upserts(jobs.event_stream(spark, str(tmp_path / "in"), ddl), str(tmp_path / "tr"), str(tmp_path / "cp2"), ["k"], "ts")
    assert {(r.k, r.ts) for r in jobs.current(spark, str(tmp_path / "tr")).collect()} == {("a", t + dt.timedelta(seconds=70)), ("b", t)}
    # later batches rewrite only the buckets they touch
    for day in range(1, 4):
        spark.createDataFrame([("a", t + dt.timedelta(days=day), day), (f"new{day}", t, 0)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_upserts(jobs.event_stream(spark, str(tmp_path / "in"), ddl), str(tmp_path / "tr"), str(tmp_path / "cp2"), ["k"], "ts")
    now = {r.k: r.n for r in jobs.current(spark, str(tmp_path / "tr")).collect()}
    assert now == {"a": 3, "b": 1, "new1": 0, "new2": 0, "new3": 0}
    assert len({v for v in jobs._versions(spark, str(tmp_path / "tr")).values()}) > 1 and jobs._versions(spark, str(tmp_path / "tr"), 1).keys() == jobs._versions(spark, str(tmp_path / "tr"), 1).keys() - {None}
