"""Sources, normalisers, marts, routes, labels, launch bias, names and streams."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilake.operators import contingency as C
from vigilake.operators import counts as K
from vigilake.operators import disproportionality as D
from vigilake.operators import dedup, labels, launch_bias, marts, resolve
from vigilake.plans import predicate, registry
from vigilake.plans.analysis import AnalysisConfig, analyse
from vigilake.sources import reports, schema
from vigilake.sources.adapter import facts


@pytest.fixture(scope="module")
def fact(spark, sf_dir):
    return facts(spark, sf_dir).persist()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("where", [None, "sex = 'male'", "age_stratum = 'adult'", "sex = 'female' AND age_stratum IN ('adult', 'unknown')", "drug_name = 'BLUE ANVIL'", "drug_name = 'BLUE ANVIL' AND sex = 'male'", "sex = 'male' AND receive_year > 1998", "sex IN ('male', 'female')"])
def test_marts_give_what_a_scan_gives(fact, where):
    m = marts.Marts.of(fact)
    assert rows(C.contingency(fact, "SMALL RING", where, m, 1)) == rows(C.contingency(fact, "SMALL RING", where, None, 1))


def test_all_pairs_agrees_with_one_drug(fact):
    assert rows(C.all_pairs(fact).where("drug = 'SMALL RING'")) == rows(C.contingency(fact, "SMALL RING"))


def test_every_comedication_agrees_with_one(fact):
    one = C.contingency(fact, "SMALL RING", "drug_name = 'BLUE ANVIL'", min_a=1)
    every = C.every_comedication(fact, "SMALL RING", 1).where("co_drug = 'BLUE ANVIL'").drop("co_drug")
    assert rows(one) == rows(every)


def test_absent_drugs_give_empty_tables(fact):
    for drug, where in (("NONE", None), ("SMALL RING", "drug_name = 'NONE'"), ("O'NEIL", "drug_name = 'O''NEIL'")):
        t = C.contingency(fact, drug, where)
        assert t.columns == ["drug", "pt", "a", "b", "c", "d", "n"] and t.count() == 0


def test_predicates_are_parsed_or_refused():
    p = predicate.Predicate.parse("sex = 'male' AND receivedate BETWEEN '2001' AND '2002' AND age_years IS NOT NULL")
    assert [t.op for t in p.terms] == ["=", "BETWEEN", "IS NOT NULL"]
    for bad in ("1 = 1", "(sex = 'x'", "sex = 'x' OR", "sex IN ()", "sex = 'x'; DROP TABLE t", "nope = 'x'"):
        with pytest.raises(ValueError):
            predicate.Predicate.parse(bad)
    assert predicate.detect_route("sex = 'male' AND receive_year > 2010") == "cubed"
    assert predicate.detect_route("SEX = 'male'") == predicate.detect_route("sex in ('male')") == "cubed"
    assert predicate.Predicate.parse("drug_name IN ('X (Y)', 'Z, (W')").terms[0].values == ("X (Y)", "Z, (W")
    assert predicate.Predicate.parse("sex = 'male' OR age_stratum = 'adult'").route() == "cubed"
    assert predicate.Predicate.parse("sex = 'male' OR drug_name = 'X'").route() == "full"
    assert predicate.Predicate.parse("sex = 'male' AND receive_year > 2010").route() == "full"
    assert predicate.detect_route(None) == "global" and predicate.detect_route("") == "full"
    assert predicate.label(predicate.stratum("male", "adult", "X")) == "Sex: Male, Age: Adult, Co-med: X"


def test_conditions_with_or_and_brackets(fact, duck):
    from vigilake.sources.adapter import with_facts

    for where in ("sex = 'male' OR age_stratum = 'adult' AND serious = '1'", "NOT (sex = 'male' OR sex = 'female')", "(sex = 'male' AND (receive_year > 1997 OR receive_year IS NULL)) AND drug_indication NOT LIKE 'PROMO%'", "drug_name IN ('SMALL RING', 'BLUE (ANVIL)') OR age_years NOT BETWEEN 20 AND 90.5"):
        p = predicate.Predicate.parse(where)
        assert fact.where(predicate.bound(list(p.terms))).count() == duck.sql(with_facts(f"SELECT count(*) FROM fact WHERE {where}")).fetchall()[0][0], where


def test_flatten_edge_reports(spark, tmp_path):
    report = {"safetyreportid": "1", "receivedate": "200703", "patient": {"patientonsetage": "6", "patientonsetageunit": "802", "patientsex": "2"}}
    drug = {"medicinalproduct": " aspirin ", "drugcharacterization": "1"}
    full = report | {"patient": report["patient"] | {"drug": drug, "reaction": [{"reactionmeddrapt": "Pain"}, {"reactionmeddrapt": ""}, {"reactionmeddrapt": "  "}]}}
    none = report | {"safetyreportid": "2", "patient": report["patient"] | {"drug": [], "reaction": [{"reactionmeddrapt": "Pain"}]}}
    fda = report | {"safetyreportid": "3", "receivedate": None, "receiptdate": "20070015", "patient": {"drug": [{"openfda": {"generic_name": ["Gen", "x"]}}, {}], "reaction": {"reactionmeddrapt": "Rash"}}}
    (tmp_path / "a.json").write_text(json.dumps({"results": [full, none, fda]}, indent=1))
    out = reports.flatten(reports.read_files(spark, str(tmp_path / "a.json")))
    assert out.schema.fieldNames() == schema.FACT.fieldNames()
    got = {(r["safetyreportid"], r["drug_name"], r["reaction_pt"]): r for r in out.collect()}
    assert set(got) == {("1", "ASPIRIN", "PAIN"), ("1", "ASPIRIN", ""), ("3", "GEN", "RASH"), ("3", "", "RASH")}
    r = got["1", "ASPIRIN", "PAIN"]
    assert (r["receivedate"], r["receive_quarter"], r["age_years"], r["age_stratum"], r["sex"], r["outcome_death"]) == ("2007-03-01", "2007Q1", 0.5, "pediatric", "female", "0")
    assert got["3", "GEN", "RASH"]["receivedate"] == "2007-00-15" and got["3", "GEN", "RASH"]["receive_quarter"] is None
    assert got["3", "", "RASH"]["drug_name_source"] == "missing" and got["3", "GEN", "RASH"]["drug_name_source"] == "openfda.generic_name"


def test_dedup_rules(spark):
    x = spark.createDataFrame([("a", "2001", 1), ("a", "2002", 2), ("a", "2002", 2), ("b", None, 3), (None, "1999", 4), (None, None, 5)], "safetyreportid string, receivedate string, k int")
    assert sorted(r["k"] for r in dedup.latest_versions(x).collect()) == [2, 2, 4, 5]
    assert sorted(r["k"] for r in dedup.latest_versions(x, distinct=True).collect()) == [2, 4, 5]


def test_cube_counts_reports_not_pairs(spark):
    x = spark.createDataFrame([("1", "male", "adult", "A"), ("1", "male", "adult", "B"), ("2", "male", "adult", "A"), ("3", "unknown", "adult", "A")], "safetyreportid string, sex string, age_stratum string, reaction_pt string")
    got = {(r["sex"], r["reaction_pt"]): (r["n_pt_stratum"], r["n_stratum"], r["n_pairs_stratum"]) for r in marts.marginals_cubed(x).collect()}
    assert got == {("male", "A"): (2, 2, 3), ("male", "B"): (1, 2, 3), ("unknown", "A"): (1, 1, 1)}


def test_label_words(spark):
    texts = spark.createDataFrame([("D", "warnings", "abdominal pains and peripheral edema (severe)"), ("D", "precautions", "pain, or c++ syndrome")], "drug_name string, section string, text string")
    terms = spark.createDataFrame([("D", t) for t in ("PAIN", "PERIPHERAL OEDEMA", "ABDOMINAL PAIN", "C++ SYNDROME")], "drug_name string, pt string")
    got = {(r["pt"], r["section"]): r for r in labels.matches(terms, texts).collect()}
    assert set(got) == {("PAIN", "precautions"), ("PERIPHERAL OEDEMA", "warnings"), ("C++ SYNDROME", "precautions")}
    assert got["PERIPHERAL OEDEMA", "warnings"]["matched_term"] == "peripheral edema"
    assert got["PERIPHERAL OEDEMA", "warnings"]["snippet"] == "…abdominal pains and peripheral edema (severe)…"


def test_launch_thresholds(spark):
    base = dict(total=30, years=5, first_year=2000, approval_year=2000, early_ratio=0.1, peak_offset=9, trend_slope=None, post_peak_slope=None)
    cases = [({}, "LOW"), ({"total": 29}, "HIGH"), ({"early_ratio": 0.5}, "MODERATE"), ({"early_ratio": 0.7}, "HIGH"), ({"years": 4}, "MODERATE"), ({"years": 2}, "HIGH"), ({"peak_offset": 3}, "HIGH"), ({"peak_offset": 4}, "MODERATE"), ({"peak_offset": 7, "post_peak_slope": -0.1}, "HIGH"), ({"peak_offset": 7, "post_peak_slope": 0.1}, "MODERATE"), ({"approval_year": None, "early_ratio": None, "peak_offset": 0}, "MODERATE")]
    for k, (change, want) in enumerate(cases):
        one = spark.createDataFrame([(k, *(base | change).values())], "k int, total long, years int, first_year int, approval_year int, early_ratio double, peak_offset int, trend_slope double, post_peak_slope double")
        assert launch_bias.risk(one).head()["risk"] == want, change


def test_names(spark):
    index = spark.createDataFrame([("WARFARIN SODIUM",), ("ACETYLCYSTEINE",), ("ACETAMINOPHEN",)], "drug_name string")
    names = spark.createDataFrame([("acetylcysteine",), ("Tachipirina 500MG",), ("sodium warfarin",), ("zzz",), ("coumadin",)], "query string")
    got = {r["query"]: (r["name"], r["method"], r["via"]) for r in resolve.resolve(names, index, resolve.brands(spark)).collect()}
    assert got == {"acetylcysteine": ("ACETYLCYSTEINE", "exact", "name"), "Tachipirina 500MG": ("ACETAMINOPHEN", "exact", "brand"), "sodium warfarin": ("WARFARIN SODIUM", "fuzzy", "name"), "zzz": ("ZZZ", "passthrough", None), "coumadin": ("WARFARIN SODIUM", "fuzzy", "brand")}
    by_start = {r["query"]: r["name"] for r in resolve.resolve(names, index, resolve.brands(spark), whole_words=False).collect()}
    assert by_start["acetylcysteine"] == "ACETAMINOPHEN" and by_start["Tachipirina 500MG"] == "ACETAMINOPHEN"
    lost = resolve.resolve(spark.createDataFrame([("plavix",), (None,)], "query string"), index, resolve.brands(spark)).collect()
    assert [tuple(r)[:3] for r in lost] == [("plavix", "PLAVIX", "passthrough")]  # its substance is not in the data
    ask = lambda q: {"zzz": "warfarin"}.get(q, "nothing like it")
    asked = {r["query"]: (r["name"], r["method"], r["via"]) for r in resolve.resolve(names, index, resolve.brands(spark), ask=ask).collect()}
    assert asked["zzz"] == ("WARFARIN SODIUM", "asked", "ask") and asked["coumadin"][1] == "fuzzy"


def test_fuzzy_against_every_pair(spark, sf_dir):
    """Names of the parts, written with slips: the best of all names by the plain score, or none."""
    index = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.upper("p_name").alias("drug_name")).distinct()
    every = sorted(r[0] for r in index.collect())
    slips = [n[1:] for n in every] + [n[:3] + n[4:] for n in every] + [" ".join(reversed(n.split())) for n in every] + [n.replace("E", "A") for n in every]
    names = spark.createDataFrame([(s,) for s in sorted(set(slips))], "query string")
    got = {r["query"]: (r["match"], round(r["score"], 6)) for r in resolve.fuzzy(names, index).collect()}
    for q in set(slips):
        best = min(((-resolve.token_set_ratio(q, n), n) for n in every))
        assert got.get(q) == ((best[1], round(-best[0], 6)) if -best[0] >= resolve.LEAST else None), q


def test_slips_at_the_start_of_a_name(spark):
    index = spark.createDataFrame([("IBUPROFEN",), ("CLOPIDOGREL",), ("PHENYTOIN",), ("FENTANYL",), (None,)], "drug_name string")
    names = spark.createDataFrame([("Ybuprofen",), ("KLOPIDOGREL",), ("FENYTOIN",), (None,), ("",)], "query string")
    got = {r["query"]: (r["match"], round(r["score"], 1)) for r in resolve.fuzzy(names, index).collect()}
    assert got == {"Ybuprofen": ("IBUPROFEN", 88.9), "KLOPIDOGREL": ("CLOPIDOGREL", 90.9), "FENYTOIN": ("PHENYTOIN", 82.4)}


def test_letter_counts_lose_no_pair():
    parts = ["RING", "RINGS", "SMALL", "SMAL", "BLUE", "BULE", "A", "GRIN", "ANVIL"]
    every = parts + [f"{x} {y}" for x in parts for y in parts] + ["", "  "]
    for a in every:
        for b in every:
            for least in (50.0, 75.0, 90.0):
                assert resolve.may_reach(a, b, least) or resolve.token_set_ratio(a, b) < least, (a, b)


def test_multi_item_and_binary(spark):
    x = spark.createDataFrame([(k, ["b", "a"], "E") for k in range(3)] + [(9, ["a"], "E")], "id int, items array<string>, AE string")
    assert rows(K.convert_multi_item(x)) == [("a", "E", 4), ("a|b", "E", 3), ("b", "E", 3)]
    c = spark.createDataFrame([("p", "E", 2), ("p", "F", 1)], "name string, AE string, count long")
    assert sorted(tuple(r)[2:] for r in K.convert_binary(c, ["E", "F"]).collect()) == [(0, 1), (1, 0), (1, 0)]


def test_long_lists_of_products(spark):
    """No list is too long: subsets grow level by level, as plain enumeration has them."""
    from collections import Counter
    from itertools import combinations

    rng = __import__("random").Random(4)
    made = [(k, [f"i{j:02d}" for j in range(16) if rng.random() < 0.45], rng.choice("EF")) for k in range(60)] + [(100, [], "E"), (101, None, "E")]
    want = Counter((("|".join(c)), ae) for _, items, ae in made for r in range(1, len(items or []) + 1) for c in combinations(items, r))
    x = spark.createDataFrame(made, "id int, items array<string>, AE string")
    got = {(r["name"], r["AE"]): r["count"] for r in K.convert_multi_item(x, min_threshold=6).collect()}
    assert got == {k: n for k, n in want.items() if n >= 6} and max(k.count("|") for k, _ in got) >= 2


def test_lasso_in_other_ways(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows_ = [(k, f"p{j}", "E" if rng.random() < 0.2 + 0.5 * (j == 0) - 0.1 * (j == 1) else "F") for k in range(300) for j in range(4) if rng.random() < 0.5]
    x = spark.createDataFrame(rows_, "id int, name string, AE string")
    fit = lambda v, **how: {(r["drug"], r["pt"]): r["coefficient"] for r in K.lasso(x, ["p0", "p1", "p2", "p3"], ["E"], variant=v, num_bootstrap=2, **how).collect()}
    for alpha in (0.001, 0.01, 0.05):
        one, two = fit("descent", alpha=alpha), fit("lars", alpha=alpha)
        assert one == pytest.approx(two, abs=1e-7)
    ic = fit("ic")
    assert ic["p0", "E"] == max(ic.values()) > 0.2
    nb = fit("nb", alpha=0.001)
    assert min(nb.values()) >= 0 and fit("nb", alpha=5.0) == pytest.approx(dict.fromkeys(nb, 0.0))
    with pytest.raises(ValueError):
        fit("other")


def test_path_by_least_angles():
    """At every penalty the path holds the conditions of the minimum, and the criterion picks the best knot."""
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        x = (rng.random((60, 5)) < 0.4).astype(float)
        x[:, 4] = x[:, 3] if rng.random() < 0.3 else x[:, 4]
        y = x @ rng.normal(size=5) + rng.normal(size=60)
        g, c, vy = K.moments(x, y, np.ones(60))
        knots = K.angle_path(g, c)
        for alpha in np.linspace(0.001, knots[0][0], 7):
            b = K.on_path(knots, alpha)
            d = K.descend(g, c, alpha, steps=20_000)
            cost = lambda v: v @ g @ v / 2 - v @ c + alpha * np.abs(v).sum()
            assert cost(b) <= cost(d) + 1e-8
        assert any(np.array_equal(K.by_criterion(g, c, vy, 60.0, "aic"), k) for _, k in knots)


def test_negative_binomial_by_its_slope():
    """One indicator: without a penalty the coefficient is the log of the mean where it is set."""
    import numpy as np

    x, y, w = np.array([[0.0], [1.0], [1.0]]), np.array([1.0, 2.0, 4.0]), np.array([5.0, 3.0, 3.0])
    assert K.negative_binomial(x, y, w, 0.0, 1.0)[0] == pytest.approx(np.log(3.0), abs=1e-6)


def test_label_records(spark):
    record = lambda **s: {k: [v] if isinstance(v, str) else v for k, v in s.items()}
    results = [record(warnings="May cause PAIN", indications_and_usage="rash"), record(warnings=["Second", "text"], precautions=None), record(boxed_warning="Box"), record(warnings="never read")]
    raw = spark.createDataFrame([("D", json.dumps(results)), ("N", None), ("E", "[]"), ("B", "not json")], "drug_name string, results string")
    got = {(r["drug_name"], r["section"]): r["text"] for r in labels.sections(labels.from_records(raw)).collect()}
    assert got == {("D", "warnings"): "may cause pain second text", ("D", "boxed_warning"): "box"}


def test_expected_by_regression(spark):
    t = spark.createDataFrame([("d", f"p{i}{j}", i * j, i * 10 - i * j, j * 20 - i * j, 10_000, 10_000) for i in range(1, 8) for j in range(1, 8)], "drug string, pt string, a long, b long, c long, d long, n long")
    for method in ("poisson", "negative-binomial"):
        for r in K.expected(t, method).collect():  # counts that are exactly log-linear in their margins
            assert r["expected"] == pytest.approx(r["a"], rel=1e-5)
    assert K.dispersion(t).head()["dispersion"] is False


def test_lasso_finds_the_product(spark):
    rows_ = [(k, "A" if k % 2 else "B", "E" if k % 2 else "F") for k in range(60)]
    x = spark.createDataFrame(rows_, "id int, name string, AE string")
    got = {(r["drug"], r["pt"]): r["coefficient"] for r in K.lasso(x, ["A", "B"], ["E", "G"], alpha=0.01).collect()}
    assert got["A", "E"] > 0.3 and got["B", "E"] <= 0.01 and got["A", "G"] == 0


def test_lasso_keeps_reports_without_listed_products(spark):
    rows_ = [(k, "A" if k % 2 else "B", "E" if k % 2 else "F") for k in range(60)]
    x = spark.createDataFrame(rows_, "id int, name string, AE string")
    got = {r["pt"]: (r["events"], r["coefficient"]) for r in K.lasso(x, ["A"], ["E", "F"], alpha=0.01).collect()}
    # one centred indicator of variance 1/4, covariance with E of 1/4 and with F of -1/4
    assert got == {"E": (30, pytest.approx(0.96)), "F": (30, pytest.approx(-0.96))}


def test_lasso_of_packed_reports(spark):
    """A row for each id gives what a row for each product and event gives, and no pair is joined by its report."""
    rows_ = [(k, f"p{j}", f"E{(k * j) % 3}") for k in range(200) for j in range(5) if (k * 7 + j * 3) % 4]
    x = spark.createDataFrame(rows_, "id int, name string, AE string")
    fit = lambda df: rows(K.lasso(df, ["p0", "p1", "p3"], ["E0", "E1", "none"], alpha=0.001, num_bootstrap=3))
    packed = x.groupBy("id").agg(F.collect_set("name").alias("names"), F.collect_set("AE").alias("AEs"))
    assert fit(packed) == fit(x)
    n, both, _ = K.co_reports(packed, ["p0", "p1"], ["E0"], 1, 1)
    ids = [{i for i, p, _ in rows_ if p == q} for q in ("p0", "p1")]
    assert n[0] == len({r[0] for r in rows_}) and both[0].tolist() == [[len(a & b) for b in ids] for a in ids]


def test_simulated_components_of_all_drugs(spark, fact, sf_dir):
    got = registry.queries()["q_bcpnn_mc"](spark, sf_dir).persist()
    pairs = C.all_pairs(fact)
    assert got.count() == pairs.where("a >= 3").count() and got.select("drug").distinct().count() > 1
    one = D.bcpnn_simulated(pairs.where("drug = 'SMALL RING'"), draws=10_000)  # seeded by cell
    assert rows(got.where("drug = 'SMALL RING'")) == rows(one)


def test_subsets_of_all_lines(spark, sf_dir):
    names = {r["name"] for r in registry.queries()["q_multi_item"](spark, sf_dir).collect()}
    assert len(names) == 127 and "L1|L2|L3|L4|L5|L6|L7" in names


def test_lasso_query_has_all_drugs_and_words(spark, sf_dir):
    got = registry.queries()["q_lasso"](spark, sf_dir).select("drug", "pt").collect()
    drugs = {r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select(F.upper("p_name")).distinct().collect()}
    assert len(got) == len(set(got)) and {d for d, _ in got} == drugs and len(got) == 6 * len(drugs)


def test_analysis_is_one_lazy_plan(spark, fact, tmp_path):
    texts = spark.createDataFrame([("SMALL RING", "warnings", "nothing")], "drug_name string, section string, text string")
    config = AnalysisConfig.from_json('{"drug": "SMALL RING", "prr_threshold": 0.9, "ror_threshold": 0.9, "ic_threshold": -1, "eb05_threshold": 0.1}')
    a = analyse(fact, config, label_texts=texts, approvals=spark.createDataFrame([("SMALL RING", 1995)], "drug_name string, year int"))
    ranked = a.ranked.collect()
    assert ranked and {r["validation_status"] for r in ranked} == {"POTENTIALLY_NEW"}
    told = {r["item"]: r["value"] for r in a.summary().collect()}
    assert a.launch.count() == 1 and told["target_drug"] == "SMALL RING" and told["POTENTIALLY_NEW"] == str(len(ranked)) and told["launch_risk"] == a.launch.head()["risk"]
    assert all(told[f"{k}_pairs"] == told["cells"] for k in ("prr", "ror", "bcpnn", "mgps")) and int(told["ror_positive"]) > 0
    a.write(str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/ranked")).count() == len(ranked)
    assert analyse(fact, AnalysisConfig("NONE")).ranked.count() == 0


def test_marts_on_disk(spark, fact, tmp_path):
    root = str(tmp_path / "marts")
    marts.Marts.of(fact).write(root)
    again = marts.Marts.read(spark, root)
    assert rows(C.contingency(fact, "SMALL RING", None, again)) == rows(C.contingency(fact, "SMALL RING"))
    reports.write_sorted(fact, str(tmp_path / "fact"))
    assert not reports.is_stale(spark, root, str(tmp_path / "fact")) and reports.is_stale(spark, root, str(tmp_path / "none"))
    check = {r["name"]: (r["rows"], r["ok"]) for r in reports.verify(spark, fact=str(tmp_path / "fact"), none=str(tmp_path / "none")).collect()}
    assert check["fact"] == (fact.count(), True) and check["none"] == (0, False)
    plan = spark.read.parquet(str(tmp_path / "fact")).where("drug_name = 'SMALL RING'").select("safetyreportid")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(drug_name), EqualTo(drug_name,SMALL RING)" in plan and "ReadSchema: struct<safetyreportid:string,drug_name:string>" in plan


def test_stream_keeps_latest_versions(spark, tmp_path):
    from vigilake.streaming.reports import LatestVersions, read_stream

    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *reports_):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in reports_))
        os.rename(tmp_path / name, folder / name)

    def report(i, date, pt="Pain"):
        return {"safetyreportid": i, "receivedate": date, "patient": {"drug": [{"medicinalproduct": "x"}], "reaction": [{"reactionmeddrapt": pt}]}}

    table = LatestVersions(spark, f"{tmp_path}/facts", buckets=4)

    def drain():
        q = table.follow(read_stream(spark, str(folder)), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()

    put("1.json", report("1", "20200101"), report("2", "20200101"))
    drain()
    put("2.json", report("1", "20200301", "Rash"), report("2", "20191201", "Late"))
    drain()
    assert sorted((r["safetyreportid"], r["receivedate"], r["reaction_pt"]) for r in table.current().collect()) == [("1", "2020-03-01", "RASH"), ("2", "2020-01-01", "PAIN")]
    for k in range(3, 7):
        put(f"{k}.json", report("1", f"20200{k}01", f"Term {k}"), report("2", f"20200{k}02"), report("", "20200101", f"No id {k}"))
        drain()
    now = sorted((r["safetyreportid"] or "", r["receivedate"], r["reaction_pt"]) for r in table.current().collect())
    assert now == [("", "2020-01-01", f"NO ID {k}") for k in range(3, 7)] + [("1", "2020-06-01", "TERM 6"), ("2", "2020-06-02", "PAIN")]
    assert len(table._versions()) <= 2 + len(set(p.rpartition("/")[0] for p in table._held().values()))


def test_quarters_of_a_stream(spark, tmp_path):
    from vigilake.streaming.reports import quarterly_counts, read_stream

    (tmp_path / "in").mkdir()
    one = {"patient": {"drug": [{"medicinalproduct": "x"}], "reaction": [{"reactionmeddrapt": "Pain"}, {"reactionmeddrapt": "Rash"}]}}
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(one | {"safetyreportid": str(k), "receivedate": d}) for k, d in enumerate(["20200101", "20200331", "20200401"])))
    q = quarterly_counts(read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("by_quarter").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("by_quarter").collect()) == [("2020Q1", 4), ("2020Q2", 2)]


def test_targets_that_are_missing(spark, tmp_path):
    manifest = spark.createDataFrame([(f"https://x/2004q2/drug-event-000{k}-of-0003.json.zip", "1", 1) for k in (1, 2, 3)], schema.MANIFEST)
    (tmp_path / "2004q2").mkdir()
    (tmp_path / "2004q2" / "drug-event-0002-of-0003.json").write_text("{}")
    left = reports.pending(spark, reports.select_partitions(manifest), str(tmp_path)).collect()
    assert sorted(r["target"] for r in left) == ["2004q2/drug-event-0001-of-0003.json", "2004q2/drug-event-0003-of-0003.json"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return v if v is None or isinstance(v, (int, bool)) else str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    cols = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and q == pytest.approx(p, rel=1e-9, abs=2e-5)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
