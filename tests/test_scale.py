"""What holds for families, names, drugs, files and tables of any size: each against the plain form."""

import itertools
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.operators import bitmaps, contingency, disproportionality, marts, resolve, scan, timeline
from vigilake.sources import lookups, reports, schema
from vigilake.sources.adapter import facts as derived


@pytest.fixture(scope="module")
def facts(spark, sf_dir):
    return derived(spark, sf_dir).persist()


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


# ---- families


def some_ps(seed, n, ties):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n) ** 2, 2 if ties else 9)
    if ties:
        p[rng.random(n) < 0.35] = 0.25  # a third of all rows are one value: over several ranges
    return [(["all", "all", "all", "b", None][rng.integers(5)], f"t{k:05d}", float(p[k])) for k in range(n)]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_scans_over_ranges(spark, ranges):
    rows = some_ps(ranges, 700, ties=True)
    x = scan.Ranges(spark.createDataFrame(rows, "drug string, pt string, p double").repartition(5), "drug", "p", "pt", ranges=ranges)
    x.running("sum", F.col("p"), "up").running("min", F.col("i") % 50, "low", backwards=True).running("max", -F.col("p"), "top")
    x.over_ties(lo=("min", F.col("i")), hi=("max", F.col("i")), mid=("max", F.when(F.col("i") % 3 == 0, F.col("pt"))))
    got = {(r["drug"], r["pt"]): r for r in x.done().collect()}
    assert len(got) == len(rows)
    for drug in ("all", "b", None):
        mine = sorted((p, pt) for d, pt, p in rows if d == drug)
        up = 0.0
        for i, (p, pt) in enumerate(mine, 1):
            r = got[(drug, pt)]
            up += p
            same = [k for k, (q, _) in enumerate(mine, 1) if q == p]
            assert (r["i"], r["m"], r["lo"], r["hi"]) == (i, len(mine), same[0], same[-1])
            assert r["up"] == pytest.approx(up) and r["top"] == -mine[0][0]
            assert r["low"] == min(k % 50 for k in range(i, len(mine) + 1))
            assert r["mid"] == max((mine[k - 1][1] for k in same if k % 3 == 0), default=None)


@pytest.mark.parametrize("ties", [True, False])
def test_family_form_equals_the_window_form(spark, ties):
    ps = spark.createDataFrame([(d or "none", t, p) for d, t, p in some_ps(3, 900, ties)], "drug string, pt string, p_value double").persist()
    cols = ["drug", "pt", "m", "power", "pi0", "qvalue", "pi0_upper", "significant"]
    for a, b in zip(table(disproportionality.lbe(ps), *cols), table(disproportionality.lbe_family(ps, ranges=13), *cols), strict=True):
        assert a == pytest.approx(b)
    x = ps.withColumnRenamed("p_value", "p_null")
    cols = ["drug", "pt", "rk", "fdr", "fnr", "se", "sp"]
    for a, b in zip(table(disproportionality.posterior_errors(x), *cols), table(disproportionality.posterior_errors_family(x, ranges=9), *cols), strict=True):
        assert a == pytest.approx(b)


def test_power_in_the_plan_is_that_of_the_solver(spark):
    from vigilake.functions.special import lbe_power

    got = spark.createDataFrame([(m,) for m in (1, 400, 401, 1000, 20_000, 3_000_000)], "m long").select("m", F.expr(disproportionality.power_text("m")).alias("power")).collect()
    assert all(r["power"] == pytest.approx(lbe_power(r["m"])) for r in got)


def test_one_family_is_no_single_task(spark, facts):
    """Neither cells nor ranks meet in one partition, and the ratio table stands once in the plan of its null shares."""
    cells = disproportionality.ratio(contingency.all_pairs(facts), disproportionality.log_ror(), "ror").select(F.lit("every").alias("drug"), F.concat_ws("|", "drug", "pt").alias("pt"), "p_value")
    plans, keep = [], scan.Ranges._keep

    def kept(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return keep(self, rows)

    scan.Ranges._keep = kept
    try:
        disproportionality.lbe_family(cells)
    finally:
        scan.Ranges._keep = keep
    assert plans and not any("SinglePartition" in p for p in plans)
    plan = disproportionality.ror(contingency.all_pairs(facts))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count(1) AS a#") == 1 and "ArrowEvalPython" not in plan


# ---- names


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            row[k], last = (last + 1 if x == y else max(row[k], row[k - 1])), row[k]
    return 200.0 * row[-1] / (len(a) + len(b))


def plain_score(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 100.0
    one, two = (f"{both} {s}".strip() for s in (left, right))
    return max([plain_ratio(one, two)] + [plain_ratio(both, w) for w in (one, two) if both])


def slips(names, seed, most=4):
    rng = random.Random(seed)
    out = set()
    for name in names:
        for _ in range(3):
            x = list(name)
            for _ in range(rng.randint(0, most)):
                k, how = rng.randrange(len(x) + 1), rng.random()
                if how < 0.4 and x:
                    x.pop(min(k, len(x) - 1))
                elif how < 0.8:
                    x.insert(k, rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ "))
                else:
                    words = "".join(x).split()
                    rng.shuffle(words)
                    x = list(" ".join(words))
            out.add("".join(x))
    return sorted(out)


def test_no_pair_of_names_is_lost(spark, sf_dir):
    """Every name of the parts, and their slips: candidates hold all pairs that reach the cutoff, in under a twentieth of all."""
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select(F.upper("p_name")).distinct().collect()]
    other = ["IBUPROFEN", "CLOPIDOGREL", "FOLIC ACID", "VALPROIC ACID SODIUM", "SODIUM CHLORIDE", "A", "AB", "ABAB " + "X" * 70, "É À", "INSULIN LISPRO HUMAN RECOMBINANT", "  "]
    for pool in (names, names + other):
        asked = slips(pool, 5)
        got = table(resolve.candidates(spark.createDataFrame([(x,) for x in [*asked, None]], "query string"), spark.createDataFrame([(x,) for x in [*pool, None]], "drug_name string")))
        assert len(set(got)) == len(got) <= 0.05 * len(asked) * len(pool)
        assert {(a, b) for a, b in itertools.product(asked, pool) if plain_score(a, b) >= resolve.LEAST} <= set(got)


def test_scores_and_subsequences():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ABCD É") for _ in range(n))
    pairs = [(word(rng.randint(0, 90)), word(rng.randint(0, 90))) for _ in range(400)]
    a, b = zip(*pairs, strict=True)
    assert resolve.common_lengths(list(a), list(b)).tolist() == [round(plain_ratio(x, y) * (len(x) + len(y)) / 200) if x + y else 0 for x, y in pairs]
    assert resolve.token_set_ratios(list(a), list(b)).tolist() == pytest.approx([plain_score(x, y) for x, y in pairs])


def test_the_most_similar_name_wins(spark):
    pool, asked = ["IBUPROFEN", "KETOPROFEN", "PHENYTOIN", "FOLIC ACID", "ACID FOLIC X"], ["ybuprofen", "Fenytoin", "acid folic", "zzzz", "KETOPROFEN "]
    got = {r["query"]: (r["match"], r["score"]) for r in resolve.fuzzy(spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame([(x,) for x in pool], "drug_name string")).collect()}
    for q in asked:
        best = min((-plain_score(q.strip().upper(), n), n) for n in pool)
        assert got.get(q) == ((best[1], pytest.approx(-best[0])) if -best[0] >= resolve.LEAST else None)


# ---- bitmaps


def test_bitmaps_of_every_shape(spark, monkeypatch):
    """Lists and bitmaps meet each other; numbers run over several buckets."""
    monkeypatch.setattr(bitmaps, "FEW", 50)
    rng = np.random.default_rng(0)
    sets = {"rare": set(rng.choice(80_000, 40, replace=False)), "common": set(rng.choice(80_000, 9_000, replace=False)), "edge": {0, 32767, 32768, 32769, 65535, 65536, 79_999}, "low": set(range(200))}
    members = spark.createDataFrame([("drug" if v != "low" else "pt", v, int(k) + 1) for v, ks in sets.items() for k in ks], "field string, value string, number long")
    index = bitmaps.ReportIndex(bitmaps.containers(members).persist())
    assert index.buckets.where("bits IS NULL").count() and index.buckets.where("bits IS NOT NULL").count()
    assert dict(table(index.sizes("drug"))) == {v: len(k) for v, k in sets.items() if v != "low"}
    for v in sets:
        stratum = index.of_value("drug" if v != "low" else "pt", v, "s")
        assert dict(table(index.shared("drug", stratum, "s"))) == {w: len(k & sets[v]) for w, k in sets.items() if w != "low" and k & sets[v]}


def test_comedication_from_bitmaps(spark, facts):
    index = bitmaps.ReportIndex.of(facts)
    drugs = [r[0] for r in facts.groupBy("drug_name").count().orderBy(F.desc("count"), "drug_name").limit(2).collect()]
    for a, b in ((drugs[0], drugs[1]), (drugs[1], "NO SUCH DRUG")):
        scan_ = contingency.contingency(facts, a, f"drug_name = '{b}'", min_a=1)
        assert table(index.comedication(a, b, 1), "pt", "a", "b", "c", "d", "n") == table(scan_, "pt", "a", "b", "c", "d", "n")
    numbers = bitmaps.numbered(facts)
    n = numbers.count()
    assert numbers.agg(F.min("number"), F.max("number"), F.count_distinct("number")).head() == (1, n, n)


def test_bitmaps_of_packed_reports(spark, sf_dir, facts, monkeypatch):
    from vigilake.sources import adapter

    monkeypatch.setattr(bitmaps, "FEW", 70)
    index, plain = bitmaps.ReportIndex.of_reports(adapter.reports(spark, sf_dir).repartition(3)), bitmaps.ReportIndex.of(facts)
    assert index.buckets.where("bits IS NULL").count() and index.buckets.where("few IS NULL").count()
    for field in ("drug", "pt"):
        assert table(index.sizes(field)) == table(plain.sizes(field))
    a, b = (r[0] for r in facts.groupBy("drug_name").count().orderBy(F.desc("count"), "drug_name").limit(2).collect())
    assert table(index.comedication(a, b, 1)) == table(plain.comedication(a, b, 1)) and table(index.comedications(a)) == table(plain.comedications(a))


def test_bitmaps_of_odd_reports(spark):
    """Names without text, reports without names, ids that are null: in no bitmap. No report is dealt by its id."""
    rows = [("1", ["A", "", None], ["P", "Q"]), ("2", ["A", "B"], ["P", ""]), ("3", ["B"], []), ("4", [""], ["P"]), (None, ["A"], ["P"])]
    packed = spark.createDataFrame(rows, "safetyreportid string, names array<string>, reactions array<string>").withColumn("drugs", F.transform("names", lambda n: F.struct(n.alias("drug_name"))))
    index = bitmaps.ReportIndex.of_reports(packed)
    assert table(index.buckets.groupBy("field", "value").agg(F.sum("n"))) == [("drug", "A", 2), ("drug", "B", 1), ("pt", "P", 2), ("pt", "Q", 1)]
    plan = bitmaps.containers_of_reports(marts.told(packed))._jdf.queryExecution().executedPlan().toString()
    assert "safetyreportid" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


# ---- marts that follow


def rows_of(spark, reports_):
    """reports_: (id, date, sex, drugs, terms)."""
    blank = {f: None for f in schema.FACT.fieldNames()}
    out = [blank | {"safetyreportid": i, "receivedate": d, "sex": s, "age_stratum": "adult", "drug_name": x, "reaction_pt": t} for i, d, s, xs, ts in reports_ for x in xs for t in ts]
    return spark.createDataFrame([tuple(r[f] for f in schema.FACT.fieldNames()) for r in out], schema.FACT)


def test_marts_follow_replaced_reports(spark, tmp_path):
    from vigilake.streaming.marts import COUNTS, LiveMarts
    from vigilake.streaming.reports import LatestVersions

    live = LiveMarts(spark, f"{tmp_path}/marts", LatestVersions(spark, f"{tmp_path}/reports", buckets=4), fold_at=2)
    merges = [
        [("1", "2020-01-01", "male", ["A", "B"], ["X"]), ("2", "2020-01-01", "female", ["A"], ["X", "Y"]), (None, "2020-01-01", "male", ["A"], ["X"])],
        [("1", "2020-02-01", "female", ["B"], ["Y", ""]), ("3", "2020-01-01", "male", ["A"], ["X"])],
        [("2", "2019-01-01", "male", ["C"], ["Z"]), ("3", "2020-01-01", "male", ["A"], ["X"])],  # late, and once more
        [("3", "2021-01-01", "male", ["C"], ["Z"])],
    ]
    for k, batch in enumerate(merges):
        live.merge(rows_of(spark, batch), k)
        now = live.reports.current()
        want = marts.Marts.of(now)
        got = live.marts()
        assert table(got.global_, "pt", "n_pt", "n_total") == table(want.global_, "pt", "n_pt", "n_total")
        cube = ["sex", "age_stratum", "reaction_pt", "n_pt_stratum", "n_stratum", "n_pairs_stratum"]
        assert table(got.cubed, *cube) == table(want.cubed, *cube)
        assert table(got.bridge, "drug_name", "safetyreportid") == table(want.bridge, "drug_name", "safetyreportid")
        assert table(live.all_pairs(1)) == table(contingency.all_pairs(now, 1))
        for name in COUNTS:  # a retried batch changes nothing
            assert len(live._deltas(name)) <= 3
        before = {name: table(live.read(name)) for name in COUNTS}
        live.merge(rows_of(spark, batch), k)
        assert {name: table(live.read(name)) for name in COUNTS} == before
    # only what changed is written
    last = spark.read.parquet(live._deltas("pt")[-1])
    assert dict(table(last)) == {"X": -1, "Z": 1}


def test_a_merge_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    from vigilake.streaming.marts import LiveMarts
    from vigilake.streaming.reports import LatestVersions

    live = LiveMarts(spark, f"{tmp_path}/marts", LatestVersions(spark, f"{tmp_path}/reports", buckets=2))
    live.merge(rows_of(spark, [("1", "2020-01-01", "male", ["A"], ["X"])]), 0)
    batch = rows_of(spark, [("1", "2020-02-01", "male", ["A"], ["Y"])])
    with monkeypatch.context() as m:
        m.setattr(live.reports, "merge", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            live.merge(batch, 1)
    live.merge(batch, 1)
    assert table(live.read("pt")) == [("Y", 1)]


# ---- periods, lookups, files, layout


@pytest.mark.parametrize("unit", ["quarter", "year"])
def test_tables_over_time(spark, facts, unit):
    cut = facts.where(F.month("receivedate") != 5).where("NOT (drug_name = 'RED ROD' AND receive_year BETWEEN 1994 AND 1996)").persist()
    got = timeline.pairs_over_time(cut, unit, min_a=2).persist()
    ends = sorted({r[0] for r in got.select("slice_end").distinct().collect()})
    for end in (ends[0], ends[len(ends) // 2], ends[-1]):
        want = contingency.all_pairs(cut.where(F.col("receivedate") <= str(end)), 2)
        assert table(got.where(F.col("slice_end") == F.lit(end)).drop("slice_end"), "drug", "pt", "a", "b", "c", "d", "n") == table(want, "drug", "pt", "a", "b", "c", "d", "n")


def test_lookups_remember_hits_and_misses(spark, tmp_path):
    asked = []

    def fetch(keys):
        asked.append(sorted(r["key"] for r in keys.collect()))
        return keys.where("key != 'none'").withColumn("payload", F.concat(F.lit("p"), "key"))

    wanted = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    x = lookups.LookupTable(spark, str(tmp_path / "l"), fetch)
    assert {r["key"]: r["payload"] for r in x.answers(wanted("a", "none", "a", None)).collect()} == {"a": "pa", "none": None, None: None}
    assert x.ask(wanted("a", "none")) == 0 and x.ask(wanted("a", "b")) == 1 and x.ask(wanted("none"), again=True) == 1
    assert asked == [["a", "none"], ["b"], ["none"]]
    os.makedirs(tmp_path / "l" / "v000009-broken")  # a round that was never finished is not seen
    assert sorted(map(tuple, x.current().collect())) == [("a", "pa", True), ("b", "pb", True), ("none", None, False)]


def test_files_are_cut_at_records(spark, tmp_path):
    tricky = ['plain', 'a "quoted" {\\"safetyreportid\\": 1', "brackets ]} , [", "é\n\t"]
    records = [{"safetyreportid": str(k), "receivedate": "20200101", "patient": {"drug": [{"medicinalproduct": tricky[k % 4]}], "reaction": [{"reactionmeddrapt": "Pain" * (k % 50)}]}} for k in range(3000)]
    os.makedirs(tmp_path / "raw")
    for k, part in enumerate((records[:2500], records[2500:], [])):
        (tmp_path / "raw" / f"{k}.json").write_text('{"meta": {"a": [1, 2]}, "results": [' + ",\n ".join(json.dumps(r, separators=(",", ":"), ensure_ascii=False) for r in part) + "]\n}\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        got = reports.read_files_cut(spark, str(tmp_path / "raw"))
        assert got.rdd.getNumPartitions() > 8  # several tasks a file
        whole = reports.read_files(spark, str(tmp_path / "raw"))
        assert table(got.select("safetyreportid", "receivedate", "patient.drug", "patient.reaction")) == table(whole.select("safetyreportid", "receivedate", "patient.drug", "patient.reaction"))
        assert got.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    (tmp_path / "other.json").write_text('{"results": [{"receivedate": "1", "safetyreportid": "2"}]}')
    with pytest.raises(Exception, match="no record that begins"):
        reports.read_files_cut(spark, str(tmp_path / "other.json")).collect()


def test_a_hot_drug_is_cut_by_report(spark, facts, tmp_path):
    one = facts.withColumn("drug_name", F.lit("HOT")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table is not worth several files
    try:
        reports.write_sorted(one, str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "hot"))
    sizes = [r["count"] for r in back.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes) and sum(sizes) == one.count()


# ---- labels


def test_terms_by_index_are_those_of_patterns(spark):
    from vigilake.operators import label_index, labels

    texts = [("a", "warnings", "peripheral oedema, then edema. stevens-johnson (sjs) and stevens johnson; rash_1 rash no. pain"), ("a", "precautions", "diarrhea\ndiarrhoea  pain pain"), ("b", "warnings", "é pain ∆ q.t. prolonged"), ("b", "empty", "")]
    terms = [(d, t) for d in ("a", "b", "c") for t in ("Pain", "rash", "RASH_1", "oedema", "Peripheral Oedema", "stevens-johnson", "stevens johnson", "(SJS)", "q.t.", ".pain", "diarrhoea", "pain pain", "∆", "é", "no. pain", "", "edema. stevens")]
    x, y = spark.createDataFrame(texts, "drug_name string, section string, text string"), spark.createDataFrame(terms, "drug_name string, pt string")
    want = table(labels.matches(y.where("pt <> ''"), x), "drug_name", "pt", "section", "matched_term", "snippet")
    assert table(label_index.matches_indexed(y.where("pt <> ''"), x), "drug_name", "pt", "section", "matched_term", "snippet") == want and len(want) > 12
    plan = label_index.matches_indexed(y, x)._jdf.queryExecution().optimizedPlan().toString()
    assert "(drug_name" in plan


def test_terms_over_labels_are_those_of_whole_sections(spark):
    from vigilake.operators import label_index, labels

    texts = ["Peripheral", "oedema, then edema. stevens-johnson (SJS", ") and", "", "", "stevens", "johnson; rash_1 rash no", "pain", "x .", "pain ∆", "Δ (", "é)", "q.t.", "prolonged " * 9, "pain a", None, "b", "c"]
    parts = [("a", k, "warnings", t) for k, t in enumerate(texts)] + [("a", k, "other", t) for k, t in enumerate(texts[::-1])] + [("b", 1, "none", ""), (None, 1, "none", "pain")]
    terms = [(d, t) for d in ("a", "b", "c") for t in ("Pain", "rash", "RASH_1", "oedema", "Peripheral Oedema", "stevens-johnson", "stevens johnson", "(SJS)", "(SJS ) and", "and   stevens", "q.t.", ".pain", ". pain", "∆", "∆ δ", "δ ( é", "no pain x", "pain a b c", "b c", "a b c b", "prolonged q.t. é", "ain", "- johnson", "( é)", "+")]
    x, y = spark.createDataFrame(parts, "drug_name string, label int, section string, text string").repartition(5), spark.createDataFrame(terms, "drug_name string, pt string")
    want = table(labels.matches(y, labels.sections(x)), "drug_name", "pt", "section", "matched_term")
    got = label_index.matches_in_labels(y, x)
    assert table(got, "drug_name", "pt", "section", "matched_term") == want and len(want) > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(label" not in plan  # no section is one row


def test_first_records_of_a_product(spark):
    from vigilake.operators import labels

    rows = spark.createDataFrame([("a", k, f"t{k}") for k in range(9)] + [("a", 1, "again"), ("b", 7, "x")], "drug_name string, label int, text string")
    assert table(labels.first_records(rows, 2)) == [("a", 0, "t0"), ("a", 1, "again"), ("a", 1, "t1"), ("b", 7, "x")]


def test_subsets_do_not_change_with_unrelated_rows(spark):
    from vigilake.operators import counts

    rows = [(k, ["b", "a", ""], None) for k in range(3)] + [(9, ["a"], "E")]
    long = [(99, [f"i{k:02d}" for k in range(13)], "E")]
    want = [("a", None, 3), ("a|b", None, 3), ("b", None, 3)]
    for extra in ([], long):
        got = counts.convert_multi_item(spark.createDataFrame(rows + extra, "id long, items array<string>, AE string"))
        assert sorted(map(tuple, got.collect())) == want


def test_models_together_are_the_models_apart(spark, facts):
    cells = contingency.all_pairs(facts).where("drug < 'C'").persist()
    wide = disproportionality.every_model(cells)
    for name in ("prr", "ror", "bcpnn", "mgps"):
        apart = getattr(disproportionality, name)(cells)
        for a, b in zip(table(wide.select(f"model_{name}.*"), *apart.columns), table(apart), strict=True):
            assert a == pytest.approx(b, nan_ok=True)


# ---- layout and kept answers


def test_buckets_need_no_exchange_by_report(spark, facts, tmp_path):
    from vigilake.sources import layout

    table_ = layout.write_buckets(facts, "facts_by_report", str(tmp_path / "b"), buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a small side would be broadcast: no exchange to save
    try:
        drug = facts.groupBy("drug_name").count().orderBy(F.desc("count"), "drug_name").first()[0]
        plain, cut = (contingency.by_report(x, drug, "drug_characterization = '1'", min_a=1) for x in (facts, table_))
        assert layout.exchanges(cut) == 0 < layout.exchanges(plain)
        assert table(cut) == table(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE facts_by_report")


def test_a_question_asked_again_reads_what_was_found(spark, facts, tmp_path, monkeypatch):
    from vigilake.plans import analysis

    kept = analysis.Kept(spark, str(tmp_path / "kept"), "facts of today")
    config = analysis.AnalysisConfig(facts.groupBy("drug_name").count().orderBy(F.desc("count"), "drug_name").first()[0], algorithms=("ror", "bcpnn"))
    first = analysis.analyse(facts, config, kept=kept)
    want = table(first.ranked.select("pt", "confidence_score"))
    assert first.notes["cells_s"] > 0 and want == table(analysis.analyse(facts, config).ranked.select("pt", "confidence_score"))
    monkeypatch.setattr(analysis.C, "contingency", lambda *_: pytest.fail("computed again"))
    assert table(analysis.analyse(facts, config, kept=kept).ranked.select("pt", "confidence_score")) == want
    with pytest.raises(BaseException, match="computed again"):
        analysis.analyse(facts, config, kept=analysis.Kept(spark, str(tmp_path / "kept"), "other facts"))


def test_footers_tell_rows_and_bounds(spark, facts, tmp_path):
    from vigilake.sources import layout

    reports.write_sorted(facts, str(tmp_path / "f"))
    got = layout.footer_summary(spark, str(tmp_path / "f"), "receive_year", "age_years")
    assert tuple(got.head()) == tuple(facts.agg(F.count("*"), F.min("receive_year"), F.max("receive_year"), F.min("age_years"), F.max("age_years")).head())
    plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedAggregation: [COUNT(*), MIN(receive_year)" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    with pytest.raises(ValueError):
        layout.footer_summary(spark, str(tmp_path / "f"), "drug_name")


def test_report_files_by_listing(spark, tmp_path):
    for name in ("a.json", "q1/b.json", "q1/c.json", "q1/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    names = lambda: [p.rpartition(str(tmp_path))[2] for p in reports.report_paths(spark, f"file://{tmp_path}")]
    assert names() == ["/a.json", "/q1/b.json", "/q1/c.json"]
    (tmp_path / "downloaded.txt").write_text("q1/c.json\n\nq1/gone.json\na.json\n")
    assert names() == ["/a.json", "/q1/c.json"]


# ---- packed reports


def test_packed_reports_give_what_crossed_facts_give(spark, sf_dir, tmp_path):
    from vigilake.operators import contingency, marts, timeline
    from vigilake.sources import adapter, reports

    odd = [("1", "2001-02-03", ["A", "", None], ["P", "Q"]), ("2", "2001-05-03", ["A", "B"], ["P", "", None]), ("3", None, ["B"], ["Q"]), ("4", "2002-01-01", [""], ["P"]), ("5", "2002-01-01", ["A"], []), (None, "2002-01-01", ["A"], ["P"])]
    whole = adapter.reports(spark, sf_dir).persist()
    base = whole.limit(1).drop("safetyreportid", "receivedate")
    names = spark.createDataFrame(odd, "safetyreportid string, receivedate string, names array<string>, pts array<string>")
    told = names.crossJoin(base).withColumn("drugs", F.transform("names", lambda n: F.col("drugs")[0].withField("drug_name", n))).withColumn("reactions", F.col("pts")).select(whole.columns)
    for packed in (whole, told):
        flat = adapter.crossed(packed).persist()
        assert table(contingency.cells(contingency.pair_counts(packed), 1)) == table(contingency.all_pairs(flat, 1))
        a, b = marts.Marts.of_reports(packed), marts.Marts.of(flat)
        for x, y in ((a.global_, b.global_), (a.cubed, b.cubed), (a.bridge, b.bridge)):
            assert table(x, *sorted(x.columns)) == table(y, *sorted(x.columns))
        assert table(timeline.reports_over_time(packed, min_a=1)) == table(timeline.pairs_over_time(flat, min_a=1))
        reports.write_crossed(adapter.by_drug(packed), str(tmp_path / "w"))
        back = spark.read.schema(flat.schema).parquet(str(tmp_path / "w"))
        assert back.exceptAll(flat).isEmpty() and flat.exceptAll(back).isEmpty()


def test_triplets_of_packed_reports_are_not_shuffled(spark, sf_dir):
    from vigilake.operators import contingency
    from vigilake.sources import adapter

    counts = contingency.pair_counts(adapter.reports(spark, sf_dir).persist())
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "safetyreportid" in line for line in plan.splitlines())


def test_lines_are_packed_as_they_lie(spark, sf_dir, monkeypatch):
    """Orders are whole wherever batches are cut, nulls are as in the SQL, and no grouping of lists stands in the plan."""
    import pyarrow as pa

    from vigilake.sources import adapter

    plan = adapter.reports(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    # order, drug, reaction, use, said
    lines = [(1, "A", "P", "u", 1), (1, "A", "Q", "t", 2), (1, None, "P", None, 4), (2, "B", "P", None, 8), (2, "B", "P", None, 16), (3, "A", "Q", "u", 0), (3, "B", "Q", None, 0), (3, "A", "P", None, 31)]
    whole = pa.table([pa.array(c) for c in zip(*[(o, d, r, u, s, "2001-01-01", "1", "X", "Y", float(o)) for o, d, r, u, s in lines])], names=["l_orderkey", "drug_name", "reaction_pt", "p_type", "said", *adapter.OF_ORDER])
    want = {
        1: ([(None, None, "0", "1", "0", "0", "2"), ("A", "t", "1", "0", "0", "0", "1")], ["P", "Q"]), 2: ([("B", None, "0", "0", "1", "1", "2")], ["P"]),
        3: ([("A", "u", "1", "1", "1", "1", "1"), ("B", None, "0", "0", "0", "0", "2")], ["P", "Q"]),
    }
    cols = ["drug_name", "drug_indication", "outcome_death", "outcome_lifethreat", "outcome_hosp", "outcome_disab", "drug_characterization"]
    for at_once in (1, 3, 100):
        monkeypatch.setattr(adapter, "AT_ONCE", at_once)
        for size in (1, 2, 5, 8):
            got = [r for b in adapter.packed(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
            assert len(got) == 3
            assert {r["l_orderkey"]: (sorted((tuple(d[c] for c in cols) for d in r["drugs"]), key=str), sorted(r["reactions"])) for r in got} == {k: (sorted(d, key=str), r) for k, (d, r) in want.items()}
            assert all(r["age_years"] == float(r["l_orderkey"]) for r in got)
    assert list(adapter.packed(iter(whole.slice(0, 0).to_batches()))) == []


def test_orders_stay_whole_where_joins_are_dealt_anew(spark, sf_dir):
    """Joins that split large partitions leave an order's lines in one task."""
    from vigilake.sources import adapter

    put = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    plain = adapter.reports(spark, sf_dir).count()
    was = {k: spark.conf.get(k, None) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        got = adapter.reports(spark, sf_dir).select("safetyreportid").collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == len(set(got)) == plain


def test_crosses_are_counted_in_one_reading(spark, monkeypatch):
    import pyarrow as pa

    from vigilake.operators import contingency, crossing, timeline

    rng = random.Random(4)
    rows = [(rng.choice(["x", None, "y"]), rng.choice([1, 2, None]), rng.sample("ABCDE", rng.randrange(6)), rng.sample("PQRS", rng.randrange(5))) for _ in range(200)]
    want = {}
    for g, h, ds, ps in rows:
        for key in itertools.product([g], [h], [*ds, None], [*ps, None]):
            want[key] = want.get(key, 0) + 1
    whole = pa.table([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["g", "h", "drugs", "pts"])
    for reports_, rows_ in ((1, 1), (7, 9), (1000, 4_000_000)):
        monkeypatch.setattr(crossing, "REPORTS", reports_)
        monkeypatch.setattr(crossing, "ROWS", rows_)
        got = {}
        for batch in crossing.counted(iter(whole.to_batches(max_chunksize=30))):
            for r in batch.to_pylist():
                key = (r["g"], r["h"], r["drug"], r["pt"])
                got[key] = got.get(key, 0) + r["k"]
        assert got == want
    packed = spark.createDataFrame([("1", "2001-01-01", [("A",), ("B",)], ["P"])], "safetyreportid string, receivedate string, drugs array<struct<drug_name: string>>, reactions array<string>")
    for x in (contingency.pair_counts(packed), timeline.reports_over_time(packed, min_a=1)):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "explode(pts" not in plan and "explode(drugs" not in plan and x.count() == 2


def test_questions_write_their_own_marts_only(spark, sf_dir, tmp_path, monkeypatch):
    from vigilake.operators import contingency
    from vigilake.sources import store

    monkeypatch.setattr(store, "root", lambda *_: f"file://{tmp_path}")
    facts, made = store.fact(spark, sf_dir), lambda: sorted(p.name for p in (tmp_path / "marts").iterdir())
    asked = {None: ["marginals_global"], "sex = 'male'": ["marginals_cubed", "marginals_global"], "drug_name = 'BLUE ANVIL'": ["bridge", "marginals_cubed", "marginals_global"]}
    for where, names in asked.items():
        got = contingency.contingency(facts, "SMALL RING", where, store.marts(spark, sf_dir), 1)
        assert table(got, *sorted(got.columns)) == table(contingency.contingency(facts, "SMALL RING", where, None, 1), *sorted(got.columns))
        assert made() == names


def test_raw_reports_are_made_once(spark, sf_dir):
    """Conditions on parsed lists do not make the texts anew within a join."""
    from vigilake.plans import registry

    plan = registry.queries()["q_json_flatten"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in plan and "Join" not in plan


def test_live_marts_follow_packed_reports(spark, sf_dir, tmp_path):
    from vigilake.operators import contingency
    from vigilake.sources import adapter, schema
    from vigilake.streaming.marts import LiveMarts
    from vigilake.streaming.reports import LatestVersions

    whole = adapter.reports(spark, sf_dir).limit(60).persist()
    early = whole.limit(20).withColumns({"receivedate": F.lit("1990-01-01"), "sex": F.lit("unknown"), "reactions": F.array(F.lit("EARLY"))})
    live = LiveMarts(spark, f"{tmp_path}/marts", LatestVersions(spark, f"{tmp_path}/reports", buckets=2, rows=schema.PACKED))
    live.merge(early, 0)
    live.merge(whole, 1)
    assert table(live.read("pair")) == table(contingency.pair_counts(whole), "drug", "pt", "a")


def test_merges_hold_no_rows_in_memory_and_deal_them_once(spark, sf_dir, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from vigilake.sources import adapter, schema
    from vigilake.streaming.marts import LiveMarts
    from vigilake.streaming.reports import LatestVersions, newest

    def held(*_, **__):
        raise AssertionError("rows are held in memory")

    monkeypatch.setattr(DataFrame, "persist", held)
    monkeypatch.setattr(DataFrame, "cache", held)
    whole = adapter.reports(spark, sf_dir).limit(40)
    live = LiveMarts(spark, f"{tmp_path}/marts", LatestVersions(spark, f"{tmp_path}/reports", buckets=2, rows=schema.PACKED))
    for k in range(2):
        live.merge(whole, k)
    rows = live.reports.placed(live.reports.current())
    plan = newest(rows, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_newest_rows_are_the_latest_versions(spark, tmp_path):
    from vigilake.operators.dedup import latest_versions
    from vigilake.streaming.reports import LatestVersions, newest

    facts = rows_of(spark, [
        ("1", "2020-01-01", "male", ["A", "A"], ["X"]), ("1", "2020-01-01", "male", ["A", "B"], ["X", None]), ("1", None, "male", ["C"], ["X"]), ("1", "2019-01-01", "male", ["D"], ["X"]),
        ("2", None, "male", ["A"], ["X"]), (None, "2020-01-01", "male", ["A", "A"], ["X"]), (None, "2021-01-01", "male", ["A"], ["X"]), (None, None, "male", ["A"], ["X"]), ("", "2020-01-01", None, ["A"], ["X"]),
    ])
    facts = facts.withColumn("age_years", F.expr("CASE WHEN drug_name = 'B' THEN 0.0D WHEN drug_name = 'A' THEN double('NaN') END"))
    facts = facts.unionByName(facts.where("drug_name = 'B'").withColumn("age_years", F.lit(-0.0)))  # equal to 0.0
    got = newest(LatestVersions(spark, str(tmp_path), buckets=2).placed(facts), 3).drop("bucket").select(facts.columns)
    text = lambda df: sorted(map(str, df.collect()))
    assert [t.replace("-0.0", "0.0") for t in text(got)] == [t.replace("-0.0", "0.0") for t in text(latest_versions(facts, distinct=True))]


def test_changes_of_counts_equal_their_plain_form(monkeypatch):
    """Whatever the ends of batches, chunks and blocks cut; nulls, empty texts, repeats, several rows at a date."""
    import pyarrow as pa

    from vigilake.streaming import deltas
    from vigilake.streaming.marts import COUNTS

    rng = random.Random(5)
    some = lambda xs: None if rng.random() < 0.1 else [rng.choice(xs) for _ in range(rng.randrange(4))]
    names = ["safetyreportid", "old", "date", "sex", "age_stratum", "drug_name", "reaction_pt"]
    rows = [
        (str(k), rng.random() < 0.5, rng.choice(["2020-01-01", "2020-02-01", None]), rng.choice(["male", "female", None]), "adult", some(["A", "B", "C", "", None]), some(["X", "Y", "", None]))
        for k in range(60) for _ in range(rng.choice([1, 1, 2, 5]))
    ]
    types = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    whole = pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
    want = {}
    for k, own in itertools.groupby(rows, lambda r: r[0]):
        own = list(own)
        if all(r[1] for r in own):
            continue
        last = max((r[2] for r in own if r[2]), default=None)
        for name, count in COUNTS.items():
            def keys(r):
                lists = {c: [x for x in r[at] or [] if x or c not in count.solid] for c, at in (("drug_name", 5), ("reaction_pt", 6))}
                one = {"safetyreportid": [k], "sex": [r[3]], "age_stratum": [r[4]], **lists}
                return set(itertools.product(*[one[c] for c in count.keys])) if all(lists.values()) else set()

            was, now = (set().union(*[keys(r) for r in own if which(r)]) for which in (lambda r: r[1], lambda r: r[2] and r[2] == last))
            for key, n in [(x, 1) for x in now - was] + [(x, -1) for x in was - now]:
                want[name, key] = want.get((name, key), 0) + n
    monkeypatch.setattr(deltas, "AT_ONCE", 7)
    monkeypatch.setattr(deltas, "CROSSES", 3)
    got = {}
    for batch in deltas.counted(COUNTS, iter(whole.to_batches(max_chunksize=5))):
        for r in batch.to_pylist():
            keys = [(tuple(r[c] for c in COUNTS[r["mart"]].keys), r["n"])] if r["safetyreportid"] is None else [((d, r["safetyreportid"]), n) for c, n in (("gained", 1), ("lost", -1)) for d in r[c]]
            for key, n in keys:
                got[r["mart"], key] = got.get((r["mart"], key), 0) + n
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n} and len({name for name, _ in want}) == len(COUNTS)


def test_a_wide_report_crosses_in_blocks(monkeypatch):
    """A report of 900 drugs and 900 terms is never one list of 810,000 pairs."""
    import pyarrow as pa

    from vigilake.streaming import deltas
    from vigilake.streaming.marts import COUNTS

    monkeypatch.setattr(deltas, "CROSSES", 20_000)
    lists = [pa.array([[f"{c}{k}" for k in range(900)]] * 2) for c in "dp"]
    rows = pa.table([pa.array(["1", "1"]), pa.array([True, False]), pa.array(["2020-01-01", "2020-01-02"]), pa.array(["male"] * 2), pa.array(["adult"] * 2), *lists], names=["safetyreportid", "old", "date", "sex", "age_stratum", "drug_name", "reaction_pt"])
    sizes = [len(face) for face, _ in deltas.Faces(rows).named(COUNTS["pair"])]
    assert sum(sizes) == 2 * 900 * 900 and max(sizes) <= 20_000
    assert sum(b.num_rows for b in deltas.counted(COUNTS, iter(rows.to_batches()))) == 0  # the same on both sides
