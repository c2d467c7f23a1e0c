"""Names, roll-ups, ranks and streams on small cases."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from riskledger.functions import names as N
from riskledger.functions import scores as S
from riskledger.operators import documented as D
from riskledger.operators import evaluate as E
from riskledger.operators import features as X
from riskledger.operators import models as M
from riskledger.operators import ranking as K
from riskledger.operators import records as R
from riskledger.operators import rollup as U
from riskledger.operators import search as Q
from riskledger.plans import catalog, learned
from riskledger.sources import bronze as B
from riskledger.streaming.incremental import latest

#: Own names, odd ones among them: raw, canonical name, match key.
NAMES = [
    ("Blue Heron Boats, Inc.", "BLUE HERON BOATS", "BLUE HERON BOATS"),
    ("The Quiet Mill Co., Ltd", "QUIET MILL", "QUIET MILL"),
    ("Ålesund Café & Søn Corp", "ALESUND CAFE AND SØN", "ALESUND CAFE AND SØN"),
    ("77310B - Fern Hollow LLC", "FERN HOLLOW", "FERN HOLLOW"),
    ("9A - Fern Hollow", "9A - FERN HOLLOW", "9A - FERN HOLLOW"),
    ("Pike MFG SVCS", "PIKE MFG SVCS", "PIKE MANUFACTURING SERVICES"),
    ("Pike/Perch Natl Equip", "PIKE PERCH NATL EQUIP", "PIKE PERCH NATIONAL EQUIPMENT"),
    ("Otter DBA Otter's Best Plant 4", "OTTER", "OTTER"),
    ("Otter Plant 4", "OTTER PLANT 4", "OTTER"),
    ("Otter Store #12 - Whse Yard 3 - Plant 2, 12345 #7 #8 #9 Unit 6 Bldg 5", "OTTER STORE #12 - WHSE YARD 3 - PLANT 2, 12345 #7 #8 #9 UNIT 6 BLDG 5", "OTTER STORE #12 - WHSE"),
    ("Otter Store 1 #2 Store 3 #4 Store 5 #6 Store 7", "OTTER STORE 1 #2 STORE 3 #4 STORE 5 #6 STORE 7", "OTTER"),
    ("Wren Holdings Group International Corp Inc LLC", "WREN HOLDINGS", "WREN HOLDINGS"),
    ("Wren's Nest, The", "WRENS NEST", "WRENS NEST"),
    ("  ", "", ""),
    ("3M", "3M", "3M"),
]


def test_names(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(NAMES)], "i int, raw string").select("i", N.canonical_name(F.col("raw")).alias("c"), N.match_key(F.col("raw")).alias("k")).orderBy("i").collect()
    assert [(NAMES[r.i][0], r.c, r.k) for r in rows] == [tuple(n) for n in NAMES]


def test_noise_goes_whatever_its_length(spark):
    """A further pass changes nothing, however many units a tail has."""
    long = "Otter " + " ".join(f"Store {i} #{i}" for i in range(40))
    raw = spark.createDataFrame([(r,) for r in [long, *[n for n, _, _ in NAMES if "Group" not in n]]], "raw string")
    once = N.without_noise(N.preclean(F.col("raw")), facility=True)
    assert raw.filter(N.without_noise(once, facility=True) != once).count() == 0 and raw.limit(1).select(N.match_key(F.col("raw")).alias("k")).first().k == "OTTER"


def test_display_names(spark):
    cases = [("105B91 - heron co, inc", "HERON"), ("3M - St Paul", "3M - ST PAUL"), ("ABCDE - Heron", "ABCDE - HERON"), ("the heron & sons ltd.", "HERON AND SONS"), ("Heron dba Boats", "HERON"), ("Heron co co co co", "HERON CO")]
    prefixes = [("Heron - CMH1", "HERON"), ("Heron (AB12)", "HERON"), ("Heron Site 4", "HERON"), ("T12", "T12"), ("Heron Campus -", "HERON")]
    rows = spark.createDataFrame(cases, "raw string, out string")
    assert [r.raw for r in rows.filter(N.display_name(F.col("raw")) != F.col("out")).collect()] == []
    assert [r.raw for r in spark.createDataFrame(prefixes, "raw string, out string").filter(N.parent_prefix(F.col("raw")) != F.col("out")).collect()] == []


def test_search_finds_misspelt_first_letters(spark, monkeypatch):
    names = spark.createDataFrame([(n,) for n in ("KROGER", "CROWN", "Heron Boats", "Boats by Heron", "ZZ")], "raw_name string")
    asked = spark.createDataFrame([("CROGER",), ("heron boat",), ("",)], "query string")
    for block in (1, 1000):
        monkeypatch.setattr(Q, "QUERIES", block)
        got = {(r["query"], r.company_key) for r in Q.fuzzy_candidates(asked, Q.key_index(names)).collect()}
        assert ("CROGER", "KROGER") in got and ("heron boat", "HERON BOATS") in got and ("heron boat", "BOATS BY HERON") in got and not any(k == "ZZ" for _, k in got)


def test_facility_codes(spark):
    rows = spark.createDataFrame([("Amazon (CMH1)", "CMH1"), ("Amazon - FWA4", "FWA4"), ("Walmart Store #2341", None)], "raw string, code string")
    assert rows.filter(~N.facility_code(F.col("raw")).eqNullSafe(F.col("code"))).count() == 0


def site(spark, rows):
    return spark.createDataFrame(rows, "company string, score double, n_inspections long, willful long, repeat long")


def test_rollup(spark):
    got = {r.company: r for r in U.company_rollup(site(spark, [("a", 80.0, 5, 0, 0), ("a", 20.0, 1, 0, 0), ("b", 70.0, 5, 0, 0), ("b", 70.0, 5, 0, 0), ("c", 70.0, 1, 0, 0), ("c", 20.0, 1, 0, 0), ("c", 20.0, 1, 0, 0), ("d", 50.0, 2, 1, 0), ("d", 50.0, 2, 0, 1)]), ["company"]).collect()}
    assert got["a"].weighted_score == pytest.approx(70) and got["b"].systemic and got["b"].recommendation == "Do Not Recommend" and not got["c"].systemic and got["d"].systemic and got["d"].recommendation == "Proceed with Caution"


def test_features_of_two_inspections(spark):
    day = datetime.date(2020, 1, 1)
    i = spark.createDataFrame([("1", None, "1234", day, "H"), ("2", None, "1234", day, "H")], "activity_nr string, estab_name string, naics_code string, open_date date, insp_type string")
    v = spark.createDataFrame([("1", "", "S", 1000.0, None, 4.0), ("1", "", "O", None, 500.0, None), ("2", "X", "S", 9.0, None, None)], "activity_nr string, delete_flag string, viol_type string, current_penalty double, initial_penalty double, gravity double")
    inj = spark.createDataFrame([("2", "9", "1.0"), ("2", "9", "3")], "rel_insp_nr string, summary_nr string, degree_of_inj string")
    acc = spark.createDataFrame([("9", "")], "summary_nr string, fatality string")
    f = X.establishment_features(X.inspection_facts(i, v, inj, acc), day).first()
    assert (f.estab, f.n_inspections, f.n_violations, f.serious_rate, f.violations_per_inspection, f.clean_ratio, f.total_penalty, f.avg_gravity, f.accidents, f.fatalities, f.injuries) == ("UNKNOWN", 2, 2, 0.5, 1.0, 0.5, 1500.0, 4.0, 1, 1, 2)


def test_ranks_of_many_rows(spark):
    """Exactly 1 to n in order, with ties, nulls and payload columns, over many ranges; running sums and percentiles with them."""
    n = 200_000
    df = spark.range(n).selectExpr("id as estab", "if(id % 1000 = 0, null, cast(pmod(xxhash64(id), 5000) as double)) as score", "concat('payload ', id) as text", "id % 3 as v").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = K.running_totals(df, ["score", "estab"], {"sum_v": "v"}).select("rank", "score", "estab", "v", "sum_v", "text").toPandas().sort_values("rank")
        down = K.global_rank(df, [F.col("score").desc(), "estab"]).select("rank", "score", "estab").toPandas().sort_values("rank")
        shares = K.percentiles(df.withColumn("g", F.col("estab") % 2), ["g"], "score", {"p10": 0.1, "p50": 0.5}).toPandas().set_index("g")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows["rank"].tolist() == list(range(1, n + 1)) == down["rank"].tolist()
    assert rows[["score", "estab"]].values.tolist() == rows.sort_values(["score", "estab"], na_position="first")[["score", "estab"]].values.tolist() or rows["score"].isna().sum() == 200
    kept = rows[rows["score"].notna()]
    assert (kept.sort_values(["score", "estab"])["rank"].diff().dropna() == 1).all() and rows["score"].isna()[:200].all() and down["score"].dropna().is_monotonic_decreasing
    assert (rows["v"].cumsum() == rows["sum_v"]).all() and (rows["text"] == "payload " + rows["estab"].astype(str)).all()
    for g, part in kept.groupby(kept["estab"] % 2):
        assert shares.loc[g, "n"] == len(part) and shares.loc[g, "p50"] == pytest.approx(part["score"].quantile(0.5)) and shares.loc[g, "p10"] == pytest.approx(part["score"].quantile(0.1))


def test_ranks_inside_groups(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], float(i * 7 % 11)) for i in range(60)], "estab int, g string, score double")
    pdf = df.toPandas()
    got = K.average_ranks(df, "score", "r", ["g"]).toPandas().set_index("estab")["r"]
    assert got.sort_index().tolist() == pdf.groupby("g")["score"].rank().tolist()
    place = K.grouped_rank(df, ["g"], [F.col("score").desc(), "estab"]).toPandas().set_index("estab")["rank"].sort_index()
    assert place.tolist() == pdf.sort_values(["score", "estab"], ascending=[False, True]).groupby("g").cumcount().add(1).sort_index().tolist()
    empty = df.limit(0)
    assert K.global_rank(empty, ["score"]).count() == 0 and K.percentiles(empty, ["g"], "score", {"m": 0.5}).count() == 0


def test_areas(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 3 == 0) for i in range(200)], "estab int, score double, pos boolean")
    wins = [(1 if a > b else 0.5 if a == b else 0) for a in [i % 7 for i in range(0, 200, 3)] for b in [i % 7 for i in range(200) if i % 3]]
    got = {r.target: r.auroc for r in E.aurocs(df, {"pos": F.col("pos"), "rare": F.col("estab") < 5}).collect()}
    assert got["pos"] == pytest.approx(sum(wins) / len(wins)) and got["rare"] is None


def test_reports_add_up(spark):
    df = spark.createDataFrame([(i, (i * 37 % 100) + 0.5, float(i % 13), i % 2) for i in range(330)], "estab int, score double, adverse double, swr int")
    assert all(r.TP + r.FP + r.TN + r.FN == 330 for r in E.threshold_table(df).collect())
    rows = E.decile_summary(df).collect()
    assert sum(r.n for r in rows) == 330 and sum(r.n * r.lift for r in rows) == pytest.approx(330)
    assert E.capture(df, (1.0,)).first().adverse_captured == pytest.approx(1)
    low, high, mean = E.bootstrap_spearman(df, resamples=50).first()
    assert low <= mean <= high


def test_erf(spark):
    row = spark.range(1).select(*[S.erf(F.lit(x)).alias(str(i)) for i, x in enumerate((-2.0, 0.3, 1.7))]).first()
    assert list(row) == pytest.approx([math.erf(-2.0), math.erf(0.3), math.erf(1.7)], abs=2e-7)


def test_general_duty_and_hazards(spark):
    rows = spark.createDataFrame([("5(A)(1)", True), ("Section 5", True), ("19100030 B01", False), ("General duty clause", True), (None, None)], "s string, e boolean")
    assert rows.filter(~R.is_general_duty(F.col("s")).eqNullSafe(F.col("e"))).count() == 0
    assert spark.range(1).select(R.hazards(F.lit(" "), F.lit("LEAD"), F.lit(None), F.lit("ZINC")).alias("h")).first().h == "LEAD, ZINC"


def test_calibration_is_monotone(spark):
    df = spark.createDataFrame([(i, i / 3.0, float((i * i) % 50 + i / 4)) for i in range(300)], "estab int, score double, adverse double")
    out = [r.calibrated for r in M.calibrate(df, M.fit_calibrator(df)).orderBy("score").collect()]
    assert out == sorted(out) and min(out) >= 0 and max(out) <= 100


def test_published_models(spark, tmp_path):
    day = datetime.date(2024, 5, 1)
    rows = [(day, X.FEATURES, 9), (day - datetime.timedelta(days=7), X.FEATURES, 9), (day, X.FEATURES[::-1], 9), (day + datetime.timedelta(days=1), X.FEATURES, 9)]
    df = spark.createDataFrame(rows, "built date, features array<string>, establishments long")
    assert [r.usable for r in M.usable(df, day, X.FEATURES).collect()] == [True, False, False, False]


@pytest.mark.parametrize("name", ["M3", "M4", "M9", "M10_trained", "M11", "E23", "K3_model", "W8_model"])
def test_registered_models_have_full_size(spark, monkeypatch, name):
    """Queries reach the trainer with its own 500 trees of Huber loss, M4 with 100 of depth 3 and squared loss."""
    seen = {}

    class Reached(Exception):
        pass

    def train_scorer(frame, label, *, trees=500, depth=5, rate=0.05, alpha=0.95):
        seen.update(trees=trees, depth=depth, rate=rate, alpha=alpha)
        raise Reached

    monkeypatch.setattr(learned.M, "train_scorer", train_scorer)
    monkeypatch.setattr(learned.M, "load_or_build", lambda path, spark, day, build, population: build(population))
    monkeypatch.setattr(learned, "frame", lambda t: spark.createDataFrame([(True,)], "train boolean"))
    with pytest.raises(Reached):
        catalog.QUERIES[name](spark, "")
    assert seen == ({"trees": 100, "depth": 3, "rate": 0.1, "alpha": None} if name == "M4" else {"trees": 500, "depth": 5, "rate": 0.05, "alpha": 0.95})


def test_small_model_is_published_and_used_again(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("string").alias("estab"), *[(F.rand(i) * 5).alias(c) for i, c in enumerate(X.FEATURES)], (F.col("id") % 50).cast("double").alias("label")).cache()
    day, path, built = datetime.date(2024, 5, 1), f"file://{tmp_path}/model", []

    def build(population):
        built.append(1)
        return M.train_scorer(population, "label", trees=2, depth=2)

    first, new = M.load_or_build(path, spark, day, build, rows)
    again, anew = M.load_or_build(path, spark, day + datetime.timedelta(days=6), build, rows)
    assert (new, anew, built) == (True, False, [1]) and M.importances(first, spark).collect() == M.importances(again, spark).collect()
    assert M.load_or_build(path, spark, day + datetime.timedelta(days=7), build, rows)[1] and len(built) == 2
    changed = rows.withColumn("label", F.when(F.col("estab") == "7", 99.0).otherwise(F.col("label")))
    assert M.load_or_build(path, spark, day + datetime.timedelta(days=8), build, changed)[1] and len(built) == 3  # other data, same place and day
    nearly = changed.withColumn(X.FEATURES[0], F.col(X.FEATURES[0]) * (1 + 1e-15)).repartition(7)
    assert not M.load_or_build(path, spark, day + datetime.timedelta(days=8), build, nearly)[1]
    assert M.load_or_build(f"{path}-few", spark, day, build, rows.limit(4)) == (None, False)


def test_industry_reference(spark, tmp_path):
    lines = [("Code of NAICS", "Industry title "), ("31-33", "MakingT"), ("44", " Retail TradeT "), ("11121", "Vegetable farms"), ("1", "x"), ("48 ", "T"), ("", "y"), ("08-11", "Eight")]
    (tmp_path / "a.csv").write_text("\n".join(",".join(x) for x in lines))
    got = {r.code: r.title for r in B.read_industry_reference(spark, f"file://{tmp_path}/a.csv").collect()}
    assert got == {"31": "Making", "32": "Making", "33": "Making", "44": "Retail Trade", "11121": "Vegetable farms", "08": "Eight", "09": "Eight", "10": "Eight", "11": "Eight"}


def test_lookups_take_the_best_tier(spark):
    names = spark.createDataFrame([("ACME", "acme north"), ("ACME TOOLS", "Old Forge"), ("", "nothing"), ("AB", "ab")], "company_key string, estab_name string")
    asked = spark.createDataFrame([(q,) for q in ("ACME", "FORGE", "THE ACME OF AB", "%", "")], "query string")
    assert {(r["query"], r.company_key, r.tier) for r in Q.tiered_lookup(asked, names).collect()} == {("ACME", "ACME", 1), ("FORGE", "ACME TOOLS", 2), ("THE ACME OF AB", "ACME", 3)}


def test_stretched_scores(spark):
    df = spark.createDataFrame([("a", 80.0, 1), ("b", 80.0, 50), ("c", 10.0, 50), ("d", 15.0, 3)], "estab string, score double, n_inspections long")
    got = {r.estab: r for r in D.shrunk_and_stretched(df).collect()}
    assert got["a"].shrunk == pytest.approx(15 + 65 * (1 - math.exp(-0.2))) and got["d"].shrunk == 15 and got["b"].rescaled == 100 and got["c"].rescaled == 0


def test_latest_rows(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, ts timestamp, v string")
    merged = latest(rows((3, at, "old"), (4, at, "b")), rows((3, at + datetime.timedelta(days=9), "new")), ["k"], ["ts"])
    assert merged.filter("k = 3").first().v == "new" and merged.count() == 2


def test_names_are_cleaned_once_and_by_many_tasks(spark, monkeypatch):
    from riskledger.plans import catalog, naming

    monkeypatch.setattr(Q, "NAMES_A_TASK", 100)
    t = catalog.Tables(spark, "/root/testdata/sf0.01")
    n = t.names.count()
    assert t.names.rdd.getNumPartitions() == n // 100 + 1
    for frame in (naming.index_staleness(t), Q.key_index(t.keyed_names), Q.keyed_facilities(t.keyed_names)):
        assert "MANUFACTURING" not in frame._jdf.queryExecution().optimizedPlan().toString()  # no pattern of match keys
    assert {tuple(r) for r in Q.key_index(t.keyed_names).collect()} == {tuple(r) for r in Q.key_index(t.names).collect()}


def test_cutoffs_write_only_what_they_read(spark, monkeypatch):
    from riskledger.plans import catalog, reports

    class Enough(Exception):
        pass

    def written(df, name):
        raise Enough(name, *df.columns)

    monkeypatch.setattr(reports, "written", written)
    with pytest.raises(Enough) as e:
        reports.cutoffs(catalog.Tables(spark, "/root/testdata/sf0.001"))
    assert e.value.args[0] == "facts" and set(e.value.args[1:]) == set(reports.FACTS)
