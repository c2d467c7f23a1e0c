"""Models, weights, calibration and documented operators as queries (see catalog)."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.functions import scores as S
from riskledger.functions.labels import DRIVER_LABELS, driver_label
from riskledger.operators import documented as D
from riskledger.operators import evaluate as E
from riskledger.operators import features as X
from riskledger.operators import models as M
from riskledger.operators.boosting import Forest
from riskledger.operators.ranking import written
from riskledger.plans import oracle_base as O
from riskledger.plans.bindings import AS_OF, CUTOFF
from riskledger.plans.catalog import I, Tables, op
from riskledger.plans.reports import FACTS, average_rank
from riskledger.sources.bronze import shared_base

#: M3's size is train_scorer's own; M4 is the small model of holdout checks.
SMALL = {"trees": 100, "depth": 3, "rate": 0.1, "alpha": None}
OUTCOME_END = AS_OF.replace(month=7)
END = "DATE '2001-07-01'"


class Written(Tables):
    """Tables whose facts (the columns that features and outcomes read) and history are written once: a model's rows, labels and outcomes all come from them."""

    @cached_property
    def facts(self) -> DataFrame:
        return written(Tables.facts.func(self).select(*FACTS), "facts")

    @cached_property
    def history(self) -> DataFrame:
        return written(Tables.history.func(self), "history")


def frame(t: Tables) -> DataFrame:
    """Model columns of the training history with its label and whether trouble followed, written."""
    t = t if isinstance(t, Written) else Written(t.spark, t.sf_dir)
    rows = X.feature_frame(t.history, keys=("estab", "raw_score")).withColumnRenamed("raw_score", "label").select("estab", *X.FEATURES, "label")
    later = t.outcomes.select("estab", F.coalesce("swr", F.lit(0)).alias("swr"), F.col("has_future_data").cast("int").alias("again"))
    return written(M.hash_split(rows.join(later, "estab").fillna(0.0), "estab"), "frame")


def scorer(t: Tables, rows: DataFrame | None = None, **options) -> tuple[DataFrame, Forest, bool]:
    """The training frame (rows, if it is at hand), the model of these options over it (the published one while it is
    fresh, see S11), and whether it was built just now."""
    rows = frame(t) if rows is None else rows
    name = hashlib.md5(repr((t.sf_dir, sorted(options.items()))).encode()).hexdigest()
    build = lambda population: M.train_scorer(population.filter("train"), "label", **options)
    model, new = M.load_or_build(f"{shared_base(t.spark)}/models/{name}", t.spark, AS_OF, build, rows)
    return rows, model, new


def learned(t: Tables, **options) -> DataFrame:
    rows, model, new = scorer(t, **options)
    scored = rows.withColumn("prediction", F.lit(50.0)) if model is None else model.transform(rows)
    return scored.select("estab", F.round("prediction", 6).alias("score"), "label", "train", "swr", F.lit(new).alias("rebuilt"))


def weights(t: Tables, rows: DataFrame | None = None, **options) -> DataFrame:
    _, model, _ = scorer(t, rows, **options)
    return M.importances(model, t.spark)


@op("M3")
def trained_scores(t: Tables) -> DataFrame:
    return learned(t).drop("rebuilt")


@op("M4")
def holdout_errors(t: Tables) -> DataFrame:
    """The small model's mean errors inside and outside its training rows."""
    return learned(t, **SMALL).groupBy("train").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("score") - F.col("label"))).alias("mae"), F.corr("score", "label").alias("pearson"))


@op("M9")
def feature_weights(t: Tables) -> DataFrame:
    return weights(t)


@op("H17", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{DRIVER_LABELS.get(f, f.replace('_', ' '))}')" for f in X.FEATURES) + ") v(feature, label) WHERE (SELECT count(*) FROM customer) > 0")
def driver_names(t: Tables) -> DataFrame:
    """The features of the model frame by name."""
    names = X.feature_frame(t.features).agg(F.array(*[F.lit(f) for f in X.FEATURES]).alias("f"), F.count("*").alias("n")).filter("n > 0")
    return names.select(F.explode("f").alias("feature")).select("feature", driver_label(F.col("feature")).alias("label"))


@op("E23")
def model_overlap(t: Tables) -> DataFrame:
    """The model and the small one: features among both their ten weightiest, and dominance."""
    rows = frame(t)
    return M.weight_overlap(weights(t, rows), weights(t, rows, **SMALL))


@op("M11")
def rebuilt(t: Tables) -> DataFrame:
    """Scores of the published model, built anew where it is older than a week or knows other features."""
    return learned(t).select("estab", "score", "rebuilt")


META = f"""{I}, m AS (SELECT company_key, max(open_date) AS built, company_key LIKE 'B%' AS old FROM inspections GROUP BY 1)"""


@op("S11", f"""{META} SELECT company_key, built, {O.AS_OF} - built AS age, {O.AS_OF} - built BETWEEN 0 AND 6 AS fresh, NOT old AS same_features, {O.AS_OF} - built BETWEEN 0 AND 6 AND NOT old AS usable FROM m""")
def published_models(t: Tables) -> DataFrame:
    """Models as old as a company's newest inspection, some of them without the last feature."""
    whole, short = (F.array(*[F.lit(f) for f in fs]) for fs in (X.FEATURES, X.FEATURES[:-1]))
    models = t.inspections.groupBy("company_key").agg(F.max("open_date").alias("built")).withColumn("features", F.when(F.col("company_key").startswith("B"), short).otherwise(whole))
    return M.usable(models, AS_OF, X.FEATURES).drop("features")


LOGS = {c: f"ln(1 + greatest({c}, 0))" for c in S.LOGGED}
ZS = {n: f"coalesce({n}, 0)" for n, _, _ in X.RATES}
FLAGS = {f"naics_{s}": f"CAST(coalesce(substr(industry_group, 1, 2) = '{s}', false) AS INT)" for s in S.SECTORS} | {"naics_unknown": "CAST(industry_group IS NULL AS INT)"}
FRAME = ", ".join(f"{({c: c for c in X.FEATURES} | LOGS | ZS | FLAGS)[c]} AS {c}" for c in X.FEATURES)
WEIGHTS = f"""{O.WITH_Z}, frame AS (SELECT estab, {FRAME} FROM zed),{O.scored()}, j AS (SELECT f.*, raw_score FROM frame f JOIN scored s USING (estab)),
w AS (SELECT unnest([{', '.join(f"'{c}'" for c in X.FEATURES)}]) AS feature, unnest([{', '.join(f'coalesce(abs(CASE WHEN stddev_pop({c}) > 0 THEN corr({c}, raw_score) END), 0)' for c in X.FEATURES)}]) AS weight FROM j)"""


@op("M1", f"{O.WITH_Z} SELECT estab, {FRAME} FROM zed")
def model_frame(t: Tables) -> DataFrame:
    return X.feature_frame(t.features)


def plain_weights(t: Tables) -> DataFrame:
    """Weights without a model, for the operators over weights."""
    return M.correlation_weights(X.feature_frame(t.features).join(t.labelled.select("estab", "raw_score"), "estab"), "raw_score")


LABELS = "CASE feature " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DRIVER_LABELS.items()) + " ELSE replace(feature, '_', ' ') END"


@op("K3", f"""{WEIGHTS} SELECT feature, {LABELS} AS label, weight, weight / max(weight) OVER () AS share, CAST(row_number() OVER (ORDER BY weight DESC, feature) AS INT) AS rank,
  row_number() OVER (ORDER BY weight DESC, feature) <= 3 AS driver FROM w QUALIFY rank <= 15""")
def drivers(t: Tables) -> DataFrame:
    return M.top_weights(plain_weights(t))


@op("W8", f"{WEIGHTS} SELECT feature, weight, weight / max(weight) OVER () AS share FROM w")
def weight_shares(t: Tables) -> DataFrame:
    return M.top_weights(plain_weights(t), most=len(X.FEATURES)).select("feature", "weight", "share")


@op("K3_model")
def model_drivers(t: Tables) -> DataFrame:
    """The largest importances of the trained model; K3 has the weights that SQL can follow."""
    return M.top_weights(weights(t))


@op("W8_model")
def model_shares(t: Tables) -> DataFrame:
    return M.top_weights(weights(t), most=len(X.FEATURES)).select("feature", "weight", "share")


# ---- calibration ------------------------------------------------------------------------
def isotonic(least_pairs: int) -> str:
    """SQL: bins of paired, and the rising function nearest to their means, by its min-max formula."""
    return f"""b AS (SELECT CAST(greatest(0, least(floor(score / 5), 19)) AS BIGINT) AS bin, count(*) AS n, avg(adverse) AS mean, (greatest(0, least(floor(score / 5), 19)) + 0.5) * 5 AS mid
  FROM paired WHERE (SELECT count(*) FROM paired) >= {least_pairs} GROUP BY 1, 4 HAVING count(*) >= 3),
seg AS (SELECT x.bin AS a, y.bin AS z, (SELECT avg(mean) FROM b WHERE bin BETWEEN x.bin AND y.bin) AS v FROM b x JOIN b y ON x.bin <= y.bin),
lows AS (SELECT b.bin, seg.a, min(v) AS v FROM b JOIN seg ON seg.a <= b.bin AND seg.z >= b.bin GROUP BY 1, 2),
fit AS (SELECT b.*, (SELECT max(v) FROM lows WHERE lows.bin = b.bin) AS fitted FROM b)"""


def calibrated(c: str) -> str:
    """SQL: a score through fit, in proportion between middles, rescaled to 0 to 100."""
    lo, hi = f"(SELECT max(mid) FROM fit WHERE mid <= {c})", f"(SELECT min(mid) FROM fit WHERE mid >= {c})"
    at = lambda m: f"(SELECT fitted FROM fit WHERE mid = {m})"
    value = f"coalesce({at(lo)} + ({at(hi)} - {at(lo)}) * coalesce(({c} - {lo}) / nullif({hi} - {lo}, 0), 0), {at(lo)}, {at(hi)})"
    return f"greatest(0, least(100, ({value} - (SELECT min(fitted) FROM fit)) / (SELECT max(fitted) - min(fitted) FROM fit) * 100))"


@op("M5", f"{O.WITH_PAIRED}, {isotonic(10)} SELECT bin, n, mean, mid, fitted FROM fit")
def calibrator(t: Tables) -> DataFrame:
    return M.fit_calibrator(t.paired).bins


@op("M6", f"{O.WITH_PAIRED}, {isotonic(10)} SELECT estab, score, {calibrated('score')} AS calibrated FROM paired")
def calibrated_scores(t: Tables) -> DataFrame:
    return M.calibrate(t.paired, M.fit_calibrator(t.paired)).select("estab", "score", "calibrated")


PAIRS = O.outcomes(O.CUTOFF).replace("SELECT estab, score,", "SELECT estab, greatest(0, least(100, raw_score)) AS score,", 1)
#: Establishments of all time under their own names, scored; calibration needs those of the history.
NOW = f"{O.features('now_feats')},{O.scored('now_feats', 'now_scored')}"


@op("M7", f"{O.WITH_FACTS},{PAIRS}, {isotonic(100)} SELECT bin, n, mean, mid, fitted FROM fit")
def recalibrator(t: Tables) -> DataFrame:
    """The calibrator of raw scores of the history against what really followed, from 100 pairs on."""
    return M.fit_calibrator(raw_pairs(t), least_pairs=100).bins


@op("A18", f"""{O.WITH_FACTS},{PAIRS} SELECT CAST(floor(score / 5) AS INT) AS bin, count(*) AS n, avg(adverse) AS mean, max(adverse) AS worst FROM paired WHERE (SELECT count(*) FROM paired) >= 100 GROUP BY 1""")
def calibration_pairs(t: Tables) -> DataFrame:
    """Pairs of raw score and outcome by bin; every term of the outcome is capped, no pair is dropped; none under 100 pairs."""
    pairs = raw_pairs(t)
    enough = F.broadcast(pairs.agg((F.count("*") >= 100).alias("enough")))  # one row
    bins = pairs.crossJoin(enough).filter("enough").groupBy(F.floor(F.col("score") / 5).cast("int").alias("bin"))
    return bins.agg(F.count("*").alias("n"), F.avg("adverse").alias("mean"), F.max("adverse").alias("worst"))


def raw_pairs(t: Tables) -> DataFrame:
    return written(E.paired(t.history.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("raw_score")))), t.outcomes), "pairs")


@op("M10", f"""{O.WITH_FACTS},{O.outcomes(O.CUTOFF)},{NOW}, {isotonic(100)}
SELECT estab, round(raw_score, 6) AS raw_score, CAST(ceiling AS DOUBLE) AS ceiling, capped, round({calibrated('score')}, 6) AS calibrated FROM now_scored""")
def scored_establishments(t: Tables) -> DataFrame:
    """All establishments: features, label, ceiling, calibration by what followed (M10_trained: with the model's score for the label)."""
    out = M.calibrate(t.labelled, M.fit_calibrator(t.paired, least_pairs=100))
    return out.select("estab", F.round("raw_score", 6).alias("raw_score"), "ceiling", "capped", F.round("calibrated", 6).alias("calibrated"))


@op("M10_trained")
def trained_establishments(t: Tables) -> DataFrame:
    t = Written(t.spark, t.sf_dir)
    pairs = written(learned(t).drop("train").withColumnRenamed("score", "raw_score").join(t.history.select("estab", "ceiling", "n_inspections", "recent", "industry_group"), "estab").withColumn("score", F.greatest(F.lit(0.0), F.least("raw_score", "ceiling"))), "scored")
    calibrator = M.fit_calibrator(E.paired(pairs, t.outcomes), least_pairs=100)
    return M.calibrate(pairs, calibrator).select("estab", F.bround("calibrated", 1).alias("score"), (F.col("raw_score") > F.col("ceiling")).alias("capped"))


# ---- documented operators ---------------------------------------------------------------
@op("D1", f"""{O.WITH_FACTS} SELECT estab, sum(penalty * exp(-((({O.AS_OF} - open_date) / 365.0) / 3.0))) AS decayed_penalty, coalesce(sum(CASE WHEN open_date >= {O.AS_OF} - 1095 THEN willful + repeat ELSE 0 END) / nullif(sum(willful + repeat), 0), 0) AS recent_wr_share,
  avg(n_violations) - coalesce(avg(n_violations) FILTER (open_date >= {O.AS_OF} - 1095), 0) AS trend_delta, ln(1 + sum(willful)) AS log_willful, ln(1 + sum(repeat)) AS log_repeat, CAST(sum(fatalities) > 0 AS INT) AS any_fatality,
  ln(1 + max(penalty)) AS log_worst_penalty, ln(1 + median(nr_in_estab)) AS log_median_size FROM facts GROUP BY 1""")
def extra_features(t: Tables) -> DataFrame:
    return D.extra_features(t.facts, AS_OF)


THRESHOLDS = f"""pen AS (SELECT substr(naics_code, 1, 2) AS sector, penalty FROM facts WHERE open_date < {O.CUTOFF} AND penalty > 0), every AS (SELECT quantile_cont(penalty, 0.95) AS c FROM pen),
p95 AS (SELECT sector, CASE WHEN count(*) >= 50 THEN quantile_cont(penalty, 0.95) ELSE any_value(c) END AS p95 FROM pen, every GROUP BY 1),
events_of AS (SELECT estab, max(CAST(serious + willful + repeat > 0 AS INT)) AS swr, max(CAST(severe_injuries > 0 AS INT)) AS injury, max(CAST(penalty >= coalesce(p95, (SELECT max(p95) FROM p95)) AS INT)) AS large_penalty
  FROM facts LEFT JOIN p95 ON sector = substr(naics_code, 1, 2) WHERE open_date >= {O.CUTOFF} AND open_date < {END} GROUP BY 1),
labels_of AS (SELECT events_of.* FROM events_of JOIN feats USING (estab)),
placed AS (SELECT l.*, floor(score / 5) AS s FROM labels_of l JOIN scored USING (estab)),
heads AS (SELECT *, avg(swr) OVER (PARTITION BY s) AS p_swr, avg(injury) OVER (PARTITION BY s) AS p_injury, avg(large_penalty) OVER (PARTITION BY s) AS p_penalty FROM placed)"""
LABELLED = f"{O.WITH_FACTS},{O.features('feats', f'open_date < {O.CUTOFF}', O.CUTOFF)},{O.scored()},{THRESHOLDS}"


def labels(t: Tables) -> DataFrame:
    return D.outcome_labels(t.history, t.facts, D.penalty_percentiles(t.facts, CUTOFF), CUTOFF, OUTCOME_END)


def heads(t: Tables) -> DataFrame:
    """Probabilities of the three outcomes by band of score, written."""
    rows = labels(t).join(t.history.select("estab", "score"), "estab")
    return written(D.stratum_rates(rows, [F.floor(F.col("score") / 5)], {"p_swr": "swr", "p_injury": "injury", "p_penalty": "large_penalty"}), "heads")


@op("D3", f"{LABELLED} SELECT estab, swr, injury, large_penalty FROM labels_of")
def outcome_labels(t: Tables) -> DataFrame:
    return labels(t)


@op("D4", f"""{O.WITH_PAIRED}, r AS (SELECT s.estab, coalesce(substr(industry_group, 1, 2), '') AS a, least(s.n_inspections, 10) AS b, CAST(has_future_data AS INT) AS again FROM scored s JOIN outcomes o USING (estab))
SELECT estab, 1 / greatest(avg(again) OVER (PARTITION BY a, b), 0.05) AS weight FROM r""")
def selection_weights(t: Tables) -> DataFrame:
    """By sector and depth of history; D4_logistic has the model of propensity."""
    rows = t.history.select("estab", "industry_group", "n_inspections").join(t.outcomes.select("estab", "has_future_data"), "estab")
    strata = [F.coalesce(F.substring("industry_group", 1, 2), F.lit("")), F.least("n_inspections", F.lit(10))]
    return D.inspection_strata(rows.withColumn("has_future_data", F.col("has_future_data").cast("int")), "has_future_data", strata).select("estab", "weight")


@op("D4_logistic")
def propensity_weights(t: Tables) -> DataFrame:
    return M.inspection_weights(frame(t), "again", ["n_inspections", "recent_ratio", "total_penalty"]).select("estab", "weight")


@op("D5")
def probability_heads(t: Tables) -> DataFrame:
    """The three heads with their composite, the hurdle model of penalties and that of gravity."""
    rows = frame(t).drop("swr", "train").join(labels(t), "estab").join(t.outcomes.select("estab", F.coalesce("penalty", F.lit(0.0)).alias("next_penalty")), "estab")
    later = t.facts.filter((F.col("open_date") >= F.lit(CUTOFF)) & (F.col("open_date") < F.lit(OUTCOME_END)))
    gravity = later.groupBy("estab").agg(F.try_divide(F.sum("gravity_sum"), F.sum("gravity_n")).alias("next_gravity"))
    rows = written(rows.join(gravity, "estab", "left").fillna(0.0, ["next_gravity"]), "heads")
    for target, out in (("swr", "p_swr"), ("injury", "p_injury"), ("large_penalty", "p_penalty")):
        rows = M.probability_head(rows, target, out)
    rows = M.expected_value(rows, "next_penalty", "expected_penalty")
    rows = M.expected_value(rows, "next_gravity", "expected_gravity")
    score = D.composite(F.col("p_swr"), F.col("p_injury"), F.col("p_penalty"))
    return rows.select("estab", "p_swr", "p_injury", "p_penalty", score.alias("composite"), "expected_penalty", "expected_gravity")


@op("D6", f"{LABELLED} SELECT estab, p_swr, p_injury, p_penalty, 100 * (0.578 * p_swr + 0.256 * p_injury + 0.165 * p_penalty) AS composite FROM heads")
def composites(t: Tables) -> DataFrame:
    rows = heads(t)
    return rows.select("estab", "p_swr", "p_injury", "p_penalty", D.composite(F.col("p_swr"), F.col("p_injury"), F.col("p_penalty")).alias("composite"))


@op("D7", f"""{O.WITH_SCORES}, s AS (SELECT estab, round(15 + (score - 15) * (1 - exp(-n_inspections / 5.0)), 9) AS shrunk FROM scored), p AS (SELECT *, pow(percent_rank() OVER (ORDER BY shrunk), 2) * 100 AS stretched FROM s)
SELECT *, (stretched - min(stretched) OVER ()) / (max(stretched) OVER () - min(stretched) OVER ()) * 100 AS rescaled FROM p""")
def stretched(t: Tables) -> DataFrame:
    return D.shrunk_and_stretched(t.labelled).select("estab", "shrunk", "stretched", "rescaled")


@op("D9", f"""{O.WITH_SCORES}, e AS (SELECT *, greatest(n_inspections / 6.58, CASE WHEN score >= 60 THEN 1.5 WHEN score >= 40 THEN 0.75 WHEN score >= 20 THEN 0.3 ELSE 0.1 END) AS e FROM scored)
SELECT estab, e AS expected_inspections, e * violations_per_inspection AS expected_violations, e * penalty_per_inspection AS expected_penalty, e * serious_rate AS expected_serious, e * (willful_rate + repeat_rate) AS expected_willful_repeat,
  CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'moderate' ELSE 'high' END AS risk_band FROM e""")
def next_year(t: Tables) -> DataFrame:
    return D.outlook(t.labelled).select("estab", "expected_inspections", "expected_violations", "expected_penalty", "expected_serious", "expected_willful_repeat", "risk_band")


@op("D10", f"""{O.WITH_PAIRED}, r AS (SELECT score / 100 AS p, swr, row_number() OVER (ORDER BY score DESC, estab) AS rn, sum(swr) OVER (ORDER BY score DESC, estab) / row_number() OVER (ORDER BY score DESC, estab) AS pr, count(*) OVER () AS n FROM paired),
a AS (SELECT avg(pow(p - swr, 2)) AS brier, avg(swr) AS prevalence, sum(pr * swr) / sum(swr) AS average_precision, avg(swr) FILTER (rn <= greatest(1, round_even(n * 0.1, 0))) / avg(swr) AS top_decile_lift,
  sum(swr) FILTER (rn <= greatest(1, round_even(n * 0.1, 0))) / sum(swr) AS top_decile_capture FROM r) SELECT *, 1 - brier / (prevalence * (1 - prevalence)) AS brier_skill FROM a""")
def probability_quality(t: Tables) -> DataFrame:
    return D.probability_metrics(t.paired.withColumn("p", F.col("score") / 100), "p", "swr", "estab")


@op("D11", f"""{LABELLED}, g AS (SELECT a / 4 AS w1, b / 4 AS w2, (4 - a - b) / 4 AS w3 FROM range(5) x(a), range(5) y(b) WHERE a + b <= 4),
c AS (SELECT w1, w2, w3, swr, round(w1 * p_swr + w2 * p_injury + w3 * p_penalty, 9) AS blend FROM heads, g), r AS (SELECT *, {average_rank('blend', 'w1, w2')} AS r FROM c),
s AS (SELECT w1, w2, w3, sum(r) FILTER (swr = 1) AS rs, CAST(sum(swr) AS BIGINT) AS pos, CAST(sum(1 - swr) AS BIGINT) AS neg FROM r GROUP BY ALL)
SELECT w1, w2, w3, pos, neg, (rs - pos * (pos + 1) / 2) / (pos * neg) AS auroc FROM s""")
def weight_search(t: Tables) -> DataFrame:
    rows = D.weight_grid(heads(t), ("p_swr", "p_injury", "p_penalty"))
    return E.aurocs(rows, {"swr": F.col("swr") == 1}, score="blend", groups=["w1", "w2", "w3"]).drop("target")


@op("D15")
def adversarial_validation(t: Tables) -> DataFrame:
    """Whether a classifier tells feature rows from before the cutoff from later ones: the area under its curve, on rows that neither its trees nor its calibration saw."""
    periods = ((F.col("open_date") < F.lit(CUTOFF), CUTOFF, 0), (F.col("open_date") >= F.lit(CUTOFF), AS_OF, 1))
    rows = E.union([X.feature_frame(X.establishment_features(t.facts.filter(test), day)).withColumn("period", F.lit(p)) for test, day, p in periods])
    told = M.probability_head(written(rows, "periods"), "period").filter("part = 'test'")
    return E.aurocs(told, {"later": F.col("period") == 1}, score="probability")
