"""Evaluation reports as queries (see catalog), with SQL for the same rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.functions import scores as S
from riskledger.operators import evaluate as E
from riskledger.operators import features as X
from riskledger.operators import models as M
from riskledger.operators import rollup as U
from riskledger.operators.ranking import percentiles, running_totals, written
from riskledger.plans import oracle_base as O
from riskledger.plans.bindings import AS_OF, CUTOFF
from riskledger.plans.catalog import Tables, op

PAIRED = O.WITH_PAIRED
TOP = "greatest(1, round_even(n * 0.1, 0))"


def average_rank(column: str, by: str = "") -> str:
    """SQL: the mean rank of equal values, inside a group."""
    part = f"PARTITION BY {by} " if by else ""
    return f"rank() OVER ({part}ORDER BY {column}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{column}) - 1) / 2"


def area(positive: str, target: str) -> str:
    """SQL: one row of the area under the curve of a target in ranked (with r)."""
    return f"""SELECT '{target}' AS target, count(*) FILTER ({positive}) AS pos, count(*) FILTER (NOT ({positive})) AS neg,
  CASE WHEN count(*) FILTER ({positive}) >= 10 AND count(*) FILTER (NOT ({positive})) >= 10
    THEN (sum(r) FILTER ({positive}) - count(*) FILTER ({positive}) * (count(*) FILTER ({positive}) + 1) / 2) / (count(*) FILTER ({positive}) * count(*) FILTER (NOT ({positive}))) END AS auroc FROM ranked"""


def group_sql(group: str, name: str, least: int = 1) -> str:
    return f"""{PAIRED}, g AS (SELECT {group} AS g, estab, score, adverse FROM paired),
r AS (SELECT *, {average_rank('score', 'g')} AS a, {average_rank('adverse', 'g')} AS b, row_number() OVER (PARTITION BY g ORDER BY score DESC, estab) AS place, count(*) OVER (PARTITION BY g) AS n FROM g)
SELECT g AS {name}, count(*) AS n, corr(a, b) AS spearman, avg(adverse) FILTER (place <= {TOP}) / nullif(avg(adverse), 0) AS top_decile_lift, avg(score) AS mean_score, avg(adverse) AS mean_adverse
FROM r GROUP BY 1 HAVING count(*) >= {least}"""


MEDIAN = "(SELECT quantile_cont(adverse, 0.5) FROM paired)"


@op("E4", f"""{PAIRED}, ranked AS (SELECT *, {average_rank('score')} AS r FROM paired)
{area('swr = 1', 'swr')} UNION ALL {area(f'adverse > {MEDIAN}', 'above_median')}""")
def areas(t: Tables) -> DataFrame:
    middle = percentiles(t.paired, [], "adverse", {"__median": 0.5}).select("__median")
    rows = t.paired.crossJoin(F.broadcast(middle))  # one row
    return E.aurocs(rows, {"swr": F.col("swr") == 1, "above_median": F.col("adverse") > F.col("__median")})


TARGETS = ["adverse", "swr", "violation_rate", "log_penalty", "fatality"]


@op("E5", PAIRED + " " + " UNION ALL ".join(f"""SELECT '{y}' AS target, corr(a, b) AS spearman, corr(score, y) AS pearson, count(*) AS n
FROM (SELECT score, {y} AS y, {average_rank('score')} AS a, {average_rank(y)} AS b FROM paired WHERE {y} IS NOT NULL)""" for y in TARGETS))
def rank_correlations(t: Tables) -> DataFrame:
    return E.correlations(t.paired, "score", TARGETS)


EDGES = ", ".join(f"quantile_cont(score, {i / 8}) AS q{i}" for i in range(1, 8))


@op("E7", f"""{PAIRED}, e AS (SELECT {EDGES} FROM paired)
SELECT CAST({' + '.join(f'CAST(score > q{i} AS INT)' for i in range(1, 8))} AS INT) AS bin, count(*) AS n, avg(adverse) AS mean FROM paired, e GROUP BY 1""")
def quantile_means(t: Tables) -> DataFrame:
    """The bins and means; E7_bootstrap has the half-widths of their intervals."""
    return E.quantile_bins(t.paired, "score", 8).groupBy("bin").agg(F.count("*").alias("n"), F.avg("adverse").alias("mean"))


@op("E7_bootstrap")
def quantile_intervals(t: Tables) -> DataFrame:
    return E.bootstrap_means(t.paired)


@op("E11", group_sql("sector", "sector", 20))
def by_sector(t: Tables) -> DataFrame:
    return E.group_report(t.paired, F.col("sector"), "sector", least=20)


@op("E12", group_sql("CASE WHEN n_inspections >= 5 AND recent >= 1 THEN 'High' WHEN n_inspections <= 1 THEN 'Low' ELSE 'Medium' END", "tag"))
def by_evidence(t: Tables) -> DataFrame:
    return E.group_report(t.paired, S.evidence_tag(F.col("n_inspections"), F.col("recent")), "tag")


@op("E14", group_sql("n_inspections = 1", "sparse", 3))
def by_depth(t: Tables) -> DataFrame:
    return E.group_report(t.paired, F.col("n_inspections") == 1, "sparse", least=3)


@op("E13", f"""{PAIRED}, b AS (SELECT round_even(score, 1) AS place, count(*) AS n FROM paired GROUP BY 1)
SELECT 'unique' AS measure, CAST(NULL AS DOUBLE) AS place, CAST(count(DISTINCT score) AS DOUBLE) AS value FROM paired UNION ALL SELECT 'deviation', NULL, stddev_pop(score) FROM paired
UNION ALL SELECT 'share_over', th, count(*) FILTER (score >= th) / count(*) FROM paired, (VALUES (20), (30), (40), (50), (60)) v(th) GROUP BY th
UNION ALL SELECT 'largest_bunch', NULL, max(n) / sum(n) FROM b UNION ALL (SELECT 'common', place, n FROM b ORDER BY n DESC, place LIMIT 10)""")
def score_diagnostics(t: Tables) -> DataFrame:
    return E.diagnostics(t.paired)


def one_cutoff(cutoff: str) -> str:
    return f"""SELECT * FROM (WITH{O.outcomes(cutoff)}, r AS (SELECT *, {average_rank('score')} AS a, {average_rank('adverse')} AS b, row_number() OVER (ORDER BY score DESC, estab) AS place, count(*) OVER () AS n FROM paired)
SELECT {cutoff} AS cutoff, count(*) AS n, corr(a, b) AS spearman, avg(adverse) FILTER (place <= {TOP}) / avg(adverse) AS top_decile_lift,
  (sum(a) FILTER (swr = 1) - count(*) FILTER (swr = 1) * (count(*) FILTER (swr = 1) + 1) / 2) / (count(*) FILTER (swr = 1) * count(*) FILTER (swr = 0)) AS auroc FROM r)"""


#: What features and outcomes read of the facts; their other columns, texts above all, need no shuffle.
FACTS = ["estab", "open_date", "naics_code", "n_violations", "serious", "willful", "repeat", "accidents", "fatalities", "injuries", "penalty", "max_penalty", "gravity_sum", "gravity_n"]


@op("E15", f"{O.WITH_FACTS} " + " UNION ALL ".join(one_cutoff(f"DATE '{y}-01-01'") for y in (1998, 1999, 2000)))
def cutoffs(t: Tables) -> DataFrame:
    """The whole way from features to outcomes and quality, for each of three cutoffs."""
    facts = written(t.facts.select(*FACTS), "facts")

    def quality(cutoff) -> DataFrame:
        past, later = facts.filter(F.col("open_date") < F.lit(cutoff)), facts.filter(F.col("open_date") >= F.lit(cutoff))
        history = written(U.site_scores(X.with_sectors(X.establishment_features(past, cutoff))), "history")
        pairs = written(E.paired(history, E.future_outcomes(history, later)).withColumn("all", F.lit(1)), "pairs")
        report = E.group_report(pairs, F.col("all"), "all").select("n", "spearman", "top_decile_lift")
        return report.crossJoin(E.aurocs(pairs, {"swr": F.col("swr") == 1}).select("auroc")).select(F.lit(cutoff).alias("cutoff"), "*")

    with ThreadPoolExecutor(3) as pool:  # each cutoff's jobs alone leave most of the cores idle
        return E.union(list(pool.map(inheritable_thread_target(quality), [CUTOFF.replace(year=y) for y in (1998, 1999, 2000)])))


TRAIN = "CAST('0x' || substr(md5(estab), 1, 8) AS BIGINT) % 100 < 80"


@op("E16", f"""{PAIRED} SELECT avg(abs(score - adverse)) AS mae, sqrt(avg(pow(score - adverse, 2))) AS rmse, 1 - avg(pow(score - adverse, 2)) / var_pop(adverse) AS r2, avg(score - adverse) AS bias,
  corr(score - adverse, adverse) AS residual_corr, avg(abs(score - adverse)) FILTER (NOT {TRAIN}) - avg(abs(score - adverse)) FILTER ({TRAIN}) AS gap FROM paired""")
def errors(t: Tables) -> DataFrame:
    return E.regression_quality(M.hash_split(t.paired, "estab"), F.col("train"))


@op("M2", f"{O.WITH_FEATURES} SELECT estab, n_inspections, {TRAIN} AS train FROM feats")
def split(t: Tables) -> DataFrame:
    return M.hash_split(t.features.select("estab", "n_inspections"), "estab")


TIER = lambda c: f"CASE WHEN {c} < 30 THEN 'Low' WHEN {c} < 60 THEN 'Medium' ELSE 'High' END"


@op("E17", f"""{PAIRED}, a AS (SELECT {TIER('score')} AS tier_a, {TIER('adverse')} AS tier_b FROM paired),
s AS (SELECT avg(CAST(tier_a = tier_b AS INT)) AS accuracy, avg(CAST(tier_a = 'High' AS INT)) FILTER (tier_b = 'High') AS high_recall, avg(CAST(tier_b = 'Low' AS INT)) FILTER (tier_a = 'Low') AS low_precision,
  avg(CAST((tier_a, tier_b) IN (('Low', 'High'), ('High', 'Low')) AS INT)) AS two_apart FROM a)
SELECT tier_a, tier_b, count(*) AS n, any_value(accuracy) AS accuracy, any_value(high_recall) AS high_recall, any_value(low_precision) AS low_precision, any_value(two_apart) AS two_apart FROM a, s GROUP BY 1, 2""")
def confusion(t: Tables) -> DataFrame:
    return E.tier_confusion(t.paired)


@op("E18", f"""{PAIRED}, r AS (SELECT row_number() OVER (ORDER BY score DESC, estab) AS a, row_number() OVER (ORDER BY adverse DESC, estab) AS b,
  row_number() OVER (ORDER BY score, estab) AS c, row_number() OVER (ORDER BY adverse, estab) AS d, count(*) OVER () AS n FROM paired)
SELECT 'top' AS "end", count(*) AS both FROM r WHERE a <= {TOP} AND b <= {TOP} UNION ALL SELECT 'bottom', count(*) FROM r WHERE c <= {TOP} AND d <= {TOP}""")
def overlaps(t: Tables) -> DataFrame:
    return E.end_overlaps(t.paired, "adverse")


@op("E19", f"""{PAIRED}, r AS (SELECT adverse, row_number() OVER (ORDER BY score, estab) AS rn, count(*) OVER () AS t FROM paired),
q AS (SELECT CAST((rn - 1) // (t // 5) AS INT) AS quintile, count(*) AS n, avg(adverse) AS mean FROM r WHERE (rn - 1) // (t // 5) < 5 GROUP BY 1)
SELECT *, (SELECT count(*) FROM (SELECT mean < lag(mean) OVER (ORDER BY quintile) AS falls FROM q) WHERE falls) AS inversions FROM q""")
def fifths(t: Tables) -> DataFrame:
    return E.quintiles(t.paired)


@op("E20", f"""{PAIRED} SELECT {', '.join(f'quantile_cont(score, {p / 100}) AS p{p}' for p in (5, 25, 50, 75, 95))}, avg(score) AS mean, stddev_pop(score) AS std, max(score) - min(score) AS score_range,
  stddev_pop(score) / stddev_pop(adverse) AS std_ratio FROM paired""")
def score_distribution(t: Tables) -> DataFrame:
    return E.distribution(t.paired)


def period_stats(name: str, where: str) -> str:
    return f"{O.features(name, where)}, {name}_s AS (SELECT grp, avg(raw_vpi) AS m FROM (SELECT *, substr(industry_group, 1, d) AS grp FROM {name}, (VALUES (4), (3), (2)) t(d) WHERE industry_group IS NOT NULL) GROUP BY 1 HAVING count(*) >= 10)"


@op("E21", f"""{O.WITH_FACTS},{period_stats('old', f'open_date < {O.CUTOFF}')},{period_stats('new', f'open_date >= {O.CUTOFF}')}
SELECT count(*) AS groups, count(*) FILTER (n.m / nullif(o.m, 0) < 0.33 OR n.m / nullif(o.m, 0) > 3) AS drifted FROM old_s o JOIN new_s n USING (grp)""")
def drift(t: Tables) -> DataFrame:
    """Groups in both periods whose mean rate changed more than threefold."""
    stats = lambda test: X.industry_statistics(X.establishment_features(t.facts.filter(test), AS_OF)).select("grp", F.col("avg_violation_rate").alias("m"))
    old, new = stats(F.col("open_date") < F.lit(CUTOFF)), stats(F.col("open_date") >= F.lit(CUTOFF)).withColumnRenamed("m", "now")
    ratio = F.try_divide("now", "m")
    return old.join(new, "grp").agg(F.count("*").alias("groups"), F.count_if((ratio < 0.33) | (ratio > 3)).alias("drifted"))


RAW_Z = lambda raw, stat: f"(z.{raw} - s.avg_{stat}) / greatest(abs(s.std_{stat}), 1e-6)"


@op("E22", f"""{O.WITH_Z}, r AS (SELECT z.industry_group, unnest([{', '.join(RAW_Z(raw, stat) for _, raw, stat in X.RATES)}]) AS z FROM zed z LEFT JOIN stats s ON s.grp = z.stats_group)
SELECT avg(CAST(abs(z) > 10 AS INT)) AS outliers, max(abs(z)) AS largest, count(DISTINCT substr(industry_group, 1, 2)) AS sectors FROM r""")
def outliers(t: Tables) -> DataFrame:
    """Share of the four z-scores, before they are clipped, that are over 10; sectors covered."""
    rows = X.with_industry(t.features, X.industry_statistics(t.features), clip=None)
    z = rows.select("industry_group", F.explode(F.array(*[n for n, _, _ in X.RATES])).alias("z"))
    return z.agg(F.avg((F.abs("z") > 10).cast("int")).alias("outliers"), F.max(F.abs("z")).alias("largest"), F.countDistinct(F.substring("industry_group", 1, 2)).alias("sectors"))


@op("E25", f"""{PAIRED}, e AS (SELECT quantile_cont(adverse, 0.75) AS edge FROM paired), b AS (SELECT CAST(least(floor(score / 2.5), 39) AS INT) AS bin, count(*) AS n, count(*) FILTER (adverse >= edge) AS n_worst FROM paired, e GROUP BY 1)
SELECT bin, n, n_worst, n / (sum(n) OVER () * 2.5) AS density, n_worst / (sum(n_worst) OVER () * 2.5) AS density_worst FROM b""")
def densities(t: Tables) -> DataFrame:
    return E.histogram(t.paired, "score", 0.0, 100.0)


DECILE = "CAST(greatest(1, ceil((row_number() OVER (ORDER BY score, estab) - 1) * 10 / (count(*) OVER () - 1))) AS INT)"


@op("E26", f"""{PAIRED}, r AS (SELECT adverse, {DECILE} AS decile FROM paired)
SELECT decile, quantile_cont(adverse, 0.25) AS q25, quantile_cont(adverse, 0.5) AS q50, quantile_cont(adverse, 0.75) AS q75 FROM r GROUP BY 1""")
def boxes(t: Tables) -> DataFrame:
    return percentiles(E.decile_bins(t.paired), ["decile"], "adverse", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")


@op("E29", f"""{O.WITH_SCORES} SELECT CAST(least(floor(score / 20), 4) AS INT) AS band, recent_ratio < 0.01 AS dormant, count(*) AS n, avg(serious_rate) AS serious_rate, avg(penalty_per_inspection) AS penalty_per_inspection,
  avg(clean_ratio) AS clean_ratio, quantile_cont(n_inspections, 0.5) AS median_n, quantile_cont(n_inspections, 0.9) AS p90_n FROM scored GROUP BY 1, 2""")
def band_profile(t: Tables) -> DataFrame:
    rows = t.labelled.withColumns({"band": F.least(F.floor(F.col("score") / 20), F.lit(4)).cast("int"), "dormant": F.col("recent_ratio") < 0.01})
    rows = written(rows.select("band", "dormant", "n_inspections", "serious_rate", "penalty_per_inspection", "clean_ratio"), "bands")
    depth = percentiles(rows, ["band", "dormant"], "n_inspections", {"median_n": 0.5, "p90_n": 0.9})
    means = rows.groupBy("band", "dormant").agg(*[F.avg(c).alias(c) for c in ("serious_rate", "penalty_per_inspection", "clean_ratio")])
    return means.join(depth, ["band", "dormant"])


@op("E31", f"""{O.WITH_SCORES} SELECT (SELECT count(*) FROM inspections) > 1000 AS inspections_enough, (SELECT count(*) FROM violations) > 1000 AS violations_enough, count(*) > 100 AS establishments_enough,
  count(*) FILTER (total_penalty < 0 OR n_violations < 0 OR n_inspections < 1) = 0 AS not_negative, count(*) FILTER (NOT clean_ratio BETWEEN 0 AND 1 OR NOT recent_ratio BETWEEN 0 AND 1) = 0 AS shares_in_range,
  count(*) FILTER (NOT score BETWEEN 0 AND 100) = 0 AS scores_in_range, count(*) FILTER (isnan(avg_penalty) OR isnan(score) OR avg_penalty IS NULL) = 0 AS no_nan, stddev_pop(score) > 1 AND count(DISTINCT score) > 10 AS not_degenerate FROM scored""")
def gates(t: Tables) -> DataFrame:
    none = lambda test: F.count_if(test) == 0
    share = lambda c: F.col(c).between(0, 1)
    out = t.labelled.agg(
        (F.count("*") > 100).alias("establishments_enough"), none((F.col("total_penalty") < 0) | (F.col("n_violations") < 0) | (F.col("n_inspections") < 1)).alias("not_negative"),
        none(~share("clean_ratio") | ~share("recent_ratio")).alias("shares_in_range"), none(~F.col("score").between(0, 100)).alias("scores_in_range"),
        none(F.isnan("avg_penalty") | F.isnan("score") | F.col("avg_penalty").isNull()).alias("no_nan"), ((F.stddev_pop("score") > 1) & (F.countDistinct("score") > 10)).alias("not_degenerate"),
    )
    enough = lambda df, name: df.agg((F.count("*") > 1000).alias(name))
    return enough(t.inspections, "inspections_enough").crossJoin(enough(t.violations, "violations_enough")).crossJoin(out)


@op("W1", f"{O.WITH_SCORES} SELECT estab, 100 * cume_dist() OVER (ORDER BY score) AS percentile FROM scored")
def population_percentile(t: Tables) -> DataFrame:
    return U.population_percentile(t.labelled.select("estab", "score"), t.labelled.select("score")).select("estab", "percentile")


@op("W4", f"""{PAIRED}, r AS (SELECT estab, row_number() OVER w AS rank, sum(adverse) OVER w AS adverse_so_far, CAST(sum(swr) OVER w AS BIGINT) AS swr_so_far FROM paired WINDOW w AS (ORDER BY score DESC, estab ROWS UNBOUNDED PRECEDING))
SELECT *, adverse_so_far / (SELECT sum(adverse) FROM paired) AS adverse_share, swr_so_far / (SELECT sum(swr) FROM paired) AS swr_share FROM r""")
def running(t: Tables) -> DataFrame:
    return E.gains(t.paired)


@op("U3", f"""{O.WITH_FACTS},{O.outcomes(O.CUTOFF)}, r AS (SELECT estab, row_number() OVER (ORDER BY score DESC, estab) AS a, row_number() OVER (ORDER BY adverse DESC, estab) AS b, count(*) OVER () AS n FROM paired)
SELECT 'top' AS set, estab AS member FROM r WHERE a <= {TOP} AND b <= {TOP}
UNION ALL SELECT DISTINCT 'industry', substr(naics_code, 1, 4) FROM facts WHERE naics_code <> '' AND open_date < {O.CUTOFF} AND substr(naics_code, 1, 4) IN (SELECT substr(naics_code, 1, 4) FROM facts WHERE open_date >= DATE '2001-07-25')""")
def intersections(t: Tables) -> DataFrame:
    """Establishments in both top tenths, and industries of both periods."""
    top = lambda c: E.top_ranked(t.paired.select("estab", c), (0.1,), score=c).select("estab")
    group = F.substring("naics_code", 1, 4)
    named = t.inspections.filter("naics_code != ''")
    industries = named.filter(F.col("open_date") < F.lit(CUTOFF)).select(group.alias("member")).intersect(named.filter("open_date >= date '2001-07-25'").select(group))
    return top("score").intersect(top("adverse")).select(F.lit("top").alias("set"), F.col("estab").alias("member")).union(industries.select(F.lit("industry"), "member"))


R7_PARTS = {
    "decile": f"SELECT 'decile' AS report, CAST(decile AS VARCHAR) AS part, avg(adverse) AS value FROM (SELECT adverse, {DECILE} AS decile FROM paired) GROUP BY 2",
    "threshold": "SELECT 'threshold', CAST(th AS VARCHAR), avg(swr) FILTER (score >= th) FROM paired, (VALUES (20), (30), (40), (50), (60)) v(th) GROUP BY th",
    "capture": "SELECT 'capture', CAST(f AS VARCHAR), sum(adverse) FILTER (rn <= greatest(1, round_even(n * f, 0))) / sum(adverse) FROM (SELECT adverse, row_number() OVER (ORDER BY score DESC, estab) AS rn, count(*) OVER () AS n FROM paired), (VALUES (0.05), (0.1), (0.2)) v(f) GROUP BY f",
    "correlation": f"SELECT 'correlation', 'spearman', corr(a, b) FROM (SELECT {average_rank('score')} AS a, {average_rank('adverse')} AS b FROM paired)",
    "area": "SELECT 'area', 'swr', (sum(r) FILTER (swr = 1) - sum(swr) * (sum(swr) + 1) / 2) / (sum(swr) * sum(1 - swr)) FROM (SELECT swr, " + average_rank("score") + " AS r FROM paired)",
    "band": "SELECT 'band', CAST(CAST(least(floor(score / 20), 4) AS INT) AS VARCHAR), avg(adverse) FROM paired GROUP BY 2",
    "tier": f"SELECT 'tier', {TIER('score')}, avg(adverse) FROM paired GROUP BY 2",
    "sector": "SELECT 'sector', sector, avg(adverse) FROM paired GROUP BY 2 HAVING count(*) >= 20",
    "separation": "SELECT 'separation', 'swr', avg(score) FILTER (swr = 1) - avg(score) FILTER (swr = 0) FROM paired",
    "error": "SELECT 'error', 'mae', avg(abs(score - adverse)) FROM paired",
}


@op("R7", f"{PAIRED} " + " UNION ALL ".join(R7_PARTS.values()))
def bundle(t: Tables) -> DataFrame:
    """The main figures of ten reports, long."""
    p = t.paired
    line = lambda df, report, part, value: df.select(F.lit(report).alias("report"), F.col(part).cast("string").alias("part"), F.col(value).cast("double").alias("value"))
    one = lambda df, report, part, value: df.select(F.lit(report).alias("report"), F.lit(part).alias("part"), F.col(value).cast("double").alias("value"))
    return E.union([
        line(E.decile_summary(p), "decile", "decile", "mean_outcome"), line(E.threshold_table(p), "threshold", "threshold", "precision"),
        line(E.capture(p, (0.05, 0.1, 0.2)).withColumn("part", F.format_string("%.2f", "fraction")), "capture", "part", "adverse_captured"),
        one(E.spearman(p, "score", "adverse"), "correlation", "spearman", "spearman"), one(E.aurocs(p, {"swr": F.col("swr") == 1}), "area", "swr", "auroc"),
        line(E.score_bands(p), "band", "band", "mean_adverse"), line(E.by_tier(p), "tier", "tier", "mean_adverse"),
        line(p.groupBy("sector").agg(F.count("*").alias("n"), F.avg("adverse").alias("m")).filter("n >= 20"), "sector", "sector", "m"),
        one(p.agg((F.avg(F.when(F.col("swr") == 1, F.col("score"))) - F.avg(F.when(F.col("swr") == 0, F.col("score")))).alias("d")), "separation", "swr", "d"),
        one(p.agg(F.avg(F.abs(F.col("score") - F.col("adverse"))).alias("mae")), "error", "mae", "mae"),
    ])
