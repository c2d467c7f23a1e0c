"""Operators known from documentation: extra features, penalty percentiles, credibility, outlook, rank metrics."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskledger.operators.ranking import percent_ranks, percentiles, running_totals


def extra_features(facts: DataFrame, as_of: datetime.date, *, tau_years: float = 3.0, recency_days: int = 1095) -> DataFrame:
    """Time-decayed penalty, recent share of willful/repeat, trend (violations per inspection
    of all time less those of recent years), logs of counts, worst penalty and size."""
    age = F.datediff(F.lit(as_of), "open_date") / 365.0
    recent = F.col("open_date") >= F.date_sub(F.lit(as_of), recency_days)
    wr = F.col("willful") + F.col("repeat")
    out = facts.groupBy("estab").agg(
        F.sum(F.col("penalty") * F.exp(-age / tau_years)).alias("decayed_penalty"), F.sum(F.when(recent, wr).otherwise(0)).alias("__r"), F.sum(wr).alias("__wr"),
        F.avg(F.when(recent, F.col("n_violations"))).alias("__new"), F.avg("n_violations").alias("__all"), F.log1p(F.sum("willful")).alias("log_willful"), F.log1p(F.sum("repeat")).alias("log_repeat"),
        (F.sum("fatalities") > 0).cast("int").alias("any_fatality"), F.log1p(F.max("penalty")).alias("log_worst_penalty"),
    )
    # sizes are counted by value first, so that a median holds an establishment's distinct sizes, not its inspections
    sizes = facts.groupBy("estab", "nr_in_estab").agg(F.count(F.lit(1)).alias("__times"))
    medians = sizes.groupBy("estab").agg(F.log1p(F.percentile("nr_in_estab", F.lit(0.5), F.col("__times"))).alias("log_median_size"))
    return out.join(medians, "estab").withColumns({"recent_wr_share": F.coalesce(F.try_divide("__r", "__wr"), F.lit(0.0)), "trend_delta": F.col("__all") - F.coalesce("__new", F.lit(0.0))}).drop("__r", "__wr", "__new", "__all")


def penalty_percentiles(facts: DataFrame, before: datetime.date, *, least: int = 50) -> DataFrame:
    """P75, P90 and P95 of penalties by sector before a date; small sectors get the global ones."""
    rows = facts.filter((F.col("open_date") < F.lit(before)) & (F.col("penalty") > 0)).select(F.coalesce(F.substring("naics_code", 1, 2), F.lit("")).alias("sector"), "penalty")
    shares = {"p75": 0.75, "p90": 0.9, "p95": 0.95}
    every = percentiles(rows, [], "penalty", shares).select(*[F.col(c).alias(f"__{c}") for c in shares])
    own = percentiles(rows, ["sector"], "penalty", shares).crossJoin(F.broadcast(every))  # one row
    return own.select("sector", "n", *[F.when(F.col("n") >= least, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in shares])


def credibility(sites: DataFrame, keys: list[str], *, k: float = 5.0, prior: float = 15.0) -> DataFrame:
    """Site scores shrunk to a prior by n / (n + k), rolled up, and blended with the worst by concentration."""
    z = F.col("n_inspections") / (F.col("n_inspections") + k)
    rows = sites.withColumn("__s", z * F.col("score") + (1 - z) * prior)
    out = rows.groupBy(*keys).agg((F.sum(F.col("__s") * F.col("n_inspections")) / F.sum("n_inspections")).alias("mean"), F.max("__s").alias("worst"), (F.count_if(F.col("score") >= 60) / F.count(F.lit(1))).alias("concentration"))
    alpha = F.least(0.3 * F.col("concentration"), F.lit(0.3))
    return out.withColumn("blended", (1 - alpha) * F.col("mean") + alpha * F.col("worst"))


def outlook(sites: DataFrame, *, years: float = 6.58) -> DataFrame:
    """Expected inspections of the next year, at least what the score's tier has, and events at past rates."""
    floor = F.when(F.col("score") >= 60, 1.5).when(F.col("score") >= 40, 0.75).when(F.col("score") >= 20, 0.3).otherwise(0.1)
    out = sites.withColumn("expected_inspections", F.greatest(F.col("n_inspections") / years, floor))
    e = F.col("expected_inspections")
    return out.withColumns({
        "expected_violations": e * F.col("violations_per_inspection"), "expected_penalty": e * F.col("penalty_per_inspection"), "expected_serious": e * F.col("serious_rate"),
        "expected_willful_repeat": e * (F.col("willful_rate") + F.col("repeat_rate")), "risk_band": F.when(F.col("score") < 30, "low").when(F.col("score") < 60, "moderate").otherwise("high"),
    })


def outcome_labels(history: DataFrame, facts: DataFrame, thresholds: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """D3: of each establishment of history (estab) inspected from start to before end, whether
    there was a serious, willful or repeat violation, an injury that killed or put someone in hospital, and
    an inspection with a penalty at or over its sector's P95 of the time before (thresholds, see
    penalty_percentiles; a sector without one has the highest)."""
    window = facts.filter((F.col("open_date") >= F.lit(start)) & (F.col("open_date") < F.lit(end))).withColumn("sector", F.coalesce(F.substring("naics_code", 1, 2), F.lit("")))
    p95 = F.broadcast(thresholds.select("sector", "p95"))  # sectors have two digits
    most = F.broadcast(thresholds.agg(F.max("p95").alias("__most")))  # one row
    rows = window.join(p95, "sector", "left").crossJoin(most).withColumn("__large", F.col("penalty") >= F.coalesce("p95", "__most"))
    flag = lambda c: F.max(c.cast("int"))
    found = rows.groupBy("estab").agg(flag(F.col("serious") + F.col("willful") + F.col("repeat") > 0).alias("swr"), flag(F.col("severe_injuries") > 0).alias("injury"), flag(F.coalesce("__large", F.lit(False))).alias("large_penalty"))
    return history.select("estab").join(found, "estab")


def stratum_rates(rows: DataFrame, strata: list, targets: dict[str, str]) -> DataFrame:
    """rows with the mean of each target (its new name: the column) over the row's stratum: probability heads without a model."""
    names = [f"__s{i}" for i in range(len(strata))]
    placed = rows.withColumns(dict(zip(names, strata)))
    rates = placed.groupBy(*names).agg(*[F.avg(c).alias(n) for n, c in targets.items()])
    return placed.join(rates, names).drop(*names)


def composite(p_swr: Column, p_injury: Column, p_penalty: Column) -> Column:
    """D6, 0 to 100: the weights are fixed values."""
    return 100 * (0.578 * p_swr + 0.256 * p_injury + 0.165 * p_penalty)


def shrunk_and_stretched(scored: DataFrame, *, prior: float = 15.0, depth: float = 5.0) -> DataFrame:
    """Scores drawn to the prior where there are few inspections, then the square of their
    percentile, rescaled to 0 to 100. depth is the number of inspections that keeps 63 % of the distance."""
    n = F.col("n_inspections")
    rows = scored.withColumn("shrunk", F.round(prior + (F.col("score") - prior) * (1 - F.exp(-n / depth)), 9))
    ranked = percent_ranks(rows, "shrunk", "__p").withColumn("stretched", F.pow("__p", 2) * 100).drop("__p")
    ends = F.broadcast(ranked.agg(F.min("stretched").alias("__lo"), F.max("stretched").alias("__hi")))  # one row
    rescaled = F.coalesce(F.try_divide(F.col("stretched") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * 100, F.col("stretched"))
    return ranked.crossJoin(ends).withColumn("rescaled", rescaled).drop("__lo", "__hi")


def inspection_strata(frame: DataFrame, again: str, strata: list, *, floor: float = 0.05) -> DataFrame:
    """D4 by strata: 1 / share of the stratum that was inspected again, the share at least floor."""
    rated = stratum_rates(frame.withColumn("__again", F.col(again).cast("double")), strata, {"__share": "__again"})
    return rated.withColumn("weight", 1 / F.greatest(F.col("__share"), F.lit(floor))).drop("__again", "__share")


def weight_grid(rows: DataFrame, heads: tuple[str, str, str], steps: int = 4) -> DataFrame:
    """Rows once for each three weights in steps that sum to one, with the weighted score."""
    grid = [(a, b, steps - a - b) for a in range(steps + 1) for b in range(steps + 1 - a)]
    combos = F.explode(F.array(*[F.struct(*[F.lit(x / steps).alias(f"w{i}") for i, x in enumerate(g, 1)]) for g in grid])).alias("w")
    spread = rows.select("*", combos).select("*", "w.*").drop("w")
    return spread.withColumn("blend", F.round(sum((F.col(f"w{i}") * F.col(h) for i, h in enumerate(heads, 1)), F.lit(0.0)), 9))


def probability_metrics(df: DataFrame, p: str, y: str, key: str) -> DataFrame:
    """Brier skill, average precision, top-decile lift and top-10 % capture of a
    probability, one row. Precision at each positive comes from running counts."""
    rows = running_totals(df.select(key, p, y), [F.col(p).desc(), F.col(key)], {"__hits": y})
    size = F.broadcast(df.agg(F.count(F.lit(1)).alias("__n")))
    top = F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("__n") * 0.1, 0))
    out = rows.crossJoin(size).agg(
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(y).alias("prevalence"), (F.sum(F.col("__hits") / F.col("rank") * F.col(y)) / F.sum(y)).alias("average_precision"),
        (F.avg(F.when(top, F.col(y))) / F.avg(y)).alias("top_decile_lift"), (F.sum(F.when(top, F.col(y))) / F.sum(y)).alias("top_decile_capture"),
    )
    return out.withColumn("brier_skill", 1 - F.col("brier") / (F.col("prevalence") * (1 - F.col("prevalence"))))


def score_distribution(sites: DataFrame) -> DataFrame:
    """Stored distribution of scores to one decimal, with the share at or below each."""
    counts = sites.groupBy(F.bround("score", 1).alias("value")).agg(F.count(F.lit(1)).alias("n"))  # at most 1,001 values
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(0))))
