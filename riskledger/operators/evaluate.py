"""How well scores anticipate later outcomes: deciles, thresholds, capture, correlation, bands, curves.

Frames are (key, score, outcome...) of establishments. Ranks over all rows come from
global_rank, which numbers ranges in parallel; fractions and edges are small literal tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.functions.scores import adverse_outcome, tier
from riskledger.operators.ranking import average_ranks, global_rank, grouped_rank, percentiles, running_totals, written

#: The primes of the 64-bit xxHash.
XXH64_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def future_outcomes(history: DataFrame, future_facts: DataFrame, key: str = "estab") -> DataFrame:
    """What the inspections after the cutoff found at each establishment of history; null where there was none."""
    n = F.count(F.lit(1))
    f = future_facts.groupBy(key).agg(n.alias("n_future"), F.sum("n_violations").alias("violations"), *[F.sum(c).alias(c) for c in ("serious", "willful", "repeat", "accidents", "fatalities", "injuries", "penalty")], (F.count_if(F.col("accidents") > 0) / n).alias("severe_rate"))
    f = f.withColumn("willful_repeat", F.col("willful") + F.col("repeat"))
    f = f.withColumns({"violation_rate": F.col("violations") / F.col("n_future"), "swr": ((F.col("serious") + F.col("willful_repeat")) > 0).cast("int"), "fatality": (F.col("fatalities") > 0).cast("int"), "adverse": adverse_outcome(F.col("fatalities"), F.col("willful_repeat"), F.col("serious"), F.col("penalty"), F.col("violations"), F.col("n_future"))})
    out = history.select(key).join(f, key, "left")
    return out.withColumns({"has_future_data": F.col("n_future").isNotNull(), "n_future": F.coalesce("n_future", F.lit(0))})


def paired(scored: DataFrame, outcomes: DataFrame, key: str = "estab") -> DataFrame:
    """Scored establishments that have an outcome."""
    o = outcomes.filter("has_future_data").select(key, "adverse", "swr", "fatality", "violation_rate", F.log1p("penalty").alias("log_penalty"))
    return scored.select(key, "score", "n_inspections", "recent", F.coalesce(F.substring("industry_group", 1, 2), F.lit("unknown")).alias("sector")).join(o, key)


def total(df: DataFrame, *aggregates: Column) -> DataFrame:
    """df with aggregates over all of it, as columns (one row is broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def decile_bins(df: DataFrame, *, bins: int = 10, key: str = "estab", score: str = "score") -> DataFrame:
    """Decile of each row by score, ties by key: max(1, ceil((rank - 1) * bins / (n - 1)))."""
    ranked = total(global_rank(df, [score, key]), F.count(F.lit(1)).alias("__n"))
    at = F.ceil(F.try_divide((F.col("rank") - 1) * bins, F.col("__n") - 1))
    return ranked.withColumn("decile", F.greatest(F.lit(1), F.coalesce(at, F.lit(1))).cast("int")).drop("__n")


def decile_summary(df: DataFrame, outcome: str = "adverse", **options) -> DataFrame:
    """E1."""
    binned = written(decile_bins(df, **options), "deciles")
    out = binned.groupBy("decile").agg(F.min("score").alias("score_lo"), F.max("score").alias("score_hi"), F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean_outcome"))
    middle = percentiles(binned, ["decile"], outcome, {"median_outcome": 0.5}).drop("n")
    out = total(out.join(middle, "decile", "left"), *[F.try_divide(F.sum(F.col("mean_outcome") * F.col("n")), F.sum("n")).alias("__mean")])
    return out.withColumn("lift", F.try_divide("mean_outcome", "__mean")).drop("__mean")


def threshold_table(df: DataFrame, target: str = "swr", thresholds: tuple[int, ...] = (20, 30, 40, 50, 60)) -> DataFrame:
    """One pass; a row is counted once for each threshold."""
    rows = df.select("score", (F.col(target) == 1).alias("pos"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    flag = F.col("score") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count_if(flag & F.col("pos")).alias("TP"), F.count_if(flag & ~F.col("pos")).alias("FP"), F.count_if(~flag & ~F.col("pos")).alias("TN"), F.count_if(~flag & F.col("pos")).alias("FN"))
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    n = tp + fp + tn + fn
    out = out.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "flagged": (tp + fp) / n, "prevalence": (tp + fn) / n})
    return out.withColumns({"f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "lift": F.try_divide("precision", "prevalence")})


def top_ranked(df: DataFrame, fractions: tuple[float, ...], *, key: str = "estab", score: str = "score") -> DataFrame:
    """Rows of the top max(1, round(n * fraction)) by score, once for each fraction; ties by key."""
    ranked = total(global_rank(df, [F.col(score).desc(), F.col(key)]), F.count(F.lit(1)).alias("__n"))
    k = lambda f: F.greatest(F.lit(1), F.bround(F.col("__n") * f, 0))
    return ranked.withColumn("fraction", F.explode(F.filter(F.array(*[F.when(F.col("rank") <= k(f), F.lit(f)) for f in fractions]), lambda x: x.isNotNull()))).drop("__n")


def capture(df: DataFrame, fractions: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """E3 (W4): share of two targets that the top fractions hold, and lifts."""
    out = top_ranked(df, fractions).groupBy("fraction").agg(F.count(F.lit(1)).alias("n"), F.sum("adverse").alias("a"), F.sum("swr").alias("s"), F.avg("adverse").alias("am"), F.avg("swr").alias("sm"))
    base = df.agg(F.sum("adverse").alias("ta"), F.sum("swr").alias("ts"), F.avg("adverse").alias("ma"), F.avg("swr").alias("ms"))
    return out.crossJoin(F.broadcast(base)).select("fraction", "n", F.try_divide("a", "ta").alias("adverse_captured"), F.try_divide("s", "ts").alias("swr_captured"), F.try_divide("am", "ma").alias("adverse_lift"), F.try_divide("sm", "ms").alias("swr_lift"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """E5: rank and plain correlation of two columns, one row."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = average_ranks(average_ranks(rows, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("spearman"), F.corr("x", "y").alias("pearson"), F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, x: str, targets: list[str]) -> DataFrame:
    """E5 for several targets, a row each: all are ranked at once, as groups of one long frame."""
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("target"), F.col(y).cast("double").alias("y")) for y in targets])).alias("t")
    rows = df.select(F.col(x).cast("double").alias("x"), each).select("t.target", "x", "t.y").filter("x is not null and y is not null")
    ranked = average_ranks(average_ranks(rows, "x", "rx", ["target"]), "y", "ry", ["target"])
    found = ranked.groupBy("target").agg(F.corr("rx", "ry").alias("spearman"), F.corr("x", "y").alias("pearson"), F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(y,) for y in targets], "target string")
    return names.join(found, "target", "left").select("target", "spearman", "pearson", F.coalesce("n", F.lit(0)).alias("n"))


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of a fixed, short list of frames."""
    return reduce(DataFrame.unionByName, frames)


def aurocs(df: DataFrame, targets: dict[str, Column], *, least: int = 10, score: str = "score", groups: list[str] | None = None) -> DataFrame:
    """Of each target (name: boolean column) and group the area under the curve, by the sum
    of the positives' average ranks; null with fewer than least positives or negatives."""
    groups = groups or []
    ranked = written(average_ranks(df, score, "__rank", groups), "areas")
    out = []
    for name, positive in targets.items():
        hit = positive.cast("int")
        one = ranked.groupBy(*groups).agg(F.sum(F.when(hit == 1, F.col("__rank"))).alias("__r"), F.coalesce(F.sum(hit), F.lit(0)).alias("pos"), F.coalesce(F.sum(1 - hit), F.lit(0)).alias("neg"))
        area = (F.col("__r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
        enough = (F.col("pos") >= least) & (F.col("neg") >= least)
        out.append(one.select(F.lit(name).alias("target"), *groups, "pos", "neg", F.when(enough, area).alias("auroc")))
    return union(out)


def group_report(df: DataFrame, group: Column, name: str, *, least: int = 1) -> DataFrame:
    """By group (of least rows or more) its size, rank correlation of score and
    outcome, lift of its top decile, and means. Ranks are those inside the group."""
    rows = written(df.select("estab", "score", "adverse", group.alias(name)), "groups")
    ranked = average_ranks(average_ranks(rows, "score", "__a", [name]), "adverse", "__b", [name])
    size = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("adverse").alias("mean_adverse"))
    placed = grouped_rank(rows, [name], [F.col("score").desc(), "estab"], "__place").join(size.select(name, "n"), name)
    top = placed.filter(F.col("__place") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.1, 0))).groupBy(name).agg(F.avg("adverse").alias("__top"))
    out = size.filter(F.col("n") >= least).join(ranked.groupBy(name).agg(F.corr("__a", "__b").alias("spearman")), name).join(top, name)
    return out.select(name, "n", "spearman", F.try_divide("__top", "mean_adverse").alias("top_decile_lift"), "mean_score", "mean_adverse")


def score_bands(df: DataFrame, width: int = 20) -> DataFrame:
    """E8."""
    band = F.least(F.floor(F.col("score") / width), F.lit(100 // width - 1)).cast("int")
    rows = df.withColumn("band", band)
    out = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg("adverse").alias("mean_adverse"), F.avg("swr").alias("swr_rate"), F.avg("fatality").alias("fatality_rate"),
        F.avg("violation_rate").alias("mean_rate"), F.avg("log_penalty").alias("mean_log_penalty"),
    )
    return out.join(percentiles(rows, ["band"], "adverse", {"median_adverse": 0.5}).drop("n"), "band", "left")


def by_tier(df: DataFrame) -> DataFrame:
    """E9."""
    return df.groupBy(tier(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.avg("adverse").alias("mean_adverse"), F.avg("score").alias("mean_score"))


def bootstrap_spearman(df: DataFrame, *, key: str = "estab", resamples: int = 500, seed: int = 42) -> DataFrame:
    """95 % interval of the rank correlation under seeded Poisson weights of each row and resample."""
    ranked = average_ranks(average_ranks(df.select(key, "score", "adverse"), "score", "x"), "adverse", "y")
    x, y = F.col("x"), F.col("y")
    m = resampled_sums(ranked, key, {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}, resamples=resamples, seed=seed)
    rho = F.expr("(n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))")
    return m.select(rho.alias("rho")).agg(F.percentile("rho", F.lit(0.025)).alias("lo"), F.percentile("rho", F.lit(0.975)).alias("hi"), F.avg("rho").alias("mean"))


def rolling_mean(df: DataFrame, *, key: str = "estab", share: float = 0.08, least: int = 50) -> DataFrame:
    """Centred mean of the outcome over score order; null where under a quarter of the
    width is there. A mean is the difference of two running sums, met by their ranks."""
    rows = df.select(key, "score", "adverse", F.col("adverse").isNotNull().cast("long").alias("__one"))
    ranked = written(running_totals(rows, ["score", key], {"__sum": "adverse", "__seen": "__one"}), "rolling")
    n = ranked.count()
    width = max(least, int(share * n))
    low, high = F.col("rank") - width // 2 - 1, F.least(F.col("rank") + (width - 1) // 2, F.lit(n))
    edge = lambda s: ranked.select(F.col("rank").alias(f"__{s}"), F.col("__sum").alias(f"__sum_{s}"), F.col("__seen").alias(f"__seen_{s}"))
    met = ranked.select(key, "score", low.alias("__lo"), high.alias("__hi")).join(edge("hi"), "__hi").join(edge("lo"), "__lo", "left")
    seen = F.col("__seen_hi") - F.coalesce("__seen_lo", F.lit(0))
    mean = (F.col("__sum_hi") - F.coalesce("__sum_lo", F.lit(0.0))) / seen
    return met.select(key, "score", F.when((seen >= width // 4) & (seen > 0), mean).alias("smooth"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int = 40) -> DataFrame:
    """Density of a column over equal bins: of all rows, and of the quarter with the worst outcomes."""
    width = (hi - lo) / bins
    edge = percentiles(df, [], "adverse", {"__edge": 0.75}).select("__edge")
    b = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    rows = df.filter(F.col(column).between(lo, hi)).crossJoin(F.broadcast(edge)).withColumn("__worst", F.col("adverse") >= F.col("__edge"))
    out = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("__worst").alias("n_worst"))
    out = total(out, F.sum("n").alias("__t"), F.sum("n_worst").alias("__w"))
    return out.select("bin", "n", "n_worst", (F.col("n") / (F.col("__t") * width)).alias("density"), (F.col("n_worst") / (F.col("__w") * width)).alias("density_worst"))


def gains(df: DataFrame, *, key: str = "estab") -> DataFrame:
    """Every row by descending score, with the share of all adverse outcomes and of all
    serious ones that it and the rows before it hold."""
    ranked = running_totals(df.select(key, "score", "adverse", "swr"), [F.col("score").desc(), key], {"adverse_so_far": "adverse", "swr_so_far": "swr"})
    every = F.broadcast(df.agg(F.sum("adverse").alias("__a"), F.sum("swr").alias("__s")))  # one row
    return ranked.crossJoin(every).select(key, "rank", "adverse_so_far", "swr_so_far", F.try_divide("adverse_so_far", "__a").alias("adverse_share"), F.try_divide("swr_so_far", "__s").alias("swr_share"))


def bootstrap_means(df: DataFrame, *, bins: int = 8, key: str = "estab", resamples: int = 200, seed: int = 42) -> DataFrame:
    """By bin of score between its quantiles the mean outcome and half the width of its 95 %
    interval, under seeded Poisson weights of each row and resample."""
    binned = quantile_bins(df.select(key, "score", "adverse"), "score", bins)
    known = binned.filter("adverse is not null")
    sums = resampled_sums(known, key, {"s": F.col("adverse")}, resamples=resamples, seed=seed, group=F.col("bin"))
    means = sums.select(F.col("g").alias("bin"), F.try_divide("s", "n").alias("m"))
    spread = means.groupBy("bin").agg(((F.percentile("m", F.lit(0.975)) - F.percentile("m", F.lit(0.025))) / 2).alias("half_width"))  # resamples rows a bin
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("adverse").alias("mean")).join(spread, "bin")


def quantile_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """df with bin (from 0): how many inner quantiles of column lie below its value."""
    edges = percentiles(df, [], column, {f"__q{i}": i / bins for i in range(1, bins)}).drop("n")
    out = df.crossJoin(F.broadcast(edges))  # one row
    at = sum(((F.col(column) > F.col(f"__q{i}")).cast("int") for i in range(1, bins)), F.lit(0))
    return out.withColumn("bin", at).drop(*[f"__q{i}" for i in range(1, bins)])


def poisson_edges(most: int = 8) -> np.ndarray:
    """The distribution function of Poisson(1) up to most - 1."""
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)])


def resample_hashes(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of rows' hashes, each taken on by the resamples' numbers (int), a row of the result for each row."""
    p = [np.uint64(x) for x in XXH64_PRIMES]
    rotated = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    v = (h.view(np.uint64)[:, None] + p[4] + np.uint64(4)) ^ (b.astype(np.uint64)[None, :] * p[0])
    v = rotated(v, 23) * p[1] + p[2]
    v = (v ^ (v >> np.uint64(33))) * p[1]
    v = (v ^ (v >> np.uint64(29))) * p[2]
    return v ^ (v >> np.uint64(32))


def resampled_sums(df: DataFrame, key: str, values: dict[str, Column], *, resamples: int, seed: int, group: Column | None = None) -> DataFrame:
    """(g, b, n, values...): for each group and resample b from 1 the sum of its rows' weights and the weighted sums of the
    values (null: 0). A row's weight in a resample is a draw from Poisson(1), by the hash of seed, key and b. Rows are not
    repeated: a task adds a vector of resamples for each group, and hands these on."""
    names = list(values)
    rows = df.select((F.lit(0) if group is None else group).cast("long").alias("g"), F.xxhash64(F.lit(seed), key).alias("h"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(c) for c, v in values.items()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        numbers, edges = np.arange(1, resamples + 1), poisson_edges()
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                u = (resample_hashes(batch["h"].to_numpy(), numbers) >> np.uint64(11)) / float(1 << 53)
                w = np.searchsorted(edges, u, "left").astype(np.float64)
                m = np.stack([np.ones(batch.num_rows), *[batch[c].to_numpy() for c in names]])
                g = batch["g"].to_numpy()
                for one in np.unique(g).tolist():
                    own = g == one
                    held[one] = held.get(one, 0.0) + m[:, own] @ w[own]
        for one, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(resamples, one)), pa.array(numbers), *map(pa.array, sums)], ["g", "b", "n", *names])

    parts = rows.mapInArrow(add, "g long, b long, n double, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("g", "b").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def diagnostics(df: DataFrame, thresholds: tuple[int, ...] = (20, 30, 40, 50, 60), *, common: int = 10) -> DataFrame:
    """E13 as (measure, place, value): number of distinct scores, deviation, share of the largest
    bunch of equal scores (to one decimal), shares at or over thresholds, and the commonest scores."""
    bunches = df.groupBy(F.bround("score", 1).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None).cast("double")
    row = lambda name, at, value: F.struct(F.lit(name).alias("measure"), at.cast("double").alias("place"), value.cast("double").alias("value"))
    n = F.count(F.lit(1))
    shares = [row("share_over", F.lit(t), F.count_if(F.col("score") >= t) / n) for t in thresholds]
    whole = df.agg(F.array(row("unique", nothing, F.countDistinct("score")), row("deviation", nothing, F.stddev_pop("score")), *shares).alias("r"))
    largest = bunches.agg(F.array(row("largest_bunch", nothing, F.max("n") / F.sum("n"))).alias("r"))
    often = bunches.orderBy(F.desc("n"), "place").limit(common).select(F.lit("common").alias("measure"), F.col("place").cast("double").alias("place"), F.col("n").cast("double").alias("value"))
    return union([whole.select(F.inline("r")), largest.select(F.inline("r")), often])


def regression_quality(df: DataFrame, train: Column) -> DataFrame:
    """Errors of score against outcome, R2, bias, correlation of residual and outcome, and how
    much larger the mean error is outside the training rows."""
    miss = F.col("score") - F.col("adverse")
    inside, outside = F.avg(F.when(train, F.abs(miss))), F.avg(F.when(~train, F.abs(miss)))
    return df.agg(
        F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"), (1 - F.avg(miss * miss) / F.var_pop("adverse")).alias("r2"), F.avg(miss).alias("bias"),
        F.corr(miss, F.col("adverse")).alias("residual_corr"), (outside - inside).alias("gap"),
    )


def tier_confusion(df: DataFrame) -> DataFrame:
    """Rows by tier of score and tier of outcome, each with accuracy, recall of the high
    tier, precision of the low one, and the share of misses by two tiers."""
    a, b = tier(F.col("score")), tier(F.col("adverse"))
    share = lambda hit, of: F.try_divide(F.count_if(hit & of), F.count_if(of))
    every = F.lit(True)
    apart = ((a == "Low") & (b == "High")) | ((a == "High") & (b == "Low"))
    summary = df.agg(share(a == b, every).alias("accuracy"), share(a == "High", b == "High").alias("high_recall"), share(b == "Low", a == "Low").alias("low_precision"), share(apart, every).alias("two_apart"))
    return df.groupBy(a.alias("tier_a"), b.alias("tier_b")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(summary))


def end_overlaps(df: DataFrame, other: str, share: float = 0.1) -> DataFrame:
    """How many of the top and of the bottom share by score are there by the other column, too."""
    def both(end: str, direction) -> DataFrame:
        top = lambda c: cut_off(global_rank(df.select("estab", c), [direction(F.col(c)), "estab"]), share).select("estab")
        return top("score").intersect(top(other)).agg(F.count(F.lit(1)).alias("both")).select(F.lit(end).alias("end"), "both")

    return union([both("top", lambda c: c.desc()), both("bottom", lambda c: c.asc())])


def cut_off(ranked: DataFrame, share: float) -> DataFrame:
    """The first max(1, round(n * share)) ranks."""
    return total(ranked, F.count(F.lit(1)).alias("__n")).filter(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("__n") * share, 0))).drop("__n")


def quintiles(df: DataFrame) -> DataFrame:
    """Mean outcome of fifths by score (a remainder is left out), and how often it falls from one to the next."""
    ranked = total(global_rank(df, ["score", "estab"]), F.count(F.lit(1)).alias("__n"))
    fifth = F.floor((F.col("rank") - 1) / F.floor(F.col("__n") / 5)).cast("int")
    out = ranked.withColumn("quintile", fifth).filter("quintile < 5").groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), F.avg("adverse").alias("mean"))
    means = out.agg(F.array_sort(F.collect_list(F.struct("quintile", "mean"))).alias("__m"))  # five entries
    falls = F.size(F.filter(F.sequence(F.lit(1), F.size("__m") - 1), lambda i: F.get("__m", i)["mean"] < F.get("__m", i - 1)["mean"]))
    return out.crossJoin(F.broadcast(means.select(falls.cast("long").alias("inversions"))))


def distribution(df: DataFrame) -> DataFrame:
    """Percentiles, mean, deviation and range of the score, and its deviation by the outcome's."""
    points = percentiles(df, [], "score", {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)}).drop("n")
    rest = df.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), (F.max("score") - F.min("score")).alias("score_range"), (F.stddev_pop("score") / F.stddev_pop("adverse")).alias("std_ratio"))
    return points.crossJoin(rest)
