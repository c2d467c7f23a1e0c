"""Learned scores with Spark ML: boosted trees, isotonic calibration, propensity weights, probability heads."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskledger.functions.labels import driver_label
from riskledger.functions.scores import tail_weight
from riskledger.operators.boosting import Forest, fit
from riskledger.operators.features import FEATURES
from riskledger.operators.ranking import written
from riskledger.sources import versions


def hash_split(df: DataFrame, key: str, share: int = 80) -> DataFrame:
    """M2: train is true for about share % of keys, by their MD5, so the same under any partitioning and in any engine."""
    return df.withColumn("train", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100 < share)


def train_scorer(frame: DataFrame, label: str, *, trees: int = 500, depth: int = 5, rate: float = 0.05, subsample: float = 0.8, min_leaf: int = 3, alpha: float | None = 0.95, seed: int = 42) -> Forest:
    """M3 / M4: boosted regression trees with tail weights and Huber loss, clipped at the quantile alpha (None: squared
    loss). Trees compare features one by one, so scaling them first, as the reference does, changes nothing."""
    rows = frame.withColumn("weight", tail_weight(F.col(label)))
    return fit(rows, FEATURES, label, "weight", "estab", trees=trees, depth=depth, rate=rate, subsample=subsample, min_leaf=min_leaf, alpha=alpha, seed=seed)


def importances(model: Forest, spark) -> DataFrame:
    """M9: importance by feature (46 rows)."""
    return spark.createDataFrame(list(zip(FEATURES, map(float, model.importances()))), "feature string, weight double")


def correlation_weights(frame: DataFrame, label: str) -> DataFrame:
    """Weights of the features without a model: how far each goes with the label, in one pass (46 rows)."""
    one = frame.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.abs(F.corr(F.col(c), F.col(label))), F.lit(0.0)).alias("weight")) for c in FEATURES]).alias("w"))
    return one.select(F.inline("w"))


def top_weights(weights: DataFrame, most: int = 15, drivers: int = 3) -> DataFrame:
    """K3: the largest weights (feature, weight; one row per feature), the first of them drivers, with
    their share of the largest (W8) and what they are called (H17)."""
    w = Window.orderBy(F.desc("weight"), "feature")
    ranked = weights.withColumn("rank", F.row_number().over(w)).withColumn("share", F.try_divide("weight", F.max("weight").over(Window.partitionBy(F.lit(0)))))
    return ranked.filter(F.col("rank") <= most).select("feature", driver_label(F.col("feature")).alias("label"), "weight", "share", "rank", (F.col("rank") <= drivers).alias("driver"))


def weight_overlap(one: DataFrame, other: DataFrame, most: int = 10) -> DataFrame:
    """Features among the most of both models, and the share of all weight that each model's first feature has."""
    place = lambda df: df.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("weight"), "feature")))
    a, b = place(one).filter(F.col("__r") <= most), place(other).filter(F.col("__r") <= most)
    lead = lambda df, name: df.agg((F.max("weight") / F.sum("weight")).alias(name))
    both = a.join(b, "feature").agg(F.count(F.lit(1)).alias("both"))
    return both.crossJoin(lead(one, "dominance")).crossJoin(lead(other, "dominance_other"))


def calibration_bins(pairs: DataFrame, *, width: float = 5.0, least: int = 3) -> DataFrame:
    """M5: mean outcome by score bin, for bins with least or more pairs (at most 20 rows)."""
    bins = F.greatest(F.lit(0), F.least(F.floor(F.col("score") / width), F.lit(int(100 / width) - 1)))
    return pairs.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("adverse").alias("mean")).filter(F.col("n") >= least).select("bin", "n", "mean", ((F.col("bin") + 0.5) * width).alias("mid"))


@dataclass
class Calibrator:
    """Outcomes that rise with the score, and where they begin and end."""

    bins: DataFrame
    model: object
    low: float
    high: float


def fit_calibrator(pairs: DataFrame, *, least_pairs: int = 10, least_bins: int = 3) -> Calibrator | None:
    """M5: isotonic regression of mean outcomes on the middles of score bins; None with fewer
    pairs or bins. M7 fits it on real outcomes and asks for 100 pairs."""
    bins = written(calibration_bins(pairs), "bins")
    if pairs.count() < least_pairs or bins.count() < least_bins:
        return None
    model = IsotonicRegression(featuresCol="mid", labelCol="mean", predictionCol="fitted").fit(bins)
    fitted = model.transform(bins)
    low, high = fitted.agg(F.min("fitted"), F.max("fitted")).first()
    return Calibrator(fitted, model, low, high)


def calibrate(scored: DataFrame, calibrator: Calibrator | None, score: str = "score") -> DataFrame:
    """M6: calibrated 0 to 100; scores pass through without a calibrator or span."""
    if calibrator is None or calibrator.high - calibrator.low < 1e-6:
        return scored.withColumn("calibrated", F.col(score))
    out = calibrator.model.setFeaturesCol(score).setPredictionCol("__fit").transform(scored)
    part = (F.col("__fit") - calibrator.low) / (calibrator.high - calibrator.low) * 100
    return out.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(100.0), part))).drop("__fit")


def inspection_weights(frame: DataFrame, inspected: str, columns: list[str], *, floor: float = 0.05) -> DataFrame:
    """1 / propensity of being inspected again, the propensity at least floor."""
    ready = VectorAssembler(inputCols=columns, outputCol="__x").transform(frame)
    model = LogisticRegression(featuresCol="__x", labelCol=inspected, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y", regParam=0.01).fit(ready)
    p = vector_to_array("__p")[1]
    return model.transform(ready).withColumn("weight", 1 / F.greatest(p, F.lit(floor))).drop("__x", "__p", "__r", "__y")


def probability_head(frame: DataFrame, target: str, out: str = "probability", *, trees: int = 20, depth: int = 3, seed: int = 42) -> DataFrame:
    """Probability of a 0/1 target by boosted trees. Of all rows, dealt by their first column, 60 % grow the
    trees (part fit), 20 % calibrate them isotonically (part calibrate), and 20 % are seen by neither (part test).
    A target of one kind only is its own probability."""
    place = F.pmod(F.xxhash64(F.col(frame.columns[0]).cast("string")), F.lit(5))
    part = F.when(place < 3, "fit").when(place == 3, "calibrate").otherwise("test")
    split = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(frame).withColumn("part", part)
    kinds = {r["part"]: r["n"] for r in split.groupBy("part").agg(F.countDistinct(target).alias("n")).collect()}
    if kinds.get("fit", 0) < 2:
        return split.withColumn(out, F.col(target).cast("double")).drop("__x")
    model = GBTClassifier(featuresCol="__x", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(split.filter("part = 'fit'"))
    scored = model.transform(split).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    if kinds.get("calibrate", 0) < 2:
        return scored.withColumn(out, F.col("raw")).drop("__x", "raw")
    iso = IsotonicRegression(featuresCol="raw", labelCol=target, predictionCol=out).fit(scored.filter("part = 'calibrate'"))
    return iso.transform(scored).drop("__x", "raw")


def expected_value(frame: DataFrame, target: str, out: str, *, trees: int = 20, depth: int = 3, seed: int = 42) -> DataFrame:
    """Expectation of a column that is often 0: the probability that it is not, times what a
    regression of its logarithm says where it is not (a hurdle)."""
    rows = frame.withColumn("__some", (F.col(target) > 0).cast("int"))
    rows = probability_head(rows, "__some", "__p", trees=trees, depth=depth, seed=seed)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(rows).withColumn("__log", F.log1p(F.col(target).cast("double")))
    positive = ready.filter("part = 'fit' and __some = 1")
    if positive.isEmpty():
        return rows.withColumn(out, F.lit(0.0)).drop("__some", "__p")
    model = GBTRegressor(featuresCol="__x", labelCol="__log", predictionCol="__amount", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(positive)
    return model.transform(ready).withColumn(out, F.col("__p") * F.expm1("__amount")).drop("__some", "__p", "__x", "__log", "__amount")


# ---- published models -------------------------------------------------------------------


def usable(published: DataFrame, as_of: datetime.date, features: list[str], *, max_age_days: int = 7) -> DataFrame:
    """Of published models (built, features) the age, and whether they are fresh and know the same features in the same order."""
    age = F.datediff(F.lit(as_of), "built")
    same = F.col("features") == F.array(*[F.lit(f) for f in features])
    return published.withColumns({"age": age, "fresh": age.between(0, max_age_days - 1), "same_features": same}).withColumn("usable", F.col("fresh") & F.col("same_features"))


def fingerprint(rows: DataFrame) -> str:
    """What tells one population from another, whatever the order of its rows: their number and the sum of their hashes.
    Sums of doubles end in other bits whenever they are added in another order, so doubles count as single floats."""
    h = F.xxhash64(*[F.col(c).cast("float") if kind == "double" else F.col(c) for c, kind in rows.dtypes])
    n, one, two = rows.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{n}:{one}:{two}"


def publish(model: Forest, base: str, spark, built: datetime.date, establishments: int, data: str) -> None:
    """The model and what says when and from what it was built, as one version that readers see whole or not at all."""
    version = versions.new_version(spark, base)
    model.save(spark, version)
    versions.commit(spark, base, version, {"built": built.isoformat(), "features": model.names, "establishments": establishments, "data": data})


def load_or_build(base: str, spark, as_of: datetime.date, build, population: DataFrame, *, least: int = 5) -> tuple[Forest | None, bool]:
    """The published model if it is usable (S11) and was built from this very population, else a new one,
    published in turn; whether it is new. None where the population has fewer than least establishments."""
    data, found = fingerprint(population), versions.current(spark, base)
    if found is not None:
        version, about = found
        row = spark.createDataFrame([(datetime.date.fromisoformat(about["built"]), about["features"])], "built date, features array<string>")
        if about["data"] == data and not usable(row, as_of, FEATURES).filter("usable").isEmpty():
            return Forest.load(spark, version), False
    n = int(data.split(":")[0])
    if n < least:
        return None, False
    model = build(population)
    publish(model, base, spark, as_of, n, data)
    return model, True
