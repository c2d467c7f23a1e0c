"""Establishment features, industry statistics and the model's feature frame."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.functions.scores import LOGGED, SECTORS, z_score
from riskledger.operators.records import accident_rollup, violation_rollup

RATES = [("relative_violation_rate", "raw_vpi", "violation_rate"), ("relative_penalty", "raw_avg_pen", "penalty"), ("relative_serious_ratio", "raw_serious_rate", "serious_ratio"), ("relative_willful_repeat", "raw_wr_rate", "willful_repeat")]


def majority(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """A4: the most frequent non-null value of each key; the smallest of equals.
    Counts are pre-aggregated, so a hot key sends one row per value and task."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__votes"))
    return votes.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__votes"), F.col(value))).alias(out))


def inspection_facts(inspections: DataFrame, violations: DataFrame, injuries: DataFrame, accidents: DataFrame) -> DataFrame:
    """Inspections with the counts of their violations and accidents (0 if none)."""
    v, a = violation_rollup(violations), accident_rollup(injuries, accidents)
    rows = inspections.join(v, "activity_nr", "left").join(a, "activity_nr", "left")
    return rows.fillna(0, [*v.columns[1:], *a.columns[1:]]).withColumn("estab", F.upper(F.coalesce("estab_name", F.lit("UNKNOWN"))))


def establishment_features(facts: DataFrame, as_of: datetime.date, *, recency_days: int = 1095, keys: tuple[str, ...] = ("estab",)) -> DataFrame:
    """A2: the 17 features by establishment, with counts, raw rates and the industry group."""
    group = F.when(F.col("naics_code").rlike(r"^\d{4,}$"), F.substring("naics_code", 1, 4))
    facts = facts.withColumn("__group", group)
    n, sums = F.count(F.lit(1)), ["n_violations", "serious", "willful", "repeat", "accidents", "fatalities", "injuries"]
    # first by industry, too, whose counts are the votes: facts are read once
    parts = facts.groupBy(*keys, "__group").agg(
        n.alias("n_inspections"), *[F.sum(c).alias(c) for c in sums], F.sum("penalty").alias("total_penalty"), F.max("max_penalty").alias("max_penalty"),
        F.count_if(F.col("open_date") >= F.date_sub(F.lit(as_of), recency_days)).alias("recent"), F.count_if(F.col("accidents") > 0).alias("severe"), F.count_if(F.col("n_violations") == 0).alias("clean"),
        F.sum("gravity_sum").alias("__g"), F.sum("gravity_n").alias("__gn"),
    )
    vote = F.when(F.col("__group").isNotNull(), F.struct(-F.col("n_inspections"), F.col("__group")))
    added = ["n_inspections", *sums, "total_penalty", "recent", "severe", "clean", "__g", "__gn"]
    out = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in added], F.max("max_penalty").alias("max_penalty"), F.min_by("__group", vote).alias("industry_group"))
    per = lambda c: F.col(c) / F.col("n_inspections")
    some = F.greatest(F.col("n_violations"), F.lit(1))
    out = out.withColumns({
        "serious_rate": per("serious"), "willful_rate": per("willful"), "repeat_rate": per("repeat"), "avg_penalty": F.col("total_penalty") / some, "recent_ratio": per("recent"), "severe_rate": per("severe"),
        "violations_per_inspection": per("n_violations"), "accident_rate": per("accidents"), "fatality_rate": per("fatalities"), "injury_rate": per("injuries"), "avg_gravity": F.coalesce(F.try_divide("__g", "__gn"), F.lit(0.0)),
        "penalty_per_inspection": per("total_penalty"), "clean_ratio": per("clean"), "raw_serious_rate": F.col("serious") / some, "raw_wr_rate": (F.col("willful") + F.col("repeat")) / some,
    }).withColumns({"raw_vpi": F.col("violations_per_inspection"), "raw_avg_pen": F.col("avg_penalty")}).drop("__g", "__gn")
    return out


def industry_statistics(features: DataFrame, *, min_sample: int = 10) -> DataFrame:
    """A5: mean and population deviation of four rates by 4-, 3- and 2-digit prefix; groups under min_sample go."""
    prefix = F.explode(F.array(*[F.when(F.length("industry_group") >= d, F.substring("industry_group", 1, d)) for d in (4, 3, 2)])).alias("grp")
    rows = features.filter(F.col("industry_group").isNotNull()).select("raw_vpi", "raw_avg_pen", "raw_serious_rate", "raw_wr_rate", prefix).filter("grp is not null")
    std = lambda c: F.when(F.stddev_pop(c) == 0, 1e-6).otherwise(F.stddev_pop(c))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("count"), *[x for _, c, name in RATES for x in (F.avg(c).alias(f"avg_{name}"), std(c).alias(f"std_{name}"))]).filter(F.col("count") >= min_sample)


def with_industry(features: DataFrame, stats: DataFrame, *, clip: float | None = 3.0) -> DataFrame:
    """The longest prefix that has statistics (4, 3, 2 digits), and the z-scores against it, clipped unless clip is None.

    Prefix groups are at most 11,100 by their digits, which bounds the broadcast.
    """
    out = features
    for d in (4, 3, 2):
        s = stats.select(F.col("grp").alias(f"__k{d}"), F.struct(*stats.columns).alias(f"__s{d}"))
        out = out.join(F.broadcast(s), F.substring("industry_group", 1, d) == F.col(f"__k{d}"), "left").drop(f"__k{d}")
    out = out.withColumn("__s", F.coalesce("__s4", "__s3", "__s2"))
    z = {name: z_score(F.col(raw), F.col(f"__s.avg_{stat}"), F.col(f"__s.std_{stat}"), clip) for name, raw, stat in RATES}
    return out.withColumns(z | {"stats_group": F.col("__s.grp"), "industry_mean_rate": F.col("__s.avg_violation_rate")}).drop("__s", "__s4", "__s3", "__s2")


def with_sectors(features: DataFrame) -> DataFrame:
    """Indicator columns of 24 sectors, and one for unknown."""
    sector = F.substring("industry_group", 1, 2)
    known = F.coalesce(sector.isin(SECTORS), F.lit(False))
    return features.withColumns({f"naics_{s}": F.coalesce(sector == s, F.lit(False)).cast("int") for s in SECTORS} | {"naics_unknown": (~known).cast("int")})


def log_compressed(features: DataFrame) -> DataFrame:
    """P12."""
    return features.withColumns({c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in LOGGED})


FEATURES = [
    "n_inspections", "n_violations", "serious_rate", "willful_rate", "repeat_rate", "total_penalty", "avg_penalty", "max_penalty", "recent_ratio", "severe_rate", "violations_per_inspection",
    "accident_rate", "fatality_rate", "injury_rate", "avg_gravity", "penalty_per_inspection", "clean_ratio", *[name for name, _, _ in RATES], *[f"naics_{s}" for s in SECTORS], "naics_unknown",
]


def feature_frame(features: DataFrame, *, keys: tuple[str, ...] = ("estab",)) -> DataFrame:
    """M1: the 46 model columns; a z-score without statistics is 0."""
    frame = log_compressed(with_sectors(with_industry(features, industry_statistics(features))))
    return frame.fillna(0.0, [name for name, _, _ in RATES]).select(*keys, *FEATURES)


def longest_prefix(codes: DataFrame, column: str, reference: DataFrame, out: str, *, default: str = "Unknown Industry") -> DataFrame:
    """Title of the longest of the 6- to 2-digit prefixes found in reference
    (code, title; one row per code, a code list of bounded size)."""
    for d in (6, 5, 4, 3, 2):
        r = reference.select(F.col("code").alias(f"__c{d}"), F.col("title").alias(f"__t{d}"))
        fits = F.when(F.length(column) >= d, F.substring(column, 1, d))
        codes = codes.join(F.broadcast(r), fits == F.col(f"__c{d}"), "left").drop(f"__c{d}")
    titles = [f"__t{d}" for d in (6, 5, 4, 3, 2)]
    return codes.withColumn(out, F.coalesce(*titles, F.lit(default))).drop(*titles)
