"""Sites to companies: scores under evidence ceilings, roll-ups, systemic flags, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.functions.labels import sector_label
from riskledger.functions.scores import ceiling, heuristic_label, normal_percentile, recommendation
from riskledger.operators.ranking import percentiles, running_totals


def site_scores(features: DataFrame, *, label: Column | None = None) -> DataFrame:
    """F1 + F4: each site's score under its evidence ceiling, and whether that capped it."""
    raw = heuristic_label({c: F.col(c) for c in features.columns}) if label is None else label
    out = features.withColumn("raw_score", raw).withColumn("ceiling", ceiling(F.col("n_inspections"), F.col("fatalities"), F.col("willful")))
    return out.withColumns({"score": F.least("raw_score", "ceiling"), "capped": F.col("raw_score") > F.col("ceiling")})


def company_rollup(sites: DataFrame, keys: list[str], *, high: float = 60.0, elevated: float = 45.0) -> DataFrame:
    """A6 + A7 + F5: one row per company; systemic if most sites score high, or if several
    have willful or repeat violations and the mean is elevated."""
    n = F.col("n_inspections")
    medians = percentiles(sites.select(*keys, "score"), keys, "score", {"median_score": 0.5}).drop("n")  # no company's scores in one task
    out = sites.groupBy(*keys).agg(
        (F.sum(F.col("score") * n) / F.sum(n)).alias("weighted_score"), F.max("score").alias("max_score"), F.count(F.lit(1)).alias("sites"),
        F.count_if(F.col("score") >= high).alias("high_sites"), F.count_if((F.col("willful") + F.col("repeat")) > 0).alias("wr_sites"), F.sum(n).alias("n_inspections"),
    )
    out = out.join(medians, keys, "left").withColumn("concentration", F.col("high_sites") / F.col("sites"))
    systemic = (F.col("concentration") > 0.5) | ((F.col("sites") >= 2) & (F.col("wr_sites") >= 2) & (F.col("weighted_score") >= elevated))
    out = out.withColumn("systemic", systemic)
    return out.withColumn("recommendation", recommendation(F.col("weighted_score"), F.col("sites"), F.col("systemic")))


def population_percentile(scored: DataFrame, population: DataFrame, *, score: str = "score") -> DataFrame:
    """Scored with percentile, 100 times the share of the population's scores at or under the
    row's own: the distinct scores of both are put in one order, and running counts tell."""
    values = population.select(F.col("score").alias("__v")).groupBy("__v").agg(F.count(F.lit(1)).alias("__c"))
    asked = scored.select(F.col(score).alias("__v")).distinct().withColumn("__c", F.lit(0).cast("long"))
    counts = values.unionByName(asked).groupBy("__v").agg(F.sum("__c").alias("__c"))
    ranks = running_totals(counts, ["__v"], {"__upto": "__c"}, "__r").select("__v", "__upto")
    size = F.broadcast(population.agg(F.count(F.lit(1)).alias("__n")))  # one row
    return scored.join(ranks, scored[score].eqNullSafe(ranks["__v"])).crossJoin(size).withColumn("percentile", 100 * F.col("__upto") / F.col("__n")).drop("__v", "__upto", "__n")


def warnings(companies: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """F8: texts on the range of site scores and the number of high sites (empty for one site)."""
    ranges = sites.groupBy(*keys).agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    many = F.col("sites") > 1
    text = lambda c: F.bround(c, 0).cast("int")
    spread = F.format_string("This score aggregates %d establishments, whose own scores lie between %d and %d.", "sites", text("__lo"), text("__hi"))
    high = F.format_string("%d of %d establishments score as high risk.", "high_sites", "sites")
    return companies.join(ranges, keys).withColumns({"aggregation_warning": F.when(many, spread).otherwise(""), "concentration_warning": F.when(many & (F.col("high_sites") > 0), high).otherwise("")}).drop("__lo", "__hi")


def peer_bullets(sites: DataFrame, stats: DataFrame) -> DataFrame:
    """up to four comparisons with the means of the industry, for z of 0.3 and differences of 10 %
    or more; and the industry's percentile by its violation rate (W6; 50 where it is unknown)."""
    s = F.broadcast(stats.select(F.col("grp").alias("__grp"), F.struct(*stats.columns).alias("__s")))  # at most 11,100 prefix groups
    joined = sites.join(s, F.col("stats_group") == F.col("__grp"), "left")
    kinds = [("relative_violation_rate", "violation_rate", "violation rate"), ("relative_penalty", "penalty", "average penalty"), ("relative_serious_ratio", "serious_ratio", "serious violation ratio"), ("relative_willful_repeat", "willful_repeat", "willful/repeat rate")]
    def bullet(z: str, stat: str, name: str) -> Column:
        mean, std = F.col(f"__s.avg_{stat}"), F.col(f"__s.std_{stat}")
        percent = F.abs(F.try_divide(F.col(z) * std, F.abs(mean))) * 100
        text = F.concat(F.bround(percent, 0).cast("int").cast("string"), F.lit("% "), F.when(F.col(z) > 0, "higher ").otherwise("lower "), F.lit(name + " than "), sector_label(F.col("stats_group")), F.lit(" average"))
        return F.when((F.abs(z) >= 0.3) & (mean != 0) & (percent >= 10), text)
    bullets = F.filter(F.array(*[bullet(*k) for k in kinds]), lambda x: x.isNotNull())
    return joined.withColumn("bullets", F.slice(bullets, 1, 4)).withColumn("industry_percentile", F.coalesce(normal_percentile(F.col("relative_violation_rate")), F.lit(50.0))).drop("__grp", "__s")


def summary(row: dict[str, Column], standards: Column) -> Column:
    """a company's record in sentences. row has the columns of an assessment; standards is an
    array of (standard, n), the most cited first."""
    def some(c: str, one: str, many: str | None = None) -> Column:
        return F.concat(row[c].cast("long").cast("string"), F.lit(" "), F.when(row[c] == 1, one).otherwise(many or one + "s"))

    def when_any(test: Column, *parts: Column) -> Column:
        return F.when(test, F.concat(*parts))

    score = row["risk_score"]
    phrase = F.when(score < 15, "Low risk").when(score < 45, "Moderate risk").when(score < 70, "Elevated risk").otherwise("High risk")
    violations = F.when(row["violations"] > 0, some("violations", "violation")).otherwise("no violations")
    money = F.when(row["penalties"] > 0, F.concat(F.lit(", $"), F.format_number(row["penalties"], 0), F.lit(" in penalties"))).otherwise("")
    grave = F.concat_ws(", ", *[F.when(row[c] > 0, F.concat(row[c].cast("long").cast("string"), F.lit(f" {name}"))) for c, name in (("serious_or_worse", "serious or worse"), ("willful", "willful"), ("repeat", "repeat"))])
    peers = when_any(~row["missing_naics"], F.lit("Ranks at percentile "), F.bround(row["industry_percentile"], 0).cast("long").cast("string"), F.lit(" of "), row["industry_label"], F.lit("."))
    cited = F.array_join(F.transform(standards, lambda s: F.concat(s["standard"], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", ")
    return F.concat_ws(
        " ", F.concat(phrase, F.lit(": "), some("inspections", "inspection"), F.lit(" with "), violations, money, F.lit(".")), when_any(grave != "", F.lit("Violations: "), grave, F.lit(".")),
        when_any(row["accidents"] > 0, some("accidents", "accident"), F.lit(", "), row["fatalities"].cast("long").cast("string"), F.lit(" fatal.")),
        when_any(row["recent"] > 0, row["recent"].cast("string"), F.lit(" in the last three years.")), F.coalesce(peers, F.lit("No industry code for a comparison with peers.")), when_any(F.size(standards) > 0, F.lit("Most cited: "), cited, F.lit(".")),
    )


def assessments(companies: DataFrame, sites: DataFrame, peers: DataFrame, counts: DataFrame, standards: DataFrame, population: DataFrame, keys: list[str]) -> DataFrame:
    """One row per company with all that a request shows: score, percentile, decision,
    industry, comparisons, warnings and summary.

    companies and sites come from company_rollup and site_scores, peers from
    peer_bullets over the companies' own features, counts has the executive counts, standards
    (keys, standards: array of struct(standard, n)), population the scores of all establishments.
    """
    scored = warnings(companies, sites, keys).withColumn("risk_score", F.bround("weighted_score", 1))
    scored = population_percentile(scored, population.select("score"), score="risk_score").withColumnRenamed("percentile", "percentile_rank")
    industry = peers.select(*keys, F.coalesce("stats_group", "industry_group").alias("industry_group"), "industry_percentile", "bullets", F.col("industry_group").isNull().alias("missing_naics"))
    out = scored.join(counts, keys).join(industry, keys).join(standards, keys, "left").withColumn("industry_label", F.when(F.col("missing_naics"), "Unknown").otherwise(sector_label(F.col("industry_group"))))
    out = out.withColumns({
        "percentile_rank": F.bround("percentile_rank", 1), "comparison": F.array_join("bullets", "; "), "confidence": F.when(F.col("inspections") > 0, 0.9).otherwise(0.4),
        "shown_percentile": F.when(F.col("missing_naics"), F.bround("percentile_rank", 1)).otherwise(F.col("industry_percentile")), "standards": F.coalesce("standards", F.expr("cast(array() as array<struct<standard:string,n:bigint>>)")),
    })
    return out.withColumn("summary", summary({c: F.col(c) for c in out.columns}, F.col("standards")))
