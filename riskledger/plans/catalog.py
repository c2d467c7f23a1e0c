"""Every operator of the library as a query over the given tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskledger.functions import scores as S
from riskledger.operators import evaluate as E
from riskledger.operators import features as X
from riskledger.operators import records as R
from riskledger.operators import rollup as U
from riskledger.operators.ranking import written
from riskledger.operators.search import dealt_names, with_key
from riskledger.plans import oracle_base as O
from riskledger.plans.bindings import AS_OF, CUTOFF, view, with_views


@dataclass
class Tables:
    """The domain tables and the frames that most queries start from."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def names(self) -> DataFrame:
        return dealt_names(view(self.spark, self.sf_dir, "names"))

    @cached_property
    def keyed_names(self) -> DataFrame:
        """Names with their keys, written once: searches read them several times."""
        return written(with_key(self.names), "keyed")

    @cached_property
    def facts(self) -> DataFrame:
        return X.inspection_facts(self.inspections, self.violations, self.injuries, self.accidents)

    @cached_property
    def features(self) -> DataFrame:
        return X.establishment_features(self.facts, AS_OF)

    @cached_property
    def labelled(self) -> DataFrame:
        return U.site_scores(X.with_sectors(self.features))

    @cached_property
    def sites(self) -> DataFrame:
        key = self.inspections.select(F.upper("estab_name").alias("estab"), "company_key").distinct()
        return self.labelled.join(key, "estab")

    @cached_property
    def companies(self) -> DataFrame:
        return U.company_rollup(self.sites, ["company_key"])

    @cached_property
    def history(self) -> DataFrame:
        return U.site_scores(X.with_sectors(X.establishment_features(self.facts.filter(F.col("open_date") < F.lit(CUTOFF)), CUTOFF)))

    @cached_property
    def outcomes(self) -> DataFrame:
        return E.future_outcomes(self.history, self.facts.filter(F.col("open_date") >= F.lit(CUTOFF)))

    @cached_property
    def paired(self) -> DataFrame:
        """Written once: reports read it several times."""
        return written(E.paired(self.history, self.outcomes), "paired")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op(name: str, sql: str | None = None):
    """Register a query under the operator's id, with its SQL."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def many(keys: dict[str, tuple[Callable[[Tables], DataFrame], str | None]]) -> None:
    for name, (f, sql) in keys.items():
        op(name, sql)(f)


V, I = with_views("violations"), with_views("inspections")  # noqa: E741
FEATS = "estab n_inspections n_violations serious willful repeat total_penalty max_penalty recent severe clean accidents fatalities injuries serious_rate willful_rate repeat_rate avg_penalty recent_ratio severe_rate violations_per_inspection accident_rate fatality_rate injury_rate penalty_per_inspection clean_ratio avg_gravity raw_serious_rate raw_wr_rate industry_group".split()
COLS = ", ".join(FEATS)

# ---- projections, filters, predicates -------------------------------------------------
many({
    "P1": (lambda t: R.live(t.violations).groupBy("viol_type").agg(F.count(F.lit(1)).alias("n")),
          f"""{V} SELECT viol_type, count(*) AS n FROM violations WHERE delete_flag IS DISTINCT FROM 'X' GROUP BY 1"""),
    "P2": (lambda t: R.in_window(t.inspections, "open_date", AS_OF, 3).select("activity_nr", "open_date"),
          f"""{I} SELECT activity_nr, open_date FROM inspections WHERE coalesce(open_date, {O.AS_OF}) >= {O.AS_OF} - 1095"""),
    "P3": (lambda t: R.typed(R.live(t.violations)).groupBy("activity_nr").agg(F.sum("penalty").alias("penalty"), F.count_if("is_repeat").alias("n_repeat"), F.count_if("is_willful").alias("n_willful"), F.count_if(F.col("severity") == "Serious").alias("n_serious"), F.count_if(F.col("severity") == "Other").alias("n_other")),
           f"""{V}
      SELECT activity_nr, sum(coalesce(current_penalty, initial_penalty, 0)) AS penalty, count(*) FILTER (viol_type = 'R') AS n_repeat, count(*) FILTER (viol_type = 'W') AS n_willful, count(*) FILTER (viol_type = 'S') AS n_serious, count(*) FILTER (viol_type NOT IN ('R', 'W', 'S')) AS n_other
      FROM violations WHERE delete_flag IS DISTINCT FROM 'X' GROUP BY 1"""),
    "P4": (lambda t: t.violations.withColumn("hazards", R.hazards(F.col("hazsub1"), F.col("hazsub2"))).groupBy("hazards").agg(F.count(F.lit(1)).alias("n")),
          f"""{V} SELECT nullif(concat_ws(', ', CASE WHEN trim(hazsub1) <> '' THEN hazsub1 END, CASE WHEN trim(hazsub2) <> '' THEN hazsub2 END), '') AS hazards, count(*) AS n
      FROM violations GROUP BY 1"""),
    "P5": (lambda t: t.violations.groupBy(R.is_general_duty(F.col("standard")).alias("general_duty")).agg(F.count(F.lit(1)).alias("n")),
          f"""{V} SELECT regexp_matches(regexp_replace(upper(standard), '[^A-Z0-9]', '', 'g'), '^(5A1|OSHACT$|SECTION5$|GENERALDUTY)') AS general_duty, count(*) AS n FROM violations
      GROUP BY 1"""),
    "P6": (lambda t: (lambda v: v.groupBy(R.is_high_priority(v).alias("high_priority")).agg(F.count(F.lit(1)).alias("n")))(R.typed(t.violations)),
          f"""{V} SELECT viol_type IN ('R', 'W') OR trunc(gravity) >= 8 OR coalesce(current_penalty, initial_penalty, 0) > 5000 AS high_priority, count(*) AS n FROM violations
      GROUP BY 1"""),
    "P7": (lambda t: t.facts.select("activity_nr", ((F.col("accidents") > 0) | F.col("insp_type").eqNullSafe("L")).alias("severe")),
          f"""{O.WITH_FACTS} SELECT activity_nr, accidents > 0 OR insp_type = 'L' AS severe FROM facts"""),
    "P12": (lambda t: X.log_compressed(t.features).select("estab", *S.LOGGED),
          f"""{O.WITH_FEATURES} SELECT estab, {', '.join(f'ln(1 + greatest({c}, 0)) AS {c}' for c in S.LOGGED)} FROM feats"""),
    "P13": (lambda t: X.with_sectors(t.features).select("estab", *[f"naics_{s}" for s in S.SECTORS], "naics_unknown"),
          f"""{O.WITH_FEATURES}
      SELECT estab, {', '.join(f'''CAST(coalesce(substr(industry_group, 1, 2) = '{s}', false) AS INT) AS naics_{s}''' for s in S.SECTORS)}, CAST(industry_group IS NULL AS INT) AS naics_unknown
      FROM feats"""),
    "P14": (lambda t: t.inspections.filter("open_date is not null").groupBy((F.col("open_date") < F.lit(CUTOFF)).alias("train")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("estab_name").alias("estabs")),
          f"""{I} SELECT open_date < {O.CUTOFF} AS train, count(*) AS n, count(DISTINCT estab_name) AS estabs FROM inspections WHERE open_date IS NOT NULL GROUP BY 1"""),
    "P15": (lambda t: R.live(t.violations).filter((F.col("issuance_date") > F.lit(CUTOFF)) & (R.penalty(F.col("current_penalty"), F.col("initial_penalty")) > 0)).select("activity_nr", "citation_id", "issuance_date", "viol_type"),
          f"""{V} SELECT activity_nr, citation_id, issuance_date, viol_type FROM violations WHERE delete_flag IS DISTINCT
      FROM 'X' AND issuance_date > {O.CUTOFF} AND coalesce(current_penalty, initial_penalty, 0) > 0"""),
    "P16": (lambda t: t.inspections.filter(F.col("open_date").between(F.lit(CUTOFF.replace(year=CUTOFF.year - 4)), F.lit(CUTOFF))).groupBy(F.year("open_date").alias("year")).agg(F.count(F.lit(1)).alias("n")),
          f"""{I} SELECT CAST(year(open_date) AS INT) AS year, count(*) AS n FROM inspections WHERE open_date BETWEEN DATE '1996-01-01' AND {O.CUTOFF} GROUP BY 1"""),
    "P17": (lambda t: t.inspections.groupBy("estab_name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").orderBy("estab_name").limit(500),
          f"""{I} SELECT estab_name, count(*) AS n FROM inspections GROUP BY 1 HAVING count(*) >= 5 ORDER BY 1 LIMIT 500"""),
})


@op("P8", f"""{I}, req AS (SELECT company_key, min(site_address) AS address FROM inspections WHERE company_key LIKE 'B%' GROUP BY 1 UNION ALL SELECT company_key, 'nowhere'
      FROM inspections WHERE company_key NOT LIKE 'B%'
      GROUP BY 1), m AS (SELECT i.company_key, activity_nr, site_address = address AS hit, bool_or(site_address = address) OVER (PARTITION BY i.company_key) AS found
      FROM inspections i JOIN req USING (company_key)) SELECT company_key, activity_nr FROM m WHERE hit OR NOT found""")
def exact_address(t: Tables) -> DataFrame:
    """Full-address filter of each request, ignored where nothing matches it."""
    i = t.inspections
    req = i.groupBy("company_key").agg(F.min("site_address").alias("lo")).select("company_key", F.when(F.col("company_key").startswith("B"), F.col("lo")).otherwise("nowhere").alias("address"))
    rows = i.select("company_key", "activity_nr", "site_address")
    found = rows.join(req, "company_key").filter(F.col("site_address") == F.col("address")).select("company_key").distinct().withColumn("found", F.lit(True))
    all_rows = rows.join(req, "company_key").join(found, "company_key", "left")
    return all_rows.filter(F.col("found").isNull() | (F.col("site_address") == F.col("address"))).select("company_key", "activity_nr")


@op("P10", f"{O.WITH_FEATURES} SELECT estab, industry_group FROM feats WHERE coalesce(substr(industry_group, 1, 2), '') NOT IN ('31', '32', '33', '52')")
def sector_exclusion(t: Tables) -> DataFrame:
    out = F.broadcast(t.spark.createDataFrame([("31",), ("32",), ("33",), ("52",)], "sector string"))
    return t.features.join(out, F.substring("industry_group", 1, 2) == F.col("sector"), "left_anti").select("estab", "industry_group")


@op("P11", f"""{with_views('inspections', 'violations')} SELECT i.activity_nr, open_date, standard, coalesce(current_penalty, initial_penalty, 0) AS penalty, citation_id
      FROM inspections i JOIN violations v USING (activity_nr) WHERE delete_flag IS DISTINCT
      FROM 'X' AND contains(standard, '1910') AND coalesce(current_penalty, initial_penalty, 0) > 4000 AND open_date >= {O.CUTOFF}
      ORDER BY open_date DESC, i.activity_nr, citation_id, standard, penalty LIMIT 25 OFFSET 25""")
def violation_grid(t: Tables) -> DataFrame:
    """Second page of the flat grid under text, number and date filters."""
    rows = R.nested(t.inspections, t.violations, t.injuries, t.accidents).filter(F.col("open_date") >= F.lit(CUTOFF)).select("activity_nr", "open_date", F.explode("violations").alias("v"))
    rows = rows.select("activity_nr", "open_date", "v.standard", "v.penalty", "v.citation_id").filter(F.col("standard").contains("1910") & (F.col("penalty") > 4000))
    return rows.orderBy(F.desc("open_date"), "activity_nr", "citation_id", "standard", "penalty").offset(25).limit(25)


# ---- joins -------------------------------------------------------------------------
IV = with_views("inspections", "violations")
many({
    "J1": (lambda t: t.inspections.select("activity_nr").join(R.violation_rollup(t.violations), "activity_nr", "left").fillna(0).select("activity_nr", "n_violations", "penalty"),
          f"""{O.WITH_FACTS} SELECT activity_nr, n_violations, penalty FROM facts"""),
    "J2": (lambda t: R.accident_rollup(t.injuries, t.accidents).select("activity_nr", "accidents", "fatalities", "injuries"),
          f"""{O.WITH_FACTS} SELECT activity_nr, accidents, fatalities, CAST(injuries AS BIGINT) AS injuries FROM ar"""),
    "J6": (lambda t: R.live(t.violations).join(t.inspections.filter(F.col("open_date") < F.lit(CUTOFF)), "activity_nr", "left_semi").groupBy("viol_type").agg(F.count(F.lit(1)).alias("n")),
          f"""{IV} SELECT viol_type, count(*) AS n FROM violations WHERE delete_flag IS DISTINCT FROM 'X' AND activity_nr IN (SELECT activity_nr FROM inspections
      WHERE open_date < {O.CUTOFF}) GROUP BY 1"""),
    "J7": (lambda t: t.inspections.join(R.live(t.violations), "activity_nr", "left_anti").select("activity_nr", "estab_name"),
          f"""{IV} SELECT activity_nr, estab_name FROM inspections WHERE activity_nr NOT IN (SELECT activity_nr FROM violations WHERE delete_flag IS DISTINCT FROM 'X')"""),
    "J9": (lambda t: X.with_industry(t.features, X.industry_statistics(t.features)).select("estab", "stats_group", *[n for n, _, _ in X.RATES]),
          f"""{O.WITH_Z} SELECT estab, stats_group, relative_violation_rate, relative_penalty, relative_serious_ratio, relative_willful_repeat FROM zed"""),
    "J12": (lambda t: t.paired, f"{O.WITH_PAIRED} SELECT * FROM paired"),
    "J15": (lambda t: t.facts.filter(F.col("open_date") < F.lit(CUTOFF)).join(t.facts.filter(F.col("open_date") >= F.lit(CUTOFF)), "estab", "left_semi").groupBy("estab").agg(F.count(F.lit(1)).alias("n")),
          f"""{O.WITH_FACTS} SELECT estab, count(*) AS n FROM facts WHERE open_date < {O.CUTOFF} AND estab IN (SELECT estab FROM facts WHERE open_date >= {O.CUTOFF}) GROUP BY 1"""),
    # ---- aggregations
    "A1": (lambda t: R.accident_rollup(t.injuries, t.accidents).agg(F.count(F.lit(1)).alias("inspections"), *[F.sum(c).alias(c) for c in ("accidents", "fatalities", "injuries")]),
          f"""{O.WITH_FACTS}
      SELECT count(*) AS inspections, CAST(sum(accidents) AS BIGINT) AS accidents, CAST(sum(fatalities) AS BIGINT) AS fatalities, CAST(sum(injuries) AS BIGINT) AS injuries
      FROM ar"""),
    "A2": (lambda t: t.features.select(*FEATS), f"{O.WITH_FEATURES} SELECT {COLS} FROM feats"),
    "A4": (lambda t: X.majority(t.inspections, ["company_key"], "naics_code", "naics"),
          f"""{I} SELECT company_key, naics_code AS naics FROM (SELECT company_key, naics_code, count(*) AS n FROM inspections GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY n DESC, naics_code) = 1"""),
    "A5": (lambda t: X.industry_statistics(t.features), f"{O.WITH_STATS} SELECT * FROM stats"),
    "A6": (lambda t: t.companies.select("company_key", "weighted_score", "max_score", "median_score", "sites", "concentration", "n_inspections"),
          f"""{O.WITH_COMPANIES} SELECT company_key, weighted_score, max_score, median_score, sites, concentration, CAST(n_inspections AS BIGINT) AS n_inspections FROM companies"""),
    "A7": (lambda t: t.companies.select("company_key", "systemic", "high_sites", "wr_sites"),
          f"""{O.WITH_COMPANIES} SELECT company_key, systemic, high_sites, wr_sites FROM companies"""),
    "A8": (lambda t: t.outcomes, f"{O.WITH_PAIRED} SELECT * FROM outcomes"),
    "A9": (lambda t: t.inspections.groupBy("company_key", "estab_name").agg(*[F.max(c).alias(c) for c in ("site_city", "site_state", "site_address", "naics_code")]),
          f"""{I} SELECT company_key, estab_name, max(site_city) AS site_city, max(site_state) AS site_state, max(site_address) AS site_address, max(naics_code) AS naics_code
      FROM inspections GROUP BY 1, 2"""),
    "A10": (lambda t: t.inspections.select("estab_name").distinct().orderBy("estab_name"), f"{I} SELECT DISTINCT estab_name FROM inspections"),
    "A11": (lambda t: t.inspections.select("company_key", address(t).alias("location")).distinct(),
          f"""{I}
      SELECT DISTINCT company_key, concat_ws(', ', nullif(site_address, ''), nullif(site_city, ''), nullif(trim(concat_ws(' ', nullif(site_state, ''), nullif(site_zip, ''))), '')) AS location
      FROM inspections"""),
    "A12": (lambda t: executive(t),
          f"""{O.WITH_FACTS}
      SELECT company_key, count(*) AS inspections, CAST(sum(n_violations) AS BIGINT) AS violations, sum(penalty) AS penalties, CAST(sum(willful) AS BIGINT) AS willful, CAST(sum(repeat) AS BIGINT) AS repeat, CAST(sum(serious + willful + repeat) AS BIGINT) AS serious_or_worse, CAST(sum(accidents) AS BIGINT) AS accidents, CAST(sum(fatalities) AS BIGINT) AS fatalities, count(*) FILTER (open_date >= {O.AS_OF} - 1095) AS recent
      FROM facts GROUP BY 1"""),
    "A13": (lambda t: t.facts.join(t.companies.select("company_key", "concentration"), "company_key").groupBy("company_key", "concentration").agg(F.count(F.lit(1)).alias("inspections"), F.sum("n_violations").alias("violations"), F.count_if((F.col("accidents") > 0) | (F.col("insp_type") == "L")).alias("severe"), F.sum(F.col("willful") + F.col("repeat")).alias("willful_repeat")),
          f"""{O.WITH_COMPANIES}
      SELECT company_key, concentration, count(*) AS inspections, CAST(sum(f.n_violations) AS BIGINT) AS violations, count(*) FILTER (f.accidents > 0 OR insp_type = 'L') AS severe, CAST(sum(f.willful + f.repeat) AS BIGINT) AS willful_repeat
      FROM facts f JOIN companies c USING (company_key) GROUP BY 1, 2"""),
    "A14": (lambda t: top_standards(t),
          f"""{IV} SELECT company_key, standard, n, CAST(rank AS INT) AS rank FROM (SELECT company_key, standard, n, row_number() OVER (PARTITION BY company_key
      ORDER BY n DESC, standard) AS rank FROM (SELECT company_key, standard, count(*) AS n FROM inspections JOIN violations USING (activity_nr) WHERE delete_flag IS DISTINCT
      FROM 'X' GROUP BY 1, 2)) WHERE rank <= 3"""),
    "A16": (lambda t: t.inspections.filter(F.col("company_key").contains("NATION_1")).groupBy("company_key", "naics_code").agg(F.count(F.lit(1)).alias("n")),
          f"""{I} SELECT company_key, naics_code, count(*) AS n FROM inspections WHERE contains(company_key, 'NATION_1') GROUP BY 1, 2"""),
})


def address(t: Tables | None = None):
    """Street, city, 'state zip', without empty parts."""
    part = lambda c: F.when(F.col(c) != "", F.col(c))
    place = F.trim(F.concat_ws(" ", part("site_state"), part("site_zip")))
    return F.concat_ws(", ", part("site_address"), part("site_city"), F.when(place != "", place))


def executive(t: Tables) -> DataFrame:
    s = lambda *c: F.sum(sum((F.col(x) for x in c[1:]), F.col(c[0])))
    return t.facts.groupBy("company_key").agg(F.count(F.lit(1)).alias("inspections"), s("n_violations").alias("violations"), s("penalty").alias("penalties"), s("willful").alias("willful"), s("repeat").alias("repeat"), s("serious", "willful", "repeat").alias("serious_or_worse"), s("accidents").alias("accidents"), s("fatalities").alias("fatalities"), F.count_if(F.col("open_date") >= F.date_sub(F.lit(AS_OF), 1095)).alias("recent"))


def top_standards(t: Tables, k: int = 3) -> DataFrame:
    cited = t.inspections.select("activity_nr", "company_key").join(R.live(t.violations).select("activity_nr", "standard"), "activity_nr").groupBy("company_key", "standard").agg(F.count(F.lit(1)).alias("n"))
    return cited.withColumn("rank", F.row_number().over(Window.partitionBy("company_key").orderBy(F.desc("n"), "standard"))).filter(F.col("rank") <= k)


# ---- scores --------------------------------------------------------------------------
many({
    "F1": (lambda t: t.labelled.select("estab", "raw_score"), f"{O.WITH_SCORES} SELECT estab, raw_score FROM scored"),
    "F2": (lambda t: t.outcomes.filter("has_future_data").select("estab", "adverse"), f"{O.WITH_PAIRED} SELECT estab, adverse FROM outcomes WHERE has_future_data"),
    "F3": (lambda t: X.with_industry(t.features, X.industry_statistics(t.features)).groupBy("stats_group").agg(F.avg("relative_penalty").alias("mean_z"), F.max("relative_penalty").alias("max_z"), F.count(F.lit(1)).alias("n")),
          f"""{O.WITH_Z} SELECT stats_group, avg(relative_penalty) AS mean_z, max(relative_penalty) AS max_z, count(*) AS n FROM zed GROUP BY 1"""),
    "F4": (lambda t: t.labelled.select("estab", "ceiling", "score", "capped"),
          f"""{O.WITH_SCORES} SELECT estab, CAST(ceiling AS DOUBLE) AS ceiling, score, capped FROM scored"""),
    "F5": (lambda t: t.companies.select("company_key", "recommendation"), f"{O.WITH_COMPANIES} SELECT company_key, recommendation FROM companies"),
    "F6": (lambda t: t.labelled.groupBy(S.tier(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n")),
          f"""{O.WITH_SCORES} SELECT CASE WHEN score < 30 THEN 'Low' WHEN score < 60 THEN 'Medium' ELSE 'High' END AS tier, count(*) AS n FROM scored GROUP BY 1"""),
    "F10": (lambda t: t.raw("customer").select(F.col("c_name").alias("estab_name")).join(t.inspections.groupBy("estab_name").agg(F.count(F.lit(1)).alias("n")), "estab_name", "left").select("estab_name", F.when(F.col("n") > 0, 0.9).otherwise(0.4).alias("confidence"), F.when(F.col("n").isNull(), "No inspection records were found.").otherwise("").alias("notice")),
          f"""{I}, n AS (SELECT estab_name, count(*) AS n FROM inspections GROUP BY 1)
      SELECT c_name AS estab_name, CAST(CASE WHEN n > 0 THEN 0.9 ELSE 0.4 END AS DOUBLE) AS confidence, CASE WHEN n IS NULL THEN 'No inspection records were found.' ELSE '' END AS notice
      FROM customer LEFT JOIN n ON estab_name = c_name"""),
    "F11": (lambda t: t.raw("orders").select("o_orderkey", F.bround(F.floor("o_totalprice") / 8, 2).alias("rounded")),
          """SELECT o_orderkey, round_even(floor(o_totalprice) / 8, 2) AS rounded FROM orders"""),
    "F12": (lambda t: t.labelled.select("estab", S.tail_weight(F.col("raw_score")).alias("weight")),
          f"""{O.WITH_SCORES} SELECT estab, greatest(1, least(8, 1 + greatest(0, raw_score - 30) / 10)) AS weight FROM scored"""),
    # ---- evaluation
    "E1": (lambda t: E.decile_summary(t.paired),
          f"""{O.WITH_PAIRED}, r AS (SELECT *, row_number() OVER (ORDER BY score, estab) AS rn, count(*) OVER () AS n, avg(adverse) OVER () AS m FROM paired)
      SELECT CAST(greatest(1, ceil((rn - 1) * 10 / (n - 1))) AS INT) AS decile, min(score) AS score_lo, max(score) AS score_hi, count(*) AS n, avg(adverse) AS mean_outcome, median(adverse) AS median_outcome, avg(adverse) / any_value(m) AS lift
      FROM r GROUP BY 1"""),
    "E2": (lambda t: E.threshold_table(t.paired),
          f"""{O.WITH_PAIRED}, c AS (SELECT CAST(th AS INT) AS threshold, count(*) FILTER (score >= th AND swr = 1) AS TP, count(*) FILTER (score >= th AND swr = 0) AS FP, count(*) FILTER (score < th AND swr = 0) AS TN, count(*) FILTER (score < th AND swr = 1) AS FN
      FROM paired, (VALUES (20), (30), (40), (50), (60)) v(th)
      GROUP BY 1), d AS (SELECT *, TP / nullif(TP + FP, 0) AS precision, TP / nullif(TP + FN, 0) AS recall, TN / nullif(TN + FP, 0) AS specificity, (TP + FP) / (TP + FP + TN + FN) AS flagged, (TP + FN) / (TP + FP + TN + FN) AS prevalence
      FROM c) SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1, precision / nullif(prevalence, 0) AS lift FROM d"""),
    "E3": (lambda t: E.capture(t.paired),
          f"""{O.WITH_PAIRED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, estab) AS rn, count(*) OVER () AS n FROM paired)
      SELECT CAST(f AS DOUBLE) AS fraction, count(*) AS n, sum(adverse) / (SELECT sum(adverse) FROM paired) AS adverse_captured, sum(swr) / (SELECT sum(swr)
      FROM paired) AS swr_captured, avg(adverse) / (SELECT avg(adverse) FROM paired) AS adverse_lift, avg(swr) / (SELECT avg(swr) FROM paired) AS swr_lift
      FROM r, (VALUES (0.01), (0.05), (0.1), (0.2), (0.3), (0.5)) v(f) WHERE rn <= greatest(1, round_even(n * f, 0)) GROUP BY 1"""),
    "E6": (lambda t: E.bootstrap_spearman(t.paired), None),
    "E8": (lambda t: E.score_bands(t.paired),
          f"""{O.WITH_PAIRED}
      SELECT CAST(least(floor(score / 20), 4) AS INT) AS band, count(*) AS n, avg(adverse) AS mean_adverse, median(adverse) AS median_adverse, avg(swr) AS swr_rate, avg(fatality) AS fatality_rate, avg(violation_rate) AS mean_rate, avg(log_penalty) AS mean_log_penalty
      FROM paired GROUP BY 1"""),
    "E9": (lambda t: E.by_tier(t.paired),
          f"""{O.WITH_PAIRED}
      SELECT CASE WHEN score < 30 THEN 'Low' WHEN score < 60 THEN 'Medium' ELSE 'High' END AS tier, count(*) AS n, avg(adverse) AS mean_adverse, avg(score) AS mean_score
      FROM paired GROUP BY 1"""),
})
