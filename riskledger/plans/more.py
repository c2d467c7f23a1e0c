"""Names, search, joins, reports and documented operators as queries (see catalog)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskledger.functions import names as N
from riskledger.functions.labels import SECTOR_NAMES, sector_label
from riskledger.functions import scores as S
from riskledger.operators import documented as D
from riskledger.operators import evaluate as E
from riskledger.operators import features as X
from riskledger.operators import records as R
from riskledger.operators import rollup as U
from riskledger.operators import search as Q
from riskledger.plans import oracle_base as O
from riskledger.plans.bindings import AS_OF, CUTOFF, with_views
from riskledger.plans.catalog import I, IV, Tables, address, many, op




def n():
    return F.count("*").alias("n")


def sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


many({
    "H13": (lambda t: t.violations.groupBy(N.code_text(F.col("standard")).alias("code")).agg(n()),
          f"""{with_views('violations')} SELECT regexp_replace(upper(standard), '[^A-Z0-9]+', '', 'g') AS code, count(*) AS n FROM violations GROUP BY 1"""),
    "H14": (lambda t: t.raw("documents").select("doc_id", F.array_join(N.code_tokens(F.col("text")), " ").alias("tokens")),
          r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(upper(text), '[^A-Z0-9]+'), lambda w, i: length(w) >= 3 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '^(19|29).*$|^[A-Z]{1,3}[0-9]{1,4}[A-Z]{0,3}$|^[0-9]{2,4}[A-Z]{1,3}$') AND list_position(regexp_split_to_array(upper(text), '[^A-Z0-9]+'), w) = i), ' ') AS tokens
      FROM documents"""),
    "H16": (lambda t: t.features.groupBy(sector_label(F.col("industry_group")).alias("label")).agg(n()),
          f"""{O.WITH_FEATURES} SELECT {{label}} AS label, count(*) AS n FROM feats GROUP BY 1"""),
})



from riskledger.plans.catalog import ORACLES  # noqa: E402

ORACLES["H16"] = ORACLES["H16"].replace("{label}", "CASE substr(industry_group, 1, 2) " + " ".join(f"WHEN '{a}' THEN {sq(b)}" for a, b in SECTOR_NAMES.items()) + " ELSE 'Unknown' END")



@op("J8", f"""{I}, ref AS (SELECT DISTINCT substr(naics_code, 1, d) AS code, 'Group ' || substr(naics_code, 1, d) AS title FROM inspections, (VALUES (2), (4)) v(d)
      WHERE naics_code <> '' AND (d = 2 OR substr(naics_code, 4, 1) = '1')), c AS (SELECT DISTINCT naics_code FROM inspections)
      SELECT naics_code, coalesce((SELECT max_by(title, length(code)) FROM ref WHERE naics_code LIKE code || '%'), 'Unknown Industry') AS industry FROM c""")
def industry_names(t: Tables) -> DataFrame:
    codes = t.inspections.select("naics_code").distinct()
    two = codes.filter("naics_code != ''").select(F.substring("naics_code", 1, 2).alias("code"))
    four = codes.filter(F.substring("naics_code", 4, 1) == "1").select(F.substring("naics_code", 1, 4).alias("code"))
    ref = two.union(four).distinct().withColumn("title", F.concat(F.lit("Group "), "code"))
    return X.longest_prefix(codes, "naics_code", ref, "industry")


STITCH = "string_agg(trim(line_text), ' ' ORDER BY CAST(coalesce(TRY_CAST(line_nr AS DOUBLE), 0) AS INT), line_text) FILTER (trim(line_text) <> '')"


def stitched(t: Tables, *keys: str) -> DataFrame:
    return R.stitched(t.narratives, list(keys), "line_nr", "line_text")


NARR = with_views("narratives")

many({
    "S3": (lambda t: stitched(t, "summary_nr", "role").select("summary_nr", "role", F.md5("narrative").alias("digest")),
          f"""{NARR} SELECT summary_nr, role, md5({STITCH}) AS digest FROM narratives GROUP BY 1, 2"""),
    "S4": (lambda t: stitched(t, "summary_nr").select("summary_nr", F.md5("narrative").alias("digest"), F.length("narrative").alias("n_chars")),
          f"""{NARR} SELECT summary_nr, md5({STITCH}) AS digest, CAST(length({STITCH}) AS INT) AS n_chars FROM narratives GROUP BY 1"""),
    "J4": (lambda t: t.accidents.join(stitched(t, "summary_nr"), "summary_nr", "left").select("summary_nr", F.length("narrative").alias("n_chars")),
          f"""{with_views('accidents', 'narratives')}, s AS (SELECT summary_nr, {STITCH} AS narrative FROM narratives GROUP BY 1)
      SELECT summary_nr, CAST(length(narrative) AS INT) AS n_chars FROM accidents LEFT JOIN s USING (summary_nr)"""),
    "R1": (lambda t: R.nested(t.inspections, t.violations, t.injuries, t.accidents).select("activity_nr", "total_penalty", "severe", F.size("violations").cast("long").alias("violations"), F.size("accidents").cast("long").alias("accidents"), F.size(F.filter("accidents", lambda a: a["fatal"])).cast("long").alias("fatal")),
          f"""{O.WITH_FACTS} SELECT activity_nr, penalty AS total_penalty, accidents > 0 OR insp_type = 'L' AS severe, n_violations AS violations, accidents, fatalities AS fatal
      FROM facts"""),
    # ---- set operations, sorts, windows
    "K2": (lambda t: t.sites.withColumn("place", F.row_number().over(Window.partitionBy("company_key").orderBy(F.desc("score"), "estab"))).select("company_key", "estab", "place"),
          f"""{O.WITH_COMPANIES} SELECT company_key, estab, CAST(row_number() OVER (PARTITION BY company_key ORDER BY score DESC, estab) AS INT) AS place FROM sites"""),
    "K5": (lambda t: t.violations.orderBy(F.desc("issuance_date"), "activity_nr", "citation_id", "standard").limit(250).select("activity_nr", "issuance_date"),
          f"""{with_views('violations')} SELECT activity_nr, issuance_date FROM violations ORDER BY issuance_date DESC, activity_nr, citation_id, standard LIMIT 250"""),
    "U1": (lambda t: t.violations.filter(F.col("issuance_date") < F.lit(CUTOFF)).unionByName(t.violations.filter(F.col("issuance_date") >= F.lit(CUTOFF))).groupBy("viol_type").agg(n()),
          f"""{with_views('violations')} SELECT viol_type, count(*) AS n FROM violations WHERE issuance_date IS NOT NULL GROUP BY 1"""),
    "U2": (lambda t: t.facts.filter(F.col("open_date") < F.lit(CUTOFF)).select("estab").distinct().union(t.facts.filter(F.col("open_date") >= F.lit(CUTOFF)).select("estab").distinct()).groupBy("estab").agg(n()),
          f"""{O.WITH_FACTS} SELECT estab, count(DISTINCT open_date < {O.CUTOFF}) AS n FROM facts GROUP BY 1"""),
    "W2": (lambda t: t.inspections.filter(F.col("site_city") != "").groupBy("estab_name").agg(F.max_by(F.struct("site_city", "site_state"), F.struct("open_date", "activity_nr")).alias("l")).select("estab_name", "l.site_city", "l.site_state"),
          f"""{I} SELECT estab_name, site_city, site_state FROM inspections WHERE site_city <> '' QUALIFY row_number() OVER (PARTITION BY estab_name
      ORDER BY open_date DESC, activity_nr DESC) = 1"""),
    "W3": (lambda t: E.decile_bins(t.paired).select("estab", "decile"),
          f"""{O.WITH_PAIRED} SELECT estab, CAST(greatest(1, ceil((row_number() OVER (ORDER BY score, estab) - 1) * 10 / (count(*) OVER () - 1))) AS INT) AS decile FROM paired"""),
    "W5": (lambda t: E.rolling_mean(t.paired).select("estab", "smooth"),
          f"""{O.WITH_PAIRED}, w AS (SELECT greatest(50, CAST(floor(0.08 * count(*)) AS INT)) AS w
      FROM paired), r AS (SELECT estab, adverse, row_number() OVER (ORDER BY score, estab) AS rn FROM paired)
      SELECT a.estab, CASE WHEN count(*) >= any_value(w // 4) THEN avg(b.adverse) END AS smooth FROM r a, w JOIN r b ON b.rn BETWEEN a.rn - w // 2 AND a.rn + (w - 1) // 2
      GROUP BY a.estab"""),
    "W6": (lambda t: X.with_industry(t.features, X.industry_statistics(t.features)).select("estab", F.round(50 * (1 + S.erf(F.col("relative_violation_rate") / F.sqrt(F.lit(2.0)))), 6).alias("percentile")),
          f"""{O.WITH_Z}, e AS (SELECT estab, relative_violation_rate / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(relative_violation_rate / sqrt(2))) AS t FROM zed)
      SELECT estab, round(50 * (1 + sign(x) * (1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x))), 6) AS percentile
      FROM e"""),
    "W7": (lambda t: t.inspections.withColumn("r", F.row_number().over(Window.partitionBy("company_key").orderBy("open_date", "activity_nr"))).filter("r = 1").select("company_key", "activity_nr"),
          f"""{I} SELECT company_key, activity_nr FROM inspections QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY open_date, activity_nr) = 1"""),
    # ---- more reports
    "E10": (lambda t: E.top_ranked(t.paired, (1.0, 0.2, 0.1, 0.05)).groupBy("fraction").agg(n(), F.avg("adverse").alias("mean"), F.avg("score").alias("mean_score")),
          f"""{O.WITH_PAIRED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, estab) AS rn, count(*) OVER () AS n FROM paired)
      SELECT CAST(f AS DOUBLE) AS fraction, count(*) AS n, avg(adverse) AS mean, avg(score) AS mean_score FROM r, (VALUES (1.0), (0.2), (0.1), (0.05)) v(f)
      WHERE rn <= greatest(1, round_even(n * f, 0)) GROUP BY 1"""),
    "E24": (lambda t: E.capture(t.paired, (0.05, 0.1, 0.2, 0.3)).select("fraction", "n", F.col("adverse_captured").alias("gain")),
          f"""{O.WITH_PAIRED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, estab) AS rn, count(*) OVER () AS n FROM paired)
      SELECT CAST(f AS DOUBLE) AS fraction, count(*) AS n, sum(adverse) / (SELECT sum(adverse) FROM paired) AS gain FROM r, (VALUES (0.05), (0.1), (0.2), (0.3)) v(f)
      WHERE rn <= greatest(1, round_even(n * f, 0)) GROUP BY 1"""),
    "E27": (lambda t: t.paired.groupBy(F.when(F.col("score") > 60, "high").when(F.col("score") < 30, "low").otherwise("mid").alias("band")).agg(n(), F.avg("adverse").alias("mean"), F.avg("swr").alias("swr_rate")).withColumn("scaled", F.col("mean") / F.max("mean").over(Window.partitionBy(F.lit(0)))),
          f"""{O.WITH_PAIRED}
      SELECT CASE WHEN score > 60 THEN 'high' WHEN score < 30 THEN 'low' ELSE 'mid' END AS band, count(*) AS n, avg(adverse) AS mean, avg(swr) AS swr_rate, avg(adverse) / max(avg(adverse)) OVER () AS scaled
      FROM paired GROUP BY 1"""),
    "E28": (lambda t: t.paired.agg((F.avg(F.when(F.col("swr") == 1, F.col("score"))) - F.avg(F.when(F.col("swr") == 0, F.col("score")))).alias("separation")),
          f"""{O.WITH_PAIRED} SELECT avg(score) FILTER (swr = 1) - avg(score) FILTER (swr = 0) AS separation FROM paired"""),
    "E30": (lambda t: t.paired.agg(F.regr_slope("adverse", "score").alias("slope"), F.regr_intercept("adverse", "score").alias("intercept")),
          f"""{O.WITH_PAIRED} SELECT regr_slope(adverse, score) AS slope, regr_intercept(adverse, score) AS intercept FROM paired"""),
    "E32": (lambda t: t.labelled.agg(F.avg(F.when(F.col("fatalities") > 0, F.col("score"))).alias("with_fatality"), F.avg(F.when(F.col("n_violations") == 0, F.col("score"))).alias("clean"), F.avg(F.when(F.col("willful") > 0, F.col("score"))).alias("willful"), F.avg(F.col("score")).alias("every"), F.avg(F.when(F.col("n_inspections") == 1, F.col("score"))).alias("single")),
          f"""{O.WITH_SCORES}
      SELECT avg(score) FILTER (fatalities > 0) AS with_fatality, avg(score) FILTER (n_violations = 0) AS clean, avg(score) FILTER (willful > 0) AS willful, avg(score) AS every, avg(score) FILTER (n_inspections = 1) AS single
      FROM scored"""),
    "M8": (lambda t: t.paired.crossJoin(F.broadcast(t.paired.agg(F.stddev_pop("adverse").alias("sy"), F.stddev_pop("score").alias("sp"), F.corr("score", "adverse").alias("r"), F.avg("adverse").alias("my"), F.avg("score").alias("mp")))).select("estab", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("my") + F.col("sy") / (F.col("r") * F.col("sp")) * (F.col("score") - F.col("mp")))).alias("stretched")),
          f"""{O.WITH_PAIRED}, m AS (SELECT stddev_pop(adverse) AS sy, stddev_pop(score) AS sp, corr(score, adverse) AS r, avg(adverse) AS my, avg(score) AS mp FROM paired)
      SELECT estab, greatest(0, least(100, my + sy / (r * sp) * (score - mp))) AS stretched FROM paired, m"""),
    # ---- documented
    "D2": (lambda t: D.penalty_percentiles(t.facts, CUTOFF),
          f"""{O.WITH_FACTS}, p AS (SELECT substr(naics_code, 1, 2) AS sector, penalty FROM facts
      WHERE open_date < {O.CUTOFF} AND penalty > 0), g AS (SELECT quantile_cont(penalty, 0.75) AS a, quantile_cont(penalty, 0.9) AS b, quantile_cont(penalty, 0.95) AS c FROM p)
      SELECT sector, count(*) AS n, CASE WHEN count(*) >= 50 THEN quantile_cont(penalty, 0.75) ELSE any_value(a) END AS p75, CASE WHEN count(*) >= 50 THEN quantile_cont(penalty, 0.9) ELSE any_value(b) END AS p90, CASE WHEN count(*) >= 50 THEN quantile_cont(penalty, 0.95) ELSE any_value(c) END AS p95
      FROM p, g GROUP BY 1"""),
    "D8": (lambda t: D.credibility(t.sites, ["company_key"]),
          f"""{O.WITH_COMPANIES}, c AS (SELECT company_key, n_inspections, score, n_inspections / (n_inspections + 5) * score + (1 - n_inspections / (n_inspections + 5)) * 15 AS s
      FROM sites), a AS (SELECT company_key, sum(s * n_inspections) / sum(n_inspections) AS mean, max(s) AS worst, count(*) FILTER (score >= 60) / count(*) AS concentration
      FROM c GROUP BY 1) SELECT *, (1 - least(0.3 * concentration, 0.3)) * mean + least(0.3 * concentration, 0.3) * worst AS blended FROM a"""),
    "D12": (lambda t: U.company_rollup(t.sites.filter(F.col("score") < 45), ["company_key"]).select("company_key", "weighted_score", "sites"),
          f"""{O.WITH_COMPANIES} SELECT company_key, sum(score * n_inspections) / sum(n_inspections) AS weighted_score, count(*) AS sites FROM sites WHERE score < 45 GROUP BY 1"""),
    "D14": (lambda t: D.score_distribution(t.labelled),
          f"""{O.WITH_SCORES}, c AS (SELECT round_even(score, 1) AS value, count(*) AS n FROM scored GROUP BY 1) SELECT value, n, sum(n) OVER (ORDER BY value) / sum(n) OVER () AS share
      FROM c"""),
})
