"""Company assessments as queries (see catalog): comparisons, warnings, summaries and the whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.functions.labels import SECTOR_NAMES
from riskledger.operators import features as X
from riskledger.operators import rollup as U
from riskledger.operators.ranking import written
from riskledger.plans import oracle_base as O
from riskledger.plans.bindings import AS_OF
from riskledger.plans.catalog import Tables, executive, op, top_standards

LABEL = lambda c: f"CASE substr({c}, 1, 2) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SECTOR_NAMES.items()) + " ELSE 'Unknown' END"
Z = lambda raw, stat: f"CASE WHEN s.grp IS NOT NULL THEN greatest(-3, least(3, ({raw} - s.avg_{stat}) / greatest(abs(s.std_{stat}), 1e-6))) END"
ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x))"


def bullet(z: str, stat: str, name: str) -> str:
    percent = f"abs({z} * std_{stat} / nullif(abs(avg_{stat}), 0)) * 100"
    text = f"CAST(round_even({percent}, 0) AS INT) || '% ' || CASE WHEN {z} > 0 THEN 'higher ' ELSE 'lower ' END || '{name} than ' || industry_label || ' average'"
    return f"CASE WHEN abs({z}) >= 0.3 AND avg_{stat} <> 0 AND {percent} >= 10 THEN {text} END"


NAMED = {"violation_rate": "violation rate", "penalty": "average penalty", "serious_ratio": "serious violation ratio", "willful_repeat": "willful/repeat rate"}


def compared(source: str, key: str, name: str = "peers") -> str:
    """SQL: rows of source (features) with z-scores, the industry's percentile and comparisons."""
    zs = ", ".join(f"{Z(f'f.{raw}', stat)} AS {z}" for z, raw, stat in X.RATES)
    bullets = ", ".join(bullet(z, stat, NAMED[stat]) for z, _, stat in X.RATES)
    return f"""{name}_k AS (SELECT f.*, (SELECT max(grp) FROM stats WHERE f.industry_group LIKE grp || '%') AS stats_group FROM {source} f),
{name}_z AS (SELECT f.* EXCLUDE (avg_penalty), s.* EXCLUDE (grp, count), {zs}, {LABEL('f.stats_group')} AS industry_label FROM {name}_k f LEFT JOIN stats s ON s.grp = f.stats_group),
{name}_e AS (SELECT *, abs(relative_violation_rate) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(relative_violation_rate) / sqrt(2)) AS t FROM {name}_z),
{name} AS (SELECT {key}, stats_group, industry_group, coalesce(round_even(50 * (1 + sign(relative_violation_rate) * {ERF}), 1), 50) AS industry_percentile, array_to_string(list_filter([{bullets}], lambda b: b IS NOT NULL), '; ') AS comparison FROM {name}_e)"""


@op("F7", f"{O.WITH_STATS},{compared('feats', 'estab')} SELECT estab, comparison, industry_percentile FROM peers")
def comparisons(t: Tables) -> DataFrame:
    stats = X.industry_statistics(t.features)
    rows = U.peer_bullets(X.with_industry(t.features, stats), stats)
    return rows.select("estab", F.array_join("bullets", "; ").alias("comparison"), "industry_percentile")


RANGES = "(SELECT company_key, CAST(round_even(min(score), 0) AS INT) AS lo, CAST(round_even(max(score), 0) AS INT) AS hi FROM sites GROUP BY 1)"
WARNINGS = """CASE WHEN sites > 1 THEN 'This score aggregates ' || sites || ' establishments, whose own scores lie between ' || lo || ' and ' || hi || '.' ELSE '' END AS aggregation_warning,
  CASE WHEN sites > 1 AND high_sites > 0 THEN high_sites || ' of ' || sites || ' establishments score as high risk.' ELSE '' END AS concentration_warning"""


@op("F8", f"{O.WITH_COMPANIES} SELECT company_key, {WARNINGS} FROM companies JOIN {RANGES} USING (company_key)")
def company_warnings(t: Tables) -> DataFrame:
    return U.warnings(t.companies, t.sites, ["company_key"]).select("company_key", "aggregation_warning", "concentration_warning")


SOME = lambda c, one: f"CAST({c} AS BIGINT) || CASE WHEN {c} = 1 THEN ' {one}' ELSE ' {one}s' END"
SUMMARY = f"""concat_ws(' ',
  CASE WHEN risk_score < 15 THEN 'Low risk' WHEN risk_score < 45 THEN 'Moderate risk' WHEN risk_score < 70 THEN 'Elevated risk' ELSE 'High risk' END || ': ' || {SOME('inspections', 'inspection')} || ' with '
    || CASE WHEN violations > 0 THEN {SOME('violations', 'violation')} ELSE 'no violations' END || CASE WHEN penalties > 0 THEN ', $' || format('{{:,}}', CAST(round_even(penalties, 0) AS BIGINT)) || ' in penalties' ELSE '' END || '.',
  'Violations: ' || nullif(concat_ws(', ', CASE WHEN serious_or_worse > 0 THEN CAST(serious_or_worse AS BIGINT) || ' serious or worse' END, CASE WHEN willful > 0 THEN CAST(willful AS BIGINT) || ' willful' END, CASE WHEN repeat > 0 THEN CAST(repeat AS BIGINT) || ' repeat' END), '') || '.',
  CASE WHEN accidents > 0 THEN {SOME('accidents', 'accident')} || ', ' || CAST(fatalities AS BIGINT) || ' fatal.' END,
  CASE WHEN recent > 0 THEN recent || ' in the last three years.' END,
  CASE WHEN NOT missing_naics THEN 'Ranks at percentile ' || CAST(round_even(industry_percentile, 0) AS BIGINT) || ' of ' || industry_label || '.' ELSE 'No industry code for a comparison with peers.' END,
  'Most cited: ' || cited || '.')"""
ASSESSED = f"""{O.WITH_COMPANIES},{O.STATS},{O.features('company_feats', key='company_key')},{compared('company_feats', 'company_key')},
counts AS (SELECT company_key, count(*) AS inspections, sum(n_violations) AS violations, sum(penalty) AS penalties, sum(willful) AS willful, sum(repeat) AS repeat, sum(serious + willful + repeat) AS serious_or_worse, sum(accidents) AS accidents,
  sum(fatalities) AS fatalities, count(*) FILTER (open_date >= {O.AS_OF} - 1095) AS recent FROM facts GROUP BY 1),
cites AS (SELECT company_key, standard, count(*) AS n FROM inspections JOIN violations USING (activity_nr) WHERE delete_flag IS DISTINCT FROM 'X' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY n DESC, standard) <= 3),
cited AS (SELECT company_key, string_agg(standard || ' (' || n || ')', ', ' ORDER BY n DESC, standard) AS cited FROM cites GROUP BY 1),
assessed AS (SELECT c.company_key, round_even(weighted_score, 1) AS risk_score, round_even(100 * (SELECT count(*) FROM scored WHERE score <= round_even(weighted_score, 1)) / (SELECT count(*) FROM scored), 1) AS percentile_rank,
  recommendation, CAST(0.9 AS DOUBLE) AS confidence, systemic, sites, concentration, industry_group IS NULL AS missing_naics, coalesce(stats_group, industry_group) AS industry_group, CASE WHEN industry_group IS NULL THEN 'Unknown' ELSE {LABEL('coalesce(stats_group, industry_group)')} END AS industry_label,
  industry_percentile, comparison, {WARNINGS}, inspections, violations, penalties, willful, repeat, serious_or_worse, accidents, fatalities, recent, cited
  FROM companies c JOIN peers USING (company_key) JOIN counts USING (company_key) JOIN {RANGES} USING (company_key) LEFT JOIN cited USING (company_key))"""


def assessed(t: Tables) -> DataFrame:
    t.facts = written(t.facts, "facts")  # read for sites, companies and counts
    t.features = written(t.features, "features")
    sites = written(t.sites, "sites")
    stats = X.industry_statistics(t.features)
    own = X.establishment_features(t.facts, AS_OF, keys=("company_key",))
    peers = U.peer_bullets(X.with_industry(own, stats), stats)
    cited = top_standards(t).groupBy("company_key").agg(F.array_sort(F.collect_list(F.struct("rank", "standard", "n"))).alias("s"))  # three a company
    cited = cited.select("company_key", F.transform("s", lambda s: F.struct(s["standard"].alias("standard"), s["n"].alias("n"))).alias("standards"))
    return U.assessments(U.company_rollup(sites, ["company_key"]), sites, peers, executive(t), cited, t.labelled, ["company_key"])


@op("F9", f"{ASSESSED} SELECT company_key, {SUMMARY} AS summary FROM assessed")
def summaries(t: Tables) -> DataFrame:
    return assessed(t).select("company_key", "summary")


@op("F13", f"{ASSESSED} SELECT company_key, missing_naics, CASE WHEN missing_naics THEN percentile_rank ELSE industry_percentile END AS shown FROM assessed")
def shown_percentile(t: Tables) -> DataFrame:
    return assessed(t).select("company_key", "missing_naics", F.col("shown_percentile").alias("shown"))


R3 = ["company_key", "risk_score", "percentile_rank", "recommendation", "confidence", "systemic", "sites", "concentration", "missing_naics", "industry_group", "industry_label", "industry_percentile", "comparison", "aggregation_warning", "concentration_warning"]


@op("R3", f"{ASSESSED} SELECT {', '.join(R3)}, {SUMMARY} AS summary FROM assessed")
def company_assessments(t: Tables) -> DataFrame:
    return assessed(t).select(*R3, "summary")
