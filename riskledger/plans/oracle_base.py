"""SQL that several oracles share: facts by inspection, features, industry statistics, scores."""

from __future__ import annotations

from riskledger.plans.bindings import with_views

AS_OF, CUTOFF = "DATE '2001-08-01'", "DATE '2000-01-01'"

FACTS = """
vr AS (SELECT activity_nr, count(*) AS n_violations, count(*) FILTER (viol_type = 'S') AS serious, count(*) FILTER (viol_type = 'W') AS willful, count(*) FILTER (viol_type = 'R') AS repeat,
    sum(coalesce(current_penalty, initial_penalty, 0)) AS penalty, max(coalesce(current_penalty, initial_penalty, 0)) AS max_penalty, sum(gravity) AS gravity_sum, count(gravity) AS gravity_n
  FROM violations WHERE delete_flag IS DISTINCT FROM 'X' GROUP BY activity_nr),
ap AS (SELECT rel_insp_nr, i.summary_nr, count(*) AS injuries, count(*) FILTER (replace(degree_of_inj, '.0', '') IN ('1', '2')) AS severe_injuries, bool_or(replace(degree_of_inj, '.0', '') = '1') OR coalesce(any_value(a.fatality) IN ('1', 'Y', 'True'), false) AS fatal
  FROM injuries i LEFT JOIN accidents a ON a.summary_nr = i.summary_nr GROUP BY rel_insp_nr, i.summary_nr),
ar AS (SELECT rel_insp_nr AS activity_nr, count(*) AS accidents, count(*) FILTER (fatal) AS fatalities, sum(injuries) AS injuries, sum(severe_injuries) AS severe_injuries FROM ap GROUP BY rel_insp_nr),
facts AS (SELECT i.*, upper(coalesce(estab_name, 'UNKNOWN')) AS estab, coalesce(n_violations, 0) AS n_violations, coalesce(serious, 0) AS serious, coalesce(willful, 0) AS willful, coalesce(repeat, 0) AS repeat,
    coalesce(penalty, 0) AS penalty, coalesce(max_penalty, 0) AS max_penalty, coalesce(gravity_sum, 0) AS gravity_sum, coalesce(gravity_n, 0) AS gravity_n,
    coalesce(accidents, 0) AS accidents, coalesce(fatalities, 0) AS fatalities, coalesce(injuries, 0) AS injuries, coalesce(severe_injuries, 0) AS severe_injuries
  FROM inspections i LEFT JOIN vr USING (activity_nr) LEFT JOIN ar USING (activity_nr))"""


def features(name: str = "feats", where: str = "true", as_of: str = AS_OF, key: str = "estab") -> str:
    """Features by establishment of the facts where the condition holds."""
    return f"""
{name}_v AS (SELECT {key}, substr(naics_code, 1, 4) AS g, count(*) AS n FROM facts WHERE {where} AND regexp_full_match(naics_code, '[0-9]{{4,}}') GROUP BY ALL),
{name}_g AS (SELECT {key}, g AS industry_group FROM {name}_v QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, g) = 1),
{name}_a AS (SELECT {key}, count(*) AS n_inspections, sum(n_violations) AS n_violations, sum(serious) AS serious, sum(willful) AS willful, sum(repeat) AS repeat, sum(penalty) AS total_penalty, max(max_penalty) AS max_penalty,
    count(*) FILTER (open_date >= {as_of} - 1095) AS recent, count(*) FILTER (accidents > 0) AS severe, count(*) FILTER (n_violations = 0) AS clean, sum(accidents) AS accidents, sum(fatalities) AS fatalities, sum(injuries) AS injuries,
    coalesce(sum(gravity_sum) / nullif(sum(gravity_n), 0), 0) AS avg_gravity FROM facts WHERE {where} GROUP BY {key}),
{name} AS (SELECT a.*, serious / n_inspections AS serious_rate, willful / n_inspections AS willful_rate, repeat / n_inspections AS repeat_rate, total_penalty / greatest(n_violations, 1) AS avg_penalty, recent / n_inspections AS recent_ratio,
    severe / n_inspections AS severe_rate, n_violations / n_inspections AS violations_per_inspection, accidents / n_inspections AS accident_rate, fatalities / n_inspections AS fatality_rate, injuries / n_inspections AS injury_rate,
    total_penalty / n_inspections AS penalty_per_inspection, clean / n_inspections AS clean_ratio, serious / greatest(n_violations, 1) AS raw_serious_rate, (willful + repeat) / greatest(n_violations, 1) AS raw_wr_rate,
    n_violations / n_inspections AS raw_vpi, total_penalty / greatest(n_violations, 1) AS raw_avg_pen, industry_group FROM {name}_a a LEFT JOIN {name}_g USING ({key}))"""


STATS = """
stats AS (SELECT grp, count(*) AS count, avg(raw_vpi) AS avg_violation_rate, coalesce(nullif(stddev_pop(raw_vpi), 0), 1e-6) AS std_violation_rate, avg(raw_avg_pen) AS avg_penalty, coalesce(nullif(stddev_pop(raw_avg_pen), 0), 1e-6) AS std_penalty,
    avg(raw_serious_rate) AS avg_serious_ratio, coalesce(nullif(stddev_pop(raw_serious_rate), 0), 1e-6) AS std_serious_ratio, avg(raw_wr_rate) AS avg_willful_repeat, coalesce(nullif(stddev_pop(raw_wr_rate), 0), 1e-6) AS std_willful_repeat
  FROM (SELECT *, substr(industry_group, 1, d) AS grp FROM feats, (VALUES (4), (3), (2)) t(d) WHERE industry_group IS NOT NULL) GROUP BY grp HAVING count(*) >= 10)"""


def _z(raw: str, stat: str) -> str:
    return f"CASE WHEN s.grp IS NOT NULL THEN greatest(-3, least(3, ({raw} - s.avg_{stat}) / greatest(abs(s.std_{stat}), 1e-6))) END"


ZED = f"""
keyed AS (SELECT f.*, (SELECT max(grp) FROM stats WHERE f.industry_group LIKE grp || '%') AS stats_group FROM feats f),
zed AS (SELECT f.*, {_z('raw_vpi', 'violation_rate')} AS relative_violation_rate, {_z('raw_avg_pen', 'penalty')} AS relative_penalty, {_z('raw_serious_rate', 'serious_ratio')} AS relative_serious_ratio, {_z('raw_wr_rate', 'willful_repeat')} AS relative_willful_repeat,
    s.avg_violation_rate AS industry_mean_rate FROM keyed f LEFT JOIN stats s ON s.grp = f.stats_group)"""

#: The heuristic label of a row of features.
LABEL = """round(greatest(0, least(100,
 least(34, CASE WHEN fatality_rate > 0 THEN least(24, 12 + 3 * greatest(least(5 * fatality_rate, 5) - 1, 0)) * ds * conf ELSE 0 END + least(25 * severe_rate, 6) + least(6 * injury_rate, 4) + least(10 * accident_rate, 4))
 + ds * (least(14 * willful_rate, 14) + least(10 * repeat_rate, 10)) + least(8 * serious_rate, 8) + CASE WHEN avg_gravity > 0 THEN least(0.6 * avg_gravity, 6) ELSE 0 END
 + 12 * recent_ratio + least(2.5 * violations_per_inspection, 10)
 + CASE WHEN recent_ratio > 0.5 AND violations_per_inspection >= 1.5 THEN least(2 * (recent_ratio - 0.5) * (violations_per_inspection - 1), 8)
        WHEN recent_ratio < 0.2 AND violations_per_inspection < 0.5 AND n_inspections >= 3 THEN -least(10 * (0.2 - recent_ratio), 5) ELSE 0 END
 + CASE WHEN total_penalty > 0 THEN least(0.4 * ln(1 + total_penalty), 4) ELSE 0 END + CASE WHEN penalty_per_inspection > 0 THEN least(0.3 * ln(1 + penalty_per_inspection), 2) ELSE 0 END
 + CASE WHEN industry_group IS NULL THEN 4 ELSE 0 END
 + CASE WHEN clean_ratio > 0 AND (recent_ratio < 0.01 OR NOT (fatality_rate > 0 OR accident_rate > 0 OR severe_rate > 0)) THEN CASE WHEN n_inspections >= 3 THEN -10 * clean_ratio WHEN n_inspections = 2 THEN -4 * clean_ratio ELSE 0 END ELSE 0 END
 + CASE WHEN n_inspections <= 1 THEN 2.5 WHEN n_inspections <= 3 THEN 1.5 WHEN n_inspections <= 5 THEN 0.5 ELSE 0 END
 + CASE WHEN fatality_rate > 0 AND willful_rate + repeat_rate > 0 THEN 8 * conf * ds ELSE 0 END + CASE WHEN willful_rate > 0 AND repeat_rate > 0 THEN 5 * conf * ds ELSE 0 END + CASE WHEN recent_ratio > 0.5 AND serious_rate >= 0.25 THEN 4 ELSE 0 END)), 9)"""


def scored(source: str = "feats", name: str = "scored") -> str:
    """Raw score, ceiling and score of each row of source."""
    return f"""
{name}_c AS (SELECT *, CASE WHEN recent_ratio < 0.01 THEN 0.5 ELSE 1.0 END AS ds, least(0.5 + n_inspections / 10, 1.0) AS conf,
    CASE WHEN fatalities > 0 AND willful > 0 THEN 70.0 WHEN n_inspections <= 2 THEN 50.0 WHEN n_inspections <= 4 THEN 58.0 ELSE 100.0 END AS ceiling FROM {source}),
{name} AS (SELECT *, {LABEL} AS raw_score, least({LABEL}, ceiling) AS score, {LABEL} > ceiling AS capped FROM {name}_c)"""


COMPANIES = """
sites AS (SELECT s.*, i.company_key FROM scored s JOIN (SELECT DISTINCT upper(estab_name) AS estab, company_key FROM inspections) i USING (estab)),
rolled AS (SELECT company_key, sum(score * n_inspections) / sum(n_inspections) AS weighted_score, max(score) AS max_score, median(score) AS median_score, count(*) AS sites, count(*) FILTER (score >= 60) AS high_sites,
    count(*) FILTER (willful + repeat > 0) AS wr_sites, sum(n_inspections) AS n_inspections, count(*) FILTER (score >= 60) / count(*) AS concentration FROM sites GROUP BY company_key),
flagged AS (SELECT *, concentration > 0.5 OR (sites >= 2 AND wr_sites >= 2 AND weighted_score >= 45) AS systemic FROM rolled),
companies AS (SELECT *, CASE WHEN weighted_score >= 60 AND (sites <= 1 OR systemic) THEN 'Do Not Recommend' WHEN weighted_score >= 60 THEN 'Proceed with Caution' WHEN weighted_score < 30 THEN 'Recommend' ELSE 'Proceed with Caution' END AS recommendation FROM flagged)"""

BASE = with_views("inspections", "violations", "injuries", "accidents")
WITH_FACTS = f"{BASE},{FACTS}"
WITH_FEATURES = f"{WITH_FACTS},{features()}"
WITH_STATS = f"{WITH_FEATURES},{STATS}"
WITH_Z = f"{WITH_STATS},{ZED}"
WITH_SCORES = f"{WITH_FEATURES},{scored()}"
WITH_COMPANIES = f"{WITH_SCORES},{COMPANIES}"


def outcomes(cutoff: str) -> str:
    """History before the cutoff scored, and what the time from the cutoff on brought."""
    return f"""{features('feats', f'open_date < {cutoff}', cutoff)},{scored()},
future AS (SELECT estab, count(*) AS n_future, sum(n_violations) AS violations, sum(serious) AS serious, sum(willful) AS willful, sum(repeat) AS repeat, sum(accidents) AS accidents, sum(fatalities) AS fatalities, sum(injuries) AS injuries,
    sum(penalty) AS penalty, count(*) FILTER (accidents > 0) / count(*) AS severe_rate FROM facts WHERE open_date >= {cutoff} GROUP BY estab),
outcomes AS (SELECT h.estab, coalesce(n_future, 0) > 0 AS has_future_data, coalesce(n_future, 0) AS n_future, f.violations, f.serious, f.willful, f.repeat, f.willful + f.repeat AS willful_repeat, f.accidents, f.fatalities, f.injuries,
    f.penalty, f.violations / n_future AS violation_rate, f.severe_rate, CASE WHEN n_future > 0 THEN CAST(f.serious + f.willful + f.repeat > 0 AS INT) END AS swr, CASE WHEN n_future > 0 THEN CAST(f.fatalities > 0 AS INT) END AS fatality,
    round(CASE WHEN n_future > 0 THEN CASE WHEN f.fatalities > 0 THEN 20 ELSE 0 END + CASE WHEN f.fatalities > 1 THEN least(5.0 * (f.fatalities - 1), 15) ELSE 0 END + CASE WHEN f.willful + f.repeat > 0 THEN 8 ELSE 0 END + least(3.0 * (f.willful + f.repeat), 15)
      + least(f.serious, 10) + least(0.8 * ln(1 + f.penalty), 10) + least(2.0 * f.violations / n_future, 10) END, 9) AS adverse
  FROM feats h LEFT JOIN future f USING (estab)),
paired AS (SELECT estab, score, s.n_inspections, s.recent, coalesce(substr(industry_group, 1, 2), 'unknown') AS sector, adverse, o.swr, o.fatality, o.violation_rate, ln(1 + o.penalty) AS log_penalty
  FROM scored s JOIN outcomes o USING (estab) WHERE has_future_data)"""


WITH_PAIRED = f"{WITH_FACTS},{outcomes(CUTOFF)}"
