"""Records, evidence and listings as queries (see catalog)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskledger.functions import labels as L
from riskledger.operators import features as X
from riskledger.operators import records as R
from riskledger.operators import search as Q
from riskledger.plans import oracle_base as O
from riskledger.plans.bindings import AS_OF, with_views
from riskledger.plans.catalog import COLS, FEATS, I, Tables, address, op

QUESTIONS = ["1910.0009 A01", "what about 5A1?", "no code here", "19100012 Z99 in 1910001"]
ASKED = "(VALUES " + ", ".join(f"('{q}')" for q in QUESTIONS) + ") q(question)"
CODE = lambda c: f"regexp_replace(upper({c}), '[^A-Z0-9]+', '', 'g')"
TOKENS = "list_filter(regexp_split_to_array(upper(question), '[^A-Z0-9]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '^(19|29).*$|^[A-Z]{1,3}[0-9]{1,4}[A-Z]{0,3}$|^[0-9]{2,4}[A-Z]{1,3}$'))"
MATCH = f"""tok AS (SELECT question, {TOKENS} AS tokens FROM {ASKED}), codes AS (SELECT DISTINCT standard, {CODE('standard')} AS c FROM violations),
hit AS (SELECT question, standard FROM tok, codes WHERE c <> '' AND (contains(c, {CODE('question')}) OR contains({CODE('question')}, c) OR len(list_filter(tokens, lambda w: contains(c, w) OR contains(w, c))) > 0))"""
#: Narrative lines of violations: the conversation is the inspection, its turns modulo seven the citations.
LINES = "note_lines AS (SELECT summary_nr AS activity_nr, lpad(CAST(CAST(line_nr AS INT) % 7 + 1 AS VARCHAR), 2, '0') AS citation_id, line_nr, line_text FROM narratives)"
STITCH = "string_agg(trim(line_text), ' ' ORDER BY CAST(coalesce(TRY_CAST(line_nr AS DOUBLE), 0) AS INT), line_text) FILTER (trim(line_text) <> '')"
NOTES = f"{LINES}, notes AS (SELECT activity_nr, citation_id, {STITCH} AS narrative FROM note_lines GROUP BY 1, 2 HAVING narrative IS NOT NULL)"
PENALTY = "coalesce(current_penalty, initial_penalty, 0)"


def questions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(q,) for q in QUESTIONS], "question string")


def notes(t: Tables) -> DataFrame:
    citation = F.lpad((F.col("line_nr").cast("int") % 7 + 1).cast("string"), 2, "0")
    lines = t.narratives.select(F.col("summary_nr").alias("activity_nr"), citation.alias("citation_id"), "line_nr", "line_text")
    return R.stitched(lines, ["activity_nr", "citation_id"], "line_nr", "line_text")


def evidence(t: Tables) -> DataFrame:
    return Q.code_evidence(questions(t), t.inspections, t.violations, notes(t))


EVIDENCE = f"""{with_views('inspections', 'violations', 'narratives')}, {MATCH}, {NOTES},
found AS (SELECT question, company_key, i.open_date, v.*, {PENALTY} AS penalty FROM violations v JOIN hit USING (standard) JOIN inspections i USING (activity_nr)),
shown AS (SELECT *, row_number() OVER (PARTITION BY question, company_key ORDER BY open_date DESC, activity_nr, citation_id, standard, penalty DESC) AS place FROM found QUALIFY place <= 20),
told AS (SELECT activity_nr, list(CASE WHEN length(narrative) > 500 THEN substr(narrative, 1, 500) || '…' ELSE narrative END ORDER BY citation_id, narrative)[1:3] AS notes FROM notes GROUP BY 1)"""


@op("H15", f"{with_views('violations')}, {MATCH} SELECT question, standard FROM hit")
def code_matches(t: Tables) -> DataFrame:
    return Q.matched_standards(questions(t), t.violations)


@op("A17", f"""{EVIDENCE} SELECT question, company_key, count(*) AS matched, string_agg(DISTINCT standard, ', ' ORDER BY standard) AS standards, sum(penalty) AS penalty FROM found GROUP BY 1, 2""")
def evidence_totals(t: Tables) -> DataFrame:
    return evidence(t).select("question", "company_key", "matched", "standards", "penalty")


@op("R4", f"""{EVIDENCE} SELECT question, company_key, count(*) AS matched, string_agg(DISTINCT standard, ', ' ORDER BY standard) AS standards, sum(penalty) AS penalty, least(20, count(*)) AS shown,
  (SELECT CAST(coalesce(sum(len(notes)), 0) AS BIGINT) FROM shown s JOIN told USING (activity_nr) WHERE s.question = f.question AND s.company_key = f.company_key) AS n_notes FROM found f GROUP BY 1, 2""")
def evidence_report(t: Tables) -> DataFrame:
    n_notes = F.aggregate("evidence", F.lit(0).cast("long"), lambda s, e: s + F.size(e["notes"]))
    return evidence(t).select("question", "company_key", "matched", "standards", "penalty", F.size("evidence").cast("long").alias("shown"), n_notes.alias("n_notes"))


@op("K4", f"""{EVIDENCE} SELECT question, company_key, CAST(place AS INT) AS place, activity_nr, standard, penalty, coalesce(array_to_string(notes, ' | '), '') AS notes FROM shown LEFT JOIN told USING (activity_nr)
UNION ALL SELECT question, NULL, CAST(row_number() OVER (PARTITION BY question ORDER BY standard) AS INT), NULL, standard, NULL, 'nearby' FROM (
  SELECT question, standard, p, min(p) OVER (PARTITION BY question) AS first FROM (SELECT question, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS p FROM tok WHERE question NOT IN (SELECT question FROM hit)) JOIN codes ON starts_with(c, substr(w, 1, 6)) WHERE length(w) >= 4)
  WHERE p = first QUALIFY row_number() OVER (PARTITION BY question ORDER BY standard) <= 8""")
def evidence_rows(t: Tables) -> DataFrame:
    """The rows shown with their notes, and standards near the codes of questions that match none."""
    shown = evidence(t).select("question", "company_key", F.explode("evidence").alias("e")).select("question", "company_key", "e.place", "e.activity_nr", "e.standard", "e.penalty", F.array_join("e.notes", " | ").alias("notes"))
    near = Q.nearby_standards(questions(t), t.violations)
    place = F.row_number().over(Window.partitionBy("question").orderBy("standard"))
    none = lambda kind: F.lit(None).cast(kind)
    return shown.unionByName(near.select("question", none("string").alias("company_key"), place.alias("place"), none("string").alias("activity_nr"), "standard", none("double").alias("penalty"), F.lit("nearby").alias("notes")))


@op("P9", f"""{I}, q(query) AS (VALUES ('MACHINERY NATION_1'), ('NATION_2'), ('HOUSEHOLD'), ('CUSTOMER#000000001'), ('THE BUILDING NATION_3 OF TODAY'), ('zzz'), ('')), k AS (SELECT DISTINCT company_key, upper(estab_name) AS name FROM inspections),
m AS (SELECT query, company_key, min(CASE WHEN company_key = query THEN 1 WHEN contains(company_key, query) OR contains(name, query) THEN 2 WHEN length(company_key) >= 3 AND contains(query, company_key) THEN 3 END) AS tier FROM q, k WHERE query <> '' GROUP BY 1, 2)
SELECT query, company_key, CAST(tier AS INT) AS tier FROM m WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY query)""")
def key_lookup(t: Tables) -> DataFrame:
    asked = ["MACHINERY NATION_1", "NATION_2", "HOUSEHOLD", "CUSTOMER#000000001", "THE BUILDING NATION_3 OF TODAY", "zzz", ""]
    return Q.tiered_lookup(t.spark.createDataFrame([(q,) for q in asked], "query string"), t.inspections)


CODED = {"degree_of_inj": L.DEGREES, "nature_of_inj": L.NATURES, "event_type_code": L.EVENTS, "part_of_body": L.BODY_PARTS}


def decoded_sql(column: str, names: list[str]) -> str:
    c = f"regexp_replace(trim({column}), '\\.0$', '')"
    cases = " ".join(f"WHEN '{i}' THEN '{x}'" for i, x in enumerate(names, 1))
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'Not reported' ELSE CASE {c} {cases} ELSE 'Unknown (code ' || {c} || ')' END END"


def decode_all(t: Tables) -> DataFrame:
    rows = t.injuries
    for column, names in CODED.items():
        rows = R.decode(rows, column, t.spark.createDataFrame([(str(i), x) for i, x in enumerate(names, 1)], "code string, label string"), f"{column}_label")
    return rows


@op("J5", f"{with_views('injuries')} SELECT event_id, {', '.join(f'{decoded_sql(c, n)} AS {c}_label' for c, n in CODED.items())} FROM injuries")
def decoded(t: Tables) -> DataFrame:
    return decode_all(t).select("event_id", *[f"{c}_label" for c in CODED])


HIGH = f"standard = '5(A)(1)' AND (viol_type IN ('R', 'W') OR trunc(gravity) >= 8 OR {PENALTY} > 5000)"


@op("J3", f"""{with_views('violations', 'narratives')}, {NOTES} SELECT activity_nr, citation_id, standard, {PENALTY} AS penalty, md5(CASE WHEN {HIGH} THEN narrative END) AS digest
FROM violations LEFT JOIN notes USING (activity_nr, citation_id) WHERE delete_flag IS DISTINCT FROM 'X'""")
def told_violations(t: Tables) -> DataFrame:
    return R.with_narratives(R.typed(R.live(t.violations)), notes(t)).select("activity_nr", "citation_id", "standard", "penalty", F.md5("narrative").alias("digest"))


@op("J11", f"{I} SELECT DISTINCT activity_nr, company_key FROM inspections WHERE company_key IN (SELECT company_key FROM inspections WHERE site_state = 'ASIA')")
def selected_inspections(t: Tables) -> DataFrame:
    """All inspections under the keys of the selected establishments, each once."""
    chosen = t.inspections.filter(F.col("site_state") == "ASIA").select("company_key")
    return t.inspections.join(chosen, "company_key", "left_semi").dropDuplicates(["activity_nr"]).select("activity_nr", "company_key")


@op("J14", f"""{I}, req AS (SELECT c_name AS raw_name, c_mktsegment || ' ' || n_name AS company_key FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT ' not ' || c_name, 'NO KEY' FROM customer WHERE c_custkey % 100 = 0),
a AS (SELECT upper(trim(estab_name)) AS k, site_city, site_state, site_address, naics_code FROM inspections QUALIFY row_number() OVER (PARTITION BY upper(trim(estab_name)) ORDER BY open_date, activity_nr) = 1),
b AS (SELECT company_key AS k, site_city, site_state, site_address, naics_code FROM inspections QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY open_date, activity_nr) = 1),
j AS (SELECT raw_name, CASE WHEN a.k IS NOT NULL THEN a.site_city ELSE b.site_city END AS site_city, CASE WHEN a.k IS NOT NULL THEN a.site_state ELSE b.site_state END AS site_state,
  CASE WHEN a.k IS NOT NULL THEN a.site_address ELSE b.site_address END AS site_address, CASE WHEN a.k IS NOT NULL THEN a.naics_code ELSE b.naics_code END AS naics_code FROM req LEFT JOIN a ON upper(trim(raw_name)) = a.k LEFT JOIN b ON company_key = b.k)
SELECT raw_name, coalesce(upper(substr(site_city, 1, 1)) || lower(substr(site_city, 2)), '') AS site_city, coalesce(upper(site_state), '') AS site_state,
  coalesce(array_to_string([upper(substr(w, 1, 1)) || lower(substr(w, 2)) FOR w IN string_split(site_address, ' ')], ' '), '') AS site_address, coalesce(naics_code, '') AS naics_code FROM j""")
def attributes(t: Tables) -> DataFrame:
    """Customers, some of them never inspected under their name, and names that nobody knows."""
    named = t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    known = named.select(F.col("c_name").alias("raw_name"), F.concat("c_mktsegment", F.lit(" "), "n_name").alias("company_key"))
    unknown = t.raw("customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit(" not "), "c_name").alias("raw_name"), F.lit("NO KEY").alias("company_key"))
    return Q.first_attributes(known.union(unknown), t.inspections)


@op("A3", f"{O.WITH_FEATURES} SELECT {COLS} FROM feats")
def features_of_records(t: Tables) -> DataFrame:
    """The features of A2 from nested records."""
    facts = R.facts_of_records(R.nested(t.inspections, t.violations, t.injuries, t.accidents))
    return X.establishment_features(facts, AS_OF).select(*FEATS)


@op("A15", f"""{O.WITH_COMPANIES}, f AS (SELECT company_key, industry_group, count(*) AS n FROM sites WHERE score >= 30 AND industry_group IS NOT NULL GROUP BY 1, 2),
d AS (SELECT company_key, industry_group AS dominant FROM f QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY n DESC, industry_group) = 1)
SELECT company_key, dominant, coalesce(substr(industry_group, 1, 2), '?') AS sector, count(*) AS n FROM sites LEFT JOIN d USING (company_key) GROUP BY 1, 2, 3""")
def industries(t: Tables) -> DataFrame:
    """Sites of each company by sector, and the commonest industry of those with a medium or high score."""
    dominant = X.majority(t.sites.filter("score >= 30"), ["company_key"], "industry_group", "dominant")
    counts = t.sites.groupBy("company_key", F.coalesce(F.substring("industry_group", 1, 2), F.lit("?")).alias("sector")).agg(F.count("*").alias("n"))
    return counts.join(dominant, "company_key", "left").select("company_key", "dominant", "sector", "n")


@op("U4", f"""{with_views('violations')}, f AS (SELECT activity_nr, standard, min(citation_id) AS first FROM violations GROUP BY 1, 2) SELECT activity_nr, string_agg(standard, ', ' ORDER BY first, standard) AS standards FROM f GROUP BY 1""")
def first_seen(t: Tables) -> DataFrame:
    """Standards of each inspection in the order of their first citation, each once."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("citation_id", "standard"))), lambda x: x["standard"])
    return t.violations.groupBy("activity_nr").agg(F.array_join(F.array_distinct(ordered), ", ").alias("standards"))


@op("R5", f"""{with_views('inspections', 'injuries', 'accidents', 'narratives')}, s AS (SELECT summary_nr, {STITCH} AS narrative FROM narratives GROUP BY 1),
h AS (SELECT rel_insp_nr, summary_nr, string_agg({decoded_sql('degree_of_inj', L.DEGREES)} || ': ' || {decoded_sql('nature_of_inj', L.NATURES)} || ', ' || {decoded_sql('part_of_body', L.BODY_PARTS)}, '; ' ORDER BY event_id) AS injuries, count(*) AS n FROM injuries GROUP BY 1, 2)
SELECT company_key, activity_nr, summary_nr, a.event_date AS day, injuries, n, coalesce(substr(narrative, 1, 1000), '') AS abstract FROM inspections JOIN h ON rel_insp_nr = activity_nr JOIN accidents a USING (summary_nr) LEFT JOIN s USING (summary_nr)""")
def accident_context(t: Tables) -> DataFrame:
    """Accidents of each company with their injuries in words and the beginning of the abstract."""
    line = F.concat("degree_of_inj_label", F.lit(": "), "nature_of_inj_label", F.lit(", "), "part_of_body_label")
    hurt = decode_all(t).groupBy(F.col("rel_insp_nr").alias("activity_nr"), "summary_nr").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("h"))
    told = R.stitched(t.narratives, ["summary_nr"], "line_nr", "line_text")
    rows = t.inspections.select("company_key", "activity_nr").join(hurt, "activity_nr").join(t.accidents.select("summary_nr", F.col("event_date").alias("day")), "summary_nr").join(told, "summary_nr", "left")
    lines = F.array_join(F.transform("h", lambda x: x["line"]), "; ")
    return rows.select("company_key", "activity_nr", "summary_nr", "day", lines.alias("injuries"), F.size("h").cast("long").alias("n"), F.coalesce(F.substring("narrative", 1, 1000), F.lit("")).alias("abstract"))


@op("R6", f"""{I} SELECT DISTINCT company_key, 'location' AS kind, concat_ws(', ', nullif(site_address, ''), nullif(site_city, ''), nullif(trim(concat_ws(' ', nullif(site_state, ''), nullif(site_zip, ''))), '')) AS value FROM inspections
UNION ALL SELECT DISTINCT company_key, 'name', estab_name FROM inspections""")
def listings(t: Tables) -> DataFrame:
    """Locations and names of each company."""
    row = lambda kind, value: t.inspections.select("company_key", F.lit(kind).alias("kind"), value.alias("value")).distinct()
    return row("location", address()).unionByName(row("name", F.col("estab_name")))


