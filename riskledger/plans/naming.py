"""Names and company search as queries (see catalog). The SQL follows the definitions step by
step, with loops as recursive queries, and shares only fixed values with the column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.functions import fuzzy as Z
from riskledger.functions import names as N
from riskledger.functions import scores as S
from riskledger.operators import search as Q
from riskledger.operators.ranking import written
from riskledger.plans.bindings import with_views
from riskledger.plans.catalog import I, Tables, address, op

QUERIES = ["small ring", "RED WIDGET INC", "Blue Gear Mfg", "cold widget co", "mall rig"]


def sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def swap(c: str, pattern: str, new: str = "") -> str:
    """SQL: c with all matches replaced, trimmed."""
    return f"trim(regexp_replace({c}, {sq(pattern)}, {sq(new)}, 'g'))"


ASKED = "(VALUES " + ", ".join(f"({sq(q)})" for q in QUERIES) + ") q(query)"
CLEAN = f"upper(regexp_replace(regexp_replace(translate(strip_accents(raw_name), {sq(N.QUOTES + N.AMPERSANDS)}, repeat('''', {len(N.QUOTES)}) || '&'), '[‐-―−]', '-', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g'))"
CLEAN = swap(f"trim({CLEAN})", r"^[A-Z0-9]{5,}\s*-\s+([A-Z])", r"\1")
CLEAN = swap(swap(f"replace({swap(CLEAN, r'\s*/\s*', ' ')}, '''', '')", r"\s*&\s*", " AND "), r"\s{2,}", " ")
ONE_UNIT = swap(swap(swap("s", r"\s*#\s*\d+\s*$"), r"\s+\d{4,}\s*$"), r"\s*[-,/]\s*$")
ONE_PLACE = f"CASE WHEN facility THEN {swap(ONE_UNIT, rf'\s*[-,]?\s*\b(?:{N.FACILITY})\s*(?:#?\s*\d+)?\s*$')} ELSE {ONE_UNIT} END"
NO_THE = r"[,.]?\s*\bTHE\s*$"


def finished(c: str) -> str:
    """SQL: what follows the loop over a name's tail."""
    c = swap(c, NO_THE)
    for _ in range(5):
        c = swap(c, rf"[,.]?\s*\b(?:{N.LEGAL})\s*$")
    return swap(swap(swap(swap(c, NO_THE), r"^THE\s+"), r"[.,;:\-/]+$"), r"\s{2,}", " ")


WORDS = "CASE w " + " ".join(f"WHEN {sq(a)} THEN {sq(b)}" for a, b in N.ABBREVIATIONS.items()) + " ELSE w END"
TOKENS = lambda c: f"array_to_string(list_filter([{WORDS} FOR w IN regexp_split_to_array({c}, '\\s+')], lambda w: w <> ''), ' ')"
NAMES = f"""{with_views('names').replace('WITH', 'WITH RECURSIVE', 1)},
raws AS (SELECT raw_name FROM names UNION SELECT query FROM {ASKED}),
clean AS (SELECT raw_name, {CLEAN} AS c FROM raws),
peeled AS (SELECT raw_name, facility, {swap('c', r'\s+(?:D/?B/?A|F/?K/?A|A/?K/?A)\s+.+$')} AS s FROM clean, (VALUES (true), (false)) v(facility)
  UNION SELECT raw_name, facility, {ONE_PLACE} FROM peeled),
noise_free AS (SELECT raw_name, facility, {finished('arg_min(s, length(s))')} AS name FROM peeled GROUP BY 1, 2),
keys AS (SELECT raw_name, name AS place_free, {TOKENS('name')} AS company_key FROM noise_free WHERE facility),
keyed AS (SELECT * FROM names JOIN keys USING (raw_name))"""
BRANCH = r"^[A-Z0-9]{5,}\s+-\s+"
SHOWN = f"CASE WHEN regexp_matches(regexp_extract(u, {sq(BRANCH)}), '[0-9]') THEN regexp_replace(u, {sq(BRANCH)}, '') ELSE u END"
SHOWN = swap(swap(f"regexp_replace({SHOWN}, {sq(r'\s+D/?B/?A\s+.+$')}, '')", NO_THE), r"^\s*THE\s+")
for _ in range(3):
    SHOWN = swap(SHOWN, rf"[,.]?\s*\b(?:{N.SHORT_LEGAL})\s*$")
SHOWN = swap(swap(swap(SHOWN, r"[.,;\- ]+$"), r"\s*&\s*", " AND "), r"\s{2,}", " ")
DISPLAY = f"{with_views('names')}, d AS (SELECT p_partkey, raw_name, {SHOWN} AS d FROM (SELECT *, upper(trim(raw_name)) AS u FROM names))"
PARENT = swap(swap(swap(swap("d", r"\s+-?\s*[A-Z]{1,5}[0-9]{1,4}\s*$"), r"\s*\([A-Z0-9]{2,8}\)\s*$"), r"\s+(?:SITE|CAMPUS|FACILITY|WAREHOUSE|DC|FC|IDC|PDC|UNIT|LOC)\s*\d*\s*$"), r"\s*[-/]\s*$")
CODE = r"upper(regexp_extract(raw_name, '(?i)(?:[\s\-]+|\()([A-Z]{1,5}[0-9]{1,4}|[A-Z0-9]{2,8})(?:\)|[\s\-]|$)', 1))"
CODE_SQL = f"CASE WHEN {CODE} <> '' AND {CODE} NOT IN ({', '.join(map(sq, N.NO_CODE))}) AND NOT regexp_full_match({CODE}, '[0-9]+') THEN {CODE} END"

PROCESSED = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'))"
TEXT = lambda words: f"array_to_string({words}, ' ')"


def common(a: str, b: str) -> str:
    """SQL: length of the longest common subsequence, by the bits of a's places."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    places = f"list_aggregate(list_transform(string_split({a}, ''), lambda x, i: CASE WHEN x = ch THEN CAST(1 AS HUGEINT) << (i - 1) ELSE CAST(0 AS HUGEINT) END), 'bit_or')"
    state = f"list_reduce(list_transform(string_split({b}, ''), lambda ch: {places}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(length({a}) - bit_count({state}))"


def ratio(a: str, b: str) -> str:
    return f"(CAST(2 * {common(a, b)} AS DOUBLE) / (length({a}) + length({b})))"


def partial(a: str, b: str) -> str:
    """SQL: the best ratio of the shorter text to a part of the longer; 0 where one is empty."""
    part = lambda t, of: f"substr({t}, greatest(k, 0) + 1, least(k, 0) + length({of}))"
    one = lambda x, y: f"CASE WHEN length({x}) BETWEEN 1 AND length({y}) THEN list_max(list_transform(range(1 - length({x}), length({y})), lambda k: {ratio(x, part(y, x))})) ELSE 0 END"
    return f"greatest({one(a, b)}, {one(b, a)})"


#: SQL: the ratios of common words and rests.
APART = f"(length(ra) + length(rb) - 2 * {common('ra', 'rb')})"
GAP = "CAST(c <> '' AS INT)"
SETS = f"""CASE WHEN c <> '' AND (ra = '' OR rb = '') THEN 1 ELSE greatest(1 - CAST({APART} AS DOUBLE) / (2 * length(c) + 2 * {GAP} + length(ra) + length(rb)),
  CASE WHEN c <> '' THEN 1 - CAST(1 + length(ra) AS DOUBLE) / (2 * length(c) + 1 + length(ra)) ELSE 0 END, CASE WHEN c <> '' THEN 1 - CAST(1 + length(rb) AS DOUBLE) / (2 * length(c) + 1 + length(rb)) ELSE 0 END) END"""
SCALE = f"CASE WHEN times <= {Z.FAR_BEYOND} THEN CAST({Z.PARTS} AS DOUBLE) ELSE CAST({Z.FAR_PARTS} AS DOUBLE) END"


def with_similarity(pairs: str) -> str:
    """SQL: common table expressions over pairs (qk, ck, ...) that end in scored, with similarity."""
    return f"""processed AS (SELECT *, {PROCESSED('qk')} AS a, {PROCESSED('ck')} AS b FROM {pairs}),
worded AS (SELECT *, list_filter(string_split(a, ' '), lambda w: w <> '') AS wa, list_filter(string_split(b, ' '), lambda w: w <> '') AS wb FROM processed WHERE a <> '' AND b <> ''),
parted AS (SELECT *, {TEXT('list_sort(wa)')} AS sa, {TEXT('list_sort(wb)')} AS sb, {TEXT('list_sort(list_intersect(list_distinct(wa), wb))')} AS c,
  {TEXT('list_sort(list_filter(list_distinct(wa), lambda w: NOT list_contains(wb, w)))')} AS ra, {TEXT('list_sort(list_filter(list_distinct(wb), lambda w: NOT list_contains(wa, w)))')} AS rb,
  CAST(greatest(length(a), length(b)) AS DOUBLE) / least(length(a), length(b)) AS times FROM worded),
scored AS (SELECT *, round(CASE WHEN times < {Z.PARTS_FROM} THEN greatest({ratio('a', 'b')}, CAST({Z.TOKENS} AS DOUBLE) * greatest({ratio('sa', 'sb')}, {SETS}))
  ELSE greatest({ratio('a', 'b')}, {SCALE} * {partial('a', 'b')}, CAST({Z.TOKENS} AS DOUBLE) * {SCALE} * CASE WHEN c <> '' THEN 1 ELSE greatest({partial('sa', 'sb')}, {partial('ra', 'rb')}) END) END, 6) AS similarity FROM parted)"""


#: All pairs of queries and keys are scored.
SEARCH = f"""{NAMES},
idx AS (SELECT company_key AS ck, count(*) AS members FROM keyed WHERE company_key <> '' GROUP BY 1),
qs AS (SELECT query, company_key AS qk FROM {ASKED} JOIN keys ON raw_name = query),
pairs AS (SELECT query, qk, ck, members, qk AS query_key, ck AS company_key FROM qs, idx WHERE length(ck) > 1),
{with_similarity('pairs')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, company_key) AS rank FROM scored WHERE similarity >= 0.55 QUALIFY rank <= 500),
sized AS (SELECT r.*, facilities FROM ranked r JOIN (SELECT company_key, count(*) AS facilities FROM keyed GROUP BY 1) USING (company_key)),
placed AS (SELECT *, facilities = 1 AND similarity < 0.65 AS unmatched,
    row_number() OVER (PARTITION BY query, facilities = 1 AND similarity < 0.65 ORDER BY similarity DESC, facilities DESC, company_key) AS place FROM sized),
grouped AS (SELECT *, CASE WHEN unmatched THEN 'unmatched' WHEN place = 1 THEN 'top' ELSE 'other' END AS tier FROM placed WHERE place <= CASE WHEN unmatched THEN 10 ELSE 5 END)"""


def search(t: Tables) -> DataFrame:
    q = t.spark.createDataFrame([(x,) for x in QUERIES], "query string")
    return Q.fuzzy_candidates(q, Q.key_index(t.keyed_names))


def by_name(name: str, column, sql: str) -> None:
    """Register an expression of raw names."""
    op(name, sql)(lambda t: t.names.select("p_partkey", column(F.col("raw_name"))))


by_name("H1", lambda c: N.preclean(c).alias("clean"), f"{NAMES} SELECT p_partkey, c AS clean FROM names JOIN clean USING (raw_name)")
by_name("H2", lambda c: N.without_noise(N.preclean(c), facility=True).alias("name"), f"{NAMES} SELECT p_partkey, place_free AS name FROM keyed")
by_name("H3", lambda c: N.canonical_tokens(F.upper(c)).alias("name"), f"{with_views('names')} SELECT p_partkey, {TOKENS('upper(raw_name)')} AS name FROM names")
by_name("H4", lambda c: N.canonical_name(c).alias("canonical"), f"{NAMES} SELECT p_partkey, name AS canonical FROM names JOIN noise_free USING (raw_name) WHERE NOT facility")
by_name("H5", lambda c: N.match_key(c).alias("company_key"), f"{NAMES} SELECT p_partkey, company_key FROM keyed")
by_name("H6", lambda c: N.display_name(c).alias("parent"), f"{DISPLAY} SELECT p_partkey, d AS parent FROM d")
by_name("H7", lambda c: N.facility_code(c).alias("code"), f"{with_views('names')} SELECT p_partkey, {CODE_SQL} AS code FROM names")
by_name("H8", lambda c: N.parent_prefix(c).alias("prefix"), f"{DISPLAY} SELECT p_partkey, coalesce(nullif({PARENT}, ''), d) AS prefix FROM d")


@op("H9", f"{SEARCH} SELECT query, company_key, similarity FROM ranked")
def similarities(t: Tables) -> DataFrame:
    return search(t).select("query", "company_key", "similarity")


@op("H9_pairs", f"""{NAMES}, pairs AS (SELECT p_partkey, raw_name, company_key AS ck, upper(city) AS qk FROM keyed), {with_similarity('pairs')}
SELECT p_partkey, coalesce(similarity, 0) AS similarity FROM names LEFT JOIN (SELECT p_partkey, CASE WHEN length(ck) > 1 THEN similarity ELSE 0 END AS similarity FROM scored) USING (p_partkey)""")
def paired_similarities(t: Tables) -> DataFrame:
    """Each name's key and its brand, as columns."""
    return t.names.select("p_partkey", F.round(Z.similarity(F.upper("city"), N.match_key(F.col("raw_name"))), 6).alias("similarity"))


@op("H10", f"""{SEARCH} SELECT query, CASE WHEN similarity >= 0.85 THEN 'High' WHEN similarity >= 0.65 THEN 'Medium' ELSE 'Low' END AS confidence, count(*) AS n
FROM ranked GROUP BY 1, 2""")
def confidences(t: Tables) -> DataFrame:
    return search(t).groupBy("query", S.confidence_label(F.col("similarity")).alias("confidence")).agg(F.count("*").alias("n"))


@op("H11", f"""{I} SELECT activity_nr, array_to_string([upper(substr(w, 1, 1)) || substr(lower(w), 2) FOR w IN string_split(site_address, ' ')], ' ') AS address
FROM inspections""")
def title_case(t: Tables) -> DataFrame:
    return t.inspections.select("activity_nr", F.initcap(F.lower("site_address")).alias("address"))


@op("H12", f"""{I} SELECT activity_nr, concat_ws(', ', nullif(site_address, ''), nullif(site_city, ''),
  nullif(trim(concat_ws(' ', nullif(site_state, ''), nullif(site_zip, ''))), '')) AS location FROM inspections""")
def addresses(t: Tables) -> DataFrame:
    return t.inspections.select("activity_nr", address().alias("location"))


@op("S6", f"{NAMES} SELECT company_key, count(*) AS members, min(raw_name) AS sample FROM keyed WHERE company_key <> '' GROUP BY 1")
def company_dimension(t: Tables) -> DataFrame:
    return Q.key_index(t.keyed_names)


@op("S12", f"""{NAMES}, k AS (SELECT company_key, min(p_partkey) AS first_key FROM keyed WHERE company_key <> '' GROUP BY 1)
SELECT count(*) AS in_table, count(*) FILTER (first_key % 10 <> 0) AS in_index, count(*) = count(*) FILTER (first_key % 10 <> 0) AS fresh FROM k""")
def index_staleness(t: Tables) -> DataFrame:
    """A stored index that lacks the keys that came with every tenth part is stale."""
    keyed = t.keyed_names.filter("company_key != ''")
    stored = keyed.groupBy("company_key").agg(F.min("p_partkey").alias("__first")).filter("__first % 10 != 0")
    return Q.index_state(keyed, stored)


@op("J10", f"{SEARCH} SELECT query, query_key, company_key, members, similarity, CAST(rank AS INT) AS rank FROM ranked")
def fuzzy_search(t: Tables) -> DataFrame:
    return search(t)


@op("J13", f"{SEARCH} SELECT query, company_key, raw_name FROM ranked JOIN keyed USING (company_key) WHERE rank <= 5")
def members(t: Tables) -> DataFrame:
    return search(t).filter("rank <= 5").join(t.keyed_names, "company_key").select("query", "company_key", "raw_name")


@op("K1", f"{SEARCH} SELECT query, tier, CAST(place AS INT) AS place, company_key FROM grouped")
def ordered_groups(t: Tables) -> DataFrame:
    return Q.grouped_results(search(t), Q.keyed_facilities(t.keyed_names)).select("query", "tier", "place", "company_key")


@op("R2", f"""{SEARCH}, f AS (SELECT company_key, string_agg(DISTINCT coalesce({CODE_SQL}, '-'), ' ' ORDER BY coalesce({CODE_SQL}, '-')) AS codes FROM keyed GROUP BY 1)
SELECT query, tier, CAST(place AS INT) AS place, company_key, CASE WHEN similarity >= 0.85 THEN 'High' WHEN similarity >= 0.65 THEN 'Medium' ELSE 'Low' END AS confidence,
  facilities, codes FROM grouped JOIN f USING (company_key)""")
def company_groups(t: Tables) -> DataFrame:
    facilities = written(Q.keyed_facilities(t.keyed_names), "facilities")
    groups = written(Q.grouped_results(search(t), facilities), "groups")
    codes = Q.group_facilities(groups, facilities).groupBy("query", "company_key").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("code", F.lit("-")))), " ").alias("codes"))
    return groups.join(codes, ["query", "company_key"]).select("query", "tier", "place", "company_key", "confidence", "facilities", "codes")


@op("R2_facilities", f"{SEARCH} SELECT query, tier, CAST(place AS INT) AS place, company_key, raw_name, {CODE_SQL} AS code FROM grouped JOIN keyed USING (company_key)")
def facility_rows(t: Tables) -> DataFrame:
    facilities = Q.keyed_facilities(t.keyed_names)
    return Q.group_facilities(Q.grouped_results(search(t), facilities), facilities).select("query", "tier", "place", "company_key", "raw_name", "code")


@op("D13", f"""{NAMES}, v AS (SELECT p_partkey, place_free AS old_key, company_key AS new_key FROM keyed)
SELECT p_partkey, old_key, new_key FROM v WHERE old_key <> new_key""")
def rekeyed(t: Tables) -> DataFrame:
    """Keys stored under the rule that did not expand abbreviations, recomputed under the present one."""
    stored = t.names.select("p_partkey", "raw_name", N.without_noise(N.preclean(F.col("raw_name")), facility=True).alias("company_key"))
    return Q.rekeyed(stored, N.match_key, ["p_partkey"])
