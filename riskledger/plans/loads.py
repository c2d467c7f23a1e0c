"""Sources, sinks and loads as queries (see catalog): what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.operators.ranking import written
from riskledger.plans import oracle_base as O
from riskledger.plans.bindings import CUTOFF, with_views
from riskledger.plans.catalog import I, Tables, op
from riskledger.plans.naming import NAMES as NAMES_SQL
from riskledger.sources import bronze as B
from riskledger.sources import published as P
from riskledger.streaming.incremental import latest, load_inspections, load_violations, loaded

NAMES = with_views("names")
#: SQL: a key with a capital after each space.
TITLE = "array_to_string([upper(substr(w, 1, 1)) || substr(lower(w), 2) FOR w IN string_split(company_key, ' ')], ' ')"


def buckets(t: Tables) -> int:
    """As many buckets as the session shuffles into, so that its other shuffles can meet them."""
    return int(t.spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(t: Tables) -> tuple[str, list[str]]:
    """Names as chunked CSV files of text columns, chunk by part key, under names that sort naturally."""
    path = B.shared_folder(t.spark, "bronze")
    rows = t.names.select(F.col("p_partkey").cast("string").alias("P_PARTKEY"), F.col("raw_name").alias("RAW_NAME"), F.concat(F.lit("part"), F.pmod("p_partkey", F.lit(12)).cast("string")).alias("chunk"))
    rows.repartition("chunk").write.partitionBy("chunk").option("header", True).option("escape", '"').csv(path)
    return path, ["P_PARTKEY", "RAW_NAME"]


@op("S1", f"{NAMES} SELECT p_partkey, raw_name, p_partkey % 12 + 1 AS chunk_order FROM names")
def csv_scan(t: Tables) -> DataFrame:
    """Rows with the natural place of their chunk: part2 comes before part10."""
    path, columns = chunks(t)
    rows = B.read_csv_folder(t.spark, path, columns, chunks=True, line_ends=False)
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "raw_name", F.col("chunk_order").cast("long").alias("chunk_order"))


@op("K6", f"{NAMES} SELECT DISTINCT 'name' AS kind, lower(raw_name) AS folded, CAST(NULL AS BIGINT) AS place FROM names UNION ALL SELECT 'chunk', 'part' || r, r + 1 FROM range(12) t(r) WHERE r IN (SELECT p_partkey % 12 FROM names)")
def sorted_names(t: Tables) -> DataFrame:
    """Names by their folded form, and chunks in natural order."""
    path, _ = chunks(t)
    folded = t.names.select(F.lit("name").alias("kind"), F.lower("raw_name").alias("folded"), F.lit(None).cast("long").alias("place")).distinct()
    return folded.unionByName(B.chunk_order(t.spark, path).select(F.lit("chunk").alias("kind"), F.col("chunk").alias("folded"), F.col("chunk_order").cast("long").alias("place"))).orderBy("kind", "place", "folded")


@op("S2", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, '' AS absent FROM orders WHERE substr(CAST(o_orderdate AS VARCHAR), 1, 10) >= '1998-01-01'")
def consolidated(t: Tables) -> DataFrame:
    """A dump with a date column, filtered, projected and written as one table."""
    raw = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", F.col("o_orderdate").cast("string").alias("o_orderdate"))
    return written(B.consolidated(raw, ["o_orderkey", "o_orderstatus", "absent"], "o_orderdate", "1998-01-01"), "consolidated")


TABLES = ["inspections", "violations", "injuries", "accidents", "names", "narratives"]


@op("S7", f"{with_views(*TABLES)} " + " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n, (SELECT min(k) > 0 FROM (VALUES {', '.join(f'((SELECT count(*) FROM {x}))' for x in TABLES)}) v(k)) AS complete FROM {n}" for n in TABLES))
def manifest(t: Tables) -> DataFrame:
    """All tables published as one load; their rows as the writes counted them."""
    keys = {"inspections": "activity_nr", "violations": "activity_nr", "injuries": "rel_insp_nr", "accidents": "summary_nr", "names": "p_partkey", "narratives": "summary_nr"}
    base = B.shared_folder(t.spark, "published")
    P.publish(t.spark, base, {name: (getattr(t, name), P.Layout(keys[name], buckets(t))) for name in TABLES})
    return P.manifest(t.spark, base)


@op("S5", f"""{with_views('inspections', 'violations')} SELECT company_key, activity_nr, citation_id, viol_type FROM violations JOIN inspections USING (activity_nr) WHERE delete_flag IS DISTINCT FROM 'X'""")
def published_records(t: Tables) -> DataFrame:
    """The tables published by their keys, and of what readers then find violations with their companies, joined bucket by bucket."""
    base = B.shared_folder(t.spark, "published")
    P.publish_records(t.spark, base, t.inspections, t.violations, t.accidents, t.injuries, buckets=buckets(t))
    violations, inspections = P.read(t.spark, base, "violations"), P.read(t.spark, base, "inspections")
    return violations.join(inspections.select("activity_nr", "company_key"), "activity_nr").select("company_key", "activity_nr", "citation_id", "viol_type")


@op("S5_companies", f"{NAMES_SQL} SELECT DISTINCT company_key, {TITLE} AS name FROM keyed WHERE company_key <> ''")
def published_companies(t: Tables) -> DataFrame:
    """Inspections of the raw names with their derived keys, published, and the dimension of the companies."""
    base = B.shared_folder(t.spark, "published")
    inspections = P.keyed(t.names.select(F.col("p_partkey").alias("activity_nr"), F.col("raw_name").alias("estab_name")))
    P.publish(t.spark, base, {"inspections": (inspections, P.Layout("company_key", buckets(t))), "companies": (P.company_dimension(inspections), P.Layout("company_key", buckets(t)))})
    return P.read(t.spark, base, "companies")


@op("S8", f"""{I}, f AS (SELECT DISTINCT substr(naics_code, 1, 2) AS s, substr(naics_code, 1, 4) AS g FROM inspections WHERE naics_code <> '')
SELECT s AS code, CASE WHEN s IN ('31', '32', '33') THEN 'Making things' WHEN s IN ('44', '45') THEN 'Selling things' ELSE 'Sector ' || s END AS title FROM (SELECT DISTINCT s FROM f)
UNION ALL SELECT DISTINCT g, 'Group ' || g FROM f WHERE s NOT IN ('31', '32', '33')""")
def industry_reference(t: Tables) -> DataFrame:
    """An export with headers of its own, footnote letters, ranges, blanks and codes out of range, read back."""
    codes = t.inspections.filter("naics_code != ''").select(F.substring("naics_code", 1, 2).alias("s"), F.substring("naics_code", 1, 4).alias("g")).distinct()
    code = F.when(F.col("s").isin("31", "32", "33"), "31-33").when(F.col("s").isin("44", "45"), "44-45").otherwise(F.col("s"))
    title = F.when(F.col("s").isin("31", "32", "33"), "Making thingsT").when(F.col("s").isin("44", "45"), " Selling things").otherwise(F.concat(F.lit("Sector "), "s", F.lit("T")))
    rows = codes.select(code.alias("c"), title.alias("t")).union(codes.filter("s not in ('31', '32', '33')").select("g", F.concat(F.lit("Group "), "g"))).distinct()
    junk = codes.select(F.lit("1").alias("c"), F.lit("One digitT").alias("t")).union(codes.select(F.lit("1234567"), F.lit("Too long"))).union(codes.select(F.lit("5555"), F.lit("T"))).distinct()
    path = B.shared_folder(t.spark, "reference")
    rows.union(junk).select(F.lit("1").alias("Seq. No."), F.col("c").alias("2022 NAICS US   Code"), F.col("t").alias("2022 NAICS US Title")).write.option("header", True).csv(path)
    return B.read_industry_reference(t.spark, path)


@op("S9", f"{O.WITH_FEATURES} SELECT estab, n_inspections, total_penalty, industry_group FROM feats")
def json_population(t: Tables) -> DataFrame:
    """The population written as JSON and read again with its schema."""
    rows = t.features.select("estab", "n_inspections", "total_penalty", "industry_group")
    return B.json_round_trip(rows, B.shared_folder(t.spark, "population"))


@op("S10", f"""{with_views('inspections', 'violations')} SELECT 'inspections' AS dataset, activity_nr, estab_name AS what, open_date AS day FROM inspections
UNION ALL SELECT 'violations', activity_nr, citation_id, issuance_date FROM violations""")
def bulk(t: Tables) -> DataFrame:
    """All inspections and violations, as training reads them."""
    row = lambda df, name, what, day: df.select(F.lit(name).alias("dataset"), "activity_nr", F.col(what).alias("what"), F.col(day).alias("day"))
    return row(t.inspections, "inspections", "estab_name", "open_date").unionByName(row(t.violations, "violations", "citation_id", "issuance_date"))


@op("ST1", f"{with_views('violations')} SELECT activity_nr, citation_id, viol_type, issuance_date FROM violations WHERE delete_flag IS DISTINCT FROM 'X' AND current_penalty > 0 QUALIFY row_number() OVER (PARTITION BY activity_nr, citation_id ORDER BY viol_type, issuance_date) = 1")
def incremental(t: Tables) -> DataFrame:
    """Violations that landed in two loads, some of them twice, each loaded once; the second brings old rows, too."""
    land, table, progress = (B.shared_folder(t.spark, n) for n in ("landing", "loaded", "progress"))
    rows = t.violations.select("activity_nr", "citation_id", "viol_type", "issuance_date", "current_penalty", "delete_flag")
    early, again = F.crc32(F.concat("activity_nr", F.lit("-"), "citation_id")) % 3 != 0, F.crc32("activity_nr") % 11 == 0
    schema = "activity_nr string, citation_id string, viol_type string, issuance_date date, current_penalty double, delete_flag string"
    load = lambda: load_violations(t.spark, land, schema, table, progress, buckets=buckets(t))
    rows.filter(early).unionByName(rows.filter(early & again)).write.parquet(land)
    load()
    rows.filter(~early | again).write.mode("append").parquet(land)
    load()
    return loaded(t.spark, table, schema).select("activity_nr", "citation_id", "viol_type", "issuance_date")


@op("ST1_companies", f"{NAMES_SQL} SELECT DISTINCT company_key, {TITLE} AS name FROM keyed WHERE company_key <> ''")
def incremental_companies(t: Tables) -> DataFrame:
    """Inspections of the raw names in two loads, and the dimension that their keys extended."""
    land, table, companies, progress = (B.shared_folder(t.spark, n) for n in ("landing", "loaded", "companies", "progress"))
    rows = t.names.select(F.col("p_partkey").alias("activity_nr"), F.col("raw_name").alias("estab_name"), F.date_add(F.lit(CUTOFF), F.pmod("p_partkey", F.lit(2000)).cast("int")).alias("open_date"))
    for part in (rows.filter("activity_nr % 3 != 0"), rows.filter("activity_nr % 3 = 0 or activity_nr % 7 = 0")):
        part.write.mode("append").parquet(land)
        load_inspections(t.spark, land, "activity_nr long, estab_name string, open_date date", table, companies, progress)
    return loaded(t.spark, companies, "company_key string, name string")


@op("ST2", f"{with_views('violations')} SELECT activity_nr, max(issuance_date) AS issuance_date FROM violations WHERE issuance_date IS NOT NULL GROUP BY 1")
def late_rows(t: Tables) -> DataFrame:
    """Stored and late violations, of each inspection the newest."""
    old = F.col("issuance_date") < F.lit(CUTOFF)
    return latest(t.violations.filter(old), t.violations.filter(~old), ["activity_nr"], ["issuance_date"]).select("activity_nr", "issuance_date")
