"""The domain tables as views over the star schema, in SQL that Spark and other engines share."""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime.date(2001, 8, 1)
CUTOFF = datetime.date(2000, 1, 1)

#: By name: what the view reads, and its text.
SECTOR = "CASE " + " ".join(
    f"WHEN n.n_nationkey = {i} THEN '{s}'" for i, s in enumerate(["11", "21", "22", "23", "31", "32", "33", "42", "44", "45", "48", "49", "51", "52", "53", "54", "55", "56", "61", "62", "71", "72", "81", "92"])
) + " ELSE '' END"
VIEWS: dict[str, str] = {
    "inspections": f"""
SELECT CAST(o.o_orderkey AS STRING) AS activity_nr, c.c_name AS estab_name, concat(c.c_mktsegment, ' ', n.n_name) AS company_key,
  concat(CAST(c.c_custkey AS STRING), ' ', c.c_mktsegment, ' ST') AS site_address, n.n_name AS site_city, r.r_name AS site_state, lpad(CAST(c.c_custkey AS STRING), 5, '0') AS site_zip,
  CASE WHEN n.n_nationkey < 24 THEN concat({SECTOR}, '0', CAST(c.c_custkey % 4 AS STRING), '10') ELSE '' END AS naics_code,
  CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F' THEN 'L' ELSE 'H' END AS insp_type, CAST(o.o_orderdate AS DATE) AS open_date, CAST(c.c_custkey % 500 AS INT) AS nr_in_estab
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "violations": """
SELECT CAST(l_orderkey AS STRING) AS activity_nr, lpad(CAST(l_linenumber AS STRING), 2, '0') AS citation_id, CASE WHEN l_tax = 0.08 THEN 'X' ELSE '' END AS delete_flag,
  CASE WHEN l_partkey % 50 = 0 THEN '5(A)(1)' ELSE concat('1910', lpad(CAST(l_partkey % 50 AS STRING), 4, '0'), ' A', lpad(CAST(l_linenumber AS STRING), 2, '0')) END AS standard,
  CASE WHEN l_returnflag = 'N' THEN 'S' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'R' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'W' ELSE 'O' END AS viol_type,
  CAST(l_shipdate AS DATE) AS issuance_date, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice * (1 - l_discount) / 10 END AS current_penalty, l_extendedprice / 10 AS initial_penalty,
  l_quantity / 5 AS gravity, CAST(l_quantity AS DOUBLE) AS nr_exposed, CASE WHEN l_suppkey % 3 = 0 THEN 'LEAD' ELSE '' END AS hazsub1, CASE WHEN l_suppkey % 5 = 0 THEN 'SILICA' ELSE ' ' END AS hazsub2
FROM lineitem WHERE l_discount >= 0.08""",
    "injuries": """
SELECT CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING) AS rel_insp_nr, CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING) AS summary_nr,
  CASE WHEN event_type = 'error' AND value > 100 THEN '1' WHEN event_type = 'error' THEN '2.0' ELSE '3' END AS degree_of_inj, CASE WHEN event_id % 26 = 0 THEN '' ELSE concat(CAST(event_id % 26 AS STRING), '.0') END AS nature_of_inj,
  CAST(user_id % 30 AS STRING) AS part_of_body, CAST(event_id % 15 AS STRING) AS event_type_code, CAST(ts AS DATE) AS event_date, props, event_id
FROM events WHERE event_type IN ('error', 'purchase') AND value > 60""",
    "accidents": """
SELECT CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING) AS summary_nr, min(CAST(ts AS DATE)) AS event_date, CASE WHEN max(value) > 150 THEN 'Y' ELSE '' END AS fatality, count(*) AS n_events
FROM events WHERE event_type IN ('error', 'purchase') AND value > 60 AND event_id % 4 <> 3 GROUP BY CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING)""",
    "names": """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' CO, INC.') WHEN 1 THEN concat(p_name, ' STORE #', CAST(p_partkey AS STRING)) WHEN 2 THEN concat(p_name, ' MFG') WHEN 3 THEN concat('The ', p_name)
  WHEN 4 THEN concat(p_name, ' DBA ', p_brand) WHEN 5 THEN concat(p_name, ' - ', upper(substring(p_type, 1, 3)), CAST(p_size AS STRING)) WHEN 6 THEN concat(p_name, ' & SONS LLC') ELSE p_name END AS raw_name, p_brand AS city, p_type AS state, p_retailprice AS weight
FROM part""",
    "narratives": "SELECT CAST(conv_id AS STRING) AS summary_nr, CAST(turn AS STRING) AS line_nr, text AS line_text, role FROM conversations",
}
NEEDS = {"inspections": ["orders", "customer", "nation", "region"], "violations": ["lineitem"], "injuries": ["events"], "accidents": ["events"], "names": ["part"], "narratives": ["conversations"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame over the given tables."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name]}
    text = reduce(lambda s, t: re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", s), tables, VIEWS[name])
    return spark.sql(text, **tables)


def with_views(*names: str) -> str:
    """The views as the start of a SQL query: WITH ... , without a last comma."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
