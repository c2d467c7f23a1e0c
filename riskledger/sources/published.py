"""Keyed tables: bucketed and sorted Parquet that lookups and joins read without a shuffle.

A table's rows lie in buckets by the hash of a key, sorted inside. A lookup by key opens one bucket, and
tables with one key and as many buckets join bucket by bucket. All tables of a load are one version (see
versions): each is written once, its rows counted by the write itself, and the counts are the load's manifest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskledger.functions.names import match_key
from riskledger.operators.records import live
from riskledger.sources import versions


@dataclass
class Layout:
    """A table's key, its number of buckets, and what its rows are sorted by inside (the key first)."""

    key: str
    buckets: int
    sort: list[str] = field(default_factory=list)

    @property
    def order(self) -> list[str]:
        return [self.key, *[c for c in self.sort if c != self.key]]


def register(spark: SparkSession, path: str, schema: StructType, layout: Layout) -> DataFrame:
    """The table at path, known to this session by its buckets: files alone don't tell them."""
    name = f"published_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    order = ", ".join(f"`{c}`" for c in layout.order)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout.key}`) SORTED BY ({order}) INTO {layout.buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_table(df: DataFrame, path: str, layout: Layout) -> int:
    """Write df in buckets and return its number of rows, counted on the way.

    Rows are dealt by key as the buckets are, so a task writes few buckets; Spark splits the part of a
    key that holds many rows, whose bucket then has several files.
    """
    spark, counted = df.sparkSession, Observation()
    dealt = df.observe(counted, F.count(F.lit(1)).alias("n")).hint("rebalance", layout.buckets, layout.key)
    name = f"writing_{uuid.uuid4().hex}"
    dealt.write.bucketBy(layout.buckets, layout.key).sortBy(*layout.order).option("path", path).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return counted.get["n"]


def publish(spark: SparkSession, base: str, tables: dict[str, tuple[DataFrame, Layout]], about: dict | None = None) -> dict[str, int]:
    """Write the tables as one version below base and let readers see it; rows by table.

    A load is complete if every table has rows; it is published either way, as its manifest says so.
    """
    version, rows, layouts = versions.new_version(spark, base), {}, {}
    for name, (df, layout) in tables.items():
        rows[name] = write_table(df, f"{version}/{name}", layout)
        layouts[name] = {"key": layout.key, "buckets": layout.buckets, "sort": layout.sort, "schema": df.schema.jsonValue()}
    versions.commit(spark, base, version, {**(about or {}), "rows": rows, "layouts": layouts})
    return rows


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the version that holds, with its buckets."""
    version, about = versions.current(spark, base)
    layout = about["layouts"][name]
    return register(spark, f"{version}/{name}", StructType.fromJson(layout["schema"]), Layout(layout["key"], layout["buckets"], layout["sort"]))


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """(dataset, n, complete) of the version that holds: rows of each dataset, and whether all have some. Nothing is counted again."""
    _, about = versions.current(spark, base)
    complete = min(about["rows"].values(), default=0) > 0
    return spark.createDataFrame([(name, n, complete) for name, n in about["rows"].items()], "dataset string, n long, complete boolean")


def keyed(inspections: DataFrame) -> DataFrame:
    """Inspections with the match key of their establishment ('' without a name)."""
    return inspections.withColumn("company_key", F.coalesce(match_key(F.upper("estab_name")), F.lit("")))


def company_dimension(inspections: DataFrame) -> DataFrame:
    """(company_key, name): each key that isn't empty once, with its name for people."""
    return inspections.filter("company_key != ''").select("company_key").distinct().withColumn("name", F.initcap(F.lower("company_key")))


def publish_records(spark: SparkSession, base: str, inspections: DataFrame, violations: DataFrame, accidents: DataFrame, injuries: DataFrame, *, buckets: int) -> dict[str, int]:
    """The load's tables by their lookup keys, soft-deleted violations left out. inspections
    has company_key (see keyed) and is written by inspection, for joins, and by company, for lookups."""
    return publish(spark, base, {
        "inspections": (inspections, Layout("activity_nr", buckets)),
        "inspections_by_company": (inspections, Layout("company_key", buckets, ["estab_name", "activity_nr"])),
        "companies": (company_dimension(inspections), Layout("company_key", buckets)),
        "violations": (live(violations), Layout("activity_nr", buckets, ["citation_id"])),
        "accidents": (accidents, Layout("summary_nr", buckets)),
        "injuries": (injuries, Layout("rel_insp_nr", buckets, ["summary_nr"])),
    })
