"""Incremental loads with Structured Streaming: rows once by key, tables extended, late rows merged.

A loaded table lies in buckets by the hash of its key, each a folder with a folder for each batch
below. A batch reads the keys of the buckets that it touches, and of these only files whose keys may meet its own;
a row may be as late as it likes. A batch that is replayed after a failure writes its own folders anew and nothing else.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from riskledger.operators.records import live
from riskledger.sources.published import company_dimension, keyed

#: Batch number of rows that a table starts with.
FIRST = -1


def stored(spark: SparkSession, table: str, schema: StructType) -> DataFrame | None:
    """The loaded table with its bucket and batch; None where nothing was loaded yet."""
    place = [StructField("bucket", IntegerType()), StructField("batch", LongType())]
    try:
        return spark.read.schema(StructType([*schema.fields, *place])).parquet(table)
    except AnalysisException:
        return None


def loaded(spark: SparkSession, table: str, schema: str | StructType) -> DataFrame:
    """The rows of a loaded table; without a table, none."""
    schema = spark.createDataFrame([], schema).schema
    rows = stored(spark, table, schema)
    return spark.createDataFrame([], schema) if rows is None else rows.select(*schema.names)


def one_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the rows of each key the least by the other columns: the same one in every run."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    least = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__row"))
    return least.select(*[F.col(c) if c in key else F.col("__row")[c].alias(c) for c in rows.columns])


def merge_new(rows: DataFrame, table: str, key: list[str], batch: int, *, buckets: int = 64) -> DataFrame:
    """Add the rows whose key the table at the path does not have, as the given batch; what this
    batch added. Rows with a null in their key are keys of their own kind, and as good as others."""
    spark = rows.sparkSession
    mine = one_each(rows, key).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
    try:
        known = stored(spark, table, rows.schema)
        if known is not None:
            first = F.col(key[0])
            touched = mine.groupBy("bucket").agg(F.min(first).alias("lo"), F.max(first).alias("hi"), F.max(first.isNull()).alias("gap")).collect()  # a row a bucket
            known = known.filter((F.col("batch") != batch) & F.col("bucket").isin([r["bucket"] for r in touched]))
            ends = [r[c] for r in touched for c in ("lo", "hi") if r[c] is not None]
            if ends and not any(r["gap"] for r in touched):
                known = known.filter(first.between(min(ends), max(ends)))
            known = known.select("bucket", *key).distinct().alias("k")
            same = [F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("bucket", *key)]
            new = mine.alias("m").join(known, same, "left_anti")
        else:
            new = mine
        new = new.withColumn("batch", F.lit(batch).cast("long")).repartition("bucket").sortWithinPartitions("bucket", *key)
        new.write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(table)
    finally:
        mine.unpersist()
    added = stored(spark, table, rows.schema)
    return rows.limit(0) if added is None else added.filter(F.col("batch") == batch).select(*rows.columns)


def load_new(
    spark: SparkSession, landing: str, schema: str, table: str, checkpoint: str, *, key: list[str], event_time: str, since: datetime.date | None = None, derive: Callable[[DataFrame], DataFrame] | None = None,
    then: Callable[[DataFrame, int], object] | None = None, buckets: int = 64,
) -> None:
    """ST1: everything that landed and was not loaded yet, in one run that ends by itself, into the table at the path table.

    Rows whose event_time is not after since don't load (null ones don't either, given since); derive
    makes of the others what is stored; of equal keys one row loads, and none whose key is there, however long
    ago it came and however late this one does. then gets what a batch added, and its number, and may be
    called again for a batch that is replayed.
    """
    rows = spark.readStream.schema(schema).parquet(landing)
    if since is not None:
        rows = rows.filter(F.col(event_time) > F.lit(since))
    if derive is not None:
        rows = derive(rows)

    def append(batch: DataFrame, number: int) -> None:
        added = merge_new(batch, table, key, number, buckets=buckets)
        if then is not None:
            then(added, number)

    rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def load_inspections(spark: SparkSession, landing: str, schema: str, table: str, companies: str, checkpoint: str, **options) -> None:
    """ST1: new inspections with the match key of their establishment (H5), and new keys into the dimension at the path companies."""
    extend = lambda added, number: merge_new(company_dimension(added), companies, ["company_key"], number)
    load_new(spark, landing, schema, table, checkpoint, key=["activity_nr"], event_time="open_date", derive=keyed, then=extend, **options)


def load_violations(spark: SparkSession, landing: str, schema: str, table: str, checkpoint: str, **options) -> None:
    """ST1: new violations with a penalty, without soft-deleted ones."""
    fined = lambda rows: live(rows).filter("current_penalty > 0")
    load_new(spark, landing, schema, table, checkpoint, key=["activity_nr", "citation_id"], event_time="issuance_date", derive=fined, **options)


def latest(stored: DataFrame, late: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """ST2: stored and late rows, of each key the one with the highest version; all columns break ties."""
    both = stored.unionByName(late)
    order = [F.col(c).desc_nulls_last() for c in [*version, *[c for c in both.columns if c not in {*key, *version}]]]
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")
