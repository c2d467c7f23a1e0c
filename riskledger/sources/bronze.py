"""Raw record dumps: folders of chunked CSV files whose columns are all text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir; in local mode a temporary one where that is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def number(name: Column) -> Column:
    """The last number in a file's or folder's name, for natural order; 0 without one."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long"), F.lit(0))


def chunk_order(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a folder (chunk=... below it) with their place in natural order; one row a chunk."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"chunk=([^/]+)/", 1).alias("chunk")).distinct()
    return names.withColumn("chunk_order", F.row_number().over(Window.orderBy(number(F.col("chunk")), "chunk")))


def read_csv_folder(spark: SparkSession, folder: str, columns: list[str], *, chunks: bool = False, line_ends: bool = True) -> DataFrame:
    """All chunks as text columns with lower-case names; texts may be long and, with line_ends, hold line ends; a
    file is then one task, else it is cut into many. With chunks, chunk_order is the natural place of the row's chunk."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("multiLine", line_ends).option("escape", '"').option("maxCharsPerColumn", -1)
    rows = reader.csv(folder)
    if not chunks:
        return rows.select(*columns).toDF(*[c.lower() for c in columns])
    rows = rows.select(*columns, F.col("chunk").cast("string")).toDF(*[c.lower() for c in columns], "chunk")
    return rows.join(F.broadcast(chunk_order(spark, folder)), "chunk").drop("chunk")  # one row a file


def consolidated(raw: DataFrame, columns: list[str], date: str, cutoff: str) -> DataFrame:
    """Rows from the cutoff on, in fixed columns; absent ones are empty."""
    kept = raw.filter(F.substring(date, 1, 10) >= cutoff)
    return kept.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def read_industry_reference(spark: SparkSession, path: str) -> DataFrame:
    """(code, title) from a CSV export. The code's column is the first whose header names both
    a code and NAICS, the title's the first that names a title. Blank rows go, a capital at the end of a title is a
    footnote, a range stands for each code in it, and codes have 2 to 6 digits."""
    sheet = spark.read.option("header", True).csv(path)
    fits = lambda *words: next(c for c in sheet.columns if all(w in c.strip().lower() for w in words))
    rows = sheet.select(F.trim(F.col(f"`{fits('code', 'naics')}`")).alias("c"), F.trim(F.col(f"`{fits('title')}`")).alias("t")).filter("c is not null and t is not null")
    rows = rows.select("c", F.trim(F.regexp_replace("t", "[A-Z]$", "")).alias("title")).filter("title != ''")
    ends = F.regexp_extract("c", r"^(\d+)-(\d+)$", 1), F.regexp_extract("c", r"^(\d+)-(\d+)$", 2)
    span = F.transform(F.sequence(ends[0].try_cast("int"), ends[1].try_cast("int")), lambda n: F.lpad(n.cast("string"), F.length(ends[0]), "0"))
    codes = F.when(ends[0] != "", span).otherwise(F.array(F.regexp_replace("c", "[^0-9]", "")))
    return rows.select(F.explode(codes).alias("code"), "title").filter(F.length("code").between(2, 6)).distinct()


def json_round_trip(rows: DataFrame, path: str) -> DataFrame:
    """Rows written as JSON lines and read back under their own schema, nulls included."""
    rows.write.option("ignoreNullFields", False).json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)
