"""What the operators of this subpackage share: table readers, shared scratch
folders, let-binding for column expressions, and a join that no hot key slows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where
    a local session has none, as in tests, a new temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from
    files that outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut wrote. Only for those whose every use was itself written
    by a finished job: then nothing that is lost later is computed from them again."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda variable, unlike a
    projected alias, is never inlined into a nested lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text (null: none), ASCII lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, *, total: int | None = None, hot_keys: int = 1000) -> DataFrame:
    """Left join of left with right, which has one row per key and the number
    of left's rows with that key in count.

    Keys with more than total/hot_keys rows (at most hot_keys of them, whatever
    the data: that bounds the broadcast) are joined by broadcast; all other rows
    meet by a shuffle in which no key has more rows than that. Null keys get nulls.
    """
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    least = max(total // hot_keys, 50)
    values = [c for c in right.columns if c != key]
    hot = right.filter(F.col(count) > least).select(F.col(key), F.struct(*values).alias("__hot"))
    cold = right.filter(F.col(count) <= least).select(F.col(key).alias("__key"), F.lit(False).alias("__found"), F.struct(*values).alias("__cold"))
    return (
        left.join(F.broadcast(hot), key, "left")
        # rows that are already served, or have no key, are dealt by a number of their own and meet nothing
        .withColumn("__found", F.col("__hot").isNotNull() | F.col(key).isNull())
        .withColumn("__key", F.when(~F.col("__found"), F.col(key)).otherwise(F.monotonically_increasing_id().cast(right.schema[key].dataType)))
        .join(cold, ["__key", "__found"], "left")
        .withColumn("__all", F.coalesce("__hot", "__cold"))
        .select(*left.columns, *[F.col("__all")[v].alias(v) for v in values])
    )
