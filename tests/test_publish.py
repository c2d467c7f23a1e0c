"""Published keyed tables, versions and incremental loads."""

import datetime

from pyspark.sql import functions as F

from riskledger.sources import published as P
from riskledger.sources import versions as V
from riskledger.streaming import incremental as L

DAY = datetime.date(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def records(spark):
    inspections = spark.range(2000).select(F.col("id").cast("string").alias("activity_nr"), F.concat(F.lit("Acme "), (F.col("id") % 40).cast("string"), F.lit(" Mfg, Inc.")).alias("estab_name"))
    # a third of all violations belong to one inspection
    violations = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "7").otherwise((F.col("id") % 2000).cast("string")).alias("activity_nr"), F.col("id").cast("string").alias("citation_id"), F.when(F.col("id") % 10 == 0, "X").alias("delete_flag"))
    accidents = spark.range(5).select(F.col("id").cast("string").alias("summary_nr"))
    injuries = spark.range(9).select(F.col("id").cast("string").alias("rel_insp_nr"), F.lit("1").alias("summary_nr"))
    return P.keyed(inspections), violations, accidents, injuries


def test_published_tables_join_and_look_up_by_bucket(spark, tmp_path):
    base = f"file://{tmp_path}/published"
    inspections, violations, accidents, injuries = records(spark)
    rows = P.publish_records(spark, base, inspections, violations, accidents, injuries, buckets=8)
    assert rows == {"inspections": 2000, "inspections_by_company": 2000, "companies": 40, "violations": 8100, "accidents": 5, "injuries": 9}
    assert {tuple(r) for r in P.manifest(spark, base).collect()} == {(n, k, True) for n, k in rows.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        v = P.read(spark, base, "violations")
        joined = v.join(P.read(spark, base, "inspections"), "activity_nr")
        assert "Exchange" not in plan(joined) and joined.count() == 8100 and v.filter("delete_flag = 'X'").isEmpty()
        one = P.read(spark, base, "inspections_by_company").filter("company_key = 'ACME 7 MANUFACTURING'")
        assert "SelectedBucketsCount: 1 out of 8" in plan(one) and one.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert P.read(spark, base, "companies").filter("name = 'Acme 7 Manufacturing'").count() == 1


def test_readers_see_whole_versions(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    assert V.current(spark, base) is None
    layout = P.Layout("k", 2)
    table = lambda n: {"t": (spark.range(n).withColumnRenamed("id", "k"), layout)}
    P.publish(spark, base, table(3), {"from": "a"})
    version, about = V.current(spark, base)
    half = V.new_version(spark, base)  # written, not committed
    P.write_table(spark.range(50).withColumnRenamed("id", "k"), f"{half}/t", layout)
    assert V.current(spark, base) == (version, about) and P.read(spark, base, "t").count() == 3
    P.publish(spark, base, table(0))
    assert P.read(spark, base, "t").count() == 0 and P.manifest(spark, base).first()["complete"] is False
    for n in range(11):
        P.publish(spark, base, table(n))
    assert P.read(spark, base, "t").count() == 10 and V.expire(spark, base, keep=1) == 12
    assert P.read(spark, base, "t").count() == 10 and len(V.pointers(spark, base)) == 1


def landed(spark, tmp_path):
    return {n: str(tmp_path / n) for n in ("land", "table", "companies", "progress")}


VIOLATION = "activity_nr string, citation_id string, viol_type string, issuance_date date, current_penalty double, delete_flag string"


def test_no_row_is_too_late(spark, tmp_path):
    at = landed(spark, tmp_path)
    day = lambda n: DAY + datetime.timedelta(days=n)
    load = lambda: L.load_violations(spark, at["land"], VIOLATION, at["table"], at["progress"])
    spark.createDataFrame([("1", "a", "S", day(500), 5.0, ""), ("2", "a", "S", day(510), 5.0, None)], VIOLATION).write.parquet(at["land"])
    load()
    more = [("3", "a", "S", day(511), 5.0, ""), ("4", "a", "S", day(0), 5.0, ""), ("1", "a", "W", day(700), 9.0, ""), ("5", "a", "S", day(3), 5.0, "X"), ("6", "a", "S", day(3), 0.0, ""), ("7", "a", "S", None, 1.0, "")]
    spark.createDataFrame(more, VIOLATION).write.mode("append").parquet(at["land"])
    load()
    load()
    rows = L.loaded(spark, at["table"], VIOLATION)
    assert sorted((r.activity_nr, r.viol_type) for r in rows.collect()) == [("1", "S"), ("2", "S"), ("3", "S"), ("4", "S"), ("7", "S")]


def test_only_rows_after_the_last_load(spark, tmp_path):
    at = landed(spark, tmp_path)
    rows = [(str(i), "a", "S", DAY + datetime.timedelta(days=i), 1.0, None) for i in range(4)]
    spark.createDataFrame(rows, VIOLATION).write.parquet(at["land"])
    L.load_violations(spark, at["land"], VIOLATION, at["table"], at["progress"], since=DAY + datetime.timedelta(days=1))
    assert sorted(r.activity_nr for r in L.loaded(spark, at["table"], VIOLATION).collect()) == ["2", "3"]


def test_inspections_get_their_keys_and_extend_the_dimension(spark, tmp_path):
    at, schema = landed(spark, tmp_path), "activity_nr long, estab_name string, open_date date"
    load = lambda: L.load_inspections(spark, at["land"], schema, at["table"], at["companies"], at["progress"], buckets=4)
    spark.createDataFrame([(1, "Acme Mfg, Inc.", DAY), (2, "ACME MANUFACTURING", DAY), (3, None, DAY)], schema).write.parquet(at["land"])
    load()
    spark.createDataFrame([(2, "Other", DAY), (4, "The Forge Co.", DAY)], schema).write.mode("append").parquet(at["land"])
    load()
    rows = L.loaded(spark, at["table"], "activity_nr long, company_key string").collect()
    assert {tuple(r) for r in rows} == {(1, "ACME MANUFACTURING"), (2, "ACME MANUFACTURING"), (3, ""), (4, "FORGE")} and len(rows) == 4
    companies = L.loaded(spark, at["companies"], "company_key string, name string").collect()
    assert sorted(tuple(r) for r in companies) == [("ACME MANUFACTURING", "Acme Manufacturing"), ("FORGE", "Forge")]


def test_a_replayed_batch_writes_the_same_rows(spark, tmp_path):
    table = f"{tmp_path}/t"
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids] + [(ids[0], "a")], "k long, v string")
    L.merge_new(rows(1, 2), table, ["k"], 0, buckets=3)
    for _ in range(2):
        added = L.merge_new(rows(2, 3, 4), table, ["k"], 1, buckets=3)
        assert sorted(r.k for r in added.collect()) == [3, 4]
    kept = L.loaded(spark, table, "k long, v string").collect()
    assert sorted(tuple(r) for r in kept) == [(1, "a"), (2, "v2"), (3, "v3"), (4, "v4")]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    table = f"{tmp_path}/t"
    L.merge_new(spark.range(1000), table, ["id"], 0, buckets=50)
    before = L.stored(spark, table, spark.range(0).schema)
    some = before.filter(F.col("bucket").isin([3, 4]))
    assert len(some.inputFiles()) == 2 or "PartitionFilters: [bucket" in plan(some)
    assert L.merge_new(spark.createDataFrame([(5,), (2000,), (None,)], "id long"), table, ["id"], 1, buckets=50).count() == 2
    assert L.merge_new(spark.createDataFrame([(None,)], "id long"), table, ["id"], 2, buckets=50).count() == 0
    assert L.loaded(spark, table, "id long").count() == 1002
