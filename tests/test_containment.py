"""Literal containment over grams against all pairs."""

import random

from pyspark.sql import functions as F

from riskledger.operators import search as Q
from riskledger.operators.containment import containing


def test_random_texts_against_all_pairs(spark):
    rng = random.Random(1)
    text = lambda longest: "".join(rng.choice("ab%_\\") for _ in range(rng.randint(0, longest)))
    texts, patterns = [text(30) for _ in range(150)] + [None, ""], [text(7) for _ in range(120)] + [None, "", "absent!"]
    one = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    got = [tuple(r) for r in containing(one(texts, "text"), one(patterns, "pattern")).collect()]
    want = {(t, p) for t in texts if t for p in patterns if p and p in t}
    assert set(got) == want and len(got) == len(want)
    assert containing(one(texts, "text"), one(["", None], "pattern")).count() == 0
    assert containing(one([], "text"), one(patterns, "pattern")).count() == 0


def test_nothing_is_broadcast_or_crossed(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        questions = spark.createDataFrame([("What of 1910.0030 B01?",), ("nothing",), ("...",)], "question string")
        violations = spark.createDataFrame([("19100030 B01",), ("1910",), ("",), ("29CFR",)], "standard string")
        found = Q.matched_standards(questions, violations)
        plan = found._jdf.queryExecution().toString()
        assert "Broadcast" not in plan and "Cartesian" not in plan
        assert {tuple(r) for r in found.collect()} == {("What of 1910.0030 B01?", "19100030 B01"), ("What of 1910.0030 B01?", "1910")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_gram_in_every_text(spark):
    texts = spark.range(5000).select(F.concat(F.lit("COMMON "), "id").alias("text"))
    patterns = spark.range(300).select(F.concat(F.lit("COMMON "), F.col("id") * 10).alias("pattern"))
    got = containing(texts, patterns)
    assert got.filter("text = pattern").count() == 300
    assert got.count() == sum(str(t).startswith(str(p * 10)) for t in range(5000) for p in range(300))
