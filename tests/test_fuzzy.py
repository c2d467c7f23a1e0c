"""Similarity of names against plain dynamic programming, and the search against all pairs."""

import random

import pytest

from riskledger.functions import fuzzy as Z
from riskledger.functions.names import match_key
from riskledger.operators import search as Q
from pyspark.sql import functions as F


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def partial(a, b):
    if not a or not b:
        return 0.0
    one = lambda s, l: max(ratio(s, l[max(i, 0) : i + len(s)]) for i in range(1 - len(s), len(l)))  # noqa: E731, E741
    return max([one(a, b)] * (len(a) <= len(b)) + [one(b, a)] * (len(b) <= len(a)))


def plain_similarity(a, b):
    a, b = Z.processed(a), Z.processed(b)
    if not a or not b:
        return 0.0
    words = lambda t: " ".join(sorted(t))
    both, x, y = set(a.split()) & set(b.split()), set(a.split()), set(b.split())
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        names = [words(both)] * bool(both), words(x - both), words(y - both)
        whole = lambda *p: " ".join(t for t in p if t)
        if both and (not names[1] or not names[2]):
            return 0.95 if ratio(a, b) < 0.95 else max(0.95, ratio(a, b))
        one, two = whole(*names[0], names[1]), whole(*names[0], names[2])
        # what follows common words is aligned by itself
        apart = len(names[1]) + len(names[2]) - 2 * lcs(names[1], names[2])
        sets = [1 - apart / (len(one) + len(two))] + [ratio(names[0][0], t) for t in (one, two) if both]
        return max(ratio(a, b), 0.95 * max(ratio(words(a.split()), words(b.split())), *sets))
    scale = 0.9 if times <= 8 else 0.6
    token = 1.0 if both else max(partial(words(a.split()), words(b.split())), partial(words(x), words(y)))
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * token)


def names(seed, n):
    rng = random.Random(seed)
    words = ["ACME", "FORGE", "WIDGET", "WALMART", "SUPERCENTER", "TOOLS", "TOOL", "NORTH", "A", "OF", "ÉCLAIR", "X9", "STEEL-WORKS", "ACNE"]
    letters = lambda: "".join(rng.choice("ABCDE12 -") for _ in range(rng.randint(1, 12)))
    return [" ".join(rng.choice(words) if rng.random() < 0.7 else letters() for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))) for _ in range(n)]


def test_pairs_against_dynamic_programming():
    a, b = names(1, 1500), names(2, 1500)
    a, b = [*a, "", "--", "A" * 70, "AB " * 40, "WALMART"], [*b, "X", "Y", "A" * 71, "BA " * 25, "WALMART SUPERCENTER"]
    got = Z.similarities(a, b)
    for x, y, g in zip(a, b, got):
        assert g == pytest.approx(plain_similarity(x, y), abs=1e-12), (x, y)
    assert got[-1] == pytest.approx(0.9)


def test_subsequences_of_any_length():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130])))
    a, b = [text() for _ in range(200)], [text() for _ in range(200)]
    short = [i for i in range(200) if min(len(a[i]), len(b[i])) <= 64]
    assert Z.subsequences([a[i] for i in short], [b[i] for i in short]).tolist() == [lcs(a[i], b[i]) for i in short]
    assert Z.subsequences(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]


def test_no_pair_is_lost_by_its_bound():
    a, b = names(4, 60), names(5, 700)
    queries, keys = Z.Bags(a), Z.Bags(b)
    for i, x in enumerate(a):
        near = set(Z.possible(i, queries, keys, 0.55).tolist())
        scores = Z.similarities([x] * len(b), b)
        assert {j for j, s in enumerate(scores) if s >= 0.55} <= near


def test_search_against_all_pairs(spark):
    keys = sorted({k for k in names(6, 300)})
    asked = names(7, 25)
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "company_key string, members long").repartition(3)
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    counted = spark.sparkContext.accumulator(0)
    found = Q.fuzzy_candidates(queries, frame, best=7, candidates=counted)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = {(r["query"], r.company_key, r.members, r.similarity, r["rank"]) for r in found.collect()}
    key = {r["query"]: r["k"] for r in queries.select("query", match_key(F.col("query")).alias("k")).collect()}
    want = set()
    for q in set(asked):
        scores = [(-round(plain_similarity(key[q], k), 6), k, i) for i, k in enumerate(keys) if len(k) > 1]
        want |= {(q, k, i, -s, r + 1) for r, (s, k, i) in enumerate(sorted(x for x in scores if x[0] <= -0.55)[:7])}
    assert got == want and 0 < counted.value < len(set(asked)) * len(keys)
