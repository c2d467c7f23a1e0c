"""Operator 11 against brute force over all pairs, and its sketches against their guarantees."""

import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from riskledger.llm import minhash_dedup as M

SCHEMA = "doc_id long, text string"


def shingles(text, k):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def plain(docs, k, percent):
    """(doc_id, size, component) by all pairs of documents with distinct ids."""
    sets = {d: shingles(t, k) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d), find(d) == d) for d in sets}


def near_copies(seed, documents):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    docs = []
    for _ in range(documents):
        if docs and rng.random() < 0.6:
            words = rng.choice(docs[-40:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                if words:
                    words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(rng.choice([1, 2, 3, 4, 8, 30, 90, 300]))]
        docs.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    return list(enumerate(docs))


def test_random_texts_against_all_pairs(spark):
    docs = near_copies(3, 400)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    for k, percent in ((3, 85), (5, 80)):
        assert {tuple(r) for r in M.with_components(frame, k=k, percent=percent).collect()} == plain(docs, k, percent)


def test_chains_and_two_groups_of_one_band(spark):
    """A long chain in which only neighbours link, and groups whose members link while the groups don't."""
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join([*base[3 * i :], *[f"x{j}" for j in range(3 * i)]]) for i in range(30)]
    half = base[:100]
    groups = [" ".join([*half, *[f"{g}{i}" for i in range(20)], f"own{g}{c}"]) for g in "abc" for c in range(25)]
    docs = list(enumerate(chain + groups))
    assert {tuple(r) for r in M.with_components(spark.createDataFrame(docs, SCHEMA), k=3, percent=85).collect()} == plain(docs, 3, 85)


def test_a_large_group_whose_members_link_in_part(spark):
    """Near copies around a text that is not among them: few link to any one leader, all to some."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(900):
        words = list(base)
        for at in rng.sample(range(0, 120, 3), rng.choice([1, 1, 2, 3, 4])):
            words[at] = f"x{i}y{at}"
        docs.append((i, " ".join(words)))
    got = {tuple(r) for r in M.with_components(spark.createDataFrame(docs, SCHEMA).repartition(4), k=3, percent=85).collect()}
    assert got == plain(docs, 3, 85)


def test_a_star_of_many_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"{base} tail{i % 700}") for i in range(3000)]
    got = M.with_components(spark.createDataFrame(docs, SCHEMA).repartition(4), k=3, percent=85)
    assert got.filter("component_id = 0").count() == 3000 and got.filter("kept").count() == 1


def test_edges(spark):
    assert M.with_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, "A B C D"), (6, "a b"), (7, "a  b"), (8, "x " * 200_000)]
    got = M.with_components(spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "sign": F.lit(1), "bands": F.lit(2), "component": F.lit(3)}), k=3, percent=85).collect()
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = M.keep_one_each(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine")), k=3, percent=85)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 8] and kept.columns == ["doc_id", "text", "kept"]


def test_sketches_fill_every_coordinate_and_estimate_the_similarity():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (0, 1, 2, 5, 50, 3000)]
    found = M.sketches(sets)
    assert (found[0] == M.EMPTY).all() and (found[1:] != M.EMPTY).all()
    assert (M.sketches([sets[4]])[0] == found[4]).all()  # a set's sketch does not depend on its neighbours
    for similarity in (0.5, 0.8, 0.9):
        errors = []
        for n in (40, 400):
            for _ in range(150):
                both = round(2 * n * similarity / (1 + similarity))
                items = np.unique(rng.integers(0, 1 << 63, 2 * n - both + 9, np.uint64))
                a, b = items[:n], np.concatenate([items[:both], items[n : 2 * n - both]])
                x, y = M.sketches([a, b])
                errors.append((x == y).mean() - both / (2 * n - both))
        spread = (similarity * (1 - similarity) / M.COORDINATES) ** 0.5
        assert abs(np.mean(errors)) < spread / 3 and np.std(errors) < 1.15 * spread


def test_parity_bits_lose_no_link(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in (20, 900, 1100, 3000):
        for percent in (70, 84, 85, 86, 95, 100):
            both = round(2 * n * percent / (100 + percent))
            items = np.unique(rng.integers(0, 1 << 63, 2 * n - both + 9, np.uint64))[: 2 * n - both]
            rng.shuffle(items)
            a, b = items[:n], np.concatenate([items[:both], items[n:]])
            rows.append((M.parity(a).tolist(), M.parity(b).tolist(), a.size, b.size, 100 * both >= 85 * (a.size + b.size - both), percent))
    got = spark.createDataFrame(rows, "p array<long>, q array<long>, m long, n long, link boolean, percent int")
    got = got.withColumn("close", M.close(F.col("p"), F.col("q"), F.col("m"), F.col("n"), 85))
    assert got.filter("link and not close").isEmpty() and got.filter("percent = 70 and close and m > 100").isEmpty()


def test_first_band(spark):
    rows = [([1, 2, 3], [0, 2, 3], 1), ([1, 2, 3], [1, 2, 3], 0), ([1, 2, 3], [4, 5, 6], -1)]
    got = spark.createDataFrame(rows, "x array<long>, y array<long>, want long")
    assert got.filter(M.first_band(F.col("x"), F.col("y")) != F.col("want")).isEmpty()


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = set(db.execute(M.OP11_SQL).fetchall())
    assert {tuple(r) for r in M.op11_minhash_dedup(spark, sf_dir).collect()} == want
