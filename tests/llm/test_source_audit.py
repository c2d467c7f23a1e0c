"""Operator 13 against brute force and its SQL; its perfect hashes against their guarantees."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskledger.llm import source_audit as A

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(docs, least=10, ranks=10):
    """The contract's rows from (doc_id, text, lang, source), term by term, with Python's integers."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in docs]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [(s, t) for x, s, t in rows if x == lang]
        frequency = Counter(w for _, t in own for w in set(t))
        kept = [w for w, n in frequency.items() if n >= least]
        counts = defaultdict(Counter)
        for s, t in own:
            counts[s].update(w for w in t if frequency[w] >= least)
        everything = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        q, ps = share(everything), {s: share(c) for s, c in counts.items()}
        for s, p in ps.items():
            pairs = [(-sum(apart(p[w], ps[o][w]) for w in kept), o.encode(), o) for o in ps if o != s]
            terms = [(-apart(p[w], q[w]), w.encode(), w) for w in kept if counts[s][w] > 0 and p[w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)}
    return out


def random_docs(seed, n, languages=3, sources=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßж漢") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs = []
    for i in range(n):
        picked = [rng.choice(words[: rng.choice([20, 100, 300])]) for _ in range(rng.choice([0, 1, 5, 40]))]
        text = "".join(w.upper() + rng.choice([" ", "-", "1", "_", "\n", ". "]) if rng.random() < 0.2 else w + " " for w in picked)
        docs.append((i, rng.choice([text] * 9 + [None]), rng.choice(["de", "en", "", None, "fr"][:languages]), rng.choice([None, "", *[f"s{j}" for j in range(sources)]])))
    return docs


def found(spark, docs, **options):
    got = [tuple(r) for r in A.audit(spark.createDataFrame(docs, SCHEMA).repartition(3), **options).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_random_texts_against_brute_force(spark):
    docs = random_docs(1, 500, languages=5)
    assert found(spark, docs) == plain(docs)
    assert found(spark, docs, least=3, ranks=4) == plain(docs, 3, 4)


def test_many_sources_are_compared_in_tiles(spark):
    docs = random_docs(2, 900, languages=1, sources=150)
    assert found(spark, docs, least=2) == plain(docs, 2)


def test_shards_in_several_broadcasts():
    rows = [{"lang": "x", "shard": i, "size": s} for i, s in enumerate([A.BROADCAST_BYTES // 2, A.BROADCAST_BYTES // 2, 1, A.BROADCAST_BYTES * 2, 5])]
    assert [[r["shard"] for r in c] for c in A.chunks_of(rows)] == [[0, 1], [2], [3], [4]]


def test_several_passes_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_TERMS", 40)
    monkeypatch.setattr(A, "BROADCAST_BYTES", 700)
    docs = random_docs(3, 400)
    assert found(spark, docs) == plain(docs)


def test_edges(spark):
    assert A.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rare = [(i, f"word{i} other", "xx", f"s{i % 3}") for i in range(9)]  # no term is frequent
    hot = [(i, "Same same words", "yy", "only") for i in range(40)] + [(99, "same " * 300_000, "yy", "only")]
    docs = rare + hot + [(100, None, None, None), (100, None, None, None), (101, "", "yy", None)]
    assert found(spark, docs) == plain(docs)
    extra = spark.createDataFrame(docs, SCHEMA).withColumns({"term": F.lit(1), "shard": F.lit("x"), "n": F.lit(2), "total": F.lit(3), "terms": F.lit(4)})
    assert {tuple(r) for r in A.audit(extra).collect()} == plain(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 500, 5000])
def test_perfect_hashes_are_minimal_and_verify(n):
    terms = [f"t{i}é".encode() for i in range(n)]
    seed, displaced, slots = A.perfect(terms)
    assert sorted(slots.tolist()) == list(range(n))
    keys = pa.array([terms[i] for i in np.argsort(slots)], pa.binary())
    assert (A.slots_of(terms, seed, displaced, keys) == slots).all()
    others = [f"u{i}".encode() for i in range(300)]
    assert (A.slots_of(others, seed, displaced, keys) == -1).all()


def test_terms_are_dealt_as_spark_deals_them(spark):
    terms = ["a", "wörter", "漢字", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t")).collect()]
    assert A.hashes([t.encode() for t in terms], A.SPARK_SEED).view(np.int64).tolist() == got


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(A, "PIECE_BYTES", 7)
    text = ("Wörter und andere, " * 50 + "end").encode()
    assert [t for piece in A.term_lists(text) for t in piece] == A.TERM.findall(text.lower())


def test_shares_of_huge_counts_are_exact():
    counts = np.array([0, 7, 1 << 40, (1 << 62) // 10**9 * 5], np.int64)
    total = int(counts.sum())
    assert A.shares(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 8) for c in counts]


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = db.execute(A.OP13_SQL).fetchall()
    got = [tuple(r) for r in A.op13_source_audit(spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == set(want)
