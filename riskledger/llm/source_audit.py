"""Operator 13, source divergence audit with a recount in minimal perfect hashes.

The first pass over the texts counts, exactly, in how many documents of its language each term stands, and
keeps the frequent ones. Their terms are cut into shards, and each shard gets a minimal perfect hash: every term a
slot of its own, none left over. A hash alone would give a slot to any other term, too, so the terms are
stored by slot and compared. The second pass holds the shards as a broadcast of bounded size (more shards than it
may hold take more passes) and adds each group's occurrences to a dense array of slots.

Groups of one language are then compared shard by shard, in tiles of sources.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskledger.llm._common import cut, discard, lookup, table
from riskledger.llm._words import mix, slices, trim

#: A term in UTF-8 bytes whose A-Z are lower-case: letters and everything beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
PIECE_BYTES = 1_000_000
#: Terms that a task counts before it hands them on, and bytes of dense slots that it holds.
HELD_TERMS, HELD_BYTES = 200_000, 64_000_000
#: About so many terms have one hash; so many bytes of hashes are broadcast at once; so many sources make a tile.
SHARD_TERMS, BROADCAST_BYTES, TILE = 16_384, 64_000_000, 64
#: The seed of Spark's xxhash64, which deals terms to shards.
SPARK_SEED = 42
SCALE = 1_000_000_000


# ---- terms -----------------------------------------------------------------------------


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in pieces of about PIECE_BYTES, cut between terms."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE_BYTES)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def frequency_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of the language that have the term, in parts."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, terms in held.items():
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64())], ["lang", "term", "n"])
        held.clear()

    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                own: set[bytes] = set()
                for terms in term_lists(text):
                    own.update(terms)
                held[lang].update(own)
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from out()
    yield from out()
    trim()


# ---- minimal perfect hashes --------------------------------------------------------------


def hashes(terms: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


def placed(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The slots, of n, of hashes that are displaced by d."""
    return (mix(h + d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n)).astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def perfect(terms: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed and displacements of a minimal perfect hash of distinct terms, and each term's slot.

    Terms are hashed to buckets of four on average. From the fullest bucket down, each takes the first
    displacement that puts its terms in free slots; a bucket of one takes any free slot by name (-1 - slot).
    """
    n, seed = len(terms), 1
    while np.unique(h := hashes(terms, seed)).size < n:
        seed += 1
    buckets = n // 4 + 1
    bucket = bucket_of(h, buckets)
    by_bucket = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    sizes = np.diff(ends, prepend=0)
    displaced, slots, free = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    tries = np.arange(64)
    for b in np.argsort(-sizes, kind="stable"):
        own = by_bucket[ends[b] - sizes[b] : ends[b]]
        if own.size < 2:
            break
        start = 0
        while True:
            at = placed(h[own][:, None], (start + tries)[None, :], n)
            fits = free[at].all(axis=0)
            if own.size > 1:
                fits &= (np.diff(np.sort(at, axis=0), axis=0) > 0).all(axis=0)
            if fits.any():
                d = int(np.argmax(fits))
                displaced[b], slots[own] = start + d, at[:, d]
                free[at[:, d]] = False
                break
            start += tries.size
    rest = np.flatnonzero(free)
    for b, slot in zip(np.flatnonzero(sizes == 1), rest):
        displaced[b] = -1 - slot
        slots[by_bucket[ends[b] - 1]] = slot
    return seed, displaced, slots


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The hash of one shard: its seed, displacements, and terms by slot."""
    terms = [t.encode() for t in pdf["term"]]
    seed, displaced, slots = perfect(terms)
    by_slot = [terms[i] for i in np.argsort(slots)]
    ends = np.cumsum([0, *map(len, by_slot)]).astype(np.int32)
    row = {"lang": pdf["lang"].iloc[0], "shard": pdf["shard"].iloc[0], "n": len(terms), "seed": seed, "displaced": displaced.tobytes(), "ends": ends.tobytes(), "terms": b"".join(by_slot)}
    return pd.DataFrame([row])


def stored(ends: bytes, terms: bytes) -> pa.BinaryArray:
    """The terms of a shard by slot."""
    ends = np.frombuffer(ends, np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(terms)])


def slots_of(terms: list[bytes], seed: int, displaced: np.ndarray, keys: pa.BinaryArray) -> np.ndarray:
    """Each term's slot, -1 for a term that the shard does not have."""
    h = hashes(terms, seed)
    d = displaced[bucket_of(h, displaced.size)]
    at = np.where(d < 0, -1 - d.astype(np.int64), placed(h, np.maximum(d, 0), len(keys)))
    same = pc.equal(keys.take(pa.array(at)), pa.array(terms, pa.binary())).to_numpy(zero_copy_only=False)
    return np.where(same, at, -1)


# ---- the recount ---------------------------------------------------------------------------


def packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def recount_pass(shared):
    """(lang, source, shard, counts): occurrences of the broadcast shards' terms, a dense array of slots for
    each group; null sources stand for all of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_counts, chunk = shared.value
        keys = {at: stored(c["ends"], c["terms"]) for at, c in chunk.items()}
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def settle() -> None:
            """Add what was counted to the slots."""
            for (lang, source), terms in held.items():
                shards = shard_counts.get(lang)
                if not shards:
                    continue
                names, counts = list(terms), np.fromiter(terms.values(), np.int64, len(terms))
                shard = (hashes(names, SPARK_SEED).view(np.int64) % shards).astype(np.int64)  # as pmod, not negative
                for s in np.unique(shard).tolist():
                    if (c := chunk.get((lang, s))) is None:
                        continue
                    own = np.flatnonzero(shard == s)
                    at = slots_of([names[i] for i in own], c["seed"], np.frombuffer(c["displaced"], np.int32), keys[lang, s])
                    slots = dense.setdefault((lang, source, s), np.zeros(len(keys[lang, s]), np.int64))
                    slots[at[at >= 0]] += counts[own][at >= 0]
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            every: dict[tuple[str, int], np.ndarray] = {}
            for (lang, source, s), counts in dense.items():
                if counts.any():
                    every[lang, s] = every[lang, s] + counts if (lang, s) in every else counts
                    yield row(lang, source, s, counts)
            for (lang, s), counts in every.items():
                yield row(lang, None, s, counts)
            dense.clear()

        def row(lang, source, shard, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([source], pa.string()), pa.array([shard], pa.int64()), pa.array([packed(counts)], pa.binary())], ["lang", "source", "shard", "counts"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, source, text in zip(*[batch[c].to_pylist() for c in ("lang", "source", "text")]):
                    for terms in term_lists(text):
                        held[lang, source].update(terms)
                if sum(map(len, held.values())) > HELD_TERMS:
                    settle()
                    if sum(a.nbytes for a in dense.values()) > HELD_BYTES:
                        yield from out()
        settle()
        yield from out()
        trim()

    return run


def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Dense counts of one group and shard, summed."""
    total = reduce(np.add, map(unpacked, pdf["counts"]))
    return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "source": pdf["source"].iloc[:1], "shard": pdf["shard"].iloc[:1], "counts": [packed(total)], "n": [int(total.sum())]})


def summed(parts: DataFrame) -> DataFrame:
    """Tasks' dense counts summed in groups of 64 tasks, then the groups' sums."""
    kind = "lang string, source string, shard long, counts binary, n long"
    some = parts.withColumn("__g", F.floor(F.spark_partition_id() / 64))
    some = some.groupBy("lang", "source", "shard", "__g").applyInPandas(add_up, kind)
    return some.groupBy("lang", "source", "shard").applyInPandas(add_up, kind)


def chunks_of(sizes: list) -> list[list]:
    """Shards (lang, shard, size) in runs that BROADCAST_BYTES hold; at least one each."""
    out, room = [], 0
    for row in sizes:
        if not out or row["size"] > room:
            out.append([])
            room = BROADCAST_BYTES
        out[-1].append(row)
        room -= row["size"]
    return out


def recounted(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The dense counts of every group and shard, in as many passes over docs as the broadcasts take. The driver
    holds a row a shard and one broadcast."""
    spark = docs.sparkSession
    sizes = index.select("lang", "shard", "shards", (F.length("terms") + F.length("ends") + F.length("displaced")).alias("size")).orderBy("lang", "shard").collect()
    passes = []
    for number, chunk in enumerate(chunks_of(sizes)):
        langs = {r["lang"]: r["shards"] for r in chunk}
        first, last, lang = chunk[0], chunk[-1], F.col("lang")
        from_first = (lang > first["lang"]) | ((lang == first["lang"]) & (F.col("shard") >= first["shard"]))
        to_last = (lang < last["lang"]) | ((lang == last["lang"]) & (F.col("shard") <= last["shard"]))
        rows = index.filter(from_first & to_last).collect()
        held = {(r["lang"], r["shard"]): {c: bytes(r[c]) if c != "seed" else r[c] for c in ("seed", "displaced", "ends", "terms")} for r in rows}
        shared = spark.sparkContext.broadcast((langs, held))
        parts = docs.mapInArrow(recount_pass(shared), "lang string, source string, shard long, counts binary")
        passes.append(cut(summed(parts), f"audit-counts-{number}"))
        shared.unpersist()
    if not passes:
        return spark.createDataFrame([], "lang string, source string, shard long, counts binary, n long")
    return reduce(DataFrame.unionByName, passes)


# ---- the comparison --------------------------------------------------------------------------


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for any counts."""
    if counts.size and int(counts.max()) >= (1 << 62) // SCALE:
        return np.array([1 + SCALE * (c + 2) // (total + 2 * terms) for c in counts.tolist()], np.int64)
    return 1 + SCALE * (counts + 2) // (total + 2 * terms) if counts.size else counts


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compare(cells: pd.DataFrame, whole: pd.DataFrame, ranks: int) -> pd.DataFrame:
    """One shard of a language, one pair of tiles: parts of the divergence of each two sources, and, where
    the tiles are one, each source's best terms. whole has the language's counts and terms, for one tile only."""
    found: list[tuple] = []
    if cells.empty:
        return pd.DataFrame(found, columns=["lang", "source", "part", "item", "value"])
    lang, slots, terms = cells["lang"].iloc[0], int(cells["slots"].iloc[0]), int(cells["terms"].iloc[0])
    counts = [np.zeros(slots, np.int64) if c is None else unpacked(c) for c in cells["counts"]]
    p = np.array([shares(c, int(n), terms) for c, n in zip(counts, cells["total"])]).reshape(len(cells), slots)
    tiles, names = cells["tile"].to_numpy(), cells["source"].tolist()
    low, high = cells["low"].iloc[0], cells["high"].iloc[0]
    for i in np.flatnonzero(tiles == low):
        others = np.flatnonzero(tiles == high)
        others = others[others > i] if low == high else others
        for j, value in zip(others, divergence(p[i], p[others]).sum(axis=1)):
            found += [(lang, names[i], "pair", names[j], int(value)), (lang, names[j], "pair", names[i], int(value))]
    if low == high and not whole.empty and whole["counts"].iloc[0] is not None:
        w = whole.iloc[0]
        q, keys = shares(unpacked(w["counts"]), int(w["total"]), terms), stored(bytes(w["ends"]), bytes(w["words"]))
        for name, c, own in zip(names, counts, p):
            at = np.flatnonzero((c > 0) & (own > q))
            value = divergence(own[at], q[at])
            if at.size > ranks:  # all that the last rank's value reaches, ties included
                reach = value >= np.partition(value, at.size - ranks)[at.size - ranks]
                at, value = at[reach], value[reach]
            best = sorted(zip((-value).tolist(), keys.take(pa.array(at)).to_pylist()))[:ranks]
            found += [(lang, name, "term", term.decode(), -v) for v, term in best]
    return pd.DataFrame(found, columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, *, least: int = 10, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text; other columns are not read).

    Terms are runs of letters (all characters beyond ASCII count as letters), A-Z lower-cased; a
    language keeps those in least or more of its documents. Part pair has, for each group (lang, source), every
    other source of its language and how far their shares of the kept terms lie apart; part term the group's
    terms above the language's share, the first ranks of them. Nulls are '' in every column; each row is a
    document, repeated or not; a group without terms has the shares of no occurrences; a language without
    kept terms has pairs of value 0; a language of one source has no pairs. Equal values rank by item. Texts are
    read whole, in pieces. An empty table gives an empty result.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(known("lang").alias("lang"), known("source").alias("source"), known("text").cast("binary").alias("text"))
    frequent = docs.mapInArrow(frequency_pass, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    kept = cut(frequent.select("lang", "term"), "audit-terms")
    sizes = cut(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "audit-languages")
    dealt = lookup(kept, sizes.withColumn("__terms", F.col("terms")), "lang", "terms").withColumn("shards", F.ceil(F.col("__terms") / SHARD_TERMS))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    index = dealt.groupBy("lang", "shard").applyInPandas(build, "lang string, shard long, n long, seed long, displaced binary, ends binary, terms binary")
    index = cut(index.join(sizes.select("lang", F.col("terms").alias("kept")), "lang").withColumn("shards", F.ceil(F.col("kept") / SHARD_TERMS)), "audit-index")
    discard(kept)
    counts = cut(recounted(docs, index), "audit-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(docs.select("lang", "source").distinct(), "audit-groups")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    # every group and shard of its language; a language without kept terms has one shard without slots
    shards = tiles.join(index.select("lang", "shard", F.col("n").alias("slots"), F.col("kept").alias("terms")), "lang", "left").fillna(0, ["shard", "slots", "terms"])
    cells = groups.join(shards, "lang").join(totals.filter("source is not null"), ["lang", "source"], "left").fillna(0, ["total"])
    cells = cells.join(counts.filter("source is not null").drop("n"), ["lang", "source", "shard"], "left").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cells = cells.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("tiles", "other")
    whole = counts.filter("source is null").drop("source", "n").join(totals.filter("source is null").drop("source"), "lang").join(tiles, "lang")
    whole = whole.join(index.select("lang", "shard", "ends", F.col("terms").alias("words")), ["lang", "shard"])
    whole = whole.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("high", F.col("low")).drop("tiles")
    keys = ["lang", "shard", "low", "high"]
    both = cells.groupBy(*keys).cogroup(whole.groupBy(*keys))
    found = both.applyInPandas(lambda a, b: compare(a, b, ranks), "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gc AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, c, 1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM gc JOIN v USING (lang)),
lc AS (SELECT lang, term, sum(c) AS c FROM gc GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q FROM lc JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
