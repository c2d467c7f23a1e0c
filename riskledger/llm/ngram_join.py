"""Operator 9, n-gram Jaccard join by vertical partitioning.

All distinct k-word shingles have one global order, rare ones first. Two documents
can only link if a shingle at the head of the one's order is at the head of the
other's; those heads give the candidates. The order is cut into fragments, the
candidates' overlaps are counted fragment by fragment, and summed per pair.

Documents with the same set of shingles are one class, whose smallest doc_id stands
for it. Classes that share a head shingle are first compared with one leader
only; the components that this gives leave just pairs of different components, so
that a large group of near copies never meets itself pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskledger.llm._common import cut, discard, lookup, table
from riskledger.llm._words import shingle_hashes, slices, trim

#: Size of the table of shingle counts (by hash), in bits; the table is summed in SLICES.
COUNT_BITS, SLICES = 22, 64
#: Least 64-bit words of parity bits of a set; a larger set has a bit or more for each shingle.
PARITY_WORDS = 16
#: A window may hold the rows of one shingle whose slot of the count table shows at most so many.
WINDOW_ROWS = 50_000
#: Ids up to this many are broadcast (8 MB) to pick documents; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set that links to it."""
    return -(-percent * n // 100)


def orders(counts: np.ndarray) -> np.ndarray:
    """Level (one byte) of each slot of the count table: rare slots low."""
    return np.minimum(np.floor(4 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def ordered(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles as numbers of the global order, ascending: level, then hash."""
    level = levels[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(55)) | (hashes & np.uint64((1 << 55) - 1)))


def signature(hashes: np.ndarray) -> str:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = hashes * np.uint64(0x9FB21C651E98DF25)
        b = (hashes ^ (hashes >> np.uint64(28))) * np.uint64(0xA0761D6478BD642F)
        return f"{int(np.add.reduce(a ^ (a >> np.uint64(31)))):016x}{int(np.add.reduce(b ^ (b >> np.uint64(30)))):016x}"


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's hashes fall on each of 64 * PARITY_WORDS bits, doubled
    until they are as many as the hashes. Bits in which two sets differ are at most the shingles that only
    one of them has; the halves of a longer array, combined by XOR, are the shorter one."""
    bits = 64 * PARITY_WORDS
    while bits < hashes.size:
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts (32 bits) compressed, byte plane by byte plane: most are small."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def count_pass(k: int):
    """Per document its id, set size and signature; per task the counts of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        none = lambda n, kind: pa.nulls(n, kind)
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, signs, at = [], [], []
                for s in shingle_hashes(batch["text"], k):
                    sizes.append(s.size)
                    signs.append(signature(s) if s.size else None)
                    at.append(s >> np.uint64(64 - COUNT_BITS))
                np.add.at(counts, np.concatenate(at).astype(np.int64), np.uint32(1))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(signs, pa.string()), none(n, pa.int32()), none(n, pa.binary())], names)
        parts = np.split(counts, SLICES)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([True] * SLICES), none(SLICES, pa.int64()), none(SLICES, pa.int64()), none(SLICES, pa.string()), pa.array(range(SLICES), pa.int32()), pa.array([packed(p) for p in parts], pa.binary())], names)

    names = ["counts", "doc_id", "n", "sign", "slice", "sums"]
    return run


def total(sums) -> np.ndarray:
    """Counts added up, at most 32 bits each."""
    out = np.zeros((1 << COUNT_BITS) // SLICES, np.uint64)
    for data in sums:
        out += unpacked(data)
    return np.minimum(out, 0xFFFFFFFF)


def add_up(pdf):
    import pandas as pd

    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "sums": [packed(total(pdf["sums"]))]})


def finish(pdf):
    """Levels of a slice of the table, and the shingles of each level."""
    import pandas as pd

    counts = total(pdf["sums"])
    levels = orders(counts)
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "levels": [levels.tobytes()], "mass": [np.bincount(levels, counts, 256)]})


def levels_of(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the count table and the shingles of each level. Tasks' tables are
    summed in groups of about 64 tasks, then the groups' sums; 4 MB reach the driver."""
    tables = counted.filter("counts").select("slice", "sums").withColumn("__g", (F.rand(0) * F.lit(max(counted.rdd.getNumPartitions() // 16, 1))).cast("int"))
    once = tables.groupBy("slice", "__g").applyInPandas(add_up, "slice int, sums binary")
    rows = sorted(once.groupBy("slice").applyInPandas(finish, "slice int, levels binary, mass array<double>").collect(), key=lambda r: r["slice"])
    if not rows:
        return np.zeros(1 << COUNT_BITS, np.uint8), np.zeros(256)
    return np.concatenate([np.frombuffer(bytes(r["levels"]), np.uint8) for r in rows]), np.sum([r["mass"] for r in rows], axis=0)


def pivots(mass: np.ndarray, fragments: int) -> np.ndarray:
    """Numbers that cut the order into fragments with about as many shingles each;
    inside a level hashes are even."""
    ends = np.cumsum(mass)
    out = []
    for f in range(1, fragments):
        want = ends[-1] * f / fragments
        level = int(np.searchsorted(ends, want))
        inside = (want - (ends[level] - mass[level])) / max(mass[level], 1)
        out.append((level << 55) + int(inside * (1 << 55)))
    return np.array(out, np.uint64)


def head_pass(k: int, percent: int, shared):
    """Per document its signature, set size and head: the least that a linked set must touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, signs, heads, bits = [], [], [], []
                for s in shingle_hashes(batch["text"], k):
                    sizes.append(s.size)
                    bits.append(parity(s))
                    signs.append(signature(s) if s.size else None)
                    heads.append(ordered(s, levels)[: s.size - least_overlap(s.size, percent) + 1].astype(np.int64) if s.size else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([h.size for h in heads])]).astype(np.int32)), pa.array(np.concatenate(heads)))
                ends = pa.array(np.concatenate([[0], np.cumsum([b.size for b in bits])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(signs, pa.string()), pa.array(sizes, pa.int64()), lists, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bits)))], ["doc_id", "sign", "n", "head", "parity"])
        trim()

    return run


def fragment_pass(k: int, shared):
    """Per document and fragment the shingles that fall there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, cuts = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, sizes, frags, parts = [], [], [], []
                for doc, s in zip(batch["doc_id"].to_pylist(), shingle_hashes(batch["text"], k)):
                    o = ordered(s, levels)
                    at = [0, *np.searchsorted(o, cuts), o.size]
                    for f, (a, b) in enumerate(zip(at, at[1:])):
                        if b > a:
                            ids.append(doc)
                            sizes.append(s.size)
                            frags.append(f)
                            parts.append(o[a:b].astype(np.int64))
                if ids:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([p.size for p in parts])]).astype(np.int32)), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(frags, pa.int32()), lists], ["rep", "n", "fragment", "part"])
        trim()

    return run


def links(pairs: DataFrame, docs: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """The pairs (a, b, na, nb) whose overlap, summed over fragments, is enough, as a written
    table. Only the documents in pairs are cut into fragments; where a doc_id has several texts of one size, the best counts."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "jaccard-ids")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    parts = cut(docs.join(some, "doc_id", "left_semi").mapInArrow(fragment_pass(k, shared), "rep long, n long, fragment int, part array<long>"), "jaccard-parts")
    one = parts.select(F.col("rep").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("__pa"))
    two = parts.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("__pb"))
    partial = pairs.join(one, ["a", "na"]).join(two, ["b", "nb", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("__pa", "__pb")).alias("__x"))
    x = F.sum("__x")
    whole = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("__x").alias("__x")).groupBy("a", "b", "na", "nb").agg(x.alias("__x"))
    out = cut(whole.filter(100 * F.col("__x") >= percent * (F.col("na") + F.col("nb") - F.col("__x"))).select("a", "b"), "jaccard-links")
    discard(ids, parts)
    return out


def shared_tokens(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """rows without those whose token no other row has. A window holds the rows of one token;
    tokens that may have more than WINDOW_ROWS are counted before they are shuffled instead."""
    most = int(orders(np.array([WINDOW_ROWS]))[0])
    light = rows if levels.max(initial=0) <= most else rows.filter(F.shiftright("token", 55) <= most)
    out = light.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("__c > 1")
    if light is rows:
        return out
    heavy = rows.filter(F.shiftright("token", 55) > most)
    counts = cut(heavy.groupBy("token").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1"), "jaccard-heavy")
    return out.unionByName(lookup(heavy, counts, "token", "__c").filter("__c > 1"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach. Each round takes the
    smallest label among the neighbours, then the label's own label; it ends when none changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{name}-labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("__near"))
        least = label.join(near, "node").withColumn("__least", F.least("component", "__near"))
        jump = label.select(F.col("node").alias("__least"), F.col("component").alias("__jump"))
        new = cut(least.join(jump, "__least", "left").select("node", F.least("__least", "__jump").alias("component"), F.col("component").alias("__was")), f"{name}-labels")
        label = new.select("node", "component")
        if new.filter("component != __was").isEmpty():
            return label


def with_components(docs: DataFrame, *, k: int = 4, percent: int = 85, fragments: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text; other columns are not read).

    Two documents link when 100 * intersection >= percent * union of their sets of
    k-word shingles; component_id is the smallest doc_id that links reach.
    Texts without words (null, empty) have no shingles and link with nothing. Rows
    whose doc_id is null take part in no link and are their own component (null). Rows
    that repeat a doc_id are each returned. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counted = cut(docs.mapInArrow(count_pass(k), "counts boolean, doc_id long, n long, sign string, slice int, sums binary"), "jaccard-counts", ["counts"])
    member = counted.filter("not counts").select("doc_id", F.col("n").alias("n_shingles"), "sign")
    classes = cut(member.filter("sign is not null and doc_id is not null").groupBy("sign").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("__n")), "jaccard-classes")
    levels, mass = levels_of(counted)
    shared = spark.sparkContext.broadcast(levels)
    heads = docs.filter("doc_id is not null").mapInArrow(head_pass(k, percent, shared), "doc_id long, sign string, n long, head array<long>, parity array<long>")
    heads = heads.filter("n > 0").groupBy("sign").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("parity").alias("parity"))
    heads = cut(heads.drop("sign"), "jaccard-heads")
    # a band holds sizes that could link; the first rows of a head suffice for the smaller set of a pair
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    first = F.col("n") - F.ceil(F.col("n") * (2.0 * percent / (100 + percent)) - 1e-9) + 1
    need = lambda m, n: F.ceil((m + n) * (percent / (100.0 + percent)) - 1e-9)
    # one shuffle of the heads: token, document, and size with place in one number
    rows = heads.select("rep", "n", F.posexplode("head").alias("at", "token")).select("token", "rep", (F.shiftleft("n", 31) + F.col("at")).alias("__na"))
    rows = shared_tokens(rows, levels).select("token", "rep", F.shiftright("__na", 31).alias("n"), F.col("__na").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("at"))
    found = cut(rows, "jaccard-rows")
    # lead: how many shingles a document has before the first that another head holds too
    lead = found.groupBy(F.col("rep").alias("__rep"), F.col("n").alias("__n")).agg(F.min("at").alias("lead"))
    rows = found.join(lead, (F.col("rep") == F.col("__rep")) & (F.col("n") == F.col("__n"))).drop("__rep", "__n")
    rows = cut(rows.withColumn("band", band).withColumn("short", F.col("at") < first), "jaccard-rows")
    # of each token and band one leader; a token has at most as many bands as sizes have powers
    leader = rows.groupBy("token", "band").agg(F.min(F.when(F.col("short"), F.struct("lead", "rep", "n", "at"))).alias("leader"), F.count(F.lit(1)).alias("__n"))
    leader = leader.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", "leader"))).alias("leaders"), F.sum("__n").alias("__n"))
    leader = cut(leader, "jaccard-leaders")
    led = lookup(rows, leader, "token", "__n", total=rows.count()).withColumn("leader", F.element_at("leaders", F.col("band")))

    def near(m: Column, i: Column, p: Column, n: Column, j: Column, q: Column) -> Column:
        """Whether sets of sizes m and n with a common shingle at i and j, and leads p and q, could link.

        A shingle of the one's lead is in the other only behind its head; then all of that
        head but the few places before it are lost. Where sizes are near, that is more than a
        link can lose, so such a lead is lost as a whole.
        """
        lost = lambda a, lead, b: (lead > a - need(m, n)) & (a - need(m, n) <= need(m, n) - F.ceil(b * (percent / 100.0) - 1e-9))
        sizes = 100 * F.least(m, n) >= percent * F.greatest(m, n)
        return sizes & (F.least(i, j) + F.least(m - i, n - j) >= need(m, n)) & ~lost(m, p, n) & ~lost(n, q, m)

    shared = spark.sparkContext.broadcast((levels, pivots(mass, fragments)))
    x = lambda c: F.col(f"leader.{c}")
    stars = led.filter((x("rep") != F.col("rep")) & near(x("n"), x("at"), x("lead"), F.col("n"), F.col("at"), F.col("lead")))
    stars = stars.select(x("rep").alias("a"), F.col("rep").alias("b"), x("n").alias("na"), F.col("n").alias("nb")).distinct()
    # where a doc_id has several texts of one size, their bits are not known
    bits = heads.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("__c"), F.first("parity").alias("parity")).select("rep", "n", F.when(F.col("__c") == 1, F.col("parity")).alias("parity"))
    bits = cut(bits, "jaccard-bits")
    discard(found, heads)

    def could(p: Column, q: Column, m: Column, n: Column) -> Column:
        """Whether few enough bits differ for a link (true where bits are not known)."""
        differ = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return F.coalesce(differ <= m + n - 2 * need(m, n), F.lit(True))

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose bits allow a link. Sizes are near, so the one array is at most twice as long as the other."""
        pairs = pairs.join(bits.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), ["a", "na"])
        pairs = pairs.join(bits.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb")), ["b", "nb"])
        half = lambda p: F.zip_with(F.slice(p, F.lit(1), (F.size(p) / 2).cast("int")), F.slice(p, (F.size(p) / 2).cast("int") + 1, F.size(p)), lambda x, y: x.bitwiseXOR(y))
        p, q = (F.when(F.size(one) > F.size(other), half(F.col(one))).otherwise(F.col(one)) for one, other in (("pa", "pb"), ("pb", "pa")))
        return pairs.filter(could(p, q, F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")

    stars = cut(possible(stars), "jaccard-stars")
    edges = links(stars, docs, k, percent, shared)
    label = components(edges, "jaccard")
    # what is left: pairs of different components at one head shingle
    own = cut(rows.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "jaccard-own")
    several = own.groupBy("token").agg(F.min("component").alias("__lo"), F.max("component").alias("__hi"), F.count(F.lit(1)).alias("__n")).filter("__lo != __hi")
    several = cut(several.select("token", F.lit(True).alias("__several"), "__n"), "jaccard-several")
    mixed = lookup(own, several, "token", "__n").filter("__several").select("token", "rep", "n", "at", "lead", "short", "component")
    # the bits of small sets decide in the join itself, those of large ones (null here) pair by pair
    little = bits.select("rep", "n", F.when(F.size("parity") == PARITY_WORDS, F.col("parity")).alias("parity"))
    mixed = cut(mixed.join(little, ["rep", "n"]), "jaccard-mixed")
    discard(rows, leader, own, several)
    a, b = mixed.filter("short").alias("x"), mixed.alias("y")
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") != F.col("y.rep")))
    pairs = a.join(b, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & order & near(*[F.col(c) for c in ("x.n", "x.at", "x.lead", "y.n", "y.at", "y.lead")]) & could(*[F.col(c) for c in ("x.parity", "y.parity", "x.n", "y.n")]))
    low = F.col("x.rep") < F.col("y.rep")
    pairs = pairs.select(*[F.when(low, F.col(p)).otherwise(F.col(q)).alias(o) for p, q, o in (("x.rep", "y.rep", "a"), ("y.rep", "x.rep", "b"), ("x.n", "y.n", "na"), ("y.n", "x.n", "nb"))]).distinct()
    pairs = cut(possible(pairs), "jaccard-pairs")
    more = links(pairs, docs, k, percent, shared)
    discard(mixed, bits, stars, pairs)
    if not more.isEmpty():
        label = components(edges.union(more), "jaccard")
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sign", F.coalesce("component", "rep").alias("component_id"), "__n")
    named = cut(named, "jaccard-named")
    # classes of one document name themselves unless a link renamed them, so only the others are looked up
    out = lookup(member, named, "sign", "__n")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id
    (equal rows of it stay). Documents without words stay."""
    found = with_components(docs, **options)
    gone = found.filter("component_id != doc_id").select("doc_id").distinct()
    few = cut(gone, "jaccard-gone")
    return docs.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, "doc_id", "left_anti")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS shingles FROM w),
s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x, any_value(a.n) AS na, any_value(b.n) AS nb FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p WHERE 100 * x >= 85 * (na + nb - x)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM l JOIN c USING (doc_id)
"""
