"""Operator 11, near-duplicate removal by fast similarity sketching, banding and exact verification.

A sketch has a coordinate for each of COORDINATES bins. In a round every shingle of the set is
thrown into a bin by a hash of the round, with a value; the least value of the first round that reaches a
bin is its coordinate. Rounds end when all bins are filled. As many rounds again as there are bins throw
all shingles into one bin each, so none stays empty, and the share of equal coordinates of two sets lies around
their similarity as closely as independent draws would.

Sketches are cut into bands; sets that agree on a band are candidates. Parity bits of the full sets drop, without loss,
most candidates that differ too much; those whose overlap is enough, counted on the full sets, are links. A band's documents are first compared with one leader, and, as long
as that joins many, with new leaders; only then those outside the band's largest component with all others, once
a pair. So copies never meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskledger.llm._common import cut, discard, lookup, table
from riskledger.llm._words import mix, shingle_hashes, slices, trim
from riskledger.llm.ngram_join import COUNT_BITS, components, links, parity, signature

#: A sketch is cut into BANDS of ROWS coordinates. Sets of similarity 0.85 agree on none with probability 6e-9.
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Leaders are drawn anew while the pairs that are left are more than so many for each row of a band, and a quarter of them went.
PAIRS_A_ROW = 16
#: Fragments of the sets in which overlaps are counted, and text that a task sketches at once.
FRAGMENTS, SLICE_BYTES = 8, 4_000_000


def seed(i: int) -> np.uint64:
    return mix(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The coordinates of each set of hashes (uint64), a row a set; those of an empty set stay EMPTY."""
    out = np.full((len(sets), COORDINATES), EMPTY, np.uint64)
    flat, bins = out.reshape(-1), np.uint64(COORDINATES)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    item = np.concatenate([np.zeros(0, np.uint64), *sets])
    row = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    for i in range(2 * COORDINATES):
        if not item.size:
            break
        h = mix(item ^ seed(i))
        at = ((h >> half) * bins >> half).astype(np.int64) if i < COORDINATES else i - COORDINATES
        np.minimum.at(flat, row * COORDINATES + at, (np.uint64(i) << half) | (h & low))
        unfilled = np.zeros(len(sets), bool)
        now = np.unique(row)
        unfilled[now] = (out[now] == EMPTY).any(axis=1)
        stays = unfilled[row]
        item, row = item[stays], row[stays]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row of sketches, its number in the sketch included."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j])
    return key.view(np.int64)


def sketch_pass(k: int):
    """Per document its set's size, signature, band keys and parity bits."""

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *[v.size for v in values]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = list(shingle_hashes(batch["text"], k))
                keys = bands(sketches(sets))
                signs = [signature(s) if s.size else None for s in sets]
                sizes = [s.size for s in sets]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(signs, pa.string()), lists(list(keys)), lists([parity(s) for s in sets])], ["doc_id", "n", "sign", "bands", "parity"])
        trim()

    return run


def first_band(x: Column, y: Column) -> Column:
    """The first band, from 0, whose keys agree."""
    return F.array_position(F.zip_with(x, y, lambda a, b: a == b), F.lit(True)) - 1


def near(m: Column, n: Column, percent: int) -> Column:
    """Whether sets of sizes m and n could link."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def close(p: Column, q: Column, m: Column, n: Column, percent: int) -> Column:
    """Whether so few parity bits differ as a link allows (true where bits are not known): no more than the shingles that
    one set alone has. Sizes are near, so the one array is at most twice as long as the other, and its halves are folded."""
    half = lambda a: F.zip_with(F.slice(a, F.lit(1), (F.size(a) / 2).cast("int")), F.slice(a, (F.size(a) / 2).cast("int") + 1, F.size(a)), lambda x, y: x.bitwiseXOR(y))
    one, two = F.when(F.size(p) > F.size(q), half(p)).otherwise(p), F.when(F.size(q) > F.size(p), half(q)).otherwise(q)
    differ = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    need = F.ceil((m + n) * (percent / (100.0 + percent)) - 1e-9)
    return F.coalesce(differ <= m + n - 2 * need, F.lit(True))


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose parity bits allow a link."""
    side = lambda x: bits.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"__{x}"))
    both = pairs.join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"])
    return both.filter(close(F.col("__a"), F.col("__b"), F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb")


def stars(rows: DataFrame, leader: str, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each document and the least leader (a struct with rep and n) that it meets in any of
    its bands and whose size allows a link: one pair a document, however many bands it shares."""
    some = rows.filter((F.col(f"{leader}.rep") != F.col("rep")) & near(F.col(f"{leader}.n"), F.col("n"), percent))
    least = some.groupBy("rep", "n").agg(F.min(leader).alias("__led"))
    return least.select(F.col("__led.rep").alias("a"), F.col("rep").alias("b"), F.col("__led.n").alias("na"), F.col("n").alias("nb"))


def unsettled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows (key, band, rep, n) of keys with several components, with their component and the key's largest one (main)."""
    own = rows.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    own = cut(own.withColumn("component", F.coalesce("component", "rep")), "minhash-own")
    parts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("__c")).groupBy("key")
    several = parts.agg(F.max(F.struct("__c", "component")).alias("__most"), F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__parts")).filter("__parts > 1")
    several = cut(several.select("key", F.col("__most.component").alias("main"), "__n"), "minhash-several")
    out = cut(lookup(own, several, "key", "__n").filter("main is not null").drop("__n"), "minhash-mixed")
    discard(own, several)
    return out


def new_leaders(mixed: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs of each document with two leaders of its bands, drawn by hash for the round: one of a band's main
    component and one of the others. No document meets a leader of its own component."""
    drawn, inside = F.xxhash64("rep", F.lit(number)), F.col("component") == F.col("main")
    best = lambda some: F.min(F.when(some, F.struct(drawn.alias("drawn"), "rep", "n", "component")))
    leaders = cut(mixed.groupBy("key").agg(best(inside).alias("one"), best(~inside).alias("two"), F.count(F.lit(1)).alias("__n")), "minhash-leaders")
    led = cut(lookup(mixed, leaders, "key", "__n"), "minhash-led")
    sides = [stars(led.filter(F.col(f"{s}.component") != F.col("component")), s, percent) for s in ("one", "two")]
    out = cut(sides[0].union(sides[1]).distinct(), "minhash-led-pairs")
    discard(leaders, led)
    return out


def with_components(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs (doc_id, text; other columns are not read).

    Documents link when 100 * intersection >= percent * union of their sets of k-word shingles
    (a text with fewer words is one shingle); component_id is the smallest doc_id that links reach, and kept
    whether it is the row's own. Texts without words (null, empty) have no shingles and link with nothing.
    Rows whose doc_id is null take part in no link, have a null component and are kept. Rows that repeat a doc_id
    are each returned, placed by their own text. Texts are read whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sketched = cut(docs.mapInArrow(sketch_pass(k), "doc_id long, n long, sign string, bands array<long>, parity array<long>"), "minhash-sketches")
    # documents with the same set are one class, for which its smallest doc_id stands
    some = sketched.filter("sign is not null and doc_id is not null")
    classes = cut(some.groupBy("sign").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in ("n", "bands", "parity")]), "minhash-classes")
    # a doc_id with several texts of one size has no bits that tell them apart
    several = cut(classes.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1"), "minhash-texts")
    known = lambda c: F.when(F.col("__c").isNull(), F.col(c)).alias(c)
    bits = classes.drop("__n").join(several, ["rep", "n"], "left").select("rep", "n", known("parity"), known("bands"))
    rows = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    shared = cut(rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("leader"), F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "minhash-shared")
    found = cut(rows.join(shared.drop("__n"), "key"), "minhash-rows")
    # the sets are cut into fragments by their hashes, evenly
    fragments = np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(55 - FRAGMENTS.bit_length() + 1)
    whole = spark.sparkContext.broadcast((np.zeros(1 << COUNT_BITS, np.uint8), fragments))
    edges = links(cut(possible(stars(found, "leader", percent), bits, percent), "minhash-stars"), docs, k, percent, whole)
    label, left, number = components(edges, "minhash"), None, 0
    while True:
        mixed = unsettled(found.select("key", "band", "rep", "n"), label)
        here = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("component") != F.col("main")).cast("long")).alias("apart"))
        pairs, size = here.agg(F.sum(F.col("all") * F.col("apart")), F.sum("all")).first()
        if not size or pairs <= PAIRS_A_ROW * size or (left is not None and 4 * pairs > 3 * left):
            break
        left, number = pairs, number + 1
        more = links(cut(possible(new_leaders(mixed, number, percent), bits, percent), "minhash-stars"), docs, k, percent, whole)
        edges = edges.union(more)
        label = components(edges, "minhash")
        discard(mixed)
    mixed = cut(mixed.join(bits, ["rep", "n"]), "minhash-last")
    x, y, c = mixed.filter("component != main").alias("x"), mixed.alias("y"), F.col
    once = ((c("y.component") == c("y.main")) | (c("x.rep") < c("y.rep"))) & F.coalesce(first_band(c("x.bands"), c("y.bands")) == c("x.band"), F.lit(True))
    enough = close(c("x.parity"), c("y.parity"), c("x.n"), c("y.n"), percent)
    pairs = x.join(y, (c("x.key") == c("y.key")) & (c("x.component") != c("y.component")) & near(c("x.n"), c("y.n"), percent) & once & enough)
    low = c("x.rep") < c("y.rep")
    pairs = pairs.select(*[F.when(low, c(p)).otherwise(c(q)).alias(o) for p, q, o in (("x.rep", "y.rep", "a"), ("y.rep", "x.rep", "b"), ("x.n", "y.n", "na"), ("y.n", "x.n", "nb"))]).distinct()
    pairs = cut(pairs, "minhash-pairs")
    more = links(pairs, docs, k, percent, whole)
    discard(shared, found, mixed, pairs)
    if not more.isEmpty():
        label = components(edges.union(more), "minhash")
    named = cut(classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sign", F.coalesce("component", "rep").alias("component_id"), "__n"), "minhash-named")
    discard(classes)
    out = lookup(sketched.select("doc_id", F.col("n").alias("n_shingles"), "sign"), named, "sign", "__n")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (equal rows of it
    stay). Documents without words or without a doc_id stay, and all columns, whatever their names."""
    gone = cut(with_components(docs, **options).filter("not kept").select("doc_id").distinct(), "minhash-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_components(table(spark, sf_dir, "documents"), k=3, percent=85)


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS shingles FROM w),
s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x, any_value(a.n) AS na, any_value(b.n) AS nb FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p WHERE 100 * x >= 85 * (na + nb - x)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM l JOIN c USING (doc_id)
"""
