"""Operator 1, benchmark decontamination (DataFrame functions only).

A document leaks a benchmark item when one of its windows of the item's size has a
weighted similarity of 0.8 or more to it: over five-word shingles, the sum of the
smaller counts through that of the larger ones. For each size of an item that has enough
shingles in the document, windows of that size that start at a benchmark shingle and hold
enough of them, of whatever items, get SimHash fingerprints (no other window can be the
first of the best ones). An index of eight blocks of bits finds all items of that size
within the radius, and the exact similarity decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskledger.llm._common import cut, let, table, words

#: Rows up to which a table made from the benchmark, or a list of leaking documents, is broadcast.
BROADCAST_ROWS = 500_000


def shingles(text: Column, k: int = 5) -> Column:
    """Hashes of a text's k-word shingles in order; fewer words are one shingle, none none."""
    every = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return let(words(text), lambda w: F.when(F.size(w) >= k, every(w)).when(F.size(w) > 0, F.array(F.xxhash64(F.lit(0), w))).otherwise(F.expr("cast(array() as array<bigint>)")))


def simhash(shingled: str) -> Column:
    """64 bits: each is set if it is set in more than half of the hashes."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if(2 * aggregate({shingled}, 0L, (c, x) -> c + (shiftright(x, b) & 1L)) > size({shingled}), 1L, 0L), b))"
    )


#: A fingerprint has 8 blocks of 8 bits. Two that differ in at most RADIUS bits have a block in
#: which they differ in at most two: that is where one of the 37 neighbours of the other's block meets it.
BLOCKS, NEAR, RADIUS = 8, 2, 23
NEIGHBOURS = [x for x in range(256) if x.bit_count() <= NEAR]


def blocks(fingerprint: str) -> Column:
    """The fingerprint's blocks: array of (block, value)."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fingerprint), 8 * i).bitwiseAND(F.lit(255)).alias("value")) for i in range(BLOCKS)])


def near_blocks(fingerprint: str) -> Column:
    """All blocks that differ from the fingerprint's own in at most NEAR bits."""
    masks = F.array(*[F.lit(x).cast("long") for x in NEIGHBOURS])
    return F.flatten(F.transform(blocks(fingerprint), lambda b: F.transform(masks, lambda m: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(m).alias("value")))))


def overlap(a: str, b: str) -> Column:
    """Sum over shingles of the smaller of the two counts."""
    plain = F.expr(f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})")
    count = f"aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    return F.when(plain, F.expr(f"size(array_intersect({a}, {b}))")).otherwise(F.expr(count))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, first_word) of each document and item it leaks.

    docs needs doc_id and text, benchmark item_id and text; other columns are not read. Case of A-Z
    doesn't count. A document shorter than the item is one window. A text under five
    words is one shingle, so it only matches an equally short, equal text. Null
    and empty texts leak nothing. Repeated rows of a document give one row; ties
    between windows go to the first. Empty tables give no rows. Of 64 bits about 10 differ at a
    similarity of 0.8, with a deviation of 3: of 420,000 simulated windows 6 lay beyond 23.
    """
    if radius > BLOCKS * (NEAR + 1) - 1:
        raise ValueError("the index does not find all fingerprints so far apart")
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = benchmark.select("item_id", shingles(F.col("text")).alias("item")).withColumn("k", F.size("item")).filter("k > 0").dropDuplicates(["item_id", "item"])
    items = cut(items.withColumn("mark", simhash("item")), "leak-items")
    wanted = small(items.select("item_id", "k", F.explode(F.array_distinct("item")).alias("shingle")))
    placed = docs.select("doc_id", "text_hash", shingles(F.col("text")).alias("own"))
    placed = placed.select("doc_id", "text_hash", F.size("own").alias("n"), F.posexplode("own").alias("at", "shingle"))
    hits = cut(placed.join(wanted, "shingle").select("doc_id", "text_hash", "n", "item_id", "k", "at"), "leak-hits")
    m, one = F.least("k", "n"), ["doc_id", "text_hash", "n"]
    need = F.ceil((F.col("k") + m) * (least / (1 + least)) - 1e-9).cast("int")
    # sizes of which an item has enough shingles in the document, and where all such items have theirs
    enough = hits.groupBy(*one, "item_id", "k").agg(F.collect_set("at").alias("p")).filter(F.size("p") >= need)
    hits = enough.groupBy(*one).agg(F.collect_set("k").alias("sizes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("p"))
    # windows of size m with at least need hits, each started at its first hit
    hits = hits.select(*one, "p", F.explode("sizes").alias("k")).withColumn("m", m).withColumn("need", need)
    starts = F.expr("transform(filter(sequence(0, size(p) - need), i -> p[i + need - 1] - p[i] < m), i -> least(p[i], n - m))")
    found = hits.select("doc_id", "text_hash", "k", "m", F.explode(F.array_distinct(starts)).alias("start"))
    found = cut(found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("k", "m", "start")).alias("windows")), "leak-windows")
    own = small(found.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_hash", "__hash"))
    again = docs.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("doc_id", "text_hash", "windows", shingles(F.col("text")).alias("own"))
    cutout = let(F.col("own"), lambda s: F.transform("windows", lambda v: F.struct(v["k"].alias("k"), v["start"].alias("start"), F.slice(s, v["start"] + 1, v["m"]).alias("window"))))
    windows = again.select("doc_id", "text_hash", F.explode(cutout).alias("w")).select("doc_id", "text_hash", "w.*")
    windows = cut(windows.withColumn("seen", simhash("window")).dropDuplicates(["doc_id", "text_hash", "k", "start"]), "leak-marks")
    left = windows.select("doc_id", "text_hash", "k", "start", "seen", F.explode(blocks("seen")).alias("b"))
    right = items.select("item_id", "k", "mark", F.explode(near_blocks("mark")).alias("b"))
    near = left.join(small(right), ["k", "b"]).filter(F.bit_count(F.col("seen").bitwiseXOR(F.col("mark"))) <= radius)
    near = near.select("doc_id", "text_hash", "k", "start", "item_id").distinct()
    full = near.join(windows.select("doc_id", "text_hash", "k", "start", "window").withColumnRenamed("doc_id", "__id"), F.expr("doc_id <=> __id")
                     & (near["text_hash"] == windows["text_hash"]) & (near["k"] == windows["k"]) & (near["start"] == windows["start"])).select(near["*"], "window")
    full = full.join(small(items.select("item_id", "item")), "item_id").withColumn("__x", overlap("window", "item"))
    full = full.withColumn("similarity", F.col("__x") / (F.size("window") + F.size("item") - F.col("__x"))).filter((F.col("similarity") >= least) & (F.size("item") == F.col("k")))
    best = F.max(F.struct("similarity", -F.col("start")))
    return full.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select("doc_id", "text_hash", "item_id", "b.similarity", (-F.col("b.col2")).alias("first_word"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that leak an item."""
    found = cut(leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "leak-documents")
    return docs.join(small(found), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity", "first_word")
