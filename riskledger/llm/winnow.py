"""Operator 4, document fingerprints by winnowing (DataFrame functions only).

A text's words make k-grams, each hashed; of every window of grams the smallest
hash is kept, of equal ones the rightmost, with its position. Two texts that
share k + window - 1 words in a row share a kept hash, wherever that run lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskledger.llm._common import cut, let, table, words

#: Equal bins of the doc_id range that are counted at once, and of a bin that holds far more than its share.
BINS, INNER = 1 << 16, 256
FIRST_KEY = -(1 << 63)
#: Word hashes and k-gram hashes are numbers below this prime; a k-gram's is a polynomial in BASE.
PRIME, BASE = (1 << 31) - 1, 1_000_003


def rolling(hashed: Column, k: int) -> Column:
    """Hashes of all k-grams of an array of word hashes. The polynomial that a rolling hash keeps
    up to date is summed at each place: the words are hashed once, and k products cost less than a
    running value that lambda functions would have to copy along."""
    factors = [pow(BASE, k - 1 - j, PRIME) for j in range(k)]
    gram = lambda i: F.pmod(sum((F.pmod(F.get(hashed, i + j) * F.lit(f), F.lit(PRIME)) for j, f in enumerate(factors)), F.lit(0)), F.lit(PRIME))
    return F.transform(F.sequence(F.lit(0), F.size(hashed) - k), gram)


def window_minima(v: Column, window: int) -> Column:
    """The smallest of each window of v (longer than a window), each once: minima of twice as many
    places come from two neighbouring ones, and a window from the two widest that cover it."""

    def widen(v: Column, wide: int) -> Column:
        step = min(wide, window - wide)
        wider = F.transform(v, lambda x, i: F.least(x, F.get(v, i + step)))
        return F.array_distinct(F.slice(wider, F.lit(1), F.size(v) - window + 1)) if wide + step == window else let(wider, lambda u: widen(u, wide + step))

    # beyond the last place get() is null, which least() passes over; those windows are cut off at the end
    return v if window == 1 else widen(v, 1)


def kept(text: Column, k: int = 5, window: int = 12) -> Column:
    """The kept grams of a text in order: 31 bits of hash above 32 bits of
    reversed position, so the smallest number is the smallest hash, the rightmost of equals."""
    tail = (1 << 32) - 1
    place = lambda h, i: h * F.lit(1 << 32) + (F.lit(tail) - i)

    def packed(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))
        every = let(let(hashed, lambda h: rolling(h, k)), lambda g: F.transform(g, place))
        short = F.array(place(F.pmod(F.xxhash64(F.lit(0), w), F.lit(PRIME)), F.lit(0)))
        return F.when(F.size(w) >= k, every).when(F.size(w) > 0, short).otherwise(F.expr("cast(array() as array<bigint>)"))

    def least(v: Column) -> Column:
        return F.when(F.size(v) > window, window_minima(v, window)).when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v)

    return let(let(words(text), packed), least)


def written(grams: Column) -> Column:
    """Kept grams as text: hash:position of each, in order."""
    return F.array_join(F.transform(grams, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 32))), F.lit(":"), (F.lit((1 << 32) - 1) - x.bitwiseAND(F.lit((1 << 32) - 1))).cast("string"))), " ")


def hashes(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, lambda x: F.shiftrightunsigned(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def binned(docs: DataFrame, key: str, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """docs with __bin, ascending in key (an array of numbers: a bin, a bin inside it, and so on), and the
    rows and the first key of each bin. Bins are equal parts of the range of keys; one with far more than its
    share is parted again over the keys that it has, so no far-off key fills a bin with all others."""
    keys = docs.select(key)
    span = keys.filter(F.col(key) != FIRST_KEY).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    # keys are halved before they are subtracted, so that no difference is too large
    half = lambda x: abs(x) // 2 * (1 if x >= 0 else -1)
    lo, width = half(span["lo"] or 0), (half(span["hi"] or 0) - half(span["lo"] or 0)) // BINS + 1
    path, levels = F.array(F.when(F.col(key) == FIRST_KEY, -1).otherwise(F.expr(f"cast(({key} div 2 - {lo}) div {width} as int)"))), []

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("__bin", path)
        for heavy in levels:
            inner = F.expr(f"cast(({key} div 2 - __lo) div __width as int)")
            df = df.join(F.broadcast(heavy), "__bin", "left").withColumn("__bin", F.when(F.col("__lo").isNull(), F.col("__bin")).otherwise(F.concat("__bin", F.array(inner)))).drop("__lo", "__width")
        return df

    while True:
        bins = cut(placed(keys).groupBy("__bin").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")), "next-bins")
        # at most BINS / 8 bins are so heavy, whatever the data
        most = max(8 * bucket_rows, 8 * (span["n"] or 0) // BINS)
        heavy = bins.filter((F.col("n") > most) & F.expr("last div 2 > first div 2")).select("__bin", F.expr("first div 2").alias("__lo"), F.expr(f"(last div 2 - first div 2) div {INNER} + 1").alias("__width"))
        heavy = cut(heavy, "next-heavy")
        if heavy.isEmpty():
            return placed(docs), bins.select("__bin", "n", "first")
        levels.append(heavy)


def with_next(docs: DataFrame, key: str, values: list[str], order: list[str], *, bucket_rows: int = 500) -> DataFrame:
    """docs with __next, a struct of the values of the row after it by key (then
    order); after the last comes the first. Null keys come first.

    Rows meet in buckets of the key's range, of about bucket_rows each (more where the
    count of rows exceeds BINS times that, or a key repeats); a copy of each bucket's first row goes to the
    bucket before it.
    """
    docs = docs.withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(FIRST_KEY)))
    docs, bins = binned(docs, "__key", bucket_rows)
    # bins are at most a few times BINS; their running count is one small sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = cut(bins.select("__bin", "first", F.floor(before / bucket_rows).alias("__bucket")), "next-bins")
    heads = bins.groupBy("__bucket").agg(F.min("first").alias("__key"))
    every = Window.orderBy("__bucket")
    to = F.coalesce(F.lag("__bucket").over(every), F.max("__bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = cut(heads.select("__key", to.alias("__bucket")), "next-heads")
    own = docs.join(F.broadcast(bins.select("__bin", "__bucket")), "__bin").withColumn("__copy", F.lit(False))
    copies = docs.join(F.broadcast(heads), "__key").withColumn("__copy", F.lit(True))
    columns = [*[c for c in docs.columns if c != "__bin"], "__bucket", "__copy"]
    w = Window.partitionBy("__bucket").orderBy("__copy", "__key", *order)
    both = own.select(columns).unionByName(copies.select(columns))
    return both.withColumn("__next", F.lead(F.struct(*values)).over(w)).filter("not __copy").drop("__key", "__bucket", "__copy")


def fingerprints(docs: DataFrame, *, k: int = 5, window: int = 12) -> DataFrame:
    """docs (doc_id, text) with each text's fingerprint and that of its edited text,
    whose last quarter is the beginning of the next document.

    A null text is empty; a text without words has an empty fingerprint, one with
    fewer than k words that of its whole sequence. Rows that repeat a doc_id follow
    each other by text. A single row is its own next; an empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"), kept(text, k, window).alias("own"))
    near = with_next(own, "doc_id", ["text", "own"], ["text"])
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring(F.col("__next.text"), F.lit(1), moved))
    digest = lambda t: let(kept(t, k, window), lambda e: F.struct(F.sha2(t.cast("binary"), 256).alias("sha"), written(e).alias("text"), let(hashes(e), lambda h: likeness(hashes(F.col("own")), h)).alias("near")))
    near = near.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("__next.own").alias("after"), let(edited, digest).alias("e"))
    return near.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), F.col("e.text").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"), likeness(hashes(F.col("own")), hashes(F.col("after"))).alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
