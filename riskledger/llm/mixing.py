"""Operator 3, mixing sources to target weights (DataFrame functions only).

Equal-token blocks go to sources, and inside a source to its shards, by the
highest quotients (Sainte-Laguë); each shard then takes a seeded, cyclic run of
its own blocks. Documents lie in a shard in seeded hash order, so that such a
run is a random choice of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskledger.llm._common import WORD, cut, table

#: Sources are few; a larger table is joined with salted keys instead of a broadcast.
BROADCAST_SOURCES = 100_000
#: Rows of one source that meet in one task of the salted join.
SALTS = 64


def apportion(df: DataFrame, groups: list[str], weight: str, seats: str, key: list[str], out: str) -> DataFrame:
    """Sainte-Laguë: each group's seats (a column, equal within the group) go to
    its rows by the highest quotients weight / (2k + 1); ties by key. Adds out.

    Rounding weight * seats / total is what the quotients above one common
    divisor give; the few seats over or short go by quotient. With n rows and s
    seats short, no row can gain more than share * (s + n) + 1 of them, so the
    quotients written out are at most s + 3n. Rows without weight get none.
    """
    w = Window.partitionBy(*[F.col(g) for g in groups]) if groups else Window.partitionBy(F.lit(0))
    df = (
        df.withColumn("__w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
        .withColumn("__share", F.coalesce(F.try_divide(F.col("__w"), F.sum("__w").over(w)), F.lit(0.0)))
        .withColumn("__base", F.floor(F.col("__share") * F.col(seats) + 0.5))
        .withColumn("__short", F.when(F.sum("__w").over(w) > 0, F.col(seats) - F.sum("__base").over(w)).otherwise(F.lit(0)))
        .withColumn("__most", F.ceil(F.col("__share") * (F.abs("__short") + F.count(F.lit(1)).over(w))) + 1)
    )
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("__short") == 0, 0).otherwise(F.col("__most")).cast("long")))
    plus = F.col("__short") > 0
    quotient = F.when(plus, F.col("__w") / (2 * (F.col("__base") + F.col("__k")) + 1)).otherwise(F.try_divide(F.col("__w"), 2 * (F.col("__base") - F.col("__k")) - 1))
    # of equal quotients the smaller key wins: it gains first and loses last
    gains = [F.col("__q").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in key]]
    losses = [F.col("__q").asc_nulls_last(), *[F.col(c).desc_nulls_first() for c in key]]
    place = F.when(plus, F.row_number().over(w.orderBy(*gains))).otherwise(F.row_number().over(w.orderBy(*losses)))
    moved = (F.col("__short") != 0) & (place <= F.abs("__short")) & (F.col("__w") > 0)
    return (
        df.withColumn("__k", k)
        .withColumn("__q", F.when(plus | (F.col("__base") - F.col("__k") >= 1), quotient))
        .withColumn("__moved", F.when(moved & F.col("__q").isNotNull(), F.signum("__short")).otherwise(F.lit(0.0)))
        .groupBy(*[c for c in df.columns])
        .agg(F.sum("__moved").alias("__moved"))
        .withColumn(out, (F.col("__base") + F.col("__moved")).cast("long"))
        .drop("__w", "__share", "__base", "__short", "__most", "__moved")
    )


def targets(sources: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Adds target to a table of (__source, __source_size): sources by code
    point, null last, weigh weights in turn; a target stops at max_epochs times
    its source's size and the excess is shared anew by weight.

    The sources that stop are those with the smallest size per weight, so one
    running sum over that order finds the level at which all is shared.
    """
    every = Window.partitionBy(F.lit(0))
    at = F.row_number().over(every.orderBy(F.col("__source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_level = every.orderBy("__level", F.col("__source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("__source_size").over(every) - F.coalesce(F.sum("__stop").over(before), F.lit(0.0))
    left = F.sum("__weight").over(every) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    return (
        sources.withColumn("__weight", F.element_at(cycle, F.pmod(at - 1, F.lit(len(weights))) + 1))
        .withColumn("__stop", F.col("__source_size") * float(max_epochs))
        .withColumn("__level", F.col("__stop") / F.col("__weight"))
        .withColumn("__open", rest / left)  # the level if this source and all after it stay open
        .withColumn("__final", F.min(F.when(F.col("__open") <= F.col("__level"), F.struct("__level", "__open"))).over(every)["__open"])
        .withColumn("__target", F.coalesce(F.least(F.col("__stop"), F.col("__weight") * F.col("__final")), F.col("__stop")))
        .drop("__stop", "__level", "__open", "__final", "__weight")
    )


def mix(docs: DataFrame, *, size: str, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, block_words: int = 16, shard_docs: int = 1000, max_shards: int = 4096, seed: int = 7) -> DataFrame:
    """Each row of docs (doc_id, source and the words in column size) with
    __source_size, __target and __taken: the words that the mix takes of it.

    The targets share all words. A source is cut into shards of about
    shard_docs documents (a hot source into max_shards at most), so no task holds a
    source. A block is block_words words of a shard; quotas of blocks go to
    sources by target and to shards by size. A shard takes whole passes over its
    blocks, then a seeded cyclic run of the rest; a document gets the words of
    its blocks, at most max_epochs times its size. Null sources are one source,
    null sizes are 0; a very long document is a shard's larger part, no more; repeated rows count each; an
    empty table stays empty. Columns of docs keep their values, but for those that the result adds.
    """
    added = ["__size", "__source_size", "__target", "__taken"]
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), "doc_id", "source", F.col(size).alias("size"))
    docs = _mixed(docs, size="size", weights=weights, max_epochs=max_epochs, block_words=block_words, shard_docs=shard_docs, max_shards=max_shards, seed=seed)
    return docs.select(*[F.col("row")[c].alias(c) for c in names], *added)


def _mixed(docs: DataFrame, *, size: str, weights: tuple[float, ...], max_epochs: int, block_words: int, shard_docs: int, max_shards: int, seed: int) -> DataFrame:
    """mix, for rows of its own columns."""
    docs = docs.withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("__hash", F.xxhash64(F.lit(seed), "doc_id", "__size"))
    sources = docs.groupBy(F.col("source").alias("__source")).agg(F.sum("__size").alias("__source_size"), F.count(F.lit(1)).alias("__n"))
    sources = targets(sources, weights, max_epochs)
    every = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("__blocks", F.floor(F.sum("__source_size").over(every) / block_words + 0.5))
    sources = cut(apportion(sources, [], "__target", "__blocks", ["__source"], "__quota").withColumn("__shards", F.least(F.ceil(F.col("__n") / shard_docs), F.lit(max_shards)).cast("long")).drop("__n", "__blocks"), "mix-sources")
    if sources.count() <= BROADCAST_SOURCES:
        docs = docs.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    else:
        salted = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("__salt", F.pmod("__hash", F.lit(SALTS)).cast("int"))
        docs = docs.join(salted, F.col("source").eqNullSafe(F.col("__source")) & (docs["__salt"] == salted["__salt"])).drop("__source", "__salt")
    docs = docs.withColumn("__shard", F.pmod(F.shiftright("__hash", 7), F.col("__shards")))
    shards = docs.groupBy("source", "__shard").agg(F.sum("__size").alias("__shard_size"), F.first("__quota").alias("__quota"))
    shards = apportion(shards, ["source"], "__shard_size", "__quota", ["__shard"], "__shard_quota")
    nb = F.ceil(F.col("__shard_size") / block_words)
    quota = F.least(F.col("__shard_quota"), nb * max_epochs)
    shards = cut(
        shards.select(
            F.col("source").alias("__source"), F.col("__shard").alias("__at"), nb.alias("__nb"), F.try_divide(quota, nb).cast("long").alias("__passes"), F.coalesce(F.try_mod(quota, nb), F.lit(0)).alias("__run"),
            F.coalesce(F.try_mod(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "__shard"), 1), nb), F.lit(0)).alias("__from"),
        ),
        "mix-shards",
    )
    docs = docs.join(shards, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__shard") == F.col("__at")))
    w = Window.partitionBy("source", "__shard").orderBy("__hash", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("__start", F.coalesce(F.sum("__size").over(w), F.lit(0)))
    end = F.col("__start") + F.col("__size")
    over = lambda a, b: F.greatest(F.lit(0), F.least(end, b * block_words) - F.greatest(F.col("__start"), a * block_words))
    last, nbs = F.col("__from") + F.col("__run"), F.col("__nb")
    taken = F.coalesce(F.col("__passes"), F.lit(0)) * F.col("__size") + over(F.col("__from"), F.least(last, nbs)) + over(F.lit(0), F.greatest(last - nbs, F.lit(0)))
    return docs.withColumn("__taken", taken.cast("long")).drop("__source", "__at", "__nb", "__passes", "__run", "__from", "__start", "__hash", "__shard", "__shards", "__quota")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it: the words taken by the
    row's size, rounded. Rows without words are kept once (they weigh nothing); all columns stay."""
    names = docs.columns
    sized = docs.select(F.struct(*[F.col(c) for c in names]).alias("held"), "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("words"))
    mixed = mix(sized, size="words", **options)
    times = F.when(F.col("__size") == 0, 1).otherwise(F.floor(F.col("__taken") / F.col("__size") + 0.5))
    return mixed.withColumn("__times", times.cast("int")).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col("held")[c].alias(c) for c in names])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    mixed = mix(cut(docs, "mix-sizes"), size="size")
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"), "source")
