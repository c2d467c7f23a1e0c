"""Ranks, running totals and exact percentiles over all rows, without gathering them in one task.

Rows are dealt by range, sorted and numbered inside each range, and written once; what lies
before a range is known from one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskledger.sources.bronze import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later plans start from files that outlive any executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, order: list) -> DataFrame:
    """df by ranges of order, written, with the range (__part) and the row's number in it (__at).

    One job writes both, so that all later uses see the same ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    in_range = number.bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return written(ranged.withColumns({"__part": F.shiftright(number, 33).cast("int"), "__at": in_range}), "ranked")


def before(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Of each range the sums of all ranges before it; parts has one row per range."""
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in columns]
    return F.broadcast(parts.select(F.col("__part").alias("__p"), *sums))


def global_rank(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Rows numbered from 1 by order (columns, each ascending or a Column with its
    direction). Rows that order does not tell apart get different numbers in any order."""
    rows = dealt(df, order)
    offsets = before(rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), ["__n"])
    ranked = rows.join(offsets, F.col("__part") == F.col("__p"))
    return ranked.withColumn(out, F.col("__n_before") + F.col("__at")).drop("__part", "__at", "__p", "__n_before")


def running_totals(df: DataFrame, order: list, totals: dict[str, str], out: str = "rank") -> DataFrame:
    """As global_rank, with the running sum of each column of totals (its new name: the column),
    the row itself included; nulls count as 0."""
    rows = dealt(df, order)
    sums = {f"__s{i}": c for i, c in enumerate(totals.values())}
    counted = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(s) for s, c in sums.items()])
    offsets = before(counted, ["__n", *sums])
    w = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inside = {f"{s}_inside": F.coalesce(F.sum(c).over(w), F.lit(0)) for s, c in sums.items()}
    ranked = rows.withColumns(inside).join(offsets, F.col("__part") == F.col("__p"))
    ranked = ranked.withColumns({out: F.col("__n_before") + F.col("__at")} | {t: F.col(f"{s}_before") + F.col(f"{s}_inside") for t, s in zip(totals, sums)})
    return ranked.select(*df.columns, out, *totals)


def grouped_rank(df: DataFrame, groups: list[str], order: list, out: str = "rank") -> DataFrame:
    """Rows numbered from 1 by order inside their group, however large the groups are."""
    ranked = global_rank(df, [*groups, *order], "__r")
    first = ranked.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.min("__r").alias("__first"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    return ranked.join(first, same).withColumn(out, F.col("__r") - F.col("__first") + 1).select(*df.columns, out)


def average_ranks(df: DataFrame, value: str, out: str, groups: list[str] | None = None) -> DataFrame:
    """Ranks of value from 1 (inside each group), equal values sharing their mean rank: running counts over the distinct values."""
    groups = groups or []
    names = [f"__g{i}" for i in range(len(groups))]
    counts = df.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranks, base = running_totals(counts, [*names, "__v"], {"__upto": "__c"}, "__r"), F.lit(0)
    if groups:
        ranks = written(ranks, "values")
        first = ranks.groupBy(*[F.col(n).alias(f"{n}f") for n in names]).agg(F.min(F.col("__upto") - F.col("__c")).alias("__base"))
        ranks, base = ranks.join(first, [F.col(n).eqNullSafe(F.col(f"{n}f")) for n in names]), F.col("__base")
    ranks = ranks.select(*names, "__v", (F.col("__upto") - base - (F.col("__c") - 1) / 2).alias(out))
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names)]
    return df.join(ranks, [*same, df[value].eqNullSafe(ranks["__v"])]).drop("__v", *names)


def percent_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Share of the other rows whose value is smaller, 0 to 1."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranks = running_totals(counts, ["__v"], {"__upto": "__c"}, "__r").select("__v", (F.col("__upto") - F.col("__c")).alias("__less"))
    size = F.broadcast(df.agg(F.count(F.lit(1)).alias("__n")))  # one row
    share = F.coalesce(F.try_divide("__less", F.col("__n") - 1), F.lit(0.0))
    return df.join(ranks, df[value].eqNullSafe(ranks["__v"])).crossJoin(size).withColumn(out, share).drop("__v", "__less", "__n")


def percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of value by group (none: one row), between two neighbours in proportion;
    shares maps the new columns to fractions. Nulls don't count; n is how many values there are. Only
    the two rows at each place are gathered, never a group."""
    rows = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("__v"))
    ranked = global_rank(rows, [*groups, "__v"], "__r")
    size = ranked.groupBy(*groups).agg(F.min("__r").alias("__first"), F.count(F.lit(1)).alias("n"))
    if groups:
        keys = size.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__first", "n")
        same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
        placed = ranked.join(keys, same).drop(*[f"__g{i}" for i in range(len(groups))])
    else:
        placed = ranked.crossJoin(F.broadcast(size))
    at = F.col("__r") - F.col("__first")
    place = {name: (F.col("n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    wanted = F.lit(False)
    for p in place.values():
        wanted = wanted | (at == F.floor(p)) | (at == F.ceil(p))

    def between(p: Column) -> Column:
        low, high = F.max(F.when(at == F.floor(p), F.col("__v"))), F.max(F.when(at == F.ceil(p), F.col("__v")))
        part = F.max(p - F.floor(p))
        return low + (high - low) * part

    return placed.filter(wanted).groupBy(*groups, "n").agg(*[between(p).alias(name) for name, p in place.items()])
