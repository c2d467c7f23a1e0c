"""Which texts contain which patterns, literally, over an inverted index of grams: no text meets a pattern that can't match.

A text that contains a pattern has each gram of the pattern. So a pattern needs to meet only the texts that have one of its
grams, and it takes the one that the fewest texts have; both sides meet by that gram, and what meets is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.operators.ranking import written

#: Characters of a gram; a shorter pattern is its own gram.
GRAM = 4


def grams(text: Column, n: Column) -> Column:
    """The distinct grams of n characters; none of a shorter text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, n)))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct pairs (text, pattern) of the texts and patterns (one column each of those names) where the text has
    the pattern in it. Nulls and empty patterns are in no text. Both sides may be of any size."""
    wanted = written(patterns.filter("pattern != ''").distinct().withColumn("__n", F.least(F.length("pattern"), F.lit(GRAM))), "patterns")
    sizes = sorted(r[0] for r in wanted.select("__n").distinct().collect())  # at most GRAM numbers
    if not sizes:
        return texts.select("text", F.col("text").alias("pattern")).limit(0)
    every = texts.filter(F.length("text") >= sizes[0]).distinct().withColumn("__n", F.explode(F.array(*[F.lit(n) for n in sizes])))
    index = written(every.select("text", F.explode(grams(F.col("text"), F.col("__n"))).alias("gram")), "grams")
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # a gram that no text has drops its pattern here only if it is the pattern's rarest; then none has the pattern
    own = wanted.select("pattern", F.explode(grams(F.col("pattern"), F.col("__n"))).alias("gram"))
    rarest = own.join(often, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("least"))
    keyed = rarest.filter("least.often > 0").select("pattern", F.col("least.gram").alias("gram"))
    return index.join(keyed, "gram").filter(F.col("text").contains(F.col("pattern"))).select("text", "pattern")
