"""Fuzzy company search, code evidence and accident context."""

from __future__ import annotations

from functools import reduce

from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskledger.functions.fuzzy import search_pass
from riskledger.functions.names import code_text, code_tokens, display_name, facility_code, match_key
from riskledger.functions.scores import confidence_label
from riskledger.operators.containment import containing
from riskledger.operators.ranking import written
from riskledger.operators.records import typed


#: Queries that tasks hold at a time, pairs that a task should bound, and most tasks of a search.
QUERIES, PAIRS_A_TASK, MOST_TASKS = 20_000, 20_000_000, 20_000
#: Names that a task cleans.
NAMES_A_TASK = 10_000


def dealt_names(names: DataFrame) -> DataFrame:
    """Names dealt over as many tasks as their number asks for: they are cleaned by many patterns, and their files are so small that one task would read most of them."""
    return names.repartition(min(names.count() // NAMES_A_TASK + 1, MOST_TASKS))


def with_key(names: DataFrame) -> DataFrame:
    """names with their company_key, if they don't have it."""
    return names if "company_key" in names.columns else names.withColumn("company_key", match_key(F.col("raw_name")))


def key_index(names: DataFrame) -> DataFrame:
    """Match keys with the number of names they stand for and one name of each."""
    return with_key(names).filter("company_key != ''").groupBy("company_key").agg(F.count(F.lit(1)).alias("members"), F.min("raw_name").alias("sample"))


def fuzzy_candidates(queries: DataFrame, keys: DataFrame, *, least: float = 0.55, best: int = 500, candidates: Accumulator | None = None) -> DataFrame:
    """For each query key the similar company keys, best first; best is the report's top k.

    At a threshold this low two names need not share any q-gram, nor any word, so no index of either finds
    all. Instead the stated queries, at most QUERIES at a time, go to the tasks, which bound each key's
    similarity by its characters, lengths and words, as matrices, and align only what may reach least. No key is lost; a
    task hands on the best of each batch. candidates counts the pairs that were aligned.
    """
    spark = queries.sparkSession
    asked = written(queries.select("query", match_key(F.col("query")).alias("query_key")).filter("query_key != ''").distinct(), "queries")
    many, found = asked.count(), None
    parts = -(-many // QUERIES) or 1
    known = keys.select("company_key", F.col("members").cast("long").alias("members"))
    # as many tasks as the pairs ask for: the keys alone are small
    dealt = written(known, "keys")
    dealt = dealt.repartition(max(1, min(dealt.count() * many // PAIRS_A_TASK + 1, MOST_TASKS)))
    for i in range(parts):
        part = asked.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == i).orderBy("query").collect()
        shared = spark.sparkContext.broadcast([(r["query"], r["query_key"]) for r in part])
        pairs = dealt.mapInArrow(search_pass(shared, least, best, candidates), "query string, query_key string, company_key string, members long, similarity double")
        found = pairs if found is None else found.unionByName(pairs)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "company_key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= best)


def keyed_facilities(names: DataFrame) -> DataFrame:
    """(company_key, raw_name, parent, code): each name of a company as a facility."""
    raw = F.col("raw_name")
    return with_key(names).select("company_key", "raw_name", display_name(raw).alias("parent"), facility_code(raw).alias("code"))


def grouped_results(candidates: DataFrame, facilities: DataFrame, *, others: int = 4, loose: int = 10) -> DataFrame:
    """R2: parents of each query with how many facilities they have: the top group, the next ones, and unmatched
    single facilities under 0.65. The facilities themselves, of whatever number, are rows: see group_facilities."""
    sizes = facilities.groupBy("company_key").agg(F.count(F.lit(1)).alias("facilities"))
    out = candidates.join(sizes, "company_key").withColumn("confidence", confidence_label(F.col("similarity")))
    unmatched = (F.col("facilities") == 1) & (F.col("similarity") < 0.65)
    w = Window.partitionBy("query", "unmatched").orderBy(F.desc("similarity"), F.desc("facilities"), "company_key")
    out = out.withColumn("unmatched", unmatched).withColumn("place", F.row_number().over(w))
    out = out.filter(F.when(F.col("unmatched"), F.col("place") <= loose).otherwise(F.col("place") <= 1 + others))
    return out.withColumn("tier", F.when(F.col("unmatched"), "unmatched").when(F.col("place") == 1, "top").otherwise("other"))


def group_facilities(groups: DataFrame, facilities: DataFrame) -> DataFrame:
    """R2: a row for each facility of each group that was found."""
    return groups.select("query", "tier", "place", "company_key", "confidence").join(facilities, "company_key")


def code_evidence(questions: DataFrame, inspections: DataFrame, violations: DataFrame, notes: DataFrame, *, rows: int = 20, most_notes: int = 3, snippet: int = 500) -> DataFrame:
    """By question and company the citations that its codes match: totals and the
    newest rows, each with up to most_notes notes on general duty of its inspection, cut to snippet characters.

    notes has (activity_nr, citation_id, narrative). The distinct standards, a bounded code list, are
    matched; citations then join by standard. Only the rows that are shown meet the notes.
    """
    v = typed(violations)
    found = v.join(matched_standards(questions, v), "standard").join(inspections.select("activity_nr", "company_key", "open_date"), "activity_nr")
    totals = found.groupBy("question", "company_key").agg(F.count(F.lit(1)).alias("matched"), F.array_join(F.array_sort(F.collect_set("standard")), ", ").alias("standards"), F.sum("penalty").alias("penalty"))
    w = Window.partitionBy("question", "company_key").orderBy(F.desc("open_date"), "activity_nr", "citation_id", "standard", F.desc("penalty"))
    shown = written(found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= rows), "shown")
    first = notes.join(shown.select("activity_nr").distinct(), "activity_nr", "left_semi").withColumn("__at", F.row_number().over(Window.partitionBy("activity_nr").orderBy("citation_id", "narrative"))).filter(F.col("__at") <= most_notes)
    cut = F.concat(F.substring("narrative", 1, snippet), F.when(F.length("narrative") > snippet, "…").otherwise(""))
    told = first.groupBy("activity_nr").agg(F.array_sort(F.collect_list(F.struct("__at", cut.alias("note")))).alias("__n"))  # at most most_notes
    told = told.select("activity_nr", F.transform("__n", lambda n: n["note"]).alias("__n"))
    shown = shown.join(told, "activity_nr", "left").withColumn("notes", F.coalesce("__n", F.expr("cast(array() as array<string>)")))
    evidence = shown.groupBy("question", "company_key").agg(F.array_sort(F.collect_list(F.struct("place", "open_date", "activity_nr", "citation_id", "standard", "penalty", "notes"))).alias("evidence"))  # at most rows
    return totals.join(evidence, ["question", "company_key"])


def matched_standards(questions: DataFrame, violations: DataFrame) -> DataFrame:
    """Questions with the standards of which one's code text contains the other's, the question's as a whole or by
    one of its tokens. A question without letters or digits matches none. Neither side is broadcast: both meet by grams."""
    codes = written(violations.select("standard").distinct().withColumn("__code", code_text(F.col("standard"))).filter("__code != ''"), "codes")
    asked = questions.select("question", F.explode(F.array_union(F.array(code_text(F.col("question"))), code_tokens(F.col("question")))).alias("__asked")).filter("__asked != ''")
    asked = written(asked.distinct(), "asked")
    inside = containing(codes.select(F.col("__code").alias("text")), asked.select(F.col("__asked").alias("pattern"))).toDF("__code", "__asked")
    around = containing(asked.select(F.col("__asked").alias("text")), codes.select(F.col("__code").alias("pattern"))).toDF("__asked", "__code")
    pairs = inside.unionByName(around).distinct()
    return pairs.join(asked, "__asked").join(codes, "__code").select("question", "standard").distinct()


def nearby_standards(questions: DataFrame, violations: DataFrame, *, most: int = 8, least: int = 4, prefix: int = 6) -> DataFrame:
    """K4: for questions without a match up to most standards that begin like one of their tokens (its first
    prefix characters; tokens of least or more), those of the first such token."""
    missed = questions.join(matched_standards(questions, violations).select("question").distinct(), "question", "left_anti")
    tokens = missed.select("question", F.posexplode(code_tokens(F.col("question"))).alias("place", "token")).filter(F.length("token") >= least)
    tokens = tokens.withColumn("__start", F.substring("token", 1, prefix))
    standards = violations.select("standard").distinct().withColumn("__code", code_text(F.col("standard")))
    starts = standards.select("standard", F.explode(F.array(*[F.substring("__code", 1, n) for n in range(least, prefix + 1)])).alias("__start")).distinct()
    first = starts.join(tokens, "__start").withColumn("__first", F.min("place").over(Window.partitionBy("question"))).filter("place = __first")
    w = Window.partitionBy("question").orderBy("standard")
    return first.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).select("question", "standard")


def tiered_lookup(queries: DataFrame, names: DataFrame, *, least: int = 3) -> DataFrame:
    """For each query the company keys of its best tier: the key itself; keys that, or one of whose
    names, contain it literally; keys of least letters or more that it contains. Empty queries find nothing.
    Queries and names may be of any number: equal keys meet by key, the others by grams."""
    asked = written(queries.filter("query != ''").distinct(), "asked")
    keys = written(names.select("company_key", F.upper("estab_name").alias("__name")).filter("company_key != ''").distinct(), "names")
    own = keys.select("company_key").distinct()
    texts = keys.select("company_key", F.col("__name").alias("text")).unionByName(own.withColumn("text", F.col("company_key")))
    inside = containing(texts.select("text"), asked.select(F.col("query").alias("pattern"))).withColumnRenamed("pattern", "query").join(texts, "text")
    around = containing(asked.select(F.col("query").alias("text")), own.filter(F.length("company_key") >= least).select(F.col("company_key").alias("pattern"))).toDF("query", "company_key")
    same = asked.join(own, F.col("query") == F.col("company_key"))
    tiers = [(same, 1), (inside, 2), (around, 3)]
    found = reduce(DataFrame.unionByName, [df.select("query", "company_key", F.lit(tier).alias("tier")) for df, tier in tiers]).groupBy("query", "company_key").agg(F.min("tier").alias("tier"))
    best = found.groupBy("query").agg(F.min("tier").alias("__best"))
    return found.join(best, "query").filter("tier = __best").drop("__best")


def first_attributes(requests: DataFrame, inspections: DataFrame) -> DataFrame:
    """Place and industry of each request (raw_name, company_key) from the first inspection
    under its name (case apart), else from the first under its key, else empty."""
    fields = ["site_city", "site_state", "site_address", "naics_code"]
    first = lambda key, name: inspections.groupBy(key.alias(name)).agg(F.min_by(F.struct(*fields), F.struct("open_date", "activity_nr")).alias(f"{name}_first"))
    out = requests.withColumn("__n", F.upper(F.trim("raw_name")))
    out = out.join(first(F.upper(F.trim("estab_name")), "__n"), "__n", "left").join(first(F.col("company_key"), "__k"), F.col("company_key") == F.col("__k"), "left")
    got = F.coalesce("__n_first", "__k_first")
    values = {"site_city": F.initcap(F.lower(F.trim(got["site_city"]))), "site_state": F.upper(F.trim(got["site_state"])), "site_address": F.initcap(F.lower(F.trim(got["site_address"]))), "naics_code": F.trim(got["naics_code"])}
    return out.select("raw_name", *[F.coalesce(v, F.lit("")).alias(c) for c, v in values.items()])


def index_state(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """How many distinct non-empty company keys the table and the stored index have, and whether they agree."""
    known = lambda df, name: df.filter("company_key != ''").agg(F.countDistinct("company_key").alias(name))
    return known(keyed, "in_table").crossJoin(known(index, "in_index")).withColumn("fresh", F.col("in_table") == F.col("in_index"))


def rekeyed(stored: DataFrame, rule, ids: list[str]) -> DataFrame:
    """Rows of stored (ids, raw_name, company_key) whose key is another under a new rule, with both keys."""
    new = stored.select(*ids, "raw_name", rule(F.col("raw_name")).alias("company_key"))
    moved = new.join(stored, [*ids, "raw_name", "company_key"], "left_anti")
    return moved.withColumnRenamed("company_key", "new_key").join(stored.select(*ids, F.col("company_key").alias("old_key")), ids).select(*ids, "old_key", "new_key")
