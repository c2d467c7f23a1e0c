"""The corpus pipeline: five stages over documents, each one operator of riskledger.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskledger.llm import decontaminate, langid, mixing, ngram_join, token_output
from riskledger.llm._common import cut, discard, scratch, table


#: Most texts of a batch between Spark and Python: each task holds some batches, on both sides.
BATCH_TEXTS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session hand on no more than BATCH_TEXTS rows at a time; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_TEXTS:
        spark.conf.set(name, str(BATCH_TEXTS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language explains go, null and empty texts and those without letters
    among them, and all where no document names its language. Repeated rows share their fate;
    very long texts are read whole; other columns stay, whatever their names; an empty table stays empty."""
    small_batches(spark)
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays, the one with the smallest
    doc_id, all its rows if it has several. Documents without words or without a doc_id stay; other
    columns stay; an empty table stays empty."""
    small_batches(spark)
    return ngram_join.keep_one_each(docs, k=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, each row of them. Null and empty texts leak nothing;
    with an empty benchmark all stay; other columns stay; an empty table stays empty."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, from not at all to three times. Null sources are one
    source; rows without words are kept once; ties between blocks go by seeded hash; other columns stay; an
    empty table stays empty."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC, and a digest per row read back from there: (doc_id, start, n_tokens,
    ids_crc32). A null text has the end id alone; null doc_ids come first, repeated rows one after the
    other; an empty table gives no rows."""
    small_batches(spark)
    path = scratch(spark, "tokens")
    token_output.write_tokens(docs, path, token_output.default_tokenizer())
    return token_output.token_digests(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", deduplicate),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: No SQL expresses language models and byte-pair encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; a stage's input goes when its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
