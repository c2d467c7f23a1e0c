"""The corpus pipeline over small tables, its stages against brute force."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from riskledger.llm import mixing, token_output
from tests.llm.test_operators import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, parts, n):
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two languages, near copies, exact copies, leaks, noise, texts without letters, nulls, a repeated row."""
    r = random.Random(5)
    kinds = {"xx": ["ka", "to", "mi", "re", "su"], "yy": ["schu", "ber", "ung", "ö", "lin"]}
    rows = [(i, prose(r, kinds["xx" if i % 2 else "yy"], r.randint(20, 120)), "xx" if i % 2 else "yy", "abc"[i % 3], 1) for i in range(240)]
    items = [(i, prose(r, kinds["xx"], 30)) for i in range(6)]
    next_id = lambda: len(rows)
    for i in range(0, 40, 4):
        near = rows[i][1].split()
        near[len(near) // 2] = "kami"
        rows.append((next_id(), " ".join(near), rows[i][2], "b", 1))
        rows.append((next_id(), rows[i + 1][1], rows[i + 1][2], None, 1))
    for i, item in items[:4]:
        rows.append((next_id(), f"{prose(r, kinds['xx'], 15)} {item} {prose(r, kinds['xx'], 10)}", "xx", "a", 1))
    for _ in range(8):
        rows.append((next_id(), "".join(r.choice("abdeghiklmnorstu ") for _ in range(300)), None, "a", 1))
    rows += [(next_id(), None, "xx", "a", 1), (next_id() + 1, "12 34 !!", None, "a", 1), rows[77]]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_against_brute_force(spark, tables):
    from tokenizers import Tokenizer

    path, rows, items = tables
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{path}/documents.parquet")
    columns, got = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        got[name] = docs
        assert name == list(stages)[-1] or docs.columns == columns
    ids = lambda name: sorted(x.doc_id for x in got[name].collect())
    clean = sorted(i for i, t, lang, *_ in rows if lang and t)
    assert ids("language_id") == clean
    text = {i: t for i, t, *_ in rows}
    sets = {i: shingles(text[i], 5) for i in set(clean)}
    group = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    single = [i for i in clean if group[i] == i]
    assert ids("ngram_jaccard_join") == single and len(single) < len(clean) - 12
    leaks = {i for i in single for _, item in items if item in text[i]}
    assert ids("decontamination") == [i for i in single if i not in leaks] and len(leaks) == 4
    kept = got["decontamination"].withColumn("size", mixing.F.regexp_count("text", mixing.F.lit(mixing.WORD)))
    times = {}
    for x in mixing.mix(kept, size="size").collect():
        times[x.doc_id] = times.get(x.doc_id, 0) + int(x["__taken"] / x["size"] + 0.5)
    assert ids("mixing") == sorted(i for i, n in times.items() for _ in range(n)) and max(times.values()) <= 6
    tokenizer, start = Tokenizer.from_file(token_output.default_tokenizer()), 0
    digests = got["token_output"].orderBy("start").collect()
    assert [x.doc_id for x in digests] == ids("mixing")
    for x in digests:
        tokens = tokenizer.encode(text[x.doc_id], add_special_tokens=False).ids + [0]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)
    whole = sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in corpus_pipeline.run(spark, path).collect())
    assert whole == sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in digests)


def test_empty_tables_and_more_columns(spark, tables, tmp_path):
    path, rows, _ = tables
    empty = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    clash = spark.createDataFrame(rows[:30], SCHEMA)
    for name in ("__language", "row", "component_id", "text_hash", "__taken", "held", "n"):
        clash = clash.withColumn(name, mixing.F.lit(name))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, empty)
        assert out.columns == clash.columns and all(x["__language"] == "__language" and x["row"] == "row" and x["__taken"] == "__taken" for x in out.collect()), name
