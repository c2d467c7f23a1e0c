"""Operator 6, line dedup by winnowing over word grams.

Every word starts a gram of GRAM words, whatever the lines it lies in. Of every WINDOW
neighbouring grams of a text the one with the smallest hash is kept (the rightmost of
equals), so any run of 50 repeated words holds a kept gram wherever it starts. Kept grams
meet their first occurrence over all documents, each match is extended word by word both
ways, and the later run is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskledger.llm._common import cut, lookup, table
from riskledger.llm._words import Words, inverse_powers, mix, powers, slices, word_hashes

#: GRAM + WINDOW - 1 <= 50: WINDOW grams start and end inside any run of 50 words.
GRAM, WINDOW = 35, 16
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of the filter that spares rows a shuffle: 1,024 rows of 32,768 bits, whatever the input.
SIEVE_BITS = 1 << 25


def kept_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word at which each kept gram starts, and its hash. A text with fewer than WINDOW grams keeps the smallest."""
    n = w.hash.size
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * powers(n), dtype=np.uint64)])
    at = np.arange(n - GRAM + 1)
    valid = np.concatenate([w.row[at] == w.row[at + GRAM - 1], np.zeros(GRAM - 1, bool)])
    g = np.full(n, _NONE)
    g[at] = np.minimum(mix((total[GRAM:] - total[at]) * inverse_powers(n)[at]), _NONE - np.uint64(1))
    g[~valid] = _NONE
    # the smallest of 2, 4, 8 and 16 grams from each place on; after a text's last gram come GRAM - 1 places without one
    best, least, step = np.arange(n), g, 1
    while step < WINDOW:
        right = least[step:] <= least[:-step]
        best, least = np.where(right, best[step:], best[:-step]), np.where(right, least[step:], least[:-step])
        step *= 2
    starts = at[: best.size]
    full = valid[starts + WINDOW - 1] & (w.row[starts] == w.row[starts + WINDOW - 1])
    first = np.concatenate([[True], w.row[starts[1:]] != w.row[starts[:-1]]])
    kept = np.unique(best[starts[valid[starts] & (full | first)]])
    return kept, g[kept]


def packed(h: np.ndarray) -> bytes:
    """Words as 32 bits of their hashes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress((h >> np.uint64(32)).astype(np.uint32).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint32)


def lists(values: np.ndarray, row: np.ndarray, n: int, kind) -> pa.ListArray:
    ends = np.cumsum(np.bincount(row, minlength=n)) if n else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(kind)))


def grams_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            n = batch.num_rows
            w = word_hashes(batch["text"])
            at, g = kept_grams(w)
            first = np.concatenate([[0], np.cumsum(np.bincount(w.row, minlength=n))])
            own = pa.array([packed(w.hash[a:b]) for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], own, lists(at - first[w.row[at]], w.row[at], n, np.int32), lists(g, w.row[at], n, np.int64)], ["doc_id", "key", "words", "at", "gram"])


def runs_of(own: np.ndarray, other: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of own's words that equal the other's, around each seed (place in own, place in other)."""
    found: list[tuple[int, int]] = []
    reach: dict[int, int] = {}
    for a, b in sorted(seeds):
        if a < reach.get(a - b, 0) or a + GRAM > own.size or b + GRAM > other.size:
            continue
        after, before = min(own.size - a, other.size - b), min(a, b)
        if found and found[-1][0] <= a - before and a + after <= found[-1][1]:
            continue  # whatever it is extended to is deleted already
        differ = np.flatnonzero(own[a : a + after] != other[b : b + after])
        end = a + (int(differ[0]) if differ.size else after)
        if end < a + GRAM:
            continue
        differ = np.flatnonzero(own[a - before : a] != other[b - before : b])
        start = a - before + (int(differ[-1]) + 1 if differ.size else 0)
        reach[a - b] = end
        found.append((start, end))
    return found


def extend(batches):
    """Runs of the document's words that equal the other's, by document."""
    import pandas as pd

    for pdf in batches:
        rows = [(key, *run) for key, own, other, seeds in zip(pdf["key"], pdf["words"], pdf["others"], pdf["seeds"]) for run in runs_of(unpacked(own), unpacked(other), [(int(s["at"]), int(s["from"])) for s in seeds])]
        yield pd.DataFrame(rows, columns=["key", "start", "end"]).astype({"key": "int64", "start": "int32", "end": "int32"})


def without(own: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """A text without the words that are gone, each run with the white space after it; where
    a run began inside a line that it ends, the white space before it goes instead."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    parts, last = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        inside = a > 0 and b < start.size and b"\n" not in own[end[a - 1] : start[a]] and b"\n" in own[end[b - 1] : start[b]]
        parts.append(own[last : end[a - 1] if inside else start[a]])
        last = end[b - 1] if inside else start[b] if b < start.size else len(own)
    return b"".join([*parts, own[last:]])


def delete_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            texts, removed = batch["text"].to_pylist(), [0] * batch.num_rows
            touched = [i for i, runs in enumerate(batch["runs"].to_pylist()) if runs and texts[i]]
            some = batch["text"].take(pa.array(touched, pa.int64()))
            runs = batch["runs"].take(pa.array(touched, pa.int64())).to_pylist()
            w = word_hashes(some)
            first = np.searchsorted(w.row, np.arange(len(touched) + 1))
            byte = 0
            for j, i in enumerate(touched):
                own, at = texts[i].encode(), slice(first[j], first[j + 1])
                gone = np.zeros(first[j + 1] - first[j], bool)
                for r in runs[j]:
                    gone[r["start"] : r["end"]] = True
                texts[i], removed[i] = without(own, w.start[at] - byte, w.end[at] - byte, gone).decode(), int(gone.sum())
                byte += len(own)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "removed_words"])


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows with __maybe: true for all whose key is in wanted (and few others), by a broadcast bitmap of hashes."""
    bit = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    part, place = F.floor(bit / 32768).cast("int"), (bit % 32768).cast("long")
    bits = wanted.select(part.alias("__part"), place.alias("__place")).groupBy("__part").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    out = rows.withColumn("__part", part).withColumn("__place", place).join(F.broadcast(bits), "__part", "left")
    set_bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("__place") % 8)), F.lit(2)) == 1
    return out.withColumn("__maybe", F.coalesce(set_bit, F.lit(False))).drop("__part", "__place", "__bits")


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed_words): texts without the runs that came before, very long texts whole.

    Order is by doc_id, then place. Every run of 50 words or more that an
    earlier place has is found, wherever it starts and however its lines break, and shorter ones from
    35 words where their gram was kept; case of A-Z and kinds of white space do not count. All its kept
    grams are deleted; up to 15 words at an end stay where the gram there came first in another place that does not go on alike. What is deleted anywhere is kept where it came first. Null
    texts stay null, empty ones empty; rows with a null doc_id neither lose text nor
    count as earlier; equal rows lose the same. An empty table stays empty. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    own = cut(docs.filter("doc_id is not null and text is not null").mapInArrow(grams_pass, "doc_id long, key long, words binary, at array<int>, gram array<long>"), "lines-words")
    marks = own.select("doc_id", "key", F.explode(F.arrays_zip("at", "gram")).alias("m")).select("doc_id", "key", "m.at", "m.gram")
    # the first place of each gram, as one number that hash aggregation can hold
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("at")).cast("decimal(35,0)")
    firsts = marks.groupBy("gram").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = cut(firsts, "lines-firsts")
    seeds = lookup(marks, firsts, "gram", "n").filter(F.col("place") < place)
    there = F.floor(F.col("place") / F.lit(1 << 31).cast("decimal(12,0)"))
    seeds = seeds.select("key", there.cast("long").alias("from_id"), "at", (F.col("place") - there * F.lit(1 << 31).cast("decimal(12,0)")).cast("int").alias("from"))
    seeds = cut(seeds.groupBy("key", "from_id").agg(F.collect_set(F.struct("at", "from")).alias("seeds")), "lines-seeds")
    mine = sieved(own.select("key", "words"), "key", seeds).filter("__maybe").drop("__maybe")
    others = sieved(own.select(F.col("doc_id").alias("from_id"), F.col("words").alias("others")), "from_id", seeds).filter("__maybe").drop("__maybe")
    # a document whose passage most others repeat goes to them by broadcast
    asked = seeds.groupBy("from_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = lookup(seeds.join(mine, "key"), others.groupBy("from_id").agg(F.collect_set("others").alias("others")).join(asked, "from_id"), "from_id", "n", total=seeds.count(), hot_keys=64)
    runs = pairs.select("key", "words", F.explode("others").alias("others"), "seeds").mapInPandas(extend, "key long, start int, end int")
    runs = cut(runs.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("runs")), "lines-runs")
    docs = sieved(docs, "key", runs)
    touched = docs.filter("__maybe").join(runs, "key", "left").select("doc_id", "text", "runs")
    whole = docs.filter("not __maybe").select("doc_id", "text", F.lit(0).cast("long").alias("removed_words"))
    return whole.unionByName(touched.mapInArrow(delete_pass, "doc_id long, text string, removed_words long"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(table(spark, sf_dir, "documents"))
