"""Operator 8, token-id output: ORC files in ascending doc_id order.

Spark deals the documents into ranges of doc_id, sorts each range, encodes it in
Arrow batches and writes ORC: stripes that readers take in parallel, run-length
encoded ids, a row index, and a Bloom filter on doc_id, so that readers which look for
some documents skip stripes by metadata.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskledger.llm._common import scratch, table
from riskledger.llm._words import SPACES, inverse_powers, mix, running_hash, slices, trim

ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "part int, start_in_part long, doc_id long, n_tokens long, ids array<int>"
#: White space beyond ASCII before other white space: a tokenizer may take both as one, so such texts are encoded whole.
_WIDE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \t-\r]")
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalpha()]] = True
#: Texts with longer pieces are encoded whole.
LONGEST_HASHED = 64
_encoders: dict[tuple[str, int], Pieces] = {}


def pieces(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where texts are cut into pieces whose ids never depend on their neighbours: before
    white space that follows anything else, and between a letter and a sign or digit. A byte-level
    BPE always cuts there. Gives each piece's hash, row, first byte and byte after the last, in raw."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = raw.size
    space, letter = SPACES[raw], _LETTER[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    first[1:] |= (space[1:] & ~space[:-1]) | (letter[:-1] & _SIGN[raw[1:]])
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)[: start.size]
    total = running_hash(raw)
    h = mix((total[end] - total[start]) * inverse_powers(n)[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(offsets, start, "right") - 1, start, end, raw


class Pieces:
    """Encodes texts by their distinct pieces, for which 64-bit hashes stand: each batch looks its own up, and the tokenizers library encodes those that are
    not known. Most known pieces are held; beyond that, the half that was met most often stays."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch, self.model, self.most = tokenizer.encode_batch_fast, tokenizer.model, most
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in "\u0120\u010a"]] = True  # how byte-level vocabularies write space and line end
        self.hash, self.at, self.size, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.direct = [x.id for x in self.model.tokenize("\u0120words")] == self.whole([" words"])[0].tolist()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.encode_batch(texts, add_special_tokens=False)]

    def encode(self, found: list[bytes]) -> list[list[int]]:
        """Ids of pieces. Letters, with or without a space before them, are one unit of the
        byte-level BPE and go to its model itself. Other pieces that begin with one space or line
        end are encoded in one call, joined: the ids of each begin at a token that begins with one.
        The rest is encoded in a batch."""
        units = [p.decode().replace(" ", "\u0120") if self.direct and p.removeprefix(b" ").isalpha() else None for p in found]
        tokenize = self.model.tokenize
        out = [[x.id for x in tokenize(u)] if u else [] for u in units]
        left = [i for i, u in enumerate(units) if not u]
        single = lambda p: p[0] in b" \n" and len(p) > 1 and p[1] not in b" \n\t\r\x0b\x0c"
        plain, other = [i for i in left if single(found[i])], [i for i in left if not single(found[i])]
        ids = self.whole([b"".join([found[i] for i in plain]).decode()])[0] if plain else np.zeros(0, np.int32)
        starts = np.flatnonzero(self.begins[ids]).tolist()
        if len(starts) == len(plain):
            ids = ids.tolist()
            for i, a, b in zip(plain, starts, [*starts[1:], len(ids)]):
                out[i] = ids[a:b]
        else:
            other += plain
        for i, x in zip(other, self.whole([found[i].decode() for i in other])):
            out[i] = x.tolist()
        return out

    def learn(self, h: np.ndarray, found: list[bytes], needed: np.ndarray) -> None:
        """Make the pieces known; h is sorted and holds no known hash. The known ones at needed stay known."""
        ids = self.encode(found)
        if self.hash.size + h.size > self.most and self.hash.size:
            often = np.argsort(-self.met, kind="stable")[: max(self.most // 2 - h.size, 0)]
            keep = np.union1d(often, needed)
            held = self.gather(self.at[keep], self.size[keep])
            self.hash, self.size, self.met = self.hash[keep], self.size[keep], self.met[keep] // 2
            self.at, self.ids = np.cumsum(self.size) - self.size, held
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        to = np.searchsorted(self.hash, h)
        self.hash, self.size, self.met = np.insert(self.hash, to, h), np.insert(self.size, to, size), np.insert(self.met, to, 0)
        self.at = np.insert(self.at, to, self.ids.size + np.cumsum(size) - size)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])

    def gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The runs of ids of these lengths at these places, one after the other."""
        ends = np.cumsum(size)
        return self.ids[np.repeat(at - ends + size, size) + np.arange(ends[-1] if ends.size else 0)]

    def texts(self, text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(text, "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").fill_null(False)
        odd = np.array([bool(o) and _WIDE.search(t) is not None for o, t in zip(odd.to_pylist(), text.to_pylist())]) if pc.any(odd).as_py() else np.zeros(len(text), bool)
        for token in self.added:
            odd |= pc.match_substring(text, token).fill_null(False).to_numpy(zero_copy_only=False)
        h, row, start, end, raw = pieces(text)
        words, first, at = np.unique(h, return_index=True, return_inverse=True)
        short = (end - start)[first] <= LONGEST_HASHED
        to = np.minimum(np.searchsorted(self.hash, words), max(self.hash.size - 1, 0))
        hit = self.hash[to] == words if self.hash.size else np.zeros(words.size, bool)
        new = np.flatnonzero(short & ~hit)
        if new.size:
            data = raw.tobytes()
            self.learn(words[new], [data[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())], to[hit])
            to = np.searchsorted(self.hash, words)
        to = np.minimum(to, max(self.hash.size - 1, 0))
        self.met[to[short]] += 1
        size, place = self.size[to][at] if words.size else at, self.at[to][at] if words.size else at
        ids = self.gather(place, size)
        count = np.bincount(row, size, len(text)).astype(np.int64)
        odd[row[end - start > LONGEST_HASHED]] = True  # an odd text is encoded as a whole
        if odd.any():
            ends = np.cumsum(count)
            parts = [ids[e - c : e] for e, c in zip(ends.tolist(), count.tolist())]
            rows = np.flatnonzero(odd).tolist()
            for r, x in zip(rows, self.whole([text[r].as_py() or "" for r in rows])):
                parts[r], count[r] = x, x.size
            ids = np.concatenate(parts)
        return ids, count


def encode_partition(path: str, end_id: int, cache_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, cache_pieces) not in _encoders:
            _encoders[path, cache_pieces] = Pieces(path, cache_pieces)
        encoder, start = _encoders[path, cache_pieces], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, count = encoder.texts(batch["text"])
                ends = np.cumsum(count)
                ids = np.insert(ids, ends, end_id)
                sizes = count + 1
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch["part"], pa.array(start + ends - sizes), batch["doc_id"], pa.array(sizes), lists], ["part", "start_in_part", "doc_id", "n_tokens", "ids"])
                start += int(ends[-1])
                trim()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 0, cache_pieces: int = 300_000) -> None:
    """Encode docs (doc_id, text; other columns are not read) and write them.

    Each file holds a range of doc_id in ascending order (null ids first, equal
    ids by text, nulls first), in which part ascends over the files. A null text
    has only the end id. Repeated rows are written each; an empty table gives no rows.
    """
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.withColumn("part", F.spark_partition_id()).mapInArrow(encode_partition(tokenizer_path, end_id, cache_pieces), SCHEMA).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_tokens' files with start, the ids of all documents
    before each. The only broadcast table has one row per written file."""
    files = spark.read.schema(SCHEMA).orc(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("__ids"))
    before = F.expr("coalesce(sum(__ids) over (order by part rows between unbounded preceding and 1 preceding), 0)")
    parts = parts.select(F.col("part").alias("__part"), before.alias("__before"))
    return files.join(F.broadcast(parts), files["part"] == F.col("__part")).withColumn("start", F.col("__before") + F.col("start_in_part")).drop("__part", "__before")


@F.pandas_udf(T.LongType())
def ids_crc32(ids):
    import pandas as pd

    return pd.Series([zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in ids], dtype="int64")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path or default_tokenizer())
    return token_digests(spark, path)
