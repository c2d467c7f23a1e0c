"""Operator 5, language-model scoring by a hierarchical Pitman-Yor model.

The previous word is the context: its restaurant has the training tokens after it as
customers. Contexts are buckets of words, about one for each thousand tokens of a bucket's
class (a word's last two bytes), so they grow with the input; the buckets of a class share a
parent restaurant, and the classes share a root over the vocabulary and one unknown word. Gibbs sweeps
draw the tables of every (word, context) from their conditional distribution given all other
tables; a text's score uses predictive probabilities averaged over the last sweeps.

Texts are cut into blocks of tokens. A block's words go once to the slice of
the vocabulary that owns them, with their counts by context; slices hold whole words,
so a sweep runs slice by slice, and only the restaurants' totals (two numbers for
each context) are summed up in between, by ranges of contexts: in a sweep, slices see each other's tables as of the sweep
before. Then each slice answers each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskledger.llm._common import cut, table
from riskledger.llm._words import mix, slices, trim, word_hashes
from riskledger.llm.langid import is_held_out

CLASSES = 256
BLOCK_TOKENS = 2_000_000
#: Documents for each bucket that a class gets, however many; contexts whose totals are summed in one group.
DOCS_PER_BUCKET, RANGE = 1000, 1 << 17
#: Strength and discount of contexts, classes and root.
THETA, DISCOUNT = (20.0, 20.0, 10.0), (0.8, 0.7, 0.5)
SWEEPS, AVERAGED = 3, 2
#: Tables of up to so many customers are drawn exactly; of more, the rest sits down in turn.
EXACT = 32
END = np.uint64(0x1BADB002CAFEF00D)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; the bytes of each are laid out plane by plane."""
    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.num, a.size)]], np.int64).tobytes()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(a.size, -1).T.tobytes() if a.size else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


_KINDS = {np.dtype(k).num: np.dtype(k) for k in ("u1", "u2", "u4", "u8", "i4", "i8", "f4", "f8")}


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)[1:].reshape(n, 2).tolist()
    at, out = 8 * (1 + 2 * n), []
    for num, size in head:
        kind = _KINDS[num]
        plane = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind) if size else np.zeros(0, kind))
        at += size * kind.itemsize
    return out


def tokens(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens (words, and one end per text): hash, class as a context (1 to 255), row."""
    w = word_hashes(text)
    n = len(text)
    count = np.bincount(w.row, minlength=n) if w.row.size else np.zeros(n, np.int64)
    place = np.arange(w.hash.size) + w.row
    total = w.hash.size + n
    h, row = np.full(total, END), np.repeat(np.arange(n), count + 1)
    h[place] = np.where(w.hash == END, w.hash + np.uint64(1), w.hash)
    lower = w.raw | np.where((w.raw >= 65) & (w.raw <= 90), 32, 0).astype(np.uint8) if w.raw.size else w.raw
    last = lower[w.end - 1].astype(np.uint64) if w.hash.size else w.hash
    but = np.where(w.end - 2 >= w.start, lower[w.end - 2], 0).astype(np.uint64) if w.hash.size else w.hash
    own = np.ones(total, np.uint8)
    own[place] = (1 + mix(last * np.uint64(256) + but) % np.uint64(CLASSES - 1)).astype(np.uint8)
    return h, own, row


def block_pass(n_slices: int, buckets: int):
    """Rows (kind, block, slice, data): per block one with its documents' tokens, each the
    number of its (word, context) pair, and one for each slice of the vocabulary with the block's words and
    the contexts and counts of their pairs. Pairs are numbered by slice, word and context."""

    def close(block: int, held: list) -> Iterator[tuple]:
        h, own, ids, nulls, out, size = (np.concatenate(x) for x in zip(*held))
        words, first, local = np.unique(h, return_index=True, return_inverse=True)
        follows = own[first].astype(np.int64) * buckets + (mix(words) % np.uint64(buckets)).astype(np.int64)
        context = np.concatenate([np.zeros(1, np.int64), follows[local[:-1]]])
        context[np.concatenate([[0], np.cumsum(size)[:-1]])] = 0  # a text's first token follows nothing
        owner = (words % np.uint64(n_slices)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        rank = np.empty(order.size, np.int64)
        rank[order] = np.arange(order.size)
        pairs, at = np.unique(rank[local] * (CLASSES * buckets) + context, return_inverse=True)
        counts = np.bincount(at, np.repeat(~out, size), pairs.size).astype(np.uint32)
        of_word = np.bincount(pairs // (CLASSES * buckets), minlength=words.size).astype(np.uint32)
        context = (pairs % (CLASSES * buckets)).astype(np.uint32)
        words, ends = words[order], np.searchsorted(owner[order], np.arange(n_slices + 1))
        p_ends = np.concatenate([[0], np.cumsum(of_word, dtype=np.int64)]).astype(np.int64)[ends]
        yield False, block, -1, pack(ids, nulls, out.astype(np.uint8), size.astype(np.int64), at.astype(np.uint32), of_word)
        for s in range(n_slices):
            a, b, c, d = ends[s], ends[s + 1], p_ends[s], p_ends[s + 1]
            if b > a:
                yield True, block, s, pack(words[a:b], np.array([a, c], np.int64), of_word[a:b], context[c:d], counts[c:d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def rows(found) -> pa.RecordBatch:
            kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], ["words", "block", "slice", "data"])

        for whole in batches:
            for batch in slices(whole, "text"):
                h, own, row = tokens(batch["text"])
                ids, out = batch["doc_id"], batch["held_out"].to_numpy(zero_copy_only=False).astype(bool)
                held.append((h, own, ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()).astype(np.uint8), out, np.bincount(row, minlength=batch.num_rows)))
                n += h.size
                if n >= BLOCK_TOKENS:
                    yield rows(list(close((task << 32) + number, held)))
                    number, held, n = number + 1, [], 0
        if held:
            yield rows(list(close((task << 32) + number, held)))
        trim()

    return run


def merge_pass(buckets: int):
    """One slice's words over all blocks: their (word, context) pairs met in training with
    counts, ordered, and for each block which words and contexts it asks for."""

    def merge(pdf):
        import pandas as pd

        got = [unpack(d) for d in pdf["data"]]
        words, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        ends = np.cumsum([0, *[g[0].size for g in got]])
        where = [at[a:b] for a, b in zip(ends, ends[1:])]
        key = np.concatenate([np.repeat(w, g[2]) * (CLASSES * buckets) + g[3] for w, g in zip(where, got)])
        pairs, slot = np.unique(key, return_inverse=True)
        count = np.bincount(slot, np.concatenate([g[4] for g in got]), pairs.size).astype(np.int64)
        pairs, count = pairs[count > 0], count[count > 0]
        word, context = pairs // (CLASSES * buckets), pairs % (CLASSES * buckets)
        asked = [pack(w.astype(np.uint32), *g[1:4]) for w, g in zip(where, got)]
        known = int((np.bincount(word, minlength=words.size) > 0).sum())
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "n_words": [words.size], "known": [known], "tokens": [int(count.sum())], "pairs": [pack(word.astype(np.uint32), context.astype(np.uint32), count)], "blocks": [pdf["block"].tolist()], "asked": [asked]})

    return merge


# ---- seating ----------------------------------------------------------------------------
_stirling: dict[float, np.ndarray] = {}


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways for n customers to sit at t tables, weighted."""
    if discount not in _stirling:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[1, 1] = 0.0
        for n in range(1, EXACT):
            t = np.arange(1, n + 2)
            with np.errstate(divide="ignore"):
                s[n + 1, t] = np.logaddexp(s[n, t - 1], np.log(np.maximum(n - t * discount, 0)) + s[n, t])
        _stirling[discount] = s
    return _stirling[discount]


def draw_tables(rng, count: np.ndarray, others: np.ndarray, base: np.ndarray, theta: float, discount: float) -> np.ndarray:
    """Tables of count customers of a dish whose restaurant has others tables besides: t with
    a weight of Stirling(count, t) * product of (theta + discount * (others + j)) for j < t * base^t,
    base being the parent's probability of the dish. Beyond EXACT customers the rest sits down
    one by one, later in runs of a sixteenth of those seated."""
    tables = np.minimum(count, 1).astype(np.float64)
    few = np.minimum(count, EXACT).astype(np.int64)
    order = np.argsort(few, kind="stable")
    starts = np.searchsorted(few[order], np.arange(2, EXACT + 2))
    for n, (a, b) in enumerate(zip(starts, starts[1:]), 2):
        for at in range(a, b, 200_000):
            rows = order[at : min(at + 200_000, b)]
            t = np.arange(1, n + 1)
            weight = np.cumsum(np.log(theta + discount * (others[rows, None] + t - 1)), axis=1) + t * np.log(np.maximum(base[rows, None], 1e-300)) + log_stirling(discount)[n, 1 : n + 1]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            tables[rows] = 1 + (weight < rng.random((rows.size, 1)) * weight[:, -1:]).sum(1)
    seated, todo = few.astype(np.float64), np.flatnonzero(count > EXACT)
    while todo.size:
        s, t = seated[todo], tables[todo]
        step = np.minimum(count[todo] - s, np.maximum(np.floor(s / 16), 1))
        new = (theta + discount * (others[todo] + t)) * base[todo]
        tables[todo] += rng.binomial(step.astype(np.int64), np.clip(new / (new + np.maximum(s - discount * t, 1e-9)), 0, 1))
        seated[todo] += step
        todo = todo[seated[todo] < count[todo]]
    return np.minimum(tables, count)


@dataclass
class Totals:
    """Over all slices: tables of each context and class, and tables and customers at the root."""

    contexts: np.ndarray
    classes: np.ndarray
    root: float
    vocabulary: int

    @cached_property
    def class_customers(self) -> np.ndarray:
        return self.contexts.reshape(CLASSES, -1).sum(1)


class Slice:
    """The pairs of a slice of the vocabulary, and the seats of their customers at three levels."""

    def __init__(self, slice_id: int, n_words: int, pairs: bytes, buckets: int):
        self.id, self.n_words, self.buckets = slice_id, n_words, buckets
        self.word, self.context, self.count = unpack(pairs)
        self.word, self.context = self.word.astype(np.int64), self.context.astype(np.int64)
        self.kind, self.at = np.unique(self.word * CLASSES + self.context // buckets, return_inverse=True)
        self.kind_word, self.kind_class = self.kind // CLASSES, self.kind % CLASSES
        # to begin with a table for each dish everywhere
        self.t, self.s = np.ones(self.word.size), np.ones(self.kind.size)
        self.r = (np.bincount(self.word, minlength=n_words) > 0).astype(np.float64)

    def customers(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the dishes of classes and root: the tables below."""
        return np.bincount(self.at, self.t, self.kind.size), np.bincount(self.kind_word, self.s, self.n_words)

    def own_totals(self, others: tuple | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """Tables of contexts, classes and root, on top of others'."""
        contexts, classes, root = others or (np.zeros(CLASSES * self.buckets), np.zeros(CLASSES), 0.0)
        np.add.at(contexts, self.context, self.t)
        np.add.at(classes, self.kind_class, self.s)
        return contexts, classes, root + float(self.r.sum())

    def sweep(self, number: int, totals: Totals) -> None:
        """Draw all tables anew, each level given the totals of the sweep before without its own."""
        rng = np.random.default_rng([number, self.id])
        below, at_root = self.customers()
        root = root_probability(at_root, self.r, totals)
        up = (THETA[1] + DISCOUNT[1] * totals.classes[self.kind_class]) * root[self.kind_word]
        c, s, everyone = below[self.at], self.s[self.at], totals.class_customers[self.kind_class][self.at]
        left = c - self.t
        tables = np.where(left > 0, np.minimum(s, left), 0)
        parent = (np.maximum(left - DISCOUNT[1] * tables, 0) + up[self.at]) / (THETA[1] + np.maximum(everyone - self.t, 0))
        self.t = draw_tables(rng, self.count, np.maximum(totals.contexts[self.context] - self.t, 0), parent, THETA[0], DISCOUNT[0])
        below, _ = self.customers()
        rest = np.maximum(at_root[self.kind_word] - self.s, 0)
        tables = np.where(rest > 0, np.minimum(self.r[self.kind_word], rest), 0)
        flat = (THETA[2] + DISCOUNT[2] * totals.root) / (totals.vocabulary + 1)
        root = (np.maximum(rest - DISCOUNT[2] * tables, 0) + flat) / (THETA[2] + np.maximum(totals.classes.sum() - self.s, 0))
        self.s = draw_tables(rng, below, np.maximum(totals.classes[self.kind_class] - self.s, 0), root, THETA[1], DISCOUNT[1])
        _, at_root = self.customers()
        uniform = np.full(self.n_words, 1 / (totals.vocabulary + 1))
        self.r = draw_tables(rng, at_root, np.maximum(totals.root - self.r, 0), uniform, THETA[2], DISCOUNT[2])

    def view(self, after: Totals, seats: np.ndarray) -> View:
        below, at_root = self.customers()
        own = self.word * (CLASSES * self.buckets) + self.context
        values = self.count - DISCOUNT[0] * self.t, below - DISCOUNT[1] * self.s, root_probability(at_root, self.r, after)
        return View(self.buckets, own, self.kind, *(v.astype(np.float32) for v in values[:2]), values[2], after, seats)


@dataclass
class View:
    """What a slice needs of a state to answer: shares of its pairs and of its classes' dishes, and the root's probabilities."""

    buckets: int
    pairs: np.ndarray
    kinds: np.ndarray
    own: np.ndarray
    share: np.ndarray
    root: np.ndarray
    after: Totals
    seats: np.ndarray

    def probability(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Predictive probability of words after contexts."""
        k = context // self.buckets
        parent = (found(self.kinds, word * CLASSES + k, self.share) + (THETA[1] + DISCOUNT[1] * self.after.classes[k]) * self.root[word]) / (THETA[1] + self.after.class_customers[k])
        own = found(self.pairs, word * (CLASSES * self.buckets) + context, self.own)
        return (own + (THETA[0] + DISCOUNT[0] * self.after.contexts[context]) * parent) / (THETA[0] + self.seats[context])


def root_probability(customers: np.ndarray, tables: np.ndarray, totals: Totals) -> np.ndarray:
    flat = (THETA[2] + DISCOUNT[2] * totals.root) / (totals.vocabulary + 1)
    return (np.maximum(customers - DISCOUNT[2] * tables, 0) + flat) / (THETA[2] + totals.classes.sum())


def found(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of wanted among the sorted keys, 0 where they are missing."""
    if not keys.size:
        return np.zeros(wanted.size)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def restored(row: tuple, buckets: int, history: list[Totals]) -> Slice:
    """A slice after the sweeps of history, which seeds make the same each time: slices keep no state between jobs."""
    out = Slice(row[0], row[1], row[2], buckets)
    for number, totals in enumerate(history):
        out.sweep(number, totals)
    return out


def totals_pass(buckets: int, history):
    """What a task's slices add to the totals after the sweeps of history, and the seats of each context, by ranges of contexts."""

    def run(batches):
        import pandas as pd

        own, seats = None, np.zeros(CLASSES * buckets)
        for pdf in batches:
            for row in zip(pdf["slice"], pdf["n_words"], pdf["pairs"]):
                s = restored(row, buckets, history.value)
                own = s.own_totals(own)
                np.add.at(seats, s.context, s.count)
        if own is not None:
            contexts, classes, root = own
            for part, at in enumerate(range(0, seats.size, RANGE)):
                once = (classes, np.array([root])) if at == 0 else (np.zeros(CLASSES), np.zeros(1))
                yield pd.DataFrame({"part": [part], "data": [pack(contexts[at : at + RANGE], seats[at : at + RANGE], *once)]})

    return run


def add_up(pdf):
    total = unpack(pdf["data"].iloc[0])
    for data in pdf["data"].iloc[1:]:
        total = [a + b for a, b in zip(total, unpack(data))]
    return pdf[["part"]].head(1).assign(data=[pack(*total)])


def whole(ranges: list[np.ndarray]) -> np.ndarray:
    """Counts of all contexts; in 4 bytes where they fit, as driver and tasks hold those of every sweep."""
    out = np.concatenate(ranges)
    return out.astype(np.uint32) if out.max() < 2**32 else out


def answer_pass(buckets: int, shared, averaged: int):
    """For each block the words it asked for with their counts, and the logarithm of the averaged probability of each pair, in its order."""

    def run(batches):
        import pandas as pd

        history, seats = shared.value
        for pdf in batches:
            for slice_id, n_words, pairs, blocks, asked in zip(pdf["slice"], pdf["n_words"], pdf["pairs"], pdf["blocks"], pdf["asked"]):
                s = restored((slice_id, n_words, pairs), buckets, history[:-averaged])
                total = np.bincount(s.word, s.count, n_words).astype(np.int64)
                views = [s.view(history[-averaged], seats)]
                for number in range(len(history) - averaged, len(history) - 1):
                    s.sweep(number, history[number])
                    views.append(s.view(history[number + 1], seats))
                del s
                rows = []
                for block, data in zip(blocks, asked):
                    w, start, of_word, context = unpack(data)
                    word, context = np.repeat(w.astype(np.int64), of_word), context.astype(np.int64)
                    p = sum(v.probability(word, context) for v in views) / averaged
                    rows.append((block, pack(start, total[w], np.log10(p).astype(np.float32))))
                yield pd.DataFrame(rows, columns=["block", "data"])
                trim()

    return run


def score_pass(n_tokens: int, vocabulary: int):
    def run(docs, answers):
        import pandas as pd

        out = []
        got = [unpack(d) for d in answers["data"]]
        for data in docs["data"]:
            ids, nulls, held, size, at, of_word = unpack(data)
            total, logp = np.zeros(of_word.size, np.int64), np.zeros(int(of_word.sum()))
            for start, count, p in got:
                total[start[0] : start[0] + count.size] = count
                logp[start[1] : start[1] + p.size] = p
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            base = np.repeat(np.log10((total + 1) / (n_tokens + vocabulary + 1)), of_word)
            known = np.repeat((total > 0).astype(np.int64), of_word)
            out.append(pd.DataFrame({
                "doc_id": pd.array(np.where(nulls, 0, ids), dtype="Int64"), "held_out": held.astype(bool), "n_tokens": size, "n_known": np.add.reduceat(known[at], first),
                "train_tokens": n_tokens, "base_score": np.add.reduceat(base[at], first), "score": np.add.reduceat(logp[at], first),
            }))
            out[-1].loc[nulls.astype(bool), "doc_id"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []})

    return run


def score(docs: DataFrame, held_out, *, sweeps: int = SWEEPS, averaged: int = AVERAGED, slice_docs: int = 4000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    The model learns from all rows where the column held_out is false. Null and empty texts
    have the end token alone; very long ones are blocks of their own. Repeated rows count and are
    returned each; a null doc_id stays null; other columns are not read; an empty table gives an empty
    result. Seats are drawn from seeds by sweep and slice, so reruns over the same files agree.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    n_docs, context = docs.count(), docs.sparkSession.sparkContext
    n_slices, buckets = max(n_docs // slice_docs, 16), max(n_docs // DOCS_PER_BUCKET, 1)
    rows = cut(docs.mapInArrow(block_pass(n_slices, buckets), "words boolean, block long, slice int, data binary"), "hpy-blocks", ["words"])
    merged = "slice int, n_words long, known long, tokens long, pairs binary, blocks array<long>, asked array<binary>"
    words = cut(rows.filter("words").groupBy("slice").applyInPandas(merge_pass(buckets), merged), "hpy-words")
    size = words.agg(F.sum("known").alias("v"), F.sum("tokens").alias("n")).first()
    vocabulary, n_tokens = size["v"] or 0, size["n"] or 0
    history: list[Totals] = []
    seats = np.zeros(CLASSES * buckets)
    for _ in range(sweeps + 1):
        shared = context.broadcast(history)
        parts = words.select("slice", "n_words", "pairs").mapInPandas(totals_pass(buckets, shared), "part int, data binary").groupBy("part").applyInPandas(add_up, "part int, data binary").collect()
        got = [unpack(bytes(r["data"])) for r in sorted(parts, key=lambda r: r["part"])] or [[seats, seats, np.zeros(CLASSES), np.zeros(1)]]
        contexts, seats = (whole([g[i] for g in got]) for i in range(2))
        history = [*history, Totals(contexts, sum(g[2] for g in got), float(sum(g[3] for g in got)[0]), vocabulary)]
        shared.destroy()
    answers = words.mapInPandas(answer_pass(buckets, context.broadcast((history, seats)), averaged), "block long, data binary")
    texts = rows.filter("not words").select("block", "data")
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score_pass(n_tokens, vocabulary), result)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), is_held_out(F.col("doc_id"), 7, 2))
