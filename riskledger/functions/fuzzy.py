"""Similarity of names, in batches: the weighted best of plain, token-sort, token-set and partial ratios.

A ratio is twice the length of the longest common subsequence by the sum of the lengths. Its length is found bit by
bit in parallel: a word of 64 bits holds a pattern's state, and one step over a text's column moves all pairs
of a batch. Patterns beyond 64 characters, rare among names, take the same steps with Python's integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: How much ratios over sorted or shared words count, and over the best part of the longer
#: name, by how many times it is longer.
TOKENS, PARTS, FAR_PARTS = 0.95, 0.9, 0.6
PARTS_FROM, FAR_BEYOND = 1.5, 8.0
#: Characters of a pattern in a machine word, and pairs that are scored at once.
WORD, BATCH = 64, 20_000


def processed(text: str) -> str:
    """Lower case, anything but letters and digits a space, none around."""
    return re.sub(r"[\W_]", " ", (text or "").lower()).strip()


# ---- common subsequences ---------------------------------------------------------------


def codes(texts: list[str]) -> np.ndarray:
    """Code points, a row a text, 0 after its end."""
    width = max(map(len, texts), default=0) or 1
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)


def matches(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each place of a text the bits of the pattern's places that have the same character."""
    out = np.zeros(texts.shape, np.uint64)
    for i in range(patterns.shape[1]):
        own = patterns[:, i, None]
        out |= ((own == texts) & (own != 0)).astype(np.uint64) << np.uint64(i)
    return out


def step(state: np.ndarray, match: np.ndarray) -> np.ndarray:
    """The state after one more character of the text; a 0 in it is a place of the pattern that was met."""
    both = state & match
    return (state + both) | (state - both)


def wide_subsequence(a: str, b: str) -> int:
    """As subsequences, for one pair of any lengths."""
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    state = full
    for c in b:
        both = state & places.get(c, 0)
        state = ((state + both) | (state - both)) & full
    return len(a) - state.bit_count()


def subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    if not a:
        return np.zeros(0, np.int64)
    short = [min(x, y, key=len) for x, y in zip(a, b)]
    long = [max(y, x, key=len) for x, y in zip(a, b)]
    wide = np.flatnonzero(lengths(short) > WORD)
    if wide.size:
        out, narrow = np.zeros(len(a), np.int64), np.flatnonzero(lengths(short) <= WORD)
        out[wide] = [wide_subsequence(short[i], long[i]) for i in wide]
        out[narrow] = subsequences([short[i] for i in narrow], [long[i] for i in narrow])
        return out
    match = matches(codes(short), codes(long))
    state = np.full(len(a), ~np.uint64(0))
    for j in range(match.shape[1]):
        state = step(state, match[:, j])
    return np.bitwise_count(~state).astype(np.int64)


def lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = lengths(a) + lengths(b)
    return np.where(total > 0, 2 * subsequences(a, b) / np.maximum(total, 1), 0.0)


def best_parts(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio of short to a part of long: parts as long as short, and shorter ones at long's ends."""
    m, n = lengths(short), lengths(long)
    if not short:
        return np.zeros(0)
    wide = np.flatnonzero(m > WORD)
    if wide.size:
        out, narrow = np.zeros(len(short)), np.flatnonzero(m <= WORD)
        for i in wide:
            x, y = short[i], long[i]
            parts = (y[max(at, 0) : at + len(x)] for at in range(1 - len(x), len(y)))
            out[i] = max(2 * wide_subsequence(x, p) / (len(x) + len(p)) for p in parts)
        out[narrow] = best_parts([short[i] for i in narrow], [long[i] for i in narrow])
        return out
    match = matches(codes(short), codes(long))
    best, widest = np.zeros(len(short)), int(m.max())
    for first in range(match.shape[1]):
        state = np.full(len(short), ~np.uint64(0))
        for j in range(first, min(first + widest, match.shape[1])):
            inside = j - first < m
            state = np.where(inside, step(state, match[:, j]), state)
            width = np.minimum(j + 1, n) - first
            # a part counts when it is whole, and at long's start also before
            counts = (width > 0) & (inside if first == 0 else (j - first == m - 1) | (inside & (j == n - 1)))
            if counts.any():
                met = np.bitwise_count(~state[counts]).astype(np.int64)
                best[counts] = np.maximum(best[counts], 2 * met / (m[counts] + np.minimum(width, m)[counts]))
    return best


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """best_parts of the shorter in the longer, of either in the other where they are as long; 0 where one is empty."""
    m, n = lengths(a), lengths(b)
    out = np.zeros(len(a))
    for some, x, y in ((m <= n, a, b), (n <= m, b, a)):
        at = np.flatnonzero(some & (m > 0) & (n > 0))
        out[at] = np.maximum(out[at], best_parts([x[i] for i in at], [y[i] for i in at]))
    return out


# ---- names --------------------------------------------------------------------------------


def joined(words) -> str:
    return " ".join(sorted(words))


def similarities(a: list[str], b: list[str]) -> np.ndarray:
    """H9: similarity of each pair, 0 to 1; 0 for names without letters and digits.

    Names of about one length: the best of the plain ratio and TOKENS times the ratios of their sorted
    words and of what remains of them beside common words. Else: the best of the plain ratio, PARTS (FAR_PARTS) times the partial
    ratio, and TOKENS times that of the partial ratio of the sorted words, which is 1 with a common word.
    """
    out = np.zeros(len(a))
    known: dict[str, tuple[str, str, set[str]]] = {}
    for text in {*a, *b}:
        own = processed(text)
        words = own.split()
        known[text] = own, joined(words), set(words)
    for start in range(0, len(a), BATCH):
        rows = [(known[x], known[y]) for x, y in zip(a[start : start + BATCH], b[start : start + BATCH])]
        live = [i for i, (x, y) in enumerate(rows) if x[0] and y[0]]
        if live:
            out[start + np.array(live)] = scored([rows[i] for i in live])
    return out


def scored(rows: list[tuple]) -> np.ndarray:
    plain = ([x[0] for x, _ in rows], [y[0] for _, y in rows])
    ordered = ([x[1] for x, _ in rows], [y[1] for _, y in rows])
    common = [x[2] & y[2] for x, y in rows]
    rest = ([joined(x[2] - c) for (x, _), c in zip(rows, common)], [joined(y[2] - c) for (_, y), c in zip(rows, common)])
    shared = np.array([bool(c) for c in common])
    m, n = lengths(plain[0]), lengths(plain[1])
    times = np.maximum(m, n) / np.minimum(m, n)
    best = ratios(*plain)

    def at(some: np.ndarray, texts: tuple[list[str], list[str]]) -> tuple[list[str], list[str]]:
        return [texts[0][i] for i in some], [texts[1][i] for i in some]

    near = np.flatnonzero(times < PARTS_FROM)
    if near.size:
        words = np.maximum(ratios(*at(near, ordered)), set_ratios([joined(common[i]) for i in near], *at(near, rest)))
        best[near] = np.maximum(best[near], TOKENS * words)
    far = np.flatnonzero(times >= PARTS_FROM)
    if far.size:
        scale = np.where(times[far] <= FAR_BEYOND, PARTS, FAR_PARTS)
        words = np.ones(far.size)
        apart = np.flatnonzero(~shared[far])
        # of a name's repeated words the rest has one each
        words[apart] = np.maximum(partial_ratios(*at(far[apart], ordered)), partial_ratios(*at(far[apart], rest)))
        best[far] = np.maximum(best[far], np.maximum(scale * partial_ratios(*at(far, plain)), TOKENS * scale * words))
    return best


def set_ratios(common: list[str], a: list[str], b: list[str]) -> np.ndarray:
    """Of names with those common words and the rests a and b: 1 if a rest is empty; else the best ratio
    of the common words to either name and of both names, each as its common words and then its rest."""
    c, m, n = lengths(common), lengths(a), lengths(b)
    gap = (c > 0).astype(np.int64)
    apart = m + n - 2 * subsequences(a, b)
    one, two = c + gap + m, c + gap + n
    best = 1 - apart / np.maximum(one + two, 1)
    either = np.maximum(1 - (gap + m) / np.maximum(c + one, 1), 1 - (gap + n) / np.maximum(c + two, 1))
    best = np.where(c > 0, np.maximum(best, either), best)
    return np.where((c > 0) & ((m == 0) | (n == 0)), 1.0, best)


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(similarities(a.fillna("").tolist(), b.fillna("").tolist()))


def similarity(a: Column, b: Column) -> Column:
    """H9 for columns; nulls are empty, and a second name of one character is like none."""
    return F.when(F.length(b) > 1, _similarity(a, b)).otherwise(0.0)


# ---- search --------------------------------------------------------------------------------

#: Kinds of characters that bags count: letters, digits and the space have their own, others share the rest.
KINDS = 64


def kind(character: str) -> int:
    """Its place in a bag: a to z, 0 to 9, the space, then the rest by code point."""
    if "a" <= character <= "z":
        return ord(character) - ord("a")
    if "0" <= character <= "9":
        return 26 + ord(character) - ord("0")
    return 36 if character == " " else 37 + ord(character) % (KINDS - 37)


class Bags:
    """What bounds the similarity of names without aligning them: characters by kind, lengths, words by hash."""

    def __init__(self, texts: list[str]) -> None:
        own = [processed(t) for t in texts]
        words = [set(t.split()) for t in own]
        self.counts = np.zeros((len(texts), KINDS), np.int16)
        for i, t in enumerate(own):
            np.add.at(self.counts[i], [kind(c) for c in t], 1)
        self.length = lengths(own)
        self.least = np.array([max(sum(map(len, w)) + len(w) - 1, 0) for w in words], np.int64)
        self.words = np.array([sum({1 << (sum(w.encode()) + len(w)) % 64 for w in ws}) for ws in words], np.uint64)


def possible(query: int, queries: Bags, keys: Bags, least: float) -> np.ndarray:
    """The keys whose similarity to a query may reach least. No subsequence is longer than what the
    bags share, and no form of a name shorter than its distinct words; common words are always worth a look."""
    both = np.minimum(keys.counts, queries.counts[query]).sum(axis=1, dtype=np.int64)
    m, n = queries.length[query], keys.length
    short = np.minimum(queries.least[query], keys.least)
    far = np.maximum(m, n) >= PARTS_FROM * np.minimum(m, n)
    whole = 2 * both / np.maximum(queries.least[query] + keys.least, 1)
    part = PARTS * 2 * both / np.maximum(short + both, 1)
    reach = np.where(far, np.maximum(whole, part), whole) >= least - 1e-9
    return np.flatnonzero((((keys.words & queries.words[query]) != 0) | reach) & (m > 0) & (n > 0))


def search_pass(shared, least: float, best: int, candidates: Accumulator | None):
    """(query, query_key, company_key, members, similarity) of a batch's keys: for each query up to best that reach least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        queries = Bags([key for _, key in asked])
        for batch in batches:
            names, members = batch["company_key"].to_pylist(), batch["members"].to_pylist()
            keys = Bags(names)
            for q, (query, query_key) in enumerate(asked):
                at = possible(q, queries, keys, least)
                if candidates is not None:
                    candidates.add(int(at.size))
                if not at.size:
                    continue
                score = np.round(similarities([query_key] * at.size, [names[i] for i in at]), 6)
                found = sorted((-s, names[i], members[i]) for s, i in zip(score.tolist(), at) if s >= least and len(names[i]) > 1)[:best]
                if found:
                    columns = [[query] * len(found), [query_key] * len(found), [f[1] for f in found], [f[2] for f in found], [-f[0] for f in found]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()))], ["query", "query_key", "company_key", "members", "similarity"])

    return run
