"""Operator 10, language identification by character language models.

One interpolated Kneser-Ney model per language, fitted by a task of its own on a bounded
sample of labelled documents, and kept in sorted hash arrays, which the workers merge; a
text gets the language of the lowest cross-entropy per character, and a score that
tells how well that entropy fits what the language's own documents have.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskledger.llm._common import table
from riskledger.llm._words import trim

#: Bounds of the training sample: documents of a language (about: by a threshold on the
#: text's hash; never more than twice as many), characters of a document that may enter it, and
#: languages. A task holds one language's sample, a worker 4 bytes for each 4-gram and language.
DOCS_PER_LANGUAGE, TRAINING_CHARS, MAX_LANGUAGES = 400, 20_000, 64
ORDER = 4
START, GAP = 1, 32
_P = np.uint64(0x9E3779B97F4A7C15)
_table: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """By code point: its lower-case letter, or GAP if it is no letter."""
    if not _table:
        t = np.full(0x110000, GAP, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                t[c] = ord(s.lower()[0])
        _table.append(t)
        _table.append(np.unique(t))
    return _table[0]


def n_symbols() -> int:
    """How many symbols there are: what the uniform distribution under all models is over."""
    symbols()
    return _table[1].size


def encode(text: str) -> np.ndarray:
    """A text's symbols: letters, and one GAP for each run of other characters."""
    s = symbols()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if s.size:
        s = s[~((s == GAP) & (np.concatenate([[GAP], s[:-1]]) == GAP))]
    return s


def grams(stream: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER the hash of the n symbols that end at each place."""
    out, h = [], np.zeros(stream.size, np.uint64)
    s = (stream.astype(np.uint64) + np.uint64(11)) * _P
    s ^= s >> np.uint64(29)
    for n in range(ORDER):
        # older symbols get higher powers, so that all n-grams of one order hash alike
        back = np.concatenate([np.zeros(n, np.uint64), s[: s.size - n]]) if n else s
        h = h + back * np.uint64(pow(int(_P), n, 1 << 64))
        g = h ^ (h >> np.uint64(31))
        out.append(g * _P)
    return out


def lay_out(texts: list[str], most: int = 300_000):
    """Texts in streams of about most characters: (stream, text of each symbol or
    -1 for the START symbols before it). Longer texts go on in further streams."""
    pad, parts, owners, held = np.full(ORDER - 1, START, np.uint32), [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), most):
            # a later piece sees the end of the piece before it
            before = encode(text[max(0, at - 40) : at])[-(ORDER - 1) :] if at else pad
            s = encode(text[at : at + most])
            parts += [before, s]
            owners += [np.full(before.size, -1, np.int64), np.full(s.size, i, np.int64)]
            held += s.size
            if held >= most:
                yield np.concatenate(parts), np.concatenate(owners)
                parts, owners, held = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(owners)


@dataclass
class Models:
    """For each order n: sorted n-gram hashes with log2 probabilities by language,
    and sorted context hashes with log2 back-off weights by language."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    limit: np.ndarray
    scale: np.ndarray

    def logs(self, stream: np.ndarray, places: np.ndarray) -> np.ndarray:
        g = grams(stream)
        out = np.zeros((places.size, len(self.languages)), np.float32)
        todo = np.arange(places.size)
        for n in range(ORDER - 1, -1, -1):
            h = g[n][places[todo]]
            at = np.minimum(np.searchsorted(self.keys[n], h), self.keys[n].size - 1)
            hit = self.keys[n][at] == h
            out[todo[hit]] += self.logp[n][at[hit]]
            todo = todo[~hit]
            if not todo.size:
                return out
            if n:
                c = g[n - 1][places[todo] - 1]
                at = np.minimum(np.searchsorted(self.contexts[n], c), self.contexts[n].size - 1)
                hit = self.contexts[n][at] == c
                out[todo[hit]] += self.backoff[n][at[hit]]
        out[todo] += self.unseen
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by text and language; number of symbols."""
        bits, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for stream, owner in lay_out(texts):
            places = np.flatnonzero(owner >= 0)
            if not places.size:
                continue
            own = owner[places]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            bits[own[first]] -= np.add.reduceat(self.logs(stream, places), first, dtype=np.float64)
            size[own[first]] += np.diff(np.concatenate([first, [own.size]]))
        return bits / np.maximum(size, 1)[:, None], size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and fit by text: und and 0 without a letter, or where no language was
        learned. The fit is how well the language's entropy suits it; the score also falls where
        another language does as well."""
        letters = [any(map(str.isalpha, t)) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        h, size = self.entropies(texts)
        best = h.argmin(1)
        rows = np.arange(len(texts))
        fits = 1 / (1 + np.exp(np.clip((h[rows, best] - self.limit[best]) / self.scale[best], -50, 50)))
        odds = np.exp2(-np.minimum(np.minimum(size, 100)[:, None] * (h - h[rows, best][:, None]), 500))
        score = np.where(letters, fits / odds.sum(1), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters)], score, np.where(letters, fits, 0.0)


def fit_language(lang: str, texts: list[str]) -> dict:
    """What one language's texts say: by order its keys with their discounted shares, contexts and
    suffixes, its contexts with their back-off weights; and where the language ends. Four of five texts
    give the counts; the fifth calibrates."""
    learn = [t for i, t in enumerate(texts) if i % 5 or len(texts) < 5]
    seen: list[list[tuple]] = [[] for _ in range(ORDER)]
    for stream, owner in lay_out(learn):
        g, p = grams(stream), np.flatnonzero(owner >= 0)
        for n in range(ORDER):
            zero = np.zeros(p.size, np.uint64)
            seen[n].append((g[n][p], g[n - 1][p - 1] if n else zero, g[n - 1][p] if n else zero))
    orders, above = [], None
    for n in range(ORDER - 1, -1, -1):
        key, context, suffix = (np.concatenate(x) for x in zip(*seen[n])) if seen[n] else [np.zeros(0, np.uint64)] * 3
        key, at, c = np.unique(key, return_index=True, return_counts=True)
        context, suffix = context[at], suffix[at]
        if above is not None:  # lower orders count the distinct symbols to the left
            u, k = np.unique(above, return_counts=True)
            c = np.ones(key.size, np.int64)
            c[np.searchsorted(key, u)] = k
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        every, slot = np.unique(context, return_inverse=True)
        total = np.bincount(slot, c, every.size)
        weight = d * np.bincount(slot, minlength=every.size) / np.maximum(total, 1)
        orders.insert(0, (key, (np.maximum(c - d, 0) / total[slot]).astype(np.float32), context, suffix, every, weight.astype(np.float32)))
        above = suffix
    found = {"language": lang, "orders": orders, "limit": 99.0, "scale": 1.0}
    return found | calibrated(merged([found]), [t for i, t in enumerate(texts) if i % 5 == 0], learn)


def random_texts(texts: list[str], n: int = 40, size: int = 200) -> list[str]:
    """Texts of letters drawn evenly from those that make up nearly all of texts, in words of six."""
    found, count = np.unique(np.concatenate([encode(t) for t in texts] or [np.zeros(0, np.uint32)]), return_counts=True)
    often = found[(found != GAP) & (count > count.sum() / 1000)]
    if not often.size:
        return []
    drawn = np.random.default_rng(0).choice(often, (n, size))
    drawn[:, 6::7] = GAP
    return ["".join(map(chr, row)) for row in drawn.tolist()]


def calibrated(model: Models, held: list[str], learn: list[str]) -> dict:
    """Where the language ends: halfway from the entropy that nine of ten of its own
    held-back texts stay under to that of random letters of its own. There the fit is a half."""
    h, size = model.entropies(held)
    h = h[size >= 20, 0] if (size >= 20).any() else h[:, 0]
    top = float(np.quantile(h, 0.9)) if h.size else 0.0
    noise = random_texts(learn)
    noise = float(model.entropies(noise)[0].mean()) if noise else -float(model.unseen[0])
    return {"limit": top + 0.5 * max(noise - top, 1.0), "scale": max(noise - top, 1.0) / 12}


def merged(found: list[dict]) -> Models:
    """Languages as one model: shared sorted keys with a column for each language, which has
    each key's interpolated probability whether it met the key or not."""
    if not found:
        return Models([], [], [], [], [], *[np.zeros(0)] * 3)
    keys, logp, contexts, backoff, below = [], [], [], [], None
    unseen = np.full(len(found), 1.0 / n_symbols())
    for n in range(ORDER):
        union, first = np.unique(np.concatenate([m["orders"][n][0] for m in found]), return_index=True)
        context, suffix = (np.concatenate([m["orders"][n][i] for m in found])[first] for i in (2, 3))
        every = np.unique(np.concatenate([m["orders"][n][4] for m in found]))
        low = np.broadcast_to(unseen, (union.size, len(found))) if below is None else below[1][np.searchsorted(below[0], suffix)]
        weight, p = np.ones((every.size, len(found))), np.zeros((union.size, len(found)))
        for j, m in enumerate(found):
            key, share, _, _, own, w = m["orders"][n]
            weight[np.searchsorted(every, own), j] = w
            p[np.searchsorted(union, key), j] = share
        p += weight[np.searchsorted(every, context)] * low
        if below is None and every.size:
            unseen = unseen * weight[0]
        keys.append(union)
        logp.append(np.log2(p).astype(np.float32))
        contexts.append(every)
        backoff.append(np.log2(weight).astype(np.float32))
        below = (union, p)
    return Models([m["language"] for m in found], keys, logp, contexts, backoff, np.log2(unseen).astype(np.float32), *(np.array([m[a] for m in found]) for a in ("limit", "scale")))


class Fitted:
    """Fitted languages on their way to the workers, each of which merges them once."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    @cached_property
    def models(self) -> Models:
        return merged([pickle.loads(r) for r in self.rows])

    def __getstate__(self):
        return {"rows": self.rows}


def fit(rows: list[tuple[str, str]]) -> Models:
    """Models of (language, text) rows, in this process."""
    return merged([fit_language(lang, [t for x, t in rows if x == lang]) for lang in sorted({lang for lang, _ in rows})])


def is_held_out(doc_id, modulus: int, remainder: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, *, docs_per_language: int = DOCS_PER_LANGUAGE, training_chars: int = TRAINING_CHARS, max_languages: int = MAX_LANGUAGES) -> Fitted:
    """Fit on a sample of docs (text, lang): texts of at most training_chars
    characters whose hash is under a threshold that leaves about docs_per_language
    of a language, at most twice as many; equal texts once; the max_languages languages with most documents. Each
    language is fitted in a task of its own, and only fitted models reach the driver. The sample,
    and so the model, is bounded by those parameters whatever the size of docs."""
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.length("text").between(1, training_chars)).select("lang", F.col("text").cast("string").alias("text"))
    found = sorted(labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect())
    part = F.shiftrightunsigned(F.xxhash64("text"), 33) / float(1 << 31)
    keep = F.lit(False)
    for r in found:
        keep = keep | ((F.col("lang") == r["lang"]) & (part < min(1.0, docs_per_language / r["count"])))
    sample = labelled.filter(keep).groupBy("lang", "text").agg(F.xxhash64("text").alias("__hash"))
    w = Window.partitionBy("lang").orderBy("__hash", "text")
    sample = sample.withColumn("__row", F.row_number().over(w)).filter(F.col("__row") <= 2 * docs_per_language)

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["__hash", "text"])
        lang = pdf["lang"].iloc[0]
        return pd.DataFrame({"lang": [lang], "model": [pickle.dumps(fit_language(lang, pdf["text"].tolist()))]})

    rows = sample.groupBy("lang").applyInPandas(one, "lang string, model binary").collect()
    return Fitted([bytes(r["model"]) for r in sorted(rows, key=lambda r: r["lang"])])


def identify(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """docs with __language, struct(lang_pred, score, fit) of each whole text, in place of any column of that name.

    A null or empty text, or one without letters, is und with 0; so is every text where no
    language was learned. Repeated rows get the same; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("lang_pred string, score double, fit double")
    def predict(text):
        import pandas as pd

        lang, score, fits = shared.value.models.predict(["" if t is None else t for t in text])
        trim()
        return pd.DataFrame({"lang_pred": lang, "score": score, "fit": fits})

    return docs.withColumn("__language", predict(F.col("text").cast("string")))


def keep_identified(docs: DataFrame, least_fit: float = 0.5) -> DataFrame:
    """docs without those that no learned language explains: no letter, or a fit under least_fit
    (all, where no document has a language). How alike learned languages are does not count.

    Null and empty texts go; equal rows share their fate; other columns, a __language
    among them, are kept; an empty table stays empty."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), "text")
    found = identify(held, train(docs)).filter((F.col("__language.lang_pred") != "und") & (F.col("__language.fit") >= least_fit))
    return found.select(*[F.col("row")[c].alias(c) for c in names])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", is_held_out(F.col("doc_id"), 4, 2))
    models = train(docs.filter(~F.col("held_out")).select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), models).select("doc_id", "held_out", "__language.lang_pred", "__language.score")
