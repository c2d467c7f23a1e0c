"""Boosted regression trees with Huber loss (Spark ML has squared and absolute loss only).

Rows are binned once and written in blocks; a tree is grown level by level from histograms that tasks
sum over their blocks, so only histograms travel. All trees grow in one job, whose tasks run at once and keep their rows in memory; where tasks
can't run at once, each sum is a job. Each tree fits residuals that are clipped at a quantile of their
size, and each leaf then takes the median of its residuals, moved by the mean of what lies around it, clipped alike.
Several features share a column of codes (all combinations of their bins), so a row is counted once for all of them, and of
two sibling nodes only the smaller is counted: the other is their parent less it.
With a job for each sum, blocks keep predictions up to some tree and add the trees since then; a lost block is read again and takes all trees.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskledger.sources.bronze import shared_folder

#: Bins of a feature, of residual sizes and of a leaf's residuals; trees until predictions are kept anew.
BINS, SIZE_BINS, LEAF_BINS, KEPT = 64, 8192, 2048, 10
#: Least and most codes of a column, and the rows of a block for each code between them.
LEAST_CODES, MOST_CODES, ROWS_PER_CODE = 256, 4096, 64
#: With more rows than slots take at this size, tasks take up to so many times as many.
FULLER = 10
#: Seconds from one look for another task's sums to the next, and until their task counts as lost.
LOOK, LOST = 0.001, 1800
#: Histograms of more tasks than these are added up among the tasks first.
FEW_TASKS = 16
ALL = 255


# ---- trees -----------------------------------------------------------------------------


@dataclass
class Forest:
    """Complete binary trees by heap place: inner nodes send rows right whose feature is above the
    cut (an infinite cut sends none), leaves have values."""

    names: list[str]
    depth: int
    rate: float
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of feature values."""
        out = np.full(len(x), self.start)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            out += self.rate * value[leaves(x, feature, cut, self.depth)]
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(DoubleType())
        def predicted(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.predict(np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(shared.value.names)))))

        return df.withColumn(out, predicted(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.names])))

    def importances(self) -> np.ndarray:
        """Each feature's share of what the splits of a tree gained, averaged over the trees that split."""
        total = np.zeros(len(self.names))
        for feature, gain in zip(self.feature, self.gain):
            if gain.sum() > 0:
                total += np.bincount(feature, gain, len(self.names)) / gain.sum()
        return total / total.sum() if total.sum() > 0 else total

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a tree."""
        rows = [(i, f.tolist(), c.tolist(), v.tolist(), g.tolist()) for i, (f, c, v, g) in enumerate(zip(self.feature, self.cut, self.value, self.gain))]
        kinds = "tree int, feature array<int>, cut array<double>, value array<double>, gain array<double>"
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{path}/trees")
        spark.createDataFrame([(self.names, self.depth, self.rate, float(self.start))], "names array<string>, depth int, rate double, start double").coalesce(1).write.parquet(f"{path}/shape")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        shape = spark.read.parquet(f"{path}/shape").first()
        out = cls(list(shape["names"]), shape["depth"], shape["rate"], shape["start"])
        for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect():
            out.feature.append(np.array(r["feature"], np.int64))
            out.cut.append(np.array(r["cut"]))
            out.value.append(np.array(r["value"]))
            out.gain.append(np.array(r["gain"]))
        return out


def leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Each row's place among the nodes of that depth."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node - (2**depth - 1)


# ---- blocks ------------------------------------------------------------------------------


def binned(edges: list[np.ndarray]):
    """Batches of rows (y, w, k, x) as blocks of bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch["x"].to_numpy(zero_copy_only=False))
                bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                columns = [bins, *[batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "k")]]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["x", "y", "w", "k"])

    return run


@dataclass
class Block:
    """A task's rows with codes by column, label, weight, key, and predictions so far."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    k: np.ndarray
    at: np.ndarray


def block_of(found: Iterable, shape: Shape) -> Block:
    """All blocks of a task as one, ordered by key, so that sums don't hang on the order of arrival; codes lie column by column."""
    kinds = {"x": np.uint8, "y": np.float64, "w": np.float64, "k": np.int64}
    parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, kind)] for c, kind in kinds.items()}
    for row in found:
        for c, kind in kinds.items():
            parts[c].append(np.frombuffer(row[c], kind))
    x, y, w, k = (np.concatenate(parts[c]) for c in kinds)
    order = np.lexsort((y, k))
    bins = x.reshape(-1, len(shape.bins))[order].T
    codes = np.zeros((len(shape.columns), y.size), np.uint16)
    for f, (column, stride) in enumerate(zip(shape.column, shape.stride)):
        codes[column] += bins[f] * np.uint16(stride)
    return Block(codes, y[order], w[order], k[order], np.zeros(y.size))


def block(batches: Iterator[pa.RecordBatch], shape: Shape) -> Block:
    return block_of((row for batch in batches for row in batch.to_pylist()), shape)


def sampled(k: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees: by the rows' keys, so the same in every run and partitioning."""
    h = (k.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


@dataclass
class Tree:
    """A tree in bins, as it grows."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2**depth - 1
        return cls(np.zeros(n, np.int64), np.full(n, ALL), np.zeros(n + 1), np.zeros(n))


# ---- growing -------------------------------------------------------------------------------


def quantile(weights: np.ndarray, share: float) -> int:
    """The first bin up to which that share of the weights lies."""
    upto = np.cumsum(weights)
    return int(np.searchsorted(upto, share * upto[-1], "left")) if upto[-1] > 0 else 0


def best_splits(h: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last bin that goes left, and gain for each node of histograms (node, feature, bin, [gradient, weight, count])."""
    left = np.cumsum(h, axis=2)[:, :, :-1]
    right = h.sum(axis=2, keepdims=True) - left
    fits = (left[..., 2] >= min_leaf) & (right[..., 2] >= min_leaf) & (left[..., 1] > 0) & (right[..., 1] > 0)
    lw, rw = np.where(fits, left[..., 1], 1.0), np.where(fits, right[..., 1], 1.0)
    gain = np.where(fits, lw * rw / (lw + rw) * (left[..., 0] / lw - right[..., 0] / rw) ** 2, 0.0).reshape(len(h), -1)
    best = (gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)  # of equals the first, whatever rounding says
    return best // left.shape[2], best % left.shape[2], gain[np.arange(len(h)), best]


def leaf_values(h: np.ndarray, mids: np.ndarray, delta: float | None) -> np.ndarray:
    """For each leaf of histograms (leaf, bin, [residual, weight]) the mean, or with delta the median and from there the mean step, clipped at delta."""
    weight = h[..., 1].sum(axis=1)
    if delta is None:
        return np.where(weight > 0, h[..., 0].sum(axis=1) / np.where(weight > 0, weight, 1.0), 0.0)
    out = np.zeros(len(h))
    for i in np.flatnonzero(weight > 0):
        w = h[i, :, 1]
        own = np.where(w > 0, h[i, :, 0] / np.where(w > 0, w, 1.0), mids)
        median = own[quantile(w, 0.5)]
        out[i] = median + (np.clip(own - median, -delta, delta) * w).sum() / weight[i]
    return out


def fit(frame: DataFrame, names: list[str], label: str, weight: str, key: str, *, trees: int, depth: int, rate: float, subsample: float, min_leaf: int, alpha: float | None, seed: int = 42, rows_per_task: int = 100_000) -> Forest:
    """Boosted trees over frame's columns names (nulls count as 0), each on the share subsample of rows that the hash of
    key draws. alpha is the quantile of the residuals' size from which they are clipped; None is squared loss."""
    spark = frame.sparkSession
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = frame.select(number(label).alias("y"), number(weight).alias("w"), F.xxhash64(key).alias("k"), *[number(c).alias(f"x{i}") for i, c in enumerate(names)])
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.approxQuantile([f"x{i}" for i in range(len(names))], shares, 0.001)
    edges = [np.unique(e) for e in found]
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("y"), F.max("y")).first()
    out = Forest(list(names), depth, rate)
    if not n:
        return out
    tasks = tasks_for(n, rows_per_task, slots(spark))
    path = shared_folder(spark, f"blocks-{uuid.uuid4().hex}")
    packed = rows.select("y", "w", "k", F.array(*[f"x{i}" for i in range(len(names))]).alias("x")).coalesce(max(1, min(-(-n // rows_per_task), 100_000)))
    packed.mapInArrow(binned(edges), "x binary, y binary, w binary, k binary").write.parquet(path)
    bins = [e.size + 1 for e in edges]
    codes = min(max(n // tasks // ROWS_PER_CODE, LEAST_CODES), MOST_CODES)
    shape = Shape(uuid.uuid4().hex, bins, packing(bins, codes), float(low), max(float(high - low), 1e-9), trees, depth, rate, subsample, min_leaf, alpha, seed)
    read = spark.read.parquet(path).repartition(tasks)
    if tasks <= max(1, at_once(spark, path)):
        kinds = "start double, feature array<long>, bin array<long>, value array<double>, gain array<double>"
        trees_of = in_one_job(shape, tasks, shared_folder(spark, "sums"))
        grown = [(r["start"], Tree(*map(np.array, r[1:]))) for r in read.mapInArrow(trees_of, kinds, barrier=tasks > 1).collect()]
    else:
        grown = together(read, shape, tasks)
    for start, tree in grown:
        out.start = start
        out.feature.append(tree.feature)
        out.cut.append(np.array([edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(tree.feature, tree.bin)], float))
        out.value.append(tree.value)
        out.gain.append(tree.gain)
    return out


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def at_once(spark: SparkSession, folder: str) -> int:
    """Tasks of a barrier stage that can tell each other sums in the folder: none where executors come and go or it isn't one of files."""
    steady = spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"
    return slots(spark) if steady and urlparse(folder).scheme in ("", "file") else 0


def tasks_for(n: int, rows_per_task: int, slots: int) -> int:
    """Every sum is a job, so no more tasks than run at once, unless they would hold FULLER times their rows."""
    tasks = max(1, -(-n // rows_per_task))
    return tasks if tasks <= slots else max(slots, -(-n // (rows_per_task * FULLER)))


def packing(bins: list[int], most: int) -> list[list[int]]:
    """Features by column: those of most bins first, each into the first column whose codes stay within most."""
    columns: list[list[int]] = []
    codes: list[int] = []
    for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
        at = next((i for i, n in enumerate(codes) if n * bins[f] <= most), None)
        if at is None:
            columns.append([f])
            codes.append(bins[f])
        else:
            columns[at].append(f)
            codes[at] *= bins[f]
    return columns


@dataclass
class Shape:
    """What holds for all trees of a model."""

    model: str
    bins: list[int]
    columns: list[list[int]]
    low: float
    span: float
    trees: int
    depth: int
    rate: float
    subsample: float
    min_leaf: int
    alpha: float | None
    seed: int

    @cached_property
    def codes(self) -> list[int]:
        """Codes of each column."""
        return [int(np.prod([self.bins[f] for f in fs])) for fs in self.columns]

    @cached_property
    def column(self) -> np.ndarray:
        """Each feature's column."""
        return np.array([i for _, i in sorted((f, i) for i, fs in enumerate(self.columns) for f in fs)])

    @cached_property
    def stride(self) -> np.ndarray:
        """What a feature's bin counts in a code of its column: its first feature counts most."""
        return np.array([s for _, s in sorted((f, int(np.prod([self.bins[g] for g in fs[at + 1 :]]))) for fs in self.columns for at, f in enumerate(fs))], np.int64)


@dataclass
class Seen:
    """A block's predictions after so many trees."""

    at: np.ndarray
    trees: int = 0


#: In a worker: by block what it saw last, of one model only. What is missing is computed from the block and the trees.
_seen: dict[tuple[str, int], Seen] = {}


def seen(shape: Shape, number: int, b: Block, trees: int) -> Seen:
    for key in [k for k in _seen if k[0] != shape.model]:
        del _seen[key]
    found = _seen.get((shape.model, number))
    if found is None or found.trees < trees:
        found = _seen[shape.model, number] = Seen(b.at, trees)
    return found


def sees(b: Block, state: Seen, tree: int, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by column, residuals and weights of the rows that a tree sees."""
    own = np.flatnonzero(sampled(b.k, tree, shape.subsample, shape.seed))
    return np.take(b.x, own, axis=1), (b.y - state.at)[own], b.w[own]


def nodes(x: np.ndarray, tree: Tree, level: int, shape: Shape) -> np.ndarray:
    """Each row's place among a level's nodes, by its codes."""
    node, n, inner = np.zeros(x.shape[1], np.int64), x.shape[1], 2**level - 1
    if not level:
        return node
    feature, most = tree.feature[:inner], max(shape.codes)
    right = np.arange(most) // shape.stride[feature, None] % np.array(shape.bins)[feature, None] > tree.bin[:inner, None]
    column, right, x, rows = shape.column[feature] * n, right.ravel(), x.ravel(), np.arange(n)
    for _ in range(level):
        code = x.take(column.take(node) + rows)
        node = 2 * node + 1 + right.take(node * most + code)
    return node - inner


def catch_up(b: Block, state: Seen, trees: list[Tree], shape: Shape) -> None:
    for t in trees:
        state.at = state.at + shape.rate * t.value[nodes(b.x, t, shape.depth, shape)]
    state.trees += len(trees)


def starts(b: Block, shape: Shape) -> np.ndarray:
    """Labels by bin, or their weighted sum and weight."""
    if shape.alpha is None:
        return np.array([(b.y * b.w).sum(), b.w.sum()])
    return np.bincount(np.clip((b.y - shape.low) / shape.span * SIZE_BINS, 0, SIZE_BINS - 1).astype(np.int64), b.w, SIZE_BINS)


def sizes(rows: tuple, shape: Shape) -> np.ndarray:
    _, r, w = rows
    return np.bincount(np.clip(np.abs(r) / shape.span * SIZE_BINS, 0, SIZE_BINS - 1).astype(np.int64), w, SIZE_BINS)


def histogram(rows: tuple, shape: Shape, tree: Tree, level: int, delta: float | None, wanted: np.ndarray) -> np.ndarray:
    """Sums by wanted node of a level and the bins that each feature has: gradients, weights, rows."""
    x, r, w = rows
    node = nodes(x, tree, level, shape)
    if len(wanted) < 2**level:
        place = np.full(2**level, -1)
        place[wanted] = np.arange(len(wanted))
        node = place[node]
        own = np.flatnonzero(node >= 0)
        node, x, r, w = node[own], np.take(x, own, axis=1), r[own], w[own]
    weighed = (r if delta is None else np.clip(r, -delta, delta)) * w
    told: list[np.ndarray] = [np.zeros(0)] * len(shape.bins)
    for codes, n, features in zip(x, shape.codes, shape.columns):
        at = node * n + codes
        rest = np.stack([np.bincount(at, v, len(wanted) * n) for v in (weighed, w, None)]).reshape(3 * len(wanted), -1)
        for f in features:  # its bins, whatever the features after it; then those, whatever its bins
            cells = rest.reshape(len(rest), shape.bins[f], -1)
            told[f], rest = cells.sum(axis=2).reshape(3, len(wanted), -1), cells.sum(axis=1)
    return np.moveaxis(np.concatenate(told, axis=2), 0, -1)


def ends(rows: tuple, shape: Shape, tree: Tree) -> np.ndarray:
    """Residuals by leaf and bin, with their weights."""
    x, r, w = rows
    at = nodes(x, tree, shape.depth, shape) * LEAF_BINS + np.clip((r / shape.span + 1) / 2 * LEAF_BINS, 0, LEAF_BINS - 1).astype(np.int64)
    return np.stack([np.bincount(at, v, 2**shape.depth * LEAF_BINS) for v in (r * w, w)], axis=-1).reshape(2**shape.depth, LEAF_BINS, 2)


def start_of(told: np.ndarray, shape: Shape) -> float:
    if shape.alpha is None:
        return float(told[0] / told[1]) if told[1] > 0 else 0.0
    return float(shape.low + (quantile(told, 0.5) + 0.5) / SIZE_BINS * shape.span)


def grow(total, shape: Shape) -> Tree:
    """The next tree; total(part, ...) sums a part's arrays over all blocks: one for the clipping point, one a level, one for the leaves."""
    delta = None if shape.alpha is None else (quantile(total(sizes), shape.alpha) + 1) / SIZE_BINS * shape.span
    tree = Tree.empty(shape.depth)
    filled = np.arange(BINS) < np.array(shape.bins)[:, None]
    wanted, above = np.zeros(1, np.int64), None
    for level in range(shape.depth):
        h = np.zeros((2**level, len(shape.bins), BINS, 3))
        told = np.zeros((len(wanted), *h.shape[1:]))
        told[:, filled] = total(histogram, tree, level, delta, wanted)
        h[wanted] = told
        if above is not None:
            h[wanted ^ 1] = above[wanted // 2] - told
        feature, last, gain = best_splits(h, shape.min_leaf)
        splits = gain > 1e-12
        inner = slice(2**level - 1, 2 ** (level + 1) - 1)
        tree.feature[inner], tree.bin[inner], tree.gain[inner] = np.where(splits, feature, 0), np.where(splits, last, ALL), np.where(splits, gain, 0.0)
        if not splits.any():
            break
        # a node that doesn't split has children that don't either; of others the child of fewer rows is summed
        at = np.flatnonzero(splits)
        left = np.array([h[i, feature[i], : last[i] + 1, 2].sum() for i in at])
        wanted, above = 2 * at + (2 * left > h[at, 0, :, 2].sum(axis=1)), h
    mids = ((np.arange(LEAF_BINS) + 0.5) / LEAF_BINS * 2 - 1) * shape.span
    tree.value = leaf_values(total(ends, tree), mids, delta)
    return tree


class Sums:
    """Sums of arrays over the tasks of a barrier stage. Spark's own allGather waits a second each time, so they are told by
    files in the shared folder: a task writes its array, adds up its share of everyone's, writes that, and reads all shares.
    A file has its name once it is whole, and goes when everyone has read it."""

    def __init__(self, folder: str, tasks: int):
        self.tasks, self.at, self.round = tasks, 0, 0
        if tasks > 1:
            context = BarrierTaskContext.get()
            # a stage that starts anew must not meet the files of the one before
            self.at, self.folder = context.partitionId(), f"{urlparse(folder).path}/{context.allGather(uuid.uuid4().hex)[0]}"
            os.makedirs(self.folder, exist_ok=True)

    def path(self, kind: str, number: int, task: int) -> str:
        return f"{self.folder}/{kind}-{number}-{task}"

    def tell(self, kind: str, values: np.ndarray) -> None:
        name = self.path(kind, self.round, self.at)
        values.tofile(f"{name}.part")
        os.replace(f"{name}.part", name)

    def told(self, kind: str, task: int, first: int = 0, n: int = -1) -> np.ndarray:
        name, end = self.path(kind, self.round, task), time.monotonic() + LOST
        while True:
            try:
                return np.fromfile(name, np.float64, n, offset=8 * first)
            except FileNotFoundError:
                if time.monotonic() > end:
                    raise TimeoutError(f"{name} did not appear: executors must share the folder of spark.checkpoint.dir") from None
                time.sleep(LOOK)

    def of(self, values: np.ndarray) -> np.ndarray:
        if self.tasks == 1:
            return values
        flat = values.astype(np.float64).ravel()
        self.tell("all", flat)
        cuts = [flat.size * i // self.tasks for i in range(self.tasks + 1)]
        first, n = cuts[self.at], cuts[self.at + 1] - cuts[self.at]
        self.tell("share", reduce(np.add, [self.told("all", i, first, n) for i in range(self.tasks)]))
        out = np.concatenate([self.told("share", i) for i in range(self.tasks)])
        # all shares are there, so everyone has read this round's arrays and the shares before
        os.remove(self.path("all", self.round, self.at))
        if self.round:
            os.remove(self.path("share", self.round - 1, self.at))
        self.round += 1
        return out.reshape(values.shape)


def in_one_job(shape: Shape, tasks: int, folder: str):
    """All trees over the rows of tasks that run at once: no tree costs a job. Every task grows them from the same sums; the first returns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, sums, found = block(batches, shape), Sums(folder, tasks), []
        start = start_of(sums.of(starts(b, shape)), shape)
        state = Seen(b.at + start)
        for i in range(shape.trees):
            rows = sees(b, state, i, shape)
            tree = grow(lambda part, *rest: sums.of(part(rows, shape, *rest)), shape)  # noqa: B023
            catch_up(b, state, [tree], shape)
            found.append((start, tree.feature.tolist(), tree.bin.tolist(), tree.value.tolist(), tree.gain.tolist()))
        if sums.at == 0:
            kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], ["start", "feature", "bin", "value", "gain"])

    return run


def together(read: DataFrame, shape: Shape, tasks: int) -> list[tuple[float, Tree]]:
    """All trees over the blocks of many tasks, each sum a job. Blocks keep predictions up to some tree; workers add the
    trees since then, and hold on to the result while they live."""
    context = read.sparkSession.sparkContext

    def summed(rdd) -> np.ndarray:
        return rdd.treeReduce(np.add) if tasks > FEW_TASKS else reduce(np.add, rdd.collect())

    whole = read.rdd.mapPartitionsWithIndex(lambda i, rows: [(i, block_of(rows, shape))]).persist(StorageLevel.MEMORY_AND_DISK)
    start = start_of(summed(whole.map(lambda r: starts(r[1], shape))), shape)
    blocks = first = whole.mapValues(lambda b: replace(b, at=b.at + start))
    grown: list[Tree] = []
    base = 0
    for i in range(shape.trees):
        if i - base == KEPT:
            every = context.broadcast(list(grown))

            def kept(r, every=every):
                state = Seen(r[1].at + start)
                catch_up(r[1], state, every.value, shape)
                return r[0], replace(r[1], at=state.at)

            base, older, blocks = i, blocks, whole.map(kept).persist(StorageLevel.MEMORY_AND_DISK)
            blocks.count()
            if older is not first:
                older.unpersist()
        since, base_now = list(grown[base:]), base

        def rows_of(r, since=since, base=base_now, i=i):
            state = seen(shape, r[0], r[1], base)
            catch_up(r[1], state, since[state.trees - base :], shape)
            return sees(r[1], state, i, shape)

        rows = blocks.map(rows_of).persist(StorageLevel.MEMORY_AND_DISK)  # all sums of a tree read them
        grown.append(grow(lambda part, *rest: summed(rows.map(lambda r: part(r, shape, *rest))), shape))  # noqa: B023
        rows.unpersist()
    blocks.unpersist()
    whole.unpersist()
    return [(start, tree) for tree in grown]
