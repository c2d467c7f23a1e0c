"""Huber boosting against a plain version, row by row and with exact quantiles; the bootstrap against repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskledger.operators import boosting as B
from riskledger.operators import evaluate as E


def weighted_quantile(values, weights, share):
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return values[order][np.searchsorted(upto, share * upto[-1], "left")]


def plain_tree(x, g, w, min_leaf, depth, rows, assign):
    """Grow by trying every cut at every value; assign gets (feature, cut) paths as lists of row indexes of leaves."""
    best = (1e-12, None)
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= min_leaf:
                    lw, rw = w[left].sum(), w[right].sum()
                    gain = lw * rw / (lw + rw) * ((g[left] * w[left]).sum() / lw - (g[right] * w[right]).sum() / rw) ** 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, cut))
    if best[1] is None:
        assign.append(([], rows))
        return
    f, cut = best[1]
    for side, keep in ((0, x[rows, f] <= cut), (1, x[rows, f] > cut)):
        inner = []
        plain_tree(x, g, w, min_leaf, depth - 1, rows[keep], inner)
        assign.extend(([(f, cut, side), *path], leaf) for path, leaf in inner)


def plain_boosting(x, y, w, k, *, trees, depth, rate, subsample, min_leaf, alpha, seed):
    at = np.full(len(y), weighted_quantile(y, w, 0.5) if alpha is not None else np.average(y, weights=w))
    for t in range(trees):
        own = np.flatnonzero(B.sampled(k, t, subsample, seed))
        r = y - at
        delta = None if alpha is None else weighted_quantile(np.abs(r[own]), w[own], alpha)
        g = r if delta is None else np.clip(r, -delta, delta)
        leaves = []
        plain_tree(x, g, w, min_leaf, depth, own, leaves)
        step = np.zeros(len(y))
        for path, rows in leaves:
            if delta is None:
                value = np.average(r[rows], weights=w[rows])
            else:
                median = weighted_quantile(r[rows], w[rows], 0.5)
                value = median + np.average(np.clip(r[rows] - median, -delta, delta), weights=w[rows])
            inside = np.ones(len(y), bool)
            for f, cut, side in path:
                inside &= (x[:, f] > cut) == bool(side)
            step[inside] = value
        at = at + rate * step
    return at


@pytest.mark.parametrize("alpha", [0.9, None])
def test_trees_against_plain_version(spark, alpha):
    rng = np.random.default_rng(3)
    n = 2000
    x = np.stack([rng.integers(0, 40, n), rng.integers(0, 5, n), rng.integers(0, 12, n)], axis=1).astype(float)
    y = np.clip(2 * x[:, 0] + 6 * (x[:, 1] == 2) * x[:, 2] + rng.normal(0, 3, n) + (rng.random(n) < 0.03) * 60, 0, 200)
    w = np.where(y > 60, 3.0, 1.0)
    rows = spark.createDataFrame([(str(i), *map(float, x[i]), float(y[i]), float(w[i])) for i in range(n)], "id string, a double, b double, c double, y double, w double").repartition(5)
    options = {"trees": 8, "depth": 3, "rate": 0.3, "subsample": 0.8, "min_leaf": 3, "alpha": alpha, "seed": 42}
    model = B.fit(rows, ["a", "b", "c"], "y", "w", "id", rows_per_task=600, **options)
    got = np.array([r["prediction"] for r in model.transform(rows).select("prediction", F.col("id").cast("int").alias("i")).orderBy("i").collect()])
    k = np.array([r["k"] for r in rows.select(F.xxhash64("id").alias("k"), F.col("id").cast("int").alias("i")).orderBy("i").collect()])
    want = plain_boosting(x, y, w, k, **options)
    assert np.abs(got - want).mean() < 0.02 and np.abs(got - want).max() < 0.5  # what histograms round
    assert np.abs(got - y).mean() < np.abs(y - np.median(y)).mean() / 2
    shares = model.importances()
    assert shares.sum() == pytest.approx(1) and shares.argmax() == 0


def test_outliers_pull_huber_less(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x, wild = rng.integers(0, 30, n).astype(float), rng.random(n) < 0.04
    y = np.where(wild, 500.0, x)
    rows = spark.createDataFrame([(str(i), float(x[i]), float(y[i])) for i in range(n)], "id string, a double, y double").withColumn("w", F.lit(1.0))
    error = {}
    for alpha in (0.9, None):
        model = B.fit(rows, ["a"], "y", "w", "id", trees=40, depth=3, rate=0.2, subsample=0.8, min_leaf=3, alpha=alpha)
        error[alpha] = np.abs(model.predict(x[~wild][:, None]) - x[~wild]).mean()
    assert error[0.9] < 3 < error[None]


def test_predictions_are_kept_and_models_reload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "KEPT", 3)
    monkeypatch.setattr(B, "FEW_TASKS", 0)
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 17).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), (F.col("id") % 17 * 2.0).alias("y"), F.lit(1.0).alias("w"))
    options = {"depth": 2, "rate": 0.3, "subsample": 0.8, "min_leaf": 3, "alpha": 0.9}
    model = B.fit(rows, ["a", "b"], "y", "w", "id", trees=10, **options)
    monkeypatch.setattr(B, "KEPT", 25)
    monkeypatch.setattr(B, "FEW_TASKS", 16)
    other = B.fit(rows, ["a", "b"], "y", "w", "id", trees=10, **options)
    x = np.stack([np.arange(17.0), np.zeros(17)], axis=1)
    assert np.allclose(model.predict(x), other.predict(x))
    model.save(spark, f"file://{tmp_path}/m")
    assert np.array_equal(B.Forest.load(spark, f"file://{tmp_path}/m").predict(x), model.predict(x))
    assert B.fit(rows.limit(0), ["a", "b"], "y", "w", "id", trees=3, **options).predict(x).tolist() == [0.0] * 17
    one = B.fit(rows.limit(1), ["a", "b"], "y", "w", "id", trees=3, **options)
    assert len(one.feature) == 3 and not np.isnan(one.predict(x)).any()


def test_resampled_sums_against_repeated_rows(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"), F.rand(4).alias("v")).repartition(4).cache()
    many = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(20))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(42), "k", "b"), 11) / float(1 << 53)
    w = sum(((u > float(e)).cast("int") for e in E.poisson_edges()), F.lit(0))
    want = {(r.g, r.b): (r.n, r.s) for r in many.groupBy("g", "b").agg(F.sum(w).alias("n"), F.sum(w * F.col("v")).alias("s")).collect()}
    found = E.resampled_sums(rows, "k", {"s": F.col("v")}, resamples=20, seed=42, group=F.col("g"))
    assert "Generate" not in found._jdf.queryExecution().toString()
    got = {(r.g, r.b): (r.n, r.s) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_model_of_squared_loss_reloads(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2.0).alias("y"), F.lit(1.0).alias("w"))
    model = B.fit(rows, ["a"], "y", "w", "id", trees=2, depth=2, rate=0.3, subsample=0.8, min_leaf=3, alpha=None)
    model.save(spark, f"file://{tmp_path}/m")
    x = np.arange(7.0)[:, None]
    assert np.array_equal(B.Forest.load(spark, f"file://{tmp_path}/m").predict(x), model.predict(x))


def test_jobs_do_not_grow_with_trees(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2.0).alias("y"), F.lit(1.0).alias("w"))
    jobs = []
    for trees in (2, 12):
        spark.sparkContext.setJobGroup(f"trees-{trees}", "")
        B.fit(rows, ["a"], "y", "w", "id", trees=trees, depth=2, rate=0.3, subsample=0.8, min_leaf=3, alpha=0.9)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees-{trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_one_task_grows_the_trees_of_many(spark, monkeypatch):
    monkeypatch.setattr(B, "KEPT", 3)
    rows = spark.range(900).select(F.col("id").cast("string").alias("id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 17 * 2.0 + F.col("id") % 5).alias("y"), F.lit(1.0).alias("w"))
    options = {"trees": 10, "depth": 3, "rate": 0.3, "subsample": 0.8, "min_leaf": 3, "alpha": 0.9}
    one, many = (B.fit(rows, ["a", "b"], "y", "w", "id", rows_per_task=n, **options) for n in (1000, 300))
    x = np.stack([np.arange(17.0), np.arange(17.0) % 5], axis=1)
    assert np.allclose(one.predict(x), many.predict(x))


def test_jobs_of_many_tasks_do_not_grow_with_trees(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2.0).alias("y"), F.lit(1.0).alias("w"))
    jobs = []
    for trees in (2, 12):
        spark.sparkContext.setJobGroup(f"many-{trees}", "")
        B.fit(rows, ["a"], "y", "w", "id", trees=trees, depth=2, rate=0.3, subsample=0.8, min_leaf=3, alpha=0.9, rows_per_task=150)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"many-{trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


@pytest.mark.parametrize("alpha", [0.9, None])
def test_tasks_at_once_and_jobs_agree(spark, monkeypatch, alpha):
    monkeypatch.setattr(B, "KEPT", 3)
    rng = np.random.default_rng(8)
    n, names = 1500, [f"c{i}" for i in range(9)]
    x = np.stack([rng.normal(size=n), rng.normal(size=n), *(rng.random((5, n)) < 0.3).astype(float), rng.integers(0, 5, n), np.ones(n)], axis=1)
    y = 10 * x[:, 0] + 4 * x[:, 3] * x[:, 7] + rng.normal(size=n)
    rows = spark.createDataFrame([(str(i), *map(float, x[i]), float(y[i]), float(1 + i % 3)) for i in range(n)], "id string, " + ", ".join(f"{c} double" for c in names) + ", y double, w double").repartition(3).cache()
    options = {"trees": 8, "depth": 4, "rate": 0.3, "subsample": 0.8, "min_leaf": 3, "alpha": alpha}
    found = [B.fit(rows, names, "y", "w", "id", rows_per_task=k, **options) for k in (2000, 400)]
    monkeypatch.setattr(B, "at_once", lambda *_: 0)
    found.append(B.fit(rows, names, "y", "w", "id", rows_per_task=400, **options))
    monkeypatch.setattr(B, "LEAST_CODES", 1)  # a column a feature
    monkeypatch.setattr(B, "MOST_CODES", 1)
    found.append(B.fit(rows, names, "y", "w", "id", rows_per_task=2000, **options))
    want = found[0].predict(x)
    assert np.abs(want - y).mean() < np.abs(y - y.mean()).mean() / 3
    for other in found[1:]:
        assert np.allclose(other.predict(x), want) and np.allclose(other.importances(), found[0].importances())


def test_packed_histograms_are_those_of_single_features():
    rng = np.random.default_rng(2)
    bins, n = [6, 2, 2, 5, 64, 2, 3], 4000
    x = np.stack([rng.integers(0, b, n) for b in bins])
    shape = B.Shape("m", bins, B.packing(bins, 64), 0.0, 1.0, 1, 2, 0.1, 0.8, 3, None, 1)
    assert sorted(f for fs in shape.columns for f in fs) == list(range(7)) and max(shape.codes) <= 64 and len(shape.columns) < 7
    block = {"x": x.T.astype(np.uint8).tobytes(), "y": rng.random(n).tobytes(), "w": rng.random(n).tobytes(), "k": np.arange(n).tobytes()}
    b = B.block_of([block], shape)
    tree = B.Tree.empty(2)
    tree.feature[:3], tree.bin[:3] = [4, 0, 3], [30, 2, 1]
    rows = b.x, b.y, b.w
    node = np.where(x[4] > 30, 2 + (x[3] > 1), x[0] > 2)
    assert np.array_equal(B.nodes(b.x, tree, 2, shape), node[np.lexsort((b.y, b.k))])
    got = B.histogram(rows, shape, tree, 2, 0.5, np.array([1, 2]))
    g = np.minimum(b.y, 0.5) * b.w
    for i, wanted in enumerate((1, 2)):
        own = node == wanted
        want = np.concatenate([np.stack([np.bincount(x[f][own], v[own], bins[f]) for v in (g, b.w, np.ones(n))], axis=-1) for f in range(7)])
        assert np.allclose(got[i], want)


def test_tasks_for_rows_and_slots():
    assert [B.tasks_for(n, 100, 12) for n in (1, 100, 101, 1200, 1201, 12000, 12001)] == [1, 1, 2, 12, 12, 12, 13]


def test_frames_read_facts_once(spark):
    from riskledger.operators import features as X
    from riskledger.plans import catalog, learned
    from riskledger.plans.bindings import CUTOFF

    plain = catalog.Tables(spark, "/root/testdata/sf0.001")
    once = learned.Written(spark, "/root/testdata/sf0.001")
    got = {r.estab: r for r in learned.frame(once).collect()}
    for df in (once.history, once.outcomes):  # what a frame is made of comes from written tables, not from lines and events once more
        assert not [f for f in df.inputFiles() if "testdata" in f]
    want = X.feature_frame(X.establishment_features(plain.facts.filter(F.col("open_date") < F.lit(CUTOFF)), CUTOFF)).join(plain.history.select("estab", F.col("raw_score").alias("label")), "estab")
    later = plain.outcomes.select("estab", F.coalesce("swr", F.lit(0)).alias("swr"), F.col("has_future_data").cast("int").alias("again"))
    rows = want.join(later, "estab").fillna(0.0).collect()
    assert len(rows) == len(got) > 100
    for r in rows:
        assert all(got[r.estab][c] == pytest.approx(r[c]) for c in r.asDict() if c != "estab")
