"""Boosted trees against a plain numpy version, single fits and hand-made cases."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forecastlab.plans import boosting
from forecastlab.plans.boosting import Job, Params


def panel(n=900, seed=1, noise=0.3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 12, n).astype(float), rng.normal(size=n).round(1), rng.integers(0, 3, n).astype(float)
    y = np.sin(a) + np.where(b > 0.3, 1.0, -0.5) * (c + 1) + noise * rng.normal(size=n)
    b[rng.random(n) < 0.2] = np.nan
    return pd.DataFrame({
        "id": np.arange(n), "a": a, "b": b, "c": c, "y": y, "w": rng.integers(1, 5, n).astype(float), "em": rng.integers(0, 4, n), "held": rng.random(n) < 0.25,
        "f0": "clash", "slot": "clash", "margins": 1,
    })


def to_spark(spark, frame):
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in frame.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, w double, em long, held boolean, f0 string, slot string, margins long")


FEATURES = ["a", "b", "c"]


class Plain:
    """The same trees by trying every cut of every node."""

    def __init__(self, x, y, w, edges, p, held=None):
        self.p, self.edges = p, edges
        self.x, self.y, self.w = x, y, w
        self.base = float((w * y).sum() / w.sum())
        self.trees, margin = [], np.full(len(y), self.base)
        scores = []
        if held is not None:
            hx, hy, hw = held
        for t in range(p.rounds + 1):
            if held is not None:
                e = hy - self.predict(hx)
                scores.append(math.sqrt((hw * e * e).sum() / hw.sum()))
                if t - int(np.argmin(scores)) >= p.patience:
                    break
            if t == p.rounds:
                break
            tree = self.grow(np.arange(len(y)), w * (margin - y), 0)
            self.trees.append(tree)
            margin = margin + np.array([self.one(tree, r) for r in x])
        self.scores = scores
        if held is not None:
            self.trees = self.trees[: int(np.argmin(scores))]

    def score(self, g, h):
        return max(abs(g) - self.p.reg_alpha, 0.0) ** 2 / (h + self.p.reg_lambda)

    def grow(self, rows, grad, depth):
        g, h = grad[rows].sum(), self.w[rows].sum()
        best = None
        if depth < self.p.depth:
            for f, cuts in enumerate(self.edges):
                v = self.x[rows, f]
                for cut in [*cuts, math.inf]:
                    for missing_left in (True, False):
                        left = (v <= cut) | (np.isnan(v) if missing_left else False)
                        gl, hl = grad[rows[left]].sum(), self.w[rows[left]].sum()
                        if min(hl, h - hl) < max(self.p.min_child, 1e-9):
                            continue
                        gain = self.score(gl, hl) + self.score(g - gl, h - hl) - self.score(g, h)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, cut, missing_left, left)
        if best is None or best[0] <= 1e-6 or best[0] < self.p.gamma:
            soft = math.copysign(max(abs(g) - self.p.reg_alpha, 0.0), g)
            return -self.p.eta * soft / (h + self.p.reg_lambda)
        gain, f, cut, missing_left, left = best
        return f, cut, missing_left, self.grow(rows[left], grad, depth + 1), self.grow(rows[~left], grad, depth + 1)

    def one(self, tree, row):
        while isinstance(tree, tuple):
            f, cut, missing_left, low, high = tree
            tree = low if (missing_left if math.isnan(row[f]) else row[f] <= cut) else high
        return tree

    def predict(self, x):
        return self.base + np.array([sum(self.one(t, r) for t in self.trees) for r in x])


def arrays(frame):
    return frame[FEATURES].to_numpy(float), frame["y"].to_numpy(float), frame["w"].to_numpy(float)


@pytest.mark.parametrize("params", [
    Params(rounds=3, depth=3, eta=0.5),
    Params(rounds=2, depth=4, eta=1.0, reg_lambda=0.0, reg_alpha=3.0, gamma=5.0, min_child=20.0),
    Params(rounds=2, depth=2, eta=0.3, reg_lambda=50.0, grow="lossguide"),
])
def test_trees_equal_trying_every_cut(spark, params):
    frame = panel()
    rows = to_spark(spark, frame).repartition(5)
    edges = boosting.bin_edges(rows, FEATURES)
    model = boosting.fit(rows, FEATURES, "y", [Job("m", params)], "w", edges=edges)[0]
    x, y, w = arrays(frame)
    plain = Plain(x, y, w, edges, params)
    got = boosting.predict([model], rows, "p").select("id", "p").toPandas().sort_values("id")["p"].to_numpy()
    assert model.n_trees == params.rounds
    assert np.allclose(got, plain.predict(x), atol=1e-9)


def test_edges_of_few_and_many_values(spark):
    rows = spark.createDataFrame([(float(k % 7), float(k), None, float("nan")) for k in range(5000)], "a double, b double, c double, d double")
    few, many, none, nan = boosting.bin_edges(rows, ["a", "b", "c", "d"], 32)
    assert few.tolist() == [0, 1, 2, 3, 4, 5] and len(none) == len(nan) == 0
    assert len(many) == 31 and np.all(np.abs(np.diff(many) - 5000 / 32) < 10)
    assert boosting.bins_of(np.array([[0.0, -5.0, 1.0, np.nan], [6.5, 1e9, 0.0, 1.0]]), [few, many, none, nan]).tolist() == [[0, 0, 0, 255], [6, 31, 0, 0]]


def test_a_dip_is_passed_over(spark):
    """One more tree makes the holdout worse, later ones better than ever: patience goes on, no patience stops before."""
    rng = np.random.default_rng(3)
    n = 4000
    a, c = rng.integers(0, 2, n).astype(float), rng.integers(0, 2, n).astype(float)
    held = np.arange(n) % 4 == 0
    # What the first split is made for hardly holds in the holdout, the second one holds in both.
    y = np.where(held, 0.2, 1.0) * (a - 0.5) * 3 + (c - 0.5) * 2.5
    frame = pd.DataFrame({"id": np.arange(n), "a": a, "b": 0.0, "c": c, "y": y, "w": 1.0, "em": 0, "held": held, "f0": "", "slot": "", "margins": 1})
    rows = to_spark(spark, frame)
    shape = dict(rounds=12, depth=1, eta=0.7, reg_lambda=0.0)
    jobs = [Job("patient", Params(patience=5, **shape)), Job("hasty", Params(patience=1, **shape))]
    patient, hasty = boosting.fit(rows, FEATURES, "y", jobs, held=F.col("held"))
    assert patient.history[1] > patient.history[0] and min(patient.history) < patient.history[0]
    assert hasty.n_trees == 0 and patient.n_trees == int(np.argmin(patient.history)) > 0
    assert len(patient.history) - 1 - patient.n_trees == 5 or len(patient.history) == 13
    plain = Plain(*arrays(frame[~frame.held]), patient.edges, jobs[0].params, arrays(frame[frame.held]))
    assert np.allclose(patient.history, plain.scores) and len(plain.trees) == patient.n_trees


def test_holdout_error_equals_sql_over_predictions(spark):
    frame = panel(1500, 5)
    rows = to_spark(spark, frame)
    model = boosting.fit(rows, FEATURES, "y", [Job("m", Params(rounds=60, depth=2, eta=0.6, patience=3))], "w", held=F.col("held"))[0]
    told = boosting.predict([model], rows.filter("held"), "p").select("y", "w", "p").toPandas()  # noqa: F841
    rmse = duckdb.sql("SELECT sqrt(sum(w * (y - p) ** 2) / sum(w)) FROM told").fetchall()[0][0]
    assert 0 < model.n_trees < 60 and math.isclose(rmse, min(model.history), rel_tol=1e-9)
    plain = Plain(*arrays(frame[~frame.held]), model.edges, model.params, arrays(frame[frame.held]))
    assert len(plain.trees) == model.n_trees and np.allclose(plain.scores, model.history)


def test_many_models_in_one_go_equal_single_fits(spark):
    frame = panel(1600, 6)
    rows = to_spark(spark, frame).repartition(3)
    params = Params(rounds=6, depth=2, eta=0.5, patience=3)
    edges = boosting.bin_edges(rows, FEATURES)
    slots = {"0": (0, 1), "2": (2, 3), "below 3": (0, 3), "none": (7, 9), "other holdout": (1, 2, (0, 4))}
    jobs = [Job(k, params, v[0], v[1], v[2] if len(v) > 2 else None) for k, v in slots.items()]
    together = boosting.fit(rows, FEATURES, "y", jobs, "w", F.col("em"), F.col("held"), edges=edges)
    for job, model in zip(jobs, together):
        own = rows.filter((~F.col("held") & F.col("em").between(job.low, job.high - 1)) | (F.col("held") & F.col("em").between((job.held or (job.low,))[0], (job.held or (0, job.high))[1] - 1)))
        alone = boosting.fit(own, FEATURES, "y", [Job(job.name, params)], "w", held=F.col("held"), edges=edges)[0]
        assert model.n_trees == alone.n_trees and np.allclose(model.history, alone.history)
        if job.name != "none":
            assert [r[2:6] for r in model.splits()] == [r[2:6] for r in alone.splits()]
    assert together[3].base is None and together[3].n_trees == 0
    which = F.when(F.col("em") == 0, 0).when(F.col("em") == 2, 1).when(F.col("em") == 3, 3)
    told = boosting.predict(together, rows, "p", which).toPandas()
    assert told["p"].isna().equals(~told["em"].isin([0, 2]))


def test_months_learn_from_all_rows_before_them(spark):
    frame = panel(1200, 7)
    rows = to_spark(spark, frame)
    params = Params(rounds=4, depth=3, eta=0.5)
    edges = boosting.bin_edges(rows, FEATURES)
    models = boosting.fit(rows, FEATURES, "y", [Job(str(k), params, high=k) for k in range(5)], "w", F.col("em"), edges=edges)
    assert models[0].base is None
    for k in range(1, 5):
        x, y, w = arrays(frame[frame.em < k])
        got = boosting.predict(models, rows.withColumn("k", F.lit(k)), "p", F.col("k")).select("id", "p").toPandas().sort_values("id")["p"]
        assert np.allclose(got, Plain(x, y, w, edges, params).predict(arrays(frame)[0]), atol=1e-9)


def test_margins_are_renewed(spark, monkeypatch):
    frame = panel(500, 8)
    rows, params = to_spark(spark, frame), Params(rounds=7, depth=2, eta=0.4)
    edges = boosting.bin_edges(rows, FEATURES)
    jobs = [Job("all", params), Job("some", params, 0, 2), Job("nothing", params, 50, 60)]
    whole = boosting.fit(rows, FEATURES, "y", jobs, "w", F.col("em"), edges=edges)
    monkeypatch.setattr(boosting, "RENEW", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    monkeypatch.setattr(boosting, "HELD_MEMORY", 1000)
    again = boosting.fit(rows, FEATURES, "y", jobs, "w", F.col("em"), edges=edges)
    for one, other in zip(whole, again):
        assert [r[2:6] for r in one.splits()] == [r[2:6] for r in other.splits()] and one.n_trees == other.n_trees
        assert np.allclose([r[-1] or 0 for r in one.splits()], [r[-1] or 0 for r in other.splits()])


def test_random_rows_and_columns(spark):
    rows = to_spark(spark, panel(2000, 9))
    shape = dict(rounds=6, depth=3, eta=0.3, subsample=0.5, colsample=0.34)
    first, same, other = boosting.fit(rows, FEATURES, "y", [Job("a", Params(**shape)), Job("b", Params(**shape)), Job("c", Params(seed=5, **shape))])
    assert [r[1:] for r in first.splits()] == [r[1:] for r in same.splits()] != [r[1:] for r in other.splits()]
    for t in range(6):
        assert len({r[3] for r in first.splits() if r[1] == t and r[3]}) <= 1
        root = next(r for r in first.splits() if r[1] == t and r[2] == 0)
        assert 850 < root[7] < 1150  # about half of the rows


def test_leaf_wise_growth(spark):
    rows = to_spark(spark, panel(1500, 10))
    shape = dict(rounds=1, depth=5, eta=1.0)
    deep, few = boosting.fit(rows, FEATURES, "y", [Job("deep", Params(**shape)), Job("few", Params(grow="lossguide", max_leaves=4, **shape))], "w")
    inner = {r[2]: r for r in deep.splits() if r[3]}
    kept = [r for r in few.splits() if r[3]]
    assert len(kept) == 3 and sum(r[3] is None for r in few.splits()) == 4
    # Best first: every split that was left out and could have been made gains no more than those made.
    open_ = [inner[n] for r in kept for n in (r[8], r[9]) if n in inner and n not in {k[2] for k in kept}]
    assert max(r[6] for r in open_) <= min(r[6] for r in kept[1:]) + 1e-9


def test_quantile_models(spark):
    rng = np.random.default_rng(11)
    n = 4000
    a = rng.integers(0, 10, n).astype(float)
    y = a + (1 + a / 3) * rng.normal(size=n)
    frame = pd.DataFrame({"id": np.arange(n), "a": a, "b": 0.0, "c": 0.0, "y": y, "w": 1.0, "em": 0, "held": np.arange(n) % 3 == 0, "f0": "", "slot": "", "margins": 1})
    rows = to_spark(spark, frame)
    shape = dict(rounds=5, depth=3, eta=0.5, patience=3)
    jobs = [Job(str(q), Params(quantile=q, **shape)) for q in (0.05, 0.95)]
    models = boosting.fit(rows, FEATURES, "y", jobs, held=F.col("held"))
    learnt = frame[~frame.held]["y"]
    assert all(math.isclose(m.base, learnt.quantile(q)) for m, q in zip(models, (0.05, 0.95)))  # the one-leaf case
    held = rows.filter("held")
    told = boosting.predict([models[1]], boosting.predict([models[0]], held, "low"), "high").toPandas()
    assert 0.02 < (told.y < told.low).mean() < 0.08 and 0.02 < (told.y > told.high).mean() < 0.08
    widths = (told.high - told.low).groupby(told.a).mean()
    assert widths[9] > 2 * widths[0]
    assert all(m.n_trees > 0 and min(m.history) < m.history[0] for m in models)


def test_poor_trials_end(spark):
    rows = to_spark(spark, panel(1500, 12))
    jobs = [Job(f"d{d}", Params(rounds=7, depth=d, eta=0.3, patience=7)) for d in (1, 3, 3, 4)]
    models = boosting.fit(rows, FEATURES, "y", jobs, held=F.col("held"), prune_after=3)
    assert len(models[0].history) == 4 and max(len(m.history) for m in models) > 5


def test_no_rows_and_rows_that_take_no_part(spark):
    rows = to_spark(spark, panel(60, 13))
    model = boosting.fit(rows.limit(0), FEATURES, "y", [Job("m", Params(rounds=3))])[0]
    assert model.base is None and model.n_trees == 0
    assert boosting.predict([model], rows, "p").filter("p IS NOT NULL").count() == 0
    odd = rows.withColumn("y", F.when(F.col("id") < 50, F.lit(None)).when(F.col("id") < 52, F.lit(float("nan"))).otherwise(2.0))
    model = boosting.fit(odd, FEATURES, "y", [Job("m", Params(rounds=3))], "w")[0]
    assert model.base == 2.0 and model.n_trees == 0  # nothing to split
    assert boosting.predict([model], rows, "p").filter("p <> 2").count() == 0


def test_importance_and_table_of_splits(spark):
    rows = to_spark(spark, panel(1500, 14))
    model = boosting.fit(rows, FEATURES, "y", [Job("m", Params(rounds=3, depth=2))])[0]
    table = boosting.split_table(spark, [model]).toPandas()
    gains = table[table.feature.notna()].groupby("feature")["gain"].mean()
    for feature, share in model.importance():
        assert math.isclose(share, gains.get(feature, 0.0) / gains.sum(), abs_tol=1e-12)
    assert len(table[table.tree == 0]) == 7 and table[table.feature.isna()]["value"].notna().all()


def test_large_models_grow_by_level(spark, monkeypatch):
    """A model whose rows one task has and one that takes a job a level have the same trees."""
    rows = to_spark(spark, panel(900, 21)).repartition(6, "id")
    shape = {"rounds": 6, "depth": 3, "patience": 9}
    jobs = [
        Job("plain", Params(**shape)), Job("drawn", Params(subsample=0.6, colsample=0.7, **shape)), Job("q", Params(quantile=0.8, **shape)),
        Job("few", Params(grow="lossguide", max_leaves=3, **shape)), Job("part", Params(**shape), high=2),
    ]
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    edges = boosting.bin_edges(rows, FEATURES)
    blocks = boosting.binned_blocks(rows, FEATURES, "y", edges, "w", F.col("em"), F.col("held"))
    whole = boosting.fit_blocks(blocks, FEATURES, edges, jobs)
    monkeypatch.setattr(boosting, "RENEW", 4)
    monkeypatch.setattr(boosting, "TASK_ROWS", 400)  # "part" stays below
    other = boosting.fit_blocks(blocks, FEATURES, edges, jobs)
    bins = boosting.bins_of(panel(900, 21)[FEATURES].to_numpy(), edges)
    for a, b in zip(whole, other):
        assert a.n_trees == b.n_trees and np.allclose(a.history, b.history) and np.allclose(a.margins(bins), b.margins(bins))


def test_trees_take_few_jobs(spark):
    """Thirty trees of depth four are grown and scored in a handful of jobs; a job a level took 120 and more."""
    rows = to_spark(spark, panel(300, 22))
    edges = boosting.bin_edges(rows, FEATURES)
    blocks = boosting.binned_blocks(rows, FEATURES, "y", edges, held=F.col("held"))
    context = spark.sparkContext
    context.setJobGroup("few jobs", "")
    try:
        model = boosting.fit_blocks(blocks, FEATURES, edges, [Job("m", Params(rounds=30, depth=4, patience=30))])[0]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.history) == 31
    assert len(context.statusTracker().getJobIdsForGroup("few jobs")) <= 20


def test_the_fuller_node_of_a_split_is_what_is_left(monkeypatch):
    """Below the root a task adds up at most half of the rows of a level; the sums are those of adding up all of them, and 0 in bins without rows."""
    frame = panel(900, 23)
    x, y, w = arrays(frame)
    edges = [np.unique(v[~np.isnan(v)])[:-1] for v in x.T]
    bins, n_bins = boosting.bins_of(x, edges), max(map(len, edges)) + 2
    rows = boosting._Rows([(0, bins, y, w, np.full(len(y), y.mean()))], 3)
    grad, node = w * (rows.margin - y), (x[:, 0] > 3) * 1
    above = rows.sums(np.zeros(len(y), np.int64), 1, [0, 1, 2], grad, n_bins)
    whole, told = rows.sums(node, 2, [0, 1, 2], grad, n_bins), rows.sums_below(node, above, [0, 1, 2], grad, n_bins)
    assert np.allclose(told, whole, atol=1e-9) and np.array_equal(told[2], whole[2]) and not told[:, whole[2] == 0].any()
    read, sums = [], boosting._Rows.sums

    def counted(self, place, nodes, *others):
        read.append((nodes, int((place >= 0).sum())))
        return sums(self, place, nodes, *others)

    monkeypatch.setattr(boosting._Rows, "sums", counted)
    trees = boosting._grown_here(Params(depth=4), 0, 3, rows, n_bins)
    assert len(trees) == 3 and len(read) > 6
    assert all(n <= len(y) // 2 for k, (_, n) in enumerate(read) if k % 4), read
    assert [n for k, (_, n) in enumerate(read) if k % 4 == 0] == [len(y)] * 3


def test_walks_are_made_once_a_task():
    """A model's trees are laid out once and then take any number of batches, missing values included."""
    tree = boosting.Tree()
    boosting._apply({(0, 0): {"feature": 1, "gain": 9.0, "cut": 2, "missing_left": True, "grad_left": 1.0, "hess_left": 1.0, "grad": 2.0, "hess": 2.0}}, [Job("m")], {0: tree}, 0)
    boosting._apply({(0, 2): {"feature": 0, "gain": 9.0, "cut": 0, "missing_left": False, "grad_left": 1.0, "hess_left": 1.0, "grad": 1.0, "hess": 1.0}}, [Job("m")], {0: tree}, 1)
    tree.value = [0.0, 10.0, 0.0, 30.0, 40.0]
    walk = boosting._Walk(tree)
    bins = np.array([[0, 2], [0, 255], [0, 3], [1, 254], [255, 3]], np.uint8)
    assert walk.leaf(bins).tolist() == tree.leaf_of(bins).tolist() == [1, 1, 3, 4, 4]
    model = boosting.Boosted("m", ["a", "b"], [np.zeros(1), np.zeros(1)], Params(), 1.0, [tree])
    assert model.margins(bins, [walk]).tolist() == model.margins(bins).tolist() == [11.0, 11.0, 31.0, 41.0, 41.0]
    assert boosting._Walk(boosting.Tree()).leaf(bins).tolist() == [0] * 5


def test_edges_read_the_rows_twice(spark, monkeypatch):
    """One pass counts distinct values, one reads sets and quantiles; quantiles of features with few values are not asked for."""
    asked, quantile = [], F.percentile_approx
    monkeypatch.setattr(boosting.F, "percentile_approx", lambda *a: asked.append(a) or quantile(*a))
    rows = spark.createDataFrame([(float(k % 7), float(k)) for k in range(3000)], "a double, b double")
    few, many = boosting.bin_edges(rows, ["a", "b"], 32)
    assert len(asked) == 1 and few.tolist() == [0, 1, 2, 3, 4, 5] and len(many) == 31


def test_features_share_codes(monkeypatch):
    """One pass counts several features, and the sums are those of each feature alone, missing values and fractions of weights included."""
    rng = np.random.default_rng(31)
    n, widths = 5000, [2, 2, 8, 65, 65, 30, 64, 5]
    bins = np.column_stack([rng.integers(0, k, n) for k in widths]).astype(np.uint8)
    bins[rng.random(n) < 0.2, 3:5] = boosting.MISSING
    y, n_bins, calls, counted = rng.normal(size=n), 66, [], np.bincount
    node = rng.integers(-1, 3, n)
    node[:4000] = np.minimum(node[:4000], 1)  # one node has few rows
    for w in (np.ones(n), rng.integers(1, 9, n).astype(float), rng.random(n) + 0.1):
        rows = boosting._Rows([(0, bins[:3000], y[:3000], w[:3000], y[:3000]), (1, bins[3000:], y[3000:], w[3000:], y[3000:])], len(widths))
        told = rows.sums(node, 3, list(range(len(widths))), w * y, n_bins)
        for f in range(len(widths)):
            code = node * n_bins + np.minimum(bins[:, f], n_bins - 1)
            for k, weight in ((0, w * y), (1, w)):
                plain = np.bincount(code[node >= 0], weight[node >= 0], 3 * n_bins).reshape(3, n_bins)
                assert np.allclose(told[k, :, f], plain) and np.array_equal(told[2, :, f] > 0, plain != 0) or k == 0
        monkeypatch.setattr(boosting.np, "bincount", lambda *a, **k: calls.append(1) or counted(*a, **k))
        calls.clear()
        rows.sums(np.zeros(n, np.int64), 1, list(range(len(widths))), w * y, n_bins, [None])
        monkeypatch.setattr(boosting.np, "bincount", counted)
        assert len(calls) < len(widths) * 2


def test_replaced_blocks_are_deleted(spark, monkeypatch):
    """However many trees there are, the folder keeps the first blocks and no copy of them; quantiles of leaves write nothing."""
    import glob

    from forecastlab.session import shared_dir

    monkeypatch.setattr(boosting, "RENEW", 2)
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    rows = to_spark(spark, panel(600, 32))
    folder = f"{shared_dir(spark).removeprefix('file:')}/forecastlab"
    before = set(glob.glob(f"{folder}/*"))
    model = boosting.fit(rows, FEATURES, "y", [Job("m", Params(rounds=5, depth=2, patience=9, quantile=0.7))], held=F.col("held"))[0]
    written = set(glob.glob(f"{folder}/*")) - before
    assert len(model.history) == 6 and len(written) == 1 and "tree_blocks" in written.pop()
