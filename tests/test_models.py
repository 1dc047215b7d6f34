from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from panelreg.operators.boosting import BoostSettings, fit_boosting, fit_ml_boosting, stop_round
from panelreg.operators.evaluate import group_mae, metric_columns
from panelreg.operators.forest import ForestSettings, bag_stream, feature_share, fit_forest, fit_ml_forest
from panelreg.operators.linear import fit_huber, fit_ols, huber_gradient
from panelreg.functions.hashing import poisson_array
from panelreg.operators.permutation import permutation_importance, permuted, shuffled_errors
from panelreg.operators import preprocess
from panelreg.operators.preprocess import PrepSettings, fit_preparation
from panelreg.operators.validation import split_by_share, split_exact
from panelreg.sources.roles import FeatureColumns

BOTH = FeatureColumns(("a", "b"), ("c",))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame(
        {
            "key": np.arange(n), "a": rng.integers(0, 12, n).astype(float), "b": rng.integers(0, 30, n) / 10.0,
            "c": rng.choice(["u", "v", "w", "z"], n, p=[0.5, 0.3, 0.15, 0.05]),
        }
    )
    pdf["label"] = 0.5 * pdf.a + np.sin(2 * pdf.b) + 2.0 * (pdf.c == "w") + rng.normal(0, 0.2, n)
    frame = spark.createDataFrame(pdf).persist()
    preparation = fit_preparation(frame, BOTH, PrepSettings(drop_first=True))
    prepared = preparation.apply(frame).persist()
    design = prepared.select("key", "label", *preparation.design_columns()).toPandas().sort_values("key")
    return pdf, prepared, preparation, design


def matrix(design):
    return design.drop(columns=["key", "label"]).to_numpy(), design["label"].to_numpy()


def test_metrics_and_constant_target(spark):
    frame = spark.createDataFrame([(2.0, 2.0, 1.0), (2.0, 2.0, 3.0)], "y double, good double, bad double")
    good = frame.agg(*metric_columns("y", "good")).first()
    bad = frame.agg(*metric_columns("y", "bad")).first()
    assert tuple(good) == (0.0, 0.0, 1.0) and tuple(bad) == (1.0, 1.0, 0.0)


def test_groups_without_known_targets_are_listed(spark):
    frame = spark.createDataFrame(
        [("0.0", 1.0, 3.0), ("0.0", 1.0, 1.0), ("1.0", None, 2.0), (None, 1.0, 1.0)], "g string, y double, p double"
    )
    assert [tuple(r) for r in group_mae(frame, "g", "y", "p").collect()] == [("0.0", 1.0), ("1.0", None)]


def test_ols_matches_least_squares(sample):
    _, prepared, preparation, design = sample
    x, y = matrix(design)
    fit = fit_ols(prepared, preparation)
    expected = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    assert [c for _, c in fit.rows()] == pytest.approx(expected.tolist(), rel=1e-8)
    scored = prepared.orderBy("key").select(fit.score()).toPandas().iloc[:, 0]
    assert scored.to_numpy() == pytest.approx(expected[0] + x @ expected[1:])


def test_collinear_ols_is_the_shortest_solution_and_predicts_alike(sample):
    _, prepared, reduced, _ = sample
    frame = prepared.drop(*reduced.prepared_columns)
    full = fit_preparation(frame, BOTH, PrepSettings(drop_first=False))
    rows = full.apply(frame)
    fit = fit_ols(rows, full)
    design = rows.orderBy("key").select("label", *full.design_columns()).toPandas()
    x = np.column_stack([np.ones(len(design)), design.drop(columns="label")])
    assert [c for _, c in fit.rows()] == pytest.approx((np.linalg.pinv(x) @ design["label"]).tolist(), rel=1e-6)
    other = fit_ols(prepared, reduced)
    ours = rows.orderBy("key").select(fit.score()).toPandas().iloc[:, 0].to_numpy()
    theirs = prepared.orderBy("key").select(other.score()).toPandas().iloc[:, 0].to_numpy()
    assert ours == pytest.approx(theirs)


def test_nearly_collinear_columns_keep_their_digits(spark):
    """Against exact fractions; the cross products' condition is beyond what doubles hold."""
    from fractions import Fraction

    rng = np.random.default_rng(1)
    rows = [(float(a), float(a) + 2.0**-12 * float(d), float(3 * a - 500 * d + e)) for a, d, e in rng.integers(0, 4096, (400, 3))]
    frame = spark.createDataFrame(rows, "a double, b double, label double").repartition(7)
    preparation = fit_preparation(frame, FeatureColumns(("a", "b"), ()), PrepSettings())
    design = [[Fraction(1), Fraction(a), Fraction(b)] for a, b, _ in rows]
    target = [Fraction(y) for _, _, y in rows]
    system = [[sum(r[i] * r[j] for r in design) for j in range(3)] + [sum(r[i] * y for r, y in zip(design, target))] for i in range(3)]
    for i in range(3):
        for j in range(3):
            if i != j:
                factor = system[j][i] / system[i][i]
                system[j] = [x - factor * z for x, z in zip(system[j], system[i])]
    expected = [float(system[i][3] / system[i][i]) for i in range(3)]
    assert [c for _, c in fit_ols(preparation.apply(frame), preparation).rows()] == pytest.approx(expected, rel=1e-7)


def test_gradients_give_the_solution_of_the_factor(sample):
    _, prepared, preparation, _ = sample
    dense = fit_ols(prepared, preparation)
    sparse = fit_ols(prepared, preparation, dense_features=0)
    assert [c for _, c in sparse.rows()] == pytest.approx([c for _, c in dense.rows()], rel=1e-8)
    assert set(c for _, c in fit_ols(prepared.limit(0), preparation, dense_features=0).rows()) == {0.0}


def test_gradients_fit_alike_under_collinearity(sample):
    _, prepared, reduced, _ = sample
    frame = prepared.drop(*reduced.prepared_columns)
    full = fit_preparation(frame, BOTH, PrepSettings(drop_first=False))
    rows = full.apply(frame)
    columns = [fit_ols(rows, full, dense_features=n).score().alias(f"p{n}") for n in (0, 1000)]
    found = rows.select(*columns).toPandas()
    assert found["p0"].to_numpy() == pytest.approx(found["p1000"].to_numpy(), abs=1e-8)


def test_least_squares_without_rows_or_with_fewer_than_columns(sample):
    _, prepared, preparation, _ = sample
    assert set(c for _, c in fit_ols(prepared.limit(0), preparation).rows()) == {0.0}
    few = prepared.where("key < 3")
    fit = fit_ols(few, preparation)
    scored = few.select("label", fit.score().alias("p")).toPandas()
    assert scored["p"].to_numpy() == pytest.approx(scored["label"].to_numpy(), abs=1e-8)


def test_huber_is_stationary_and_resists_outliers(sample):
    _, prepared, preparation, _ = sample
    spoiled = prepared.withColumn("label", F.when(F.col("key") % 50 == 0, 500.0).otherwise(F.col("label")))
    fit = fit_huber(spoiled, preparation)
    slopes = huber_gradient(spoiled, fit, 1.35, 1e-4).toPandas()["gradient"]
    assert np.abs(slopes).max() / 3000 < 1e-4
    clean, ols = fit_ols(prepared, preparation), fit_ols(spoiled, preparation)
    assert abs(fit.coefficients[0] - clean.coefficients[0]) < 0.02 < abs(ols.intercept - clean.intercept)


def grow_by_hand(x, g, h, depth, lam, alpha, gamma, mcw, rows, level=0):
    """Best-first search over every threshold of every design column, in plain numpy."""
    pull = lambda v: np.sign(v) * max(abs(v) - alpha, 0)
    value = -pull(g.sum()) / (h.sum() + lam)
    best = None
    if level < depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[1:]:
                right = x[:, f] >= cut
                hr, hl = h[right].sum(), h[~right].sum()
                if hr < mcw or hl < mcw or (h[right] > 0).sum() < rows or (h[~right] > 0).sum() < rows:
                    continue
                gr, gl = g[right].sum(), g[~right].sum()
                gain = pull(gl) ** 2 / (hl + lam) + pull(gr) ** 2 / (hr + lam) - pull(g.sum()) ** 2 / (h.sum() + lam)
                if gain > gamma and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, cut)
    if best is None:
        return np.full(len(x), value)
    right = x[:, best[1]] >= best[2]
    out = np.empty(len(x))
    for side in (right, ~right):
        out[side] = grow_by_hand(x[side], g[side], h[side], depth, lam, alpha, gamma, mcw, rows, level + 1)
    return out


@pytest.mark.parametrize(("refresh", "local"), [(1, 0), (10, 0), (1, 100_000)])
def test_boosting_matches_plain_numpy(sample, refresh, local):
    _, prepared, preparation, design = sample
    x, y = matrix(design)
    settings = BoostSettings(
        n_rounds=3, learning_rate=0.4, max_depth=3, subsample=1.0, column_share=1.0, lambda_=2.0, alpha=0.5,
        gamma=0.5, min_child_weight=5, refresh_rounds=refresh, local_rows=local,
    )
    model = fit_boosting(prepared, preparation, settings)
    expected = np.full(len(y), y.mean())
    for _ in range(3):
        expected += 0.4 * grow_by_hand(x, expected - y, np.ones(len(y)), 3, 2.0, 0.5, 0.5, 5, 1)
    got = prepared.orderBy("key").select(model.score()).toPandas().iloc[:, 0].to_numpy()
    assert got == pytest.approx(expected, abs=1e-9)
    shares = [s for _, s in model.importances()]
    assert sum(shares) == pytest.approx(1.0) and shares == sorted(shares, reverse=True)


@pytest.mark.parametrize("local", [0, 100_000])
def test_forest_matches_plain_numpy(sample, local):
    _, prepared, preparation, design = sample
    x, y = matrix(design)
    settings = ForestSettings(n_trees=3, max_depth=4, min_rows_leaf=7, max_features=1.0, seed=9, local_rows=local)
    forest, binned = fit_forest(prepared, preparation, settings)
    keys = design["key"].to_numpy()
    trees, total, count = [], np.zeros(len(y)), np.zeros(len(y))
    for t in range(3):
        w = poisson_array(keys, bag_stream(9, t)).astype(float)
        drawn = w > 0
        grown = grow_by_hand(x[drawn], -(w * y)[drawn], w[drawn], 4, 0.0, 0.0, 1e-12, 0, 7)
        mine = prepared.orderBy("key").select(_tree_score(forest, t)).toPandas().iloc[:, 0].to_numpy()
        assert mine[drawn] == pytest.approx(grown, abs=1e-9)
        trees.append(mine)
        total[~drawn] += mine[~drawn]
        count[~drawn] += 1
    got = prepared.orderBy("key").select(forest.score()).toPandas().iloc[:, 0].to_numpy()
    assert got == pytest.approx(np.mean(trees, axis=0))
    oob = forest.out_of_bag(binned).select("key", "oob").toPandas().sort_values("key")["oob"].to_numpy()
    assert np.array_equal(np.isnan(oob), count == 0)
    assert oob[count > 0] == pytest.approx((total / np.maximum(count, 1))[count > 0])
    assert sum(s for _, s in forest.importances()) == pytest.approx(1.0)


def _tree_score(forest, number):
    from dataclasses import replace

    return replace(forest, trees=(forest.trees[number],)).score()


def test_unlimited_forest_grows_to_the_leaf_size(sample):
    _, prepared, preparation, _ = sample
    forest, _ = fit_forest(prepared, preparation, ForestSettings(n_trees=2, min_rows_leaf=100, max_features="sqrt"))
    for tree in forest.trees:
        assert tree.depth > 2 and tree.feature.count(-1) == len(tree.feature) // 2 + 1


def test_cells_of_one_level_may_need_several_scans(sample, monkeypatch):
    from panelreg.operators import trees

    _, prepared, preparation, _ = sample
    settings = ForestSettings(n_trees=3, max_depth=3, max_features=1.0, local_rows=0)
    whole, _ = fit_forest(prepared, preparation, settings)
    monkeypatch.setattr(trees, "CELL_BUDGET", 300)
    parts, _ = fit_forest(prepared, preparation, settings)
    assert [t.feature for t in whole.trees] == [t.feature for t in parts.trees]


def test_sampling_and_early_stopping(sample):
    _, prepared, preparation, _ = sample
    rows = split_exact(prepared, "key", 0.2)
    settings = BoostSettings(n_rounds=6, learning_rate=0.9, max_depth=2, subsample=0.8, column_share=0.6, patience=2)
    model = fit_boosting(rows, preparation, settings, fold="fold")
    held = rows.filter("fold = 1").withColumn("p", model.score())
    rmse = held.agg(*metric_columns("label", "p")).first()["RMSE"]
    assert rmse == pytest.approx(min(model.curve), rel=1e-9) and len(model.trees) == int(np.argmin(model.curve)) + 1


def test_patience_rule():
    curve = [5, 4, 3, 3.1, 3.2, 2.9]
    assert stop_round(curve[:4], 2) is None
    assert stop_round(curve[:5], 2) == 3
    assert stop_round(curve, 0) is None


def test_feature_share():
    assert feature_share("sqrt", 37) == 6 and feature_share("log2", 37) == 5
    assert feature_share("0.5", 10) == 5 and feature_share("4", 10) == 4 and feature_share(99, 10) == 10
    with pytest.raises(ValueError):
        feature_share(1.5, 10)


def test_ml_models_learn_the_signal(sample):
    _, prepared, preparation, _ = sample
    for model in (
        fit_ml_forest(prepared, preparation, ForestSettings(n_trees=10, max_depth=6, max_features=0.8)),
        fit_ml_boosting(prepared, preparation, BoostSettings(n_rounds=10, learning_rate=0.3, max_depth=3)),
    ):
        scored = model.transform(preparation.with_vector(prepared))
        assert scored.agg(*metric_columns("label", "prediction")).first()["R2"] > 0.8


def test_ml_fits_deal_their_rows_over_tasks(sample, monkeypatch):
    """Rows that come in one partition are fitted in as many as they need, each with its share, all columns intact."""
    _, prepared, preparation, _ = sample
    n = prepared.count()
    numbers = preparation.width + preprocess.ROW_OVERHEAD + 8
    monkeypatch.setattr(preprocess, "TASK_NUMBERS", -(-n // 5) * numbers)
    seen = []

    def spy(self, rows):
        seen.append([len(part) for part in rows.rdd.glom().collect()])
        assert sorted(map(str, rows.collect())) == sorted(map(str, preparation.with_vector(prepared).select("features", "label").collect()))
        raise InterruptedError

    for estimator, fit, settings in (
        (RandomForestRegressor, fit_ml_forest, ForestSettings(n_trees=4)),
        (GBTRegressor, fit_ml_boosting, BoostSettings(n_rounds=2)),
    ):
        monkeypatch.setattr(estimator, "fit", spy)
        with pytest.raises(InterruptedError):
            fit(prepared.coalesce(1), preparation, settings)
    assert [len(parts) for parts in seen] == [5, 5] and all(sum(p) == n and max(p) <= n / 5 + 8 for p in seen)


def test_exact_split_has_the_exact_size(spark):
    frame = spark.range(1001).withColumnRenamed("id", "key")
    for kept in (20, 5000):
        parts = {r["fold"]: r["n"] for r in split_exact(frame, "key", 0.15, kept_rows=kept).groupBy("fold").agg(F.count("key").alias("n")).collect()}
        assert parts == {1: 151, 0: 850}
    near = split_by_share(frame, "key", 0.15).filter("fold = 1").count()
    assert 110 < near < 195


def predictor(columns):
    return 0.5 * columns[0] + 0.0 * columns[1] + 2.0 * (columns[2] == 2)


def test_permutation_importance_ranks_the_inputs(sample):
    pdf, prepared, preparation, _ = sample
    table = permutation_importance(prepared, preparation, predictor, repeats=3)
    rows = {r["feature"]: r for r in table.collect()}
    assert list(rows)[0] == "a" and rows["b"]["pi_mean"] == pytest.approx(0) and rows["a"]["pi_mean"] > rows["c"]["pi_mean"] > 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 90, 1000, 4099])
def test_permutations_are_bijections(n):
    rows = [permuted(np.arange(n), n, 42, repeat) for repeat in range(3)]
    assert all(np.array_equal(np.sort(r), np.arange(n)) for r in rows)
    if n > 50:
        assert not np.array_equal(rows[0], rows[1]) and (rows[0] == np.arange(n)).sum() < 10
        # neighbours part
        assert (np.abs(np.diff(rows[0])) == 1).mean() < 0.1


def test_shuffled_errors_by_hand(sample):
    _, prepared, preparation, _ = sample
    rows = prepared.where("key < 777").repartition(5)
    table = rows.orderBy("key").select("label", *preparation.prepared_columns).toPandas().to_numpy()
    expected = {(-1, 0): np.abs(table[:, 0] - predictor(table[:, 1:].T)).mean()}
    for repeat in range(2):
        target = permuted(np.arange(777), 777, 5, repeat)
        for place in range(3):
            mixed = table[:, 1:].copy()
            mixed[target, place] = table[:, 1 + place]
            expected[place, repeat] = np.abs(table[:, 0] - predictor(mixed.T)).mean()
    found = shuffled_errors(rows, preparation.prepared_columns, predictor, repeats=2, seed=5).collect()
    assert {(r["place"], r["repeat"]): r["error"] for r in found} == pytest.approx(expected)


def test_shuffling_keeps_every_value(sample):
    _, prepared, preparation, _ = sample
    # with the label zero and the column itself as prediction, the error is the column's mean
    rows = prepared.withColumn("label", F.lit(0.0))
    errors = shuffled_errors(rows, preparation.prepared_columns, lambda c: c[0], repeats=2).toPandas()
    assert errors["error"].to_numpy() == pytest.approx(np.full(len(errors), errors["error"].iloc[0]))
