from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings as hypothesis_settings, strategies as st
from pyspark.sql import functions as F

from panelreg.operators.levels import level_counts, sort_levels, summarize_levels
from panelreg.operators.preprocess import PrepSettings, fit_preparation
from panelreg.operators.quantiles import exact_quantiles
from panelreg.sources.roles import FeatureColumns


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def levels(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def fit_number(spark, values, **settings):
    return fit_preparation(numbers(spark, *values), FeatureColumns(("x",), ()), PrepSettings(**settings)).numeric[0]


def fit_levels(spark, values, **settings):
    return fit_preparation(levels(spark, *values), FeatureColumns((), ("c",)), PrepSettings(**settings))


def test_median_of_an_even_count(spark):
    assert fit_number(spark, [1.0, 2.0, None]).median == 1.5


def test_winsor_bounds_interpolate(spark):
    step = fit_number(spark, [float(i) for i in range(1, 101)], winsor_lower=0.05, winsor_upper=0.95)
    assert (step.low, step.high) == pytest.approx((5.95, 95.05))


def test_winsor_of_a_constant_keeps_it(spark):
    step = fit_number(spark, [3.0, 3.0, 3.0], winsor_lower=0.05, winsor_upper=0.95)
    assert step.high == step.low + 1e-12
    assert [r[0] for r in numbers(spark, 3.0, 9.0).select(step.expression()).collect()] == pytest.approx([3.0, 3.0])


def test_winsor_bounds_are_those_of_the_imputed_column(spark):
    step = fit_number(spark, [0.0, None, None, 10.0], winsor_lower=0.25, winsor_upper=0.75)
    assert (step.low, step.high) == pytest.approx(tuple(np.quantile([0, 5, 5, 10], [0.25, 0.75])))


def test_scaling_uses_the_population_deviation(spark):
    assert fit_number(spark, [1.0, 2.0, 4.0], scale_numeric=True).deviation == pytest.approx(1.247219, abs=1e-6)
    constant = fit_number(spark, [0.1] * 7, scale_numeric=True)
    assert [r[0] for r in numbers(spark, 0.1).select(constant.expression()).collect()] == pytest.approx([0.0])


def test_mode_tie_takes_the_smallest_level(spark):
    assert fit_levels(spark, ["b", "a", "b", "a", None]).categories[0].mode == "a"
    assert fit_levels(spark, ["10.0", "9.0", "10.0", "9.0"]).categories[0].mode == "9.0"
    assert sort_levels(["10.0", "9.0"]) == ["9.0", "10.0"] and sort_levels(["10.0", "9.0", "x"]) == ["10.0", "9.0", "x"]


def test_dummies_drop_the_first_level_and_zero_unknown_ones(spark):
    prep = fit_levels(spark, ["a", "b", "c"], drop_first=True)
    assert prep.feature_names() == ["c_b", "c_c"]
    got = prep.apply(levels(spark, "a", "zz", "c")).select(*prep.design_columns()).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_rare_levels_become_other(spark):
    prep = fit_levels(spark, ["a"] * 5 + ["b"] * 5 + ["c"], rare_min_count=2)
    assert prep.categories[0].levels == ("Other", "a", "b")
    got = prep.apply(levels(spark, "c", "zz", "b")).select("code_0").collect()
    assert [r[0] for r in got] == [0, 0, 2]


def test_no_other_dummy_when_no_training_level_is_rare(spark):
    prep = fit_levels(spark, ["a"] * 5 + ["b"] * 5, rare_min_count=2)
    assert prep.categories[0].levels == ("a", "b")
    assert [r[0] for r in prep.apply(levels(spark, "zz")).select("code_0").collect()] == [-1]


def test_gaps_count_for_the_mode_before_rare_grouping(spark):
    prep = fit_levels(spark, ["a", None, None, "b"], rare_min_count=3)
    assert prep.categories[0].frequent == ("a",)


@pytest.mark.parametrize("rare", [0, 2])
def test_many_levels_are_coded_without_moving_rows(spark, rare):
    names = [f"v{i:04d}" for i in range(3000)]
    values = names + names[:1700]
    prep = fit_levels(spark, [*values, None], rare_min_count=rare)
    frame = levels(spark, *names, "new", None)
    step = prep.categories[0]
    other = step.levels.index("Other") if rare else -1
    expected = {name: step.levels.index(name) if name in set(step.levels) else other for name in [*names, "new"]}
    coded = {r["c"]: r["code_0"] for r in prep.apply(frame).collect()}
    assert coded == expected | {None: expected["v0000"]} and len(step.levels) == (1701 if rare else 3000)
    assert "Exchange" not in prep.apply(frame)._jdf.queryExecution().executedPlan().toString()


def test_empty_columns_are_dropped_and_named(spark):
    frame = spark.createDataFrame([(1.0, None, None)], "x double, y double, c string")
    prep = fit_preparation(frame, FeatureColumns(("x", "y"), ("c",)))
    assert prep.feature_names() == ["x"] and prep.dropped == ("y", "c")


def test_a_column_missing_at_scoring_time_is_an_error(spark):
    prep = fit_preparation(numbers(spark, 1.0), FeatureColumns(("x",), ()))
    with pytest.raises(ValueError, match="absent here: x"):
        prep.apply(levels(spark, "a"))


def test_level_counts_list_gaps(spark):
    got = {(r["column"], r["level"]): r["n"] for r in level_counts(levels(spark, "a", "a", None), ["c"]).collect()}
    assert got == {("c", "a"): 2, ("c", None): 1}
    assert summarize_levels(levels(spark, "a"), []) == {}


def test_vector_and_dense_design_agree(spark):
    frame = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c"), (5.0, None)], "x double, c string")
    for drop in (True, False):
        prep = fit_preparation(frame, FeatureColumns(("x",), ("c",)), PrepSettings(drop_first=drop))
        rows = prep.apply(spark.createDataFrame([(1.0, "a"), (None, "zz"), (3.0, "c")], "x double, c string"))
        dense = rows.select(*prep.design_columns()).toPandas().to_numpy()
        vector = np.array([r[0].toArray() for r in prep.with_vector(rows).select("features").collect()])
        inside = prep.design_array([rows.toPandas()[c].to_numpy() for c in prep.prepared_columns])
        assert np.array_equal(dense, vector) and np.array_equal(dense, inside)
        weights = np.arange(1, dense.shape[1] + 1)
        scored = [r[0] for r in rows.select(prep.linear_score(0.5, weights)).collect()]
        assert scored == pytest.approx((0.5 + dense @ weights).tolist())


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(size=6000))
    x[rng.random(6000) < 0.33] = 1.5
    frame = pd.DataFrame({"x": x, "y": rng.integers(0, 4, 6000).astype(float)})
    frame.loc[rng.random(6000) < 0.1, "y"] = None
    return frame, spark.createDataFrame(frame).select("x", F.nanvl("y", F.lit(None)).alias("y")).persist()


@pytest.mark.parametrize("limits", [{}, {"kept_rows": 40}])
def test_quantiles_are_exact_on_every_path(skewed, limits):
    pdf, frame = skewed
    qs = [0.0, 0.02, 0.34, 0.5, 0.61, 0.98, 1.0]
    got = exact_quantiles(frame, {c: (F.col(c), qs) for c in ("x", "y")}, **limits)
    for c in ("x", "y"):
        assert got[c] == pytest.approx(pdf[c].dropna().quantile(qs).tolist(), rel=1e-12)


@hypothesis_settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60),
    st.floats(0, 1),
)
def test_quantiles_of_any_list(spark, values, q):
    got = exact_quantiles(numbers(spark, *values), {"x": (F.col("x"), [q])}, kept_rows=2)["x"]
    present = [v for v in values if v is not None]
    if present:
        assert got[0] == pytest.approx(np.quantile(present, q), rel=1e-9, abs=1e-9)
    else:
        assert got is None
