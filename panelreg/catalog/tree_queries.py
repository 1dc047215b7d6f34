"""Queries over boosting, forests and permutation importance."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelreg.catalog.base import (
    HH, LABEL, NUMERIC_ROLES, ROLES, TEST_YEAR, digest_sql, hash_uniform_sql, hash_word_sql, households, is_train, metrics_sql,
    query, rounded, settings,
)
from panelreg.functions.hashing import RANGE, poisson_array, poisson_steps, stream_word
from panelreg.functions.target import to_learning_scale
from panelreg.operators.boosting import ROWS, BoostSettings, column_mask, fit_boosting, fit_ml_boosting
from panelreg.operators.evaluate import metric_columns
from panelreg.operators.forest import ForestSettings, bag_stream, fit_forest, fit_ml_forest
from panelreg.operators.permutation import ROUNDS as FEISTEL_ROUNDS, SHUFFLE, permutation_importance
from panelreg.operators.preprocess import Preparation, PrepSettings, fit_preparation
from panelreg.operators.trees import (
    RowRule, SplitRules, Tree, bin_columns, feature_space, histogram_cells, scan_source, split_candidates,
)
from panelreg.operators.validation import split_by_share
from panelreg.plans.boosting_job import run_boosting
from panelreg.plans.common import ModelRun, prepare_split
from panelreg.plans.forest_job import run_forest
from panelreg.sources.roles import FeatureColumns

SMALL = FeatureColumns(("n_lines",), ("is_f", "priority"))
RATE, LAMBDA = 0.5, 2.0
SEED = 42


def small_fit(spark: SparkSession, sf_dir: str, numeric_only: bool = False) -> tuple[DataFrame, Preparation]:
    """(prepared rows of all years with key and label, preparation) on line count and categories."""
    rows = (
        households(spark, sf_dir)
        .withColumn("label", to_learning_scale(F.col("revenue"), "log1p"))
        .withColumn("is_f", F.col("is_f").cast("string"))
        .withColumn("key", F.col("hh_id"))
    )
    features = FeatureColumns(("n_lines",), ()) if numeric_only else SMALL
    preparation = fit_preparation(rows.filter(is_train()), features, PrepSettings(drop_first=True))
    return preparation.apply(rows), preparation


# n: imputed line count; d1..d5: the dummies in feature order
SMALL_SQL = f"""WITH {HH}, pm AS (SELECT median(n_lines) AS mn,
  (SELECT is_f FROM tr WHERE is_f IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mf,
  (SELECT priority FROM tr WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mp FROM tr),
sm AS (SELECT hh_id, yr, {LABEL} AS y, coalesce(n_lines, mn) AS n,
  CAST(coalesce(is_f, mf) = 1 AS INT) AS d1, CAST(coalesce(priority, mp) = '2-HIGH' AS INT) AS d2,
  CAST(coalesce(priority, mp) = '3-MEDIUM' AS INT) AS d3, CAST(coalesce(priority, mp) = '4-NOT SPECIFIED' AS INT) AS d4,
  CAST(coalesce(priority, mp) = '5-LOW' AS INT) AS d5 FROM hh, pm)"""
FEATURES = ("n_lines", "is_f_1.0", "priority_2-HIGH", "priority_3-MEDIUM", "priority_4-NOT SPECIFIED", "priority_5-LOW")


def cells_sql(rows: str, dummies: int = 5, condition: str = "true") -> str:
    """Cells of the root: one per line count above the least, and one per dummy."""
    parts = [
        f"SELECT 0 AS feature, n AS cut, sum(g) AS g, count(*)::DOUBLE AS h FROM {rows} "
        f"WHERE {condition} AND n > (SELECT min(n) FROM {rows} WHERE {condition}) GROUP BY n"
    ]
    parts += [
        f"SELECT {i}, 1, sum(g), count(*)::DOUBLE FROM {rows} WHERE {condition} AND d{i} = 1 HAVING count(*) > 0"
        for i in range(1, dummies + 1)
    ]
    return " UNION ALL ".join(parts)


def gains_sql(cells: str, totals: str, lam: float) -> str:
    """Right sides of all splits with their gain, from cells and totals."""
    return f"""SELECT feature, cut, gr, hr, ga, ha,
      (ga - gr) * (ga - gr) / (ha - hr + {lam}) + gr * gr / (hr + {lam}) - ga * ga / (ha + {lam}) AS gain
    FROM (SELECT feature, cut, sum(g) OVER w AS gr, sum(h) OVER w AS hr FROM {cells}
          WINDOW w AS (PARTITION BY feature ORDER BY cut DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), {totals}
    WHERE ha - hr >= 1"""


def rounds_sql(count: int, dummies: int = 5, condition: str = "true", first_rows: str = "sm WHERE yr <= 2000") -> str:
    """``count`` rounds of depth-one boosting: tables r0..rN with the prediction, best1..bestN."""
    text = [f"r0 AS (SELECT *, (SELECT avg(y) FROM {first_rows} AND {condition}) AS pred FROM sm)"]
    where = f"yr <= 2000 AND {condition}"
    for i in range(1, count + 1):
        text.append(f"g{i} AS (SELECT *, pred - y AS g FROM r{i - 1})")
        text.append(f"cells{i} AS ({cells_sql(f'g{i}', dummies, where)})")
        text.append(f"all{i} AS (SELECT sum(g) AS ga, count(*)::DOUBLE AS ha FROM g{i} WHERE {where})")
        text.append(f"gains{i} AS ({gains_sql(f'cells{i}', f'all{i}', LAMBDA)})")
        text.append(
            f"best{i} AS (SELECT *, -gr / (hr + {LAMBDA}) AS wr, -(ga - gr) / (ha - hr + {LAMBDA}) AS wl FROM gains{i} "
            f"ORDER BY round(gain / (SELECT max(gain) FROM gains{i}), 9) DESC, feature, cut LIMIT 1)"
        )
        side = " ".join(f"WHEN {d} THEN d{d} = 1" for d in range(1, dummies + 1))
        goes_right = f"CASE feature WHEN 0 THEN n >= cut {side} END"
        text.append(
            f"r{i} AS (SELECT g{i}.* EXCLUDE (pred, g), pred + {RATE} * CASE WHEN {goes_right} THEN wr ELSE wl END AS pred "
            f"FROM g{i}, best{i})"
        )
    return ", ".join(text)


def _root_cells(spark: SparkSession, sf_dir: str):
    prepared, preparation = small_fit(spark, sf_dir)
    train = prepared.filter(is_train())
    space = feature_space(train, preparation)
    base = train.agg(F.avg("label")).first()[0]
    binned = bin_columns(train, space, ["key", F.col("label").alias("y")])
    rule = RowRule(("key", "y"), lambda tree, key: None, lambda columns, table: base - columns["y"])
    return histogram_cells(scan_source(binned, space, rule), space, rule, {0: (Tree().packed(), [0])}), space


def _named(cells: DataFrame, space) -> DataFrame:
    """Feature names and cut values instead of numbers."""
    names = F.array(*[F.lit(f.name) for f in space.features])
    # values are listed per bin; a dummy's only bin is 1
    cuts = F.array(*[F.array(*[F.lit(v) for v in (space.cuts.get(f.slot) or (1.0,))]) for f in space.features])
    return cells.filter("feature >= 0").select(
        F.get(names, F.col("feature")).alias("feature"),
        F.get(F.get(cuts, F.col("feature")), F.col("bin") - 1).alias("cut"),
        *[c for c in cells.columns if c not in ("tree", "node", "feature", "bin")],
    )


NAME_SQL = "CASE feature " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FEATURES)) + " END"
ROOT_SQL = f"""{SMALL_SQL}, g AS (SELECT *, (SELECT avg(y) FROM sm WHERE yr <= 2000) - y AS g FROM sm WHERE yr <= 2000),
cells AS ({cells_sql('g')}), totals AS (SELECT sum(g) AS ga, count(*)::DOUBLE AS ha FROM g)"""


@query(f"{ROOT_SQL} SELECT {NAME_SQL} AS feature, cut::DOUBLE AS cut, round(g, 4) + 0.0 AS g, h AS n FROM cells")
def boost_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient sums and row counts per (feature, bin) at the root of the first tree."""
    cells, space = _root_cells(spark, sf_dir)
    return _named(cells, space).select("feature", "cut", (F.round("g", 4) + 0.0).alias("g"), F.col("h").alias("n"))


@query(f"{ROOT_SQL}, gains AS ({gains_sql('cells', 'totals', LAMBDA)}) SELECT {NAME_SQL} AS feature, cut::DOUBLE AS cut, hr AS n_right, round(gain, 3) AS gain FROM gains")
def boost_split_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of every split of the root with lambda 2."""
    cells, space = _root_cells(spark, sf_dir)
    # a vanishing gain is still listed
    candidates = split_candidates(cells, SplitRules(lambda_=LAMBDA, gamma=-1e9))
    return _named(candidates, space).select("feature", "cut", F.col("h_right").alias("n_right"), F.round("gain", 3).alias("gain"))


def _stumps(rounds: int, **changes) -> BoostSettings:
    base = {"n_rounds": rounds, "learning_rate": RATE, "max_depth": 1, "subsample": 1.0, "column_share": 1.0, "lambda_": LAMBDA}
    return BoostSettings(**(base | changes))


@query(f"{SMALL_SQL}, {rounds_sql(2)} SELECT hh_id, round(pred, 6) AS pred FROM r2")
def boost_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of depth-one trees; predictions of all rows."""
    prepared, preparation = small_fit(spark, sf_dir)
    model = fit_boosting(prepared.filter(is_train()), preparation, _stumps(2))
    return prepared.select("hh_id", F.round(model.score(), 6).alias("pred"))


@query(
    f"""{SMALL_SQL}, {rounds_sql(4)}, used AS ({" UNION ALL ".join(f"SELECT feature, gain FROM best{i}" for i in range(1, 5))}),
m AS (SELECT f.feature, coalesce(avg(gain), 0) AS gain FROM range(6) f(feature) LEFT JOIN used USING (feature) GROUP BY 1)
SELECT {NAME_SQL} AS feature, round(gain / sum(gain) OVER (), 6) AS importance FROM m"""
)
def boost_importance_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average gain per feature over four rounds, as shares."""
    prepared, preparation = small_fit(spark, sf_dir)
    model = fit_boosting(prepared.filter(is_train()), preparation, _stumps(4, refresh_rounds=2))
    rows = [(name, round(share, 6)) for name, share in model.importances()]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


STOP_ROUNDS, PATIENCE = 6, 2
FOLD_SQL = f"{digest_sql('hh_id', SEED, 8)} / {RANGE} >= 0.15"


@query(
    f"""{SMALL_SQL}, {rounds_sql(STOP_ROUNDS, 0, FOLD_SQL)}, curve AS (
{" UNION ALL ".join(f"SELECT {i} AS round, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM r{i} WHERE yr <= 2000 AND NOT ({FOLD_SQL})" for i in range(1, STOP_ROUNDS + 1))}),
so_far AS (SELECT *, min(rmse) OVER (ORDER BY round) AS best FROM curve),
best_round AS (SELECT *, (SELECT min(c.round) FROM curve c WHERE c.rmse = best) AS best_at FROM so_far),
stop AS (SELECT coalesce(min(round), {STOP_ROUNDS}) AS last_round FROM best_round WHERE round - best_at >= {PATIENCE}),
kept AS (SELECT max(best_at) AS trees FROM best_round, stop WHERE round <= last_round)
SELECT CAST(round AS INT) AS round, round(rmse, 6) AS rmse, round <= trees AS kept FROM curve, stop, kept WHERE round <= last_round"""
)
def early_stop_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation error per round, and which trees the patience rule keeps."""
    prepared, preparation = small_fit(spark, sf_dir, numeric_only=True)
    train = split_by_share(prepared.filter(is_train()), "key", 0.15, SEED)
    model = fit_boosting(train, preparation, _stumps(STOP_ROUNDS, patience=PATIENCE), fold="fold")
    rows = [(i, round(e, 6), i <= len(model.trees)) for i, e in enumerate(model.curve, start=1)]
    return spark.createDataFrame(rows, "round int, rmse double, kept boolean")


TREES = 5
STREAMS_SQL = "bags(tree, stream) AS (VALUES " + ", ".join(f"({t}, {bag_stream(SEED, t)}::BIGINT)" for t in range(TREES)) + ")"
U_SQL = hash_uniform_sql("hh_id", "stream")
WEIGHT_SQL = " + ".join(f"CAST(u >= {s!r} AS INT)" for s in poisson_steps())


@query(
    f"""WITH {HH}, {STREAMS_SQL}, u AS (SELECT tree, hh_id, {U_SQL} AS u FROM tr, bags), w AS (SELECT tree, hh_id, {WEIGHT_SQL} AS weight FROM u)
SELECT CAST(tree AS INT) AS tree, weight, count(*) AS n, sum(hh_id) AS ids FROM w GROUP BY tree, weight"""
)
def bag_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each training row is drawn by each of five trees."""
    rows = households(spark, sf_dir).filter(is_train()).select("hh_id")

    @F.pandas_udf("array<long>")
    def draw(key: pd.Series) -> pd.Series:
        return pd.Series(list(np.column_stack([poisson_array(key.to_numpy(), bag_stream(SEED, t)) for t in range(TREES)])))

    drawn = rows.select("hh_id", F.posexplode(draw("hh_id")).alias("tree", "weight"))
    return drawn.groupBy("tree", "weight").agg(F.count(F.lit(1)).alias("n"), F.sum("hh_id").alias("ids"))


# depth-one trees on the line count; a leaf is the weighted mean, a split needs three drawn rows per side
FOREST_SQL = f"""{SMALL_SQL}, {STREAMS_SQL}, u AS (SELECT tree, hh_id, n, y, {U_SQL} AS u FROM sm, bags WHERE yr <= 2000),
w AS (SELECT tree, hh_id, n, y, {WEIGHT_SQL} AS w FROM u),
cell AS (SELECT tree, n AS cut, sum(w * y) AS s, sum(w) AS h, count(*) AS c FROM w WHERE w > 0 GROUP BY tree, n),
sides AS (SELECT tree, cut, sum(s) OVER r AS sr, sum(h) OVER r AS hr, sum(c) OVER r AS cr,
  sum(s) OVER a AS sa, sum(h) OVER a AS ha, sum(c) OVER a AS ca FROM cell
  WINDOW r AS (PARTITION BY tree ORDER BY cut DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY tree)),
gains AS (SELECT *, (sa - sr) * (sa - sr) / (ha - hr) + sr * sr / hr - sa * sa / ha AS gain FROM sides
  WHERE cr >= 3 AND ca - cr >= 3 AND cut > (SELECT min(n) FROM sm WHERE yr <= 2000)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY round(gain / top, 9) DESC, cut) AS place
  FROM (SELECT *, max(gain) OVER (PARTITION BY tree) AS top FROM gains)) WHERE place = 1)"""


@query(
    f"""{FOREST_SQL}, oob AS (SELECT hh_id, any_value(y) AS y, avg(CASE WHEN n >= cut THEN sr / hr ELSE (sa - sr) / (ha - hr) END) AS p
  FROM w JOIN best USING (tree) WHERE w = 0 GROUP BY hh_id)
SELECT count(*) AS n, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS R2_OOB FROM oob"""
)
def oob_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-bag R2 of five depth-one trees, over the rows at least one tree did not draw."""
    prepared, preparation = small_fit(spark, sf_dir, numeric_only=True)
    forest, binned = fit_forest(prepared.filter(is_train()), preparation, ForestSettings(n_trees=TREES, max_depth=1, seed=SEED))
    scored = forest.out_of_bag(binned).filter("oob IS NOT NULL")
    _, _, r2 = metric_columns("y", "oob", "_OOB")
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), r2), R2_OOB=6)


@query(
    f"""{FOREST_SQL} SELECT hh_id, round(avg(CASE WHEN n >= cut THEN sr / hr ELSE (sa - sr) / (ha - hr) END), 6) AS pred
FROM sm, best GROUP BY hh_id"""
)
def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prediction of the same five trees for every row."""
    prepared, preparation = small_fit(spark, sf_dir, numeric_only=True)
    forest, binned = fit_forest(prepared.filter(is_train()), preparation, ForestSettings(n_trees=TREES, max_depth=1, seed=SEED))
    binned.unpersist()
    return prepared.select("hh_id", F.round(forest.score(), 6).alias("pred"))


@query(
    f"""{FOREST_SQL} SELECT hh_id, round(avg(CASE WHEN n >= cut THEN sr / hr ELSE (sa - sr) / (ha - hr) END), 6) AS pred
FROM sm, best GROUP BY hh_id"""
)
def forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trees with six constant columns beside and one feature tried: a node goes on until one splits."""
    rows = households(spark, sf_dir).withColumns({f"same_{i}": F.lit(float(i)) for i in range(6)})
    rows = rows.withColumn("label", to_learning_scale(F.col("revenue"), "log1p")).withColumn("key", F.col("hh_id"))
    features = FeatureColumns(("same_0", "same_1", "same_2", "n_lines", "same_3", "same_4", "same_5"), ())
    preparation = fit_preparation(rows.filter(is_train()), features, PrepSettings())
    prepared = preparation.apply(rows)
    forest_settings = ForestSettings(n_trees=TREES, max_depth=1, max_features=1, seed=SEED)
    forest, binned = fit_forest(prepared.filter(is_train()), preparation, forest_settings)
    binned.unpersist()
    return prepared.select("hh_id", F.round(forest.score(), 6).alias("pred"))


TRIED = 2


def level_sql(
    level: str, value: str, weight: str, score, valid: str, least: float, tried: int | None = None, features=range(6)
) -> str:
    """Cells, gains and the chosen split of every (tree, node) of ``drawn<level>``, for sums of value and weight."""
    running = "PARTITION BY tree, node ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    sums = f"sum({value}) AS s, sum({weight}) AS h, count(*) AS c"
    cells = [
        f"SELECT tree, node, {k} AS feature, 0 AS cut, s AS sr, h AS hr, c AS cr "
        f"FROM (SELECT tree, node, {sums} FROM drawn{level} WHERE d{k} = 1 GROUP BY tree, node)"
        for k in features
        if k
    ]
    if 0 in features:
        cells.append(
            f"SELECT tree, node, 0 AS feature, n AS cut, sum(s) OVER r AS sr, sum(h) OVER r AS hr, sum(c) OVER r AS cr "
            f"FROM bins{level} WINDOW r AS ({running})"
        )
    chosen = "true" if tried is None else f"turn <= {tried}"
    return f"""
bins{level} AS (SELECT tree, node, n, {sums} FROM drawn{level} GROUP BY tree, node, n), cells{level} AS ({" UNION ALL ".join(cells)}),
nodes{level} AS (SELECT tree, node, sum({value}) AS sa, sum({weight}) AS ha, count(*) AS ca FROM drawn{level} GROUP BY tree, node),
gains{level} AS (SELECT * FROM (SELECT *, {score("(sa - sr)", "(ha - hr)")} + {score("sr", "hr")} - {score("sa", "ha")} AS gain
  FROM cells{level} JOIN nodes{level} USING (tree, node) WHERE {valid}) WHERE gain > {least}),
turns{level} AS (SELECT *, dense_rank() OVER (PARTITION BY tree, node ORDER BY md5(concat_ws(':', tree, node, feature, {SEED}))) AS turn FROM gains{level}),
best{level} AS (SELECT tree, node, feature, cut, sr, hr, sa, ha, gain FROM (SELECT *, row_number() OVER (PARTITION BY tree, node
  ORDER BY round(gain / top, 9) DESC, feature, cut) AS place
  FROM (SELECT *, max(gain) OVER (PARTITION BY tree, node) AS top FROM turns{level} WHERE {chosen})) WHERE place = 1)"""


def side_sql(level: str) -> str:
    """Whether a row goes right at the split of its node."""
    cases = " ".join(f"WHEN {k} THEN d{k} = 1" for k in range(1, 6))
    return f"CASE best{level}.feature WHEN 0 THEN n >= best{level}.cut {cases} END"


def forest_level_sql(level: str) -> str:
    return level_sql(
        level, "w * y", "w", lambda g, h: f"{g} * {g} / {h}", "cr >= 3 AND ca - cr >= 3", 1e-12, TRIED
    )


TWO_LEVELS_SQL = f"""{SMALL_SQL}, {STREAMS_SQL}, u AS (SELECT sm.*, tree, {U_SQL} AS u FROM sm, bags),
rows0 AS (SELECT * EXCLUDE (u), CASE WHEN yr <= 2000 THEN {WEIGHT_SQL} ELSE 0 END AS w, 0 AS node FROM u),
drawn0 AS (SELECT * FROM rows0 WHERE w > 0), {forest_level_sql("0")},
rows1 AS (SELECT rows0.* EXCLUDE (node), CASE WHEN {side_sql("0")} THEN 2 ELSE 1 END AS node FROM rows0 JOIN best0 USING (tree)),
drawn1 AS (SELECT * FROM rows1 WHERE w > 0), {forest_level_sql("1")}"""


def _levels(spark: SparkSession, sf_dir: str, depth: int, local_rows: int):
    prepared, preparation = small_fit(spark, sf_dir)
    forest_settings = ForestSettings(n_trees=TREES, max_depth=depth, max_features=TRIED, seed=SEED, local_rows=local_rows)
    forest, binned = fit_forest(prepared.filter(is_train()), preparation, forest_settings)
    binned.unpersist()
    return prepared, forest


@query(
    f"""{TWO_LEVELS_SQL}, leaves AS (SELECT hh_id, CASE WHEN best1.feature IS NULL THEN nodes1.sa / nodes1.ha WHEN {side_sql('1')} THEN best1.sr / best1.hr
  ELSE (best1.sa - best1.sr) / (best1.ha - best1.hr) END AS p
  FROM rows1 JOIN nodes1 USING (tree, node) LEFT JOIN best1 USING (tree, node))
SELECT hh_id, round(avg(p), 6) AS pred FROM leaves GROUP BY hh_id"""
)
def forest_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prediction of five trees of depth two over line count and dummies, two features tried per node; by histograms alone."""
    prepared, forest = _levels(spark, sf_dir, 2, 0)
    return prepared.select("hh_id", F.round(forest.score(), 6).alias("pred"))


@query(
    f"""{TWO_LEVELS_SQL}, used AS (SELECT tree, feature, gain FROM best0 UNION ALL SELECT tree, feature, gain FROM best1),
shares AS (SELECT feature, sum(gain / total) AS share FROM used JOIN (SELECT tree, sum(gain) AS total FROM used GROUP BY tree) USING (tree) GROUP BY feature)
SELECT {NAME_SQL} AS feature, round(coalesce(share, 0) / sum(share) OVER (), 6) AS importance FROM range(6) f(feature) LEFT JOIN shares USING (feature)"""
)
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impurity importances of the same trees."""
    rows = [(name, round(share, 6)) for name, share in _levels(spark, sf_dir, 2, 0)[1].importances()]
    return spark.createDataFrame(rows, "feature string, importance double")


THREE_LEVELS_SQL = f"""{TWO_LEVELS_SQL},
rows2 AS (SELECT rows1.* EXCLUDE (node), 2 * node + CASE WHEN {side_sql("1")} THEN 2 ELSE 1 END AS node FROM rows1 JOIN best1 USING (tree, node)),
drawn2 AS (SELECT * FROM rows2 WHERE w > 0), {forest_level_sql("2")}"""


@query(
    f"""{THREE_LEVELS_SQL}, ended AS (SELECT hh_id, nodes1.sa / nodes1.ha AS p FROM rows1 JOIN nodes1 USING (tree, node) LEFT JOIN best1 USING (tree, node)
  WHERE best1.feature IS NULL),
leaves AS (SELECT hh_id, CASE WHEN best2.feature IS NULL THEN nodes2.sa / nodes2.ha WHEN {side_sql('2')} THEN best2.sr / best2.hr
  ELSE (best2.sa - best2.sr) / (best2.ha - best2.hr) END AS p
  FROM rows2 JOIN nodes2 USING (tree, node) LEFT JOIN best2 USING (tree, node))
SELECT hh_id, round(avg(p), 6) AS pred FROM (FROM ended UNION ALL FROM leaves) GROUP BY hh_id"""
)
def forest_three_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trees one level deeper: roots by histograms, the nodes below that have become small finished in a task each."""
    prepared, forest = _levels(spark, sf_dir, 3, prepared_rows(spark, sf_dir) * 4 // 10)
    return prepared.select("hh_id", F.round(forest.score(), 6).alias("pred"))


def prepared_rows(spark: SparkSession, sf_dir: str) -> int:
    """Training rows."""
    return households(spark, sf_dir).filter(is_train()).count()


ALL_ROWS_SQL = TWO_LEVELS_SQL.replace(f"CASE WHEN yr <= 2000 THEN {WEIGHT_SQL} ELSE 0 END AS w", "CAST(yr <= 2000 AS INT) AS w")


@query(
    f"""{ALL_ROWS_SQL}, leaves AS (SELECT hh_id, yr, y, CASE WHEN best1.feature IS NULL THEN nodes1.sa / nodes1.ha WHEN {side_sql('1')} THEN best1.sr / best1.hr
  ELSE (best1.sa - best1.sr) / (best1.ha - best1.hr) END AS p
  FROM rows1 JOIN nodes1 USING (tree, node) LEFT JOIN best1 USING (tree, node)),
scored AS (SELECT hh_id, yr, any_value(y) AS y, avg(p) AS pred FROM leaves GROUP BY hh_id, yr),
f AS (SELECT least(greatest(avg(exp(y - pred)), 0.5), 1.5) AS factor FROM scored WHERE yr <= 2000)
SELECT {metrics_sql("y", "pred")}, round(any_value(factor), 6) AS smearing,
  {metrics_sql("(exp(y) - 1)", "greatest(factor * (exp(pred) - 1), 0)", "_raw", 3)} FROM scored, f WHERE yr = {TEST_YEAR}"""
)
def forest_job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest job end to end, every tree on all rows with two features tried per node: its report, smearing included."""
    roles = replace(ROLES, numeric=("n_lines",))
    choice = settings(prep=PrepSettings(drop_first=True), geography="none")
    forest = ForestSettings(n_trees=TREES, max_depth=2, max_features=TRIED, seed=SEED, bootstrap=False)
    report = run_forest(households(spark, sf_dir), roles, choice, forest).report()
    kept = report.select("MAE", "RMSE", "R2", "smearing", "MAE_raw", "RMSE_raw", "R2_raw")
    return rounded(kept, MAE=6, RMSE=6, R2=6, smearing=6, MAE_raw=3, RMSE_raw=3, R2_raw=6)


ALPHA, GAMMA, CHILD, SUBSAMPLE, SHARE = 3.0, 2000.0, 40.0, 0.8, 0.7
DEEP = BoostSettings(
    n_rounds=2, learning_rate=RATE, max_depth=2, subsample=SUBSAMPLE, column_share=SHARE, lambda_=LAMBDA, alpha=ALPHA,
    min_child_weight=CHILD, gamma=GAMMA, seed=SEED,
)


def deep_round_sql(number: int, chosen: BoostSettings = DEEP) -> str:
    """One round of depth two with L1, L2, least gain, least child weight, drawn rows and columns: ``b<n>`` to ``b<n+1>``."""
    soft = lambda g: f"greatest(abs({g}) - {ALPHA}, 0)"
    leaf = lambda g, h: f"-sign({g}) * {soft(g)} / ({h} + {LAMBDA})"
    mask = column_mask(chosen, number, len(FEATURES))
    features = [k for k in range(len(FEATURES)) if mask is None or mask[k]]
    drawn = "yr <= 2000"
    if chosen.subsample < 1:
        drawn += f" AND {hash_uniform_sql('hh_id', f'{stream_word(SEED, ROWS, number)}::BIGINT')} < {SUBSAMPLE}"

    def level(name: str) -> str:
        return level_sql(
            name, "g", "1.0::DOUBLE", lambda g, h: f"pow({soft(g)}, 2) / ({h} + {LAMBDA})",
            f"hr >= {CHILD} AND ha - hr >= {CHILD}", GAMMA, None, features,
        )

    low, high = f"{number}a", f"{number}b"
    return f"""b{number}g AS (SELECT *, pred - y AS g, 0 AS tree, 0 AS node FROM b{number}),
drawn{low} AS (SELECT * FROM b{number}g WHERE {drawn}), {level(low)},
b{number}n AS (SELECT b{number}g.* EXCLUDE (node), CASE WHEN {side_sql(low)} THEN 2 ELSE 1 END AS node FROM b{number}g JOIN best{low} USING (tree)),
drawn{high} AS (SELECT * FROM b{number}n WHERE {drawn}), {level(high)},
b{number + 1} AS (SELECT * EXCLUDE (g, tree, node, pred, leaf), pred + {RATE} * leaf AS pred FROM (SELECT b{number}n.*,
  CASE WHEN best{high}.feature IS NULL THEN {leaf(f"nodes{high}.sa", f"nodes{high}.ha")}
    WHEN {side_sql(high)} THEN {leaf(f"best{high}.sr", f"best{high}.hr")}
    ELSE {leaf(f"(best{high}.sa - best{high}.sr)", f"(best{high}.ha - best{high}.hr)")} END AS leaf
  FROM b{number}n JOIN nodes{high} USING (tree, node) LEFT JOIN best{high} USING (tree, node)))"""


BOOST_SQL = f"""{SMALL_SQL}, b0 AS (SELECT *, (SELECT avg(y) FROM sm WHERE yr <= 2000) AS pred FROM sm), {deep_round_sql(0)}, {deep_round_sql(1)}
SELECT hh_id, round(pred, 6) AS pred FROM b2"""


@query(BOOST_SQL)
def boost_regularized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of depth two with both penalties, least gain and child weight, and rows and columns drawn by hash."""
    prepared, preparation = small_fit(spark, sf_dir)
    model = fit_boosting(prepared.filter(is_train()), preparation, replace(DEEP, local_rows=0))
    return prepared.select("hh_id", F.round(model.score(), 6).alias("pred"))


@query(BOOST_SQL)
def boost_handed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two rounds with each tree finished in one pass over the rows, as far as a task may hold them."""
    prepared, preparation = small_fit(spark, sf_dir)
    model = fit_boosting(prepared.filter(is_train()), preparation, replace(DEEP, local_rows=10**9))
    return prepared.select("hh_id", F.round(model.score(), 6).alias("pred"))


WHOLE = replace(DEEP, subsample=1.0, column_share=1.0)
FIRST_SQL = "b0 AS (SELECT *, (SELECT avg(y) FROM sm WHERE yr <= 2000) AS pred FROM sm)"
RAW_METRICS_SQL = metrics_sql("(exp(y) - 1)", "greatest(factor * (exp(pred) - 1), 0)", "_raw", 3)


@query(
    f"""{SMALL_SQL}, {FIRST_SQL}, {deep_round_sql(0, WHOLE)}, {deep_round_sql(1, WHOLE)},
f AS (SELECT least(greatest(avg(exp(y - pred)), 0.5), 1.5) AS factor FROM b2 WHERE yr <= 2000)
SELECT {metrics_sql("y", "pred")}, round(any_value(factor), 6) AS smearing, {RAW_METRICS_SQL} FROM b2, f WHERE yr = {TEST_YEAR}"""
)
def boost_job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosting job end to end with all rows and columns in every round: its report, smearing included."""
    roles = replace(ROLES, numeric=("n_lines",))
    choice = settings(prep=PrepSettings(drop_first=True))
    report = run_boosting(households(spark, sf_dir), roles, choice, WHOLE).report()
    kept = report.select("MAE", "RMSE", "R2", "smearing", "MAE_raw", "RMSE_raw", "R2_raw")
    return rounded(kept, MAE=6, RMSE=6, R2=6, smearing=6, MAE_raw=3, RMSE_raw=3, R2_raw=6)


REPEATS = 3

ROUND_SQL = f"""SELECT * EXCLUDE (l, r), l * lower + r AS target FROM (
  SELECT * REPLACE ((r + {hash_word_sql("l", "s3")}) % lower AS r) FROM (
  SELECT * REPLACE ((l + {hash_word_sql("r", "s2")}) % upper AS l) FROM (
  SELECT * REPLACE ((r + {hash_word_sql("l", "s1")}) % lower AS r) FROM (
  SELECT * EXCLUDE (l), (l + {hash_word_sql("r", "s0")}) % upper AS l FROM (
  SELECT * EXCLUDE (target), target // lower AS l, target % lower AS r FROM {{rows}})))))"""
SHUFFLES_SQL = "shuffles(repeat, s0, s1, s2, s3) AS (VALUES " + ", ".join(
    f"({r}, " + ", ".join(f"{stream_word(SEED, SHUFFLE, r, k)}::BIGINT" for k in range(FEISTEL_ROUNDS)) + ")" for r in range(REPEATS)
) + ")"
# numbers beyond the last one go through the rounds again; more than five times is unheard of
WALKS = 5
WALK_SQL = ", ".join(
    f"w{i + 1} AS ({ROUND_SQL.format(rows=f'w{i}' if not i else f'(FROM w{i} WHERE target >= rows_)')}"
    + (f" UNION ALL BY NAME FROM w{i} WHERE target < rows_" if i else "")
    + ")"
    for i in range(WALKS)
)


@query(
    f"""WITH {HH}, med AS (SELECT median(acctbal) AS ma, median(n_lines) AS mn FROM tr), {SHUFFLES_SQL},
rows0 AS (SELECT {LABEL} AS y, coalesce(acctbal, ma) AS a, coalesce(n_lines, mn) AS n, row_number() OVER (ORDER BY hh_id) - 1 AS number,
  count(*) OVER () AS rows_ FROM te, med),
sized AS (SELECT *, CAST(floor(sqrt(rows_ - 1)) AS BIGINT) + 1 AS upper FROM rows0),
w0 AS (SELECT *, number AS target, CAST(ceil(rows_ / upper) AS BIGINT) AS lower FROM sized, shuffles), {WALK_SQL},
errors AS (SELECT place, d.repeat, avg(abs(o.y - (9 + 0.0001 * CASE WHEN place = 0 THEN d.a ELSE o.a END
  + 0.6 * CASE WHEN place = 1 THEN d.n ELSE o.n END))) AS e
  FROM w{WALKS} d JOIN rows0 o ON o.number = d.target, (VALUES (0), (1)) p(place) GROUP BY 1, 2),
base AS (SELECT avg(abs(y - (9 + 0.0001 * a + 0.6 * n))) AS b FROM rows0)
SELECT CASE place WHEN 0 THEN 'acctbal' ELSE 'n_lines' END AS feature, round(avg(e - b), 6) AS pi_mean, round(stddev_pop(e - b), 6) AS pi_std
FROM errors, base GROUP BY place"""
)
def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error growth of a fixed linear predictor on the test year when a column is shuffled."""
    split = prepare_split(households(spark, sf_dir), NUMERIC_ROLES, settings())
    preparation = fit_preparation(split.train, split.features, PrepSettings())
    test = preparation.apply(split.test).withColumn("key", F.col("hh_id"))
    table = permutation_importance(
        test, preparation, lambda columns: 9 + 0.0001 * columns[0] + 0.6 * columns[1], repeats=REPEATS, seed=SEED
    )
    return rounded(table, pi_mean=6, pi_std=6)


VARIANCE_SQL = f"""WITH {HH} SELECT 1.0::DOUBLE AS importance_sum, true AS beats_mean, round(var_pop({LABEL}), 6) AS variance,
  count(*) AS n FROM te"""


def _invariants(scored: DataFrame, importance_sum: float) -> DataFrame:
    """What must hold for any sound model: shares sum to one, R2 above zero, RMSE and R2 agree."""
    metrics = scored.agg(*metric_columns("label", "yhat"), F.count(F.lit(1)).alias("n"))
    return metrics.select(
        F.lit(round(importance_sum, 6)).alias("importance_sum"),
        (F.col("R2") > 0).alias("beats_mean"),
        F.round(F.col("RMSE") * F.col("RMSE") / (1 - F.col("R2")), 6).alias("variance"),
        "n",
    )


def _job_invariants(run: ModelRun) -> DataFrame:
    return _invariants(run.known, sum(share for _, share in run.importances))


@query(VARIANCE_SQL)
def rf_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest job with all features and out-of-bag score."""
    forest = ForestSettings(n_trees=20, max_depth=5)
    return _job_invariants(run_forest(households(spark, sf_dir), ROLES, settings(), forest, oob=True))


@query(VARIANCE_SQL)
def boost_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosting job: L1/L2, gain threshold, sampling, early stopping on 15 % of the training rows."""
    boosting = BoostSettings(
        n_rounds=8, learning_rate=0.3, max_depth=3, alpha=0.5, min_child_weight=2, gamma=0.5, patience=3
    )
    return _job_invariants(run_boosting(households(spark, sf_dir), ROLES, settings(), boosting, val_size=0.15))


def _ml_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Preparation]:
    split = prepare_split(households(spark, sf_dir), ROLES, settings())
    preparation = fit_preparation(split.train, split.features, settings().prep)
    return preparation.apply(split.train), preparation.apply(split.test), preparation


def _ml_invariants(model, test: DataFrame, preparation: Preparation) -> DataFrame:
    scored = model.transform(preparation.with_vector(test)).withColumnRenamed("prediction", "yhat")
    return _invariants(scored, float(np.sum(model.featureImportances.toArray())))


@query(VARIANCE_SQL)
def rf_ml_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark ML's forest on the same design."""
    train, test, preparation = _ml_rows(spark, sf_dir)
    return _ml_invariants(fit_ml_forest(train, preparation, ForestSettings(n_trees=20, max_depth=5)), test, preparation)


@query(VARIANCE_SQL)
def gbt_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark ML's boosting on the same design."""
    train, test, preparation = _ml_rows(spark, sf_dir)
    quick = BoostSettings(n_rounds=10, learning_rate=0.3, max_depth=3)
    return _ml_invariants(fit_ml_boosting(train, preparation, quick), test, preparation)
