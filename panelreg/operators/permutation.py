"""Permutation importance: how much the error grows when one input column is shuffled.

Rows are numbered without gaps, in the order of their key. A permutation of the numbers is a Feistel
network: a number is a pair of digits, and in turn each digit is moved by a hash of the other. That is a
bijection on all pairs; a result beyond the last number goes through it again until it isn't (the pairs are
only just more than the numbers, so this is rare). So every row can tell by itself which row its values
go to. One such permutation serves all columns of a repeat: rows meet their donors in one join by
number, which is unique on both sides, and a batch of joined rows yields the errors of all columns.
No group of rows is held anywhere, and a lost task is done again with the same numbers. Keys have to be unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelreg.functions.hashing import stream_word, word_array
from panelreg.operators.preprocess import Preparation
from panelreg.session import StoredTable

SHUFFLE = 5
ROUNDS = 4


def digits(n: int) -> tuple[int, int]:
    """Ranges of the two digits of numbers below n."""
    upper = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return upper, max(-(-n // upper), 1)


def permuted(number: np.ndarray, n: int, seed: int, repeat: int) -> np.ndarray:
    """Where the numbers 0 to n - 1 go in the permutation of a repeat."""
    upper, lower = digits(n)
    moved = number.astype(np.int64)
    open_ = np.arange(len(moved))
    while len(open_):
        left, right = np.divmod(moved[open_], lower)
        for step in range(ROUNDS):
            stream = stream_word(seed, SHUFFLE, repeat, step)
            if step % 2 == 0:
                left = (left + word_array(right, stream)) % upper
            else:
                right = (right + word_array(left, stream)) % lower
        moved[open_] = left * lower + right
        open_ = open_[moved[open_] >= n]
    return moved


def numbered(rows: DataFrame, key: str = "key") -> tuple[StoredTable, DataFrame, int]:
    """The written rows, the same with ``number`` (from 0, without gaps, in the order of the key), and how many there are."""
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    stored = StoredTable(ordered.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    sizes = stored.frame.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, total = [], 0
    for number, n in sorted(tuple(r) for r in sizes):
        starts.append((number, total))
        total += n
    # a line for each partition
    known = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    frame = stored.frame.withColumn("_part", part).join(known, "_part").withColumn("number", F.col("_start") + inside)
    return stored, frame.drop("_place", "_part", "_start"), total


def donated(rows: DataFrame, columns: list[str], n: int, repeats: int, seed: int) -> DataFrame:
    """repeat, number (of the row that the values go to) and the values as donor_0, donor_1, ..."""
    wanted = rows.select("number", *columns)
    names = ["repeat", "number", *(f"donor_{i}" for i in range(len(columns)))]
    kinds = ["int", "long", *(wanted.schema[c].dataType.simpleString() for c in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for repeat in range(repeats):
                target = permuted(number, n, seed, repeat)
                fixed = [pa.array(np.full(len(number), repeat, np.int32)), pa.array(target)]
                yield pa.RecordBatch.from_arrays([*fixed, *batch.columns[1:]], names)

    return wanted.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds, strict=True)))


def shuffled_errors(
    rows: DataFrame,
    columns: list[str],
    predict: Callable[[list[np.ndarray]], np.ndarray],
    *,
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(place, repeat, error): mean absolute error of ``label`` with the column at that place shuffled.

    ``rows`` has ``key`` (bigint), ``label`` and the prepared columns. Place -1 is the unshuffled table.
    """
    stored, table, n = numbered(rows.select("key", F.col("label").cast("double"), *columns))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[float]] = {}
        for batch in batches:
            repeat, truth, *data = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            own, donors = data[: len(columns)], data[len(columns) :]
            for r in np.unique(repeat).tolist():
                mine = repeat == r
                kept = [c[mine] for c in own]
                # the unshuffled error is counted once
                for place in range(0 if r else -1, len(columns)):
                    mixed = kept if place < 0 else [*kept[:place], donors[place][mine], *kept[place + 1 :]]
                    found = sums.setdefault((place, r), [0.0, 0])
                    found[0] += float(np.abs(truth[mine] - predict(mixed)).sum())
                    found[1] += int(mine.sum())
        lines = [(place, r, total, count) for (place, r), (total, count) in sums.items()]
        yield pa.RecordBatch.from_pydict(
            {
                "place": pa.array([x[0] for x in lines], pa.int32()),
                "repeat": pa.array([x[1] for x in lines], pa.int32()),
                "total": pa.array([x[2] for x in lines], pa.float64()),
                "n": pa.array([x[3] for x in lines], pa.int64()),
            }
        )

    both = donated(table, columns, n, repeats, seed).join(table.drop("key"), "number")
    parts = both.select("repeat", "label", *columns, *(f"donor_{i}" for i in range(len(columns))))
    summed = parts.mapInArrow(errors, "place int, repeat int, total double, n long").groupBy("place", "repeat")
    result = summed.agg((F.sum("total") / F.sum("n")).alias("error"))
    # a line for each column and repeat: kept as rows, so that the numbered table can go
    found = rows.sparkSession.createDataFrame(result.collect(), result.schema)
    stored.drop()
    return found


def permutation_importance(
    rows: DataFrame,
    preparation: Preparation,
    predict: Callable[[list[np.ndarray]], np.ndarray],
    *,
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(feature, pi_mean, pi_std) per input column, on the learning scale, largest first."""
    errors = shuffled_errors(rows, preparation.prepared_columns, predict, repeats=repeats, seed=seed)
    names = F.array(*[F.lit(c) for c in preparation.source_columns])
    # (column, repeat) lines only from here on; the unshuffled error rides along in every group
    lines = errors.groupBy().agg(
        F.max(F.when(F.col("place") == -1, F.col("error"))).alias("base"),
        F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "error"))).alias("lines"),
    )
    return (
        lines.select("base", F.inline("lines"))
        .groupBy("place", "base")
        .agg(F.avg("error").alias("mean"), F.stddev_pop("error").alias("pi_std"))
        .select(F.get(names, F.col("place")).alias("feature"), (F.col("mean") - F.col("base")).alias("pi_mean"), "pi_std")
        .orderBy(F.desc("pi_mean"), "feature")
    )
