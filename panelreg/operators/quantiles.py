"""Exact quantiles of many columns without sorting or shuffling the rows.

Spark's exact ``percentile`` holds every distinct value of a column in one task. Here each order
statistic is found by narrowing, whatever the table's size: a mergeable sketch proposes pivots, an exact count says between which pivots the wanted rank
lies, and the next pass looks only there. Sketch errors cost passes, never exactness; a value
that a third of the rows share becomes a pivot and is counted, not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Values per order statistic that may be listed once the search is that narrow.
KEPT_ROWS = 4_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """The value at 0-based ``rank`` of ``column``, known to lie strictly inside (low, high)."""

    column: Column
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self) -> Column:
        test = self.column.isNotNull()
        if self.low is not None:
            test = test & (self.column > self.low)
        if self.high is not None:
            test = test & (self.column < self.high)
        return test

    def kept(self) -> Column:
        return F.when(self.within(), self.column)

    def probes(self) -> list[float]:
        place = (self.rank - self.below) / max(self.inside - 1, 1)
        margin = 2.0 / SKETCH_ACCURACY
        return [min(max(place + shift, 0.0), 1.0) for shift in (-margin, 0.0, margin)]

    def place_among(self, pivots: list[float], less: list[int], equal: list[int]) -> None:
        """Move the bounds to the gap between pivots that holds the rank, or finish on a pivot."""
        below, inside, low, high = self.below, self.inside, self.low, self.high
        end = below + inside
        for pivot, n_less, n_equal in zip(pivots, less, equal):
            first = below + n_less
            if self.rank < first:
                high, end = pivot, first
                break
            if self.rank < first + n_equal:
                self.value = pivot
                return
            low, start = pivot, first + n_equal
            self.below = start
        self.low, self.high, self.inside = low, high, end - self.below


def order_statistics(
    df: DataFrame, wanted: Mapping[str, tuple[Column, int, Iterable[int]]], kept_rows: int = KEPT_ROWS
) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks. ``wanted`` maps a name to (column, non-null count, ranks)."""
    searches = {
        (name, rank): _Search(column, rank, count)
        for name, (column, count, ranks) in wanted.items()
        for rank in dict.fromkeys(ranks)
    }
    while True:
        wide = [s for s in searches.values() if s.value is None and s.inside > kept_rows]
        if not wide:
            break
        _narrow(df, wide)
    rest = [s for s in searches.values() if s.value is None]
    if rest:
        row = df.agg(*[F.sort_array(F.collect_list(s.kept())).alias(f"v{i}") for i, s in enumerate(rest)]).first()
        for i, search in enumerate(rest):
            search.value = row[f"v{i}"][search.rank - search.below]
    return {key: float(search.value) for key, search in searches.items()}


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    sketch = df.agg(
        *[
            F.percentile_approx(s.kept(), s.probes(), SKETCH_ACCURACY).alias(f"p{i}")
            for i, s in enumerate(searches)
        ]
    ).first()
    pivots = [sorted(set(sketch[f"p{i}"])) for i in range(len(searches))]
    counts = df.agg(
        *[
            count
            for i, s in enumerate(searches)
            for j, pivot in enumerate(pivots[i])
            for count in (
                F.count_if(s.within() & (s.column < pivot)).alias(f"l{i}_{j}"),
                F.count_if(s.column == pivot).alias(f"e{i}_{j}"),
            )
        ]
    ).first()
    for i, search in enumerate(searches):
        places = range(len(pivots[i]))
        search.place_among(pivots[i], [counts[f"l{i}_{j}"] for j in places], [counts[f"e{i}_{j}"] for j in places])


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, tuple[Column, Sequence[float]]],
    *,
    counts: Mapping[str, int] | None = None,
    kept_rows: int = KEPT_ROWS,
) -> dict[str, list[float] | None]:
    """Quantiles with linear interpolation over the non-null values; None for an empty column."""
    if not wanted:
        return {}
    if counts is None:
        row = df.agg(*[F.count(column).alias(name) for name, (column, _) in wanted.items()]).first()
        counts = row.asDict()
    filled = {name: spec for name, spec in wanted.items() if counts[name]}
    result: dict[str, list[float] | None] = dict.fromkeys(wanted)
    places = {name: [q * (counts[name] - 1) for q in qs] for name, (_, qs) in filled.items()}
    values = order_statistics(
        df,
        {
            name: (column, counts[name], [r for h in places[name] for r in (math.floor(h), math.ceil(h))])
            for name, (column, _) in filled.items()
        },
        kept_rows,
    )
    for name, positions in places.items():
        result[name] = [
            values[name, math.floor(h)] + (values[name, math.ceil(h)] - values[name, math.floor(h)]) * (h - math.floor(h))
            for h in positions
        ]
    return result


def filled_quantiles(
    df: DataFrame, counts: Mapping[str, int], rows: int, bounds: Sequence[float], kept_rows: int = KEPT_ROWS
) -> dict[str, tuple[float, list[float]]]:
    """Median of each column, and the quantiles ``bounds`` of it after its gaps were filled with the median.

    One search serves both: ``gaps`` more medians move a rank of the filled column by at most that many
    places, so its value is the middle one of the median and the values at both ranks of the raw column.
    """
    inner = {name: (count - 1) / 2 for name, count in counts.items()}
    outer = [q * (rows - 1) for q in bounds]
    wanted, edges = {}, dict.fromkeys(r for h in outer for r in (math.floor(h), math.ceil(h)))
    for name, count in counts.items():
        ranks = [math.floor(inner[name]), math.ceil(inner[name])]
        ranks += [r for edge in edges for r in (edge, edge - (rows - count)) if 0 <= r < count]
        wanted[name] = (F.col(name), count, ranks)
    values = order_statistics(df, wanted, kept_rows)
    result = {}
    for name, count in counts.items():
        h, gaps = inner[name], rows - count
        low, high = values[name, math.floor(h)], values[name, math.ceil(h)]
        median = low + (high - low) * (h - math.floor(h))

        def filled(rank: int) -> float:
            return sorted((values.get((name, rank), math.inf), median, values.get((name, rank - gaps), -math.inf)))[1]

        found = []
        for h in outer:
            low, high = filled(math.floor(h)), filled(math.ceil(h))
            found.append(low + (high - low) * (h - math.floor(h)))
        result[name] = (median, found)
    return result
