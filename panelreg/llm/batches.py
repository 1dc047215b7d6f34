"""Whole texts of an Arrow batch as numpy arrays: code points, runs of them, hashes of the runs.

Rows are worked off in parts of at most ``PART_CHARS`` characters (one text at least), so memory
depends on the longest text and not on the number of rows.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_CHARS = 600_000

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

OTHER, LETTER, NUMBER, SPACE = range(4)

_BASE = np.uint64(0x9E3779B97F4A7C55)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as this Python process: for what every task of a worker needs."""
    home = sys.modules.setdefault("_panelreg_worker_store", types.ModuleType("_panelreg_worker_store"))
    return home.__dict__.setdefault(name, {})


def forget_others(*names: str) -> None:
    """Give back the memory of stores that earlier stages of this Python process filled, but for the named ones."""
    home = sys.modules.get("_panelreg_worker_store")
    stale = [n for n, store in (vars(home).items() if home else ()) if isinstance(store, dict) and not n.startswith("__") and n not in names and store]
    for name in stale:
        vars(home)[name].clear()
    if stale:
        gc.collect()
        give_back()


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Task) -> Task:
    """The same function of a task's batches; freed memory goes back before the worker waits for its next task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidy


class Recent:
    """A dictionary of at most about twice ``size`` entries that forgets what wasn't asked for lately."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: Sequence[str]) -> list[int]:
        """Places of the keys that aren't known; the others are in ``new`` afterwards."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        found = [i for i, key in enumerate(keys) if key not in new]
        if not old:
            return found
        new.update((key, old[key]) for i in found if (key := keys[i]) in old)
        return [i for i in found if keys[i] not in new]


def parts(lengths: Sequence[int], limit: int = PART_CHARS) -> Iterator[slice]:
    """Neighbouring rows that have at most ``limit`` characters together, or are a single row."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield slice(first, len(lengths))


def text_parts(column: pa.Array, limit: int = PART_CHARS) -> Iterator[tuple[slice, list[str]]]:
    """The ``parts`` of a batch, and the texts of one after the other as Python's; null is empty."""
    for part in parts(pc.utf8_length(column).fill_null(0).to_pylist(), limit):
        yield part, [t or "" for t in column[part].to_pylist()]


def codepoints(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters in one array, and where each text begins; the last entry is the end."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), ends


def char_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point."""
    store = worker_store("classes")
    if "table" not in store:
        table = np.zeros(0x110000, np.uint8)
        # letters and numbers beyond the supplementary planes 0 to 3 don't exist
        for cp in range(0x40000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                table[cp] = LETTER
            elif kind == "N":
                table[cp] = NUMBER
            elif chr(cp).isspace() and not 0x1C <= cp <= 0x1F:
                table[cp] = SPACE
        store["table"] = table
    return store["table"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64)
    high = x >> np.uint64(30)
    x ^= high
    x *= _MIX[0]
    np.right_shift(x, np.uint64(27), out=high)
    x ^= high
    x *= _MIX[1]
    np.right_shift(x, np.uint64(31), out=high)
    x ^= high
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base modulo 2**64, and their inverses."""
    store = worker_store("powers")
    if len(store.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            store[name] = np.multiply.accumulate(row)
    return store["up"][: n + 1], store["down"][: n + 1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:end]``, from one prefix sum over all values.

    Long runs can be made that share it: it draws features, and doesn't tell runs apart."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed(values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    total = (sums[ends] - sums[starts]) * down[starts]
    return mixed(total ^ ((ends - starts).astype(np.uint64) * _BASE))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    places = np.repeat(starts - before, lengths)
    places += np.arange(len(places))
    return places


def distinct_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each set of equal runs ``values[start:end]``, and for each run its set; compared value by value.

    Values are below 2 ** 21."""
    sizes = ends - starts
    cuts = np.append(0, np.cumsum(sizes))
    # positions in four bytes where they fit: half the memory to go through
    small = np.int32 if len(values) < 1 << 31 and cuts[-1] < 1 << 31 else np.int64
    at = np.arange(int(cuts[-1]), dtype=small)
    at += np.repeat((starts - cuts[:-1]).astype(small), sizes)
    own = values[at]
    # the place in the run above the value, and one for a value of zero
    cells = (at - np.repeat(starts.astype(small), sizes)).astype(np.uint64)
    cells <<= np.uint64(21)
    cells += own.astype(np.uint64, copy=False)
    cells += np.uint64(1)
    sums = np.zeros(len(cells) + 1, np.uint64)
    np.cumsum(mixed(cells), out=sums[1:])
    names = sums[cuts[1:]] - sums[cuts[:-1]]
    _, first, group = np.unique(names, return_index=True, return_inverse=True)
    model = first[group]
    other = sizes != sizes[model]
    if not other.any():
        at += np.repeat((starts[model] - starts).astype(small), sizes)
        differs = own != values[at]
        if differs.any():
            other = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[differs], minlength=len(sizes)) > 0
    if not other.any():
        return first, group
    # runs that share a sum without being equal: all runs are told apart one by one
    known: dict[bytes, int] = {}
    group = np.array([known.setdefault(values[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(group, return_index=True)[1], group


def word_runs(cps: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of characters marked ``inside``; no run crosses two texts."""
    before = np.zeros(len(cps) + 1, bool)
    before[1:] = inside
    edge = np.zeros(len(cps) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.ones(len(cps) + 1, bool)
    after[:-1] = ~inside
    stops = np.flatnonzero(inside & (after[1:] | edge[1:])) + 1
    return starts, stops
