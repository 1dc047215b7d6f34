"""Reproducible per-row randomness.

A row gets its random numbers from an integer key and a seed or stream number, never from its
place in a partition, so a recomputed task draws the same numbers. Columns that a plan filters
or groups by use a digest of the key. Code inside tasks, which draws once per row and tree, uses
a 32-bit integer mixer on numpy arrays; its products stay below 2**63.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values of the 32-bit mixer.
MULTIPLIER = 73244475
WORD = 0xFFFFFFFF
RANGE = 4294967296.0


def mix_int(x: int) -> int:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MULTIPLIER) & WORD
    return x ^ (x >> 16)


def stream_word(seed: int, *parts: int) -> int:
    """One 32-bit word for a seed and a stream such as (tree,) or (column, repeat)."""
    word = mix_int(seed & WORD)
    for part in parts:
        word = mix_int(word ^ (part & WORD))
    return word


def digest_number(key: Column, seed: int, digits: int) -> Column:
    """The first hexadecimal digits of the key's digest as an exact double."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("double")


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) per key."""
    return digest_number(key, seed, 8) / F.lit(RANGE)


def hash_rank(key: Column, seed: int) -> Column:
    """52 random bits as an exact double: a sort key whose ties are negligible at any size."""
    return digest_number(key, seed, 13)


def mix_array(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MULTIPLIER) & WORD
    return x ^ (x >> 16)


def word_array(key: np.ndarray, stream: int) -> np.ndarray:
    inner = mix_array(((key >> 32) & WORD) ^ stream)
    return mix_array((key & WORD) ^ inner)


def uniform_array(key: np.ndarray, stream: int) -> np.ndarray:
    return word_array(key, stream) / RANGE


def poisson_steps() -> list[float]:
    """Values of the Poisson(1) distribution function, up to the resolution of 32 bits."""
    steps, mass, total, k = [], math.exp(-1.0), 0.0, 0
    while mass > 0.5 / RANGE:
        total += mass
        steps.append(total)
        k += 1
        mass /= k
    return steps


def poisson_array(key: np.ndarray, stream: int) -> np.ndarray:
    return np.searchsorted(np.array(poisson_steps()), uniform_array(key, stream), side="right")
