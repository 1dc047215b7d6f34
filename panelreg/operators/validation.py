"""Random validation rows from a seeded hash of the row key, without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from panelreg.functions.hashing import hash_rank, hash_uniform
from panelreg.operators.quantiles import KEPT_ROWS, order_statistics

FOLD = "fold"


def split_by_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Add ``fold`` (1 = validation) by a hash threshold: one expression, about ``share`` of the rows."""
    held = hash_uniform(F.col(key), seed) < share
    return df.withColumn(FOLD, held.cast("int"))


def split_exact(df: DataFrame, key: str, share: float, seed: int = 42, kept_rows: int = KEPT_ROWS) -> DataFrame:
    """Add ``fold`` (1 = validation) for exactly ceil(n * share) rows of a unique bigint key.

    The rows with the smallest hashes are held out. Their number is met by finding the hash of
    that rank; should several rows share that very hash, the smaller keys among them go first.
    Rows with equal keys stay together.
    """
    ranks = df.select(F.col(key).alias("key"), hash_rank(F.col(key), seed).alias("rank")).persist()
    count = ranks.count()
    wanted = math.ceil(count * share)
    rank = hash_rank(F.col(key), seed)
    if wanted == 0:
        held = F.lit(False)
    else:
        last = order_statistics(ranks, {"rank": (F.col("rank"), count, [wanted - 1])}, kept_rows)["rank", wanted - 1]
        held = rank <= last
        around = ranks.agg(F.count_if(F.col("rank") < last).alias("below"), F.count_if(F.col("rank") == last).alias("equal")).first()
        if around["below"] + around["equal"] > wanted:
            tied = F.when(F.col("rank") == last, F.col("key").cast("double"))
            place = wanted - around["below"] - 1
            top = order_statistics(ranks, {"key": (tied, around["equal"], [place])})["key", place]
            held = (rank < last) | ((rank == last) & (F.col(key) <= top))
    ranks.unpersist()
    return df.withColumn(FOLD, held.cast("int"))
