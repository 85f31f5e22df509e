"""Keys that hold a large part of all rows, so that they can be taken out of a shuffle by key.

A row's key is counted on rows of one in ``SAMPLED`` ids by hash. That only chooses a way: callers treat hot and other
keys exactly, by different plans, so results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One in so many ids is counted; a key is hot above one in ``HOT`` of the rows counted and ``LEAST`` of them.
SAMPLED, HOT, LEAST = 64, 1000, 20


def hot_keys(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """Column ``key`` of the hot ones: fewer than ``HOT`` rows, as each holds over one in ``HOT``, so it may be broadcast."""
    some = rows.filter(F.pmod(F.xxhash64(id_col, F.lit(31)), F.lit(SAMPLED)) == 0)
    total = some.count()
    found = some.groupBy(key).count().filter(F.col("count") > max(LEAST, total // HOT)).select(key).collect()
    return rows.sparkSession.createDataFrame(found, rows.select(key).schema)


def split(rows: DataFrame, hot: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of hot keys, the others)."""
    return rows.join(F.broadcast(hot), key, "left_semi"), rows.join(F.broadcast(hot), key, "left_anti")
