"""Filters, latest rows, top rows and set operations; all take column names, so they run on any table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Equality on each column whose value is given; None and '' ask for nothing."""
    asked = [F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None and v != ""]
    return df.filter(reduce(lambda a, b: a & b, asked)) if asked else df


def stable_only(column: str, null_is_stable: bool) -> Column:
    """Not a prerelease. A missing flag counts as stable in usages, not in dependency versions."""
    return ~F.coalesce(F.col(column), F.lit(False)) if null_is_stable else F.col(column) == F.lit(False)


def prefix(column: str, scope: str) -> Column:
    return F.col(column).startswith(f"{scope}/")


def effective_time(code: str = "code_at", scanned: str = "scanned_at") -> Column:
    """When the code was as it is, else when it was scanned, as an instant; null where neither parses."""
    return F.coalesce(F.col(code).try_cast("timestamp"), F.col(scanned).try_cast("timestamp"))


def latest_flag(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str = "is_latest") -> DataFrame:
    """``flag`` is true on the first row of each key in ``order``, which has to end in a tie-break."""
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return latest_flag(df, keys, order, "_first").filter("_first").drop("_first")


def distinct_list(column: str | Column) -> Column:
    """Sorted list of the different values of a group, a null among them if there is one."""
    value = F.col(column) if isinstance(column, str) else column
    return F.transform(F.sort_array(F.collect_set(F.struct(value.alias("v")))), lambda s: s["v"])


def members_by(df: DataFrame, by: Sequence[str], key: str, count: str = "project_count", listed: str = "projects") -> DataFrame:
    """by, count, listed: the different values of ``key`` in each group. The count is taken from the list, so one shuffle does."""
    grouped = df.groupBy(*by).agg(distinct_list(key).alias(listed))
    return grouped.select(*by, F.size(F.filter(listed, lambda x: x.isNotNull())).alias(count), listed)


def distinct_count(column: str | Column) -> Column:
    return F.count_distinct(column).cast("int")


def rows() -> Column:
    return F.count(F.lit(1)).cast("int")


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def members(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key), key, "left_semi")


def non_members(universe: DataFrame, some: DataFrame, key: str) -> DataFrame:
    return universe.select(key).distinct().join(some.select(key), key, "left_anti")


def union_distinct(frames: Sequence[DataFrame], column: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(column) for f in frames]).distinct()


def asc(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def desc(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]
