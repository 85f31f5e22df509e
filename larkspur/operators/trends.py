"""Adoption over time and sampling of commits.

No theta joins: a trend is a running sum of changes over the distinct periods, so its cost is a pass over the rows and
a window over the periods.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def month_series(spark: SparkSession, as_of: date | str, months: int) -> DataFrame:
    """period: the first days of the ``months`` months up to that of ``as_of``."""
    this = F.trunc(F.lit(str(as_of)).cast("date"), "month")
    return spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("g")).select(F.add_months(this, -F.col("g")).alias("period"))


def first_seen_trend(rows: DataFrame, key: str, at: Column, as_of: date | str, months: int) -> DataFrame:
    """period, adopting_projects: keys first seen up to each month. Months without any are absent; it never falls."""
    first = rows.select(F.col(key).alias("k"), F.trunc(at.cast("date"), "month").alias("m")).filter("m IS NOT NULL").groupBy("k").agg(F.min("m").alias("m"))
    began = first.groupBy("m").agg(F.count("*").alias("n"))
    # a row a month at most from here on; months before the first one count towards it
    periods = month_series(rows.sparkSession, as_of, months).select("period", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("shown"))
    events = periods.unionByName(began.select(F.col("m").alias("period"), "n", F.lit(False).alias("shown")))
    run = Window.orderBy("period").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.select("period", "shown", F.sum("n").over(run).cast("int").alias("adopting_projects"))
    return counted.filter("shown AND adopting_projects > 0").drop("shown").orderBy("period")


def carry_forward(snapshots: DataFrame, presence: DataFrame, key: str = "project_id", day: str = "day", value: str | None = None, out: str = "project_count") -> DataFrame:
    """``day``, ``out``: over the keys whose last snapshot up to each day has a row of ``presence``, their number or the sum of ``value``.

    snapshots: (key, day); presence: (key, day[, value]). A key's state holds from its snapshot to its next one.
    """
    days = snapshots.select(key, day).filter(F.col(day).isNotNull()).distinct()
    spans = days.withColumn("until", F.lead(day).over(Window.partitionBy(key).orderBy(day)))
    amount = F.sum(value) if value else F.lit(1)
    held = presence.groupBy(key, day).agg(amount.cast("bigint").alias("v"))
    alive = spans.join(held, [key, day])
    changes = alive.select(F.col(day), F.col("v"), F.lit(1).alias("n")).unionByName(alive.filter("until IS NOT NULL").select(F.col("until").alias(day), (-F.col("v")).alias("v"), F.lit(-1).alias("n")))
    changes = changes.groupBy(day).agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    # one row a day from here on
    timeline = days.select(day).distinct().join(changes, day, "left").fillna(0, ["v", "n"])
    run = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    total = timeline.select(day, F.sum("v").over(run).alias("v"), F.sum("n").over(run).alias("n"))
    return total.filter("n > 0").select(day, F.col("v").cast("int").alias(out)).orderBy(day)


def checkpoint_sample(commits: DataFrame, epoch_ms: str, interval_ms: int, keys: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """The latest row of each interval since 1970; empty intervals give none. Newest first."""
    bucket = F.floor(F.col(epoch_ms) / F.lit(interval_ms))
    order = [F.col(epoch_ms).desc(), *([F.col(tie).desc()] if tie else [])]
    ranked = commits.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return ranked.filter("_r = 1").drop("_b", "_r").orderBy(*keys, F.col(epoch_ms).desc())


def with_baseline(sampled: DataFrame, commits: DataFrame, since_ms: int, id_col: str = "sha", epoch_ms: str = "epoch_ms") -> DataFrame:
    """``sampled`` and the last commit up to ``since_ms``, unless it is among them, with the start as its time (code_at_ms)."""
    base = commits.filter(F.col(epoch_ms) <= since_ms).orderBy(F.col(epoch_ms).desc(), F.col(id_col).desc()).limit(1)
    base = base.join(sampled.select(id_col), id_col, "left_anti").withColumn("code_at_ms", F.lit(since_ms).cast("bigint"))
    return sampled.withColumn("code_at_ms", F.col(epoch_ms).cast("bigint")).unionByName(base)
