"""Distributions: versions, values, tools and packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.selection import asc, desc, distinct_count, first_rows, members_by, rows


def version_label(major: str, minor: str, unknown_minor: str | None = None) -> Column:
    """major.minor; 'unknown' without major, or with ``unknown_minor`` for a missing minor."""
    if unknown_minor is not None:
        return F.concat(F.col(major).cast("string"), F.lit("."), F.coalesce(F.col(minor).cast("string"), F.lit(unknown_minor)))
    return F.when(F.col(major).isNull(), "unknown").otherwise(F.concat_ws(".", F.col(major), F.col(minor)))


def version_spread(df: DataFrame, major: str, minor: str, key: str, unknown_minor: str | None = None) -> DataFrame:
    """label, major, minor, project_count in version order, unknown last."""
    counted = df.groupBy(F.col(major).alias("major"), F.col(minor).alias("minor")).agg(distinct_count(key).alias("project_count"))
    return counted.select(version_label("major", "minor", unknown_minor).alias("label"), "major", "minor", "project_count").orderBy(*asc("major", "minor"))


def category_counts(df: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """category, value, count of all ``columns`` in one pass; nulls don't count. With ``key``, its different values and their list."""
    long = df.select(*([key] if key else []), *[F.col(c).cast("string").alias(c) for c in columns])
    long = long.unpivot([key] if key else [], list(columns), "category", "value").filter("value IS NOT NULL")
    return members_by(long, ["category", "value"], key) if key else long.groupBy("category", "value").agg(rows().alias("count"))


def value_distribution(df: DataFrame, keys: Sequence[str], value: str = "value", kind: str = "value_type") -> DataFrame:
    """keys, value, n: how often each fixed value occurs ('null' for null), and '[dynamic]' for all others."""
    shown = F.when(F.col(kind) == "dynamic", "[dynamic]").otherwise(F.coalesce(F.col(value), F.lit("null")))
    return df.groupBy(*keys, shown.alias("value")).agg(rows().alias("n"))


def snippet_previews(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[Column], n: int = 3, snippet: str = "source_snippet") -> DataFrame:
    """keys, preview: the line that holds the name (else the first), trimmed, of the first ``n`` snippets of each key."""
    lines = F.split(F.col(snippet), "\n")
    hits = F.filter(lines, lambda line: F.contains(line, F.col(name)))
    line = F.trim(F.coalesce(F.get(hits, F.lit(0)), F.get(lines, F.lit(0))))
    chosen = first_rows(df.filter(F.col(snippet).isNotNull()), keys, order, n)
    return chosen.select(*keys, line.alias("preview"))


def nested_values(df: DataFrame, outer: str, inner: str, props: int = 4, values: int = 2) -> DataFrame:
    """outer, inner, value, n: of each outer name its most used inner names, and of these the commonest fixed values."""
    used = df.groupBy(outer, inner).agg(rows().alias("uses"))
    used = first_rows(used, [outer], [*desc("uses"), *asc(inner)], props)
    spread = value_distribution(df, [outer, inner]).join(used.select(outer, inner), [outer, inner])
    fixed = first_rows(spread.filter("value != '[dynamic]'"), [outer, inner], [*desc("n"), *asc("value")], values)
    return fixed.unionByName(spread.filter("value = '[dynamic]'"))


def conditional_counts(df: DataFrame, by: str, key: str, column: str, named: dict[str, str]) -> DataFrame:
    """by, project_count, and for each name the different keys where ``column`` has its value."""
    return df.groupBy(by).agg(distinct_count(key).alias("project_count"), *[distinct_count(F.when(F.col(column) == v, F.col(key))).alias(n) for n, v in named.items()])


def tool_matrix(df: DataFrame, tool: str, key: str, tools: Sequence[str]) -> DataFrame:
    """A row for each key, a column for each tool: whether it is there."""
    pivot = df.groupBy(key).pivot(tool, list(tools)).agg(F.count(F.lit(1)))
    return pivot.select(key, *[(F.coalesce(F.col(f"`{t}`"), F.lit(0)) > 0).alias(t) for t in tools])


def usage_summary(components: DataFrame, functions: DataFrame, by: str = "package_name") -> DataFrame:
    """by, component and call totals, and sorted lists of files, components and functions."""
    left = components.select(by, "file_path", F.col("component_name").alias("c"), F.lit(None).cast("string").alias("f"))
    right = functions.select(by, "file_path", F.lit(None).cast("string").alias("c"), F.col("export_name").alias("f"))
    both = left.unionByName(right)
    return both.groupBy(by).agg(
        F.count("c").cast("int").alias("total_component_usages"), F.count("f").cast("int").alias("total_function_calls"),
        F.sort_array(F.collect_set("file_path")).alias("files"), F.sort_array(F.collect_set("c")).alias("components"), F.sort_array(F.collect_set("f")).alias("functions"),
    )


def adoption_by_project(declared: DataFrame, used: Sequence[DataFrame], key: str = "project_id") -> DataFrame:
    """key, usage_count: declared keys begin at 0, each usage adds 1."""
    all_ = declared.select(key, F.lit(0).alias("n"))
    for u in used:
        all_ = all_.unionByName(u.select(key, F.lit(1).alias("n")))
    return all_.groupBy(key).agg(F.sum("n").cast("int").alias("usage_count"))
