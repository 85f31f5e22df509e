"""The thirteen tool queries over the six tables. Orders are total, so limits cut the same rows every time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.selection import asc, desc, distinct_count, distinct_list, effective_time, members_by, optional_filters, prefix, stable_only, top
from larkspur.operators.trends import first_seen_trend
from larkspur.sources.tables import Tables

#: Columns of a snapshot that count as tooling (fixed values).
CATEGORIES = ("test_framework", "build_tool", "package_manager", "bundler", "linter", "formatter", "css_approach", "framework", "typescript")


def stale(days: int, as_of: str | None) -> F.Column:
    now = F.lit(as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return F.col("scanned_at").try_cast("timestamp") < now - F.make_dt_interval(F.lit(int(days)))


def version_filters(df: DataFrame, major: object, include_prerelease: bool | None) -> DataFrame:
    if isinstance(major, int) and not isinstance(major, bool):
        df = df.filter(F.col("package_version_major") == major)
    return df if include_prerelease is True else df.filter(stable_only("package_version_is_prerelease", null_is_stable=True))


def get_scan_metadata(t: Tables, as_of: str | None = None, latest_only: bool = False) -> DataFrame:
    """One row over all scans. A project with any old scan counts as stale, unless ``latest_only``."""
    df = t.project_snapshots.filter("is_latest") if latest_only else t.project_snapshots
    return df.agg(
        distinct_count("project_id").alias("project_count"),
        F.min("scanned_at").alias("oldest_scan"), F.max("scanned_at").alias("newest_scan"),
        F.min("code_at").alias("oldest_code_at"), F.max("code_at").alias("newest_code_at"),
        distinct_list("schema_version").alias("schema_versions"),
        distinct_count(F.when(stale(7, as_of), F.col("project_id"))).alias("stale_project_count"),
    )


def list_projects(t: Tables, framework: str | None = None, build_tool: str | None = None, stale_after_days: int = 7, as_of: str | None = None, project_id: str | None = None, limit: int = 100) -> DataFrame:
    df = optional_filters(t.latest("project_snapshots"), {"framework": framework, "build_tool": build_tool, "project_id": project_id})
    shown = df.select("project_id", "repo_url", "scanned_at", "framework", "build_tool", "test_framework", "typescript", "package_manager", stale(stale_after_days, as_of).alias("is_stale"))
    return top(shown, asc("project_id"), limit)


def list_packages(t: Tables, scope: str | None = None, dep_type: str | None = None, internal_only: bool = False) -> DataFrame:
    df = optional_filters(t.latest("dependencies"), {"dep_type": dep_type})
    df = df.filter(prefix("package_name", scope)) if scope else df
    df = df.filter("is_internal") if internal_only is True else df
    counted = df.groupBy("package_name").agg(distinct_count("project_id").alias("project_count"), distinct_list("version_resolved").alias("versions_seen"))
    return top(counted, [*desc("project_count"), *asc("package_name")], 100)


def project_snapshot_row(t: Tables, project_id: str) -> DataFrame:
    return top(t.latest("project_snapshots").filter(F.col("project_id") == project_id), desc("scanned_at", "commit_sha"), 1)


def project_dependencies(t: Tables, project_id: str, limit: int | None = 500) -> DataFrame:
    df = t.latest("dependencies").filter(F.col("project_id") == project_id)
    df = df.select("package_name", "version_range", "version_resolved", "dep_type", "is_internal")
    order = asc("dep_type", "package_name", "version_resolved", "version_range", "is_internal")
    return top(df, order, limit) if limit else df.orderBy(*order)


def get_project_snapshot(t: Tables, project_id: str) -> DataFrame:
    """One row: snapshot (null if none) and the array of its dependencies."""
    deps = project_dependencies(t, project_id)
    shown = deps.agg(F.array_sort(F.collect_list(F.struct("dep_type", "package_name", "version_resolved", "version_range", "is_internal"))).alias("dependencies"))
    row = project_snapshot_row(t, project_id)
    return shown.join(row.select(F.struct(*row.columns).alias("snapshot")), F.lit(True), "left").select("snapshot", "dependencies")


def query_dependency_versions(t: Tables, package_name: str, dep_type: str | None = None, include_prerelease: bool = False) -> DataFrame:
    df = optional_filters(t.latest("dependencies"), {"package_name": package_name, "dep_type": dep_type})
    df = df if include_prerelease is True else df.filter(stable_only("version_is_prerelease", null_is_stable=False))
    by = ["version_resolved", "version_major", "version_minor", "version_patch", "version_prerelease"]
    counted = members_by(df, by, "project_id")
    return top(counted, [*desc("version_major", "version_minor", "version_patch"), *asc("version_resolved", "version_prerelease")], 100)


def query_prerelease_usage(t: Tables, package_name: str, prerelease_filter: str | None = None) -> DataFrame:
    df = t.latest("dependencies").filter((F.col("package_name") == package_name) & F.col("version_is_prerelease"))
    df = df.filter(F.contains("version_prerelease", F.lit(prerelease_filter))) if prerelease_filter else df
    counted = members_by(df, ["version_resolved", "version_prerelease"], "project_id")
    return top(counted, [*desc("project_count"), *asc("version_resolved")], 100)


def query_tooling_distribution(t: Tables, category: str) -> DataFrame:
    if category not in CATEGORIES:
        raise ValueError(f"{category!r} isn't one of {', '.join(CATEGORIES)}")
    df = t.latest("project_snapshots").select("project_id", F.col(category).cast("string").alias("value")).filter("value IS NOT NULL")
    counted = members_by(df, ["value"], "project_id")
    return top(counted, [*desc("project_count"), *asc("value")], 100)


def query_component_usage(t: Tables, package_name: str, component_name: str, package_version: int | None = None, include_prerelease: bool = False) -> DataFrame:
    df = optional_filters(t.latest("component_usages"), {"package_name": package_name, "component_name": component_name})
    df = version_filters(df, package_version, include_prerelease)
    return top(df.select("project_id", "file_path", "line", "package_version_resolved"), asc("project_id", "file_path", "line", "package_version_resolved"), 100)


PROP_COLUMNS = ["project_id", "file_path", "line", "prop_name", "value_type", "value", "source_snippet"]


def query_prop_usage(t: Tables, package_name: str, component_name: str, prop_name: str | None = None, package_version: int | None = None, include_prerelease: bool = False) -> DataFrame:
    df = optional_filters(t.latest("component_prop_usages"), {"package_name": package_name, "component_name": component_name, "prop_name": prop_name})
    df = version_filters(df, package_version, include_prerelease).select(*PROP_COLUMNS, "package_version_resolved")
    return top(df, asc("prop_name", "project_id", "file_path", "line", "value_type", "value", "package_version_resolved"), 200)


def query_component_adoption_trend(t: Tables, package_name: str, component_name: str | None = None, period_months: int = 12, as_of: str | None = None) -> DataFrame:
    df = optional_filters(t.component_usages, {"package_name": package_name, "component_name": component_name})
    return _trend(df, period_months, as_of)


def query_export_adoption_trend(t: Tables, package_name: str, export_name: str, period_months: int = 12, as_of: str | None = None) -> DataFrame:
    return _trend(optional_filters(t.function_usages, {"package_name": package_name, "export_name": export_name}), period_months, as_of)


def _trend(df: DataFrame, months: int, as_of: str | None) -> DataFrame:
    df = df.filter(stable_only("package_version_is_prerelease", null_is_stable=True))
    trend = first_seen_trend(df, "project_id", effective_time(), as_of or datetime.now(timezone.utc).date().isoformat(), months)
    return trend.select(F.col("period").cast("string").alias("period"), "adopting_projects").orderBy("period")


def query_export_usage(t: Tables, package_name: str, export_name: str, package_version: int | None = None, include_prerelease: bool = False) -> DataFrame:
    """Call sites and their arguments; a call without any has a row of nulls. Calls that share a line share arguments."""
    calls = optional_filters(t.latest("function_usages"), {"package_name": package_name, "export_name": export_name})
    calls = version_filters(calls, package_version, include_prerelease)
    keys = ["project_id", "scanned_at", "file_path", "line", "export_name"]
    # the export's name is among the keys, so its filter holds on both sides before the shuffle
    args = t.function_arg_usages.filter(F.col("export_name") == export_name).select(*keys, "arg_index", "value_type", "value", "source_snippet")
    joined = calls.select(*keys, "package_version_resolved").join(args, keys, "left")
    shown = joined.select("project_id", "file_path", "line", "arg_index", "value_type", "value", "source_snippet", "package_version_resolved")
    return top(shown, asc("project_id", "file_path", "line", "arg_index", "value_type", "value", "package_version_resolved", "source_snippet"), 100)


def get_source_context(t: Tables, project_id: str, file_path: str, line: int, prop_name: str | None = None, arg_index: int | None = None) -> DataFrame:
    """No row or one: source_snippet, value_type, value."""
    if prop_name is None and arg_index is None:
        raise ValueError("prop_name or arg_index has to be given")
    table, at = ("component_prop_usages", F.col("prop_name") == prop_name) if prop_name is not None else ("function_arg_usages", F.col("arg_index") == arg_index)
    df = t.latest(table).filter((F.col("project_id") == project_id) & (F.col("file_path") == file_path) & (F.col("line") == line) & at)
    return top(df.select("source_snippet", "value_type", "value"), asc("value_type", "value", "source_snippet"), 1)


TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        get_scan_metadata, list_projects, list_packages, get_project_snapshot, query_dependency_versions, query_prerelease_usage, query_tooling_distribution,
        query_component_usage, query_prop_usage, query_component_adoption_trend, query_export_usage, query_export_adoption_trend, get_source_context,
    )
}


class UnknownTool(LookupError):
    code = -32601


def call(t: Tables, name: str, args: dict | None = None) -> DataFrame:
    """The query ``name`` with ``args``; UnknownTool if there is none."""
    if name not in TOOLS:
        raise UnknownTool(f"no tool is called {name!r}")
    return TOOLS[name](t, **(args or {}))


def to_json(df: DataFrame) -> list[str]:
    """Result rows as JSON; meant for results that a limit bounds."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"].tolist()
