"""Terminal-view queries: one project, one component or export, many projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.selection import asc, desc, distinct_count, members, optional_filters, rows, top
from larkspur.operators.shares import category_counts, snippet_previews, value_distribution
from larkspur.plans import tools
from larkspur.sources.tables import Tables

OVERVIEW = ("framework", "build_tool", "test_framework", "package_manager", "css_approach")


def load_projects(t: Tables, project: str | None = None, framework: str | None = None, build_tool: str | None = None, stale_days: int = 7, as_of: str | None = None) -> DataFrame:
    return tools.list_projects(t, framework, build_tool, stale_days, as_of, project, limit=200)


snapshot_row = tools.project_snapshot_row
dependencies = tools.project_dependencies


def component_counts(t: Tables, project: str, package: str | None = None) -> DataFrame:
    return _counts(t.latest("component_usages"), "component_name", "usage_count", project, package)


def export_counts(t: Tables, project: str, package: str | None = None) -> DataFrame:
    return _counts(t.latest("function_usages"), "export_name", "call_count", project, package)


def _counts(df: DataFrame, name: str, out: str, project: str, package: str | None) -> DataFrame:
    df = optional_filters(df, {"project_id": project, "package_name": package})
    counted = df.groupBy("project_id", "package_name", name).agg(rows().alias(out))
    return top(counted, [*desc(out), *asc("package_name", name)], 200)


def prop_usages(t: Tables, package: str, component: str, project: str | None = None) -> DataFrame:
    df = optional_filters(t.latest("component_prop_usages"), {"package_name": package, "component_name": component, "project_id": project})
    return top(df.select(*tools.PROP_COLUMNS), asc("prop_name", "project_id", "line", "file_path", "value_type", "value", "source_snippet"), 2000)


def arg_usages(t: Tables, package: str, export: str, project: str | None = None) -> DataFrame:
    df = optional_filters(t.latest("function_arg_usages"), {"package_name": package, "export_name": export, "project_id": project})
    df = df.select("project_id", "file_path", "line", "arg_index", "value_type", "value", "source_snippet")
    return top(df, asc("arg_index", "project_id", "line", "file_path", "value_type", "value", "source_snippet"), 2000)


def site_counts(t: Tables, table: str, package: str, name: str, project: str | None = None) -> DataFrame:
    """Sites of a component (``component_usages``) or export (``function_usages``) by project."""
    column = {"component_usages": "component_name", "function_usages": "export_name"}[table]
    df = optional_filters(t.latest(table), {"package_name": package, column: name, "project_id": project})
    return df.groupBy("project_id").agg(rows().alias("site_count")).orderBy(*desc("site_count"), *asc("project_id"))


def totals(t: Tables, table: str, projects: DataFrame, package: str | None = None) -> DataFrame:
    """Names used in the given projects: how many projects, how many sites."""
    column, out = {"component_usages": ("component_name", "usage_count"), "function_usages": ("export_name", "call_count")}[table]
    df = members(optional_filters(t.latest(table), {"package_name": package}), projects, "project_id")
    counted = df.groupBy("package_name", column).agg(distinct_count("project_id").alias("project_count"), rows().alias(out))
    return top(counted, [*desc("project_count", out), *asc("package_name", column)], 50)


def prop_breakdown(t: Tables, package: str, component: str) -> DataFrame:
    df = optional_filters(t.latest("component_prop_usages"), {"package_name": package, "component_name": component})
    return value_distribution(df, ["prop_name"]).orderBy("prop_name", F.desc("n"), "value")


def arg_breakdown(t: Tables, package: str, export: str) -> DataFrame:
    df = optional_filters(t.latest("function_arg_usages"), {"package_name": package, "export_name": export})
    return value_distribution(df, ["arg_index"]).orderBy("arg_index", F.desc("n"), "value")


def prop_previews(t: Tables, package: str, component: str) -> DataFrame:
    df = optional_filters(t.latest("component_prop_usages"), {"package_name": package, "component_name": component})
    return snippet_previews(df, ["prop_name"], "component_name", asc("project_id", "file_path", "line", "source_snippet"))


def tooling_overview(t: Tables) -> DataFrame:
    return category_counts(t.latest("project_snapshots"), OVERVIEW).orderBy(F.desc("count"), "category", "value")
