"""Data-loader and dashboard queries. All but trends and histories look at the latest scan of each project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.selection import asc, desc, distinct_count, effective_time, non_members, optional_filters, rows, top, union_distinct
from larkspur.operators.shares import adoption_by_project, category_counts, conditional_counts, nested_values, tool_matrix, usage_summary, version_spread
from larkspur.operators.trends import carry_forward
from larkspur.sources.tables import Tables

#: Dependency sections and the names of their counts (fixed values).
SECTIONS = {"prod_count": "dependencies", "dev_count": "devDependencies", "peer_count": "peerDependencies", "optional_count": "optionalDependencies"}


def overview_projects(t: Tables) -> DataFrame:
    return t.latest("project_snapshots").select("project_id", "scanned_at", "code_at", "framework", "build_tool", "package_manager").orderBy(*desc("scanned_at"), *asc("project_id"))


def tool_counts(t: Tables) -> DataFrame:
    """category, value, count of frameworks, build tools and package managers, in one pass."""
    return category_counts(t.latest("project_snapshots"), ("framework", "build_tool", "package_manager")).orderBy("category", F.desc("count"), "value")


def usage_totals(t: Tables) -> DataFrame:
    return t.latest("component_usages").agg(rows().alias("components")).join(t.latest("function_usages").agg(rows().alias("functions")), F.lit(True))


def top_packages(t: Tables) -> DataFrame:
    df = t.latest("dependencies")
    flags = df.groupBy("package_name").agg(
        distinct_count("project_id").alias("project_count"),
        *[distinct_count(F.when(F.col("dep_type") == v, F.col("project_id"))).alias(n) for n, v in SECTIONS.items()],
        F.bool_or("version_is_prerelease").alias("any_prerelease"), F.bool_or("is_internal").alias("any_internal"),
    )
    return top(flags, [*desc("project_count"), *asc("package_name")], 50)


def nested_top_packages(t: Tables) -> DataFrame:
    df = top_packages(t)
    return df.select("package_name", "project_count", F.struct(*[F.col(n).alias(v) for n, v in SECTIONS.items()]).alias("dep_type_breakdown"), "any_prerelease", "any_internal")


def latest_dependencies(t: Tables, search: str | None = None, prerelease_only: bool = False, internal_only: bool = False) -> DataFrame:
    df = t.latest("dependencies")
    if search and search.strip():
        df = df.filter(F.contains("package_name", F.lit(search.strip())))
    df = df.filter("version_is_prerelease") if prerelease_only else df
    df = df.filter("is_internal") if internal_only else df
    columns = ["project_id", "package_name", "version_range", "version_resolved", "version_major", "version_minor", "version_patch", "version_prerelease", "version_is_prerelease", "dep_type", "is_internal"]
    return df.select(*columns).orderBy(*asc("package_name", "project_id", "dep_type", "version_resolved"))


def prerelease_exposure(t: Tables) -> DataFrame:
    return t.latest("dependencies").filter("version_is_prerelease").select("project_id", "package_name", "version_resolved", "version_prerelease", "dep_type", "version_range").orderBy(*asc("package_name", "project_id", "version_resolved"))


def project_ids(t: Tables) -> DataFrame:
    return t.project_snapshots.select("project_id").distinct().orderBy("project_id")


def package_names(t: Tables) -> DataFrame:
    return union_distinct([t.latest(n) for n in ("dependencies", "component_usages", "function_usages")], "package_name").orderBy("package_name")


def major_versions(t: Tables, package: str) -> DataFrame:
    return _of(t, "dependencies", package).filter("version_major IS NOT NULL").select("version_major").distinct().orderBy("version_major")


def _of(t: Tables, table: str, package: str, major: int | None = None) -> DataFrame:
    column = "version_major" if table == "dependencies" else "package_version_major"
    return optional_filters(t.latest(table), {"package_name": package, column: major})


def declaring_projects(t: Tables, package: str, major: int | None = None) -> DataFrame:
    return _of(t, "dependencies", package, major).select("project_id").distinct().orderBy("project_id")


USE = ["project_id", "package_name", "package_version_resolved", "package_version_major", "package_version_minor"]


def package_components(t: Tables, package: str, major: int | None = None) -> DataFrame:
    return _of(t, "component_usages", package, major).select(*USE, "component_name").orderBy(*asc("component_name", "project_id", "package_version_resolved"))


def package_functions(t: Tables, package: str, major: int | None = None) -> DataFrame:
    return _of(t, "function_usages", package, major).select(*USE, "export_name").orderBy(*asc("export_name", "project_id", "package_version_resolved"))


def latest_projects(t: Tables) -> DataFrame:
    return t.latest("project_snapshots").select("project_id").distinct().orderBy("project_id")


def package_versions(t: Tables, package: str) -> DataFrame:
    """Spread by major and minor; a missing minor shows as x, and a missing major has no row."""
    return version_spread(_of(t, "dependencies", package).filter("version_major IS NOT NULL"), "version_major", "version_minor", "project_id", unknown_minor="x")


def dependency_versions(t: Tables, package: str) -> DataFrame:
    return version_spread(_of(t, "dependencies", package), "version_major", "version_minor", "project_id")


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("scan_date", F.date_trunc("day", effective_time()).cast("date"))


def presence_trend(t: Tables, package: str) -> DataFrame:
    """scan_date, project_count: projects whose last scan up to the day declares the package. Looks at all scans."""
    present = _by_day(t.dependencies.filter(F.col("package_name") == package))
    return carry_forward(_by_day(t.project_snapshots), present, "project_id", "scan_date")


def usage_trend(t: Tables, package: str, major: int | None = None) -> DataFrame:
    """scan_date, usage_count, type: use sites in the last scans up to each day, of components and of functions."""
    snapshots = _by_day(t.project_snapshots)

    def series(df: DataFrame, kind: str) -> DataFrame:
        asked = optional_filters(df, {"package_name": package, "package_version_major": major})
        counted = _by_day(asked).groupBy("project_id", "scan_date").agg(F.count("*").alias("n"))
        return carry_forward(snapshots, counted, "project_id", "scan_date", "n", "usage_count").withColumn("type", F.lit(kind))

    return series(t.component_usages, "components").unionByName(series(t.function_usages, "functions")).orderBy("scan_date", "type")


def project_scans(t: Tables, project: str) -> DataFrame:
    columns = ["project_id", "scanned_at", "code_at", "is_latest", "framework", "framework_version", "package_manager", "build_tool", "test_framework", "linter", "formatter", "css_approach", "typescript", "typescript_version", "node_version", "branch", "commit_sha"]
    return t.project_snapshots.filter(F.col("project_id") == project).select(*columns).orderBy(*desc("scanned_at", "commit_sha"))


def current_scan(t: Tables, project: str) -> DataFrame:
    """The latest scan, or without a flagged one the newest."""
    return top(project_scans(t, project), desc("is_latest", "scanned_at", "commit_sha"), 1)


def project_packages(t: Tables, project: str) -> DataFrame:
    df = t.latest("dependencies").filter(F.col("project_id") == project)
    return df.select("package_name", "version_resolved", "version_range", "dep_type", "version_is_prerelease", "is_internal").orderBy(*asc("dep_type", "package_name", "version_resolved"))


def project_components(t: Tables, project: str) -> DataFrame:
    return _versioned(t.latest("component_usages"), project, "component_name", "usage_count")


def project_functions(t: Tables, project: str) -> DataFrame:
    return _versioned(t.latest("function_usages"), project, "export_name", "call_count")


def _versioned(df: DataFrame, project: str, name: str, out: str) -> DataFrame:
    by = ["package_name", name, "package_version_resolved", "package_version_major", "package_version_minor"]
    return df.filter(F.col("project_id") == project).groupBy(*by).agg(rows().alias(out)).orderBy(*asc("package_name"), *desc(out), *asc(name, "package_version_resolved"))


def scan_history(t: Tables, project: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """scanned_at, component_count, function_count by effective time, from all scans; the span may be limited."""

    def counts(df: DataFrame, c: F.Column, f: F.Column) -> DataFrame:
        own = df.filter(F.col("project_id") == project).groupBy(effective_time().alias("scanned_at")).agg(F.count("*").alias("n"))
        return own.select("scanned_at", c.alias("cu"), f.alias("fu"))

    both = counts(t.component_usages, F.col("n"), F.lit(0)).unionByName(counts(t.function_usages, F.lit(0), F.col("n")))
    df = both.groupBy("scanned_at").agg(F.sum("cu").cast("int").alias("component_count"), F.sum("fu").cast("int").alias("function_count"))
    if start or end:
        df = df.filter(F.col("scanned_at").between(F.lit(start or "0001-01-01").cast("timestamp"), F.lit(end or "9999-12-31").cast("timestamp")))
    return df.orderBy("scanned_at")


def long_history(history: DataFrame) -> DataFrame:
    """A row for each time and kind of use."""
    return history.unpivot(["scanned_at"], ["component_count", "function_count"], "type", "n")


def names(t: Tables, table: str, column: str, wanted: dict | None = None) -> DataFrame:
    """The different values of a column among latest rows: packages, components, exports, projects, props, argument indexes."""
    return optional_filters(t.latest(table), wanted or {}).select(column).distinct().orderBy(*asc(column))


def uses_by_project(t: Tables, table: str, wanted: dict, out: str) -> DataFrame:
    df = optional_filters(t.latest(table), wanted)
    return df.groupBy("project_id").agg(rows().alias(out)).orderBy(*desc(out), *asc("project_id"))


def prop_frequency(t: Tables, package: str, component: str, **more: object) -> DataFrame:
    df = optional_filters(t.latest("component_prop_usages"), {"package_name": package, "component_name": component, **more})
    return top(df.groupBy("prop_name").agg(rows().alias("usage_count")), [*desc("usage_count"), *asc("prop_name")], 40)


def snippet_rows(t: Tables, table: str, wanted: dict) -> DataFrame:
    slot = "prop_name" if table == "component_prop_usages" else "arg_index"
    df = optional_filters(t.latest(table), wanted).filter("source_snippet IS NOT NULL")
    return top(df.select("project_id", "file_path", "line", slot, "value_type", "value", "source_snippet"), asc("project_id", "file_path", "line", slot, "source_snippet", "value_type", "value"), 200)


def file_rows(t: Tables, table: str, wanted: dict) -> DataFrame:
    slot = ["prop_name"] if table == "component_prop_usages" else ["arg_index", "arg_name"]
    df = optional_filters(t.latest(table), wanted)
    return top(df.select("file_path", "line", *slot, "value_type", "value"), asc("file_path", "line", *slot, "value_type", "value"), 500)


def usage_rows(t: Tables, table: str, wanted: dict) -> DataFrame:
    slot = ["prop_name"] if table == "component_prop_usages" else ["arg_index", "arg_name"]
    df = optional_filters(t.latest(table), wanted)
    return top(df.select("project_id", "file_path", "line", *slot, "value_type", "value"), asc("project_id", "file_path", "line", *slot, "value_type", "value"), 500)


def most_called(t: Tables, package: str | None = None) -> DataFrame:
    df = optional_filters(t.latest("function_usages"), {"package_name": package})
    return top(df.groupBy("export_name", "package_name").agg(rows().alias("total_calls")), [*desc("total_calls"), *asc("package_name", "export_name")], 40)


def arg_pattern(t: Tables, package: str, export: str, **more: object) -> DataFrame:
    df = optional_filters(t.latest("function_arg_usages"), {"package_name": package, "export_name": export, **more})
    return df.groupBy("arg_index", "value_type").agg(rows().alias("n")).orderBy(*asc("arg_index"), *desc("n"), *asc("value_type"))


def popularity(t: Tables, table: str, package: str) -> DataFrame:
    column = {"component_usages": "component_name", "function_usages": "export_name"}[table]
    return _of(t, table, package).groupBy(column).agg(rows().alias("n")).orderBy(*desc("n"), *asc(column))


def adopters(t: Tables, package: str) -> DataFrame:
    return union_distinct([_of(t, n, package) for n in ("dependencies", "component_usages", "function_usages")], "project_id")


def non_adopters(t: Tables, package: str) -> DataFrame:
    return non_members(t.latest("project_snapshots"), adopters(t, package), "project_id").orderBy("project_id")


def package_adoption(t: Tables, package: str) -> DataFrame:
    used = [_of(t, n, package) for n in ("component_usages", "function_usages")]
    return adoption_by_project(declaring_projects(t, package), used).orderBy(*desc("usage_count"), *asc("project_id"))


def package_reach(t: Tables, k: int = 30) -> DataFrame:
    df = t.latest("dependencies").groupBy("package_name").agg(distinct_count("project_id").alias("project_count"))
    return top(df, [*desc("project_count"), *asc("package_name")], k)


def section_counts(t: Tables, package: str) -> DataFrame:
    return _of(t, "dependencies", package).groupBy("dep_type").agg(rows().alias("n")).orderBy(*desc("n"), *asc("dep_type"))


def section_totals(t: Tables) -> DataFrame:
    df = t.latest("dependencies")
    return df.groupBy("project_id").agg(F.count_if(F.col("dep_type") == "dependencies").cast("int").alias("production"), F.count_if(F.col("dep_type") == "devDependencies").cast("int").alias("dev"), rows().alias("total"))


def cards(t: Tables) -> DataFrame:
    df = t.latest("dependencies")
    return df.agg(distinct_count("package_name").alias("packages"), rows().alias("entries"), F.count_if(F.coalesce("version_is_prerelease", F.lit(False))).cast("int").alias("prereleases"), distinct_count("project_id").alias("projects"))


def matrix(t: Tables, column: str, tools: list[str]) -> DataFrame:
    return tool_matrix(t.latest("project_snapshots").filter(F.col(column).isNotNull()), column, "project_id", tools)


def first_versions(t: Tables) -> DataFrame:
    """The first known version of each package, by project and version."""
    known = t.latest("dependencies").filter("version_resolved IS NOT NULL")
    return known.groupBy("package_name").agg(F.min_by("version_resolved", F.struct("project_id", "version_resolved")).alias("version_resolved"))


def document_totals(scans: DataFrame) -> DataFrame:
    """Sums of the counters in scan documents: files, files with errors, component uses and calls."""
    names = {"files": "totalFilesScanned", "files_with_errors": "filesWithErrors", "components": "totalComponentUsages", "calls": "totalFunctionCalls"}
    return scans.agg(*[F.coalesce(F.sum(f"summary.{f}"), F.lit(0)).cast("bigint").alias(n) for n, f in names.items()])


def packages_summary(t: Tables) -> DataFrame:
    return usage_summary(t.latest("component_usages"), t.latest("function_usages"))


def component_values(t: Tables, package: str) -> DataFrame:
    return nested_values(_of(t, "component_prop_usages", package), "component_name", "prop_name")


def breakdown(t: Tables) -> DataFrame:
    return conditional_counts(t.latest("dependencies"), "package_name", "project_id", "dep_type", SECTIONS)
