"""All queries that run on the driver's tables, with SQL of the same results.

Named queries run on the six tables that ``sources.standin`` makes of the order tables; the rest run on the driver's
tables as they are. Lists are shown as sorted strings, so that both engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from larkspur.functions import text as fn
from larkspur.operators import selection as sel
from larkspur.operators import shares, trends
from larkspur.plans import dashboard, tools, views
from larkspur.plans.build import calls_with_args, flatten
from larkspur.sources.standin import AS_OF, CTE, standin_tables
from larkspur.sources.standin_scans import SCANS_CTE, standin_scans

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Arrays as strings: values in order, 'null' for null, joined by commas."""
    shown = [F.array_join(F.sort_array(F.transform(f.name, lambda x: F.coalesce(x.cast("string"), F.lit("null")))), ",").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema]
    return df.select(*shown)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_tables(name: str, of: Callable, sql: str) -> None:
    _queries[name] = lambda spark, sf_dir: flat(of(standin_tables(spark, sf_dir)))
    _sql[name] = f"WITH {CTE}\n{sql.strip()}"


def _on_driver(name: str, of: Query, sql: str | None) -> None:
    _queries[name] = of
    if sql:
        _sql[name] = sql.strip()


def _listed(column: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT coalesce({column}::VARCHAR, 'null'))), ',')"


#: Arguments of the named queries.
PKG, PART, OTHER, PROJECT = "@parts/economy", "small_ring", "red_widget", "p7"
STABLE = "coalesce(package_version_is_prerelease, false) = false"
DAY = "coalesce(code_at, scanned_at)::TIMESTAMP::DATE"
SITE = f"is_latest AND package_name = '{PKG}' AND component_name = '{PART}'"
CALL = f"is_latest AND package_name = '{PKG}' AND export_name = '{PART}'"


def _trend_sql(table_name: str, where: str, months: int) -> str:
    return f"""
SELECT m.period::VARCHAR AS period, count(DISTINCT s.project_id)::INTEGER AS adopting_projects
FROM (SELECT (date_trunc('month', DATE '{AS_OF}') - to_months(g::INTEGER))::DATE AS period FROM range(0, {months}) AS r(g)) m
JOIN (SELECT DISTINCT project_id, date_trunc('month', {DAY})::DATE AS scan_month FROM {table_name} WHERE {STABLE} AND {where}) s ON s.scan_month <= m.period
GROUP BY 1"""


_LAST = f"""days AS (SELECT DISTINCT project_id, {DAY} AS d FROM project_snapshots),
spans AS (SELECT project_id, d, lead(d) OVER (PARTITION BY project_id ORDER BY d) AS until FROM days),
timeline AS (SELECT DISTINCT d AS scan_date FROM days)"""

# Tool queries
_on_tables("tool_scan_metadata", lambda t: tools.get_scan_metadata(t, AS_OF), f"""
SELECT count(DISTINCT project_id)::INTEGER AS project_count, min(scanned_at) AS oldest_scan, max(scanned_at) AS newest_scan, min(code_at) AS oldest_code_at, max(code_at) AS newest_code_at,
  {_listed("schema_version")} AS schema_versions,
  count(DISTINCT CASE WHEN scanned_at::TIMESTAMP < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN project_id END)::INTEGER AS stale_project_count
FROM project_snapshots""")
_LIST = f"""SELECT project_id, repo_url, scanned_at, framework, build_tool, test_framework, typescript, package_manager, scanned_at::TIMESTAMP < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS is_stale
FROM project_snapshots WHERE is_latest"""
_on_tables("tool_list_projects", lambda t: tools.list_projects(t, framework="machinery", build_tool="high", stale_after_days=30, as_of=AS_OF), f"{_LIST} AND framework = 'machinery' AND build_tool = 'high' ORDER BY project_id LIMIT 100")
_on_tables("tool_list_packages", lambda t: tools.list_packages(t, scope="@parts", dep_type="dependencies", internal_only=True), f"""
SELECT package_name, count(DISTINCT project_id)::INTEGER AS project_count, {_listed("version_resolved")} AS versions_seen
FROM dependencies WHERE is_latest AND starts_with(package_name, '@parts/') AND dep_type = 'dependencies' AND is_internal GROUP BY package_name ORDER BY project_count DESC, package_name LIMIT 100""")
_on_tables("tool_project_snapshot", lambda t: tools.get_project_snapshot(t, PROJECT).select("snapshot.*", F.size("dependencies").alias("n_dependencies"), F.transform("dependencies", lambda d: d["package_name"]).alias("dependency_names")), f"""
SELECT s.*, d.n_dependencies, d.dependency_names FROM (SELECT * FROM project_snapshots WHERE project_id = '{PROJECT}' AND is_latest) s,
  (SELECT count(*)::INTEGER AS n_dependencies, coalesce(string_agg(package_name, ',' ORDER BY package_name), '') AS dependency_names FROM dependencies WHERE project_id = '{PROJECT}' AND is_latest) d""")
_on_tables("tool_dependency_versions", lambda t: tools.query_dependency_versions(t, PKG), f"""
SELECT version_resolved, version_major, version_minor, version_patch, version_prerelease, count(DISTINCT project_id)::INTEGER AS project_count, {_listed("project_id")} AS projects
FROM dependencies WHERE is_latest AND package_name = '{PKG}' AND version_is_prerelease = false GROUP BY ALL
ORDER BY version_major DESC NULLS LAST, version_minor DESC NULLS LAST, version_patch DESC NULLS LAST, version_resolved, version_prerelease LIMIT 100""")
_on_tables("tool_prerelease_usage", lambda t: tools.query_prerelease_usage(t, PKG, "beta.3"), f"""
SELECT version_resolved, version_prerelease, count(DISTINCT project_id)::INTEGER AS project_count, {_listed("project_id")} AS projects
FROM dependencies WHERE is_latest AND package_name = '{PKG}' AND version_is_prerelease AND version_prerelease LIKE '%beta.3%' GROUP BY ALL ORDER BY project_count DESC, version_resolved LIMIT 100""")
for _category in ("framework", "build_tool", "bundler", "test_framework", "linter", "formatter", "css_approach", "package_manager", "typescript"):
    _on_tables(f"tool_tooling_{_category}", lambda t, c=_category: tools.query_tooling_distribution(t, c), f"""
SELECT {_category}::VARCHAR AS value, count(DISTINCT project_id)::INTEGER AS project_count, {_listed("project_id")} AS projects
FROM project_snapshots WHERE is_latest AND {_category} IS NOT NULL GROUP BY {_category} ORDER BY project_count DESC, value LIMIT 100""")
_on_tables("tool_component_usage", lambda t: tools.query_component_usage(t, PKG, PART), f"""
SELECT project_id, file_path, line, package_version_resolved FROM component_usages WHERE {SITE} AND {STABLE}
ORDER BY project_id, file_path, line, package_version_resolved LIMIT 100""")
_on_tables("tool_component_usage_major", lambda t: tools.query_component_usage(t, PKG, PART, package_version=11, include_prerelease=True), f"""
SELECT project_id, file_path, line, package_version_resolved FROM component_usages WHERE {SITE} AND package_version_major = 11
ORDER BY project_id, file_path, line, package_version_resolved LIMIT 100""")
_on_tables("tool_prop_usage", lambda t: tools.query_prop_usage(t, PKG, PART), f"""
SELECT project_id, file_path, line, prop_name, value_type, value, source_snippet, package_version_resolved FROM component_prop_usages WHERE {SITE} AND {STABLE}
ORDER BY prop_name, project_id, file_path, line, value_type, value, package_version_resolved LIMIT 200""")
_on_tables("tool_component_trend", lambda t: tools.query_component_adoption_trend(t, PKG, PART, 24, AS_OF), _trend_sql("component_usages", f"package_name = '{PKG}' AND component_name = '{PART}'", 24))
_on_tables("tool_export_trend", lambda t: tools.query_export_adoption_trend(t, PKG, OTHER, 60, AS_OF), _trend_sql("function_usages", f"package_name = '{PKG}' AND export_name = '{OTHER}'", 60))
_on_tables("tool_export_usage", lambda t: tools.query_export_usage(t, PKG, PART), f"""
SELECT f.project_id, f.file_path, f.line, a.arg_index, a.value_type, a.value, a.source_snippet, f.package_version_resolved
FROM function_usages f LEFT JOIN function_arg_usages a ON f.project_id = a.project_id AND f.scanned_at = a.scanned_at AND f.file_path = a.file_path AND f.line = a.line AND f.export_name = a.export_name
WHERE f.is_latest AND f.package_name = '{PKG}' AND f.export_name = '{PART}' AND coalesce(f.package_version_is_prerelease, false) = false
ORDER BY f.project_id, f.file_path, f.line, a.arg_index, a.value_type, a.value, f.package_version_resolved, a.source_snippet LIMIT 100""")
_on_tables("tool_source_context", lambda t: tools.get_source_context(t, PROJECT, "src/f3.tsx", 2, arg_index=0), f"""
SELECT source_snippet, value_type, value FROM function_arg_usages WHERE is_latest AND project_id = '{PROJECT}' AND file_path = 'src/f3.tsx' AND line = 2 AND arg_index = 0 ORDER BY value_type, value, source_snippet LIMIT 1""")

# View queries
_on_tables("view_projects", lambda t: views.load_projects(t, framework="building", stale_days=30, as_of=AS_OF), f"{_LIST} AND framework = 'building' ORDER BY project_id LIMIT 200")
_on_tables("view_snapshot", lambda t: views.snapshot_row(t, PROJECT), f"SELECT * FROM project_snapshots WHERE project_id = '{PROJECT}' AND is_latest")
_on_tables("view_dependencies", lambda t: views.dependencies(t, PROJECT), f"""
SELECT package_name, version_range, version_resolved, dep_type, is_internal FROM dependencies WHERE project_id = '{PROJECT}' AND is_latest LIMIT 500""")
for _name, _table, _column, _out, _f in (("components", "component_usages", "component_name", "usage_count", views.component_counts), ("exports", "function_usages", "export_name", "call_count", views.export_counts)):
    _on_tables(f"view_{_name}", lambda t, f=_f: f(t, PROJECT), f"""
SELECT project_id, package_name, {_column}, count(*)::INTEGER AS {_out} FROM {_table} WHERE project_id = '{PROJECT}' AND is_latest GROUP BY ALL ORDER BY {_out} DESC, package_name, {_column} LIMIT 200""")
    _on_tables(f"view_{_name}_sites", lambda t, n=_table: views.site_counts(t, n, PKG, PART), f"""
SELECT project_id, count(*)::INTEGER AS site_count FROM {_table} WHERE is_latest AND package_name = '{PKG}' AND {_column} = '{PART}' GROUP BY project_id""")
    _on_tables(f"view_{_name}_totals", lambda t, n=_table: views.totals(t, n, views.load_projects(t, framework="building", as_of=AS_OF)), f"""
SELECT package_name, {_column}, count(DISTINCT project_id)::INTEGER AS project_count, count(*)::INTEGER AS {_out} FROM {_table}
WHERE is_latest AND project_id IN (SELECT project_id FROM project_snapshots WHERE is_latest AND framework = 'building' ORDER BY project_id LIMIT 200)
GROUP BY package_name, {_column} ORDER BY project_count DESC, {_out} DESC, package_name, {_column} LIMIT 50""")
_on_tables("view_prop_usages", lambda t: views.prop_usages(t, PKG, PART), f"SELECT project_id, file_path, line, prop_name, value_type, value, source_snippet FROM component_prop_usages WHERE {SITE} ORDER BY prop_name, project_id, line, file_path, value_type, value, source_snippet LIMIT 2000")
_on_tables("view_arg_usages", lambda t: views.arg_usages(t, PKG, PART), f"SELECT project_id, file_path, line, arg_index, value_type, value, source_snippet FROM function_arg_usages WHERE {CALL} ORDER BY arg_index, project_id, line, file_path, value_type, value, source_snippet LIMIT 2000")
_SHOWN = "CASE WHEN value_type = 'dynamic' THEN '[dynamic]' ELSE coalesce(value, 'null') END"
_on_tables("view_prop_breakdown", lambda t: views.prop_breakdown(t, PKG, PART), f"SELECT prop_name, {_SHOWN} AS value, count(*)::INTEGER AS n FROM component_prop_usages WHERE {SITE} GROUP BY ALL")
_on_tables("view_arg_breakdown", lambda t: views.arg_breakdown(t, PKG, PART), f"SELECT arg_index, {_SHOWN} AS value, count(*)::INTEGER AS n FROM function_arg_usages WHERE {CALL} GROUP BY ALL")
_on_tables("view_prop_previews", lambda t: views.prop_previews(t, PKG, PART), f"""
SELECT prop_name, 'use(' || component_name || ')' AS preview FROM component_prop_usages WHERE {SITE} AND source_snippet IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY prop_name ORDER BY project_id, file_path, line, source_snippet) <= 3""")
_on_tables("view_tooling_overview", views.tooling_overview, "\nUNION ALL\n".join(f"SELECT '{c}' AS category, {c} AS value, count(*)::INTEGER AS count FROM project_snapshots WHERE is_latest AND {c} IS NOT NULL GROUP BY {c}" for c in views.OVERVIEW))

# Data loaders and dashboard
_on_tables("load_overview_projects", dashboard.overview_projects, "SELECT project_id, scanned_at, code_at, framework, build_tool, package_manager FROM project_snapshots WHERE is_latest")
_on_tables("load_tool_counts", dashboard.tool_counts, "\nUNION ALL\n".join(f"SELECT '{c}' AS category, {c} AS value, count(*)::INTEGER AS count FROM project_snapshots WHERE is_latest AND {c} IS NOT NULL GROUP BY {c}" for c in ("framework", "build_tool", "package_manager")))
_on_tables("load_usage_totals", dashboard.usage_totals, "SELECT (SELECT count(*)::INTEGER FROM component_usages WHERE is_latest) AS components, (SELECT count(*)::INTEGER FROM function_usages WHERE is_latest) AS functions")
_SECTIONS = ", ".join(f"count(DISTINCT CASE WHEN dep_type = '{v}' THEN project_id END)::INTEGER AS {n}" for n, v in dashboard.SECTIONS.items())
_on_tables("load_top_packages", dashboard.top_packages, f"""
SELECT package_name, count(DISTINCT project_id)::INTEGER AS project_count, {_SECTIONS}, bool_or(version_is_prerelease) AS any_prerelease, bool_or(is_internal) AS any_internal
FROM dependencies WHERE is_latest GROUP BY package_name ORDER BY project_count DESC, package_name LIMIT 50""")
_on_tables("load_latest_dependencies", dashboard.latest_dependencies, """
SELECT project_id, package_name, version_range, version_resolved, version_major, version_minor, version_patch, version_prerelease, version_is_prerelease, dep_type, is_internal FROM dependencies WHERE is_latest""")
_on_tables("load_dependencies_filtered", lambda t: dashboard.latest_dependencies(t, " econ ", True, True), """
SELECT project_id, package_name, version_range, version_resolved, version_major, version_minor, version_patch, version_prerelease, version_is_prerelease, dep_type, is_internal
FROM dependencies WHERE is_latest AND contains(package_name, 'econ') AND version_is_prerelease AND is_internal""")
_on_tables("load_prerelease_exposure", dashboard.prerelease_exposure, "SELECT project_id, package_name, version_resolved, version_prerelease, dep_type, version_range FROM dependencies WHERE is_latest AND version_is_prerelease")
_on_tables("load_project_ids", dashboard.project_ids, "SELECT DISTINCT project_id FROM project_snapshots")
_on_tables("page_packages", dashboard.package_names, "SELECT package_name FROM dependencies WHERE is_latest UNION SELECT package_name FROM component_usages WHERE is_latest UNION SELECT package_name FROM function_usages WHERE is_latest")
_on_tables("page_major_versions", lambda t: dashboard.major_versions(t, PKG), f"SELECT DISTINCT version_major FROM dependencies WHERE is_latest AND package_name = '{PKG}' AND version_major IS NOT NULL")
_on_tables("page_declaring_projects", lambda t: dashboard.declaring_projects(t, PKG, 11), f"SELECT DISTINCT project_id FROM dependencies WHERE is_latest AND package_name = '{PKG}' AND version_major = 11")
_on_tables("page_package_components", lambda t: dashboard.package_components(t, PKG), f"SELECT project_id, package_name, package_version_resolved, package_version_major, package_version_minor, component_name FROM component_usages WHERE is_latest AND package_name = '{PKG}'")
_on_tables("page_package_functions", lambda t: dashboard.package_functions(t, PKG, 11), f"SELECT project_id, package_name, package_version_resolved, package_version_major, package_version_minor, export_name FROM function_usages WHERE is_latest AND package_name = '{PKG}' AND package_version_major = 11")
_on_tables("page_latest_projects", dashboard.latest_projects, "SELECT DISTINCT project_id FROM project_snapshots WHERE is_latest")
_on_tables("page_package_versions", lambda t: dashboard.package_versions(t, PKG), f"""
SELECT version_major || '.' || coalesce(version_minor::VARCHAR, 'x') AS label, version_major AS major, version_minor AS minor, count(DISTINCT project_id)::INTEGER AS project_count
FROM dependencies WHERE is_latest AND package_name = '{PKG}' AND version_major IS NOT NULL GROUP BY version_major, version_minor""")
_on_tables("page_dependency_versions", lambda t: dashboard.dependency_versions(t, PKG), f"""
SELECT CASE WHEN version_major IS NULL THEN 'unknown' ELSE concat_ws('.', version_major, version_minor) END AS label, version_major AS major, version_minor AS minor, count(DISTINCT project_id)::INTEGER AS project_count
FROM dependencies WHERE is_latest AND package_name = '{PKG}' GROUP BY version_major, version_minor""")
_on_tables("page_presence_trend", lambda t: dashboard.presence_trend(t, PKG), f""", {_LAST},
present AS (SELECT DISTINCT project_id, {DAY} AS d FROM dependencies WHERE package_name = '{PKG}')
SELECT scan_date, count(DISTINCT s.project_id)::INTEGER AS project_count FROM timeline JOIN spans s ON s.d <= scan_date AND (until IS NULL OR scan_date < until)
JOIN present p ON p.project_id = s.project_id AND p.d = s.d GROUP BY scan_date""")
_on_tables("page_usage_trend", lambda t: dashboard.usage_trend(t, PKG), f""", {_LAST},
counts AS (
  SELECT 'components' AS type, project_id, {DAY} AS d, count(*) AS n FROM component_usages WHERE package_name = '{PKG}' GROUP BY ALL
  UNION ALL SELECT 'functions', project_id, {DAY}, count(*) FROM function_usages WHERE package_name = '{PKG}' GROUP BY ALL)
SELECT scan_date, sum(c.n)::INTEGER AS usage_count, c.type FROM timeline JOIN spans s ON s.d <= scan_date AND (until IS NULL OR scan_date < until)
JOIN counts c ON c.project_id = s.project_id AND c.d = s.d GROUP BY scan_date, c.type""")
_on_tables("page_project_scans", lambda t: dashboard.project_scans(t, PROJECT), f"""
SELECT project_id, scanned_at, code_at, is_latest, framework, framework_version, package_manager, build_tool, test_framework, linter, formatter, css_approach, typescript, typescript_version, node_version, branch, commit_sha
FROM project_snapshots WHERE project_id = '{PROJECT}'""")
_on_tables("page_current_scan", lambda t: dashboard.current_scan(t, PROJECT).select("project_id", "commit_sha"), f"SELECT project_id, commit_sha FROM project_snapshots WHERE project_id = '{PROJECT}' ORDER BY is_latest DESC, scanned_at DESC, commit_sha DESC LIMIT 1")
_on_tables("page_project_packages", lambda t: dashboard.project_packages(t, PROJECT), f"SELECT package_name, version_resolved, version_range, dep_type, version_is_prerelease, is_internal FROM dependencies WHERE project_id = '{PROJECT}' AND is_latest")
for _name, _table, _column, _out, _f in (("components", "component_usages", "component_name", "usage_count", dashboard.project_components), ("functions", "function_usages", "export_name", "call_count", dashboard.project_functions)):
    _on_tables(f"page_project_{_name}", lambda t, f=_f: f(t, PROJECT), f"""
SELECT package_name, {_column}, package_version_resolved, package_version_major, package_version_minor, count(*)::INTEGER AS {_out} FROM {_table} WHERE project_id = '{PROJECT}' AND is_latest GROUP BY ALL""")
    _on_tables(f"page_{_name}_popularity", lambda t, n=_table: dashboard.popularity(t, n, PKG), f"SELECT {_column}, count(*)::INTEGER AS n FROM {_table} WHERE is_latest AND package_name = '{PKG}' GROUP BY {_column}")
    _on_tables(f"page_{_name}_packages", lambda t, n=_table: dashboard.names(t, n, "package_name"), f"SELECT DISTINCT package_name FROM {_table} WHERE is_latest")
    _on_tables(f"page_{_name}_names", lambda t, n=_table, c=_column: dashboard.names(t, n, c, {"package_name": PKG}), f"SELECT DISTINCT {_column} FROM {_table} WHERE is_latest AND package_name = '{PKG}'")
    _on_tables(f"page_{_name}_projects", lambda t, n=_table, c=_column: dashboard.names(t, n, "project_id", {"package_name": PKG, c: PART}), f"SELECT DISTINCT project_id FROM {_table} WHERE is_latest AND package_name = '{PKG}' AND {_column} = '{PART}'")
    _on_tables(f"page_{_name}_by_project", lambda t, n=_table, c=_column, o=_out: dashboard.uses_by_project(t, n, {"package_name": PKG, c: PART}, o), f"SELECT project_id, count(*)::INTEGER AS {_out} FROM {_table} WHERE is_latest AND package_name = '{PKG}' AND {_column} = '{PART}' GROUP BY project_id")
_HIST = f"SELECT coalesce(code_at, scanned_at)::TIMESTAMP AS scanned_at, {{}} FROM {{}} WHERE project_id = '{PROJECT}'"
_on_tables("page_scan_history", lambda t: dashboard.scan_history(t, PROJECT).withColumn("scanned_at", F.date_format("scanned_at", "yyyy-MM-dd")), f"""
SELECT strftime(scanned_at, '%Y-%m-%d') AS scanned_at, sum(cu)::INTEGER AS component_count, sum(fu)::INTEGER AS function_count
FROM ({_HIST.format("1 AS cu, 0 AS fu", "component_usages")} UNION ALL {_HIST.format("0, 1", "function_usages")}) GROUP BY scanned_at""")
_on_tables("page_scan_history_long", lambda t: dashboard.long_history(dashboard.scan_history(t, PROJECT, "1996-01-01", "1999-12-31")).withColumn("scanned_at", F.date_format("scanned_at", "yyyy-MM-dd")), f"""
, h AS (SELECT scanned_at, sum(cu)::INTEGER AS cc, sum(fu)::INTEGER AS fc FROM ({_HIST.format("1 AS cu, 0 AS fu", "component_usages")} UNION ALL {_HIST.format("0, 1", "function_usages")}) GROUP BY scanned_at)
SELECT strftime(scanned_at, '%Y-%m-%d') AS scanned_at, 'component_count' AS type, cc AS n FROM h WHERE scanned_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'
UNION ALL SELECT strftime(scanned_at, '%Y-%m-%d'), 'function_count', fc FROM h WHERE scanned_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""")
_on_tables("page_prop_names", lambda t: dashboard.names(t, "component_prop_usages", "prop_name", {"package_name": PKG, "component_name": PART}), f"SELECT DISTINCT prop_name FROM component_prop_usages WHERE {SITE}")
_on_tables("page_prop_frequency", lambda t: dashboard.prop_frequency(t, PKG, PART), f"SELECT prop_name, count(*)::INTEGER AS usage_count FROM component_prop_usages WHERE {SITE} GROUP BY prop_name ORDER BY usage_count DESC, prop_name LIMIT 40")
_PROPS, _ARGS = {"package_name": PKG, "component_name": PART}, {"package_name": PKG, "export_name": PART}
_on_tables("page_prop_snippets", lambda t: dashboard.snippet_rows(t, "component_prop_usages", _PROPS | {"prop_name": "p0"}), f"""
SELECT project_id, file_path, line, prop_name, value_type, value, source_snippet FROM component_prop_usages WHERE {SITE} AND prop_name = 'p0' AND source_snippet IS NOT NULL
ORDER BY project_id, file_path, line, prop_name, source_snippet, value_type, value LIMIT 200""")
_on_tables("page_prop_files", lambda t: dashboard.file_rows(t, "component_prop_usages", {"package_name": PKG, "project_id": PROJECT}), f"""
SELECT file_path, line, prop_name, value_type, value FROM component_prop_usages WHERE is_latest AND package_name = '{PKG}' AND project_id = '{PROJECT}' ORDER BY file_path, line, prop_name, value_type, value LIMIT 500""")
_on_tables("page_prop_rows", lambda t: dashboard.usage_rows(t, "component_prop_usages", _PROPS), f"""
SELECT project_id, file_path, line, prop_name, value_type, value FROM component_prop_usages WHERE {SITE} ORDER BY project_id, file_path, line, prop_name, value_type, value LIMIT 500""")
_on_tables("page_arg_indexes", lambda t: dashboard.names(t, "function_arg_usages", "arg_index", _ARGS), f"SELECT DISTINCT arg_index FROM function_arg_usages WHERE {CALL}")
for _name, _package in (("package", PKG), ("all", None)):
    _on_tables(f"page_most_called_{_name}", lambda t, p=_package: dashboard.most_called(t, p), f"""
SELECT export_name, package_name, count(*)::INTEGER AS total_calls FROM function_usages WHERE is_latest {f"AND package_name = '{_package}'" if _package else ""} GROUP BY ALL ORDER BY total_calls DESC, package_name, export_name LIMIT 40""")
_on_tables("page_arg_pattern", lambda t: dashboard.arg_pattern(t, PKG, PART), f"SELECT arg_index, value_type, count(*)::INTEGER AS n FROM function_arg_usages WHERE {CALL} GROUP BY arg_index, value_type")
_on_tables("page_arg_snippets", lambda t: dashboard.snippet_rows(t, "function_arg_usages", _ARGS | {"arg_index": 0}), f"""
SELECT project_id, file_path, line, arg_index, value_type, value, source_snippet FROM function_arg_usages WHERE {CALL} AND arg_index = 0 AND source_snippet IS NOT NULL
ORDER BY project_id, file_path, line, arg_index, source_snippet, value_type, value LIMIT 200""")
_on_tables("page_arg_files", lambda t: dashboard.file_rows(t, "function_arg_usages", {"package_name": PKG, "project_id": PROJECT}), f"""
SELECT file_path, line, arg_index, arg_name, value_type, value FROM function_arg_usages WHERE is_latest AND package_name = '{PKG}' AND project_id = '{PROJECT}' ORDER BY file_path, line, arg_index, value_type, value LIMIT 500""")
_on_tables("page_arg_rows", lambda t: dashboard.usage_rows(t, "function_arg_usages", _ARGS), f"""
SELECT project_id, file_path, line, arg_index, arg_name, value_type, value FROM function_arg_usages WHERE {CALL} ORDER BY project_id, file_path, line, arg_index, arg_name, value_type, value LIMIT 500""")

# Aggregates that pages make of query results
_ADOPT = f"SELECT project_id FROM dependencies WHERE is_latest AND package_name = '{PKG}' UNION SELECT project_id FROM component_usages WHERE is_latest AND package_name = '{PKG}' UNION SELECT project_id FROM function_usages WHERE is_latest AND package_name = '{PKG}'"
_on_tables("page_adopters", lambda t: dashboard.adopters(t, PKG), _ADOPT)
_on_tables("page_non_adopters", lambda t: dashboard.non_adopters(t, PKG), f"SELECT DISTINCT project_id FROM project_snapshots WHERE is_latest AND project_id NOT IN ({_ADOPT})")
_on_tables("page_package_adoption", lambda t: dashboard.package_adoption(t, PKG), f"""
SELECT project_id, sum(n)::INTEGER AS usage_count FROM (
  SELECT DISTINCT project_id, 0 AS n FROM dependencies WHERE is_latest AND package_name = '{PKG}'
  UNION ALL SELECT project_id, 1 FROM component_usages WHERE is_latest AND package_name = '{PKG}'
  UNION ALL SELECT project_id, 1 FROM function_usages WHERE is_latest AND package_name = '{PKG}') GROUP BY project_id""")
_on_tables("page_package_reach", dashboard.package_reach, "SELECT package_name, count(DISTINCT project_id)::INTEGER AS project_count FROM dependencies WHERE is_latest GROUP BY package_name ORDER BY project_count DESC, package_name LIMIT 30")
_on_tables("page_section_counts", lambda t: dashboard.section_counts(t, PKG), f"SELECT dep_type, count(*)::INTEGER AS n FROM dependencies WHERE is_latest AND package_name = '{PKG}' GROUP BY dep_type")
_on_tables("page_section_totals", dashboard.section_totals, "SELECT project_id, count(*) FILTER (WHERE dep_type = 'dependencies')::INTEGER AS production, count(*) FILTER (WHERE dep_type = 'devDependencies')::INTEGER AS dev, count(*)::INTEGER AS total FROM dependencies WHERE is_latest GROUP BY project_id")
_on_tables("page_cards", dashboard.cards, "SELECT count(DISTINCT package_name)::INTEGER AS packages, count(*)::INTEGER AS entries, count(*) FILTER (WHERE version_is_prerelease)::INTEGER AS prereleases, count(DISTINCT project_id)::INTEGER AS projects FROM dependencies WHERE is_latest")
_TOOLS = ["npm", "pnpm", "yarn"]
_on_tables("page_tool_matrix", lambda t: dashboard.matrix(t, "package_manager", _TOOLS), f"SELECT project_id, {', '.join(f'''bool_or(package_manager = '{x}') AS {x}''' for x in _TOOLS)} FROM project_snapshots WHERE is_latest AND package_manager IS NOT NULL GROUP BY project_id")
_on_tables("page_packages_summary", dashboard.packages_summary, """
SELECT package_name, count(c)::INTEGER AS total_component_usages, count(f)::INTEGER AS total_function_calls,
  array_to_string(list_sort(list(DISTINCT file_path)), ',') AS files, array_to_string(list_sort(list(DISTINCT c) FILTER (WHERE c IS NOT NULL)), ',') AS components, array_to_string(list_sort(list(DISTINCT f) FILTER (WHERE f IS NOT NULL)), ',') AS functions
FROM (SELECT package_name, file_path, component_name AS c, NULL AS f FROM component_usages WHERE is_latest UNION ALL SELECT package_name, file_path, NULL, export_name FROM function_usages WHERE is_latest) GROUP BY package_name""")
_on_tables("page_first_versions", dashboard.first_versions, """
SELECT package_name, version_resolved FROM dependencies WHERE is_latest AND version_resolved IS NOT NULL QUALIFY row_number() OVER (PARTITION BY package_name ORDER BY project_id, version_resolved) = 1""")
_on_tables("page_component_values", lambda t: dashboard.component_values(t, PKG), f"""
, spread AS (SELECT component_name, prop_name, {_SHOWN} AS value, count(*)::INTEGER AS n FROM component_prop_usages WHERE is_latest AND package_name = '{PKG}' GROUP BY ALL),
best AS (SELECT component_name, prop_name FROM (SELECT component_name, prop_name, sum(n) AS s FROM spread GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY component_name ORDER BY s DESC, prop_name) <= 4),
kept AS (SELECT spread.* FROM spread JOIN best USING (component_name, prop_name))
SELECT * FROM (SELECT * FROM kept WHERE value <> '[dynamic]' QUALIFY row_number() OVER (PARTITION BY component_name, prop_name ORDER BY n DESC, value) <= 2)
UNION ALL SELECT * FROM kept WHERE value = '[dynamic]'""")
_on_tables("page_dependency_breakdown", dashboard.breakdown, f"SELECT package_name, count(DISTINCT project_id)::INTEGER AS project_count, {_SECTIONS} FROM dependencies WHERE is_latest GROUP BY package_name")

# Operators and functions on the driver's tables
_on_driver("latest_turn", lambda s, d: sel.latest_per(table(s, d, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars")),
    "SELECT conv_id, turn, role, length(text)::BIGINT AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
_on_driver("null_kept_list", lambda s, d: flat(table(s, d, "events").groupBy("user_id").agg(sel.distinct_list(F.when(F.col("event_type") != "error", F.col("event_type"))).alias("kinds"))),
    f"SELECT user_id, {_listed('CASE WHEN event_type <> $$error$$ THEN event_type END').replace('$$', chr(39))} AS kinds FROM events GROUP BY user_id")
_on_driver("documents_without_label", lambda s, d: sel.non_members(table(s, d, "documents"), table(s, d, "labels"), "doc_id"), "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_on_driver("documents_with_label", lambda s, d: table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left"), "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
_on_driver("event_checkpoints", lambda s, d: trends.checkpoint_sample(table(s, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms")), "epoch_ms", 86_400_000, ("user_id",), "event_id"),
    "SELECT event_id, user_id, epoch_us(ts) // 1000 AS epoch_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) = 1")
_on_driver("checkpoints_with_baseline", lambda s, d: (lambda c: trends.with_baseline(trends.checkpoint_sample(c.filter("epoch_ms > 1704844800000"), "epoch_ms", 604_800_000, (), "sha"), c, 1704844800000))(table(s, d, "events").select(F.col("event_id").alias("sha"), F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"))),
    """WITH c AS (SELECT event_id AS sha, epoch_us(ts) // 1000 AS epoch_ms FROM events), s AS (SELECT * FROM c WHERE epoch_ms > 1704844800000 QUALIFY row_number() OVER (PARTITION BY epoch_ms // 604800000 ORDER BY epoch_ms DESC, sha DESC) = 1)
SELECT sha, epoch_ms, epoch_ms AS code_at_ms FROM s UNION ALL (SELECT sha, epoch_ms, 1704844800000 FROM c WHERE epoch_ms <= 1704844800000 ORDER BY epoch_ms DESC, sha DESC LIMIT 1)""")
_on_driver("month_series", lambda s, d: trends.month_series(s, AS_OF, 18), f"SELECT (date_trunc('month', DATE '{AS_OF}') - to_months(g::INTEGER))::DATE AS period FROM range(0, 18) AS r(g)")
_VERSIONS = "CASE l_suppkey % 6 WHEN 0 THEN 'v' || l_linenumber WHEN 1 THEN NULL ELSE l_partkey || '.' || l_linenumber || '.' || l_quantity::INTEGER || CASE l_returnflag WHEN 'R' THEN '-rc.1+b7' WHEN 'A' THEN '+meta' ELSE '' END END"
_on_driver("semver_parse", lambda s, d: (lambda df: df.select("*", *[c.alias(n) for n, c in fn.semver(F.col("version")).items()]).distinct())(table(s, d, "lineitem").select(F.expr("CASE l_suppkey % 6 WHEN 0 THEN concat('v', l_linenumber) WHEN 1 THEN NULL ELSE concat(l_partkey, '.', l_linenumber, '.', cast(l_quantity AS int), CASE l_returnflag WHEN 'R' THEN '-rc.1+b7' WHEN 'A' THEN '+meta' ELSE '' END) END").alias("version"))), f"""
WITH x AS (SELECT DISTINCT {_VERSIONS} AS version FROM lineitem), y AS (SELECT version, split_part(version, '+', 1) AS c FROM x), z AS (SELECT version, c, regexp_matches(c, '^\\d+\\.\\d+\\.\\d+(-.+)?$') AS ok FROM y)
SELECT version, CASE WHEN version IS NOT NULL THEN CASE WHEN ok THEN split_part(c, '.', 1)::INTEGER ELSE 0 END END AS major, CASE WHEN version IS NOT NULL THEN CASE WHEN ok THEN split_part(c, '.', 2)::INTEGER ELSE 0 END END AS minor,
  CASE WHEN version IS NOT NULL THEN CASE WHEN ok THEN regexp_extract(c, '^\\d+\\.\\d+\\.(\\d+)', 1)::INTEGER ELSE 0 END END AS patch, CASE WHEN ok AND contains(c, '-') THEN regexp_extract(c, '-(.+)$', 1) END AS prerelease,
  CASE WHEN version IS NOT NULL THEN ok AND contains(c, '-') END AS is_prerelease FROM z""")
_on_driver("url_slug", lambda s, d: table(s, d, "pages").select("page_id", fn.remote_slug(F.col("url")).alias("slug")), "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS slug FROM pages")
_on_driver("path_package_name", lambda s, d: table(s, d, "pages").select("page_id", fn.package_of(F.concat(F.lit("@"), F.expr("substring(url, instr(url, '//') + 2)"))).alias("package"), fn.is_external(F.col("url")).alias("external")),
    "WITH u AS (SELECT page_id, '@' || substring(url, instr(url, '//') + 2) AS p FROM pages) SELECT page_id, split_part(p, '/', 1) || CASE WHEN contains(p, '/') THEN '/' || split_part(p, '/', 2) ELSE '' END AS package, true AS external FROM u")
_on_driver("line_col_offsets", lambda s, d: table(s, d, "documents").select("doc_id", *[c.cast("bigint").alias(n) for n, c in zip(("line", "col"), fn.line_and_column(F.col("text"), (F.length("text") / 2).cast("int")), strict=True)]), """
WITH h AS (SELECT doc_id, string_split(left(text, length(text) // 2), chr(10)) AS p FROM documents) SELECT doc_id, len(p)::BIGINT AS line, length(p[-1]) + 1 AS col FROM h""")
_on_driver("source_snippet", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(fn.snippet(F.col("text"), F.lit(4))).alias("snippet_md5"), F.length(fn.snippet(F.col("text"), F.lit(4))).cast("bigint").alias("n")), """
SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:6], chr(10))) AS snippet_md5, length(array_to_string(string_split(text, chr(10))[2:6], chr(10)))::BIGINT AS n FROM documents""")
_on_driver("value_distribution", lambda s, d: shares.value_distribution(table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("value"), F.expr("CASE WHEN cast(get_json_object(props, '$.k') AS int) % 2 = 0 THEN 'dynamic' ELSE 'static' END").alias("value_type")), ["event_type"]), """
WITH e AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_type, CASE WHEN k::INTEGER % 2 = 0 THEN '[dynamic]' ELSE k END AS value, count(*)::INTEGER AS n FROM e GROUP BY ALL""")
_on_driver("first_order_trend", lambda s, d: trends.first_seen_trend(table(s, d, "orders"), "o_custkey", F.col("o_orderdate"), AS_OF, 80), f"""
SELECT m.period, count(DISTINCT o_custkey)::INTEGER AS adopting_projects FROM (SELECT (date_trunc('month', DATE '{AS_OF}') - to_months(g::INTEGER))::DATE AS period FROM range(0, 80) AS r(g)) m JOIN orders ON date_trunc('month', o_orderdate) <= m.period GROUP BY 1""")


# The build: scan documents to tables
_HEAD = "project_id, scanned_at, code_at, is_latest"
_PACKAGE = "package_name, resolved AS package_version_resolved, major AS package_version_major, minor AS package_version_minor, patch AS package_version_patch, prerelease AS package_version_prerelease, is_prerelease AS package_version_is_prerelease"


def _on_scans(name: str, of: Callable, sql: str) -> None:
    _on_driver(name, lambda spark, sf_dir: of(standin_scans(spark, sf_dir)), f"WITH {SCANS_CTE}\n{sql.strip()}")


_on_scans("build_snapshots", lambda d: flatten(d).project_snapshots.select(*_HEAD.split(", "), "repo_url", "branch", "commit_sha", "schema_version", "framework", "typescript", "linter"), f"""
SELECT {_HEAD}, 'https://git.example/r' AS repo_url, o_orderpriority AS branch, md5(o_orderkey::VARCHAR) AS commit_sha, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS schema_version, o_orderpriority AS framework, o_orderkey % 5 = 0 AS typescript, NULL::VARCHAR AS linter FROM scans""")
_on_scans("build_dependencies", lambda d: flatten(d).dependencies, f"""
SELECT {_HEAD}, package_name, '^' || l_linenumber AS version_range, resolved AS version_resolved, major AS version_major, minor AS version_minor, patch AS version_patch, prerelease AS version_prerelease, is_prerelease AS version_is_prerelease, section AS dep_type,
  package_name LIKE '@parts3/%' OR package_name = '@parts4/x1' AS is_internal FROM uses""")
_on_scans("build_component_usages", lambda d: flatten(d).component_usages, f"SELECT {_HEAD}, {_PACKAGE}, 'C' || (l_partkey % 20) AS component_name, file_path, line FROM uses")
_on_scans("build_component_prop_usages", lambda d: flatten(d).component_prop_usages, f"""
SELECT {_HEAD}, {_PACKAGE}, 'C' || (l_partkey % 20) AS component_name, file_path, line, l_returnflag AS prop_name, CASE WHEN l_linenumber % 2 = 0 AND l_linenumber <> 4 THEN 'dynamic' ELSE 'static' END AS value_type,
  CASE WHEN l_linenumber % 2 = 1 OR l_linenumber = 4 THEN l_linestatus END AS value, '<' || l_suppkey || '>' AS source_snippet FROM uses WHERE l_linenumber <> 5""")
_on_scans("build_function_usages", lambda d: flatten(d).function_usages, f"SELECT {_HEAD}, {_PACKAGE}, 'use' || (l_partkey % 20) AS export_name, file_path, line FROM uses")
_on_scans("build_function_arg_usages", lambda d: flatten(d).function_arg_usages, f"""
SELECT {_HEAD}, {_PACKAGE}, 'use' || (l_partkey % 20) AS export_name, file_path, line, (l_linenumber % 3)::INTEGER AS arg_index, NULL::VARCHAR AS arg_name, CASE WHEN kind = 'identifier' THEN 'dynamic' ELSE 'static' END AS value_type,
  CASE WHEN kind <> 'identifier' THEN l_linestatus END AS value, '(' || l_suppkey || ')' AS source_snippet FROM uses""")
_on_scans("build_calls_with_args", lambda d: calls_with_args(d).drop("file_path"), """
SELECT project_id, is_latest, line, package_name, 'use' || (l_partkey % 20) AS export_name, (l_linenumber % 3)::INTEGER AS arg_index, CASE WHEN kind = 'identifier' THEN 'dynamic' ELSE 'static' END AS value_type,
  CASE WHEN kind <> 'identifier' THEN l_linestatus END AS value, '(' || l_suppkey || ')' AS source_snippet FROM uses""")
_on_scans("build_project_identity", lambda d: d.select("id", fn.project_slug(F.concat(F.lit("git@git.example:"), F.col("projectSlug"), F.lit(".git")), F.col("projectName"), F.concat(F.lit("/work/"), F.col("branch"), F.lit("/"))).alias("slug")), """
SELECT 'scan-' || o_orderkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN 'git.example/org/p' || (o_custkey % 40) WHEN o_custkey % 14 <> 0 THEN 'name' || (o_custkey % 40) ELSE o_orderpriority END AS slug FROM orders""")

# Column functions that no other query shows
_on_driver("import_targets", lambda s, d: (lambda df: df.select("l_orderkey", "l_linenumber", fn.in_targets(F.col("p"), F.array(F.lit("@parts1"), F.lit("@parts2/x"))).alias("is_target"), fn.is_external(F.col("p"), F.array(F.lit("@parts1/x0"), F.lit("@parts2"))).alias("is_external"), fn.is_internal(F.col("p"), F.array(F.lit("@parts3/"), F.lit("@parts4"))).alias("is_internal")))(
    table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE l_suppkey % 4 WHEN 0 THEN concat('@parts', l_partkey % 6) WHEN 1 THEN concat('@parts', l_partkey % 6, '/x', l_suppkey % 2, '/y') WHEN 2 THEN './local' ELSE concat('@parts', l_partkey % 6, 'b') END").alias("p"))), """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 4 WHEN 0 THEN '@parts' || (l_partkey % 6) WHEN 1 THEN '@parts' || (l_partkey % 6) || '/x' || (l_suppkey % 2) || '/y' WHEN 2 THEN './local' ELSE '@parts' || (l_partkey % 6) || 'b' END AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, p = '@parts1' OR p LIKE '@parts1/%' OR p = '@parts2/x' OR p LIKE '@parts2/x/%' AS is_target,
  CASE WHEN p LIKE './%' THEN false ELSE list_contains(['@parts1/x0', '@parts2'], array_to_string(string_split(p, '/')[1:2], '/')) END AS is_external, p LIKE '@parts3/%' OR p = '@parts4' AS is_internal FROM x""")
_on_driver("site_links", lambda s, d: table(s, d, "orders").select("o_orderkey", fn.source_link(F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'github.com/org/repo' WHEN 1 THEN 'github.com/org/repo/web/app' ELSE 'git.example/org/repo' END"), F.expr("IF(o_orderkey % 2 = 0, o_orderpriority, NULL)"), F.lit("src/a.ts"), F.expr("IF(o_custkey % 2 = 0, o_custkey, NULL)")).alias("link"),
    fn.arg_index(F.expr("CASE o_custkey % 3 WHEN 0 THEN concat('Arg ', o_custkey) WHEN 1 THEN 'Arg x' END")).isNull().alias("no_arg"), F.coalesce(fn.arg_index(F.expr("CASE o_custkey % 3 WHEN 0 THEN concat('Arg ', o_custkey) WHEN 1 THEN 'Arg x' END")), F.lit(-1)).alias("arg"), fn.indentation(F.concat(F.expr("repeat(' ', cast(o_custkey % 9 AS int))"), F.col("o_orderpriority"))).cast("int").alias("indent"), fn.value_type(F.expr("CASE o_custkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'undefined' WHEN 2 THEN 'object' END")).alias("value_type")), """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'https://github.com/org/repo/blob/' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'HEAD' END || CASE WHEN o_orderkey % 3 = 1 THEN '/web/app' ELSE '' END || '/src/a.ts' || CASE WHEN o_custkey % 2 = 0 THEN '#L' || o_custkey ELSE '' END END AS link,
  o_custkey % 3 <> 0 AS no_arg, CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE -1 END::INTEGER AS arg, (o_custkey % 9)::INTEGER AS indent, CASE WHEN o_custkey % 4 < 2 THEN 'static' ELSE 'dynamic' END AS value_type FROM orders""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.presence_trend(standin_tables(spark, sf_dir), PKG)


def core_queries() -> dict[str, Query]:
    return dict(_queries)


def core_sql() -> dict[str, str]:
    return dict(_sql)
