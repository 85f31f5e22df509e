"""The six tables made of the driver's order tables, as DataFrames and as SQL.

A customer is a project, an order a scan of it, a line item a dependency and a use site. So every named query runs on
tables of any size that an independent engine can make too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.selection import latest_flag
from larkspur.sources.tables import Tables, migrated

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
AS_OF = "2001-08-01"


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    iso = lambda c: F.date_format(c.cast("timestamp"), ISO)
    earlier = F.expr("o_orderdate - make_dt_interval(cast(o_orderkey % 7 AS int))")
    scans = orders.select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project_id"),
        iso(at).alias("scanned_at"),
        F.when(F.col("o_orderkey") % 5 != 0, iso(earlier)).alias("code_at"),
    )
    return latest_flag(scans, ["o_custkey"], [F.coalesce("code_at", "scanned_at").desc(), F.col("o_orderkey").desc()])


def standin_tables(spark: SparkSession, sf_dir: str) -> Tables:
    scans = _scans(spark, sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    snapshots = scans.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "project_id", "scanned_at", "code_at", "is_latest",
        "concat('https://git.example.org/', project_id) AS repo_url", "'main' AS branch", "concat('s', cast(o_orderkey AS string)) AS commit_sha",
        "cast(o_orderkey % 2 AS int) AS schema_version",
        "CASE o_custkey % 4 WHEN 0 THEN 'pnpm' WHEN 1 THEN 'yarn' WHEN 2 THEN 'npm' END AS package_manager",
        "lower(substring(o_orderpriority, 3)) AS build_tool",
        "CASE o_orderstatus WHEN 'F' THEN 'jest' WHEN 'O' THEN 'vitest' END AS test_framework",
        "CASE o_orderkey % 3 WHEN 0 THEN 'eslint' WHEN 1 THEN 'biome' END AS linter",
        "CASE WHEN o_orderkey % 4 = 1 THEN 'prettier' END AS formatter",
        "CASE WHEN o_custkey % 5 = 0 THEN 'tailwind' END AS css_approach",
        "CASE WHEN o_custkey % 3 = 0 THEN true END AS typescript",
        "lower(c_mktsegment) AS framework",
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size")
    head = scans.select("o_orderkey", "project_id", "scanned_at", "code_at", "is_latest")
    sites = lines.join(head, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    sites = sites.withColumn("known", F.col("l_suppkey") % 10 != 0).withColumn("pre", F.col("l_returnflag") == "R")
    sites = sites.selectExpr(
        "*", "concat('@parts/', lower(p_type)) AS package_name",
        "CASE WHEN known THEN concat(p_size, '.', l_linenumber, '.', cast(l_quantity AS int), CASE WHEN pre THEN concat('-beta.', l_linenumber) ELSE '' END) END AS v",
        "CASE WHEN known THEN p_size END AS v1", "CASE WHEN known THEN l_linenumber END AS v2", "CASE WHEN known THEN cast(l_quantity AS int) END AS v3",
        "CASE WHEN known AND pre THEN concat('beta.', l_linenumber) END AS v4", "CASE WHEN known THEN pre END AS v5",
        "replace(p_name, ' ', '_') AS name", "concat('src/f', l_suppkey, '.tsx') AS file_path", "l_linenumber AS line",
    )
    base = ["project_id", "scanned_at", "code_at", "is_latest", "package_name"]
    dependencies = sites.selectExpr(
        *base, "concat('^', p_size, '.0.0') AS version_range", "v AS version_resolved", "v1 AS version_major", "v2 AS version_minor", "v3 AS version_patch",
        "v4 AS version_prerelease", "v5 AS version_is_prerelease",
        "CASE l_returnflag WHEN 'N' THEN 'dependencies' WHEN 'A' THEN 'devDependencies' ELSE 'peerDependencies' END AS dep_type",
        "l_suppkey % 7 = 0 AS is_internal",
    )
    version = ["v AS package_version_resolved", "v1 AS package_version_major", "v2 AS package_version_minor", "v3 AS package_version_patch", "v4 AS package_version_prerelease", "v5 AS package_version_is_prerelease"]
    use = [*base, *version, "file_path", "line"]
    components, functions = sites.filter("l_linestatus = 'O'"), sites.filter("l_linestatus = 'F'")
    value = [
        "CASE WHEN l_partkey % 3 = 0 THEN 'dynamic' ELSE 'static' END AS value_type",
        "CASE WHEN l_partkey % 3 <> 0 AND l_quantity < 40 THEN cast(cast(l_quantity AS int) AS string) END AS value",
        "CASE WHEN l_partkey % 3 = 0 THEN concat('// ', file_path, '\\n  use(', name, ')') END AS source_snippet",
    ]
    props = components.selectExpr("*", "explode(CASE WHEN l_quantity > 25 THEN array(0, 1) ELSE array(0) END) AS slot")
    args = functions.filter("l_suppkey % 4 <> 0").selectExpr("*", "explode(CASE WHEN l_quantity > 25 THEN array(0, 1) ELSE array(0) END) AS slot")
    made = {
        "project_snapshots": snapshots,
        "dependencies": dependencies,
        "component_usages": components.selectExpr(*use, "name AS component_name"),
        "component_prop_usages": props.selectExpr(*use, "name AS component_name", "CASE slot WHEN 0 THEN concat('p', l_partkey % 5) ELSE concat('q', l_linenumber % 3) END AS prop_name", *value),
        "function_usages": functions.selectExpr(*use, "name AS export_name"),
        "function_arg_usages": args.selectExpr(*use, "name AS export_name", "slot AS arg_index", "cast(null AS string) AS arg_name", *value),
    }
    return Tables(**{n: migrated(df, n) for n, df in made.items()})


#: The same tables as common table expressions for the oracle.
CTE = r"""scans AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(code_at, scanned_at) DESC, o_orderkey DESC) = 1 AS is_latest FROM (
    SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, 'p' || o_custkey AS project_id,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS scanned_at,
      CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate - to_days((o_orderkey % 7)::INTEGER), '%Y-%m-%dT%H:%M:%SZ') END AS code_at
    FROM orders)),
project_snapshots AS (
  SELECT project_id, scanned_at, code_at, is_latest, 'https://git.example.org/' || project_id AS repo_url, 'main' AS branch, 's' || o_orderkey AS commit_sha,
    (o_orderkey % 2)::INTEGER AS schema_version,
    CASE o_custkey % 4 WHEN 0 THEN 'pnpm' WHEN 1 THEN 'yarn' WHEN 2 THEN 'npm' END AS package_manager,
    lower(substring(o_orderpriority, 3)) AS build_tool,
    CASE o_orderstatus WHEN 'F' THEN 'jest' WHEN 'O' THEN 'vitest' END AS test_framework, NULL::VARCHAR AS bundler,
    CASE o_orderkey % 3 WHEN 0 THEN 'eslint' WHEN 1 THEN 'biome' END AS linter,
    CASE WHEN o_orderkey % 4 = 1 THEN 'prettier' END AS formatter,
    CASE WHEN o_custkey % 5 = 0 THEN 'tailwind' END AS css_approach,
    CASE WHEN o_custkey % 3 = 0 THEN true END AS typescript, NULL::VARCHAR AS typescript_version, NULL::VARCHAR AS node_version,
    lower(c_mktsegment) AS framework, NULL::VARCHAR AS framework_version
  FROM scans JOIN customer ON o_custkey = c_custkey),
sites AS (
  SELECT project_id, scanned_at, code_at, is_latest, '@parts/' || lower(p_type) AS package_name, l_suppkey, l_partkey, l_quantity, l_linestatus, l_returnflag, l_linenumber, p_size,
    CASE WHEN l_suppkey % 10 <> 0 THEN p_size || '.' || l_linenumber || '.' || l_quantity::INTEGER || CASE WHEN l_returnflag = 'R' THEN '-beta.' || l_linenumber ELSE '' END END AS v,
    CASE WHEN l_suppkey % 10 <> 0 THEN p_size END AS v1, CASE WHEN l_suppkey % 10 <> 0 THEN l_linenumber END AS v2, CASE WHEN l_suppkey % 10 <> 0 THEN l_quantity::INTEGER END AS v3,
    CASE WHEN l_suppkey % 10 <> 0 AND l_returnflag = 'R' THEN 'beta.' || l_linenumber END AS v4, CASE WHEN l_suppkey % 10 <> 0 THEN l_returnflag = 'R' END AS v5,
    replace(p_name, ' ', '_') AS name, 'src/f' || l_suppkey || '.tsx' AS file_path, l_linenumber AS line,
    CASE WHEN l_partkey % 3 = 0 THEN 'dynamic' ELSE 'static' END AS value_type,
    CASE WHEN l_partkey % 3 <> 0 AND l_quantity < 40 THEN l_quantity::INTEGER::VARCHAR END AS value
  FROM lineitem JOIN scans ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
noted AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN '// ' || file_path || chr(10) || '  use(' || name || ')' END AS source_snippet FROM sites),
dependencies AS (
  SELECT project_id, scanned_at, code_at, is_latest, package_name, '^' || p_size || '.0.0' AS version_range, v AS version_resolved, v1 AS version_major, v2 AS version_minor,
    v3 AS version_patch, v4 AS version_prerelease, v5 AS version_is_prerelease,
    CASE l_returnflag WHEN 'N' THEN 'dependencies' WHEN 'A' THEN 'devDependencies' ELSE 'peerDependencies' END AS dep_type, l_suppkey % 7 = 0 AS is_internal
  FROM sites),
uses AS (
  SELECT *, v AS package_version_resolved, v1 AS package_version_major, v2 AS package_version_minor, v3 AS package_version_patch,
    v4 AS package_version_prerelease, v5 AS package_version_is_prerelease FROM noted),
component_usages AS (SELECT *, name AS component_name FROM uses WHERE l_linestatus = 'O'),
function_usages AS (SELECT *, name AS export_name FROM uses WHERE l_linestatus = 'F'),
component_prop_usages AS (
  SELECT *, 'p' || (l_partkey % 5) AS prop_name FROM component_usages
  UNION ALL SELECT *, 'q' || (l_linenumber % 3) AS prop_name FROM component_usages WHERE l_quantity > 25),
function_arg_usages AS (
  SELECT *, 0 AS arg_index, NULL::VARCHAR AS arg_name FROM function_usages WHERE l_suppkey % 4 <> 0
  UNION ALL SELECT *, 1 AS arg_index, NULL::VARCHAR AS arg_name FROM function_usages WHERE l_suppkey % 4 <> 0 AND l_quantity > 25)"""
