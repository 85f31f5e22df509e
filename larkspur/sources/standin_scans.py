"""Scan documents made of the order tables: one for each order, a file for each of its lines, so that the build can be
held against SQL on the same tables. They are written as JSON and read by the fixed schema, as documents are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.schemas import SCAN_DDL

INTERNAL = ("@parts3/", "@parts4/x1")
#: Parts of a line's entries, in words that both engines read alike.
NAME = "concat('@parts', l_partkey % 10, '/x', l_suppkey % 5)"
RESOLVED = "concat(l_linenumber, '.', CAST(l_quantity AS int), '.0', CASE WHEN l_returnflag = 'R' THEN '-rc.1' ELSE '' END)"
SECTION = "CASE l_returnflag WHEN 'A' THEN 'devDependencies' WHEN 'R' THEN 'peerDependencies' ELSE 'dependencies' END"
KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'identifier' ELSE 'null' END"
SLUG = "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('org/p', o_custkey % 40) END"
PROJECT = "CASE WHEN o_custkey % 14 = 0 THEN NULL ELSE concat('name', o_custkey % 40) END"
SCANNED = "concat(CAST(CAST(o_orderdate AS date) AS string), 'T00:00:00.000Z')"
CODE = "CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(CAST(o_orderdate AS date) + 400 AS string), 'T00:00:00.000Z') END"

_VERSION = f"'packageVersionResolved', {RESOLVED}, 'packageVersionMajor', l_linenumber, 'packageVersionMinor', CAST(l_quantity AS int), 'packageVersionPatch', 0, 'packageVersionPrerelease', IF(l_returnflag = 'R', 'rc.1', NULL), 'packageVersionIsPrerelease', l_returnflag = 'R'"
_SITE = f"'file', concat('/src/f', l_linenumber, '.tsx'), 'line', l_suppkey, 'column', 1, 'importedFrom', {NAME}, {_VERSION}"
_PROP = "named_struct('name', l_returnflag, 'value', l_linestatus, 'isDynamic', IF(l_linenumber = 4, NULL, l_linenumber % 2 = 0), 'sourceSnippet', concat('<', l_suppkey, '>'))"
_ARG = f"named_struct('index', l_linenumber % 3, 'type', {KIND}, 'value', l_linestatus, 'isSpread', false, 'sourceSnippet', concat('(', l_suppkey, ')'))"
_FILE = f"""named_struct('filePath', concat('/src/f', l_linenumber, '.tsx'), 'relativePath', IF(l_linenumber = 3, NULL, concat('f', l_linenumber, '.tsx')),
  'componentUsages', array(named_struct({_SITE}, 'componentName', concat('C', l_partkey % 20), 'props', IF(l_linenumber = 5, array(), array({_PROP})))),
  'functionCalls', array(named_struct({_SITE}, 'functionName', concat('use', l_partkey % 20), 'args', array({_ARG}))))"""
_DEPENDENCY = f"named_struct('name', {NAME}, 'versionRange', concat('^', l_linenumber), 'section', {SECTION}, 'versionResolved', {RESOLVED}, 'versionMajor', l_linenumber, 'versionMinor', CAST(l_quantity AS int), 'versionPatch', 0, 'versionPrerelease', IF(l_returnflag = 'R', 'rc.1', NULL), 'versionIsPrerelease', l_returnflag = 'R')"
_DOCUMENT = f"""named_struct('id', concat('scan-', o_orderkey), 'schemaVersion', IF(o_orderkey % 2 = 0, 2, NULL), 'projectSlug', {SLUG}, 'projectName', {PROJECT}, 'scannedAt', {SCANNED}, 'codeAt', {CODE},
  'repoUrl', 'https://git.example/r', 'branch', o_orderpriority, 'commitSha', md5(CAST(o_orderkey AS string)), 'internalPackages', array({", ".join(f"'{p}'" for p in INTERNAL)}),
  'meta', named_struct('dependencies', dependencies, 'tooling', named_struct('framework', o_orderpriority, 'typescript', o_orderkey % 5 = 0)), 'files', files)"""


def standin_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    held = lines.groupBy("l_orderkey").agg(F.expr(f"collect_list({_DEPENDENCY})").alias("dependencies"), F.expr(f"collect_list({_FILE})").alias("files"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(F.from_json(F.to_json(F.expr(_DOCUMENT)), SCAN_DDL).alias("d")).select("d.*")


#: The same rows by SQL: ``scans`` are the documents with is_latest, ``uses`` a row for each line of each.
SCANS_CTE = f"""scans AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(code_at, scanned_at) DESC, id DESC) = 1 AS is_latest
  FROM (SELECT o_orderkey, o_orderpriority, 'scan-' || o_orderkey AS id, coalesce({SLUG.replace("NULL ELSE concat('org/p', o_custkey % 40)", "NULL ELSE 'org/p' || (o_custkey % 40)")}, {PROJECT}, 'scan-' || o_orderkey) AS project_id,
    {SCANNED.replace(" AS string", " AS varchar")} AS scanned_at, {CODE.replace(" AS string", " AS varchar")} AS code_at FROM orders)),
uses AS (
  SELECT project_id, scanned_at, code_at, is_latest, {NAME} AS package_name, {RESOLVED} AS resolved, l_linenumber::INTEGER AS major, CAST(l_quantity AS int) AS minor, 0 AS patch, CASE WHEN l_returnflag = 'R' THEN 'rc.1' END AS prerelease, l_returnflag = 'R' AS is_prerelease,
    {SECTION} AS section, l_suppkey::INTEGER AS line, CASE WHEN l_linenumber = 3 THEN '/src/f3.tsx' ELSE 'f' || l_linenumber || '.tsx' END AS file_path, {KIND} AS kind, lineitem.*
  FROM scans JOIN lineitem ON l_orderkey = o_orderkey)"""
