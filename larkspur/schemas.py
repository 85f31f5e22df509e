"""Fixed schemas: the scan document and the six tables made of it. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string

_VERSION = "packageVersionResolved STRING, packageVersionMajor INT, packageVersionMinor INT, packageVersionPatch INT, packageVersionPrerelease STRING, packageVersionIsPrerelease BOOLEAN"
IMPORTS = "ARRAY<STRUCT<source STRING, specifiers ARRAY<STRUCT<local STRING, imported STRING, type STRING>>, typeOnly BOOLEAN>>"
COMPONENTS = f"ARRAY<STRUCT<file STRING, line INT, `column` INT, componentName STRING, importedFrom STRING, props ARRAY<STRUCT<name STRING, value STRING, isDynamic BOOLEAN, sourceSnippet STRING>>, selfClosing BOOLEAN, {_VERSION}>>"
CALLS = f"ARRAY<STRUCT<file STRING, line INT, `column` INT, functionName STRING, importedFrom STRING, args ARRAY<STRUCT<index INT, type STRING, value STRING, isSpread BOOLEAN, sourceSnippet STRING>>, {_VERSION}>>"
DEPENDENCIES = "ARRAY<STRUCT<name STRING, versionRange STRING, section STRING, versionResolved STRING, versionMajor INT, versionMinor INT, versionPatch INT, versionPrerelease STRING, versionIsPrerelease BOOLEAN>>"
TOOLING = "STRUCT<packageManager STRING, packageManagerVersion STRING, buildTool STRING, testFramework STRING, bundler STRING, linter STRING, formatter STRING, cssApproach STRING, typescript BOOLEAN, typescriptVersion STRING, nodeVersion STRING, framework STRING, frameworkVersion STRING>"
SUMMARY = "STRUCT<totalFilesScanned INT, filesWithErrors INT, filesWithTargetUsage INT, totalComponentUsages INT, totalFunctionCalls INT, byPackage MAP<STRING, STRUCT<totalComponentUsages INT, totalFunctionCalls INT, files ARRAY<STRING>, components ARRAY<STRING>, functions ARRAY<STRING>>>>"

SCAN_DDL = (
    "id STRING, schemaVersion INT, projectPath STRING, projectName STRING, projectSlug STRING, scannedAt STRING, repoUrl STRING, branch STRING, "
    "commitSha STRING, packageJson STRING, targetPackages ARRAY<STRING>, internalPackages ARRAY<STRING>, fileCount INT, "
    f"files ARRAY<STRUCT<filePath STRING, relativePath STRING, imports {IMPORTS}, componentUsages {COMPONENTS}, functionCalls {CALLS}, errors ARRAY<STRING>>>, "
    f"summary {SUMMARY}, meta STRUCT<packageName STRING, packageVersion STRING, dependencies {DEPENDENCIES}, tooling {TOOLING}>, "
    "cacheHits INT, codeAt STRING, isHistoricalScan BOOLEAN"
)

_HEAD = "project_id STRING, scanned_at STRING, code_at STRING, is_latest BOOLEAN"
_SITE = "package_name STRING, package_version_resolved STRING, package_version_major INT, package_version_minor INT, package_version_patch INT, package_version_prerelease STRING, package_version_is_prerelease BOOLEAN"
_VALUE = "value_type STRING, value STRING, source_snippet STRING"

TABLE_DDL = {
    "project_snapshots": f"{_HEAD}, repo_url STRING, branch STRING, commit_sha STRING, schema_version INT, package_manager STRING, build_tool STRING, test_framework STRING, bundler STRING, linter STRING, formatter STRING, css_approach STRING, typescript BOOLEAN, typescript_version STRING, node_version STRING, framework STRING, framework_version STRING",
    "dependencies": f"{_HEAD}, package_name STRING, version_range STRING, version_resolved STRING, version_major INT, version_minor INT, version_patch INT, version_prerelease STRING, version_is_prerelease BOOLEAN, dep_type STRING, is_internal BOOLEAN",
    "component_usages": f"{_HEAD}, {_SITE}, component_name STRING, file_path STRING, line INT",
    "component_prop_usages": f"{_HEAD}, {_SITE}, component_name STRING, file_path STRING, line INT, prop_name STRING, {_VALUE}",
    "function_usages": f"{_HEAD}, {_SITE}, export_name STRING, file_path STRING, line INT",
    "function_arg_usages": f"{_HEAD}, {_SITE}, export_name STRING, file_path STRING, line INT, arg_index INT, arg_name STRING, {_VALUE}",
}


def scan_schema() -> StructType:
    return _parse_datatype_string(SCAN_DDL)


def table_schema(name: str) -> StructType:
    return _parse_datatype_string(TABLE_DDL[name])
