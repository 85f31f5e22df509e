"""From scan documents to the six tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import is_internal, value_type
from larkspur.operators.selection import effective_time, latest_flag
from larkspur.schemas import TABLE_DDL
from larkspur.sources.scan_store import read_scans
from larkspur.sources.tables import Tables, delete, migrated, write

#: Column of a table → field of ``tooling`` (fixed values).
TOOLS = {
    "package_manager": "packageManager", "build_tool": "buildTool", "test_framework": "testFramework", "bundler": "bundler", "linter": "linter", "formatter": "formatter", "css_approach": "cssApproach",
    "typescript": "typescript", "typescript_version": "typescriptVersion", "node_version": "nodeVersion", "framework": "framework", "framework_version": "frameworkVersion",
}
PARTS = {"resolved": "Resolved", "major": "Major", "minor": "Minor", "patch": "Patch", "prerelease": "Prerelease", "is_prerelease": "IsPrerelease"}


def identified(scans: DataFrame) -> DataFrame:
    """Scans with project_id, scanned_at, code_at and is_latest: per project the latest instant, ties to the larger scan id.

    One row a scan, so the window is over few rows; the flag is carried into every table.
    """
    df = scans.withColumns({"project_id": F.coalesce("projectSlug", "projectName", "id"), "scanned_at": F.col("scannedAt"), "code_at": F.col("codeAt")})
    return latest_flag(df, ["project_id"], [effective_time().desc_nulls_last(), F.col("id").desc_nulls_last()])


def flatten(scans: DataFrame) -> Tables:
    """The six tables of ``scans``; nothing is read until one is used."""
    return tables_of(identified(scans))


def tables_of(df: DataFrame) -> Tables:
    """The six tables of scans that ``identified`` has marked."""
    head = ["project_id", "scanned_at", "code_at", "is_latest"]
    snapshots = df.select(*head, F.col("repoUrl").alias("repo_url"), "branch", F.col("commitSha").alias("commit_sha"), F.coalesce("schemaVersion", F.lit(0)).alias("schema_version"), *[F.col(f"meta.tooling.{f}").alias(c) for c, f in TOOLS.items()])

    deps = df.select(*head, "internalPackages", F.explode("meta.dependencies").alias("d"))
    dependencies = deps.select(
        *head, F.col("d.name").alias("package_name"), F.col("d.versionRange").alias("version_range"), *[F.col(f"d.version{f}").alias(f"version_{c}") for c, f in PARTS.items()],
        F.col("d.section").alias("dep_type"), is_internal(F.col("d.name"), F.col("internalPackages")).alias("is_internal"),
    )

    files = df.select(*head, F.explode("files").alias("f"))
    relative = F.col("f.relativePath")

    def sites(field: str, name: str, out: str, inner: str) -> tuple[DataFrame, DataFrame]:
        use = files.select(*head, relative.alias("relative"), F.explode(f"f.{field}").alias("u"))
        shown = [*head, F.col("u.importedFrom").alias("package_name"), *[F.col(f"u.packageVersion{f}").alias(f"package_version_{c}") for c, f in PARTS.items()], F.col(f"u.{name}").alias(out), F.coalesce("relative", "u.file").alias("file_path"), F.col("u.line").alias("line")]
        return use.select(*shown), use.select(*shown, F.explode(f"u.{inner}").alias("v"))

    components, props = sites("componentUsages", "componentName", "component_name", "props")
    calls, args = sites("functionCalls", "functionName", "export_name", "args")
    snippet = F.col("v.sourceSnippet").alias("source_snippet")
    dynamic = F.coalesce("v.isDynamic", F.lit(False))
    props = props.withColumns({"prop_name": F.col("v.name"), "value_type": F.when(dynamic, "dynamic").otherwise("static"), "value": F.when(~dynamic, F.col("v.value"))}).withColumn("source_snippet", snippet)
    kind = value_type(F.col("v.type"))
    args = args.withColumns({"arg_index": F.col("v.index"), "arg_name": F.lit(None).cast("string"), "value_type": kind, "value": F.when(kind == "static", F.col("v.value"))}).withColumn("source_snippet", snippet)
    made = {"project_snapshots": snapshots, "dependencies": dependencies, "component_usages": components, "component_prop_usages": props, "function_usages": calls, "function_arg_usages": args}
    return Tables(**{n: migrated(t, n) for n, t in made.items()})


def calls_with_args(scans: DataFrame) -> DataFrame:
    """Calls and their own arguments, from one walk of the documents; a call without any keeps a row of nulls.

    Unlike the join of the two tables, calls that share a line don't mix.
    """
    df = identified(scans)
    calls = df.select("project_id", "scanned_at", "is_latest", F.explode("files").alias("f")).select("project_id", "scanned_at", "is_latest", F.col("f.relativePath").alias("file_path"), F.explode("f.functionCalls").alias("u"))
    kind = value_type(F.col("v.type"))
    return calls.select("*", F.explode_outer("u.args").alias("v")).select(
        "project_id", "is_latest", "file_path", F.col("u.line").alias("line"), F.col("u.importedFrom").alias("package_name"), F.col("u.functionName").alias("export_name"),
        F.col("v.index").alias("arg_index"), F.when(F.col("v").isNotNull(), kind).alias("value_type"), F.when(kind == "static", F.col("v.value")).alias("value"), F.col("v.sourceSnippet").alias("source_snippet"),
    )


@dataclass
class Report:
    rows: dict[str, int]
    skipped: int


def build(spark: SparkSession, store: str, warehouse: str) -> Report:
    """Reads every document of ``store`` and rewrites all six tables below ``warehouse``.

    Documents are parsed and marked once, into a columnar stage of which each table reads the fields it needs.
    """
    scans, bad = read_scans(spark, store)
    stage = f"{warehouse}/_stage"
    marked = identified(scans).drop("packageJson", "summary")
    marked.write.mode("overwrite").parquet(stage)
    tables = tables_of(spark.read.schema(marked.schema).parquet(stage))
    for name in TABLE_DDL:
        write(getattr(tables, name), warehouse, name)
    delete(spark, stage)
    done = Tables.read(spark, warehouse, optional=False)
    return Report({n: getattr(done, n).count() for n in TABLE_DDL}, bad.count())
