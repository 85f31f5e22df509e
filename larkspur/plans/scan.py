"""From a project's files to a scan document."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from larkspur.extract.lockfiles import FILES as LOCKFILES
from larkspur.extract.lockfiles import resolved_versions
from larkspur.extract.tooling import declared, known_packages, tooling
from larkspur.extract.usage import analyze
from larkspur.functions.periods import interval_ms, parse_period, resolve
from larkspur.functions.text import package_of, project_slug
from larkspur.operators.trends import checkpoint_sample, with_baseline
from larkspur.schemas import CALLS, COMPONENTS, IMPORTS
from larkspur.session import on_workers
from larkspur.sources import git
from larkspur.sources.project_files import is_source, load_config, lockfiles, package_roots, read_files, to_analyse
from larkspur.sources.scan_store import ScanStore
from larkspur.sources.tables import delete, folders

ANALYSIS_DDL = f"filePath STRING, relativePath STRING, imports {IMPORTS}, componentUsages {COMPONENTS}, functionCalls {CALLS}, errors ARRAY<STRING>"
SCHEMA_VERSION = 1


def analysis_schema() -> StructType:
    return _parse_datatype_string(ANALYSIS_DDL)


def analyse_files(sources: DataFrame, targets: list[str], known: list[str], root: str = "") -> DataFrame:
    """An analysis for each (path, content) row. Only the parser is Python; each task streams its files."""
    wanted, names = frozenset(targets), frozenset(known)

    def rows(batches):
        for batch in batches:
            made = [analyze(p, None if c is None else bytes(c).decode("utf-8", "replace"), root, wanted, names) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"j": [json.dumps(m) for m in made]})

    on_workers(sources.sparkSession)
    text = sources.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(rows, "j string")
    return text.select(F.from_json("j", analysis_schema()).alias("a")).select("a.*")


#: Raised when the analysis of a file would come out differently.
CACHE_VERSION = 1


def analysed(listed: DataFrame, targets: list[str], known: list[str], root: str, cache: str | None = None) -> tuple[DataFrame, int]:
    """(analyses of all files, how many of them came from the cache). listed: path, content, modified, size.

    The cache is a folder of numbered tables; the newest counts, and is replaced by one of the files there are now.
    """
    spark = listed.sparkSession
    if not cache:
        return analyse_files(listed, targets, known, root), 0
    numbers = [int(n) for n in folders(spark, cache) if n.isdigit()]
    schema = _parse_datatype_string(f"path STRING, modified TIMESTAMP, size BIGINT, targets ARRAY<STRING>, version INT, analysis STRUCT<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in analysis_schema())}>")
    old = spark.read.schema(schema).parquet(f"{cache}/{max(numbers)}") if numbers else spark.createDataFrame([], schema)
    keyed = listed.select(F.col("path"), "content", "modified", F.col("size").cast("bigint").alias("size"))
    wanted = sorted({*targets, *(f"known:{k}" for k in known)})
    missing, held = to_analyse(keyed, old, wanted, CACHE_VERSION)
    fresh = analyse_files(missing, targets, known, root).select(F.struct("*").alias("analysis"))
    fresh = missing.select("path", "modified", "size").join(fresh, F.col("path") == F.col("analysis.filePath"))
    fresh = fresh.select("path", "modified", "size", F.array(*map(F.lit, wanted)).cast("array<string>").alias("targets"), F.lit(CACHE_VERSION).alias("version"), F.col("analysis").cast(schema["analysis"].dataType).alias("analysis"))
    new = f"{cache}/{max(numbers, default=0) + 1}"
    hits = held.count()
    fresh.unionByName(held).write.parquet(new)
    for n in numbers:
        delete(spark, f"{cache}/{n}")
    return spark.read.schema(schema).parquet(new).select("analysis.*"), hits


def enriched(files: DataFrame, versions: DataFrame, by_package: bool = False) -> DataFrame:
    """Use sites with the resolved version of the package they import.

    versions: (name, version_*), one row a package of one lockfile, so it may be broadcast. ``by_package`` also resolves
    paths below a package; without it only the bare name does.
    """
    fields = ["resolved", "major", "minor", "patch", "prerelease", "is_prerelease"]
    entry = F.struct(*[F.col(f"version_{f}").alias(f) for f in fields])
    lookup = versions.agg(F.map_from_entries(F.collect_list(F.struct("name", entry))).alias("m"))
    schema = files.schema

    def versioned(column: str, names: list[str]) -> F.Column:
        def one(u: F.Column) -> F.Column:
            key = package_of(u["importedFrom"]) if by_package else u["importedFrom"]
            v = F.try_element_at(F.col("m"), key)
            kept = [u[n].alias(n) for n in names if not n.startswith("packageVersion")]
            new = dict(zip(("packageVersionResolved", "packageVersionMajor", "packageVersionMinor", "packageVersionPatch", "packageVersionPrerelease", "packageVersionIsPrerelease"), fields, strict=True))
            return F.struct(*kept, *[v[f].alias(n) for n, f in new.items()])

        return F.transform(column, one).cast(schema[column].dataType)

    names = {c: schema[c].dataType.elementType.names for c in ("componentUsages", "functionCalls")}
    joined = files.join(F.broadcast(lookup), F.lit(True))  # one row
    return joined.withColumns({c: versioned(c, n) for c, n in names.items()}).drop("m")


def dependency_entries(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """Declared dependencies (name, version_range, section) with their resolved versions; null where the lockfile has none."""
    return entries.join(versions, "name", "left")


def summary(files: DataFrame) -> dict:
    """Totals over a scan's analyses, and totals and lists for each package."""
    used = (F.size("componentUsages") > 0) | (F.size("functionCalls") > 0)
    total = files.agg(
        F.count("*").alias("totalFilesScanned"), F.count_if(F.size("errors") > 0).alias("filesWithErrors"), F.count_if(used).alias("filesWithTargetUsage"),
        F.coalesce(F.sum(F.size("componentUsages")), F.lit(0)).alias("totalComponentUsages"), F.coalesce(F.sum(F.size("functionCalls")), F.lit(0)).alias("totalFunctionCalls"),
    ).first()
    none = F.lit(None).cast("string")
    parts = files.select("relativePath", F.explode("componentUsages").alias("u")).select(F.col("u.importedFrom").alias("p"), "relativePath", F.col("u.componentName").alias("c"), none.alias("f"))
    parts = parts.unionByName(files.select("relativePath", F.explode("functionCalls").alias("u")).select(F.col("u.importedFrom").alias("p"), "relativePath", none.alias("c"), F.col("u.functionName").alias("f")))
    grouped = parts.groupBy("p").agg(F.count("c").alias("totalComponentUsages"), F.count("f").alias("totalFunctionCalls"), F.sort_array(F.collect_set("relativePath")).alias("files"), F.sort_array(F.collect_set("c")).alias("components"), F.sort_array(F.collect_set("f")).alias("functions"))
    return {**total.asDict(), "byPackage": {r["p"]: {k: v for k, v in r.asDict().items() if k != "p"} for r in grouped.collect()}}


def scan_project(spark: SparkSession, path: str, targets: list[str], code_at: str | None = None, historical: bool = False, slug: str | None = None, cache: str | None = None, by_package: bool = False) -> dict:
    """The document of the project at ``path``. One project is small, so its document is put together on the driver.

    ``cache``: a folder for analyses of files that don't change; ``by_package``: see ``enriched``.
    """
    root = path.rstrip("/")
    config, about = load_config(root), git.describe(root)
    listed = read_files(spark, root).filter(~F.col("path").rlike("(^|/)node_modules/"))
    names = listed.select(F.lit("p").alias("project_id"), "path")
    below = (package_roots(names).first() or {"root": ""})["root"]
    package = f"{below}/package.json".lstrip("/")
    texts = {r["path"]: bytes(r["content"]).decode("utf-8", "replace") for r in listed.filter(F.col("path").isin(package, *(f"{below}/{n}".lstrip("/") for n in (".nvmrc", ".node-version")))).collect()}
    package_json = texts.get(package)
    try:
        parsed = json.loads(package_json) if package_json else None
    except ValueError:
        parsed = package_json = None

    above = [root, *(str(p) for p in _parents(root, 3))]
    nearby = _existing([f"{folder}/{name}" for folder in above for name in LOCKFILES] + [f"{root}/{below}/{n}" for n in LOCKFILES])
    folder = f"{root}/{below}".rstrip("/")
    lock = lockfiles(spark.createDataFrame([("p", folder)], "project_id string, folder string"), spark.createDataFrame([(n,) for n in nearby], "path string")).first()
    content = spark.createDataFrame([("p", lock["file"], open(lock["path"], errors="replace").read() if not lock["file"].startswith("bun") else "")] if lock else [], "project_id string, file string, content string")
    versions = resolved_versions(content).drop("project_id").cache()

    one = spark.createDataFrame([("p", package_json)], "project_id string, packageJson string")
    entries = declared(one).drop("project_id")
    known = one.select(known_packages(F.col("packageJson")).alias("k")).first()["k"] or []
    deps = dependency_entries(entries, versions).collect()
    tools = spark.createDataFrame(
        [("p", package_json, [r["path"][len(below) :].lstrip("/") for r in names.select("path").collect() if r["path"].startswith(below)], [lock["file"]] if lock else [], {d["name"]: d["version_range"] for d in reversed(deps)}, texts.get(f"{below}/.nvmrc".lstrip("/")), texts.get(f"{below}/.node-version".lstrip("/")))],
        "project_id string, packageJson string, files array<string>, lock_files array<string>, deps map<string,string>, nvmrc string, node_version_file string",
    )
    sources = listed.filter(is_source(F.col("path"), config)).withColumn("path", F.concat(F.lit(root + "/"), "path"))
    analyses, hits = analysed(sources, targets, known, root, cache)
    files = enriched(analyses, versions, by_package).cache()
    name = (parsed or {}).get("name") if isinstance(parsed, dict) else None
    own_slug = one.select(project_slug(F.lit(about["repoUrl"]).cast("string"), F.lit(name).cast("string"), F.lit(root)).alias("s")).first()["s"]
    if about["repoUrl"] and about["subpath"]:
        own_slug = f"{own_slug}/{about['subpath']}"
    order = {s: i for i, s in enumerate(("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))}
    document = {
        "id": about["commitSha"] or str(uuid.uuid4()), "schemaVersion": SCHEMA_VERSION, "projectPath": root, "projectName": name or root.rsplit("/", 1)[-1], "projectSlug": slug or own_slug,
        "scannedAt": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z", "repoUrl": about["repoUrl"], "branch": about["branch"], "commitSha": about["commitSha"],
        "packageJson": parsed, "targetPackages": targets, "internalPackages": [], "files": [json.loads(j) for j in files.toJSON().collect()], "summary": summary(files),
        "meta": {
            "packageName": name or "", "packageVersion": (parsed or {}).get("version", "") if isinstance(parsed, dict) else "",
            "dependencies": [
                {"name": d["name"], "versionRange": d["version_range"], "section": d["section"], "versionResolved": d["version_resolved"], "versionMajor": d["version_major"], "versionMinor": d["version_minor"], "versionPatch": d["version_patch"], "versionPrerelease": d["version_prerelease"], "versionIsPrerelease": d["version_is_prerelease"]}
                for d in sorted(deps, key=lambda d: order[d["section"]])
            ],
            "tooling": tooling(tools).select("tooling").first()["tooling"].asDict(),
        },
        "cacheHits": hits, "codeAt": code_at or about["codeAt"], "isHistoricalScan": historical,
    }
    document["fileCount"] = len(document["files"])
    versions.unpersist()
    files.unpersist()
    return document


def _parents(path: str, n: int) -> list:
    from pathlib import Path

    return list(Path(path).resolve().parents)[:n]


def _existing(paths: list[str]) -> list[str]:
    from os.path import exists

    return list(dict.fromkeys(p for p in paths if exists(p)))


def scan(spark: SparkSession, path: str, store: str, targets: list[str], force: bool = False, since: str | None = None, until: str | None = None, interval: str | None = None, cache: str | None = None) -> list[str]:
    """Scans a project, or its history from ``since`` on, and gives the ids of the documents it stored.

    A commit that is stored already is passed over unless ``force``. ``interval`` keeps the last commit of each span.
    """
    if interval and not since:
        raise ValueError("an interval needs a start (since)")
    about = git.describe(path)
    now = datetime.now(timezone.utc)
    if not since:
        slug = None
        if about["commitSha"] and not force:
            slug = scan_slug(spark, path, about)
            if ScanStore(spark, store, slug).has(about["commitSha"]):
                return []
        document = scan_project(spark, path, targets, slug=slug, cache=cache)
        ScanStore(spark, store, document["projectSlug"]).save(document)
        return [document["id"]]

    start, end = resolve(parse_period(since), now), resolve(parse_period(until), now) if until else now
    commits = git.commit_frame(spark, git.commits_between(path, start, end))
    sampled = checkpoint_sample(commits, "epoch_ms", interval_ms(interval), (), "sha") if interval else commits
    before = git.commit_up_to(path, start)
    everything = commits.unionByName(git.commit_frame(spark, [before] if before else [])).distinct()
    plan = with_baseline(sampled, everything, int(start.timestamp() * 1000)).orderBy(F.desc("code_at_ms")).collect()
    slug, done = scan_slug(spark, path, about), []
    kept = ScanStore(spark, store, slug)
    for n, commit in enumerate(plan):
        if kept.has(commit["sha"]) and not force:
            continue
        with git.worktree(path, commit["sha"]) as tree:
            at = datetime.fromtimestamp(commit["code_at_ms"] / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            document = scan_project(spark, tree, targets, at, True, slug) | {"id": commit["sha"], "commitSha": commit["sha"], "projectPath": path, "repoUrl": about["repoUrl"]}
        kept.save(document, latest=n == 0)
        done.append(commit["sha"])
    return done


def scan_slug(spark: SparkSession, path: str, about: dict) -> str:
    from pathlib import Path

    at = Path(path, "package.json")
    try:
        name = json.loads(at.read_text()).get("name") if at.exists() else None
    except ValueError:
        name = None
    base = spark.range(1).select(project_slug(F.lit(about["repoUrl"]).cast("string"), F.lit(name).cast("string"), F.lit(path)).alias("s")).first()["s"]
    return f"{base}/{about['subpath']}" if about["repoUrl"] and about["subpath"] else base
