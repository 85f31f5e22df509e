"""From documents and projects to answers."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from larkspur.extract.tooling import declared, known_packages, tooling
from larkspur.functions import text as fn
from larkspur.plans import dashboard, tools
from larkspur.plans.build import build, calls_with_args
from larkspur.plans.scan import scan, scan_project
from larkspur.sources.project_files import glob_regex, load_config, lockfiles, package_roots, to_analyse, write_default_config
from larkspur.sources.scan_store import ScanStore, read_scans
from larkspur.sources.tables import NotBuilt, Tables, read_or_empty, require
from larkspur.streaming.incremental import follow, followed_tables


def document(slug, scan_id, at, code_at=None, version="1.2.3", **more):
    v = {"packageVersionResolved": version, "packageVersionMajor": 1, "packageVersionMinor": 2, "packageVersionPatch": 3, "packageVersionPrerelease": None, "packageVersionIsPrerelease": None}
    use = {"file": "/x/a.tsx", "line": 3, "column": 1, "componentName": "Button", "importedFrom": "@acme/ui", "selfClosing": True, **v, "props": [
        {"name": "size", "value": 3, "isDynamic": False, "sourceSnippet": None}, {"name": "on", "value": "[f]", "isDynamic": True, "sourceSnippet": "a\n<Button on={f}/>"}, {"name": "off", "value": True, "isDynamic": False}]}
    call = {"file": "/x/a.tsx", "line": 4, "column": 1, "functionName": "format", "importedFrom": "@acme/utils", **v, "args": [{"index": 0, "type": "string", "value": "d", "isSpread": False}, {"index": 1, "type": "object", "isSpread": False, "sourceSnippet": "format('d', {})"}]}
    bare = {**call, "line": 5, "args": []}
    return {
        "id": scan_id, "schemaVersion": 1, "projectPath": "/x", "projectName": slug, "projectSlug": slug, "scannedAt": at, "repoUrl": None, "branch": "main", "commitSha": scan_id, "packageJson": {"name": slug}, "targetPackages": [], "internalPackages": ["@int/", "exact"],
        "fileCount": 1, "files": [{"filePath": "/x/a.tsx", "relativePath": "a.tsx", "imports": [], "componentUsages": [use], "functionCalls": [call, bare], "errors": []}], "codeAt": code_at,
        "meta": {"packageName": slug, "packageVersion": "1", "dependencies": [{"name": n, "versionRange": "^1", "section": "dependencies", "versionResolved": "1.2.3", "versionMajor": 1, "versionMinor": 2, "versionPatch": 3, "versionPrerelease": None, "versionIsPrerelease": False} for n in ("@acme/ui", "@int/x", "exact")], "tooling": {"buildTool": "vite", "typescript": True}},
        **more,
    }


@pytest.fixture
def store(spark, tmp_path):
    root = tmp_path / "store"
    docs = [
        document("a", "s1", "2024-01-01T00:00:00Z"), document("a", "s2", "2024-03-01T00:00:00Z", "2024-02-01T02:00:00+05:00"), document("a", "s3", "2024-03-02T00:00:00Z", "2024-01-31T23:00:00Z"),
        document("b", "s1", "2024-02-01T00:00:00Z"), {k: v for k, v in document("c", "s9", "2024-02-01T00:00:00Z").items() if k not in ("meta", "schemaVersion", "codeAt", "projectSlug")},
    ]
    for d in docs:
        at = root / (d.get("projectSlug") or "c") / "scans"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{d['id']}.json").write_text(json.dumps(d, indent=2))
    (root / "a" / "scans" / "bad.json").write_text("{ nope")
    (root / "a" / "latest.json").write_text(json.dumps(docs[0]))
    (root / "a" / "file-cache.json").write_text("{}")
    (root / "built" / "scans").mkdir(parents=True)
    (root / "built" / "scans" / "x.json").write_text(json.dumps(docs[0]))
    return str(root)


def test_build_and_ask(spark, store, tmp_path):
    warehouse = str(tmp_path / "tables")
    report = build(spark, store, warehouse)
    assert report.skipped == 1
    assert report.rows == {"project_snapshots": 5, "dependencies": 12, "component_usages": 5, "component_prop_usages": 15, "function_usages": 10, "function_arg_usages": 10}
    t = Tables.read(spark, warehouse)
    # instants decide, not strings: s3's code is later than s2's
    assert {(r.project_id, r.commit_sha) for r in t.latest("project_snapshots").collect()} == {("a", "s3"), ("b", "s1"), ("c", "s9")}
    assert t.project_snapshots.filter("project_id = 'c'").first().schema_version == 0
    props = {r.prop_name: (r.value_type, r.value) for r in t.latest("component_prop_usages").filter("project_id = 'a'").collect()}
    assert props == {"size": ("static", "3"), "on": ("dynamic", None), "off": ("static", "true")}
    assert {r.package_name for r in t.latest("dependencies").filter("is_internal").collect()} == {"@int/x", "exact"}
    calls = tools.call(t, "query_export_usage", {"package_name": "@acme/utils", "export_name": "format"}).collect()
    assert [(c.project_id, c.line, c.arg_index) for c in calls if c.project_id == "a"] == [("a", 4, 0), ("a", 4, 1), ("a", 5, None)]
    assert tools.call(t, "get_source_context", {"project_id": "a", "file_path": "a.tsx", "line": 3, "prop_name": "on"}).first().value_type == "dynamic"
    assert tools.get_scan_metadata(t, "2024-03-05").first().stale_project_count == 3
    assert tools.get_scan_metadata(t, "2024-03-05", latest_only=True).first().stale_project_count == 2
    assert json.loads(tools.to_json(tools.list_projects(t, as_of="2024-03-05"))[0])["project_id"] == "a"
    with pytest.raises(tools.UnknownTool):
        tools.call(t, "nothing")
    with pytest.raises(ValueError, match="prop_name"):
        tools.get_source_context(t, "a", "a.tsx", 3)
    with pytest.raises(ValueError, match="one of"):
        tools.query_tooling_distribution(t, "repo_url")


def test_own_arguments_do_not_mix(spark, store):
    scans, _ = read_scans(spark, store)
    rows = calls_with_args(scans).filter("is_latest AND project_id = 'a'").collect()
    assert sorted((r.line, r.arg_index if r.arg_index is not None else -1) for r in rows) == [(4, 0), (4, 1), (5, -1)]


def test_document_totals(spark, store):
    scans, _ = read_scans(spark, store)
    assert tuple(dashboard.document_totals(scans).first()) == (0, 0, 0, 0)
    counted = scans.limit(1).withColumn("summary", F.struct(*[F.lit(n).alias(c) for n, c in enumerate(("totalFilesScanned", "filesWithErrors", "totalComponentUsages", "totalFunctionCalls"), 1)]))
    assert tuple(dashboard.document_totals(counted).first()) == (1, 2, 3, 4)


def test_missing_tables(spark, tmp_path):
    with pytest.raises(NotBuilt):
        require(spark, str(tmp_path), "dependencies")
    assert read_or_empty(spark, str(tmp_path), "dependencies").count() == 0


def test_old_tables_get_their_missing_columns(spark, tmp_path):
    spark.createDataFrame([("p", True)], "project_id string, is_latest boolean").write.parquet(f"{tmp_path}/project_snapshots")
    assert require(spark, str(tmp_path), "project_snapshots").first().code_at is None


def test_empty_store(spark, tmp_path):
    report = build(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    assert set(report.rows.values()) == {0}


def test_stream_builds_the_same(spark, store, tmp_path):
    warehouse, mark = str(tmp_path / "live"), str(tmp_path / "mark")
    follow(spark, store, warehouse, mark).awaitTermination()
    first = followed_tables(spark, warehouse)
    assert {(r.project_id, r.commit_sha) for r in first.latest("project_snapshots").collect()} == {("a", "s3"), ("b", "s1"), ("c", "s9")}
    ScanStore(spark, store, "b").save(document("b", "s0", "2024-01-05T00:00:00Z"))
    ScanStore(spark, store, "b").save(document("b", "s7", "2024-05-05T00:00:00Z"))
    follow(spark, store, warehouse, mark).awaitTermination()
    t = followed_tables(spark, warehouse)
    assert t.project_snapshots.count() == 7
    assert {r.commit_sha for r in t.latest("project_snapshots").filter("project_id = 'b'").collect()} == {"s7"}
    assert t.latest("component_usages").count() == 3


def test_store(spark, tmp_path):
    kept = ScanStore(spark, str(tmp_path), "host/org/repo")
    assert kept.load_latest() is None and kept.list() == []
    kept.save(document("a", "s1", "2024-01-01T00:00:00Z"))
    kept.save(document("a", "s2", "2024-01-01T00:00:00Z"), latest=False)
    assert kept.list() == ["s1", "s2"] and kept.load_latest()["id"] == "s1" and kept.load("s2")["id"] == "s2" and kept.load("s3") is None and kept.has("s1")


@pytest.mark.parametrize(
    ("url", "slug"),
    [
        ("https://github.com/a/b.git", "github.com/a/b"), ("https://u:p@host/a/b/c", "host/a/b/c"), ("ssh://git@host:22/a/b.git", "host/a/b"), ("git@github.com:a/b.git", "github.com/a/b"), ("nonsense", None), ("", None), (None, None),
    ],
)
def test_remote_slug(spark, url, slug):
    assert spark.createDataFrame([(url,)], "u string").select(fn.remote_slug(F.col("u"))).first()[0] == slug


def test_small_functions(spark):
    row = spark.range(1).select(
        fn.project_slug(F.lit(None).cast("string"), F.lit("  "), F.lit("/x/y/")).alias("a"), fn.project_slug(F.lit("x"), F.lit(" n "), F.lit("/y")).alias("b"),
        fn.source_link(F.lit("github.com/o/r/sub"), F.lit("main"), F.lit("a.ts"), F.lit(3)).alias("c"), fn.source_link(F.lit("host/o/r"), F.lit("main"), F.lit("a.ts"), F.lit(3)).alias("d"),
        fn.arg_index(F.lit("Arg 12")).alias("e"), fn.arg_index(F.lit("All")).alias("f"), fn.package_of(F.lit("@a/b/c")).alias("g"), fn.indentation(F.lit("  x")).alias("h"),
    ).first()
    assert tuple(row) == ("y", "n", "https://github.com/o/r/blob/main/sub/a.ts#L3", None, 12, None, "@a/b", 2)


@pytest.mark.parametrize(
    ("files", "locks", "deps", "field", "value"),
    [
        ([], ["pnpm-lock.yaml", "yarn.lock"], {}, "packageManager", "pnpm"), ([], ["bun.lock", "yarn.lock"], {}, "packageManager", "bun"), ([], [], {}, "packageManager", None),
        (["vite.config.ts", "webpack.config.js"], [], {}, "buildTool", "vite"), (["web/webpack.config.prod.js"], [], {}, "buildTool", "webpack"), (["a/b/c/webpack.config.js"], [], {}, "buildTool", None), ([], [], {"esbuild": "1"}, "buildTool", "esbuild"),
        ([], [], {"vitest": "1", "jest": "1"}, "testFramework", "vitest"), (["biome.json"], [], {}, "linter", "biome"), ([".eslintrc.json", "biome.json"], [], {}, "linter", "eslint"), ([], [], {"prettier": "3"}, "formatter", "prettier"),
        ([], [], {"@emotion/styled": "1"}, "cssApproach", "emotion"), (["tsconfig.json"], [], {}, "typescript", True), ([], [], {}, "typescript", None), ([], [], {"typescript": "^5"}, "typescriptVersion", "^5"), ([], [], {"next": "14", "react": "18"}, "frameworkVersion", "14"), ([], [], {"@angular/core": "17"}, "frameworkVersion", "17"),
    ],
)
def test_tooling(spark, files, locks, deps, field, value):
    df = spark.createDataFrame([("p", files, locks, deps, '{"engines": {"node": ">=20"}}')], "project_id string, files array<string>, lock_files array<string>, deps map<string,string>, packageJson string")
    got = tooling(df).select("tooling.*").first()
    assert got[field] == value and got["nodeVersion"] == ">=20"


def test_declared(spark):
    df = spark.createDataFrame([("p", '{"dependencies": {"a": "1"}, "peerDependencies": {"b": "2"}}'), ("q", "{"), ("r", None)], "project_id string, packageJson string")
    assert {tuple(r) for r in declared(df).collect()} == {("p", "a", "1", "dependencies"), ("p", "b", "2", "peerDependencies")}
    assert [r[0] for r in df.select(known_packages(F.col("packageJson"))).collect()] == [["a"], [], []]


def test_globs_and_config(tmp_path):
    import re

    assert re.match(glob_regex("**/*.ts"), "a/b.ts") and re.match(glob_regex("**/*.ts"), "b.ts") and not re.match(glob_regex("*.ts"), "a/b.ts")
    assert re.match(glob_regex("**/node_modules/**"), "x/node_modules/y/z.ts") and re.match(glob_regex("*.{js,ts}"), "a.js")
    (tmp_path / ".larkspurrc").write_text('{"include": ["lib/**"]}')
    assert load_config(str(tmp_path))["include"] == ["lib/**"]
    (tmp_path / "larkspur.config.json").write_text("{")
    with pytest.warns(UserWarning):
        assert load_config(str(tmp_path))["include"] == ["lib/**"]
    write_default_config(str(tmp_path))
    assert "**/*.ts" in load_config(str(tmp_path))["include"]


def test_package_roots_and_lockfiles(spark):
    files = spark.createDataFrame([("a", "package.json"), ("a", "x/package.json"), ("b", "web/package.json"), ("c", "x/package.json"), ("c", "y/package.json")], "project_id string, path string")
    assert {r.project_id: r.root for r in package_roots(files).collect()} == {"a": "", "b": "web", "c": ""}
    folders = spark.createDataFrame([("p", "/r/packages/a"), ("q", "/deep/1/2/3/4/5")], "project_id string, folder string")
    locks = spark.createDataFrame([("/r/yarn.lock",), ("/r/pnpm-lock.yaml",), ("/deep/yarn.lock",)], "path string")
    assert [tuple(r) for r in lockfiles(folders, locks).collect()] == [("p", "/r", "pnpm-lock.yaml", "/r/pnpm-lock.yaml")]


def test_cache_hits(spark):
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "path string, modified int, size int")
    cache = spark.createDataFrame([("a", 1, 10, ["t"], 1), ("b", 1, 20, ["t"], 1)], "path string, modified int, size int, targets array<string>, version int")
    miss, hit = to_analyse(files, cache, ["t"], 1)
    assert [r.path for r in miss.collect()] == ["b"] and [r.path for r in hit.collect()] == ["a"]
    assert to_analyse(files, cache, [], 1)[0].count() == 2 and to_analyse(files, cache, ["t"], 2)[0].count() == 2


def git(path, *args, at="2024-01-01T00:00:00Z"):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", "-C", str(path), *args], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at, "HOME": str(path)})


def test_scan_of_a_project_and_its_history(spark, tmp_path):
    project, store = tmp_path / "web", str(tmp_path / "store")
    (project / "src").mkdir(parents=True)
    (project / "package.json").write_text(json.dumps({"name": "web", "version": "1.0.0", "dependencies": {"@acme/ui": "^1.0.0", "react": "^18"}, "devDependencies": {"vitest": "1"}}))
    (project / "yarn.lock").write_text('"@acme/ui@^1.0.0":\n  version "1.4.0"\n\nreact@^18:\n  version "18.2.0"\n')
    (project / "src" / "a.tsx").write_text("import { Button } from '@acme/ui'\nimport { Icon } from '@acme/ui/icons'\nexport default () => <Button><Icon/></Button>\n")
    (project / "src" / "b.test.tsx").write_text("import { Button } from '@acme/ui'\nx = <Button/>\n")
    git(project, "init", "-b", "main")
    git(project, "add", ".")
    git(project, "commit", "-m", "one", at="2024-01-01T00:00:00Z")
    (project / "src" / "c.ts").write_text("import { go } from '@acme/ui'\ngo(1)\n")
    git(project, "add", ".")
    git(project, "commit", "-m", "two", at="2024-03-01T00:00:00Z")
    cache = str(tmp_path / "cache")
    d = scan_project(spark, str(project), ["@acme/ui"], cache=cache)
    again = scan_project(spark, str(project), ["@acme/ui"], cache=cache)
    assert (d["cacheHits"], again["cacheHits"]) == (0, 2) and sorted(map(json.dumps, again["files"])) == sorted(map(json.dumps, d["files"]))
    assert scan_project(spark, str(project), ["other"], cache=cache)["cacheHits"] == 0
    assert d["fileCount"] == 2 and d["projectSlug"] == "web" and d["summary"]["totalComponentUsages"] == 2 and d["summary"]["totalFunctionCalls"] == 1
    uses = {u["componentName"]: u.get("packageVersionResolved") for f in d["files"] for u in f["componentUsages"]}
    assert uses == {"Button": "1.4.0", "Icon": None}
    assert d["meta"]["tooling"]["testFramework"] == "vitest" and d["meta"]["tooling"]["packageManager"] == "yarn" and d["meta"]["tooling"]["framework"] == "react"
    assert {x["name"]: x["versionResolved"] for x in d["meta"]["dependencies"]} == {"@acme/ui": "1.4.0", "react": "18.2.0", "vitest": None}
    assert len(scan(spark, str(project), store, ["@acme/ui"])) == 1 and scan(spark, str(project), store, ["@acme/ui"]) == []
    history = scan(spark, str(project), store, ["@acme/ui"], since="2024-02-01", force=True)
    assert len(history) == 2
    build(spark, store, str(tmp_path / "tables"))
    t = Tables.read(spark, str(tmp_path / "tables"))
    trend = tools.query_component_adoption_trend(t, "@acme/ui", "Button", 4, "2024-04-15").collect()
    assert [(r.period, r.adopting_projects) for r in trend] == [("2024-02-01", 1), ("2024-03-01", 1), ("2024-04-01", 1)]
