"""Tools of a project, told by its files and declared dependencies; all in DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
WEBPACK = r"^(?:(?!node_modules/)[^/]+/){0,2}webpack\.config(?:\.[^/]+)?\.(?:js|ts|mjs|cjs)$"


def _names(stem: str, *endings: str) -> tuple[str, ...]:
    return tuple(f"{stem}.{e}" for e in endings)


# Fixed values: (tool, files that show it, dependencies that show it), the first that holds counts.
RULES: dict[str, tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]] = {
    "packageManager": (
        ("pnpm", ("pnpm-lock.yaml",), ()),
        ("bun", ("bun.lockb", "bun.lock"), ()),
        ("yarn", ("yarn.lock",), ()),
        ("npm", ("package-lock.json",), ()),
    ),
    "buildTool": (
        ("vite", _names("vite.config", "js", "ts", "mjs"), ()),
        ("webpack", (f"~{WEBPACK}",), ()),
        ("esbuild", _names("esbuild.config", "js", "ts"), ("esbuild",)),
        ("rollup", _names("rollup.config", "js", "ts", "mjs"), ()),
    ),
    "testFramework": (
        ("vitest", (), ("vitest",)),
        ("jest", (), ("jest", "@jest/core")),
        ("mocha", (), ("mocha",)),
        ("jasmine", (), ("jasmine",)),
    ),
    "linter": (
        ("eslint", (*_names("eslint.config", "js", "ts", "mjs"), ".eslintrc", *_names(".eslintrc", "json", "js", "yml", "yaml")), ()),
        ("biome", ("biome.json",), ("@biomejs/biome",)),
        ("oxlint", (), ("oxlint",)),
    ),
    "formatter": (
        ("prettier", (".prettierrc", *_names(".prettierrc", "json", "yml", "yaml", "js"), *_names("prettier.config", "js", "ts")), ("prettier",)),
        ("biome", ("biome.json",), ("@biomejs/biome",)),
    ),
    "cssApproach": (
        ("tailwind", _names("tailwind.config", "js", "ts", "mjs", "cjs"), ("tailwindcss",)),
        ("styled-components", (), ("styled-components",)),
        ("emotion", (), ("@emotion/react", "@emotion/styled")),
    ),
    "framework": (
        ("next", _names("next.config", "js", "ts", "mjs", "cjs"), ("next",)),
        ("nuxt", _names("nuxt.config", "js", "ts", "mjs"), ("nuxt",)),
        ("react", (), ("react",)),
        ("vue", (), ("vue",)),
        ("angular", (), ("@angular/core",)),
        ("svelte", (), ("svelte",)),
    ),
}
#: The dependency whose range is a framework's version (fixed values).
FRAMEWORK_PACKAGE = {"angular": "@angular/core"}


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _matches(pattern: str):
    return lambda file: file.rlike(pattern)


def choose(field: str, files: Column, deps: Column) -> Column:
    """The first tool of ``RULES`` that a project's files or dependencies show; null if none."""
    cases = []
    for tool, shown_by, named in RULES[field]:
        hits = [F.exists(files, _matches(p[1:])) if p.startswith("~") else F.array_contains(files, p) for p in shown_by]
        cases.append(F.when(any_of([*hits, *[F.map_contains_key(deps, d) for d in named]]), tool))
    return F.coalesce(*cases)


def declared(package_json: DataFrame, key: str = "project_id", text: str = "packageJson") -> DataFrame:
    """key, name, version_range, section of each dependency of a package.json text; nothing where it doesn't parse."""
    block = lambda s: F.from_json(F.get_json_object(F.col(text), f"$.{s}"), "map<string,string>")
    none = F.array().cast("array<struct<key:string,value:string>>")

    def listed_in(section: str) -> Column:
        return F.transform(F.coalesce(F.map_entries(block(section)), none), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version_range"), F.lit(section).alias("section")))

    listed = F.concat(*map(listed_in, SECTIONS))
    return package_json.select(key, F.inline(listed))


def known_packages(package_json: Column) -> Column:
    """Names under dependencies and devDependencies."""
    keys = lambda s: F.coalesce(F.map_keys(F.from_json(F.get_json_object(package_json, f"$.{s}"), "map<string,string>")), F.array().cast("array<string>"))
    return F.array_union(keys("dependencies"), keys("devDependencies"))


def tooling(projects: DataFrame, files: str = "files", lock_files: str = "lock_files", deps: str = "deps", package_json: str = "packageJson") -> DataFrame:
    """``projects`` with struct ``tooling``. files, lock_files: paths relative to the project and beside its lockfile; deps: name → range.

    Optional columns nvmrc and node_version_file hold the text of these files.
    """
    f, d = F.col(files), F.col(deps)
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in projects.columns else F.lit(None).cast("string")
    has = lambda c: F.col(c).isNotNull() if c in projects.columns else F.lit(False)
    framework = choose("framework", f, d)
    package = reduce(lambda c, kv: F.when(framework == kv[0], kv[1]).otherwise(c), FRAMEWORK_PACKAGE.items(), framework)
    typed = F.array_contains(f, "tsconfig.json") | F.map_contains_key(d, "typescript")
    node = F.when(has("nvmrc"), text("nvmrc")).when(has("node_version_file"), text("node_version_file")).otherwise(F.get_json_object(F.col(package_json), "$.engines.node"))
    none = F.lit(None).cast("string")
    made = {
        "packageManager": choose("packageManager", F.col(lock_files), d), "packageManagerVersion": none, "buildTool": choose("buildTool", f, d), "testFramework": choose("testFramework", f, d),
        "bundler": none, "linter": choose("linter", f, d), "formatter": choose("formatter", f, d), "cssApproach": choose("cssApproach", f, d), "typescript": F.when(typed, True),
        "typescriptVersion": F.when(typed, F.try_element_at(d, F.lit("typescript"))), "nodeVersion": node, "framework": framework, "frameworkVersion": F.try_element_at(d, package),
    }
    return projects.withColumn("tooling", F.struct(*[c.alias(n) for n, c in made.items()]))
