"""A project's files: which of them are sources, and where its package and lockfile are."""

from __future__ import annotations

import json
import re
import warnings
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.extract.lockfiles import FILES as LOCKFILES

CONFIG_NAMES = ("larkspur.config.json", ".larkspurrc", ".larkspurrc.json")
#: What counts as source unless a project says otherwise.
DEFAULTS = {
    "include": ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mjs", "**/*.cjs"],
    "exclude": ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/*.d.ts", "**/*.test.*", "**/*.spec.*", "**/coverage/**", "**/.next/**", "**/.nuxt/**"],
}


def load_config(project: str) -> dict[str, list[str]]:
    """The first config file that parses, over the defaults; a warning for each that doesn't."""
    for name in CONFIG_NAMES:
        at = Path(project, name)
        if at.exists():
            try:
                own = json.loads(at.read_text())
                return {k: own.get(k) or v for k, v in DEFAULTS.items()}
            except (ValueError, AttributeError) as e:
                warnings.warn(f"{at} doesn't parse, so the next config or the defaults hold: {e}", stacklevel=2)
    return {k: list(v) for k, v in DEFAULTS.items()}


def write_default_config(project: str) -> str:
    at = Path(project, CONFIG_NAMES[0])
    at.write_text(json.dumps(DEFAULTS, indent=2) + "\n")
    return str(at)


def glob_regex(pattern: str) -> str:
    """A regular expression of a glob: ** crosses folders, * and ? don't, {a,b} chooses."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = pattern[i]
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def is_source(path: Column, config: dict[str, list[str]]) -> Column:
    """Whether a path relative to its project is to be read."""
    any_of = lambda globs: path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)
    return any_of(config["include"]) & ~any_of(config["exclude"])


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to ``root``), content (bytes), modified, size of every file below ``root``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file://").rstrip("/")
    plain = F.regexp_replace("path", "^[a-z]+:(//[^/]*(?=/))?", "")
    relative = F.substring(plain, F.lit(len(base) + 2), F.length("path"))
    return df.select(relative.alias("path"), "content", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def package_roots(files: DataFrame) -> DataFrame:
    """project_id, root: the folder with the package file — its own, else the only child that has one, else its own again.

    files: (project_id, path).
    """
    own = F.max(F.col("path") == "package.json")
    child = F.regexp_extract("path", r"^([^/]+)/package\.json$", 1)
    found = files.groupBy("project_id").agg(own.alias("own"), F.collect_set(F.nullif(child, F.lit(""))).alias("children"))
    return found.select("project_id", F.when(~F.col("own") & (F.size("children") == 1), F.col("children")[0]).otherwise("").alias("root"))


def lockfiles(folders: DataFrame, files: DataFrame, levels: int = 4) -> DataFrame:
    """project_id, folder, file: the nearest folder with a lockfile, at most ``levels`` up, and of its lockfiles the first by precedence.

    folders: (project_id, folder) absolute; files: (path) absolute.
    """
    names = F.array(*[F.lit(n) for n in LOCKFILES])
    locks = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("at"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("path").alias("lock_path"))
    locks = locks.filter(F.array_contains(names, F.col("file"))).withColumn("precedence", F.array_position(names, F.col("file")))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.least(F.lit(levels - 1), F.size(parts) - 2)), lambda up: F.struct(up.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - up), "/").alias("at")))
    asked = folders.filter(F.size(parts) >= 2).select("project_id", F.inline(above))
    hits = asked.join(locks, "at")
    best = hits.groupBy("project_id").agg(F.min(F.struct("up", "precedence", "at", "file", "lock_path")).alias("b"))
    return best.select("project_id", F.col("b.at").alias("folder"), F.col("b.file").alias("file"), F.col("b.lock_path").alias("path"))


def to_analyse(files: DataFrame, cache: DataFrame, targets: list[str], version: int) -> tuple[DataFrame, DataFrame]:
    """(files to read again, cached analyses that still hold). A hit has the same path, time and size, targets and version."""
    wanted = F.array_sort(F.array(*[F.lit(t) for t in targets])) if targets else F.array().cast("array<string>")
    valid = cache.filter((F.col("version") == version) & (F.array_sort("targets") == wanted))
    keys = ["path", "modified", "size"]
    return files.join(valid.select(*keys), keys, "left_anti"), valid.join(files.select(*keys), keys, "left_semi")
