"""Resolved versions in lockfiles: npm v1-v3, pnpm v5-v9, yarn classic and berry.

Each dialect is a generator of (name, version) in file order; the first of a name counts. Text that doesn't parse
gives nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import semver

#: File names, in order of precedence (fixed values). bun's are known, but not read.
FILES = ("pnpm-lock.yaml", "bun.lockb", "bun.lock", "yarn.lock", "package-lock.json")
SECTIONS = ("dependencies", "devDependencies")
QUOTES = "'\""


def npm(content: str) -> Iterator[tuple[str, str]]:
    lock = json.loads(content)
    if not isinstance(lock, dict):
        return
    number = lock.get("lockfileVersion", 1)
    if isinstance(number, (int, float)) and number >= 2:
        for path, entry in (lock.get("packages") or {}).items():
            if found := re.fullmatch(r"node_modules/((?:(?!/node_modules/).)+)", path):
                yield found[1], entry.get("version")
        return
    yield from _nested(lock.get("dependencies"))


def _nested(deps: object) -> Iterator[tuple[str, str]]:
    """Each package, then at once those below it."""
    for name, entry in deps.items() if isinstance(deps, dict) else ():
        yield name, entry.get("version")
        yield from _nested(entry.get("dependencies"))


def indented(content: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(keys from the outermost, value) of each line of nested ``key: value`` lines."""
    path: list[tuple[int, str]] = []
    for line in content.split("\n"):
        body = line.strip()
        if not body or body.startswith("#") or ":" not in body:
            continue
        indent = len(line) - len(line.lstrip(" "))
        if body[0] in QUOTES and body.find(body[0], 1) > 0:
            end = body.find(body[0], 1)
            key, value = body[1:end], body[end + 1 :].partition(":")[2]
        else:
            key, _, value = body.partition(":")
        path = [p for p in path if p[0] < indent] + [(indent, key.strip(QUOTES))]
        yield tuple(k for _, k in path), value.strip()


def pnpm(content: str, importers: tuple[str, ...] = (".",)) -> Iterator[tuple[str, str]]:
    """Versions without their peer suffix; of workspaces, only those in ``importers``."""
    lines = list(indented(content))
    nested = any(keys == ("importers",) and not value for keys, value in lines)
    for keys, value in lines:
        if nested:
            if keys[0] != "importers" or len(keys) < 4 or keys[1] not in importers:
                continue
            keys = keys[2:]
        if keys[0] in SECTIONS and (len(keys) == 2 and value or len(keys) == 3 and nested and keys[2] == "version"):
            yield keys[1], value.partition("(")[0].strip(QUOTES)


def specifier_name(specifier: str) -> str | None:
    """The package of ``name@range``; the range begins at the first @ after a scope's slash."""
    found = re.match(r"(@[^/]+/[^@]+|[^@]+)@", specifier.strip().strip(QUOTES))
    return found[1] if found else None


def yarn(content: str, version: str = r'\s+version\s+"([^"]+)"') -> Iterator[tuple[str, str]]:
    """Each entry's names get its version; an entry ends at a blank line or the next header."""
    names: list[str] = []
    for line in content.split("\n"):
        if line.startswith("#"):
            continue
        if not line.strip():
            names = []
        elif line[0] not in " \t" and line.rstrip().endswith(":"):
            specifiers = line.strip()[:-1].strip(QUOTES).split(", ")
            names = [n for n in dict.fromkeys(map(specifier_name, specifiers)) if n]
        elif names and (found := re.match(version, line)):
            yield from ((n, found[1].strip()) for n in names)
            names = []


def berry(content: str) -> Iterator[tuple[str, str]]:
    return yarn(content, r"\s+version:\s+(.+)")


def resolved(file: str, content: str | None, importers: tuple[str, ...] = (".",)) -> dict[str, str]:
    """name → version of a lockfile by its file name."""
    name, out = file.rsplit("/", 1)[-1], {}
    if not content or not content.strip():
        return out
    if name == "pnpm-lock.yaml":
        found = pnpm(content, importers)
    elif name == "yarn.lock":
        found = berry(content) if "__metadata:" in content else yarn(content)
    elif name == "package-lock.json":
        found = npm(content)
    else:
        return out
    try:
        for package, version in found:
            if isinstance(version, str) and version:
                out.setdefault(package, version)
    except (ValueError, AttributeError, TypeError):
        return out
    return out


def resolved_versions(files: DataFrame, key: str = "project_id", file: str = "file", content: str = "content") -> DataFrame:
    """key, name, version_resolved, version_major/minor/patch, version_prerelease, version_is_prerelease of each lockfile row."""

    def rows(batches):
        for batch in batches:
            made = [(k, n, v) for k, f, c in zip(batch["k"], batch["f"], batch["c"], strict=True) for n, v in resolved(f, c).items()]
            yield pd.DataFrame(made, columns=["k", "name", "version_resolved"])

    kind = files.schema[key].dataType.simpleString()
    found = files.select(F.col(key).alias("k"), F.col(file).alias("f"), F.col(content).alias("c")).mapInPandas(rows, f"k {kind}, name string, version_resolved string")
    return found.select(F.col("k").alias(key), "name", "version_resolved", *[c.alias(f"version_{n}") for n, c in semver(F.col("version_resolved")).items()])
