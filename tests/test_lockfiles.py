import json

import pytest
from pyspark.sql import functions as F

from larkspur.extract.lockfiles import resolved, resolved_versions
from larkspur.functions.text import semver

PNPM6 = """lockfileVersion: '6.0'
importers:
  .:
    dependencies:
      react:
        specifier: ^18.0.0
        version: 18.2.0(@types/react@18)(x@1)
      '@s/x':
        specifier: 1
        version: 1.0.0-beta.2
    devDependencies:
      jest:
        specifier: 29
        version: 29.1.0
    optionalDependencies:
      no:
        specifier: 1
        version: 1.0.0
  packages/a:
    dependencies:
      vue:
        specifier: 3
        version: 3.0.0
packages:
  /react@18.2.0:
    dependencies:
      loose: 1.1.0
"""
PNPM5 = "lockfileVersion: 5.4\ndependencies:\n  react: 17.0.2\n  '@s/x': 1.2.3(y@1)\ndevDependencies:\n  jest: 27.0.0\npackages:\n  /react/17.0.2:\n    dev: false\n"
YARN1 = '# yarn lockfile v1\n\n"@t/r@^18", "@t/r@^18.2":\n  version "18.0.1"\n  resolved "x"\n\na@^1, b@npm:b@^2:\n  version "1.5.0"\n\na@^2:\n  version "2.0.0"'
BERRY = '__metadata:\n  version: 6\n\n"a@npm:^1, a@npm:^1.2":\n  version: 1.2.3\n  dependencies:\n    b: ^2\n\n"c@patch:c@npm:1#x":\n  version: 3.0.0\n'


@pytest.mark.parametrize(
    ("file", "content", "expected"),
    [
        ("package-lock.json", json.dumps({"lockfileVersion": 3, "packages": {"": {"version": "9"}, "node_modules/a": {"version": "1.0.0"}, "node_modules/@s/b": {"version": "2.0.0"}, "node_modules/a/node_modules/c": {"version": "3.0.0"}}}), {"a": "1.0.0", "@s/b": "2.0.0"}),
        ("package-lock.json", json.dumps({"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "1.1.0"}}}, "b": {"version": "2.0.0"}}}), {"a": "1.0.0", "b": "1.1.0"}),
        ("package-lock.json", "{ no", {}),
        ("package-lock.json", "[]", {}),
        ("pnpm-lock.yaml", PNPM6, {"react": "18.2.0", "@s/x": "1.0.0-beta.2", "jest": "29.1.0"}),
        ("pnpm-lock.yaml", PNPM5, {"react": "17.0.2", "@s/x": "1.2.3", "jest": "27.0.0"}),
        ("pnpm-lock.yaml", "importers:\n  .:\n    dependencies:\n      a: 1.0.0\n", {"a": "1.0.0"}),
        ("pnpm-lock.yaml", "  \n", {}),
        ("yarn.lock", YARN1, {"@t/r": "18.0.1", "a": "1.5.0", "b": "1.5.0"}),
        ("yarn.lock", BERRY, {"a": "1.2.3", "c": "3.0.0"}),
        ("bun.lock", "x", {}),
        ("yarn.lock", None, {}),
    ],
)
def test_dialects(file, content, expected):
    assert resolved(file, content) == expected


def test_other_importers_on_demand():
    from larkspur.extract.lockfiles import pnpm

    assert dict(pnpm(PNPM6, importers=("packages/a",))) == {"vue": "3.0.0"}


def test_rows(spark):
    df = spark.createDataFrame([("p", "pnpm-lock.yaml", PNPM6), ("q", "yarn.lock", YARN1)], "project_id string, file string, content string")
    got = {(r.project_id, r.name): (r.version_major, r.version_minor, r.version_patch, r.version_prerelease, r.version_is_prerelease) for r in resolved_versions(df).collect()}
    assert got[("p", "@s/x")] == (1, 0, 0, "beta.2", True)
    assert got[("q", "a")] == (1, 5, 0, None, False)


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("1.2.3", (1, 2, 3, None, False)), ("1.2.3-beta.1", (1, 2, 3, "beta.1", True)), ("1.2.3-a-b.c+x.y", (1, 2, 3, "a-b.c", True)), ("1.2.3+b", (1, 2, 3, None, False)),
        ("link:../x", (0, 0, 0, None, False)), ("1.2", (0, 0, 0, None, False)), ("", (0, 0, 0, None, False)), (None, (None, None, None, None, None)), ("99999999999.1.1", (0, 1, 1, None, False)),
    ],
)
def test_semver(spark, text, parts):
    row = spark.createDataFrame([(text,)], "v string").select(*[c.alias(n) for n, c in semver(F.col("v")).items()]).first()
    assert tuple(row) == parts
