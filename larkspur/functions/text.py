"""Column functions over versions, addresses, import paths and source texts; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = r"^(\d+)\.(\d+)\.(\d+)(?:-(.+))?$"


def semver(version: Column) -> dict[str, Column]:
    """major, minor, patch, prerelease, is_prerelease. Build metadata is cut; what doesn't parse is 0.0.0; null stays null."""
    core = F.split(version, r"\+").getItem(0)
    ok = core.rlike(VERSION)
    part = lambda k: F.when(version.isNotNull(), F.coalesce(F.when(ok, F.regexp_extract(core, VERSION, k)).try_cast("int"), F.lit(0)))
    tag = F.when(ok, F.nullif(F.regexp_extract(core, VERSION, 4), F.lit("")))
    return {"major": part(1), "minor": part(2), "patch": part(3), "prerelease": tag, "is_prerelease": F.when(version.isNotNull(), tag.isNotNull())}


def remote_slug(url: Column) -> Column:
    """host/path of a git remote (https, ssh:// or scp form) without '.git'; null for anything else."""
    trimmed = F.trim(url)
    forms = (
        r"^https?://(?:[^@/]+@)?([^/]+)/(.+?)(?:\.git)?/?$",
        r"^ssh://(?:[^@/]+@)?([^/:]+)(?::\d+)?/(.+?)(?:\.git)?/?$",
        r"^(?:[^@/\s]+@)([^:/\s]+):(?!//)(.+?)(?:\.git)?/?$",
    )
    return F.coalesce(*[F.when(trimmed.rlike(f), F.concat_ws("/", F.regexp_extract(trimmed, f, 1), F.regexp_extract(trimmed, f, 2))) for f in forms])


def project_slug(url: Column, package_name: Column, path: Column) -> Column:
    """The remote's slug, else the package's name, else the folder's."""
    name = F.nullif(F.trim(package_name), F.lit(""))
    return F.coalesce(remote_slug(url), name, F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))


def package_of(source: Column) -> Column:
    """The package that an import path names: two segments under a scope, else one."""
    parts = F.split(source, "/")
    return F.when(source.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts.getItem(0))


def is_external(source: Column, known: Column | None = None) -> Column:
    """Not a path or alias; with a list of known packages that isn't empty, one of them."""
    outside = ~source.rlike(r"^(\.|/|@/|~/)")
    if known is None:
        return outside
    return outside & (F.coalesce(F.size(known) == 0, F.lit(True)) | F.array_contains(known, package_of(source)))


def in_targets(source: Column, targets: Column) -> Column:
    """No targets, or the source is a target or a path below one."""
    hit = F.exists(targets, lambda t: (source == t) | source.startswith(F.concat(t, F.lit("/"))))
    return F.coalesce(F.size(targets) == 0, F.lit(True)) | hit


def is_internal(name: Column, patterns: Column) -> Column:
    """A pattern that ends in '/' names all that begin with it, any other one name."""
    return F.coalesce(F.exists(patterns, lambda p: F.when(p.endswith("/"), name.startswith(p)).otherwise(name == p)), F.lit(False))


def line_and_column(source: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based character offset."""
    before = F.substring(source, F.lit(1), offset)
    lines = F.split(before, "\n")
    return F.size(lines), F.length(F.element_at(lines, -1)) + 1


def snippet(source: Column, line: Column, reach: int = 2) -> Column:
    """The lines around a 1-based line, ``reach`` to either side."""
    lines = F.split(source, "\n")
    first = F.greatest(F.lit(1), line - reach)
    last = F.least(F.size(lines), line + reach)
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")


def source_link(slug: Column, branch: Column, file: Column, line: Column) -> Column:
    """A page address for slugs of github.com; null for other hosts."""
    form = r"^github\.com/([^/]+)/([^/]+)(?:/(.+))?$"
    below = F.regexp_extract(slug, form, 3)
    at = F.concat(F.when(below != "", F.concat(below, F.lit("/"))).otherwise(F.lit("")), file)
    url = F.concat(F.lit("https://github.com/"), F.regexp_extract(slug, form, 1), F.lit("/"), F.regexp_extract(slug, form, 2), F.lit("/blob/"), F.coalesce(branch, F.lit("HEAD")), F.lit("/"), at)
    return F.when(slug.rlike(form), F.when(line.isNull(), url).otherwise(F.concat(url, F.lit("#L"), line.cast("string"))))


def arg_index(label: Column) -> Column:
    """The number of a label "Arg n"; null for any other."""
    return F.when(label.rlike(r"^Arg \d+$"), F.regexp_extract(label, r"^Arg (\d+)$", 1).try_cast("int"))


def value_type(kind: Column) -> Column:
    """'static' for literals, 'dynamic' for all else."""
    return F.when(kind.isin("string", "number", "boolean", "null", "undefined"), "static").otherwise("dynamic")


def indentation(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))
