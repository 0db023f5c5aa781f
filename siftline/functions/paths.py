"""Path expressions. Paths are ordered component by component, so /a/b comes before /a-b."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """Components with the root as an empty first one; a sort key."""
    return F.split(path, "/")


def sort_key(path: Column) -> Column:
    """Orders paths, with the path itself at hand."""
    return F.struct(components(path).alias("parts"), path.alias("path"))


def normal(path: Column) -> Column:
    """Without repeated and trailing slashes and inner dots."""
    slim = F.regexp_replace(F.regexp_replace(path, "/(\\./)+", "/"), "/+", "/")
    return F.when(slim == "/", slim).otherwise(F.regexp_replace(slim, "(/\\.)?/?$", ""))


def name(path: Column) -> Column:
    return F.element_at(components(path), -1)


def parent(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def depth(path: Column) -> Column:
    """Number of components; the root is one."""
    return F.size(F.filter(components(path), lambda x: x != "")) + F.when(F.startswith(path, F.lit("/")), 1).otherwise(0)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; null without one, or if it only begins with one."""
    last = name(path)
    return F.when(last.rlike("^.+\\.[^.]*$"), F.regexp_extract(last, "\\.([^.]*)$", 1))


def under(path: Column, root: Column | str) -> Column:
    """Whether path is root or below it, by components."""
    root = F.lit(root) if isinstance(root, str) else root
    return (path == root) | F.startswith(path, F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))


def under_any(path: Column, roots: Sequence[str]) -> Column:
    out = F.lit(False)
    for root in roots:
        out = out | under(path, root)
    return out


def relative(path: Column, root: Column | str) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return F.substring(path, F.length(F.regexp_replace(root, "/$", "")) + 2, F.length(path))


def without_suffix(path: Column, suffix: Column) -> Column:
    """The base of which suffix is the relative path to `path`; null if there is none, or nothing is left."""
    p, s = components(path), components(suffix)
    n = F.size(p) - F.size(s)
    return F.when((n > 0) & (F.slice(p, F.greatest(n + 1, F.lit(1)), F.size(s)) == s), F.array_join(F.slice(p, 1, F.greatest(n, F.lit(0))), "/"))


def ancestors(path: Column) -> Column:
    """All folders above a path, topmost first, the root left out."""
    p = components(path)
    return F.when(F.size(p) > 2, F.transform(F.sequence(F.lit(2), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def chain(path: Column, root: str) -> Column:
    """Components of the folder relative to root; the absolute ones if it isn't below."""
    up = parent(path)
    return F.filter(F.when(under(up, root), components(relative(up, root))).otherwise(components(up)), lambda x: x != "")


def archived(path: Column, archive_dir: str) -> Column:
    """Where a file goes in an archive folder: its own components below it."""
    return F.concat_ws("/", F.lit(archive_dir), F.array_join(F.filter(components(path), lambda x: ~x.isin("", ".", "..")), "/"))
