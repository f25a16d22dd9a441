"""Column expressions over slash-separated paths. Roots: '' has depth 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(name: Column) -> Column:
    """Runs of slashes as one, none at the end; a leading slash stays. Clean names skip the pattern."""
    clean = ~name.contains("//") & ~name.endswith("/")
    return F.when(clean, name).otherwise(F.regexp_replace(F.regexp_replace(name, "/+", "/"), "/$", ""))


def depth(path: Column) -> Column:
    """Number of segments."""
    return F.when(path == "", F.lit(0)).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1).cast("int")


def parent(path: Column) -> Column:
    """What stands before the last slash; '' if there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def prefix_at(path: Column, k: int) -> Column:
    """The first k segments; null for shorter paths."""
    return F.when(depth(path) >= k, F.substring_index(path, "/", k))


def in_subtree(path: Column, top: str) -> Column:
    """top itself or below, as comparisons that reach the scan: '0' follows '/'."""
    return F.lit(True) if top == "" else (path == top) | ((path >= f"{top}/") & (path < f"{top}0"))


def ancestors(path: Column, own: bool = True, root: bool = True, least: int = 1) -> Column:
    """Array of the paths above, shortest first: with '' if root, with the path if own, from depth least on."""
    top = depth(path) if own else depth(path) - 1
    some = F.when(top >= least, F.transform(F.sequence(F.lit(least), F.greatest(top, F.lit(least))), lambda k: F.call_function("substring_index", path, F.lit("/"), k))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), some) if root else some


def child_of(path: Column, top: Column) -> Column:
    """The ancestor-or-self of path right under top ('' is the root)."""
    return F.call_function("substring_index", path, F.lit("/"), depth(top) + 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def url_path(url: Column) -> Column:
    """Path of a URL without query and fragment, canonical, no slash in front."""
    return F.regexp_replace(canonical(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)), "^/", "")
