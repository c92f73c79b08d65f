"""Path functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: Column, caseless: bool = False) -> Column:
    """One separator between components, no closing separator, no ``.`` components."""
    if caseless:
        path = F.lower(F.translate(path, "\\", "/"))
    path = F.regexp_replace(path, r"/+", "/")
    path = F.regexp_replace(path, r"(?<=[^/])(/\.)+(?=/|$)", "")
    return F.regexp_replace(path, r"(?<=.)/$", "")


def base_name(path: Column) -> Column:
    """Last component; the path itself when it has none."""
    last = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    return F.when(last == "", path).otherwise(last)


def parent(path: Column) -> Column:
    """Containing directory: ``a/b`` to ``a``, ``a`` to the empty path, null for a root."""
    path = clean(path)
    cut = F.regexp_replace(path, r"/?[^/]+$", "")
    return F.when(path.isin("", "/"), F.lit(None).cast("string")).otherwise(
        F.when((cut == "") & path.startswith("/"), F.lit("/")).otherwise(cut)
    )


def extension(path: Column) -> Column:
    """Text after the last dot of the last component, null when there is none before which a name stands."""
    return extension_of_name(base_name(path))


def extension_of_name(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """Last component without its extension."""
    return stem_of_name(base_name(path))


def stem_of_name(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_replace(name, r"(?s)\.[^.]*$", "")).otherwise(name)


def lies_under(path: Column, ancestor: Column) -> Column:
    """The path is ``ancestor`` or below it, component by component."""
    below = F.when(ancestor.endswith("/"), path.startswith(ancestor)).otherwise(
        path.startswith(F.concat(ancestor, F.lit("/")))
    )
    return (path == ancestor) | below


def ancestors(path: Column) -> Column:
    """The path and every path above it, longest last."""
    def joined(parts: Column) -> Column:
        paths = F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        )
        return F.transform(paths, lambda p: F.when(p == "", F.lit("/")).otherwise(p))

    return F.array_distinct(F.get(F.transform(F.array(F.split(path, "/")), joined), F.lit(0)))


TYPE_CODES = {"App": 1, "File": 2, "Setting": 3, "Command": 4}


def stable_id(entry_type: Column, source: Column, caseless: bool = False) -> Column:
    """64-bit id of an entry from its type and where it comes from."""
    code = F.lit(None).cast("int")
    for name, number in TYPE_CODES.items():
        code = F.when(entry_type == name, F.lit(number)).otherwise(code)
    return F.xxhash64(code, F.lower(source) if caseless else source)


def entry_file_type(file_type: Column, path: Column, windows: bool = False) -> Column:
    """File type of an entry: the stored one without leading dots, else the path's extension."""
    stored = F.lower(F.regexp_replace(file_type, r"^\.+", ""))
    if windows:
        stored = F.when(F.trim(file_type) != "", stored)
        return F.coalesce(stored, F.lower(extension(F.translate(path, "\\", "/"))), F.lit(""))
    return F.coalesce(stored, F.lower(extension(path)))


def _components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: c != "")


def scan_keeps(root: Column, path: Column, excludes, windows: bool = False) -> Column:
    """Rule of the file scan: below the root no hidden component; nowhere an excluded one.

    The windows dialect has no rule for hidden names, ignores case, and of the root only
    tests the last component.
    """
    below = F.substr(path, F.length(root) + 1)
    if windows:
        names = F.array(*[F.lit(e.lower()) for e in excludes]).cast("array<string>")
        tested = F.concat(F.array(F.lower(base_name(root))), _components(F.lower(below)))
        return ~F.arrays_overlap(tested, names)
    names = F.array(*[F.lit(e) for e in excludes]).cast("array<string>")
    return ~F.exists(_components(below), lambda c: c.startswith(".")) & ~F.arrays_overlap(_components(path), names)


def event_keeps(path: Column, roots, excludes, windows: bool = False) -> Column:
    """Rule of the change feed: under some root, with no hidden or excluded component below it.
    The windows dialect (where no roots mean any) compares without case and with either slash, has no rule for hidden names and tests
    every component of the path for exclusion."""
    if windows:
        names = F.array(*[F.lit(e.lower()) for e in excludes]).cast("array<string>")
        key = F.lower(F.translate(path, "\\", "/"))
        inside = F.lit(not roots)
        for root in roots:
            inside = inside | lies_under(key, F.lit(root.lower().replace("\\", "/").rstrip("/") or "/"))
        return inside & ~F.arrays_overlap(_components(key), names)
    names = F.array(*[F.lit(e) for e in excludes]).cast("array<string>")
    kept = F.lit(False)
    for root in roots:
        below = F.substr(path, F.lit(len(root) + 1))
        parts = _components(below)
        kept = kept | (
            lies_under(path, F.lit(root))
            & ~F.exists(parts, lambda c: c.startswith("."))
            & ~F.arrays_overlap(parts, names)
        )
    return kept
