"""File and path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens import catalogue as cat
from corpuslens.functions.lookup import contains_any, literal_array, lookup
from corpuslens.functions.text import basename, extension


def _path(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def not_in_ignored_dir(path: Column | str, which: str, include_name: bool = False) -> Column:
    """No directory on the path is in the set. ``include_name`` also tests the file name itself."""
    parts = F.split(_path(path), "/")
    if not include_name:
        parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.arrays_overlap(parts, literal_array(cat.IGNORED_DIRS[which]))


def is_analyzable(path: Column | str) -> Column:
    """Neither the name nor the extension marks the file as binary, media or archive."""
    return ~basename(path).isin(*cat.IGNORED_FILE_NAMES) & ~extension(path).isin(*cat.IGNORED_EXTENSIONS)


def language_of(path: Column | str) -> Column:
    return lookup(extension(path), cat.EXTENSION_LANGUAGE)


def is_test_path(path: Column | str, variant: str = "score") -> Column:
    return contains_any(F.lower(_path(path)), cat.TEST_MARKERS[variant])


def is_root_readme(path: Column | str) -> Column:
    return _path(path).isin(*cat.ROOT_READMES)


def is_manifest(path: Column | str) -> Column:
    name = basename(path)
    return name.isin(*cat.MANIFESTS) | name.endswith(".csproj")


def is_entry_point(path: Column | str) -> Column:
    return basename(path).isin(*cat.ENTRY_POINTS)


def security_scannable(path: Column | str, max_bytes: int | None = None, size_bytes: Column | str = "size_bytes") -> Column:
    """Files that are searched for secrets; with ``max_bytes`` larger ones are left out."""
    named = extension(path).isin(*cat.SECURITY_EXTENSIONS) | (basename(path) == ".env")
    fits = F.lit(True) if max_bytes is None else _path(size_bytes) <= max_bytes
    return named & fits & not_in_ignored_dir(path, "security")
