"""Path and package-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import lookup


def is_test_path(path: Column) -> Column:
    return F.rlike(path, F.lit(C.TEST_PATH))


def is_fixture_path(path: Column) -> Column:
    return F.rlike(path, F.lit(C.FIXTURE_PATH))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; null without one."""
    return F.lower(F.nullif(F.regexp_extract(file_name(path), r".\.([^.]+)$", 1), F.lit("")))


def language(path: Column) -> Column:
    return lookup(suffix(path), C.LANGUAGE_OF_SUFFIX)


def components(path: Column) -> Column:
    """Ordered components of a path; its parent folder, or ``root``, when no rule names one."""
    named = F.array_compact(
        F.array(
            F.when(is_test_path(path), F.lit("tests")),
            F.when(is_fixture_path(path) & ~is_test_path(path), F.lit("fixtures")),
            *[F.when(F.rlike(path, F.lit(pattern)), F.lit(name)) for name, pattern in C.COMPONENT_PATHS],
        )
    )
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("root"))
    return F.when(F.size(named) > 0, named).otherwise(F.array(parent))


def is_scannable(path: Column, size: Column, max_bytes: int | None = None) -> Column:
    """Text files of the repository itself: no vendored folder, no binary suffix, within a size limit if one is given."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    vendored = F.exists(folders, lambda d: d.isin(C.SKIPPED_DIRS) | d.endswith(".egg-info"))
    binary = F.coalesce(suffix(path).isin(C.BINARY_SUFFIXES), F.lit(False))
    return ~vendored & ~binary if max_bytes is None else ~vendored & ~binary & (size <= max_bytes)


def is_requirements_file(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(^|/)requirements[^/]*\.txt$")) | F.rlike(path, F.lit(r"(^|/)(requirements|reqs)/[^/]+\.txt$"))


def ecosystem_of_manifest(path: Column) -> Column:
    return F.coalesce(
        lookup(file_name(path), C.ECOSYSTEM_OF_MANIFEST), F.when(is_requirements_file(path), F.lit("PyPI"))
    )


def is_entrypoint(path: Column) -> Column:
    return file_name(path).isin(C.ENTRYPOINT_NAMES) | F.contains(path, F.lit("/routes")) | F.contains(path, F.lit("/api/"))


def is_public_module(path: Column, packages: Column) -> Column:
    """Modules inside one of the repository's packages or two folders deep under ``src``."""
    parts = F.split(path, "/")
    return F.array_contains(packages, F.element_at(parts, 1)) | (path.startswith("src/") & (F.size(parts) > 2))


def module_name(path: Column) -> Column:
    """Dotted name of a Python module; null for other files and for a package file at the root."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    dotted = F.replace(F.regexp_replace(bare, r"^src(/|$)", ""), F.lit("/"), F.lit("."))
    return F.when(path.endswith(".py") & (dotted != ""), dotted)


def normalise_package(name: Column, ecosystem: Column) -> Column:
    return F.when(ecosystem == "PyPI", F.lower(F.regexp_replace(name, r"[-_.]+", "-"))).otherwise(name)


def import_name(package: Column, ecosystem: Column) -> Column:
    known = F.coalesce(lookup(F.lower(package), C.IMPORT_NAMES), F.replace(F.lower(package), F.lit("-"), F.lit("_")))
    return F.when(ecosystem == "PyPI", known).otherwise(package)


def clean_path(raw: Column) -> Column:
    """A repository-relative path in plain form; null when it is absolute, has a drive, or climbs out."""
    path = F.trim(F.replace(raw, F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    bad = (
        (F.size(parts) == 0)
        | path.startswith("/")
        | F.contains(F.get(parts, F.lit(0)), F.lit(":"))
        | F.contains(path, F.lit("\u0000"))
        | F.array_contains(parts, "..")
    )
    return F.when(~bad, F.array_join(parts, "/"))
