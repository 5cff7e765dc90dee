"""License identification, normalisation and compatibility as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import lookup


def with_license_of_text(df: DataFrame, text: str = "text", out: str = "license_id") -> DataFrame:
    """Add the license whose fingerprint comes first among those found in the whole text."""
    head = F.col("_license_text")
    expr = None
    for spdx, needles in C.LICENSE_FINGERPRINTS:
        found = F.lit(True)
        for needle in needles:
            found = found & F.contains(head, F.lit(needle))
        expr = F.when(found, F.lit(spdx)) if expr is None else expr.when(found, F.lit(spdx))
    return (
        df.withColumn("_license_text", F.lower(F.col(text)))
        .withColumn(out, expr)
        .drop("_license_text")
    )


def spdx_header(line: Column) -> Column:
    """The expression of an SPDX header line; null without one."""
    return F.nullif(F.trim(F.regexp_extract(line, C.SPDX_HEADER, 1)), F.lit(""))


def _alias_map() -> Column:
    pairs = [F.lit(x) for pair in C.LICENSE_OF_ALIAS.items() for x in pair]
    return F.create_map(*pairs)


def normalise_license(value: Column) -> Column:
    """Canonical id of free-form license text: alias, then alias of a part, then a known id or its ``-`` variant."""
    aliases = _alias_map()
    raw = F.trim(value)
    whole = F.try_element_at(aliases, F.regexp_replace(F.lower(raw), r"\.+$", ""))
    parts = F.transform(F.split(raw, r"\s+(?:OR|AND|/)\s+|\s*,\s*"), lambda p: F.try_element_at(aliases, F.lower(F.trim(p))))
    by_part = F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0))
    upper = F.upper(raw)
    by_id = F.coalesce(
        *[F.when((upper == spdx.upper()) | upper.startswith(spdx.upper() + "-"), F.lit(spdx)) for spdx in C.LICENSE_CLASS]
    )
    return F.when(raw != "", F.coalesce(whole, by_part, by_id))


def normalise_expression(value: Column) -> Column:
    """Every recognised license of an expression, each once, in order."""
    parts = F.split(value, r"\s+(?:OR|AND)\s+|\s*/\s*|\s*,\s*|[()]")
    found = F.array_distinct(F.array_compact(F.transform(parts, normalise_license)))
    whole = F.array_compact(F.array(normalise_license(value)))
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(whole, F.array().cast("array<string>")))


def license_class(spdx: Column) -> Column:
    return F.coalesce(lookup(spdx, C.LICENSE_CLASS), F.lit("unknown"))


def conflict_severity(project: Column, component: Column) -> Column:
    """Severity of using ``component``-licensed code in a ``project``-licensed one; null without a conflict."""
    p, c = license_class(project), license_class(component)
    out = None
    for (project_class, component_class), severity in C.LICENSE_CONFLICTS.items():
        hit = (p == project_class) & (c == component_class)
        out = F.when(hit, F.lit(severity)) if out is None else out.when(hit, F.lit(severity))
    return out


def best_registry_license(expression: Column, license_text: Column, classifiers: Column) -> Column:
    """The expression, else a short recognisable license field, else the approved classifiers, else the field's start."""
    short = (F.length(license_text) < 60) & ~F.contains(license_text, F.lit("\n"))
    known = F.size(normalise_expression(license_text)) > 0
    prefix = "License :: OSI Approved :: "
    approved = F.transform(
        F.filter(classifiers, lambda c: c.startswith(prefix)), lambda c: F.trim(F.element_at(F.split(c, "::"), -1))
    )
    return F.coalesce(
        F.nullif(expression, F.lit("")),
        F.when(short & known, license_text),
        F.when(F.size(approved) > 0, F.array_join(approved, " OR ")),
        F.nullif(F.left(license_text, F.lit(60)), F.lit("")),
    )
