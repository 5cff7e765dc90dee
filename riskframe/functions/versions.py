"""Version order, version gaps and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
SEMVER_HEAD = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?"
NO_LIMIT = 2**62



def _part(version: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(version, pattern, group), F.lit(""))


def _release(version: Column, ecosystem: Column) -> Column:
    """Release numbers; Python releases keep their length, others have three."""
    python = F.transform(F.split(_part(version, PEP440, 2), r"\."), lambda p: p.cast("bigint"))
    head = F.array(*[F.coalesce(_part(version, SEMVER_HEAD, i).cast("bigint"), F.lit(0).cast("bigint")) for i in (1, 2, 3)])
    return F.when(ecosystem == "PyPI", F.when(F.rlike(version, F.lit(PEP440)), python)).otherwise(
        F.when(F.rlike(version, F.lit(SEMVER_HEAD)), head)
    )


def version_key(version: Column, ecosystem: Column) -> Column:
    """A struct that sorts as versions do (pre < final < post, dev first); null where the text is no version."""
    trimmed = F.transform(
        F.split(F.regexp_replace(_part(version, PEP440, 2), r"(\.0+)+$", ""), r"\."), lambda p: p.cast("bigint")
    )
    letter = F.lower(_part(version, PEP440, 3))
    is_dev = _part(version, PEP440, 8).isNotNull()
    is_post = (_part(version, PEP440, 5).isNotNull()) | (_part(version, PEP440, 6).isNotNull())
    phase = (
        F.when(letter.isin("a", "alpha"), F.lit(0))
        .when(letter.isin("b", "beta"), F.lit(1))
        .when(letter.isNotNull(), F.lit(2))
        .when(is_dev & ~is_post, F.lit(-1))
        .otherwise(F.lit(3))
    )
    zero = F.lit(0).cast("bigint")
    key = F.struct(
        F.coalesce(_part(version, PEP440, 1).cast("bigint"), zero).alias("epoch"),
        trimmed.alias("release"),
        phase.alias("phase"),
        F.coalesce(_part(version, PEP440, 4).cast("bigint"), zero).alias("pre"),
        F.when(
            is_post, F.coalesce(_part(version, PEP440, 5).cast("bigint"), _part(version, PEP440, 7).cast("bigint"), zero)
        )
        .otherwise(F.lit(-1).cast("bigint"))
        .alias("post"),
        F.when(is_dev, F.coalesce(_part(version, PEP440, 9).cast("bigint"), zero))
        .otherwise(F.lit(NO_LIMIT).cast("bigint"))
        .alias("dev"),
        F.coalesce(F.lower(_part(version, PEP440, 10)), F.lit("")).alias("local"),
    )
    plain = F.struct(
        zero.alias("epoch"),
        _release(version, ecosystem).alias("release"),
        F.lit(3).alias("phase"),
        zero.alias("pre"),
        F.lit(-1).cast("bigint").alias("post"),
        F.lit(NO_LIMIT).cast("bigint").alias("dev"),
        F.lit("").alias("local"),
    )
    return F.when(ecosystem == "PyPI", F.when(F.rlike(version, F.lit(PEP440)), key)).otherwise(
        F.when(F.rlike(version, F.lit(SEMVER_HEAD)), plain)
    )


def version_gap(current: Column, latest: Column, ecosystem: Column) -> Column:
    """``major``, ``minor``, ``patch`` or ``current``; null when either side is no version."""

    def three(version: Column) -> Column:
        release = _release(version, ecosystem)
        zeros = F.array(*[F.lit(0).cast("bigint")] * 3)
        return F.slice(F.concat(release, zeros), 1, 3)

    a, b = three(current), three(latest)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("string"))
        .when(a >= b, F.lit("current"))
        .when(F.get(a, F.lit(0)) < F.get(b, F.lit(0)), F.lit("major"))
        .when(F.get(a, F.lit(1)) < F.get(b, F.lit(1)), F.lit("minor"))
        .otherwise(F.lit("patch"))
    )


def age_days(when: Column, now: Column) -> Column:
    """Whole periods of 24 hours between two instants; null when the first is missing."""
    micros = F.unix_micros(now) - F.unix_micros(when)
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def parse_instant(text: Column) -> Column:
    """An ISO instant; null on anything else."""
    return F.try_to_timestamp(text)
