"""Text functions: lines, hashes, redaction, masking, markers, terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import constants as C

LINE_BREAK = r"\r\n|\r|\n"
REDACTION_MARKERS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "AKIA", "ASIA", "xox", "-----BEGIN")
REDACTION_MARKERS_ANY_CASE = ("bearer", "://", "api", "secret", "token", "passw", "authorization")


def strip(text: Column) -> Column:
    """Without white space on either side, tabs and line breaks included."""
    return F.trim(text, F.lit(" \t\r\n\f\u000b"))


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not start another line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def may_hold_secret(text: Column) -> Column:
    """A cheap test that every text with something to redact passes."""
    return contains_any(text, REDACTION_MARKERS) | contains_any(F.lower(text), REDACTION_MARKERS_ANY_CASE)


def redact(text: Column, known: Iterable[str] = ()) -> Column:
    """Replace known values (longest first) and credential-shaped text; texts without any marker pass untouched."""
    out = text
    values = sorted({v for v in known if len(v) >= 6}, key=len, reverse=True)
    for value in values:
        out = F.replace(out, F.lit(value), F.lit(C.REDACTED))
    guard = may_hold_secret(text) | contains_any(text, values)
    for _name, pattern, keep_prefix, tail in C.REDACTIONS:
        out = F.regexp_replace(out, pattern, ("$1" if keep_prefix else "") + C.REDACTED + tail)
    return F.when(guard, out).otherwise(text)


def redact_array(values: Column, known: Iterable[str] = ()) -> Column:
    return F.transform(values, lambda v: redact(v, known))


def redact_map(values: Column, known: Iterable[str] = ()) -> Column:
    return F.transform_values(values, lambda _k, v: redact(v, known))


def mask(value: Column, keep: int = 4) -> Column:
    """The first and last characters of a value, with stars between; short values are all stars."""
    n = F.length(value)
    stars = F.repeat(F.lit("*"), F.greatest(n - 2 * keep, F.lit(0)))
    return F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(value, F.lit(keep)), stars, F.right(value, F.lit(keep)))
    )


def mask_webhook(kind: Column, target: Column) -> Column:
    """Mail addresses stay; a webhook shows its host and its last four characters."""
    slashes = F.length(target) - F.length(F.replace(target, F.lit("/"), F.lit("")))
    host = F.when(slashes >= 2, F.split_part(target, F.lit("/"), F.lit(3))).otherwise(F.lit("webhook"))
    return F.when(kind == "email", target).otherwise(
        F.concat(F.lit("https://"), host, F.lit("/…"), F.right(target, F.lit(4)))
    )


def neutralise(text: Column) -> Column:
    """Take the force out of delimiter look-alikes and chat-template tokens."""
    out = F.regexp_replace(text, r"(?i)UNTRUSTED_REPOSITORY_DATA", "UNTRUSTED-DATA-MARKER-REMOVED")
    out = F.regexp_replace(out, r"<\|(im_start|im_end|system|endoftext)\|>", "<|token-removed|>")
    return F.regexp_replace(out, r"\[/?INST\]", "[inst-removed]")


def wrap_untrusted(label: Column, text: Column, max_chars: int) -> Column:
    """Redacted and neutralised text between data markers, with the number of characters cut off."""
    name = F.left(F.regexp_replace(label, r"[^A-Za-z0-9_.:/\- ]", "_"), F.lit(120))
    body = neutralise(redact(text))
    cut = F.concat(
        F.left(body, F.lit(max_chars)),
        F.lit("\n...[truncated "),
        (F.length(body) - max_chars).cast("string"),
        F.lit(" chars]"),
    )
    shown = F.when(F.length(body) > max_chars, cut).otherwise(body)
    return F.concat(
        F.lit('<<<UNTRUSTED_REPOSITORY_DATA label="'),
        name,
        F.lit('"\n'),
        shown,
        F.lit("\nUNTRUSTED_REPOSITORY_DATA>>>"),
    )


def excerpt(text: Column, start: Column, end: Column, max_chars: int = 600) -> Column:
    """Lines ``start..end`` of a text, at most ``max_chars`` characters."""
    lines = split_lines(text)
    first = F.greatest(start, F.lit(1))
    length = F.greatest(end - first + 1, F.lit(0))
    return F.left(F.array_join(F.slice(lines, first, length), "\n"), F.lit(max_chars))


def clip(text: Column, limit: int) -> Column:
    """Cut at the last sentence or clause boundary past half the limit, else at the limit."""
    head = F.left(text, F.lit(limit))
    out = F.concat(head, F.lit("…"))
    half = int(limit * 0.5) + 1
    for separator in (r" ", r", ", r"; ", r" \| ", r"\. "):
        before = F.regexp_extract(head, r"(?s)^(.*)" + separator, 1)
        cut = F.concat(F.regexp_replace(before, r"[ .|;,]+$", ""), F.lit("…"))
        out = F.when(F.length(before) >= half, cut).otherwise(out)
    return F.when(F.length(text) <= limit, text).otherwise(out)


def line_range_hash(text: Column, start: Column, end: Column) -> Column:
    """SHA-256 of lines ``start..end``; of the whole text when there is no start."""
    lines = split_lines(text)
    first = F.greatest(start, F.lit(1))
    last = F.coalesce(end, start)
    chunk = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return F.sha2(F.when(start.isNull(), text).otherwise(chunk), 256)


def normalise_line(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(line, r"\s+", " ")), r"\s+", " ")


def terms(text: Column, stop_words: Iterable[str] = C.STOP_WORDS) -> Column:
    """Distinct words of three or more characters, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_.+/-]+"), F.lit(0))
    long_words = F.filter(words, lambda w: F.length(w) > 2)
    bare = F.transform(long_words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.array_except(F.array_distinct(bare), F.array(*[F.lit(w) for w in stop_words]))


def clean_markup(entry: Column) -> Column:
    """Markdown and reStructuredText to plain text with code spans; links keep their label."""
    out = F.regexp_replace(entry, r"`([^`<]+?)\s*<[^>]+>`_{1,2}", "$1")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r":[a-z]+:`([^`]+)`", "`$1`")
    out = F.replace(out, F.lit("``"), F.lit("`"))
    out = F.regexp_replace(out, r"\s*<https?://[^>]+>", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
