"""Text expressions. All are built-in column functions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Python's str.isspace() as a Java class.
_BLANK = r"[\s\x1c-\x1f]"
#: Noise patterns, in the order in which they are removed.
FENCED_CODE = r"(?s)```.*?```"
INLINE_CODE = r"`[^`]*`"
LOG_LINE = r"(?d)(ERROR|WARN|DEBUG|INFO|TRACE).*"
STACK_FRAME = rf"(?d)(?U)\tat{_BLANK}+[\w\.$]+\(.*?\)"
THREAD_EXCEPTION = r"(?d)Exception in thread.*"
BRACKET_LINE = r"(?d)\[.*?\].*"
HTML_TAG = r"<[^>]+>"
#: Extension, behind a flag: runs of base64 and Python tracebacks.
BASE64_RUN = r"(?:[A-Za-z0-9+/]{4}){16,}={0,2}"
PY_TRACEBACK = r"(?d)(?m)^Traceback \(most recent call last\):(?:\n[ \t]+.*)*(?:\n\w+(?:\.\w+)*(?:Error|Exception)\b.*)?"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def clip(c: Column, n: int) -> Column:
    """n characters and "..." if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clean_description(text: Column, max_length: int = 500, extended: bool = False) -> Column:
    """Code, log lines, stack frames and tags out; white space collapsed; clipped. Null and blank give ''."""
    c = F.coalesce(text.cast("string"), F.lit(""))
    for pattern in (FENCED_CODE, INLINE_CODE, *((BASE64_RUN, PY_TRACEBACK) if extended else ()), LOG_LINE, STACK_FRAME, THREAD_EXCEPTION, BRACKET_LINE):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(c, HTML_TAG, " ")
    c = F.trim(F.regexp_replace(c, rf"(?U){_BLANK}+", " "))
    return clip(c, max_length)


def feature_text(summary: Column, cleaned: Column) -> Column:
    """What is embedded: summary | cleaned description; empty parts are left out."""
    return strip(F.concat_ws(" | ", F.nullif(summary, F.lit("")), F.nullif(cleaned, F.lit(""))))


def content_fingerprint(summary: Column, description: Column, label: Column | None = None) -> Column:
    """First 16 hex digits of the md5 of summary|description|label; a null label counts as ''."""
    label = F.lit("") if label is None else F.coalesce(label, F.lit(""))
    return F.substring(F.md5(F.concat_ws("|", F.coalesce(summary, F.lit("")), F.coalesce(description, F.lit("")), label)), 1, 16)


def characters(c: Column) -> Column:
    """The set of lower-cased characters; null has none."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), "")), "")


def set_jaccard(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; both empty 1, one empty 0."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def character_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lower-cased characters; both empty 1, one empty 0."""
    return set_jaccard(characters(a), characters(b))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def parse_timestamp(c: Column) -> Column:
    """ISO-8601 with T or space, Z or offset; compact and week-date forms too; null if unreadable."""
    s = c.cast("string")
    return F.coalesce(s.try_cast("timestamp"), F.try_to_timestamp(s, F.lit("yyyyMMdd'T'HHmmss[XXX][X]")), F.try_to_timestamp(s, F.lit("yyyyMMdd")))
