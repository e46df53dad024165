"""Expressions over lines and texts; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(text: Column) -> Column:
    """Lower case letter by letter, whatever stands around: a final sigma is a sigma, a dotted capital I an i. So a piece of a text folds to a piece of its fold."""
    return F.lower(F.translate(text, "\u03a3\u03c2\u0130", "\u03c3\u03c3i"))


def lines_of(text: Column) -> Column:
    """Lines of a text: no last one after a final newline, none in an empty text, no carriage return at an end."""
    parts = F.split(text, "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, strip_cr)


def strip_cr(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def strip_dot(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def matches(text: Column, query: str, mode: str) -> Column:
    """mode: literal, case_insensitive_literal or regex."""
    if mode == "literal":
        return text.contains(query)
    if mode == "case_insensitive_literal":
        return fold(text).contains(fold(F.lit(query)))
    if mode == "regex":
        return text.rlike(query)
    raise ValueError(f"no search mode {mode!r}")


def match_column(text: Column, query: str, mode: str) -> Column:
    """1-based byte where the literal begins; 1 for a regex, and where ASCII folding doesn't find it."""
    if mode == "regex":
        return F.lit(1)
    fold = ascii_lower if mode == "case_insensitive_literal" else lambda x: x
    at = F.locate(query.translate(str.maketrans(UPPER, LOWER)) if mode == "case_insensitive_literal" else query, fold(text))
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)) + 1).otherwise(1).cast("int")


def grams(text: Column) -> Column:
    """Distinct three-letter pieces of the text, folded as matches are: one pass of a look-ahead, linear in its length."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit("(?s)(?=(...))."), F.lit(1)))


def loc(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))


def grep_line(said: Column) -> Column:
    """(path, line_number, text) of a line `path:line:text` of a search tool's output, without a leading ./; null where it isn't one."""
    part = lambda k: F.regexp_extract(said, r"(?s)^([^:]*):([0-9]+):(.*)$", k)
    number = part(2).try_cast("int")
    return F.when(number.isNotNull(), F.struct(strip_dot(part(1)).alias("path"), number.alias("line_number"), part(3).alias("text")))


def kind_of(mode: Column) -> Column:
    """directory, file or other, by the first letter of a listing's mode (drwxr-xr-x); links and devices are other."""
    first = F.substring(mode, 1, 1)
    return F.when(first == "d", "directory").when(first == "-", "file").otherwise("other")


def encoded(row: Column) -> Column:
    """A row (struct) as JSON; null fields are left out."""
    return F.to_json(row)


def decoded(text: Column, schema: str) -> Column:
    """The row again; null where the text is no such row."""
    return F.from_json(text, schema)


def binary(text: Column) -> Column:
    return F.locate("\0", text) > 0


def safe_error(error: Column) -> Column:
    """What may be shown of a host's error."""
    low = F.lower(error)
    # The four messages, in the order of their tests.
    return (
        F.when(error.isNull(), None)
        .when(low.contains("timeout"), "Device did not respond before the request deadline.")
        .when(low.contains("unauthorized") | low.contains("401"), "Device rejected the peer request.")
        .when(low.contains("not readable") | low.contains("permission"), "Some configured paths are not readable.")
        .otherwise("Device is unavailable or returned an incomplete result.")
    )


# Diagnostics that only say that some path can't be read.
UNREADABLE = (
    "permission denied",
    "operation not permitted",
    "not readable",
    "input/output error",
    "resource busy",
    "resource deadlock avoided",
    "no such file or directory",
    "stale file handle",
)
UNREADABLE_MESSAGE = "some configured paths were not readable"


def unreadable(line: Column) -> Column:
    low = F.lower(line)
    out = F.lit(False)
    for said in UNREADABLE:
        out = out | low.contains(said)
    return out


def absolute_url(url: Column) -> Column:
    """Scheme and authority are there."""
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & (F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")) != ""), F.lit(False))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def sound(path: Column) -> Column:
    """Absolute, and without a way up."""
    return path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def ancestors(path: Column) -> Column:
    """An absolute path itself and every directory above it, the top as '/'."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.array_distinct(F.concat(F.array(F.lit("/")), above))


def within(path: Column, root: Column) -> Column:
    """The path is the root or under it, and has no way up."""
    return ((path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))) & ~path.rlike(r"(^|/)\.\.(/|$)") & path.startswith("/")


def artifact_job(name: Column) -> Column:
    """The job whose results a file of this name holds (job-....json); null for any other name."""
    return F.when(name.rlike(r"^job-[A-Za-z0-9-]*\.json$"), F.regexp_replace(name, r"\.json$", ""))
