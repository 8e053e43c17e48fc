"""Scalar text functions, all JVM-side Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a full trim removes (ASCII blanks plus the no-break space).
BLANKS = " \t\r\n\f\x0b "

# Formats that normalisation masks.
GUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
ISO_TIMESTAMP = r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\b"
TRAILING_LINE_NOTE = r"(?i)\s*//\s*line\s+\d+\s*$"
SOURCE_LINE_MARKER = r"\[[A-Z]+-SOURCE-LINE:(\d+)\]"
SOURCE_LINE_COMMENT = r"(?i)//\s*line\s+(\d+)\b"
TODO_PREFIX = "// TODO:"
WINDOWS_HOME = r"(?i)[A-Za-z]:\\Users\\[^\\]+"
UNIX_HOME = r"(?i)[/\\]home[/\\][^/\\]+"
MAC_HOME = r"(?i)[/\\]Users[/\\][^/\\]+"
QUOTED_URL = r"(?i)([\"'])https?://[^\"'\s]+[\"']"
QUOTED_HEX = r"([\"'])[a-fA-F0-9]{32,}[\"']"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(BLANKS))


def ltrim_all(c: Column | str) -> Column:
    return F.ltrim(as_col(c), F.lit(BLANKS))


def rtrim_all(c: Column | str) -> Column:
    return F.rtrim(as_col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.length(trim_all(c)), F.lit(0)) == 0


def newline_normal(c: Column | str) -> Column:
    """CR LF and lone CR become LF."""
    return F.replace(F.replace(as_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(c: Column | str) -> Column:
    return F.split(newline_normal(c), "\n", -1)


def contains_ci(c: Column | str, needle: str) -> Column:
    return F.contains(F.lower(as_col(c)), F.lit(needle.lower()))


def normalize_text(c: Column | str, roots: Sequence[str] = (), temp_root: str = "/tmp") -> Column:
    """Mask what differs between two runs of the same thing: roots, temp, GUIDs, times, blanks."""
    v = trim_all(F.replace(as_col(c), F.lit("\\"), F.lit("/")))
    for root in [r for r in roots if r]:
        v = F.regexp_replace(v, "(?i)" + re.escape(root.replace("\\", "/").rstrip("/")), "<ROOT>")
    v = F.regexp_replace(v, "(?i)" + re.escape(temp_root.rstrip("/")), "<TEMP>")
    v = F.regexp_replace(v, GUID, "<GUID>")
    v = F.regexp_replace(v, ISO_TIMESTAMP, "<TIMESTAMP>")
    v = F.regexp_replace(v, r"\s+", " ")
    return F.coalesce(trim_all(v), F.lit(""))


def normalize_set(c: Column | str, roots: Sequence[str] = ()) -> Column:
    """Array of strings -> normalised, non-empty, distinct, sorted."""
    return F.array_sort(
        F.array_distinct(F.filter(F.transform(as_col(c), lambda x: normalize_text(x, roots)), lambda x: F.length(x) > 0))
    )


def normalize_source(c: Column | str) -> Column:
    """Source text without blank lines, comment lines, line notes, times and GUIDs."""

    def clean(line: Column) -> Column:
        v = rtrim_all(F.regexp_replace(line, TRAILING_LINE_NOTE, ""))
        return F.regexp_replace(F.regexp_replace(v, ISO_TIMESTAMP, "<TIMESTAMP>"), GUID, "<GUID>")

    trimmed = F.transform(split_lines(c), trim_all)
    kept = F.filter(trimmed, lambda x: (F.length(x) > 0) & ~F.startswith(x, F.lit("//")))
    return F.array_join(F.filter(F.transform(kept, clean), lambda x: F.length(x) > 0), "\n")


def residual_message(c: Column | str) -> Column:
    """Issue message without line pointers, blanks collapsed, lower case."""
    v = F.regexp_replace(as_col(c), r"\[([A-Z]+)-SOURCE-LINE:\d+\]", "[$1-SOURCE-LINE:*]")
    v = F.regexp_replace(v, r"(?i)\bat line \d+\b", "at line *")
    v = F.regexp_replace(v, r"\s+", " ")
    return F.coalesce(F.lower(trim_all(v)), F.lit(""))


def source_line(c: Column | str) -> Column:
    """Line number a generated line points back to, or null."""
    marker = F.regexp_extract(as_col(c), SOURCE_LINE_MARKER, 1)
    comment = F.regexp_extract(as_col(c), SOURCE_LINE_COMMENT, 1)
    picked = F.coalesce(F.nullif(marker, F.lit("")), F.nullif(comment, F.lit("")))
    return picked.try_cast("int")


def redact_paths(c: Column | str) -> Column:
    v = as_col(c)
    for pattern in (WINDOWS_HOME, UNIX_HOME, MAC_HOME):
        v = F.regexp_replace(v, pattern, "<USER_HOME>")
    return v


def redact_url(c: Column | str) -> Column:
    """Host of a URL masked, scheme and rest kept."""
    return F.regexp_replace(as_col(c), r"(?i)^(https?:)//[^/]+(.*)$", "$1://<redacted-host>$2")


def redact_secrets(c: Column | str) -> Column:
    v = F.regexp_replace(as_col(c), QUOTED_URL, "$1<redacted-url>$1")
    return F.regexp_replace(v, QUOTED_HEX, "$1<redacted-secret>$1")


def redaction_count(c: Column | str) -> Column:
    """How many URLs and secrets :func:`redact_secrets` replaces."""
    v = F.regexp_replace(as_col(c), QUOTED_URL, "$1<redacted-url>$1")
    return F.regexp_count(as_col(c), F.lit(QUOTED_URL)) + F.regexp_count(v, F.lit(QUOTED_HEX))


def base_signature(c: Column | str) -> Column:
    """``receiver.method`` of a call text, or the text itself when it is no call."""
    pattern = r"(\w+(?:\.\w+)*?)\.(\w+)\((.*)\)"
    receiver, method = F.regexp_extract(as_col(c), pattern, 1), F.regexp_extract(as_col(c), pattern, 2)
    return F.when(method == "", as_col(c)).otherwise(F.concat_ws(".", receiver, method))


def signatures(c: Column | str) -> Column:
    return F.struct(base_signature(c).alias("base"), as_col(c).alias("full"))


CALL = r"^(.*)\((.*)\)"


def call_pattern(first: Column | str, varied: Column) -> Column:
    """Pattern of a method from its first signature and whether its argument lists vary.

    Both come from a partial aggregate (min, and min <> max of the arguments), so a
    method called a billion times never has its signatures collected.
    """
    sig = as_col(first)
    base, args = F.regexp_extract(sig, CALL, 1), F.regexp_extract(sig, CALL, 2)
    holes = F.transform(F.sequence(F.lit(0), F.size(F.split(args, ",", -1)) - 1), lambda i: F.concat(F.lit("{arg"), i.cast("string"), F.lit("}")))
    return (
        F.when(~F.rlike(sig, F.lit(CALL)), F.concat(sig, F.lit("()")))
        .when(varied, F.concat(base, F.lit("("), F.array_join(holes, ", "), F.lit(")")))
        .otherwise(F.concat(base, F.lit("("), args, F.lit(")")))
    )


def call_args(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), CALL, 2)


def parameterized_pattern(sigs: Column | str) -> Column:
    """Array form of :func:`call_pattern`; the first signature in sorted order gives the placeholder count."""
    s = F.array_sort(F.array_distinct(as_col(sigs)))
    return call_pattern(F.element_at(s, 1), F.size(F.array_distinct(F.transform(s, call_args))) > 1)


def placeholder_regex(pattern: str) -> str:
    """``Foo({x})`` -> regex where each ``{name}`` matches any shortest text. Driver side, for rule rows."""
    return ".+?".join(re.escape(p) for p in re.split(r"\{[A-Za-z_][A-Za-z0-9_]*\}", pattern))


def placeholder_regex_col(pattern: Column | str) -> Column:
    """Column form of :func:`placeholder_regex`, for rule tables that stay on the cluster."""
    parts = F.split(as_col(pattern), r"\{[A-Za-z_][A-Za-z0-9_]*\}", -1)
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"([\\.\[\]{}()*+?^$|#\-])", r"\\$1")), ".+?")


def table_base(c: Column | str) -> Column:
    v = as_col(c)
    return F.when(F.instr(v, ".Items") > 1, F.substring_index(v, ".Items", 1))


def manual_pattern(c: Column | str) -> Column:
    pattern = r"(\w+(?:\.\w+)*?)\.(\w+(?:<[^>]*>)?)"
    return F.nullif(F.regexp_extract(as_col(c), pattern, 0), F.lit(""))


def count_hits(text: Column | str, key: Column | str) -> Column:
    """Non-overlapping occurrences of ``key``."""
    t, k = as_col(text), as_col(key)
    return F.when(F.length(k) == 0, F.lit(0)).otherwise(
        ((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)).cast("int")
    )


def first_hit_line(text: Column | str, key: Column | str) -> Column:
    """1-based line of the first occurrence, 0 when there is none."""
    t, k = as_col(text), as_col(key)
    pos = F.position(k, t)
    before = F.substring(t, F.lit(1), pos - 1)
    newlines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when(pos > 0, newlines + 1).otherwise(F.lit(0))


def match_value(c: Column | str) -> Column:
    """Form in which two selector values are compared."""
    stripped = F.btrim(trim_all(c), F.lit("\"'"))
    return F.nullif(F.replace(F.lower(stripped), F.lit("xpath="), F.lit("")), F.lit(""))


def values_match(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(~is_blank(a) & ~is_blank(b) & (match_value(a) == match_value(b)), F.lit(False))


def json_unescape(c: Column | str) -> Column:
    """Content of a JSON string literal; text that is no valid literal stays as it is."""
    v = as_col(c)
    parsed = F.from_json(F.concat(F.lit('{"v":"'), v, F.lit('"}')), "v string")
    return F.coalesce(parsed["v"], v)


def kebab(c: Column | str) -> Column:
    """A hyphen before every capital that is not the first character."""
    return F.lower(F.regexp_replace(as_col(c), r"(?<!^)([A-Z])", "-$1"))


def screaming_snake(c: Column | str) -> Column:
    """An underscore before a capital that follows a non-capital."""
    return F.upper(F.regexp_replace(as_col(c), r"([^A-Z])([A-Z])", "$1_$2"))


def half_even(c: Column | str, digits: int) -> Column:
    """Round to ``digits`` places, ties to even, on the scaled double (not on its decimal text)."""
    scale = float(10**digits)
    return F.rint(as_col(c) * scale) / scale


def clamp(c: Column | str, lo: int = 0, hi: int = 100) -> Column:
    return F.least(F.greatest(as_col(c), F.lit(lo)), F.lit(hi))


def is_ordered_subsequence(expected: Column | str, actual: Column | str) -> Column:
    """True when ``expected`` occurs inside ``actual`` in order, gaps allowed."""
    exp, act = as_col(expected), as_col(actual)
    reached = F.aggregate(act, F.lit(0), lambda i, x: i + F.when(x == F.get(exp, i), 1).otherwise(0))
    return reached == F.size(exp)


def evidence_age(ts: Column | str, as_of: Column | str, max_days: int) -> Column:
    """Age in whole hours (never negative), stale and future flags, against an explicit instant."""
    seconds = F.unix_seconds(as_col(as_of).cast("timestamp")) - F.unix_seconds(as_col(ts).cast("timestamp"))
    hours = F.greatest(F.lit(0).cast("bigint"), F.floor(seconds / 3600).cast("bigint"))
    return F.struct(hours.alias("hours"), (seconds > max_days * 86400).alias("stale"), (seconds < 0).alias("future"))


def first_flag(rules: Sequence[tuple[str, Column]], default: Column | str | None = None) -> Column:
    """Ordered cascade: the label of the first condition that holds."""
    expr = None
    for label, cond in rules:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        raise ValueError("a cascade needs at least one rule")
    return expr if default is None else expr.otherwise(F.lit(default) if isinstance(default, str) else default)
