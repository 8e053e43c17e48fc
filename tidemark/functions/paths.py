"""Path functions and the glob predicate."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import as_col


def slashes(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit("\\"), F.lit("/"))


def file_name(c: Column | str) -> Column:
    """Last segment, whatever the separator; trailing separators do not count."""
    return F.substring_index(F.rtrim(slashes(c), F.lit("/")), "/", -1)


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"(\.[^.]+)$", 1))


def short_path(c: Column | str, keep: int = 3) -> Column:
    """Last ``keep`` segments; a path that is already short stays as it is."""
    norm = slashes(c)
    parts = F.filter(F.split(norm, "/", -1), lambda x: F.length(x) > 0)
    tail = F.slice(parts, F.greatest(F.size(parts) - (keep - 1), F.lit(1)), keep)
    return F.when(norm.isNull() | (F.trim(norm) == ""), F.lit("")).when(F.size(parts) <= keep, norm).otherwise(F.array_join(tail, "/"))


def safe_path(c: Column | str, base: str | None = None) -> Column:
    """Path relative to ``base`` when it lies below it, else only the file name.

    Windows-shaped paths compare ignoring case and with either separator, on any
    operating system; other paths compare as written.
    """
    path, name = as_col(c), file_name(c)
    if not base:
        return name
    windows_base = "\\" in base or bool(re.match(r"^[A-Za-z]:", base))
    looks_windows = F.contains(path, F.lit("\\")) | F.rlike(path, F.lit(r"^\p{L}:")) | F.lit(windows_base)
    win_path = F.rtrim(F.replace(path, F.lit("/"), F.lit("\\")), F.lit("\\"))
    win_base = base.replace("/", "\\").rstrip("\\") + "\\"
    below_win = F.startswith(F.lower(win_path), F.lit(win_base.lower()))
    win_rel = F.substring(win_path, len(win_base) + 1, 2**31 - 1)
    unix_base = base.rstrip("/") + "/"
    below_unix = F.startswith(path, F.lit(unix_base))
    unix_rel = F.rtrim(F.substring(path, len(unix_base) + 1, 2**31 - 1), F.lit("/"))
    return (
        F.when(path == "", path)
        .when(looks_windows & below_win & (F.length(win_rel) > 0), win_rel)
        .when(~looks_windows & below_unix & (F.length(unix_rel) > 0), unix_rel)
        .otherwise(name)
    )


def glob_to_regex(glob: str) -> tuple[str, bool]:
    """Regex for a glob, and whether it looks at the file name only.

    ``*`` stays inside a segment, ``**`` crosses segments, ``?`` is one character
    of a segment. A pattern without a slash names a file. A relative pattern may
    start at any depth.
    """
    pattern = glob.strip().replace("\\", "/")
    name_only = "/" not in pattern
    rooted = pattern.startswith("/") or bool(re.match(r"^[A-Za-z]:/", pattern))
    pieces = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(pieces.get(token) or re.escape(token) for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern))
    depth = "" if name_only or rooted or pattern.startswith("**/") else "(?:.*/)?"
    return f"(?i)^{depth}{body}$", name_only


def glob_match(path: Column | str, glob: str) -> Column:
    if not glob or not glob.strip():
        return F.lit(False)
    regex, name_only = glob_to_regex(glob)
    subject = F.substring_index(slashes(path), "/", -1) if name_only else slashes(path)
    return F.coalesce(F.rlike(subject, F.lit(regex)), F.lit(False))


def glob_any(path: Column | str, globs: Sequence[str]) -> Column:
    cond = F.lit(False)
    for g in globs:
        cond = cond | glob_match(path, g)
    return cond


def in_ignored_dir(path: Column | str, ignored: Sequence[str]) -> Column:
    parts = F.split(F.lower(slashes(path)), "/", -1)
    return F.arrays_overlap(parts, F.array(*[F.lit(i.lower()) for i in ignored])) if ignored else F.lit(False)


def path_segments(path: Column | str) -> Column:
    return F.split(slashes(path), "/", -1)


def common_root(df, path_col: str, by: Sequence[str]):
    """Longest common directory per group, ignoring case.

    The common prefix of a set is the common prefix of its smallest and largest
    member, so one partial aggregate (min, max) is enough: nothing is collected
    per group.
    """
    directory = F.regexp_replace(slashes(path_col), r"/?[^/]*$", "")
    folded = F.lower(F.concat(directory, F.lit("/")))
    kept = df.where(F.length(F.coalesce(F.col(path_col), F.lit(""))) > 0).select(*by, directory.alias("_dir"), folded.alias("_fold"))
    agg = kept.groupBy(*by).agg(F.min("_fold").alias("_lo"), F.max("_fold").alias("_hi"), F.min("_dir").alias("_shown"))
    lo, hi = F.split("_lo", "/", -1), F.split("_hi", "/", -1)
    same = F.zip_with(lo, hi, lambda a, b: F.coalesce(a == b, F.lit(False)))
    depth = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
                        lambda s, x: F.struct((s["n"] + F.when(s["go"] & x, 1).otherwise(0)).alias("n"), (s["go"] & x).alias("go")),
                        lambda s: s["n"])
    root = F.array_join(F.slice(F.split("_shown", "/", -1), F.lit(1), depth), "/")
    return agg.select(*by, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")).alias("root"))
