"""URL filters: host and path rules, then listed URLs by a blocked Bloom filter and an exact join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is four 64-bit words; each URL sets BITS_SET bits of one block.
WORDS, BITS_SET = 4, 6
BITS_A_URL = 16
#: The filter never has more blocks than this (4 MB of bits), so it may be broadcast. A longer list only lets
#: more candidates through to the exact join, which removes them.
MAX_BLOCKS = 1 << 17


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without a leading ``www.`` and path without closing slashes, then the query's fields, sorted, without
    ``utm_`` fields and ``ref``; scheme and fragment do not count. Empty without ``://`` or for null."""
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.startswith("utm_") & ~f.startswith("ref=")))
    kept = F.array_join(fields, "&")
    name = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.concat(name, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule ``(host, path, verdict)`` that fits, null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules are configuration and
    become one CASE, longest first; of equally long ones the longer host comes first.
    """
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, answer in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, answer).otherwise(verdict)
    return name, verdict


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bits of a URL in each word of its block."""
    bits = F.xxhash64(key, F.lit(2))
    at = [F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(64 * WORDS - 1)) for i in range(BITS_SET)]
    out = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for p in at:
            mask = mask.bitwiseOR(F.when(F.shiftrightunsigned(p, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def blocked_bloom(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(block, w0 .. w3)`` of the keys, and the number of blocks; one row a block that is not empty."""
    wanted = listed.count() * BITS_A_URL // (64 * WORDS)
    blocks = min(MAX_BLOCKS, 1 << max(0, wanted).bit_length())
    rows = listed.select(_place(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def listed_urls(pages: DataFrame, url_col: str, listed: DataFrame, listed_col: str) -> DataFrame:
    """``pages`` with a boolean ``listed``: whether the canonical form of the URL is that of a listed one.

    The filter answers "no" for most rows where they are read. Possible hits alone are shuffled, to a hash
    join with the distinct list that removes false positives; a URL that a third of the rows share splits in
    that join, as its list side is one row. A null URL, or one without a host, is never listed.
    """
    keys = listed.select(canonical_url(F.col(listed_col)).alias("__key")).where("__key <> ''").distinct()
    bloom, blocks = blocked_bloom(keys, "__key")
    keyed = pages.withColumn("__key", canonical_url(F.col(url_col))).withColumn("__block", _place(F.col("__key"), blocks))
    probed = keyed.join(F.broadcast(bloom.withColumnRenamed("block", "__block")), "__block", "left")
    maybe = F.lit(True)
    for i, mask in enumerate(_masks(F.col("__key"))):
        maybe = maybe & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    probed = probed.withColumn("__maybe", F.coalesce(maybe, F.lit(False)))
    hits = probed.where("__maybe").join(keys.withColumn("listed", F.lit(True)), "__key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    misses = probed.where("NOT __maybe").withColumn("listed", F.lit(False))
    return hits.select(*pages.columns, "listed").unionByName(misses.select(*pages.columns, "listed"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each row: the verdict of the longest fitting rule, else block if listed, else allow.

    Null URLs and those without ``://`` have empty host and path, fit no rule, are not listed and so allowed.
    Repeated rows are judged one by one, other columns of ``pages`` play no part, empty tables give empty results.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    judged = listed_urls(own, "url", listed, listed_col).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "listed")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
