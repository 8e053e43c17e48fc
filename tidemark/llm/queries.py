"""The queries ``opN_<name>``: each operator, with production parameters, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_and_decode
from tidemark.llm.chat import chat_documents
from tidemark.llm.common import fresh_folder
from tidemark.llm.fingerprints import edited_fingerprints
from tidemark.llm.langid import predict_languages
from tidemark.llm.mixing import mix_plan
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.prefix_trie import rebuilt_trie
from tidemark.llm.quality import quality_rules
from tidemark.llm.ranked_search import build_index, search
from tidemark.llm.secret_scan import scan_secrets
from tidemark.llm.token_files import read_token_files, write_token_files
from tidemark.llm.url_filter import host_of, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_fingerprints")
def op1_fingerprints(spark, sf):
    return edited_fingerprints(table(spark, sf, "documents"), "doc_id", "text")


@query("op2_packing")
def op2_packing(spark, sf):
    return pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "doc_id", "text", end_id=2, capacity=1024)


#: The rules of the query, and labels of hosts whose pages are its list of unwanted URLs; query and SQL read both.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED_LABELS = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\."

CANONICAL_SQL = rf"""
  parts AS (SELECT page_id, url,
      translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
      array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'), lambda f: f <> '' AND NOT starts_with(f, 'utm_') AND NOT starts_with(f, 'ref='))), '&') AS kept
    FROM pages),
  named AS (SELECT page_id, host, path, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM parts),
  listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{LISTED_LABELS}') AND canonical <> '')
"""


@query(
    "op3_url_filter",
    f"""WITH {CANONICAL_SQL},
  ruled AS (SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
)
def op3_url_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES, pages.where(host_of(F.col("url")).rlike(LISTED_LABELS)).select("url"))


@query(
    "op4_chat",
    """WITH messages AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1) // 1024 AS segment
      FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
  turns AS (SELECT conv_id, turn, coalesce(turn::VARCHAR, 'N') || '=' || string_agg(coalesce(length(role) || ':' || role, 'N') || '/' || coalesce(length(text) || ':' || text, 'N'), chr(30) ORDER BY role NULLS FIRST, text NULLS FIRST) AS said FROM messages GROUP BY conv_id, turn),
  prefixes AS (SELECT conv_id, string_agg(said, chr(31)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS so_far, lead(conv_id) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) IS NULL AS last FROM turns),
  singles AS (SELECT coalesce(turn::VARCHAR, 'N') || '=' || coalesce(length(role) || ':' || role, 'N') || '/' || coalesce(length(text) || ':' || text, 'N') AS so_far, role, text FROM conversations WHERE conv_id IS NULL),
  ends AS (SELECT so_far, min(conv_id) AS conv_id, count(*) AS copies FROM (SELECT so_far, conv_id FROM prefixes WHERE last UNION ALL SELECT so_far, NULL FROM singles) GROUP BY so_far),
  kept AS (SELECT so_far, conv_id, copies FROM ends WHERE so_far NOT IN (SELECT so_far FROM prefixes WHERE NOT last))
SELECT conv_id, segment, count(DISTINCT coalesce(turn::VARCHAR, 'N')) AS n_turns, any_value(copies) AS copies,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM messages JOIN kept USING (conv_id) GROUP BY conv_id, segment
UNION ALL SELECT NULL, 0, 1, any_value(copies), '<|' || coalesce(any_value(role), '') || '|>' || chr(10) || coalesce(any_value(text), '') || '<|end|>' || chr(10)
FROM singles JOIN kept USING (so_far) WHERE conv_id IS NULL GROUP BY so_far""",
)
def op4_chat(spark, sf):
    return chat_documents(table(spark, sf, "conversations"))


@query("op5_language_id")
def op5_language_id(spark, sf):
    return predict_languages(table(spark, sf, "documents"), "doc_id", "text", "lang", spans=False)


@query("op6_secret_scan")
def op6_secret_scan(spark, sf):
    found = scan_secrets(table(spark, sf, "documents"), "doc_id", "text")
    return found.select("doc_id", "word_no", F.char_length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


@query("op7_token_files")
def op7_token_files(spark, sf):
    folder = fresh_folder(spark, "token-files")
    write_token_files(table(spark, sf, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 49_408, id_col="doc_id", text_col="text", end_id=1)
    return read_token_files(spark, folder)


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf):
    return encode_and_decode(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id", "text")


@query(
    "op9_near_dedup",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN links ON a = doc_id WHERE root < b)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
)
def op9_near_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), "doc_id", "text", width=5, percent=85)


@query("op10_quality")
def op10_quality(spark, sf):
    return quality_rules(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "op11_mixing",
    r"""WITH u AS (SELECT doc_id, source, coalesce(md5(text), '') AS mark, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
  units AS (SELECT *, floor(sqrt(size))::DOUBLE AS weight FROM u),
  own AS (SELECT source, sum(size)::BIGINT AS source_size FROM units GROUP BY source),
  numbered AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM own),
  filled AS (SELECT *, 3 * source_size * sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM numbered),
  targets AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE
      ELSE ((sum(source_size) OVER () - sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER ()) * w)::DOUBLE / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM filled),
  classes AS (SELECT source, weight, sum(size)::DOUBLE AS words FROM units WHERE size > 0 GROUP BY ALL),
  known AS (SELECT c.*, t.target, (t.target - 3 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
      >= 3 * sum(weight * words) OVER (PARTITION BY c.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
    FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
  shares AS (SELECT *, CASE WHEN is_full THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, weight * ((target - 3 * sum(CASE WHEN is_full THEN words ELSE 0 END) OVER (PARTITION BY source)) / sum(CASE WHEN is_full THEN 0 ELSE weight * words END) OVER (PARTITION BY source))) END AS copies FROM known),
  parts AS (SELECT *, floor(copies + 1e-9::DOUBLE) AS whole, greatest(0::DOUBLE, copies - floor(copies + 1e-9::DOUBLE)) AS odd FROM shares),
  needs AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source) AS need FROM parts),
  shared AS (SELECT u.doc_id, u.source, u.mark, u.size, coalesce(n.whole, 0) AS whole, n.odd, n.need,
      (('0x' || substr(md5('mix|' || coalesce(u.doc_id::VARCHAR, '') || '|' || u.mark), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS r
    FROM units u LEFT JOIN needs n ON u.source IS NOT DISTINCT FROM n.source AND u.weight = n.weight AND u.size > 0),
  ranked AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (r / (1 - r)) * ((1 - odd) / odd), doc_id NULLS FIRST, mark ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM shared WHERE odd > 1e-9::DOUBLE),
  used AS (SELECT source, max(cum) AS used FROM ranked WHERE cum <= need GROUP BY source),
  opened AS (SELECT k.*, need - coalesce(used, 0) AS open FROM ranked k LEFT JOIN used s ON k.source IS NOT DISTINCT FROM s.source WHERE cum > need AND size <= need - coalesce(used, 0)),
  few AS (SELECT *, row_number() OVER (PARTITION BY source, len(bin(size)) ORDER BY cum) AS nth FROM opened),
  lists AS (SELECT source, any_value(open) AS open, list({'size': size, 'cum': cum} ORDER BY -size, cum) AS found FROM few WHERE nth <= 2 GROUP BY source),
  more AS (SELECT source, unnest(list_reduce(found, lambda state, one: CASE WHEN one.size <= state.open THEN {'open': state.open - one.size, 'size': 0::BIGINT, 'cum': 0::BIGINT, 'cums': state.cums || [one.cum]} ELSE state END,
      {'open': open, 'size': 0::BIGINT, 'cum': 0::BIGINT, 'cums': []::BIGINT[]}).cums) AS cum FROM lists),
  decided AS (SELECT k.doc_id, k.source, k.size, k.whole + CASE WHEN k.cum <= k.need OR m.cum IS NOT NULL THEN 1 ELSE 0 END AS copies FROM ranked k LEFT JOIN more m ON k.source IS NOT DISTINCT FROM m.source AND k.cum = m.cum
    UNION ALL SELECT doc_id, source, size, whole FROM shared WHERE coalesce(odd, 0) <= 1e-9::DOUBLE)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM decided d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source""",
)
def op11_mixing(spark, sf):
    return mix_plan(table(spark, sf, "documents"), "doc_id", "source", "text").select("doc_id", "size", "source_size", "target", "taken")


#: The CRC-32 of a decimal number, bit by bit.
CRC32_SQL = "xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda crc, byte: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295))"


@query(
    "op12_prefix_trie",
    f"""WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
  heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32_SQL} % 4 AS h FROM ids),
  own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
  turns AS (SELECT h.conv_id, 0 AS part, o.pos, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.base AND o.pos <= h.h
    UNION ALL SELECT h.conv_id, 1, o.pos, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h),
  numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, length(role) || ':' || role || length(text) || ':' || text AS said, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM turns),
  prefixes AS (SELECT conv_id, depth, words, string_agg(said, chr(31)) OVER (PARTITION BY conv_id ORDER BY depth) AS so_far, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM numbered
    UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM numbered) FROM ids),
  named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, so_far) AS node FROM prefixes),
  paths AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM named),
  nodes AS (SELECT node AS conv_id, depth, any_value(parent) AS parent_conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE last) AS ends FROM paths GROUP BY node, depth),
  kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
  full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (conv_id, depth)),
  below AS (SELECT p.node AS conv_id, p.depth, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens
    FROM full_nodes f JOIN paths p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256 FROM full_nodes f JOIN below b USING (conv_id, depth)""",
)
def op12_prefix_trie(spark, sf):
    return rebuilt_trie(table(spark, sf, "conversations"))


@query(
    "op13_ranked_search",
    r"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  tfs AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
  lengths AS (SELECT doc_id, count(*) AS n FROM found GROUP BY ALL),
  total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM lengths),
  norms AS (SELECT doc_id, 100 - 75 + (75 * n * all_docs) // all_terms AS m FROM lengths, total),
  weights AS (SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, total GROUP BY term),
  asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  items AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
  scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10""",
)
def op13_ranked_search(spark, sf):
    folder = build_index(table(spark, sf, "documents"), fresh_folder(spark, "impact-index"), "doc_id", "text")
    return search(spark, folder, table(spark, sf, "benchmark"), "item_id", "text", k=10)
