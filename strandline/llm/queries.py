"""The queries opN_<name>, thin views of the operators over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table
from .decontaminate import decontaminate
from .language_id import identify
from .license_scan import scan_licenses
from .near_dup import near_duplicates
from .packing import pack
from .quality_model import quality
from .quality_rules import quality_rules
from .token_rollup import Rollup, count_tokens, deletes, inserts, revisions
from .toxicity import toxicity
from .url_filter import filter_urls


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _remainder(3) == 1
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the signed path: half are loaded with counts that a revision mends, half are
    loaded, deleted and inserted again; each batch is committed twice and a compaction lies between."""
    counts = materialize(count_tokens(table(spark, sf_dir, "documents")), "counts")
    half = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0))
    a, b = counts.filter(half == 0), counts.filter(half == 1)
    stale = a.withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")

    def commit(**batches: DataFrame) -> None:
        for _ in range(2):
            for name, deltas in batches.items():
                rollup.commit(name, deltas)

    commit(load_a=inserts(stale), load_b=inserts(b))
    commit(revise_a=revisions(stale, a), delete_b=deletes(b))
    rollup.compact()
    commit(load_a=inserts(stale), again_b=inserts(b))
    return rollup.totals()


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, docs = _remainder(4) == 2, table(spark, sf_dir, "documents")
    return identify(docs, docs.filter(~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_url_filter, op3_pack, op4_toxicity, op5_license_scan, op6_near_dup, op7_quality_rules,
    op8_token_rollup, op9_language_id, op10_quality_model)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win, least(len(w), 8) AS n
  FROM items, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM words, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)
), hits AS (
  SELECT DISTINCT s.doc_id, s.i, s.n, x.item_id FROM spots s JOIN wins x ON s.win = x.win AND s.n = x.n
), inside AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words w LEFT JOIN inside USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
spots AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM w, (VALUES (5), (8), (10)) AS sizes(n), unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)),
twice AS (SELECT r, n, win FROM spots GROUP BY ALL HAVING count(*) > 1),
inside AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS k FROM spots JOIN twice USING (r, n, win)),
cover AS (
  SELECT r, coalesce(count(*) FILTER (n = 8), 0) AS n_repeat_words, coalesce(sum(length(w.w[k])) FILTER (n = 5), 0) AS c5,
    coalesce(sum(length(w.w[k])) FILTER (n = 8), 0) AS c8, coalesce(sum(length(w.w[k])) FILTER (n = 10), 0) AS c10
  FROM inside JOIN w USING (r) GROUP BY r
), lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT r, sum(n - 1) AS n_dup_lines, coalesce(sum(n * length(line)) FILTER (n > 1), 0) / sum(n * length(line))::DOUBLE AS line_share FROM lines GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(line_share, 0) AS line_share, coalesce(c5, 0) AS c5, coalesce(c8, 0) AS c8, coalesce(c10, 0) AS c10
  FROM w LEFT JOIN cover USING (r) LEFT JOIN dup USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND line_share <= 0.3::DOUBLE AND c5 / greatest(word_chars, 1)::DOUBLE <= 0.4::DOUBLE
    AND c8 / greatest(word_chars, 1)::DOUBLE <= 0.3::DOUBLE AND c10 / greatest(word_chars, 1)::DOUBLE <= 0.3::DOUBLE AS kept
FROM m
"""

_OP2_SQL = rf"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, html, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0)")} AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, nullif(host, '') || regexp_replace(path, '(\.html?|/index\.html?|/)$', '') AS key, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts
), own AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict_ FROM ruled
), goal AS (
  SELECT key, unnest([regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS u
  FROM own WHERE key IS NOT NULL
), ends AS (
  SELECT key AS a, substr(u, instr(u, '://') + 3) AS r FROM goal WHERE instr(u, '://') > 0
), edges AS (
  SELECT a, {_LOWER.format("regexp_extract(r, '^[^/?#]*', 0)")} || regexp_replace(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '(\.html?|/index\.html?|/)$', '') AS b FROM ends
), both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT DISTINCT key AS node, key AS top FROM own WHERE key IS NOT NULL
  UNION SELECT r.node, e.b FROM reach r JOIN both_ e ON r.top = e.a
), tops AS (SELECT node, min(top) AS top FROM reach GROUP BY node),
classes AS (
  SELECT top, bool_or(verdict_ = 'block') AS block, coalesce(bool_or(verdict_ = 'allow'), false) AS allow FROM own JOIN tops ON own.key = tops.node GROUP BY top
)
SELECT page_id, host, path, rule, coalesce(verdict_, CASE WHEN block AND NOT allow THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN tops ON own.key = tops.node LEFT JOIN classes USING (top)
"""

ORACLE_SQL = {"op1_decontaminate": _OP1_SQL, "op2_url_filter": _OP2_SQL, "op7_quality_rules": _OP7_SQL}
