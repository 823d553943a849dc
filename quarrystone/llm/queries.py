"""Queries over the standard tables, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, chat, decontaminate, html_extract, line_dedup, mixing, order_minhash, quality, token_output, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- 1

def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), with_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
         / coalesce(greatest(length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / greatest(length(text), 1), 0.05), 0.05) AS key
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
r AS (SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 1.5 * sum(n) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(2 * n) OVER q, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS w_left
      FROM r WINDOW q AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((total - full_before) / w_left, (2 * n / w, source IS NULL, source)) FILTER (WHERE (total - full_before) / w_left * w <= 2 * n) AS x FROM o),
t AS (SELECT source, n, CASE WHEN x IS NULL OR x * w > 2 * n THEN 2 * n ELSE x * w END AS target FROM r, level),
p AS (SELECT d.*, t.n, t.target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id::VARCHAR RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n::BIGINT AS source_size, target,
       (size * (epochs + CASE WHEN 2 * upto - size <= 2 * (target - epochs * n) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

# --- 2

#: Host and path rules; ``||host/path`` is the host or a subdomain, then the path's beginning.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERNS = ("||*spam-farm.", "||*cheap-pills.", "||ads-track.", "||*.ads-track.", "||*casino.", "||*-porn.", "*/adserver/", "*/affiliate/", "*/sponsored/", "*/wp-login.php^")


def url_rules() -> list[url_filter.Rule]:
    own = [url_filter.Rule(p, "block") for p in PATTERNS]
    return own + [url_filter.Rule(f"||{r}", v, r, tier=1) for r, v in HOST_RULES]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules())
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '^(?:[^/]*\.)?.*(spam-farm|cheap-pills|casino|-porn)\.') OR regexp_matches(host || path, '^(?:[^/]*\.)?(?:.*\.)?ads-track\.')
                 OR regexp_matches(host || path, '/(adserver|affiliate|sponsored)/') OR regexp_matches(host || path, '/wp-login\.php(?:[^\w\-.%]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""

# --- 3

def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("kept_text").alias("text"), "n_lines", "n_removed_lines", "n_removed_chars")


# --- 4

def op4_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_chats(table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "turn", "position", "new_role", "action", "rendered")


# --- 5

def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shards = token_output.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return token_output.read_shards(spark, shards)


# --- 6

def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("digest")


# --- 7

def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = attention_lm.train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 8

def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "answered")


# --- 9

def learned_rules(spark: SparkSession, sf_dir: str) -> quality.DecisionList:
    return quality.learn(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), learned_rules(spark, sf_dir))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), quality.DecisionList(()))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


QUALITY_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
g AS (SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS win FROM n),
a AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
c AS (SELECT r, count(DISTINCT i + k) AS again FROM a, range(8) x(k) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
o AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(again, 0)::BIGINT AS n_repeat_words FROM w JOIN l USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AS kept FROM f
"""

# --- 10

def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_url_filter, op3_line_dedup, op4_format_chats, op5_token_output, op6_near_duplicates, op7_lm_scores, op8_decontaminate, op9_quality_rules, op10_main_text, quality_base_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_url_filter": OP2_SQL, "quality_base_counts": QUALITY_SQL}
