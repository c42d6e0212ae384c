"""The queries of this subpackage, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, quality_rules, secret_scans, simhash, substring_dedup, token_counts, toxicity, url_filters, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, _table(spark, sf_dir, "labels")))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan_secrets(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), quality_rules.STANDARD)
    base = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.BASE.mask)) != 0
    return entries.withColumn("base_failed", base).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


QUERIES = {f.__name__: f for f in (op1_packing, op2_url_filters, op3_token_counts, op4_simhash, op5_mixing, op6_toxicity, op7_secret_scans, op8_substring_dedup, op9_fingerprints, op10_quality_rules)}

#: DuckDB SQL, where it can express the whole query. Its regular expressions write white space as \t\n\x0B\f\r.
ORACLE_SQL = {
    "op2_url_filters": r"""
        WITH split AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1, 's') AS path
            FROM split
        ), rules(rule, action, rule_host, rule_path) AS (
            VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
                   ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
        ), fitting AS (
            SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
            FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
            GROUP BY p.page_id
        ), method(place, name, pattern) AS (
            VALUES (1, 'login-page', '/wp-login\.php\b'), (2, 'remote-procedure', '/xmlrpc\.php\b'), (3, 'adult-host', '\A(?:[^/]*\.)?xxx(?:/|\z)'),
                   (4, 'casino-page', '(?:\A|[./-])casino[./-]'), (5, 'cart-step', '/cart/(?:add|checkout)\b'), (6, 'tag-listing', '/tag/[^/]+/page/[0-9]+'),
                   (7, 'address-literal', '\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|\z)')
        ), patterns AS (
            SELECT p.page_id, arg_min(m.name, m.place) AS pattern FROM parts p JOIN method m ON regexp_matches(p.host || p.path, m.pattern) GROUP BY p.page_id
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, CASE WHEN m.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               CASE WHEN f.rule IS NULL THEN m.pattern END AS pattern
        FROM parts p LEFT JOIN fitting f USING (page_id) LEFT JOIN patterns m USING (page_id)
    """,
    "op10_quality_rules": r"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        split AS (
            SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM texts
        ), windows AS (
            SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3
        ), named AS (
            SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM windows
        ), again AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM named) WHERE n > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS t(d) GROUP BY doc_id
        ), measured AS (
            SELECT s.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
                   length(regexp_replace(text, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_bangs
            FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id
        ), judged AS (
            SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
                 + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END)
                 + (CASE WHEN 10 * n_bangs > 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 2 THEN 32 ELSE 0 END)
                 + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END) AS bits FROM measured
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed_bits FROM judged
    """,
    "op8_substring_dedup": r"""
        WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words FROM documents),
        windows AS (SELECT doc_id, i, list_slice(words, i, i + 12) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13)),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS least FROM windows) WHERE doc_id > least),
        gone AS (SELECT doc_id, list_sort(list(DISTINCT i + d)) AS spots FROM hit, (SELECT unnest(range(0, 13)) AS d) GROUP BY doc_id),
        rest AS (SELECT s.doc_id, s.words, coalesce(g.spots, []) AS spots FROM split s LEFT JOIN gone g USING (doc_id)),
        kept AS (SELECT r.doc_id, string_agg(r.words[r.i], ' ' ORDER BY r.i) AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM rest) r
                 LEFT JOIN (SELECT doc_id, unnest(spots) AS i FROM gone) g ON g.doc_id = r.doc_id AND g.i = r.i WHERE g.i IS NULL GROUP BY r.doc_id)
        SELECT r.doc_id, len(r.words)::BIGINT AS n_words, len(r.spots)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM rest r LEFT JOIN kept k USING (doc_id)
    """,
}
