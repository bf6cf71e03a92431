"""Queries over words as tokens: frequencies, pruning, pairs, surgery, packing, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, stats, vocab
from .registry import query, table

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def word_docs(spark, d):
    """Documents with their words and the sizes that metrics need."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ord"), "lang", "text", words.alias("words"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.length("text").cast("bigint").alias("n_chars"), T.count_words(F.col("text")).cast("bigint").alias("n_words")).withColumn("n_tokens", F.size("words").cast("bigint"))


def tokens(spark, d):
    return word_docs(spark, d).select("doc_id", "lang", F.explode("words").alias("token"))


def word_vocab(spark, d):
    """Distinct words; a word's id is itself."""
    return tokens(spark, d).select("token").distinct().withColumn("token_id", F.col("token"))


TOKENS = f"t AS (SELECT doc_id, lang, unnest({WORDS}) AS token FROM documents)"
PAIRS = f"w AS (SELECT doc_id, {WORDS} AS w FROM documents), p AS (SELECT w[i] AS left_id, w[i + 1] AS right_id, count(*) AS count FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1) GROUP BY 1, 2)"


@query(f"WITH {TOKENS} SELECT token, count(*) AS count_total, count(*) FILTER (lang = 'de') AS count_de, count(*) FILTER (lang = 'en') AS count_en, count(*) FILTER (lang = 'es') AS count_es, count(*) FILTER (lang = 'fr') AS count_fr FROM t GROUP BY 1")
def token_freq_pivot(spark, d):
    return vocab.token_counts(tokens(spark, d), langs=["de", "en", "es", "fr"])


@query(f"WITH {TOKENS} SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_types FROM t GROUP BY 1")
def word_token_stats(spark, d):
    return tokens(spark, d).groupBy("lang").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_types"))


@query(f"WITH {PAIRS} SELECT * FROM p ORDER BY count DESC, left_id, right_id LIMIT 100")
def pair_mining_topk(spark, d):
    return vocab.pair_counts(word_docs(spark, d), "words").orderBy(F.desc("count"), "left_id", "right_id").limit(100)


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (ORDER BY count DESC, left_id, right_id) AS rank FROM p ORDER BY count DESC, left_id, right_id LIMIT 500),
v AS (SELECT DISTINCT unnest(w) AS token FROM w), n AS (SELECT *, left_id || right_id AS new_token FROM r WHERE left_id || right_id NOT IN (SELECT token FROM v))
SELECT rank, left_id AS left, right_id AS right, new_token, count AS gain FROM (SELECT *, row_number() OVER (PARTITION BY new_token ORDER BY rank) AS k FROM n) WHERE k = 1""")
def donor_select(spark, d):
    found = vocab.donors(vocab.pair_counts(word_docs(spark, d), "words"), word_vocab(spark, d), 500)
    return found.select(F.col("rank").cast("bigint").alias("rank"), "left", "right", "new_token", "gain")


STATS = f"{TOKENS}, s AS (SELECT token, count(*) AS count_total, count(*) FILTER (lang = 'en') AS count_en, count(*) FILTER (lang = 'de') AS count_de FROM t GROUP BY 1), e AS (SELECT *, row_number() OVER (ORDER BY count_total, token) AS prune_rank FROM s WHERE length(token) > 2 AND count_en < 5 AND count_de < 3)"


def _ranked(spark, d):
    counts = vocab.token_counts(tokens(spark, d), langs=["de", "en"]).withColumn("token_id", F.col("token"))
    rows = counts.withColumn("is_leaf", F.lit(True)).withColumn("is_protected", F.length("token") <= 2)
    return vocab.eligible(rows, rows.select("token"), rows.filter("is_protected").select("token_id"), {"count_en": 5, "count_de": 3})


@query(f"WITH {STATS} SELECT token, count_total, prune_rank FROM e ORDER BY prune_rank LIMIT 200")
def prune_candidates(spark, d):
    return _ranked(spark, d).orderBy("prune_rank").limit(200).select("token", "count_total", F.col("prune_rank").cast("bigint").alias("prune_rank"))


@query(f"WITH {STATS}, c AS (SELECT prune_rank, sum(count_total) OVER (ORDER BY prune_rank) AS cum FROM e) SELECT prune_rank, CAST(cum AS BIGINT) AS cum_count, cum / 1000000.0::DOUBLE AS cum_share FROM c WHERE prune_rank IN (10, 100, 1000)")
def prune_cumulative(spark, d):
    return vocab.cumulative(_ranked(spark, d), [10, 100, 1000], 1_000_000).withColumn("prune_rank", F.col("prune_rank").cast("bigint"))


SIZES = f"s AS (SELECT doc_id, lang, CAST(len({WORDS}) AS BIGINT) AS n_tokens, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents)"


@query(f"WITH {SIZES} SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, sum(n_tokens) / sum(n_chars) AS tok_per_char, sum(n_tokens) / sum(n_bytes) AS tok_per_byte, sum(n_bytes) / sum(n_tokens) AS bytes_per_tok, sum(n_tokens) / sum(n_words) AS tok_per_word FROM s GROUP BY 1")
def compression_by_lang(spark, d):
    return stats.compression(word_docs(spark, d), ["lang"])


@query(f"WITH {SIZES} SELECT lang, CAST(floor(quantile_cont(n_tokens, 0.5)) AS BIGINT) AS p50_len, CAST(floor(quantile_cont(n_tokens, 0.9)) AS BIGINT) AS p90_len, CAST(floor(quantile_cont(n_tokens, 0.95)) AS BIGINT) AS p95_len, CAST(floor(quantile_cont(n_tokens, 0.99)) AS BIGINT) AS p99_len, max(n_tokens) AS max_len FROM s GROUP BY 1")
def length_percentiles(spark, d):
    return stats.length_percentiles(word_docs(spark, d), ["lang"], "n_tokens")


@query(f"WITH {SIZES} SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS tier, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_chars) AS BIGINT) AS n_chars, sum(n_tokens) / sum(n_chars) AS tok_per_char FROM s GROUP BY ROLLUP (1)")
def lang_tiers_rollup(spark, d):
    return stats.tiers(word_docs(spark, d), F.when(F.col("lang") == "en", "english").otherwise("other"))


@query(f"WITH {SIZES}, c AS (SELECT *, sum(n_tokens + 1) OVER (ORDER BY doc_id) AS stop FROM s WHERE n_tokens > 0), x AS (SELECT *, stop - n_tokens - 1 AS start FROM c), e AS (SELECT *, unnest(range(CAST(floor(start / 512) AS BIGINT), CAST(floor((stop - 1) / 512) AS BIGINT) + 1)) AS chunk FROM x) SELECT chunk, min(doc_id) AS first_ord, max(doc_id) AS last_ord, CAST(sum(least(stop, (chunk + 1) * 512) - greatest(start, chunk * 512)) AS BIGINT) AS n_tokens, count(*) AS n_docs FROM e WHERE chunk < (SELECT floor(max(stop) / 512) FROM c) GROUP BY 1")
def pack_chunks(spark, d):
    return budget.pack_chunks(word_docs(spark, d), 512)


@query(f"WITH {SIZES} SELECT doc_id, CAST(cum AS BIGINT) AS cum_bytes FROM (SELECT doc_id, n_bytes, sum(n_bytes) OVER (ORDER BY doc_id) AS cum FROM s) WHERE cum - n_bytes < 200000")
def budget_prefix(spark, d):
    return budget.budget_prefix(word_docs(spark, d), 200_000).select("doc_id", "cum_bytes")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def skip_take(spark, d):
    return budget.skip_take(word_docs(spark, d), 100, 50).select("doc_id")


@query("SELECT substr(string_agg(text, '' ORDER BY doc_id), 1, 5000) AS prompt FROM documents")
def prompt_prefix(spark, d):
    return budget.prompt(word_docs(spark, d), 5000)


@query(f"WITH {SIZES}, b AS (SELECT CAST(doc_id / 1 AS BIGINT) AS chunk, n_bytes FROM s), u AS (SELECT chunk // 8 AS update, sum(n_bytes) AS n_bytes, count(*) AS n FROM b GROUP BY 1), c AS (SELECT update, n_bytes, sum(n_bytes) OVER (ORDER BY update) AS cum FROM u WHERE n = 8) SELECT update, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(cum AS BIGINT) AS cum_bytes FROM c WHERE update <= (SELECT min(update) FROM c WHERE cum >= 300000)")
def first_update_at(spark, d):
    return budget.updates(word_docs(spark, d).select(F.col("doc_id").alias("chunk"), "n_bytes"), 2, 4, 300_000)


@query(f"WITH w AS (SELECT doc_id, list_transform({WORDS}, lambda x: strlen(x)) AS b FROM documents), c AS (SELECT doc_id, b, CASE WHEN len(b) > 0 THEN list_transform(range(0, len(b), 64), lambda i: b[i + 1:i + 64]) ELSE [] END AS c FROM w) SELECT doc_id, CAST(coalesce(list_sum(b), 0) AS BIGINT) AS total_bytes, CAST(coalesce(list_sum(list_transform(c, lambda x: CASE WHEN len(x) >= 2 THEN list_sum(x) - x[1] ELSE 0 END)), 0) AS BIGINT) AS scored_bytes, CAST(coalesce(list_sum(list_transform(c, lambda x: CASE WHEN len(x) >= 2 THEN x[1] ELSE 0 END)), 0) AS BIGINT) AS first_bytes, CAST(coalesce(list_sum(list_transform(c, lambda x: CASE WHEN len(x) < 2 THEN list_sum(x) ELSE 0 END)), 0) AS BIGINT) AS dropped_bytes, CAST(len(c) AS BIGINT) AS n_chunks FROM c")
def scored_bytes(spark, d):
    rows = word_docs(spark, d).select("doc_id", F.transform("words", lambda x: F.octet_length(x).cast("bigint")).alias("token_bytes"))
    return budget.scored_bytes(rows, 64).withColumn("n_chunks", F.col("n_chunks").cast("bigint"))


@query(f"WITH {TOKENS}, v AS (SELECT DISTINCT token FROM t WHERE length(token) = 9), f AS (SELECT v.token, count(t.token) AS n FROM v LEFT JOIN t ON t.token = v.token AND t.lang = 'en' GROUP BY 1), s AS (SELECT n * 8.0::DOUBLE AS x FROM f) SELECT count(*) AS n, sum(x) AS total, list_sort(list(x))[count(*) // 2 + 1] AS upper_median, avg(x) AS mean, max(x) AS max, count(*) FILTER (x = 0) AS n_zero, count(*) FILTER (x > 0 AND x < 10) AS n_under_10, count(*) FILTER (x >= 10 AND x < 100) AS n_under_100, count(*) FILTER (x >= 100 AND x < 1000) AS n_under_1000, count(*) FILTER (x >= 1000) AS n_over FROM s")
def token_exposure(spark, d):
    new = word_vocab(spark, d).filter(F.length("token") == 9).select("token")
    seen = tokens(spark, d).filter("lang = 'en'").groupBy("token").agg(F.count("*").alias("n"))
    return vocab.fire_digest(new.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("fires_sample")), 8.0)


@query(f"WITH {TOKENS}, x AS (SELECT DISTINCT token FROM t WHERE length(token) = 9) SELECT count(DISTINCT t.token) AS n_active, (SELECT count(*) FROM x) AS n_donors, count(DISTINCT t.token) / (SELECT count(*) FROM x) AS rate FROM t JOIN x USING (token) WHERE lang = 'en'")
def activation_rate(spark, d):
    new = word_vocab(spark, d).filter(F.length("token") == 9).select("token_id")
    return vocab.activation_rate(tokens(spark, d).filter("lang = 'en'").select(F.col("token").alias("token_id")), new)


@query(f"WITH {TOKENS}, x AS (SELECT DISTINCT token FROM t) SELECT CAST(least(length(token), 5) AS BIGINT) AS length, count(*) AS n, count(*) FILTER (token LIKE '%e%') AS n_removed FROM x WHERE token LIKE 't%' GROUP BY 1")
def vocab_census(spark, d):
    rows = word_vocab(spark, d).select(F.col("token").alias("surface"), F.col("token").startswith("t").alias("has_han"), F.col("token").contains("e").alias("removed"))
    return vocab.census(rows).withColumn("length", F.col("length").cast("bigint"))
