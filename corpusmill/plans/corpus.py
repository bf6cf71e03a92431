"""Queries over documents and pages: cleaning, labels, deduplication, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from ..operators import dedup, domain, quality, stats
from ..sources import readers, sinks
from .registry import query, table

LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"
SQUEEZED = r"regexp_replace(text, '[ \t\n\x{2028}\x{2029}]+', '', 'g')"
GRAM5 = "CASE WHEN length(c) < 40 THEN 1.0 ELSE len(list_distinct(list_transform(range(1, length(c) - 3), lambda i: substr(c, i, 5)))) / (length(c) - 4) END"
REPEAT = "CASE WHEN len(l) < 4 THEN 0.0 ELSE len(list_filter(l, lambda x: len(list_filter(l, lambda y: y = x)) > 1)) / len(l) END"


def _share(pattern: str) -> str:
    return f"CASE WHEN length(text) = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '{pattern}')) / length(text) END"


HANGUL = r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"
CHECKED = f"""
parts AS (SELECT *, {LINES} AS l, {SQUEEZED} AS c FROM documents),
checked AS (SELECT doc_id, text, lang, source, CASE
  WHEN length(text) < 200 THEN 'too_short' WHEN length(text) > 200000 THEN 'too_long'
  WHEN {_share(HANGUL)} < 0.0 THEN 'low_hangul' WHEN {_share('[A-Za-z]')} < 0.5 THEN 'low_latin'
  WHEN {_share(HANGUL)} > 0.05 THEN 'korean_in_english' WHEN {_share('[0-9]')} > 0.3 THEN 'digit_heavy'
  WHEN coalesce(list_sum(list_transform(l, lambda x: length(x))) / len(l), 0) < 10 THEN 'short_lines'
  WHEN {REPEAT} > 0.3 THEN 'repeated_lines' WHEN {GRAM5} < 0.25 THEN 'repeated_ngram' END AS reject_reason FROM parts)
"""
UNIT = "CAST(('0x' || substr(sha256('42:' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0"
SPLIT = f"CASE WHEN {UNIT} < 0.9 THEN 'train' WHEN {UNIT} < 0.9::DOUBLE + 0.05::DOUBLE THEN 'dev' ELSE 'final_test' END"


def documents(spark, d):
    """Documents with an explicit order and a content hash."""
    return table(spark, d, "documents").withColumn("ord", F.col("doc_id")).withColumn("sha256", F.sha2("text", 256))


def split_documents(spark, d):
    return documents(spark, d).withColumn("split", dedup.hash_split_sha256(F.col("doc_id")))


@query(f"""WITH {CHECKED}, first AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM checked WHERE reject_reason IS NULL)
SELECT {SPLIT} AS split, lang AS domain, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM first WHERE k = 1 GROUP BY 1, 2""")
def corpus_summary(spark, d):
    """The whole cleaning path: exact duplicates, quality, split, summary.

    Equal texts have equal verdicts, so each text is judged once, after its copies went.
    """
    kept = quality.passing(quality.check(dedup.exact_dedup(documents(spark, d)), "en"))
    rows = kept.withColumn("split", dedup.hash_split_sha256(F.col("doc_id")))
    return sinks.summary(rows.select("split", F.col("lang").alias("domain"), F.length("text").alias("char_count"), F.octet_length("text").alias("byte_count")))


@query(f"WITH {CHECKED} SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents) AS percent FROM checked GROUP BY 1")
def quality_reasons(spark, d):
    return quality.reason_stats(quality.check(documents(spark, d), "en"))


@query(f"SELECT doc_id, length(text) AS n_chars, {_share(HANGUL)} AS hangul_ratio, {_share('[A-Za-z]')} AS latin_ratio, {_share('[0-9]')} AS digit_ratio FROM documents")
def char_class_stats(spark, d):
    rows = documents(spark, d).select("doc_id", T.char_stats(F.col("text")).alias("s"))
    return rows.select("doc_id", F.col("s.n_chars").cast("bigint").alias("n_chars"), "s.hangul_ratio", "s.latin_ratio", "s.digit_ratio")


@query(f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, {REPEAT} AS repeat_ratio, coalesce(list_sum(list_transform(l, lambda x: length(x))) / len(l), 0) AS mean_chars FROM (SELECT doc_id, {LINES} AS l FROM documents)")
def line_statistics(spark, d):
    rows = documents(spark, d).select("doc_id", T.lines(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("bigint").alias("n_lines"), T.line_repeat_ratio(F.col("l")).alias("repeat_ratio"), T.mean_line_chars(F.col("l")).alias("mean_chars"))


@query(f"SELECT doc_id, {GRAM5} AS ratio FROM (SELECT doc_id, {SQUEEZED} AS c FROM documents)")
def distinct_ngram(spark, d):
    rows = documents(spark, d).select("doc_id", T.squeezed(F.col("text")).alias("c"))
    return rows.select("doc_id", T.distinct_ngram_ratio(F.col("c")).alias("ratio"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \t\n\x{2028}\x{2029}]+'), lambda x: x <> '')) AS BIGINT) AS n_words, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def word_and_byte_counts(spark, d):
    return documents(spark, d).select("doc_id", T.count_words(F.col("text")).cast("bigint").alias("n_words"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(nfc_normalize(text), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS sha256 FROM documents")
def normalized_sha256(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("sha256"))


@query("SELECT floor(least(latin, 0.99) * 10) AS bin, count(*) AS n FROM (SELECT CASE WHEN a = 0 THEN 0.0 ELSE 1.0 END AS latin FROM (SELECT len(regexp_extract_all(text, '[A-Za-z]')) AS a FROM documents)) GROUP BY 1".replace("floor(least(latin, 0.99) * 10)", "CAST(floor(least(latin, 0.99) * 10) AS BIGINT)"))
def latin_share_bins(spark, d):
    share = F.least(T.latin_share(F.col("text")), F.lit(0.99))
    return documents(spark, d).groupBy(F.floor(share * 10).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def exact_dedup(spark, d):
    return dedup.exact_dedup(documents(spark, d)).select("doc_id", "sha256")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return documents(spark, d).groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(f"WITH {CHECKED} SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM checked WHERE reject_reason IS NULL) WHERE k <= 20 OR source = ''")
def host_cap(spark, d):
    kept = quality.passing(quality.check(documents(spark, d), "en"))
    return dedup.host_cap(kept, "source", "ord", 20).select("doc_id", "source")


@query("SELECT source AS host, count(*) AS n_seen, least(count(*), 45) AS n_kept, CAST(count(*) > 45 AS INTEGER) AS capped FROM documents GROUP BY 1")
def hosts_tsv(spark, d):
    return dedup.host_stats(documents(spark, d).withColumnRenamed("source", "host"), "host", 45)


@query(f"SELECT doc_id, {SPLIT} AS split FROM documents")
def hash_split_sha256(spark, d):
    return split_documents(spark, d).select("doc_id", "split")


@query()
def hash_split_blake2b(spark, d):
    """DuckDB has no BLAKE2b; the tests hold it against hashlib."""
    return documents(spark, d).select("doc_id", dedup.hash_split(F.col("doc_id")).alias("split"))


@query(f"SELECT {SPLIT} AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def split_by_lang(spark, d):
    return split_documents(spark, d).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query(f"WITH s AS (SELECT *, {SPLIT} AS split FROM documents) SELECT lang, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'dev') AS n_dev, CAST(coalesce(sum(strlen(text)) FILTER (split = 'dev'), 0) AS BIGINT) AS dev_bytes FROM s GROUP BY 1")
def split_domain_distribution(spark, d):
    dev = F.col("split") == "dev"
    return split_documents(spark, d).groupBy("lang").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(dev).alias("n_dev"), F.coalesce(F.sum(F.when(dev, F.octet_length("text"))), F.lit(0)).alias("dev_bytes"))


@query(f"SELECT split, count(*) AS n, count(DISTINCT h) AS n_distinct, count(*) - count(DISTINCT h) AS n_inner_duplicates FROM (SELECT {SPLIT} AS split, sha256(text) AS h FROM documents) GROUP BY 1")
def split_audit(spark, d):
    return dedup.split_audit(split_documents(spark, d))


@query(f"WITH s AS (SELECT DISTINCT {SPLIT} AS split, sha256(text) AS h FROM documents) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM s a JOIN s b ON a.h = b.h AND a.split < b.split GROUP BY 1, 2")
def split_leakage(spark, d):
    return dedup.leakage(split_documents(spark, d))


@query(f"WITH s AS (SELECT {SPLIT} AS split, sha256(text) AS h FROM documents) SELECT h AS sha256 FROM s WHERE split = 'train' INTERSECT SELECT h FROM s WHERE split <> 'train'")
def split_intersect(spark, d):
    rows = split_documents(spark, d)
    return rows.filter("split = 'train'").select("sha256").intersect(rows.filter("split <> 'train'").select("sha256"))


@query(f"WITH p AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS k, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents WHERE {SPLIT} = 'dev' GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY k)) AS dataset_hash FROM p")
def dataset_hash(spark, d):
    return hashing.dataset_hash(split_documents(spark, d).filter("split = 'dev'"), "sha256", "doc_id")


@query(f"SELECT doc_id, source, lang AS domain, 'NA' AS date, lang AS language, sha256(text) AS sha256, {SPLIT} AS split, length(text) AS char_count, strlen(text) AS byte_count FROM documents")
def manifest(spark, d):
    rows = split_documents(spark, d).select("doc_id", "source", F.col("lang").alias("domain"), F.lit("").alias("date"), F.col("lang").alias("language"), "text", "split")
    return sinks.manifest(rows).drop("latin_share", "hangul_ratio").withColumn("char_count", F.col("char_count").cast("bigint")).withColumn("byte_count", F.col("byte_count").cast("bigint"))


@query("SELECT DISTINCT lang FROM documents UNION SELECT role FROM conversations")
def union_distinct(spark, d):
    return table(spark, d, "documents").select("lang").union(table(spark, d, "conversations").select("role")).distinct()


@query()
def near_dup_edges(spark, d):
    """Published MinHash signature; the tests hold it against plain Python."""
    signed = documents(spark, d).select("ord", dedup.minhash_udf()(F.col("text")).alias("signature"))
    return dedup.near_edges(signed)


@query()
def near_dup_clusters(spark, d):
    signed = documents(spark, d).select("ord", dedup.minhash_udf()(F.col("text")).alias("signature"))
    return dedup.near_dedup(signed)


HOST = r"regexp_replace(lower(regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^\.+', '')"


def _host_case() -> str:
    out = []
    for r in domain.RULES:
        tests = [f"host = '{s}' OR suffix(host, '.{s}')" for s in r.suffixes] + [f"contains(host, '{s}')" for s in r.contains]
        out.append(f"WHEN {' OR '.join(tests)} THEN '{r.domain}'")
    return "CASE " + " ".join(out) + " END"


@query(f"SELECT page_id, {HOST} AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", T.host_of(F.col("url")).alias("host"))


@query(f"SELECT page_id, host, coalesce({_host_case()}, CASE WHEN len(regexp_extract_all(html, '[A-Za-z]')) > 0 THEN 'ko_en_mixed' END, 'web_general') AS domain FROM (SELECT *, {HOST} AS host FROM pages)")
def domain_by_host(spark, d):
    return domain.classify(table(spark, d, "pages"), text="html").select("page_id", "host", "domain")


@query(f"SELECT domain, count(*) AS n FROM (SELECT coalesce({_host_case()}, 'web_general') AS domain FROM (SELECT {HOST} AS host FROM pages)) GROUP BY 1")
def domain_distribution(spark, d):
    rows = table(spark, d, "pages").select(F.coalesce(domain.classify_host(T.host_of(F.col("url"))), F.lit(domain.FALLBACK)).alias("domain"))
    return rows.groupBy("domain").agg(F.count("*").alias("n"))


@query(f"SELECT host, count(*) AS n, count(*) / (SELECT count(*) FROM pages) AS share FROM (SELECT {HOST} AS host FROM pages) GROUP BY 1 ORDER BY n DESC, host LIMIT 30")
def host_survey(spark, d):
    rows = table(spark, d, "pages").select(T.host_of(F.col("url")).alias("host"))
    return domain.host_survey(rows).orderBy(F.desc("n"), "host").limit(30)


def _audit(spark, d):
    checked = quality.check(documents(spark, d), "en").select("doc_id", F.when(F.col("reject_reason").isNull(), "1").otherwise("0").alias("pred"))
    return checked.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("gold")), "doc_id")


AUDIT = f"WITH {CHECKED}, a AS (SELECT CAST(quality AS VARCHAR) AS gold, CASE WHEN reject_reason IS NULL THEN '1' ELSE '0' END AS pred FROM checked JOIN labels USING (doc_id))"


@query(f"{AUDIT} SELECT gold, pred, count(*) AS n FROM a GROUP BY 1, 2")
def audit_confusion(spark, d):
    return domain.confusion(_audit(spark, d), "gold", "pred")


@query(f"{AUDIT}, x AS (SELECT gold AS label, 1 AS g, 0 AS p, CAST(gold = pred AS INT) AS h FROM a UNION ALL SELECT pred, 0, 1, 0 FROM a) SELECT label, CAST(sum(g) AS BIGINT) AS n_gold, CAST(sum(p) AS BIGINT) AS n_predicted, CAST(sum(h) AS BIGINT) AS n_hit, sum(h) / nullif(sum(p), 0) AS precision, sum(h) / nullif(sum(g), 0) AS recall FROM x GROUP BY 1")
def audit_precision_recall(spark, d):
    return domain.precision_recall(_audit(spark, d), "gold", "pred")


@query()
def audit_halves(spark, d):
    return table(spark, d, "pages").select("page_id", dedup.audit_half(F.concat(F.lit("s"), F.col("page_id").cast("string"))).alias("half"))


@query()
def stable_sample(spark, d):
    return dedup.stable_sample(table(spark, d, "pages").select("page_id", "url"), "page_id", 50, seed=7)


@query()
def content_signals(spark, d):
    """Korean patterns on texts without Hangul; the tests have Korean ones."""
    return documents(spark, d).select("doc_id", *(c.cast("bigint").alias(n) for n, c in domain.signals(F.col("text")).items()))


CLEAN = "regexp_replace(lower(nfc_normalize(text)), '\\s+', '', 'g')"
CONTAMINATION = f"""
WITH i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(length(c) - 11, 1)), lambda k: substr(c, k, 13))) AS g FROM (SELECT item_id, {CLEAN} AS c FROM benchmark)),
dg AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(length(c) - 11, 1)), lambda k: substr(c, k, 13))) AS g FROM (SELECT {CLEAN} AS c FROM documents)),
f AS (SELECT item_id, count(*) AS n_grams, count(dg.g) AS n_hit FROM i LEFT JOIN dg USING (g) GROUP BY 1),
r AS (SELECT item_id, coalesce(n_grams, 0) AS n_grams, coalesce(n_hit, 0) AS n_hit, coalesce(n_hit / nullif(n_grams, 0), 0) AS coverage FROM benchmark LEFT JOIN f USING (item_id))
"""
KIND = "CASE WHEN n_grams < 10 THEN CASE WHEN coverage >= 0.5 THEN 'short_high' ELSE 'short' END WHEN coverage >= 0.5 THEN 'high' WHEN coverage >= 0.2 THEN 'middle' WHEN n_hit > 0 THEN 'low' ELSE 'none' END"


@query(f"{CONTAMINATION} SELECT *, {KIND} AS kind FROM r")
def contamination_coverage(spark, d):
    return stats.contamination(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query(f"{CONTAMINATION} SELECT {KIND} AS kind, count(*) AS n FROM r GROUP BY 1")
def contamination_classes(spark, d):
    return contamination_coverage(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_replace(substr(text, 1, 180), '[\\t\\n\\r]', ' ', 'g') AS preview FROM documents")
def text_preview(spark, d):
    return documents(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def url_slug(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 100) AS BIGINT) // 3) AS step FROM documents) SELECT doc_id, lang FROM documents, n WHERE doc_id // 100 % step = 0 AND doc_id // 100 // step < 3")
def strided_scan(spark, d):
    """Evenly spaced stretches of 100 rows of documents, whose ids are their row numbers however they lie in files."""
    return readers.strided(spark, f"{d}/documents.parquet", ["doc_id", "lang"], max_docs=300, per_group=100, row="doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL")
def multi_file_scan(spark, d):
    return readers.read_documents(spark, [f"{d}/documents.parquet"], ["doc_id", "text", "lang", "source", "no_such_column"]).select("doc_id", "lang", "source")
