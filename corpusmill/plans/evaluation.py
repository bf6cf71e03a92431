"""Queries around evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation
from . import metrics
from .registry import query, table
from .vocabulary import word_docs


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings")
def choice_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", evaluation.argmax_first(F.col("embedding")).alias("pred"))


@query("WITH i AS (SELECT doc_id, text AS q FROM documents), s AS (SELECT doc_id, q || chr(10) || 'A. a' || chr(10) || 'B. b' || chr(10) || 'C. c' || chr(10) || 'D. d' || chr(10) AS b FROM i) SELECT doc_id, b || '정답:' AS target, b || '정답: ' || ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS shot FROM s")
def item_prompts(spark, d):
    """The whole text as the question."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("q"))
    choices = [F.lit(x) for x in "abcd"]
    return rows.select("doc_id", evaluation.format_item(F.col("q"), choices).alias("target"), evaluation.format_item(F.col("q"), choices, (F.col("doc_id") % 4).cast("int")).alias("shot"))


@query("WITH s AS (SELECT doc_id, list_transform(range(0, CAST(doc_id % 6 AS BIGINT)), lambda k: length(text) // (k + 2)) AS l, length(text) AS n FROM documents), f AS (SELECT doc_id, len(l) AS m, l, n, list_filter(range(0, len(l) + 1), lambda k: n + coalesce(list_sum(list_transform(l[k + 1:], lambda x: x + 2)), 0) <= 4000 OR k = len(l)) AS ok FROM s) SELECT doc_id, CAST(m - ok[1] AS INTEGER) AS n_shot FROM f")
def few_shot_fit(spark, d):
    """The whole text is the target, its beginnings are the shots; what fits 4,000 characters."""
    rows = table(spark, d, "documents")
    n = F.length("text")
    shots = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.substr("text", F.lit(1), F.floor(n / (k + 2)).cast("int")))
    rows = rows.select("doc_id", "text", F.slice(shots, 1, (F.col("doc_id") % 6).cast("int")).alias("shots"))
    return rows.select("doc_id", evaluation.few_shot(F.col("text"), F.col("shots"), F.length, 4000)["n_shot"].alias("n_shot"))


@query("SELECT event_id, strftime(to_timestamp(1704067200 + event_id)::TIMESTAMP + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events".replace("to_timestamp(1704067200 + event_id)::TIMESTAMP", "make_timestamp((1704067200 + event_id) * 1000000)"))
def local_times(spark, d):
    utc = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", evaluation.local_time(utc, "Asia/Seoul").alias("local"))


@query("SELECT doc_id, n_class FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[éèêñüöäß]')) AS BIGINT) AS n_class, length(text) AS n FROM documents) WHERE n_class >= 20 AND n_class >= 0.005 * n")
def dense_subset(spark, d):
    return evaluation.dense_subset(table(spark, d, "documents"), "[éèêñüöäß]").select("doc_id", F.col("n_class").cast("bigint").alias("n_class"))




@query("SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(length(text) // 4 + 1) AS BIGINT) AS n_tokens, sum(strlen(text)) / sum(length(text) // 4 + 1) AS bytes_per_tok FROM documents GROUP BY 1")
def evaluated_compression(spark, d):
    """All documents, each with a row of the evaluation."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang", "text")
    seen = metrics.doc_nll(spark, d).select("doc", F.col("bytes").alias("raw_bytes"), "tokens")
    return evaluation.evaluated_compression(docs, seen, ["lang"])


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT (SELECT count(*) FROM a WHERE user_id NOT IN (SELECT user_id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE user_id NOT IN (SELECT user_id FROM a)) AS only_b, (SELECT count(*) FROM a WHERE user_id NOT IN (SELECT user_id FROM b)) + (SELECT count(*) FROM b WHERE user_id NOT IN (SELECT user_id FROM a)) = 0 AS same")
def same_sets(spark, d):
    e = table(spark, d, "events")
    return evaluation.same_sets(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id")


@query()
def paired_difference(spark, d):
    rows = metrics.doc_nll(spark, d).select("lang", (F.col("doc") % 4 < 2).alias("correct_a"), (F.col("doc") % 5 < 2).alias("correct_b"))
    return evaluation.paired_difference(rows, ["lang"])


@query()
def pool_order(spark, d):
    return evaluation.pool_order(table(spark, d, "documents").select(F.col("doc_id").alias("ord")), 500, seed=3)


@query(r"SELECT lang, CAST(sum(len(regexp_extract_all(lower(text), '[a-z]+'))) AS BIGINT) AS n_tokens, CAST(sum(len(list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> ''))) AS BIGINT) AS n_units, sum(len(regexp_extract_all(lower(text), '[a-z]+'))) / sum(len(list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> ''))) AS fertility FROM documents GROUP BY 1")
def word_fertility(spark, d):
    return evaluation.fertility(word_docs(spark, d), ["lang"])




@query(f"WITH {metrics.CURVE}, s AS (SELECT k, list(x ORDER BY x) AS x, list(v ORDER BY x) AS v FROM c GROUP BY 1 HAVING count(*) >= 4), d AS (SELECT k, x, v, v[1] - v[2] AS d1, v[2] - v[3] AS d2 FROM s), r AS (SELECT *, CASE WHEN d1 > 0 AND d2 > 0 AND d2 < d1 THEN d2 / d1 END AS r, (x[-1] - x[3]) / (x[3] - x[2]) AS n FROM d) SELECT k, x[-1] AS x, round(v[3] - d2 * r * (1 - r ** n) / (1 - r), 6) AS predicted, round(v[-1], 6) AS observed, round(v[-1] - (v[3] - d2 * r * (1 - r ** n) / (1 - r)), 6) AS excess FROM r")
def plateau_null(spark, d):
    rows = evaluation.null_models(metrics.curve(spark, d), "k", "x", "v")
    return rows.select("k", "x", *(F.round(c, 6).alias(c) for c in ("predicted", "observed", "excess")))