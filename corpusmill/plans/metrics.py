"""Queries over curves, model outputs, embeddings and ledgers.

Neural outputs are inputs here; where the sample tables have none, they are
made from documents by a fixed rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, embedding, stats
from .registry import query, table

CURVE = "c AS (SELECT user_id % 20 AS k, CAST(event_id AS DOUBLE) AS x, abs(value) + 1.0 AS v FROM events WHERE value IS NOT NULL)"


def curve(spark, d):
    """Events of twenty groups of users as curves over the event number."""
    return table(spark, d, "events").filter("value is not null").select((F.col("user_id") % 20).alias("k"), F.col("event_id").cast("double").alias("x"), (F.abs("value") + 1.0).alias("v"))


def _points(spark):
    return spark.range(20).select(F.col("id").alias("k"), F.explode(F.array(*(F.lit(float(x)) for x in (250, 500, 750)))).alias("x"))


POINTS = "p AS (SELECT k.range AS k, x FROM range(20) k, (VALUES (250.0::DOUBLE), (500.0::DOUBLE), (750.0::DOUBLE)) t(x))"


@query(f"WITH {CURVE}, {POINTS} SELECT p.k, p.x, n.x AS x_near, n.v FROM p LEFT JOIN LATERAL (SELECT x, v FROM c WHERE c.k = p.k AND abs(c.x - p.x) <= 25 ORDER BY abs(c.x - p.x), c.x LIMIT 1) n ON true")
def asof_nearest(spark, d):
    return curves.asof_nearest(_points(spark), curve(spark, d), "k", "x", "v", 25.0)


@query(f"WITH {CURVE} SELECT k, CASE WHEN count(*) FILTER (x >= 500 AND x < 515) = 1 THEN max(v) FILTER (x >= 500 AND x < 515) END AS v FROM c GROUP BY 1")
def range_unique(spark, d):
    return curves.value_at(curve(spark, d), "k", "x", "v", 500.0, 15.0)


@query(f"WITH {CURVE}, g AS (SELECT *, round_even(x / 100, 0) * 100 AS grid FROM c) SELECT k, grid, arg_max(v, x) AS v FROM g WHERE abs(x - grid) <= 20 GROUP BY 1, 2")
def grid_snap(spark, d):
    return curves.grid_snap(curve(spark, d), "k", "x", "v", 100.0, 20.0)


@query(f"""WITH {CURVE}, {POINTS} SELECT p.k, p.x AS at, round(CASE WHEN lo.x IS NULL THEN hi.v WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.v ELSE lo.v + (p.x - lo.x) / (hi.x - lo.x) * (hi.v - lo.v) END, 6) AS v
FROM p LEFT JOIN LATERAL (SELECT x, v FROM c WHERE c.k = p.k AND c.x <= p.x ORDER BY x DESC LIMIT 1) lo ON true LEFT JOIN LATERAL (SELECT x, v FROM c WHERE c.k = p.k AND c.x >= p.x ORDER BY x LIMIT 1) hi ON true""")
def interp_linear(spark, d):
    return curves.interpolate(curve(spark, d), _points(spark).withColumnRenamed("x", "at"), "k", "x", "v", "at").withColumn("v", F.round("v", 6))


@query(f"WITH {CURVE}, t AS (SELECT *, coalesce((x - lag(x) OVER w) * (v + lag(v) OVER w) / 2, 0) AS p FROM c WINDOW w AS (PARTITION BY k ORDER BY x)) SELECT k, x, round(sum(p) OVER (PARTITION BY k ORDER BY x), 3) AS integral FROM t")
def trapezoid(spark, d):
    return curves.trapezoid(curve(spark, d), "k", "x", "v").select("k", "x", F.round("integral", 3).alias("integral"))


@query(f"WITH {CURVE} SELECT k, x, (v - lag(v) OVER w) / (x - lag(x) OVER w) AS slope, round(ln(v / lag(v) OVER w) / (x - lag(x) OVER w), 6) AS log_rate FROM c WINDOW w AS (PARTITION BY k ORDER BY x)")
def slopes(spark, d):
    return curves.slopes(curve(spark, d), "k", "x", "v").select("k", "x", "slope", F.round("log_rate", 6).alias("log_rate"))


@query(f"WITH {CURVE}, t AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY x) AS b FROM c) SELECT k, x FROM t WHERE floor(x / 200) > coalesce(floor(b / 200), 0) OR (x >= 333 AND coalesce(b, -1) < 333)")
def eval_cadence(spark, d):
    return curves.crossings(curve(spark, d), "k", "x", 200.0, [333.0]).select("k", "x")


@query(f"WITH {CURVE}, m AS (SELECT k, min(v) AS least FROM c GROUP BY 1), f AS (SELECT c.k, floor, ln(x) AS lx, ln(v - floor) AS ly FROM c JOIN m USING (k), (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) t(floor) WHERE x > 0 AND floor < least) SELECT k, floor, count(*) AS n, round(regr_slope(ly, lx), 6) AS slope, round(regr_syy(ly, lx) - regr_sxy(ly, lx) ** 2 / regr_sxx(ly, lx), 4) AS sse FROM f GROUP BY 1, 2")
def loglog_fit(spark, d):
    return curves.loglog_fit(curve(spark, d), "k", "x", "v", [0.0, 0.5]).select("k", "floor", "n", F.round("slope", 6).alias("slope"), F.round("sse", 4).alias("sse"))


@query(f"WITH {CURVE}, p AS (SELECT * FROM c WHERE x >= 1 AND log2(x) = round(log2(x))), g AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY x) AS gain FROM p) SELECT k, x, round(gain, 6) AS gain, round(gain / nullif(lag(gain) OVER (PARTITION BY k ORDER BY x), 0), 6) AS gain_ratio FROM g")
def recovery_doublings(spark, d):
    rows = curves.doublings(curve(spark, d), "k", "x", "v", 1.0)
    return rows.select("k", "x", F.round("gain", 6).alias("gain"), F.round("gain_ratio", 6).alias("gain_ratio"))


@query("SELECT event_id, round(CASE WHEN event_id < 10 THEN event_id / 10 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, (event_id - 10) / 990))) END, 9) AS cosine, round(CASE WHEN event_id < 10 THEN event_id / 10 ELSE 1 END, 9) AS constant, round(CASE WHEN event_id < 10 THEN event_id / 10 WHEN event_id < 800 THEN 1 ELSE greatest(0, 1 - (event_id - 800) / 200) END, 9) AS wsd FROM events")
def lr_schedules(spark, d):
    x = F.col("event_id").cast("double")
    rows = table(spark, d, "events")
    return rows.select("event_id", F.round(curves.cosine_lr(x, 1000.0, 1.0, 10.0, 0.1), 9).alias("cosine"), F.round(curves.constant_lr(x, 1.0, 10.0), 9).alias("constant"), F.round(curves.wsd_lr(x, 1000.0, 1.0, 10.0, 0.2), 9).alias("wsd"))


@query("WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, median(value) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std, max(value) FILTER (r = greatest(round_even(0.95 * n, 0), 1)) AS p95 FROM e GROUP BY 1")
def latency_stats(spark, d):
    rows = table(spark, d, "events").filter("value is not null")
    return stats.latency_stats(rows, ["event_type"], "value").select("event_type", "n", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), "p95")


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, CAST(len(s) AS BIGINT) AS n, s[least(len(s) - 1, CAST(floor(0.5 * len(s)) AS BIGINT)) + 1] AS q50, s[least(len(s) - 1, CAST(floor(0.9 * len(s)) AS BIGINT)) + 1] AS q90 FROM s")
def quantile_digest(spark, d):
    rows = table(spark, d, "events").filter("value is not null")
    return stats.quantile_digest(rows, ["event_type"], "value", [50, 90]).withColumn("n", F.col("n").cast("bigint"))


NLL = "n AS (SELECT doc_id AS doc, lang, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) // 4 + 1 AS BIGINT) AS tokens, strlen(text) * (0.5 + (doc_id % 7) / 10.0::DOUBLE) AS nll FROM documents)"


def doc_nll(spark, d):
    """Stand-in for model output: a likelihood per document by a fixed rule."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("doc"), "lang", F.octet_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("chars"), (F.floor(F.length("text") / 4) + 1).cast("bigint").alias("tokens"), (F.octet_length("text") * (0.5 + (F.col("doc_id") % 7) / 10.0)).alias("nll"))


@query(f"WITH {NLL} SELECT lang, round(sum(nll), 4) AS total_nll, CAST(sum(bytes) AS BIGINT) AS n_bytes, round(sum(nll) / (ln(2) * sum(bytes)), 9) AS bpb, round(sum(nll) / (ln(2) * sum(chars)), 9) AS bpc, round(exp(sum(nll) / sum(tokens)), 6) AS token_ppl FROM n GROUP BY 1")
def bpb_by_lang(spark, d):
    return stats.lm_metrics(doc_nll(spark, d), ["lang"]).select("lang", F.round("total_nll", 4).alias("total_nll"), "n_bytes", F.round("bpb", 9).alias("bpb"), F.round("bpc", 9).alias("bpc"), F.round("token_ppl", 6).alias("token_ppl"))


@query(f"WITH {NLL} SELECT lang AS subject, count(*) AS n_items, CAST(sum(CAST(doc % 4 = doc % 3 AS INT)) AS BIGINT) AS n_correct, avg(CAST(doc % 4 = doc % 3 AS INT)) AS accuracy FROM n GROUP BY ROLLUP (lang)")
def accuracy_rollup(spark, d):
    rows = doc_nll(spark, d).select(F.col("lang").alias("subject"), (F.col("doc") % 4).alias("gold"), (F.col("doc") % 3).alias("pred"))
    return stats.accuracy(rows, "subject")


@query()
def bootstrap_accuracy(spark, d):
    rows = doc_nll(spark, d).select(F.col("lang").alias("subject"), (F.col("doc") % 4 == F.col("doc") % 3).alias("correct"))
    return stats.bootstrap_accuracy(rows, ["subject"])


@query()
def bootstrap_gap(spark, d):
    """Resampled intervals; the tests hold the point estimates against sums."""
    n = doc_nll(spark, d)
    return stats.paired_ratio_bootstrap(n.select("lang", "doc", F.col("nll").alias("nll_a"), F.col("bytes").alias("bytes_a"), (F.col("nll") * 1.1).alias("nll_b"), F.col("bytes").alias("bytes_b")), ["lang"])


@query(f"WITH {NLL}, m AS (SELECT median(doc % 5) AS m FROM n WHERE doc % 5 > 0) SELECT CASE WHEN doc % 5 = 0 THEN 'zero' WHEN doc % 5 <= m THEN 'low' ELSE 'high' END AS stratum, count(*) AS n FROM n, m GROUP BY 1")
def exposure_strata(spark, d):
    return stats.exposure_strata(doc_nll(spark, d).withColumn("n_removed", F.col("doc") % 5)).groupBy("stratum").agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM v")
def emb_reference_stats(spark, d):
    rows = embedding.reference_stats(table(spark, d, "embeddings"), "embedding")
    return rows.select(F.col("n").cast("bigint").alias("n"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("SELECT a.vec_id AS id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) / 2)), 4) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def emb_pair_mean(spark, d):
    v = _vectors(spark, d)
    slots = v.filter("id % 2 = 0").select("id", F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    return embedding.parent_mean(slots, v).select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], e) AS c FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS k FROM c) SELECT query_id, vec_id, round(c, 4) AS cosine FROM r WHERE k <= 20")
def emb_cosine_topk(spark, d):
    """The query set of searches, every vector with an id divisible by 100, against all rows."""
    v = _vectors(spark, d)
    return embedding.cosine_topk(v.filter("id % 100 = 0"), v, 20).select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 4).alias("cosine"))


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS k, count(*) OVER () AS n FROM embeddings), m AS (SELECT sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) AS move FROM r a JOIN r b ON b.k = a.k % a.n + 1) SELECT count(*) AS n_moved, round(avg(move), 4) AS mean_move FROM m WHERE move > 0")
def emb_permute_moves(spark, d):
    v = _vectors(spark, d)
    return embedding.moves(v, embedding.permute(v, v.select("id"))).select("n_moved", F.round("mean_move", 4).alias("mean_move"))


@query("SELECT doc_id, length(text) * 2 * 24 * 2 * 64 * 2 / 1048576.0::DOUBLE AS mb FROM documents")
def kv_cache(spark, d):
    """As if a character were a token."""
    per = embedding.kv_bytes_per_token(F.lit(24), F.lit(2), F.lit(64))
    return table(spark, d, "documents").select("doc_id", embedding.kv_cache_mb(F.length("text").cast("bigint"), per).alias("mb"))


@query("SELECT n.n_name AS nation, r.r_name AS region, count(*) AS n_customers, round(sum(CAST(o.o_totalprice AS DOUBLE)), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2")
def star_join_smoke(spark, d):
    """No counterpart among the reported operators: joins and aggregates over the star tables."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("n_customers"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))
