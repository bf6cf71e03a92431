"""Queries over run tables, verdicts, vocabularies and vectors that fixed rules make of the sample tables.

Every table is read whole: runs come from events, seeds and arms from line items,
evidence by customer from orders, a vocabulary with its merges from the words of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import budget, curves, embedding, evaluation, ledger, overview, stats, verdicts, vocab
from ..sources import readers, sinks
from ..streaming import watch
from . import metrics
from .registry import query, table
from .vocabulary import TOKENS, tokens, word_docs

# --- Runs: an event is a ledger row -----------------------------------------------------

STATUS = {"signup": "start", "purchase": "ok", "error": "fail", "view": "start", "click": "abort"}
PHASE = {"signup": "data", "purchase": "cpt", "error": "eval", "view": "tok", "click": "unknown"}
_case = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in m.items()) + " END"
TS = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
RUNS = f"r AS (SELECT event_id AS line, 'run-' || (user_id * 7 + CAST(date_part('day', ts) AS BIGINT)) AS run_id, {_case('event_type', STATUS)} AS status, {_case('event_type', PHASE)} AS phase, {TS} AS ts_utc, value, event_type, user_id FROM events)"


def runs(spark, d):
    """(line, run_id, status, phase, ts_utc, value, event_type, user_id): a run is a user's day."""
    mapped = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("event_type")]
    run = F.concat(F.lit("run-"), (F.col("user_id") * 7 + F.dayofmonth("ts")).cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("line"), run.alias("run_id"), mapped(STATUS).alias("status"), mapped(PHASE).alias("phase"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"), "value", "event_type", "user_id")


@query(f"WITH {RUNS} SELECT run_id, ts_utc FROM r WHERE status = 'abort' AND run_id NOT IN (SELECT run_id FROM r WHERE status = 'ok')")
def ledger_orphans(spark, d):
    r = runs(spark, d)
    return ledger.orphans(r.filter("status = 'abort'"), r.filter("status = 'ok'"), "run_id").select("run_id", "ts_utc")


@query(f"WITH {RUNS}, s AS (SELECT run_id, max(ts_utc) AS started FROM r WHERE status = 'start' AND event_type = 'signup' GROUP BY 1), a AS (SELECT run_id, max(ts_utc) AS active FROM r WHERE event_type = 'view' GROUP BY 1) SELECT run_id FROM s LEFT JOIN a USING (run_id) WHERE run_id NOT IN (SELECT run_id FROM r WHERE status IN ('ok', 'fail', 'abort')) AND greatest(started, coalesce(active, '')) < '2024-01-20T11:00:00Z'")
def dead_runs(spark, d):
    r = runs(spark, d)
    return ledger.dead_runs(r.filter("status <> 'start' or event_type = 'signup'"), r.filter("event_type = 'view'"), "2024-01-20T12:00:00Z")


@query(f"WITH {RUNS} SELECT run_id, status, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id, status ORDER BY line) AS k FROM r) WHERE k > 1")
def ledger_dups(spark, d):
    return ledger.duplicates(runs(spark, d), ["run_id", "status"]).select("run_id", "status", "line")


@query(f"WITH {RUNS} SELECT run_id, arg_max(ts_utc, line) AS ts_utc, max(line) AS line FROM r WHERE status = 'ok' GROUP BY 1")
def latest_ok_run(spark, d):
    return evaluation.latest_ok(runs(spark, d).withColumnRenamed("line", "pos")).select("run_id", "ts_utc", F.col("pos").alias("line"))


@query(f"WITH {RUNS} SELECT line, run_id FROM r ORDER BY line DESC LIMIT 25")
def last_ledger_rows(spark, d):
    return evaluation.last_rows(runs(spark, d), 25, "line").select("line", "run_id")


@query(f"WITH {RUNS} SELECT run_id, 'phase' AS rule FROM r WHERE phase = 'unknown'")
def ledger_enums(spark, d):
    return ledger.check_enums(runs(spark, d))


CELLS = "[CASE WHEN event_id % 11 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END, CASE WHEN event_id % 13 = 0 THEN 'no hash' ELSE sha256(CAST(event_id AS VARCHAR)) END, event_type, props, 'NA', CASE WHEN event_id % 17 = 0 THEN '' ELSE 'x' END, CAST(event_id AS VARCHAR), '1', 'w', 'ntp', CASE WHEN event_id % 19 = 0 THEN 'abc' ELSE substr(sha256(CAST(event_id AS VARCHAR)), 1, 40) END, 'NA']"


@query(f"""WITH c AS (SELECT event_id + 2 AS line, event_id, {CELLS} AS f FROM events),
x AS (SELECT line, 'field count' AS rule, '13' AS detail FROM c WHERE event_id % 23 = 0
UNION ALL SELECT line, 'crlf', '' FROM c WHERE event_id % 29 = 0
UNION ALL SELECT line, 'time', f[1] FROM c WHERE event_id % 11 = 0 AND event_id % 23 <> 0
UNION ALL SELECT line, 'sha256', 'clock_check_sha256' FROM c WHERE event_id % 13 = 0 AND event_id % 23 <> 0
UNION ALL SELECT line, 'blank cell', 'local_midpoint_utc' FROM c WHERE event_id % 17 = 0 AND event_id % 23 <> 0
UNION ALL SELECT line, 'git commit', 'abc' FROM c WHERE event_id % 19 = 0 AND event_id % 23 <> 0)
SELECT 'clock_checks' AS "table", line, rule, detail FROM x UNION ALL SELECT 'clock_checks', 1, 'header', 'ts_utc'""")
def ledger_lines(spark, d):
    """The checks of a stored table's lines, on clock checks with faults of every kind; the faults are in the data by rule."""
    e, i = table(spark, d, "events"), F.col("event_id")
    sha = F.sha2(i.cast("string"), 256)
    cells = [F.when(i % 11 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.when(i % 13 == 0, "no hash").otherwise(sha), F.col("event_type"), F.col("props"), F.lit("NA"), F.when(i % 17 == 0, "").otherwise("x"), i.cast("string"), F.lit("1"), F.lit("w"), F.lit("ntp"), F.when(i % 19 == 0, "abc").otherwise(F.substring(sha, 1, 40)), F.lit("NA")]
    text = F.concat(F.array_join(F.array(*cells), "\t"), F.when(i % 23 == 0, "\tmore").otherwise(""), F.when(i % 29 == 0, "\r").otherwise(""))
    lines = e.select((i + 2).alias("line"), text.alias("text")).unionByName(spark.createDataFrame([(1, "ts_utc")], "line long, text string"))
    return ledger.check_lines(lines, "clock_checks")


@query(f"WITH {RUNS} SELECT run_id, status, line FROM r WHERE status IN ('ok', 'fail') AND user_id >= 75")
def ledger_new_results(spark, d):
    r = runs(spark, d).select("run_id", "status", "line", "user_id")
    return ledger.new_results(r.filter("user_id < 75"), r).select("run_id", "status", "line")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'A' THEN CAST(l_partkey AS BIGINT) ELSE CAST(floor(l_suppkey * 40000 / 32768) AS BIGINT) END AS n, CASE l_returnflag WHEN 'A' THEN 'ledger' WHEN 'N' THEN 'derived' END AS source FROM lineitem")
def update_counts(spark, d):
    flag = F.col("l_returnflag")
    found = ledger.update_count(F.when(flag == "A", F.col("l_partkey")), F.when(flag == "N", F.col("l_suppkey") * 40000))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", found.alias("u")).select("l_orderkey", "l_linenumber", "u.n", "u.source")


@query("WITH o AS (SELECT 'o' || o_orderkey AS run_id, o_totalprice, o_orderstatus, o_orderpriority FROM orders) SELECT run_id, 'price' AS problem FROM o WHERE NOT o_totalprice < 200000 UNION ALL SELECT run_id, 'finished' FROM o WHERE o_orderstatus <> 'F' UNION ALL SELECT run_id, 'priority' FROM o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def frozen_problems(spark, d):
    o = table(spark, d, "orders").withColumn("run_id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    return ledger.frozen_problems(o, {"price": F.col("o_totalprice") < 200_000, "finished": F.col("o_orderstatus") == "F", "priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")})


@query("SELECT event_id, round((2 * s + 40 + event_id % 31) / 2.0 - (s + value), 6) AS \"offset\", CAST(40 + event_id % 31 AS BIGINT) AS rtt, abs((2 * s + 40 + event_id % 31) / 2.0 - (s + value)) <= 20 AS ok FROM (SELECT *, CAST(event_id * 1000 AS DOUBLE) AS s FROM events WHERE value IS NOT NULL)")
def clock_probes(spark, d):
    sent = (F.col("event_id") * 1000).cast("double")
    e = table(spark, d, "events").filter("value is not null")
    rows = e.select("event_id", ledger.clock_probe(sent + F.col("value"), sent, sent + 40 + F.col("event_id") % 31, 20.0).alias("p"))
    return rows.select("event_id", F.round("p.offset", 6).alias("offset"), F.col("p.rtt").cast("bigint").alias("rtt"), "p.ok")


@query(f"WITH {RUNS} SELECT run_id, ts_utc, line FROM r WHERE status = 'ok' AND ts_utc <= '2024-01-15T00:00:00Z' ORDER BY ts_utc DESC, line LIMIT 1")
def latest_clock_check(spark, d):
    """The last successful check of the day before; one row."""
    return ledger.latest_check(runs(spark, d).filter("status = 'ok'"), "2024-01-15T00:00:00Z").select("run_id", "ts_utc", "line")


@query(f"WITH {RUNS}, x AS (SELECT user_id, min(line) AS line FROM r GROUP BY 1) SELECT user_id FROM x WHERE user_id NOT IN (SELECT user_id FROM r WHERE event_type = 'error' AND value > 100)")
def registry_insert(spark, d):
    """Users that aren't in the registry yet, each once."""
    r = runs(spark, d)
    return ledger.insert_missing(r.select("user_id"), r.filter("event_type = 'error' and value > 100").select("user_id").distinct(), ["user_id"])


@query(f"WITH {RUNS} SELECT run_id, ts_utc, line, 'NA' AS added FROM r")
def ledger_migrated(spark, d):
    old = runs(spark, d).select("run_id", "ts_utc", "line")
    return ledger.migrate(old, ["run_id", "ts_utc", "line", "added"])


@query(f"WITH {RUNS} SELECT ts_utc, run_id, status, props AS note FROM r JOIN events ON events.event_id = r.line WHERE status IN ('fail', 'abort') OR props LIKE '%nan%'")
def ledger_alerts(spark, d):
    notes = table(spark, d, "events").select(F.col("event_id").alias("line"), F.col("props").alias("note"))
    return watch.failures(runs(spark, d).join(notes, "line"))


@query("WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id AS run_id, count(*) AS n, max(epoch_us(ts)) AS last_us FROM s GROUP BY user_id, k")
def activity_sessions(spark, d):
    """Stalls of activity: a session ends when nothing came for half an hour (as a batch; the tests run it as a stream)."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.stalls(rows).select("run_id", "n", F.unix_micros("last").alias("last_us"))


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS value_a, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS value_b, 'unknown' AS kind, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'unrecorded' ELSE 'different' END AS status, true AS blocks FROM customer WHERE (c_custkey % 5 = 0) <> (c_custkey % 7 = 0) OR (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0)")
def config_diff(spark, d):
    """Two sides of every customer's segment: one lacks some keys, the other lacks and changes some."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    a = c.filter("k % 5 <> 0").select("key", "value")
    b = c.filter("k % 7 <> 0").select("key", F.when(F.col("k") % 3 == 0, "changed").otherwise(F.col("value")).alias("value"))
    return ledger.config_diff(a, b, ["run_id"], ["wall_sec"], ["seed"], ["lr"])


# --- Seeds, arms and verdicts -----------------------------------------------------------

SEEDS = "m AS (SELECT CASE l_returnflag WHEN 'A' THEN 'treat' WHEN 'N' THEN 'control' ELSE 'other' END AS arm, l_linenumber AS seed, l_linestatus AS domain, avg(l_extendedprice / l_quantity) / 1000 AS bpb FROM lineitem GROUP BY 1, 2, 3)"


def seed_metrics(spark, d):
    """(arm, seed, domain, bpb): mean unit prices by return flag, line number and status."""
    arm = F.when(F.col("l_returnflag") == "A", "treat").when(F.col("l_returnflag") == "N", "control").otherwise("other")
    rows = table(spark, d, "lineitem").groupBy(arm.alias("arm"), F.col("l_linenumber").alias("seed"), F.col("l_linestatus").alias("domain"))
    return rows.agg((F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 1000).alias("bpb"))


@query(f"WITH {SEEDS} SELECT a.seed, a.domain, round(a.bpb, 7) AS treat, round(b.bpb, 7) AS control, round(a.bpb - b.bpb, 7) AS diff FROM m a JOIN m b ON a.seed = b.seed AND a.domain = b.domain AND a.arm = 'treat' AND b.arm = 'control'")
def bpb_gap_pairs(spark, d):
    return verdicts.seed_pairs(seed_metrics(spark, d), "treat", "control").select("seed", "domain", *(F.round(c, 7).alias(c) for c in ("treat", "control", "diff")))


@query(f"WITH {SEEDS} SELECT arm, domain, count(*) AS n, CASE WHEN count(*) = 7 THEN round(stddev_samp(bpb), 7) END AS sigma FROM m GROUP BY 1, 2")
def seed_sigma(spark, d):
    return stats.seed_spread(seed_metrics(spark, d), ["arm", "domain"], "bpb", 7).select("arm", "domain", "n", F.round("sigma", 7).alias("sigma"))


@query(f"WITH {SEEDS}, a AS (SELECT arm, domain, seed // 4 AS third, count(*) AS n, avg(bpb) AS mean, stddev_samp(bpb) AS sd FROM m GROUP BY 1, 2, 3) SELECT arm, domain, third, n, round(mean, 7) AS mean, round(sd, 7) AS sd, CASE WHEN n = 3 THEN round(mean - 4.302653 * sd / sqrt(n), 6) END AS ci_lo, CASE WHEN n = 3 THEN round(mean + 4.302653 * sd / sqrt(n), 6) END AS ci_hi FROM a")
def seed_describe(spark, d):
    rows = seed_metrics(spark, d).withColumn("third", F.floor(F.col("seed") / 4).cast("int"))
    return stats.describe(rows, ["arm", "domain", "third"], "bpb").select("arm", "domain", "third", "n", F.round("mean", 7).alias("mean"), F.round("sd", 7).alias("sd"), F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"))


EVIDENCE = "e AS (SELECT o_custkey AS c, avg(o_totalprice) FILTER (o_orderstatus = 'F') / 1e5 AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') / 1e5 AS b, avg(o_totalprice) FILTER (o_orderstatus = 'P') / 1e5 AS p, stddev_samp(o_totalprice) / 1e6 AS s FROM orders GROUP BY 1)"


def evidence(spark, d):
    """(c, a, b, p, s): a customer's mean order by status, and the deviation; sides without orders are null."""
    of = lambda x: F.avg(F.when(F.col("o_orderstatus") == x, F.col("o_totalprice"))) / 1e5
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(of("F").alias("a"), of("O").alias("b"), of("P").alias("p"), (F.stddev_samp("o_totalprice") / 1e6).alias("s"))


@query(f"WITH {EVIDENCE} SELECT c, CASE WHEN a > b THEN round((a - p) / (a - b), 6) END AS recovery FROM e")
def recovery_rate(spark, d):
    return evidence(spark, d).select("c", F.round(verdicts.recovery(F.col("a"), F.col("p"), F.col("b")), 6).alias("recovery"))


@query(f"WITH {EVIDENCE} SELECT c, CASE WHEN abs(a - b) / s <= 2 THEN 'indistinct' WHEN abs(a - b) / s IS NOT NULL THEN CASE WHEN a - b > 0 THEN 'worse' ELSE 'better' END END AS verdict, abs(a - b) / s > 4.9684 AS beyond, CASE WHEN a - b IS NULL OR s IS NULL THEN NULL WHEN a - b > greatest(2 * s, 0.005) THEN 'worse' WHEN a - b < -greatest(2 * s, 0.005) THEN 'better' ELSE 'indistinct' END AS floor FROM e")
def sigma_rule(spark, d):
    delta = F.col("a") - F.col("b")
    v = verdicts.sigma_rule(delta, F.col("s"), F.col("s") / 2)
    return evidence(spark, d).select("c", v["verdict"].alias("verdict"), v["beyond"].alias("beyond"), verdicts.floor_rule(delta, F.col("s")).alias("floor"))


@query(f"WITH {EVIDENCE} SELECT c, CASE WHEN a > 0 THEN round((a - b) / a, 7) END AS rho, CASE WHEN (a - b) / a <= 0.25 THEN 'small' WHEN (a - b) / a <= 0.5 THEN 'middle' WHEN a > 0 AND b IS NOT NULL THEN 'large' END AS kind FROM e")
def rho_class(spark, d):
    r = verdicts.rho(F.col("a"), F.col("b"))
    return evidence(spark, d).select("c", F.round(r, 7).alias("rho"), verdicts.rho_class(r).alias("kind"))


@query(f"WITH {EVIDENCE}, x AS (SELECT c, a / 4 AS ctrl, (a - b) / 40 - s / 4 AS lo, (a - b) / 40 + s / 4 AS hi, p - a AS warm, a > b AS ko, b > p AS en, a AS sat FROM e) SELECT c, CASE WHEN ctrl <= 0.25 THEN 'floor' WHEN lo >= -0.02 AND hi <= 0.02 THEN 'equivalent' WHEN hi < 0 THEN 'worse' WHEN lo > 0 THEN 'better' WHEN lo IS NOT NULL THEN 'undecided' END AS verdict, lo > 0 AS confirmed, warm >= 0.010 AS warm, sat / 2 > 0.5 AND sat / 2 <= 0.9 AS saturated, CASE WHEN ko AND en THEN 'reproduced' WHEN ko = false OR en = false THEN 'differs' ELSE 'unrecorded' END AS status FROM x")
def equivalence(spark, d):
    """Interval rules, the warm gate, saturation and the status of a reproduction, null where there is no evidence."""
    a, b, p, s = (F.col(c) for c in "abps")
    lo, hi = (a - b) / 40 - s / 4, (a - b) / 40 + s / 4
    return evidence(spark, d).select("c", verdicts.equivalence(a / 4, lo, hi).alias("verdict"), verdicts.confirmed(lo).alias("confirmed"), verdicts.warm_gate(p - a).alias("warm"), verdicts.saturated(a / 2).alias("saturated"), verdicts.reproduction_status(a > b, b > p).alias("status"))


@query(f"WITH {EVIDENCE} SELECT c, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE abs(round_even(a, 6) - b) < 5e-7 END AS ab, CASE WHEN a IS NULL THEN NULL ELSE c % 2 = 1 END AS aa FROM e")
def reproduced_sums(spark, d):
    a, b = F.col("a"), F.col("b")
    return evidence(spark, d).select("c", verdicts.reproduced(a, b).alias("ab"), verdicts.reproduced(a, F.bround(a, 6) + F.when(F.col("c") % 2 == 0, 1e-6).otherwise(0.0)).alias("aa"))


@query("WITH t AS (SELECT p_size AS k, avg(p_retailprice) / 500 AS ratio FROM part GROUP BY 1) SELECT k, round(ratio, 6) AS ratio, abs(ratio - 2.058) <= 0.05 AS inside FROM t WHERE k <= 40 ORDER BY abs(ratio - 2.058), k LIMIT 1")
def calibration_gate(spark, d):
    trials = table(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg((F.avg("p_retailprice") / 500).alias("ratio"))
    return verdicts.calibration_gate(trials, most=40).withColumn("ratio", F.round("ratio", 6))


@query("WITH p AS (SELECT l_orderkey AS k, l_discount AS a, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax END AS b FROM lineitem) SELECT k, CASE WHEN count(*) FILTER (b IS NULL) = 0 THEN bool_and(abs(a - b) <= 0.001) END AS agrees FROM p GROUP BY 1")
def predecay(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_discount").alias("a"), F.when(F.col("l_tax") > 0.07, None).otherwise(F.col("l_tax")).alias("b"))
    return verdicts.predecay_agrees(rows, ["k"], "a", "b")


@query("WITH c AS (SELECT user_id AS k, CAST(event_id AS DOUBLE) AS x, CASE WHEN event_id < 800 THEN 1.0 ELSE greatest(0, 1 - (event_id - 800) / 200.0) END AS expected FROM events), r AS (SELECT *, CASE WHEN k % 3 = 0 THEN 1.0 ELSE expected END AS lr FROM c) SELECT k, bool_and(abs(lr - expected) <= 1e-3 * abs(expected)) AND bool_or(x > 800) AS conforms FROM r GROUP BY 1")
def schedule_conforms(spark, d):
    x = F.col("x")
    expected = curves.wsd_lr(x, 1000.0, 1.0, 0.0, 0.2)
    rows = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").cast("double").alias("x")).withColumn("lr", F.when(F.col("k") % 3 == 0, F.lit(1.0)).otherwise(expected))
    return verdicts.schedule_conforms(rows, ["k"], "lr", expected, x > 800)


@query("WITH a AS (SELECT doc_id AS doc, strlen(text) AS x FROM documents), b AS (SELECT doc_id AS doc, CASE WHEN lang = 'de' THEN strlen(text) + 1 ELSE strlen(text) END AS y FROM documents) SELECT 'document ' || min(doc) || ': raw bytes differ' AS problem FROM a JOIN b USING (doc) WHERE x <> y")
def pair_problem(spark, d):
    t = table(spark, d, "documents")
    n = F.octet_length("text")
    side = lambda c: t.select(F.col("doc_id").alias("doc"), c.cast("bigint").alias("raw_bytes"))
    return verdicts.pair_integrity(side(n), side(F.when(F.col("lang") == "de", n + 1).otherwise(n)))


@query(f"WITH {metrics.NLL}, m AS (SELECT lang, doc % 50 AS part, sum(nll) AS t, CAST(sum(bytes) AS BIGINT) AS b FROM n GROUP BY 1, 2), k AS (SELECT lang, part // 2 AS part, t, b FROM m WHERE part % 2 = 0 OR part < 25) SELECT lang, part, CASE WHEN count(*) = 1 THEN round(max(t / (ln(2) * b)), 7) END AS bpb FROM k GROUP BY 1, 2")
def recomputed_bpb(spark, d):
    """Bits per byte from stored sums, null where a key has several rows."""
    n = metrics.doc_nll(spark, d).groupBy("lang", (F.col("doc") % 50).alias("part")).agg(F.sum("nll").alias("total_nll"), F.sum("bytes").alias("n_bytes"))
    rows = n.filter("part % 2 = 0 or part < 25").withColumn("part", F.floor(F.col("part") / 2))
    return evaluation.recomputed(rows, ["lang", "part"]).withColumn("bpb", F.round("bpb", 7))


STRATA = f"{metrics.NLL}, mid AS (SELECT median(doc % 5) AS m FROM n WHERE doc % 5 > 0), st AS (SELECT *, CASE WHEN doc % 5 = 0 THEN 'zero' WHEN doc % 5 <= m THEN 'low' ELSE 'high' END AS stratum FROM n, mid)"


@query(f"WITH {STRATA} SELECT stratum, count(*) AS n_docs, min(doc % 5) AS least_count, max(doc % 5) AS most_count, round(sum(nll) / (ln(2) * sum(bytes)), 7) AS bpb_a, round(sum(nll * 1.1) / (ln(2) * sum(bytes)), 7) AS bpb_b, round(sum(nll * 1.1) / (ln(2) * sum(bytes)) - sum(nll) / (ln(2) * sum(bytes)), 7) AS diff, true AS ordered FROM st GROUP BY 1")
def strata_gaps(spark, d):
    """Both sides by stratum; whether the resampled interval holds the point is one column."""
    n = metrics.doc_nll(spark, d).withColumn("n_removed", F.col("doc") % 5)
    pairs = n.select("doc", "n_removed", F.col("nll").alias("nll_a"), F.col("bytes").alias("bytes_a"), (F.col("nll") * 1.1).alias("nll_b"), F.col("bytes").alias("bytes_b"))
    rows = stats.strata_intervals(pairs)
    return rows.select("stratum", "n_docs", "least_count", "most_count", *(F.round(c, 7).alias(c) for c in ("bpb_a", "bpb_b", "diff")), ((F.col("ci_lo") <= F.col("diff")) & (F.col("diff") <= F.col("ci_hi"))).alias("ordered"))


@query("SELECT 'o' || o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS raw_bytes_seen, o_orderkey * 7000 + 100 AS tokens_seen, CAST(floor((o_orderkey * 7000 + 100) / 4096) AS BIGINT) AS updates, CAST(floor((o_orderkey * 7000 + 100) / 4096) AS BIGINT) * 4096 AS tokens_applied, (o_orderkey * 7000 + 100) % 4096 AS tokens_left FROM orders")
def accounting_audit(spark, d):
    o = table(spark, d, "orders")
    run, seen = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderkey") * 7000 + 100
    rows = o.select(run.alias("run_id"), F.floor("o_totalprice").alias("raw_bytes_seen"), seen.alias("tokens_seen"), F.floor(seen / 4096).alias("updates"))
    return overview.accounting(rows, o.select(run.alias("run_id"), F.lit(512).alias("seq_len"), F.lit(2).alias("micro"), F.lit(4).alias("accumulate")))


@query(f"WITH {SEEDS}, t AS (SELECT seed, domain, max(bpb) FILTER (arm = 'treat') AS b0, max(bpb) FILTER (arm = 'other') AS bf, max(bpb) FILTER (arm = 'control') AS cf FROM m GROUP BY 1, 2) SELECT seed, domain, round(bf - cf, 7) AS gap, CASE WHEN b0 > cf THEN round((b0 - bf) / (b0 - cf), 4) END AS recovery, round(b0 - cf / 2, 7) AS d0 FROM t")
def gap_audit(spark, d):
    m = seed_metrics(spark, d)
    arm = lambda x: m.filter(F.col("arm") == x)
    rows = overview.gaps(arm("treat"), arm("other"), arm("control"), arm("control").withColumn("bpb", F.col("bpb") / 2), ["seed", "domain"])
    return rows.select("seed", "domain", F.round("gap", 7).alias("gap"), F.round("recovery", 4).alias("recovery"), F.round("d0", 7).alias("d0"))


@query(f"WITH {SEEDS}, x AS (SELECT o.seed, o.bpb AS x, f.bpb AS y FROM m o JOIN m f ON o.seed = f.seed AND o.arm = 'treat' AND f.arm = 'treat' AND o.domain = 'O' AND f.domain = 'F' WHERE o.seed <= 3) SELECT count(*) AS n, round(avg(y - x), 7) AS mean, round(stddev_samp(y - x), 7) AS sd, round(avg(y - x) - 4.302653 * stddev_samp(y - x) / sqrt(3), 6) AS ci_lo, round(avg(y - x) + 4.302653 * stddev_samp(y - x) / sqrt(3), 6) AS ci_hi FROM x")
def paired_audit(spark, d):
    """Three seeds, as the interval of three wants them."""
    m = seed_metrics(spark, d).filter("arm = 'treat' and seed <= 3").withColumnRenamed("bpb", "recovery")
    r = overview.paired_recovery(m.filter("domain = 'O'"), m.filter("domain = 'F'"))
    return r.select("n", F.round("mean", 7).alias("mean"), F.round("sd", 7).alias("sd"), F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"))


# --- A vocabulary of the documents' words -----------------------------------------------

VOCAB = f"{TOKENS}, w AS (SELECT token, count(*) AS count_total FROM t GROUP BY 1), v AS (SELECT token, count_total, row_number() OVER (ORDER BY token) - 1 AS token_id FROM w), m AS (SELECT row_number() OVER (ORDER BY count_total DESC, token) - 1 AS rank, l, r, token FROM (SELECT v.token, v.count_total, substr(v.token, 1, length(v.token) - 1) AS l, substr(v.token, length(v.token), 1) AS r FROM v WHERE length(v.token) > 1) x WHERE l IN (SELECT token FROM w) AND r IN (SELECT token FROM w)), leaf AS (SELECT v.*, token NOT IN (SELECT l FROM m UNION SELECT r FROM m) AS is_leaf FROM v), pruned AS (SELECT token FROM leaf WHERE is_leaf ORDER BY count_total, token LIMIT 40)"


def vocabulary(spark, d):
    """Words with their counts and alphabetical ids, and merges of a word and a letter that make a word, frequent ones first."""
    counts = tokens(spark, d).groupBy("token").agg(F.count("*").alias("count_total"))
    v = budget.global_rank(counts, [F.col("token")], "token_id").withColumn("token_id", F.col("token_id") - 1)
    n = F.length("token")
    parts = v.filter(n > 1).select("token", "count_total", F.substr("token", F.lit(1), n - 1).alias("left"), F.substr("token", n, F.lit(1)).alias("right"))
    known = v.select("token")
    made = parts.join(known.withColumnRenamed("token", "left"), "left", "left_semi").join(known.withColumnRenamed("token", "right"), "right", "left_semi")
    m = budget.global_rank(made, [-F.col("count_total"), F.col("token")], "rank").select((F.col("rank") - 1).alias("rank"), "left", "right")
    return v, m


def _pruned(v, m):
    return vocab.with_leaf(v, m).filter("is_leaf").orderBy("count_total", "token").limit(40).select("token")


@query(f"WITH {VOCAB} SELECT token, token_id, is_leaf FROM leaf")
def vocab_leaves(spark, d):
    v, m = vocabulary(spark, d)
    return vocab.with_leaf(v, m).select("token", "token_id", "is_leaf")


@query(f"WITH {VOCAB} SELECT token, row_number() OVER (ORDER BY token_id) - 1 AS token_id FROM v WHERE token NOT IN (SELECT token FROM pruned)")
def surgery_drop(spark, d):
    v, m = vocabulary(spark, d)
    return vocab.drop_tokens(v, m, _pruned(v, m))[0].withColumn("token_id", F.col("token_id").cast("bigint"))


@query(f"WITH {VOCAB} SELECT rank, l AS \"left\", r AS \"right\" FROM m WHERE token NOT IN (SELECT token FROM pruned)")
def surgery_drop_merges(spark, d):
    v, m = vocabulary(spark, d)
    return vocab.drop_tokens(v, m, _pruned(v, m))[1]


@query(f"WITH {VOCAB}, n AS (SELECT token_id, row_number() OVER (ORDER BY token_id) - 1 AS new_id FROM v WHERE token NOT IN (SELECT token FROM pruned)) SELECT token_id AS old_id, new_id FROM n WHERE token_id <> new_id")
def surgery_drop_ids(spark, d):
    v, m = vocabulary(spark, d)
    return vocab.drop_tokens(v, m, _pruned(v, m))[2].withColumn("new_id", F.col("new_id").cast("bigint"))


REPLACED = f"{VOCAB}, slots AS (SELECT token_id, row_number() OVER (ORDER BY token_id) AS k FROM v WHERE token IN (SELECT token FROM pruned)), fresh AS (SELECT token, row_number() OVER (ORDER BY count_total DESC, token) AS k, count_total FROM w WHERE length(token) > 3), placed AS (SELECT token_id, 'q' || token AS new_token, 'q' AS l, token AS r, k FROM slots JOIN fresh USING (k))"


def _replaced(spark, d):
    v, m = vocabulary(spark, d)
    best = v.filter(F.length("token") > 3).orderBy(F.desc("count_total"), "token").limit(60)
    new = budget.global_rank(best, [-F.col("count_total"), F.col("token")], "rank").select("rank", F.lit("q").alias("left"), F.col("token").alias("right"), F.concat(F.lit("q"), F.col("token")).alias("new_token"))
    return vocab.replace_tokens(v.select("token", "token_id"), m, _pruned(v, m), new)


@query(f"WITH {REPLACED} SELECT token, token_id FROM v WHERE token NOT IN (SELECT token FROM pruned) UNION ALL SELECT new_token, token_id FROM placed")
def surgery_replace(spark, d):
    return _replaced(spark, d)[0]


@query(f"WITH {REPLACED} SELECT rank, l AS \"left\", r AS \"right\" FROM m WHERE token NOT IN (SELECT token FROM pruned) UNION ALL SELECT (SELECT max(rank) FROM m) + k, l, r FROM placed")
def surgery_replace_merges(spark, d):
    return _replaced(spark, d)[1].withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {VOCAB}, few AS (SELECT token FROM v WHERE count_total > 1), x AS (SELECT rank, 'left' AS part, l AS token FROM m UNION ALL SELECT rank, 'right', r FROM m UNION ALL SELECT rank, 'result', token FROM m) SELECT * FROM x WHERE token NOT IN (SELECT token FROM few)")
def broken_merges(spark, d):
    v, m = vocabulary(spark, d)
    return vocab.broken_merges(v.filter("count_total > 1"), m)


@query(f"WITH {VOCAB} SELECT token, count_total FROM v WHERE token IN (SELECT token FROM m) AND count_total BETWEEN 3 AND 50 AND length(token) > 2 ORDER BY count_total DESC, token_id LIMIT 20")
def damaged_pick(spark, d):
    v, m = vocabulary(spark, d)
    rows = v.withColumn("is_protected", F.length("token") <= 2)
    return evaluation.damaged_rows(rows, vocab.merge_parents(m), "count_total", 3, 50, 20).select("token", "count_total")


@query(f"WITH {TOKENS}, c AS (SELECT lang, count(*) FILTER (length(token) > 6) / count(*) - 0.25 AS change FROM t GROUP BY 1), k AS (SELECT CASE lang WHEN 'de' THEN 'ko' ELSE lang END AS lang, change FROM c), l AS (SELECT * FROM (VALUES ('ko', NULL, -0.15), ('en', 0.05, 0.25), ('code', 0.10, 0.40)) t(lang, report, hard)) SELECT l.lang, round(change, 9) AS change, CASE WHEN change IS NULL THEN 'fail' WHEN l.lang = 'ko' THEN CASE WHEN change <= hard THEN 'ok' ELSE 'fail' END WHEN change > hard THEN 'fail' WHEN change > report THEN 'report' ELSE 'ok' END AS level FROM l LEFT JOIN k USING (lang)")
def candidate_gate(spark, d):
    change = tokens(spark, d).groupBy("lang").agg((F.count_if(F.length("token") > 6) / F.count("*") - 0.25).alias("change"))
    rows = change.withColumn("lang", F.when(F.col("lang") == "de", "ko").otherwise(F.col("lang")))
    return vocab.gate(rows).withColumn("change", F.round("change", 9))


@query(f"WITH {VOCAB} SELECT DISTINCT token_id FROM (SELECT token_id FROM v WHERE length(token) = 1 UNION ALL SELECT token_id FROM v WHERE count_total > 100 UNION ALL SELECT token_id FROM v WHERE token LIKE 'x%')")
def protected_ids(spark, d):
    v, _ = vocabulary(spark, d)
    return vocab.protected_ids(v.filter(F.length("token") == 1), v.filter("count_total > 100"), v.filter("token like 'x%'"))


@query(f"WITH {VOCAB} SELECT token_id FROM v WHERE count_total > 100 EXCEPT SELECT token_id FROM v WHERE length(token) < 4")
def lost_protected(spark, d):
    v, _ = vocabulary(spark, d)
    return vocab.lost_protected(v.filter("count_total > 100"), v.filter(F.length("token") < 4))


@query(f"WITH {VOCAB}, o AS (SELECT token, token_id FROM v WHERE count_total > 1) SELECT v.token_id AS new_id, coalesce(o.token_id, -1) AS old_id FROM v LEFT JOIN o USING (token)")
def id_mapping(spark, d):
    v, _ = vocabulary(spark, d)
    return embedding.id_mapping(v, v.filter("count_total > 1"))


@query(f"WITH {VOCAB}, s AS (SELECT token_id AS id, l AS a, r AS b FROM v JOIN m USING (token)) SELECT id, x.token_id AS left_id, y.token_id AS right_id FROM s JOIN v x ON x.token = a JOIN v y ON y.token = b WHERE y.count_total > 5")
def parent_ids(spark, d):
    """Slots with the ids of both parts; those with a part that the vocabulary lacks go."""
    v, m = vocabulary(spark, d)
    slots = v.select("token", "token_id").join(vocab.merge_parents(m), "token")
    n = F.length("token")
    return embedding.parents(slots, v.filter((n > 1) | (F.col("count_total") > 5)))


@query(f"WITH {VOCAB}, g AS (SELECT *, token LIKE '%a%' AS removed FROM v WHERE length(token) = 4) SELECT count(*) AS n, count(*) FILTER (removed) AS n_removed, median(count_total) FILTER (removed) AS removed_median, max(count_total) FILTER (removed) AS removed_max, CAST(count(*) FILTER (removed AND count_total = (SELECT max(count_total) FROM g WHERE removed)) AS BIGINT) AS removed_at_max FROM g")
def census_singles(spark, d):
    """Words of four letters stand for tokens of one character of a script, those with an a for the removed."""
    v, _ = vocabulary(spark, d)
    rows = v.filter(F.length("token") == 4).select(F.substring("token", 1, 1).alias("surface"), F.col("token").contains("a").alias("removed"), "count_total", F.lit(True).alias("pure_han"))
    return vocab.census_singles(rows)


@query(f"WITH {TOKENS}, x AS (SELECT DISTINCT token FROM t WHERE length(token) = 9), f AS (SELECT x.token, count(t.token) AS n FROM x LEFT JOIN t ON t.token = x.token AND t.lang = 'en' GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (n = 0) AS n_zero, count(*) FILTER (n * 8.0 < 100) AS n_few, list_sort(list(n * 8.0::DOUBLE))[count(*) // 2 + 1] AS upper_median FROM f")
def exposure_digest(spark, d):
    new = tokens(spark, d).select("token").distinct().filter(F.length("token") == 9)
    seen = tokens(spark, d).filter("lang = 'en'").groupBy("token").agg(F.count("*").alias("n"))
    return vocab.exposure_digest(new.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("fires_sample")), 8.0)


LINED = "list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: regexp_extract_all(x, '[a-z]+')), lambda x: len(x) > 0)"


def line_docs(spark, d):
    """Documents' words, and whether each opens a line: lines stand for segments."""
    words = F.transform(F.split(F.lower("text"), "\n"), lambda x: F.regexp_extract_all(x, F.lit("[a-z]+"), F.lit(0)))
    rows = table(spark, d, "documents").select("doc_id", words.alias("l"))
    return rows.select("doc_id", F.flatten("l").alias("ids"), F.flatten(F.transform("l", lambda x: F.transform(x, lambda _, i: i == 0))).alias("opens"))


@query(f"WITH l AS (SELECT unnest({LINED}) AS w FROM documents), p AS (SELECT w[i] AS left_id, w[i + 1] AS right_id FROM (SELECT w, unnest(range(1, len(w))) AS i FROM l WHERE len(w) > 1)) SELECT left_id, right_id, count(*) AS count FROM p GROUP BY 1, 2")
def segment_pairs(spark, d):
    return vocab.pair_counts(line_docs(spark, d), "ids", "opens")


@query(f"WITH l AS (SELECT {LINED} AS l FROM documents), c AS (SELECT len(l) - 1 AS x, list_sum(list_transform(l, lambda w: len(w))) - 1 AS n FROM l WHERE len(l) > 0) SELECT CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(x) AS BIGINT) AS n_cross, sum(x) / sum(n) AS share FROM c")
def segment_crossings(spark, d):
    return vocab.crossings(line_docs(spark, d))


@query("WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda x: strlen(x)) AS b FROM documents), e AS (SELECT doc_id, unnest(range(1, len(b) + 2)) AS i, b FROM b WHERE len(b) > 0), s AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS pos, sum(coalesce(b[i], 0)) OVER (ORDER BY doc_id, i) AS cum FROM e), marks AS (SELECT unnest([1, 4095, 8192, 60000, 900000000])::BIGINT AS n) SELECT n, CAST(cum AS BIGINT) AS bytes FROM marks LEFT JOIN s ON pos = n")
def bytes_at_tokens(spark, d):
    rows = word_docs(spark, d).select("ord", F.transform("words", lambda x: F.octet_length(x).cast("bigint")).alias("token_bytes"))
    marks = spark.createDataFrame([(n,) for n in (1, 4095, 8192, 60_000, 900_000_000)], "n long")
    return budget.bytes_at(rows, marks, 512)


@query(f"WITH {TOKENS}, s AS (SELECT lang, doc_id, count(*) AS n FROM t GROUP BY 1, 2), p AS (SELECT lang, doc_id, n, sum(n) OVER (PARTITION BY lang ORDER BY doc_id) - n AS before, CASE lang WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.4 END AS share FROM s WHERE lang IN ('en', 'de')) SELECT doc_id, lang, row_number() OVER (ORDER BY before / share, lang, doc_id) - 1 AS pool_ord FROM p WHERE before < share * (20000 * 1.15)")
def mixed_pool(spark, d):
    from ..operators import dedup

    n = tokens(spark, d).groupBy("lang", "doc_id").agg(F.count("*").alias("n_bytes")).withColumnRenamed("doc_id", "ord")
    return dedup.mixed_pool(n, {"en": 0.6, "de": 0.4}, 20_000).select(F.col("ord").alias("doc_id"), "lang", F.col("pool_ord").cast("bigint").alias("pool_ord"))


# --- Vectors ------------------------------------------------------------------------------

VEC = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


_total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 4)


@query(f"WITH {VEC}, n AS (SELECT id * 2 AS id, CASE WHEN label < 5 THEN id ELSE -1 END AS old FROM e) SELECT n.id, e.id IS NULL AS todo, round(list_sum(e.v), 4) AS total FROM n LEFT JOIN e ON e.id = n.old")
def emb_rearrange(spark, d):
    """Rows of five labels keep a vector in their new places; the others are still to do."""
    v = vectors(spark, d)
    mapping = v.select((F.col("id") * 2).alias("new_id"), F.when(F.col("label") < 5, F.col("id")).otherwise(-1).alias("old_id"))
    width = len(v.select("vec").first()[0])
    return embedding.rearrange(mapping, v, width).select("id", "todo", F.when(~F.col("todo"), _total("vec")).alias("total"))


@query(f"WITH {VEC} SELECT id, round(list_sum(list_transform(v, lambda x: x * 0.5)), 4) AS total FROM e WHERE id < 300 UNION ALL SELECT id, 0.0 FROM e WHERE id >= 300")
def emb_rescale_pads(spark, d):
    rows = embedding.zero_pads(embedding.rescale(vectors(spark, d), 0.5), 300)
    return rows.select("id", (_total("vec") + 0.0).alias("total"))


@query(f"WITH {VEC} SELECT a.id, CAST(ceil((a.id + 1) / 128.0) * 128 AS BIGINT) AS padded, b.id IS NOT NULL AS moved, round(list_sum(coalesce(b.v, a.v)), 4) AS total FROM e a LEFT JOIN (SELECT id + 1 AS id, v FROM e) b ON a.id = b.id AND a.label = 3")
def emb_transplant(spark, d):
    v = vectors(spark, d)
    rows = embedding.transplant(v, v.select((F.col("id") + 1).alias("id"), "vec"), v.filter("label = 3").select("id"))
    return rows.select("id", embedding.padded_size(F.col("id") + 1).cast("bigint").alias("padded"), "moved", _total("vec").alias("total"))


@query(f"WITH {VEC}, s AS (SELECT a.id, a.v AS l, b.v AS r, (a.label + 1.0) / (a.label + b.label + 2.0) AS wl, (1.0 / (a.label + 1)) / (1.0 / (a.label + 1) + 1.0 / (b.label + 1)) AS wf FROM e a JOIN e b ON b.id = a.id + 1) SELECT id, round(list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * wl + r[i] * (1 - wl))), 4) AS by_length, round(list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * wf + r[i] * (1 - wf))), 4) AS by_frequency FROM s")
def emb_weighted_means(spark, d):
    """Means of neighbours, weighted by length and by inverse frequency; labels stand for both."""
    v = vectors(spark, d)
    labels = v.select("id", "label")
    slots = v.select("id", F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"), F.col("label").alias("a")).join(labels.toDF("right_id", "b"), "right_id")
    a, b = F.col("a"), F.col("b")
    one = embedding.parent_mean(slots, v, embedding.left_weight("length", a + 1, b + 1)).select("id", _total("vec").alias("by_length"))
    two = embedding.parent_mean(slots, v, embedding.left_weight("frequency", a, b)).select("id", _total("vec").alias("by_frequency"))
    return one.join(two, "id")


@query(f"WITH {VEC}, h AS (SELECT e.id, e.v AS b, CASE WHEN e.label = 1 AND x.id IS NOT NULL AND y.id IS NOT NULL THEN list_transform(range(1, len(e.v) + 1), lambda i: (x.v[i] + y.v[i]) / 2) END AS a FROM e LEFT JOIN e x ON x.id = (e.id + 7) % (SELECT count(*) FROM e) LEFT JOIN e y ON y.id = (e.id + 11) % (SELECT count(*) FROM e)), q AS (SELECT *, sqrt(list_sum(list_transform(range(1, len(b) + 1), lambda i: (a[i] - b[i]) ** 2))) AS move FROM h WHERE a IS NOT NULL) SELECT count(*) AS n_moved, round(avg(move), 4) AS mean_move, (SELECT round(stddev_pop(x), 4) FROM (SELECT unnest(b) AS x FROM q)) AS std_before, (SELECT round(stddev_pop(x), 4) FROM (SELECT unnest(a) AS x FROM q)) AS std_after FROM q")
def emb_damage_mean(spark, d):
    """Rows of a label become the mean of two others; what that moved."""
    v = vectors(spark, d).select("id", "vec", "label")
    n = v.count()
    ids = v.filter("label = 1").select("id")
    parents = v.select("id", ((F.col("id") + 7) % n).alias("left_id"), ((F.col("id") + 11) % n).alias("right_id"))
    rows = v.select("id", "vec")
    after = embedding.damage(rows, ids, "mean", parents)
    return embedding.damage_report(rows, after, ids).select("n_moved", *(F.round(c, 4).alias(c) for c in ("mean_move", "std_before", "std_after")))


@query("SELECT p_partkey, p_size * 1000 * 64 AS embedding_params, p_size * 1000 * 64 + 2 * (2 * 64 * 64 + 2 * 64 * (2 * 16) + 3 * 64 * 256) + CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size * 1000 * 64 END AS total_params, 256 AS kv_bytes_per_token FROM part")
def parameter_counts(spark, d):
    c = lambda v: F.lit(v).cast("bigint")
    models = table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("bigint") * 1000).alias("vocab_size"), c(64).alias("hidden_size"), c(2).alias("n_layers"), c(4).alias("n_heads"), c(2).alias("n_kv_heads"), c(16).alias("head_dim"), c(256).alias("intermediate_size"), (F.col("p_size") % 2 == 0).alias("tie_word_embeddings"))
    return embedding.parameter_counts(models).select("p_partkey", "embedding_params", "total_params", "kv_bytes_per_token")


# --- Texts and sources ----------------------------------------------------------------------


@query("SELECT page_id, 'data_' || trim(regexp_replace(regexp_replace(lower(list_last(string_split(replace(url, chr(92), '/'), '/'))), '[^a-z0-9_.-]+', '-', 'g'), '-{2,}', '-', 'g'), '-') || '_seed' || page_id AS run_id FROM pages WHERE trim(regexp_replace(lower(list_last(string_split(url, '/'))), '[^a-z0-9_.-]+', '-', 'g'), '-') <> '' UNION ALL SELECT page_id, 'data_seed' || page_id FROM pages WHERE trim(regexp_replace(lower(list_last(string_split(url, '/'))), '[^a-z0-9_.-]+', '-', 'g'), '-') = ''")
def run_ids(spark, d):
    return table(spark, d, "pages").select("page_id", T.run_id(F.lit("data"), F.col("url"), seed=F.col("page_id")).alias("run_id"))


@query("SELECT event_id, CAST(nullif(regexp_extract(replace(replace(replace(replace(props, '{', ''), '}', ''), '\"', ''), ': ', '='), '(?:^|\\s)k=([+-]?[0-9.]+)', 1), '') AS DOUBLE) AS k FROM events")
def note_values(spark, d):
    note = F.regexp_replace(F.regexp_replace("props", '[{}"]', ""), ": ", "=")
    return table(spark, d, "events").select("event_id", T.note_value(note, "k").alias("k"))


@query("SELECT event_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN '' END AS dry FROM events")
def argv_options(spark, d):
    argv = F.concat(F.lit("--kind "), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, " --dry").otherwise(""))
    rows = table(spark, d, "events").select("event_id", T.parse_argv(argv).alias("o"))
    return rows.select("event_id", F.col("o")["kind"].alias("kind"), F.col("o")["dry"].alias("dry"))


@query("SELECT doc_id, regexp_matches(text, '[éèêñüöäß]') AS has_accent, regexp_full_match(regexp_replace(text, '[^A-Za-z]', '', 'g'), '[A-Za-z]+') AS pure_latin FROM documents")
def class_predicates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_class(F.col("text"), "[éèêñüöäß]").alias("has_accent"), T.pure_class(F.regexp_replace("text", "[^A-Za-z]", ""), T.LATIN).alias("pure_latin"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def token_byte_lengths(spark, d):
    """A byte-level token stands for as many bytes as it has characters: whole texts written in the byte alphabet."""
    table_ = T.byte_alphabet()

    @F.pandas_udf("string")
    def written(s):
        return s.map(lambda x: "".join(map(table_.__getitem__, x.encode())))

    return table(spark, d, "documents").select("doc_id", T.token_bytes(written("text")).cast("bigint").alias("n_bytes"))


@query("SELECT doc_id, text FROM documents")
def byte_surfaces(spark, d):
    """Texts written in the byte alphabet and read back."""
    table_ = T.byte_alphabet()

    @F.pandas_udf("string")
    def written(s):
        return s.map(lambda x: "".join(map(table_.__getitem__, x.encode())))

    return table(spark, d, "documents").select("doc_id", T.byte_surface(True)(written("text")).alias("text"))


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha256 FROM (SELECT doc_id, replace(text, chr(10), chr(10)) AS text FROM documents)")
def folded_text_hashes(spark, d):
    """Texts with CRLF line ends have the hashes of those with LF."""
    from ..functions import hashing

    return table(spark, d, "documents").select("doc_id", hashing.text_hash(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("sha256"))


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT conv_id, 'talk' FROM conversations")
def corpora_union(spark, d):
    docs = table(spark, d, "documents")
    parts = {x: docs.filter(F.col("lang") == x).select("doc_id") for x in ("en", "fr", "de", "es")}
    return readers.named_corpora(parts | {"talk": table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))})


@query("WITH s AS (SELECT lang, source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS b, CAST(sum(length(text)) AS BIGINT) AS c FROM documents GROUP BY 1, 2) SELECT lang AS split, source AS domain, n AS n_docs, c AS n_chars, b AS n_bytes FROM s")
def stored_summary(spark, d):
    """The summary after a round trip through a written table: manifest rows by split, sorted, and read back."""
    from .. import scratch

    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("split"), F.col("source").alias("domain"), F.length("text").alias("char_count"), F.octet_length("text").alias("byte_count"))
    path = f"{scratch.folder(spark)}/summary-{uuid.uuid4().hex}"
    sinks.write_by_split(rows, path)
    return sinks.summary(spark.read.parquet(path))


@query("SELECT count(*) AS n, count(*) FILTER (h < 0) AS n_negative FROM (SELECT 0 AS h FROM documents WHERE text IS NOT NULL)")
def bottom_hashes(spark, d):
    """Documents whose bottom hashes are sorted, distinct and at most 512: all of them."""
    from ..operators import dedup

    @F.pandas_udf("boolean")
    def wrong(s):
        found = s.map(lambda x: dedup.shingle_hashes(x or ""))
        return found.map(lambda h: bool(len(h) > dedup.BOTTOM or (h[1:] <= h[:-1]).any()))

    rows = table(spark, d, "documents").filter("text is not null").select(wrong("text").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.count_if("w").alias("n_negative"))


def claim_evidence(spark, d):
    """Evidence for the claims by fixed rules: arms and seeds from line items, held-out documents from documents."""
    docs = table(spark, d, "documents")
    compression = docs.select(F.explode(F.array(F.lit("base"), F.lit("new"))).alias("arm"), F.octet_length("text").alias("n_bytes"), F.length("text").alias("c")).withColumn("n_tokens", F.when(F.col("arm") == "base", F.col("c")).otherwise(F.floor(F.col("c") * 7 / 10)))
    system = table(spark, d, "part").groupBy(F.col("p_size").alias("raw_chars")).agg(F.avg("p_retailprice").alias("ms")).select("raw_chars", F.explode(F.array(F.struct(F.lit("base").alias("arm"), F.col("ms").alias("prefill_ms")), F.struct(F.lit("new").alias("arm"), (F.col("ms") * 0.6).alias("prefill_ms")))).alias("x")).select("raw_chars", "x.*")
    m = seed_metrics(spark, d).filter("domain = 'O' and seed <= 3")
    names = F.create_map(*map(F.lit, ("treat", "new", "control", "base", "other", "pruned")))
    add = {"cosine": 0.02, "constant": 0.0, "warm": 0.001, "wsd": 0.01}
    lm = m.select(names[F.col("arm")].alias("arm"), F.explode(F.array(*(F.struct(F.lit(s).alias("schedule"), F.when(F.col("arm") == "treat", F.col("bpb") + 0.3 + x).otherwise(F.col("bpb")).alias("bpb")) for s, x in add.items()))).alias("x"), "seed").select("arm", "seed", "x.*")
    n = metrics.doc_nll(spark, d)
    heldout = n.select("doc", F.col("nll").alias("nll_a"), F.col("bytes").alias("bytes_a"), (F.col("nll") * 1.1).alias("nll_b"), F.col("bytes").alias("bytes_b"))
    updates = m.filter("arm = 'treat'").select("seed", (F.col("bpb") + 0.3).alias("d_full"), (F.col("bpb") * 0.9 + 0.3).alias("d_upd"))
    items = docs.select((F.col("doc_id") % 3 == 0).alias("correct_a"), (F.col("doc_id") % 3 == 1).alias("correct_b"))
    return compression, system, lm, heldout, updates, items


@query(f"""WITH {SEEDS.replace('GROUP BY 1, 2, 3', "WHERE l_linestatus = 'O' AND l_linenumber <= 3 GROUP BY 1, 2, 3")}, {metrics.NLL},
s AS (SELECT t.seed, t.bpb AS t, c.bpb AS c, o.bpb AS o FROM m t JOIN m c ON t.seed = c.seed AND t.arm = 'treat' AND c.arm = 'control' JOIN m o ON o.seed = t.seed AND o.arm = 'other'),
x AS (SELECT 'C1' AS id, 1 AS n, sum(length(text) * 7 // 10) / sum(length(text)) - 1 AS value FROM documents
UNION ALL SELECT 'C2', count(DISTINCT p_size), -0.4 FROM part
UNION ALL SELECT 'C3', count(*), avg(t + 0.3 - c) FROM s
UNION ALL SELECT 'C4', count(*), sum(nll * 1.1) / (ln(2) * sum(bytes)) - sum(nll) / (ln(2) * sum(bytes)) FROM n
UNION ALL SELECT 'C5', count(*), -0.02 FROM s
UNION ALL SELECT 'C6', count(*), avg(t * 0.9 + 0.3) FROM s
UNION ALL SELECT 'C7', count(*), -0.001 FROM s
UNION ALL SELECT 'C8', count(*), 0.01 FROM s
UNION ALL SELECT 'C9', (SELECT count(*) FROM documents), avg(o / c - 1) FROM s)
SELECT id, n, round(value, 6) AS value FROM x""")
def claim_values(spark, d):
    """The nine claims' values."""
    return overview.claim_rows(*claim_evidence(spark, d), samples=1000).select("id", "n", F.round("value", 6).alias("value"))


@query()
def claim_table(spark, d):
    """The nine claims with their intervals and verdicts (resampled, so without SQL)."""
    return overview.claim_rows(*claim_evidence(spark, d))


assert set(STATUS.values()) <= set(schemas.STATUSES)
