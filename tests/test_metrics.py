import math

import numpy as np
import pytest
from corpusmill import schemas
from corpusmill.operators import curves, embedding, ledger, stats, verdicts
from pyspark.sql import functions as F


def test_latency(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 101)] + [("b", x) for x in (10.0, 12.0, 11.0, 50.0)] + [("c", 7.5)], "k string, v double")
    got = {r.k: r for r in stats.latency_stats(df, ["k"], "v").collect()}
    assert got["a"].p95 == 95 and got["b"].p95 == 50 and got["c"].std == 0


def test_recovery_is_guarded(spark):
    r = spark.createDataFrame([(1.0, 2.0, 3.0)], "b double, a double, c double").select(verdicts.recovery(F.col("b"), F.col("a"), F.col("c")).alias("r")).first()
    assert r.r is None


def test_three_valued(spark):
    df = spark.createDataFrame([(True, True), (True, False), (None, True), (None, False)], "k boolean, e boolean")
    got = [r.s for r in df.select(verdicts.reproduction_status(F.col("k"), F.col("e")).alias("s")).collect()]
    assert got == ["reproduced", "differs", "unrecorded", "differs"]


def test_pair_integrity(spark):
    a = spark.createDataFrame([(0, 21), (1, 5)], "doc int, raw_bytes int")
    assert verdicts.pair_integrity(a, a).first().problem is None
    b = spark.createDataFrame([(0, 99)], "doc int, raw_bytes int")
    assert "document 0" in verdicts.pair_integrity(a, b).first().problem


def test_strata(spark):
    df = spark.createDataFrame([(x,) for x in (0, 0, 1, 2, 3, 10, 0)], "n_removed int")
    assert [r.stratum for r in stats.exposure_strata(df).collect()] == ["zero", "zero", "low", "low", "high", "high", "zero"]


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [("g", i, float(rng.uniform(50, 90)), 100.0, float(rng.uniform(80, 99)), 100.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, doc int, nll_a double, bytes_a double, nll_b double, bytes_b double")
    r = stats.paired_ratio_bootstrap(df, ["k"], 500).first()
    want = (sum(x[4] for x in rows) - sum(x[2] for x in rows)) / (math.log(2) * 4000)
    assert abs(r["diff"] - want) < 1e-12 and r.ci_lo <= r["diff"] <= r.ci_hi and r.se > 0


def test_bootstrap_accuracy(spark):
    df = spark.createDataFrame([("a", i % 4 == 0) for i in range(400)], "k string, correct boolean")
    r = stats.bootstrap_accuracy(df, ["k"]).first()
    assert r.value == 0.25 and 0.19 < r.ci_lo < 0.23 and 0.27 < r.ci_hi < 0.31


def test_asof_at_bucket_borders(spark):
    left = spark.createDataFrame([("a", 10.0), ("a", 100.0)], "k string, x double")
    right = spark.createDataFrame([("a", 8.0, 1.0), ("a", 12.0, 2.0), ("a", 131.0, 3.0)], "k string, x double, v double")
    got = [(r.x, r.v) for r in curves.asof_nearest(left, right, "k", "x", "v", 30.0).orderBy("x").collect()]
    assert got == [(10.0, 1.0), (100.0, None)]


def test_schedules(spark):
    x = F.col("x")
    df = spark.createDataFrame([(0.0,), (10.0,), (50.0,), (100.0,)], "x double")
    r = df.select(curves.cosine_lr(x, 100, 1, 10, 0.1).alias("c"), curves.wsd_lr(x, 100, 1, 10, 0.2).alias("w")).collect()
    assert r[0].c == 0 and r[1].c == 1 and abs(r[3].c - 0.1) < 1e-12
    assert [y.w for y in r][1:] == [1, 1, 0]


def test_kv(spark):
    r = spark.range(1).select(embedding.kv_bytes_per_token(F.lit(24), F.lit(2), F.lit(64)).alias("b")).first()
    assert r.b == 12288


def test_embedding_surgery(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id int, vec array<double>")
    new = spark.createDataFrame([("a", 0), ("ab", 1)], "token string, token_id int")
    old = spark.createDataFrame([("b", 0), ("a", 1)], "token string, token_id int")
    m = embedding.id_mapping(new, old)
    assert {r.new_id: r.old_id for r in m.collect()} == {0: 1, 1: -1}
    rows = embedding.rearrange(m, v, 2)
    assert {r.id: r.todo for r in rows.collect()} == {0: False, 1: True}
    assert [r.id for r in embedding.unfilled(rows).collect()] == [1]
    assert embedding.unfilled(embedding.fill_random(rows, 0.0, 1.0, 2)).isEmpty()
    slots = spark.createDataFrame([(9, 0, 1)], "id int, left_id int, right_id int")
    assert embedding.parent_mean(slots, v).first().vec == [2.0, 3.0]
    for kind in ("length", "frequency", "uniform"):
        w = spark.createDataFrame([(3.0, 1.0)], "l double, r double").select(embedding.left_weight(kind, F.col("l"), F.col("r")).alias("w"), embedding.left_weight(kind, F.col("r"), F.col("l")).alias("u")).first()
        assert abs(w.w + w.u - 1) < 1e-12


def test_permute_keeps_the_rows(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id int, vec array<double>")
    p = embedding.permute(v, v.filter("id < 4").select("id"))
    got = {r.id: r.vec[0] for r in p.collect()}
    assert sorted(got.values()) == [0, 1, 2, 3, 4, 5] and all(got[i] != i for i in range(4)) and got[5] == 5


def test_format_value():
    assert [ledger.format_value(x) for x in (None, "", float("nan"), True, 1 / 3, "a\tb\n")] == ["NA", "NA", "NA", "1", "0.3333333333", "a\\tb\\n"]


def test_ledger_rows(spark):
    df = ledger.rows(spark, "ledger", [{"run_id": "r", "phase": "data", "status": "start"}], now="2024-01-01T00:00:00Z")
    assert df.first().ts_utc == "2024-01-01T00:00:00Z" and df.first().note == "NA"
    for bad in ({"run_id": "r"}, {"run_id": "r", "phase": "data", "status": "ok", "x": 1}):
        with pytest.raises(ValueError):
            ledger.rows(spark, "ledger", [bad])


def test_check_lines(spark):
    columns = schemas.TABLES["clock_checks"]
    good = ["2024-01-01T00:00:00Z", "a" * 64, *["x"] * (len(columns) - 4), "b" * 40, "NA"]
    lines = ["\t".join(columns), "\t".join(good), "\t".join(good) + "\r", "short", "\t".join([good[0], "bad", "", *good[3:]])]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")
    got = sorted((r.line, r.rule) for r in ledger.check_lines(df, "clock_checks").collect())
    assert got == [(3, "crlf"), (4, "field count"), (5, "blank cell"), (5, "sha256")]


def test_lifecycle(spark, tmp_path):
    path = str(tmp_path)
    with ledger.run(spark, path, "data", {"seed": 1}, "r1") as log:
        log("lm_metrics", split="dev", domain="ko", bpb=1.5)
    with pytest.raises(RuntimeError), ledger.run(spark, path, "data", {}, "r2"):
        raise RuntimeError("stop")
    rows = spark.read.parquet(f"{path}/ledger")
    assert sorted((r.run_id, r.status) for r in rows.collect()) == [("r1", "ok"), ("r1", "start"), ("r2", "fail"), ("r2", "start")]
    assert ledger.orphans(spark.read.parquet(f"{path}/lm_metrics"), rows, "run_id").isEmpty()


def test_migrate(spark):
    old = spark.createDataFrame([("1", "2")], "a string, b string")
    assert ledger.migrate(old, ["a", "b", "c"]).first().c == "NA"
    with pytest.raises(ValueError):
        ledger.migrate(old, ["b", "a", "c"])
