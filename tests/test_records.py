"""Registries, hashes, budgets, damage, streams and null keys on small tables."""

import hashlib
import json

import pytest
from corpusmill import schemas, scratch
from corpusmill.functions import hashing
from corpusmill.functions import text as T
from corpusmill.operators import budget, dedup, domain, embedding, ledger, overview, stats, vocab
from corpusmill.sources import readers
from corpusmill.streaming import watch
from pyspark.sql import functions as F


def test_exact_dedup_keeps_one_row_without_a_key(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "h", "c"), (4, "h", "d")], "ord int, sha256 string, text string")
    assert sorted(r.ord for r in dedup.exact_dedup(df).collect()) == [1, 3]


def test_host_cap_leaves_blank_hosts(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(["a"] * 9 + [None] * 5 + [""] * 4 + ["b"])], "ord int, host string")
    got = dedup.host_cap(df, "host", "ord", 3)
    assert sorted(r.ord for r in got.collect()) == [0, 1, 2, *range(9, 19)] and got.columns == df.columns


def test_running_sum_of_sparse_ids(spark):
    ids = [-(2**62), -7, 0, 1, 2, 3, 4, 5, 10**9, 2**62]
    df = spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "ord long, v long")
    for width in (1, 3, 100_000):
        got = {r.ord: r.s for r in budget.running_sum(df, "ord", F.col("v"), "s", width).collect()}
        assert got == {i: sum(range(1, k + 2)) for k, i in enumerate(ids)}
    dense = spark.createDataFrame([(i, 1) for i in [*range(200), 2**50]], "ord long, v long")
    assert budget.running_sum(dense, "ord", F.col("v"), "s", 4).agg(F.max("s")).first()[0] == 201
    assert budget.running_sum(df.limit(0), "ord", F.col("v"), "s").count() == 0


def test_order_statistics_of_one_hot_group(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 1001)] + [("b", 5.0)] * 3 + [(None, 1.0)], "k string, v double")
    got = {r.k: (r.n, r.m) for r in stats.percentiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": (1000, 500.5), "b": (3, 5.0), None: (1, 1.0)}
    assert stats.percentiles(df.select("v"), [], "v", {"m": 0.25}).first().n == 1004


def test_strata_under_the_floor_are_hidden(spark):
    rows = [(i, 0 if i < 40 else 1 + i % 2, 5.0 + i, 10.0, 6.0 + i, 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc long, n_removed int, nll_a double, bytes_a double, nll_b double, bytes_b double")
    got = {r.stratum: r for r in stats.strata_intervals(df, n=300).collect()}
    assert got["zero"].ci_lo <= got["zero"]["diff"] <= got["zero"].ci_hi and got["low"].bpb_a is None and got["high"].n_docs == 10


def test_format_folds_line_ends():
    assert ledger.format_value("a\r\nb\rc\nd\te\\") == "a\\nb\\nc\\nd\\te\\\\"


def test_hashes_of_files(spark, tmp_path):
    (tmp_path / "a" / "__pycache__").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_bytes(b"one\r\ntwo")
    (tmp_path / "b.bin").write_bytes(bytes(range(256)) * 10)
    (tmp_path / "a" / "__pycache__" / "no").write_bytes(b"n")
    files = hashing.file_hashes(spark, str(tmp_path))
    want = {"a/x.txt": hashlib.sha256(b"one\r\ntwo").hexdigest(), "b.bin": hashlib.sha256(bytes(range(256)) * 10).hexdigest()}
    assert {r["name"]: r.sha256 for r in files.collect()} == want
    whole = hashlib.sha256("\n".join(f"{k}  {want[k]}" for k in sorted(want)).encode()).hexdigest()
    assert tuple(hashing.folder_hash(files).first()) == (whole, 2568)
    df = spark.createDataFrame([("a\r\nb",), ("a\nb",)], "t string")
    assert {r[0] for r in df.select(hashing.text_hash(F.col("t"))).collect()} == {hashlib.sha256(b"a\nb").hexdigest()}


def test_artifacts(spark, tmp_path):
    (tmp_path / "out" / "final_test").mkdir(parents=True)
    (tmp_path / "out" / "t.tsv").write_text("x")
    runs = spark.createDataFrame([("r1",)], "run_id string")
    make = lambda path, kind="table", **k: ledger.describe_artifact(spark, str(tmp_path), path, kind, runs, **k)
    one = make("out/t.tsv", run_id="r1")
    assert one["artifact_sha256"] == hashlib.sha256(b"x").hexdigest() and one["size_bytes"] == 1 and one["name"] == "t.tsv" and one["note"] == "NA"
    assert one["artifact_id"] == make("out/../out/t.tsv", run_id="r1")["artifact_id"] != make("out/t.tsv")["artifact_id"]
    schemas.check_row("artifacts", one)
    for path, more, error in (("../x", {}, ValueError), ("out/final_test", {}, ValueError), ("out/none", {}, FileNotFoundError), ("out/t.tsv", {"kind": "pet"}, ValueError), ("out/t.tsv", {"run_id": "r9"}, ValueError)):
        with pytest.raises(error):
            make(path, **more)
    assert make("out")["size_bytes"] == 1


def test_clock_and_environment(spark):
    checks = spark.createDataFrame([("2024-01-01T00:00:00Z", "ok", 1), ("2024-01-01T20:00:00Z", "fail", 2), ("2024-01-02T06:00:00Z", "ok", 3), ("bad", "ok", 4)], "ts_utc string, status string, n int")
    assert ledger.latest_check(checks, "2024-01-02T00:00:00Z").first().n == 1
    assert ledger.latest_check(checks, "2024-01-02T00:00:01Z").isEmpty()
    snapshot = {"python": "3.13", "numpy": "2"}
    known = spark.createDataFrame([(hashing.object_hash(snapshot | {"torch": "NA"}),)], "env_sha256 string")
    assert ledger.environment_gate(snapshot, known, ["python", "numpy", "torch"]) == known.first()[0]
    with pytest.raises(ValueError):
        ledger.environment_gate({"python": "3.12"}, known, ["python", "numpy", "torch"])


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": {"blog": {"host_suffix": ["b.com"]}, "news": {"host_contains": ["news"], "host_suffix": ["n.org"]}}}))
    rules = domain.load_rules(str(path))
    assert [tuple(r) for r in domain.rule_table(spark, rules).collect()] == [(0, "blog", "suffix", "b.com"), (1, "news", "suffix", "n.org"), (1, "news", "contains", "news")]
    df = spark.createDataFrame([("x.b.com",), ("ab.com",), ("mynews.net",)], "h string")
    assert [r[0] for r in df.select(domain.classify_host(F.col("h"), rules)).collect()] == ["blog", None, "news"]


def test_missing_corpora_are_passed_over(spark, tmp_path):
    (tmp_path / "ko.jsonl").write_text('{"doc_id": "1", "text": "x"}\n')
    got = readers.named_corpora({"ko": str(tmp_path / "ko.jsonl"), "en": str(tmp_path / "en.jsonl")}, spark)
    assert [(r.doc_id, r.lang) for r in got.collect()] == [("1", "ko")]


def test_strided_budget(spark, sf):
    path = f"{sf}/documents.parquet"
    every = readers.strided(spark, path, ["doc_id", "text"], max_docs=60, per_group=10).orderBy("_row").collect()
    some = readers.strided(spark, path, ["doc_id"], max_docs=60, per_group=10, max_bytes=9000)
    assert some.columns == ["doc_id", "_row"]
    want, total = [], 0
    for r in every:
        if total >= 9000:
            break
        want.append(r.doc_id)
        total += len(r.text.encode())
    assert [r.doc_id for r in some.orderBy("_row").collect()] == want


def test_damage(spark):
    rows = [(i, [float(i), float(i % 3), 1.0]) for i in range(12)]
    v, ids = spark.createDataFrame(rows, "id long, vec array<double>"), spark.createDataFrame([(i,) for i in range(4)], "id long")
    old = dict(rows)
    for how in ("permute", "random", "mean"):
        parents = spark.createDataFrame([(i, 6, 8) for i in range(4)], "id long, left_id long, right_id long")
        got = {r.id: list(r.vec) for r in embedding.damage(v, ids, how, parents).collect()}
        assert got.keys() == old.keys() and all(got[i] == old[i] for i in range(4, 12)) and all(got[i] != old[i] for i in range(4))
        if how == "mean":
            assert got[0] == [7.0, 1.0, 1.0]
        if how == "permute":
            assert sorted(got[i] for i in range(4)) == sorted(old[i] for i in range(4))
    report = embedding.damage_report(v, embedding.damage(v, ids, "mean", parents), ids).first()
    assert report.n_moved == 4 and report.std_after > 0
    with pytest.raises(ValueError):
        embedding.damage(v, ids, "mean", parents.limit(3))
    nan = spark.createDataFrame([(0, [1.0]), (1, [float("nan")])], "id long, vec array<double>")
    embedding.assert_filled(nan, used=1)
    with pytest.raises(ValueError):
        embedding.assert_filled(nan)
    assert embedding.zero_pads(v, 11).filter("id = 11").first().vec == [0.0, 0.0, 0.0]


def test_run_id_guard(spark):
    df = spark.createDataFrame([("cpt", "Qwen/Qwen2.5-0.5B", "r1 ctrl", 42), ("nope", "x", "", 1), ("tok", "", None, None)], "p string, a string, b string, s int")
    got = [r[0] for r in df.select(T.run_id(F.col("p"), F.col("a"), F.col("b"), seed=F.col("s"))).collect()]
    assert got == ["cpt_qwen2.5-0.5b_r1-ctrl_seed42", None, "tok"]


def test_bytes_at(spark):
    docs = spark.createDataFrame([(0, [3, 1]), (1, []), (2, [2, 2, 2])], "ord long, token_bytes array<bigint>")
    marks = spark.createDataFrame([(n,) for n in range(9)], "n long")
    got = {r.n: r.bytes for r in budget.bytes_at(docs, marks, 3).collect()}
    assert got == {0: 0, 1: 3, 2: 4, 3: 4, 4: 6, 5: 8, 6: 10, 7: None, 8: None}


def test_census(spark):
    rows = [(0, "甲", 5, True), (1, "乙", 5, True), (2, "丙", 1, True), (3, "丁", 9, False), (4, "甲乙", 2, True)]
    df = spark.createDataFrame(rows, "token_id int, surface string, count_total long, removed boolean").withColumn("pure_han", T.pure_class(F.col("surface"), T.HAN_CENSUS))
    assert tuple(vocab.census_singles(df).first()) == (4, 3, 5.0, 5, 2)
    assert [r.token_id for r in vocab.census_top(df, 2).collect()] == [0, 1, 3]


def test_claims_without_evidence(spark):
    none = lambda s: spark.createDataFrame([], s)
    got = overview.claim_rows(none("arm string, n_tokens long, n_bytes long"), none("arm string, raw_chars int, prefill_ms double"), none("arm string, schedule string, seed int, bpb double"), none("doc long, nll_a double, bytes_a double, nll_b double, bytes_b double"), none("seed int, d_full double, d_upd double"), none("correct_a boolean, correct_b boolean"), samples=10).collect()
    assert sorted(r.id for r in got) == sorted(overview.CLAIMS) and not any(r.holds for r in got)


def test_host_cap_of_a_stream(spark, tmp_path):
    schema = "host string, n int"
    spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5), ("", 6), ("", 7)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = watch.host_cap(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2)
    q = out.writeStream.format("memory").queryName("capped").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = [(r.host, r.n) for r in spark.table("capped").collect()]
    assert sorted(n for h, n in got if h == "a") == [1, 2] and sorted(n for h, n in got if not h) == [5, 6, 7] and ("b", 4) in got


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        scratch.folder(Session())
