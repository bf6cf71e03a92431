import collections
import importlib
import json

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpusmill.sources import readers, sinks
from corpusmill.streaming import watch


def test_stride():
    assert readers.stride(100, 10_000, 2) == list(range(0, 100, 20))
    assert readers.stride(3, 10_000, 1) == [0, 1, 2]
    assert readers.pick_files(["c", "a", "b", "d"], 2) == ["a", "c"]


def test_files_and_fallback_ids(spark, sf):
    df = readers.read_documents(spark, [f"{sf}/documents.parquet"], ["doc_id", "text", "none"])
    assert df.columns == ["doc_id", "text", "_source_path", "_fallback_id"]
    assert df.select("_fallback_id").distinct().count() == df.count()
    with pytest.raises(ValueError):
        readers.read_documents(spark, [], ["text"])


def test_pruned_scan(spark, sf):
    plan = readers.strided(spark, f"{sf}/documents.parquet", ["doc_id"], 100)._jdf.queryExecution().toString()
    read = plan.rpartition("ReadSchema:")[2]
    assert "doc_id" in read and "text" not in read


def test_quoted_tsv(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('token_id\ttoken\n0\t"\\""\n1\t"a\n2\t"""\n', encoding="utf-8")
    assert readers.read_tsv(spark, str(p)).count() == 3


def test_items(spark, tmp_path):
    p = tmp_path / "i.csv"
    p.write_text('question,A,B,C,D,answer\n"x, y",1,2,3,4,2\n')
    assert readers.read_items(spark, str(p)).first().gold == 1
    p.write_text("question,A,B,C,D,answer\nx,1,2,3,4,5\n")
    with pytest.raises(Exception):
        readers.read_items(spark, str(p)).collect()
    p.write_text("question,A\nx,1\n")
    with pytest.raises(ValueError):
        readers.read_items(spark, str(p))


def test_split_writer(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i else "dev", "d", "t") for i in range(9, -1, -1)], "doc_id int, split string, domain string, text string")
    sinks.write_by_split(df, str(tmp_path / "m"))
    sinks.write_by_split(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 10
    sinks.write_jsonl(df, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j" / "split=dev").glob("*.json") for x in f.read_text().splitlines()]
    assert [x["doc_id"] for x in lines] == [0]


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "ts_utc string, run_id string, status string, note string"
    spark.createDataFrame([("t", "a", "ok", None), ("t", "b", "fail", ""), ("t", "c", "start", "loss is NaN")], schema).write.parquet(path)
    q = watch.watch(spark, path, schema).writeStream.format("memory").queryName("alerts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.run_id for r in spark.table("alerts").collect()) == ["b", "c"]
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "doc_id int, text string").write.parquet(docs)
    s = watch.split(watch.new_contents(spark.readStream.schema("doc_id int, text string").parquet(docs)))
    q = s.writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("fresh").count() == 2


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_split_audit_plan_has_no_cross_join(spark, sf):
    from corpusmill.plans import catalogue

    plan = catalogue.QUERIES["split_leakage"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_strided_over_many_files(spark, tmp_path):
    path, at = tmp_path / "documents.parquet", 0
    path.mkdir()
    for i, n in enumerate([130, 0, 7, 501, 62]):
        pq.write_table(pa.table({"doc_id": list(range(at, at + n)), "text": ["é"] * n}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())])), path / f"part-{i}.parquet", row_group_size=100)
        at += n
    got = readers.strided(spark, str(path), ["doc_id"], max_docs=30, per_group=10).collect()
    assert all(r.doc_id == r._row for r in got)
    assert sorted(r.doc_id for r in got) == [10 * g + k for g in readers.stride(70, 30, 1, 10) for k in range(10)]
    some = readers.strided(spark, str(path), ["doc_id"], max_docs=30, per_group=10, max_bytes=25)
    assert sorted(r.doc_id for r in some.collect()) == [*range(10), 230, 231, 232]
    assert readers.strided(spark, str(path), ["doc_id"], max_docs=0, row="doc_id").isEmpty()


@pytest.mark.parametrize("ids", [list(range(1203)), [(i * 7919) % 1203 for i in range(1203)], [*range(-350, 0), None, 5, 5, *range(900, 1900)], [3 * i for i in range(150)], []])
def test_strided_scan_is_its_sql(spark, tmp_path, ids):
    """In several files, with ids in order, shuffled, negative, missing, repeated, with gaps, and none."""
    from corpusmill.plans import catalogue

    path, schema = tmp_path / "documents.parquet", pa.schema([("doc_id", pa.int64()), ("lang", pa.string())])
    path.mkdir()
    for i in range(3):
        part = ids[len(ids) * i // 3 : len(ids) * (i + 1) // 3]
        pq.write_table(pa.table({"doc_id": part, "lang": [f"l{k}" for k in range(len(part))]}, schema=schema), path / f"part-{i}.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sql.execute(catalogue.ORACLE["strided_scan"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["strided_scan"](spark, str(tmp_path)).collect()]
    assert collections.Counter(got) == collections.Counter(want)
