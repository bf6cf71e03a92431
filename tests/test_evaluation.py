import re

import duckdb
import numpy as np
from corpusmill.operators import domain, embedding
from corpusmill.plans import catalogue
from pyspark.sql import functions as F


def test_evaluated_compression_has_all_documents(spark, sf):
    got = {r.lang: (r.n_bytes, r.n_tokens) for r in catalogue.QUERIES["evaluated_compression"](spark, sf).collect()}
    want = duckdb.sql(f"SELECT lang, sum(strlen(text)), sum(length(text) // 4 + 1) FROM '{sf}/documents.parquet' GROUP BY 1").fetchall()
    assert got == {k: (b, t) for k, b, t in want}


def test_permute_moves_all_vectors(spark, sf):
    got = catalogue.QUERIES["emb_permute_moves"](spark, sf).first()
    v = np.array([r[0] for r in duckdb.sql(f"SELECT embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()])
    want = np.linalg.norm(np.roll(v, -1, 0) - v, axis=1)
    assert got.n_moved == len(v) and abs(got.mean_move - want.mean()) < 1e-4


def test_cosine_topk_has_all_queries(spark, sf):
    got = [(r.query_id, r.vec_id, r.cosine) for r in catalogue.QUERIES["emb_cosine_topk"](spark, sf).orderBy("query_id", F.desc("cosine"), "vec_id").collect()]
    pairs = f"SELECT q.vec_id AS q, e.vec_id AS v, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM '{sf}/embeddings.parquet' q, '{sf}/embeddings.parquet' e WHERE q.vec_id % 100 = 0"
    want = duckdb.sql(f"SELECT q, v, round(c, 4) AS r FROM ({pairs}) QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, v) <= 20 ORDER BY q, r DESC, v").fetchall()
    assert len(got) == 100 and [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-4)


def test_cosine_topk_in_blocks_and_at_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0] if i % 2 else [float(i), 1.0]) for i in range(40)] + [(40, [0.0, 0.0])], "id long, vec array<double>").repartition(3)
    got = embedding.cosine_topk(v.filter("id < 5"), v, 4, block=2).collect()
    assert sorted(r.id for r in got if r.query_id == 1) == [1, 3, 5, 7] and {r.query_id for r in got} == {0, 1, 2, 3, 4} and len(got) == 20


def test_item_prompts_hold_the_whole_text(spark, sf):
    got = {r.doc_id: (r.target, r.shot) for r in catalogue.QUERIES["item_prompts"](spark, sf).collect()}
    end = "\nA. a\nB. b\nC. c\nD. d\n정답:"
    want = {i: (t + end, f"{t}{end} {'ABCD'[i % 4]}") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}
    assert got == want


def test_content_signals_count_the_whole_text(spark, tmp_path):
    text = "x" * 180 + " RTX 4090 GPU 16GB RAM DDR5 " * 3
    duckdb.sql(f"COPY (SELECT 0::BIGINT AS doc_id, '{text}' AS text, 'ko' AS lang, 'web' AS source, {len(text)} AS n_chars) TO '{tmp_path}/documents.parquet'")
    got = catalogue.QUERIES["content_signals"](spark, str(tmp_path)).first()
    assert got.spec == len(re.findall(domain.SIGNALS["spec"], text)) > 0
