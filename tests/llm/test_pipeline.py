"""The pipeline's stages on a small table with planted cases."""

import random

import corpus_pipeline
from corpusmill.llm import common


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "river stone garden window market letter evening morning".split() for b in ("", "s", "ing", "ed")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        text = prose(80)
        if kind == 1:
            text = " ".join(w + "***" for w in text.split())
        if kind == 2:
            text += " you stupid worthless idiot"
        rows.append((i, text))
        labels.append((i, int(kind != 1), int(kind == 2)))
    passage = prose(30)
    rows += [(1000, rows[0][1]), (1001, rows[0][1] + " More."), (1002, prose(40) + " " + passage + " " + prose(40)), (1003, None), (1004, "")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = common.table(spark, d, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, d))
        assert docs.columns == columns
        seen[name] = {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "neardup", "decontaminate", "packing"]
    clean = set(range(0, 300, 3))
    assert seen["toxicity"] >= clean and not seen["toxicity"] & set(range(2, 300, 3))
    assert seen["quality"] >= clean and not seen["quality"] & set(range(1, 300, 3))
    assert seen["neardup"] >= clean and not seen["neardup"] & {1000, 1001}
    assert seen["decontaminate"] >= clean and 1002 not in seen["decontaminate"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()} == seen["decontaminate"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables and repeated ids: each stage gives what its docstring says."""
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "fr", "s", 1), (3, None, None, None, None), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    left = [5, 5, 3, 3]
    for (name, stage), n in zip(corpus_pipeline.STAGES, left, strict=False):
        docs = common.cut(stage(spark, docs, d))
        assert docs.count() == n, name
    assert sorted(docs.select("doc_id").collect(), key=str) == [(1,), (3,), (None,)]
