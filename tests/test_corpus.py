import hashlib

import numpy as np
from corpusmill.operators import dedup, domain, quality
from pyspark.sql import functions as F


def reasons(spark, texts, language):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.reject_reason for r in quality.check(df, language).orderBy("i").collect()]


def test_quality_reasons(spark):
    article = "\n".join(f"오늘 서울에서 열린 회의의 {i}번째 안건은 지역 도서관 예산과 {chr(0xAC00 + 37 * i)}{chr(0xB098 + 11 * i)} 계획이었다고 관계자들이 차례로 발표했다" for i in range(8))
    got = reasons(spark, ["짧다", "a" * 500, "시험패스 공부자료 최신덤프 " * 60, "같은 줄이 계속 나오는 문서이다\n" * 20, article], "ko")
    assert got[:2] == ["too_short", "low_hangul"]
    assert got[2] in ("repeated_ngram", "repeated_lines")
    assert got[3] == "repeated_lines"
    assert got[4] is None


def test_reason_stats(spark):
    df = spark.createDataFrame([(None,), ("too_short",), ("too_short",)], "reject_reason string")
    assert {r.reason: r.n for r in quality.reason_stats(df).collect()} == {"kept": 1, "too_short": 2}


def test_host_rules(spark):
    want = {
        "ko.wikipedia.org": "encyclopedia",
        "blog.naver.com": "blog",
        "www.yna.co.kr": "news",
        "docs.python.org": "technical",
        "github.com": "code",
        "mynewsletter.example.com": "news",
        "blog.koreadaily.com": "blog",
        "notseoul.co.kr.example.org": None,
        "other.example.com": None,
    }
    df = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r.h: r.d for r in df.select("h", domain.classify_host(F.col("h")).alias("d")).collect()} == want


def test_content_rules(spark):
    texts = {"작성일 2020 조회 33": "community", "장관은 이렇게 밝혔다": "news", "다음 단계를 클릭하": "technical", "모델명: ABC-1234": "ko_en_mixed", "좋았어요 했어요 하네요": "blog", "제가 내가 갔는데 거든요": "blog", "아무것도 없다": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.d for r in df.select("t", domain.classify_content(F.col("t")).alias("d")).collect()} == texts


def test_exact_dedup_and_cap(spark):
    df = spark.createDataFrame([(0, "h1", "x"), (1, "h1", "x"), (2, "h2", ""), (3, "h3", "x")], "ord int, sha256 string, host string")
    assert sorted(r.ord for r in dedup.exact_dedup(df).collect()) == [0, 2, 3]
    assert sorted(r.ord for r in dedup.host_cap(df, "host", "ord", 2).collect()) == [0, 1, 2]


def test_minhash_vector():
    h = np.array([1874661006], np.uint64)
    assert int.from_bytes(hashlib.blake2b("가나다라마바사아".encode(), digest_size=4).digest(), "big") == h[0]
    a, b = dedup.permutations()
    assert (int(a[0]), int(b[0])) == (1784621144001422544, 1463560800993222872)
    with np.errstate(over="ignore"):
        v = (a[:2] * h[0] + b[:2]) % dedup.PRIME & np.uint64(0xFFFFFFFF)
    assert v.tolist() == [25488441, 302945629]


def test_near_dedup(spark):
    base = "서울에서 열린 회의에서 도서관 예산을 다루었다. 참석자들은 의견을 나누었다. "
    df = spark.createDataFrame([(0, base * 8), (1, base * 8 + " 끝."), (2, "전혀 다른 문서의 내용이 여기에 길게 적혀 있습니다 " * 8)], "ord int, text string")
    signed = df.select("ord", dedup.minhash_udf()(F.col("text")).alias("signature"))
    got = {r.id: (r.component, r.kept) for r in dedup.near_dedup(signed).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (2, True)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a int, b int")
    got = {r.id: r.component for r in dedup.components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[200] == 100


def test_split(spark):
    df = spark.range(20_000).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("d"))
    shares = {r.s: r.n / 20_000 for r in df.groupBy(dedup.hash_split(F.col("d")).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert abs(shares["train"] - 0.9) < 0.01 and abs(shares["dev"] - 0.05) < 0.005
    want = int.from_bytes(hashlib.blake2b(b"42:doc-7", digest_size=8).digest(), "big") / 2**64
    own = df.filter("d = 'doc-7'").select(dedup.hash_split(F.col("d")).alias("s")).first().s
    assert own == ("train" if want < 0.9 else "dev" if want < 0.9 + 0.05 else "final_test")


def test_split_shares_must_add_up(spark):
    import pytest

    with pytest.raises(ValueError):
        dedup.hash_split_sha256(F.lit("x"), train=0.9, dev=0.2)


def test_mixed_pool(spark):
    rows = [("ko", i, 100) for i in range(50)] + [("en", i, 100) for i in range(50)]
    df = spark.createDataFrame(rows, "lang string, ord int, n_bytes int")
    got = dedup.mixed_pool(df, {"ko": 0.75, "en": 0.25}, 2000, 1.0).orderBy("pool_ord").collect()
    assert [r.lang for r in got].count("ko") == 15 and [r.lang for r in got].count("en") == 5
    first = [r.lang for r in got[:8]]
    assert first.count("ko") == 6
