import hashlib
import unicodedata

from corpusmill.functions import hashing
from corpusmill.functions import text as T
from pyspark.sql import functions as F


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_normalize(spark):
    raw = "가나\u200b\u3000다\r\n\n\n\n\ufeff라 "
    got = one(spark, raw, T.normalize_text(F.col("t")).alias("n")).n
    assert got == "가나 다\n\n라"
    assert one(spark, got, T.normalize_text(F.col("t")).alias("n")).n == got
    assert one(spark, None, T.normalize_text(F.col("t")).alias("n")).n == ""
    assert one(spark, unicodedata.normalize("NFD", "é\x00"), T.normalize_text(F.col("t")).alias("n")).n == "é"


def test_trailing_space_only_before_line_feed(spark):
    assert one(spark, "a \u2028b \nc", T.clean_spaces(F.col("t")).alias("n")).n == "a \u2028b\nc"


def test_char_stats(spark):
    s = one(spark, "가나다abc123", T.char_stats(F.col("t")).alias("s")).s
    assert (s.n_chars, s.hangul_ratio, s.latin_ratio, s.digit_ratio) == (9, 3 / 9, 3 / 9, 3 / 9)
    assert one(spark, "", T.char_stats(F.col("t")).alias("s")).s.latin_ratio == 0


def test_words_bytes_and_shares(spark):
    r = one(spark, "나는 학교에 간다", T.count_words(F.col("t")).alias("w"), F.octet_length("t").alias("b"), T.latin_share(F.col("t")).alias("l"))
    assert (r.w, r.b, r.l) == (3, 23, 0)


def test_ngrams_against_python(spark):
    text = "시험패스 공부자료 최신덤프 " * 60
    c = "".join(text.split())
    want = len({c[i : i + 5] for i in range(len(c) - 4)}) / (len(c) - 4)
    assert one(spark, text, T.distinct_ngram_ratio(T.squeezed(F.col("t"))).alias("r")).r == want


def test_line_repeats(spark):
    f = lambda t: one(spark, t, T.line_repeat_ratio(T.lines(F.col("t"))).alias("r")).r
    assert f("a\nb\na\nc") == 0.5
    assert f("a\na\na") == 0
    assert f("a\n \n" * 20) == 1


def test_hosts(spark):
    urls = {"https://KO.wikipedia.org/wiki": "ko.wikipedia.org", "blog.naver.com/x": "blog.naver.com", "http://[bad": "", "http://.a.org:80/": ""}
    for u, h in list(urls.items())[:3]:
        assert one(spark, u, T.host_of(F.col("t")).alias("h")).h == h


def test_blake2b_vectors(spark):
    f = hashing.blake2b_unit(64)
    got = one(spark, "42:doc-1", f(F.col("t")).alias("u")).u
    assert abs(got - 0.73237231047769) < 1e-12
    assert one(spark, "가나다", F.sha2("t", 256).alias("h")).h == hashlib.sha256("가나다".encode()).hexdigest()


def test_byte_alphabet(spark):
    table = T.byte_alphabet()
    assert len(set(table.values())) == 256
    token = "".join(table[b] for b in "가 나".encode())
    r = one(spark, token, T.token_bytes(F.col("t")).alias("n"), T.byte_surface(True)(F.col("t")).alias("s"))
    assert (r.n, r.s) == (7, "가 나")
    half = table[0xEA]
    assert one(spark, half, T.byte_surface(True)(F.col("t")).alias("s")).s is None
    assert one(spark, half, T.byte_surface(False)(F.col("t")).alias("s")).s == "\ufffd"


def test_notes_and_arguments(spark):
    r = one(spark, "steps=12 ko_vs_ledger=-0.000001", T.note_value(F.col("t"), "steps").alias("a"), T.note_value(F.col("t"), "ko_vs_ledger").alias("b"), T.note_value(F.col("t"), "none").alias("c"))
    assert (r.a, r.b, r.c) == (12.0, -0.000001, None)
    assert one(spark, "--k v --flag --n 3", T.parse_argv(F.col("t")).alias("m")).m == {"k": "v", "flag": "", "n": "3"}


def test_han_ranges_differ(spark):
    r = one(spark, "\U0002ffff", F.col("t").rlike(T.HAN_BENCH).alias("a"), F.col("t").rlike(T.HAN_CENSUS).alias("b"))
    assert (r.a, r.b) == (False, True)
