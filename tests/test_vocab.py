import pytest
from corpusmill.operators import budget, vocab


def toy(spark):
    """Six tokens and two merges."""
    return spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("ab", 3), ("abc", 4), ("z", 5)], "token string, token_id int"), spark.createDataFrame([(0, "a", "b"), (1, "ab", "c")], "rank int, left string, right string")



def test_drop(spark):
    v, m = toy(spark)
    new, merges, ids = vocab.drop_tokens(v, m, spark.createDataFrame([("abc",)], "token string"))
    assert {r.token: r.token_id for r in new.collect()} == {"a": 0, "b": 1, "c": 2, "ab": 3, "z": 4}
    assert merges.count() == 1
    assert [(r.old_id, r.new_id) for r in ids.collect()] == [(5, 4)]


def test_replace(spark):
    v, m = toy(spark)
    pruned = spark.createDataFrame([("abc",)], "token string")
    donor = "rank int, left string, right string, new_token string"
    new, merges, slots = vocab.replace_tokens(v, m, pruned, spark.createDataFrame([(1, "a", "z", "az")], donor))
    assert new.count() == 6 and slots.first().token_id == 4
    last = merges.orderBy("rank").collect()[-1]
    assert (last.left, last.right) == ("a", "z")
    assert vocab.broken_merges(new, merges).isEmpty()
    for bad, names in ((spark.createDataFrame([], donor), ["abc"]), (spark.createDataFrame([(1, "a", "z", "az")], donor), ["none"]), (spark.createDataFrame([(1, "a", "bc", "abc2"), (2, "ab", "c", "abc2")], donor), ["abc"])):
        with pytest.raises(ValueError):
            vocab.replace_tokens(v, m, spark.createDataFrame([(n,) for n in names], "token string"), bad)


def test_leaves_and_parents(spark):
    v, m = toy(spark)
    assert {r.token for r in vocab.with_leaf(v, m).filter("is_leaf").collect()} == {"abc", "z"}
    assert {r.token: (r.left, r.right) for r in vocab.merge_parents(m).collect()} == {"ab": ("a", "b"), "abc": ("ab", "c")}


def test_pairs_stay_inside_segments(spark):
    df = spark.createDataFrame([([1, 2, 3], [True, False, True]), ([1, 2], [True, False]), ([], []), ([5], [True])], "ids array<int>, opens array<boolean>")
    got = {(r.left_id, r.right_id): r["count"] for r in vocab.pair_counts(df, opens="opens").collect()}
    assert got == {(1, 2): 2}
    assert vocab.pair_counts(df).count() == 2


def test_donor_strings_are_unique(spark):
    v = spark.createDataFrame([("a", 0), ("bc", 1), ("ab", 2), ("c", 3)], "token string, token_id int")
    pairs = spark.createDataFrame([(2, 3, 9), (0, 1, 8), (0, 99, 7), (0, 3, 6)], "left_id int, right_id int, count long")
    got = vocab.donors(pairs, v, 10).orderBy("rank").collect()
    assert [(r.rank, r.new_token) for r in got] == [(1, "abc"), (4, "ac")]


def test_pack_against_python(spark):
    lens = [5, 0, 3, 20, 1, 1, 9]
    df = spark.createDataFrame([(i, n, n) for i, n in enumerate(lens)], "ord int, n_tokens int, n_bytes int")
    stream = [i for i, n in enumerate(lens) if n for _ in range(n + 1)]
    want = [(c, stream[c * 8], stream[c * 8 + 7], 8) for c in range(len(stream) // 8)]
    got = [(r.chunk, r.first_ord, r.last_ord, r.n_tokens) for r in budget.pack_chunks(df, 8).orderBy("chunk").collect()]
    assert got == want


def test_running_sum_over_ranges(spark):
    df = spark.range(1000).selectExpr("id AS ord", "id % 7 AS v")
    got = [r.s for r in budget.running_sum(df, "ord", df.v, "s", width=64).orderBy("ord").collect()]
    run, want = 0, []
    for i in range(1000):
        run += i % 7
        want.append(run)
    assert got == want


def test_budget_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([(0, "x" * 60), (1, "y" * 5)], "ord int, text string")
    assert [r.ord for r in budget.budget_prefix(df, 30).collect()] == [0]
