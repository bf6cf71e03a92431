"""Token statistics and vocabulary surgery on relational vocabularies.

vocab(token, token_id), merges(rank, left, right); token statistics have
token_id, token, count_total, count_ko, count_en, count_code, is_leaf, is_protected.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import budget, stats


def encode_udf(load: Callable, flags: bool = False):
    """Arrow UDF: ids of a tokenizer that ``load()`` gives once a worker; with ``flags``, whether each id opens a segment too."""
    if not flags:

        @F.pandas_udf("array<int>")
        def ids(s: pd.Series) -> pd.Series:
            t = load()
            return s.map(lambda x: t.encode(x or "", add_special_tokens=False).ids)

        return ids

    @F.pandas_udf("ids array<int>, opens array<boolean>")
    def both(s: pd.Series) -> pd.DataFrame:
        t = load()
        own, opens = [], []
        for x in s:
            e = t.encode(x or "", add_special_tokens=False)
            own.append(e.ids)
            opens.append([i == 0 or w != e.word_ids[i - 1] for i, w in enumerate(e.word_ids)])
        return pd.DataFrame({"ids": own, "opens": opens})

    return both


def token_counts(tokens: DataFrame, vocab: DataFrame | None = None, token: str = "token", lang: str = "lang", langs: list[str] | None = None) -> DataFrame:
    """Occurrences by language and in total of each exploded token; tokens of ``vocab`` that never occur get zeros."""
    counted = tokens.groupBy(token, lang).agg(F.count("*").alias("n"))
    langs = langs or sorted(r[0] for r in tokens.select(lang).distinct().collect())
    wide = counted.groupBy(token).agg(F.sum("n").alias("count_total"), *(F.sum(F.when(F.col(lang) == x, F.col("n")).otherwise(0)).alias(f"count_{x}") for x in langs))
    return wide if vocab is None else vocab.join(wide, token, "left").fillna(0, ["count_total", *(f"count_{x}" for x in langs)])


def merge_parts(merges: DataFrame) -> DataFrame:
    """Tokens that are a part of some merge."""
    return merges.select(F.explode(F.array("left", "right")).alias("token")).distinct()


def with_leaf(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """``vocab`` with is_leaf: no merge uses the token."""
    parts = merge_parts(merges).withColumn("__part", F.lit(True))
    return vocab.join(parts, "token", "left").withColumn("is_leaf", F.col("__part").isNull()).drop("__part")


def merge_parents(merges: DataFrame) -> DataFrame:
    """(token, left, right) of the first rule that makes each token."""
    made = merges.groupBy(F.concat("left", "right").alias("token")).agg(F.min_by(F.struct("left", "right"), "rank").alias("p"))
    return made.select("token", "p.left", "p.right")


def eligible(stats: DataFrame, vocab: DataFrame, protected: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Tokens that may be pruned: unprotected leaves of the live vocabulary below every floor; rarest first."""
    rows = stats.filter("is_leaf and not is_protected").join(protected.select("token_id"), "token_id", "left_anti").join(vocab.select("token"), "token", "left_semi")
    for column, floor in floors.items():
        rows = rows.filter(F.col(column) < floor)
    return budget.global_rank(rows, [F.col("count_total"), F.col("token_id")], "prune_rank")


def cumulative(ranked: DataFrame, marks: list[int], total: int) -> DataFrame:
    """Occurrences of the first N ranked tokens, and their share, at each mark."""
    return budget.running_sum(ranked, "prune_rank", F.col("count_total"), "cum_count").filter(F.col("prune_rank").isin(marks)).select("prune_rank", "cum_count", (F.col("cum_count") / float(total)).alias("cum_share"))


def pair_counts(docs: DataFrame, ids: str = "ids", opens: str | None = None) -> DataFrame:
    """Occurrences of adjacent pairs; pairs that cross a segment don't count if ``opens`` is given.

    Pairs come from each document's own array: no window and no sort.
    """
    n = F.size(ids)
    places = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    inside = lambda i: F.lit(True) if opens is None else ~F.col(opens)[i + 1]
    pairs = docs.select(F.explode(F.transform(F.filter(places, inside), lambda i: F.struct(F.col(ids)[i].alias("left_id"), F.col(ids)[i + 1].alias("right_id")))).alias("p"))
    return pairs.groupBy("p.left_id", "p.right_id").agg(F.count("*").alias("count"))


def donors(pairs: DataFrame, vocab: DataFrame, top: int) -> DataFrame:
    """The most frequent pairs whose string is new: known ids only, the first rank of a string wins, ranks keep their gaps."""
    ranked = pairs.orderBy(F.desc("count"), "left_id", "right_id").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "left_id", "right_id")))
    names = vocab.select("token_id", "token")
    rows = ranked.join(names.toDF("left_id", "left"), "left_id").join(names.toDF("right_id", "right"), "right_id")
    rows = rows.withColumn("new_token", F.concat("left", "right")).join(vocab.select(F.col("token").alias("new_token")), "new_token", "left_anti")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("new_token").orderBy("rank"))).filter("__n = 1")
    return first.select("rank", "left_id", "right_id", "left", "right", "new_token", "count", F.col("count").alias("gain"))


def drop_tokens(vocab: DataFrame, merges: DataFrame, pruned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary without the pruned tokens, renumbered; its merges; and the ids that changed."""
    left = vocab.join(pruned.select("token"), "token", "left_anti").withColumn("new_id", F.row_number().over(Window.orderBy("token_id")) - 1)
    kept = merges.join(pruned.select(F.col("token").alias("__t")), F.concat("left", "right") == F.col("__t"), "left_anti")
    return left.select("token", F.col("new_id").alias("token_id")), kept, left.filter("new_id <> token_id").select(F.col("token_id").alias("old_id"), "new_id")


def replace_tokens(vocab: DataFrame, merges: DataFrame, pruned: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Free slots filled with donors by rank, their merges put last; the size stays."""
    unknown = pruned.join(vocab, "token", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("a token to prune is not in the vocabulary")
    slots = vocab.join(pruned.select("token"), "token", "left_semi").select("token_id", F.row_number().over(Window.orderBy("token_id")).alias("k"))
    ranked = new.withColumn("k", F.row_number().over(Window.orderBy("rank")))
    if ranked.select("new_token").distinct().count() < ranked.count():
        raise ValueError("two donors have the same string")
    if ranked.count() < slots.count():
        raise ValueError("fewer donors than free slots")
    placed = slots.join(ranked, "k")
    kept = merges.join(pruned.select(F.col("token").alias("__t")), F.concat("left", "right") == F.col("__t"), "left_anti")
    last = merges.agg(F.coalesce(F.max("rank"), F.lit(-1)).alias("last"))
    added = placed.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("k")).cast("int").alias("rank"), "left", "right")
    out = vocab.join(pruned.select("token"), "token", "left_anti").unionByName(placed.select(F.col("new_token").alias("token"), "token_id"))
    return out, kept.select("rank", "left", "right").unionByName(added), placed.select("token_id", F.col("new_token").alias("token"), "left", "right")


def broken_merges(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges with a part or a result outside the vocabulary, and which."""
    parts = merges.select("rank", F.explode(F.array(F.struct(F.lit("left").alias("part"), F.col("left").alias("token")), F.struct(F.lit("right").alias("part"), F.col("right").alias("token")), F.struct(F.lit("result").alias("part"), F.concat("left", "right").alias("token")))).alias("p"))
    return parts.select("rank", "p.part", "p.token").join(vocab.select("token"), "token", "left_anti")


def protected_ids(*sets: DataFrame) -> DataFrame:
    """Union of byte, special and extra ids."""
    out = sets[0].select("token_id")
    for s in sets[1:]:
        out = out.unionByName(s.select("token_id"))
    return out.distinct()


def lost_protected(before: DataFrame, after: DataFrame) -> DataFrame:
    """Protected ids that a surgery removed."""
    return before.select("token_id").subtract(after.select("token_id"))


def activation_rate(tokens: DataFrame, donor_ids: DataFrame) -> DataFrame:
    """Share of donor ids that occur at all."""
    seen = tokens.join(donor_ids, "token_id", "left_semi").agg(F.countDistinct("token_id").alias("n_active"))
    return seen.crossJoin(F.broadcast(donor_ids.agg(F.count("*").alias("n_donors")))).withColumn("rate", F.try_divide("n_active", "n_donors"))


def fire_digest(fires: DataFrame, scale: float) -> DataFrame:
    """Scaled occurrences of new tokens: total, upper median, mean, maximum, buckets."""
    rows = fires.withColumn("scaled", F.col("fires_sample") * scale)
    middle = stats.order_statistics(rows.select("scaled"), [], "scaled", {"upper_median": F.floor(F.col("n") / 2) + 1}).select("upper_median")
    buckets = {"n_zero": F.col("scaled") == 0, "n_under_10": (F.col("scaled") > 0) & (F.col("scaled") < 10), "n_under_100": (F.col("scaled") >= 10) & (F.col("scaled") < 100), "n_under_1000": (F.col("scaled") >= 100) & (F.col("scaled") < 1000), "n_over": F.col("scaled") >= 1000}
    out = rows.agg(F.count("*").alias("n"), F.sum("scaled").alias("total"), F.avg("scaled").alias("mean"), F.max("scaled").alias("max"), *(F.count_if(c).alias(k) for k, c in buckets.items()))
    return out.join(F.broadcast(middle), F.lit(True), "left").select("n", "total", "upper_median", "mean", "max", *buckets)


def exposure_digest(fires: DataFrame, scale: float, few: float = 100.0) -> DataFrame:
    """Number of new tokens, those the sample lacks, those under ``few`` scaled occurrences, and the upper median."""
    rows = fires.withColumn("scaled", F.col("fires_sample") * scale)
    middle = stats.order_statistics(rows.select("scaled"), [], "scaled", {"upper_median": F.floor(F.col("n") / 2) + 1}).select("upper_median")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("fires_sample") == 0).alias("n_zero"), F.count_if(F.col("scaled") < few).alias("n_few"))
    return out.join(F.broadcast(middle), F.lit(True), "left")


def gate(changes: DataFrame) -> DataFrame:
    """Verdicts on a candidate's relative change of tokens per character by language.

    Fixed values: Korean must gain 15%; English and code are reported beyond 5%
    and 10%, refused beyond 25% and 40%; an absent language is refused.
    """
    limits = changes.sparkSession.createDataFrame([("ko", None, -0.15), ("en", 0.05, 0.25), ("code", 0.10, 0.40)], "lang string, report double, hard double")
    rows = F.broadcast(limits).join(changes, "lang", "left")
    level = (
        F.when(F.col("change").isNull(), F.lit("fail"))
        .when(F.col("lang") == "ko", F.when(F.col("change") <= F.col("hard"), F.lit("ok")).otherwise(F.lit("fail")))
        .when(F.col("change") > F.col("hard"), F.lit("fail"))
        .when(F.col("change") > F.col("report"), F.lit("report"))
        .otherwise(F.lit("ok"))
    )
    return rows.select("lang", "change", level.alias("level"))


def crossings(docs: DataFrame, ids: str = "ids", opens: str = "opens") -> DataFrame:
    """Adjacent pairs, those that cross a segment, and their share."""
    n = F.greatest(F.size(ids) - 1, F.lit(0)).cast("bigint")
    cross = F.size(F.filter(F.slice(opens, 2, 1 << 30), lambda x: x)).cast("bigint")
    return docs.agg(F.sum(n).alias("n_pairs"), F.sum(cross).alias("n_cross")).withColumn("share", F.try_divide("n_cross", "n_pairs"))


def census_singles(tokens: DataFrame, pure: str = "pure_han", removed: str = "removed", count: str = "count_total") -> DataFrame:
    """Of tokens that are one character of the class: all, removed ones, and the median, greatest count and how often it occurs among the removed."""
    single = tokens.filter(F.col(pure) & (F.length("surface") == 1))
    gone = single.filter(F.col(removed))
    middle = stats.percentiles(gone.select(count), [], count, {"removed_median": 0.5}).select("removed_median")
    top = gone.groupBy(count).agg(F.count("*").alias("c")).agg(F.max(F.struct(count, "c")).alias("t")).select(F.col("t")[count].alias("removed_max"), F.coalesce("t.c", F.lit(0)).alias("removed_at_max"))
    return single.agg(F.count("*").alias("n"), F.count_if(F.col(removed)).alias("n_removed")).crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(top))


def census_top(tokens: DataFrame, n: int = 10, pure: str = "pure_han", removed: str = "removed", count: str = "count_total") -> DataFrame:
    """The most frequent single-character tokens among the removed and among the kept."""
    single = tokens.filter(F.col(pure) & (F.length("surface") == 1))
    parts = [single.filter(F.col(removed) == v).orderBy(F.desc(count), "token_id").limit(n).select("token_id", "surface", count, removed) for v in (True, False)]
    return parts[0].unionByName(parts[1])


def census(tokens: DataFrame, has: str = "has_han", removed: str = "removed") -> DataFrame:
    """Tokens with a property by length capped at 5: all, and those removed."""
    return tokens.filter(F.col(has)).groupBy(F.least(F.length("surface"), F.lit(5)).alias("length")).agg(F.count("*").alias("n"), F.count_if(F.col(removed)).alias("n_removed"))
