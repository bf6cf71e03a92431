"""Operators on embedding tables (id, vec) and on model shapes."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from .budget import global_rank

#: Columns of the rows of a search.
NEAREST = "query_id bigint, id bigint, cosine double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, id, cosine): the k nearest rows of each query, the lower id first at a tie.

    Queries go to the executors in blocks of ``block`` vectors; each task keeps
    its k best rows a query, and the best of those are taken. Sums run over the
    elements in order, so equal vectors have equal cosines. Rows whose cosine
    is not a number come last, as null.
    """
    ranked = scratch.cut(global_rank(queries.select("id", "vec"), [F.col("id")], "__k").withColumn("__b", F.floor((F.col("__k") - 1) / block)))
    blocks = sorted(r[0] for r in ranked.select("__b").distinct().collect())
    best = [scratch.cut(_block_topk(ranked.filter(F.col("__b") == b).select("id", "vec").toPandas(), vectors, k)) for b in blocks]
    empty = vectors.sparkSession.createDataFrame([], NEAREST)
    rows = functools.reduce(DataFrame.unionByName, best, empty)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def _block_topk(queries: pd.DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query of a block in every partition of ``vectors``."""
    qid, qvec = queries["id"].to_numpy(), np.stack(queries["vec"].to_list()).astype("float64")

    def run(batches):
        def lengths(m):
            return np.sqrt(sum(m[:, i] * m[:, i] for i in range(m.shape[1])))

        qn = lengths(qvec)
        values, ids = np.empty((len(qid), 0)), np.empty((len(qid), 0), "int64")
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                v = np.stack(part["vec"].to_list()).astype("float64")
                c = np.zeros((len(qid), len(v)))
                for i in range(v.shape[1]):
                    c += qvec[:, i, None] * v[None, :, i]
                with np.errstate(divide="ignore", invalid="ignore"):
                    c /= qn[:, None] * lengths(v)[None, :]
                c[~np.isfinite(c)] = -np.inf
                values = np.concatenate([values, c], axis=1)
                ids = np.concatenate([ids, np.broadcast_to(part["id"].to_numpy(), c.shape)], axis=1)
                first = np.lexsort((ids, -values))[:, :k]
                values, ids = np.take_along_axis(values, first, 1), np.take_along_axis(ids, first, 1)
        if values.shape[1]:
            yield pd.DataFrame({"query_id": np.repeat(qid, values.shape[1]), "id": ids.ravel(), "cosine": values.ravel()})

    rows = vectors.select("id", "vec").mapInPandas(run, NEAREST)
    return rows.withColumn("cosine", F.when(F.col("cosine") > float("-inf"), F.col("cosine")))


def reference_stats(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean and population deviation of all elements of rows without NaN: sums by row, then over rows."""
    ok = vectors.filter(~F.exists(vec, F.isnan))
    v = F.transform(vec, lambda x: x.cast("double"))
    sums = ok.select(F.size(vec).alias("n"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("s"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    return sums.agg(n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))).alias("std"))


def id_mapping(new: DataFrame, old: DataFrame) -> DataFrame:
    """Each new id's old id by token; -1 if the token is new."""
    return new.select("token", F.col("token_id").alias("new_id")).join(old.select("token", F.col("token_id").alias("old_id")), "token", "left").select("new_id", F.coalesce("old_id", F.lit(-1)).alias("old_id"))


def rearrange(mapping: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """Rows in their new places; NaN where there is none yet."""
    empty = F.array_repeat(F.lit(float("nan")), width)
    own = vectors.select(F.col("id").alias("old_id"), F.col("vec").cast("array<double>").alias("vec"))
    return mapping.join(own, "old_id", "left").select(F.col("new_id").alias("id"), F.coalesce("vec", empty).alias("vec"), F.col("vec").isNull().alias("todo"))


def padded_size(n: Column, multiple: int = 128) -> Column:
    return F.ceil(n / multiple) * multiple


def parents(slots: DataFrame, vocab: DataFrame) -> DataFrame:
    """Slots with the ids of both parts; a slot with a missing part goes."""
    ids = vocab.select("token", "token_id")
    return slots.select(F.col("token_id").alias("id"), "left", "right").join(ids.toDF("left", "left_id"), "left").join(ids.toDF("right", "right_id"), "right").select("id", "left_id", "right_id")


def parent_mean(slots: DataFrame, vectors: DataFrame, weight: Column | None = None) -> DataFrame:
    """Weighted mean of both parents' vectors; ``weight`` is the left parent's share (one half by default)."""
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    w = F.lit(0.5) if weight is None else weight
    both = slots.join(v.toDF("left_id", "lv"), "left_id").join(v.toDF("right_id", "rv"), "right_id").withColumn("__w", w)
    mean = F.transform(F.arrays_zip("lv", "rv"), lambda z: z["lv"] * F.col("__w") + z["rv"] * (1 - F.col("__w")))
    return both.select("id", mean.alias("vec"))


def left_weight(kind: str, left: Column, right: Column) -> Column:
    """Left share by token length, by inverse frequency (1 / (f + 1)), or uniform; both shares add up to 1."""
    if kind == "uniform":
        return F.lit(0.5)
    a, b = (left, right) if kind == "length" else (1.0 / (left + 1), 1.0 / (right + 1))
    return F.coalesce(F.try_divide(a, a + b), F.lit(0.5))


def fill_random(rows: DataFrame, mean: float, std: float, width: int, seed: int = 0) -> DataFrame:
    """Rows still to do get normal values that depend on the id and the seed alone."""
    unit = lambda *k: (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), *map(F.lit, k[:1]), k[1]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: mean + std * F.sqrt(-2 * F.ln(unit(1, i))) * F.cos(2 * 3.141592653589793 * unit(2, i)))
    return rows.withColumn("vec", F.when(F.col("todo"), normal).otherwise(F.col("vec")))


def unfilled(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.exists("vec", F.isnan)).select("id")


def rescale(vectors: DataFrame, factor: float) -> DataFrame:
    return vectors.withColumn("vec", F.transform("vec", lambda x: x * factor))


def transplant(base: DataFrame, donor: DataFrame, ids: DataFrame) -> DataFrame:
    """The donor's rows for the given ids; all others as they were, with a flag."""
    new = donor.join(ids, "id", "left_semi").select("id", F.col("vec").alias("__new"))
    return base.join(new, "id", "left").select("id", F.coalesce("__new", "vec").alias("vec"), F.col("__new").isNotNull().alias("moved"))


def permute(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Each chosen row gets the next chosen row's vector, the last one the first's: no row keeps its own."""
    ranked = scratch.cut(global_rank(vectors.join(ids, "id", "left_semi").select("id"), [F.col("id")], "k"))
    n = ranked.agg(F.count("*").alias("n"))
    to = ranked.crossJoin(F.broadcast(n)).select((F.pmod(F.col("k"), F.col("n")) + 1).alias("k"), "id")
    source = to.join(ranked.withColumnRenamed("id", "__from"), "k").select("id", "__from")
    moved = source.join(vectors.select(F.col("id").alias("__from"), "vec"), "__from").select("id", "vec")
    return vectors.join(ids, "id", "left_anti").select("id", "vec").unionByName(moved)


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean Euclidean move of the rows that moved."""
    both = before.select("id", F.col("vec").alias("a")).join(after.select("id", F.col("vec").alias("b")), "id")
    d = F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double"))
    rows = both.select("id", d.alias("d")).select(norm(F.col("d")).alias("move"))
    return rows.filter("move > 0").agg(F.count("*").alias("n_moved"), F.avg("move").alias("mean_move"))


def norm_ratio(norm_a: Column, size_a: Column, norm_b: Column, size_b: Column) -> Column:
    """Ratio of root mean squares of two parameter groups."""
    return F.try_divide(norm_a / F.sqrt(size_a), norm_b / F.sqrt(size_b))


def zero_pads(vectors: DataFrame, used: int) -> DataFrame:
    """Rows from id ``used`` on are padding and become zeros."""
    return vectors.withColumn("vec", F.when(F.col("id") >= used, F.transform("vec", lambda x: x * 0.0)).otherwise(F.col("vec")))


def assert_filled(vectors: DataFrame, used: int | None = None) -> None:
    """Raises if a row that isn't padding still holds NaN."""
    left = unfilled(vectors if used is None else vectors.filter(F.col("id") < used))
    if bad := [r[0] for r in left.orderBy("id").limit(10).collect()]:
        raise ValueError(f"rows without values: {bad}")


def damage(vectors: DataFrame, ids: DataFrame, how: str, parents: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Chosen rows spoiled: normal values with the others' deviation, each other's vectors, or the mean of both parents.

    ``parents``: (id, left_id, right_id), for "mean"; a chosen row without both raises.
    """
    chosen, other = vectors.join(ids, "id", "left_semi"), vectors.join(ids, "id", "left_anti").select("id", "vec")
    if how == "permute":
        return permute(vectors, ids)
    if how == "random":
        width = len(vectors.select("vec").first()[0])
        std = reference_stats(other).first()["std"]
        return other.unionByName(fill_random(chosen.select("id", F.col("vec").cast("array<double>").alias("vec"), F.lit(True).alias("todo")), 0.0, std, width, seed).select("id", F.col("vec").cast(vectors.schema["vec"].dataType).alias("vec")))
    if how != "mean":
        raise ValueError(f"{how!r} is not random, permute or mean")
    means = parent_mean(parents.join(ids, "id", "left_semi"), vectors)
    if not chosen.select("id").join(means, "id", "left_anti").isEmpty():
        raise ValueError("a chosen row has no parents")
    return other.unionByName(means.select("id", F.col("vec").cast(vectors.schema["vec"].dataType).alias("vec")))


def damage_report(before: DataFrame, after: DataFrame, ids: DataFrame) -> DataFrame:
    """Mean move of the chosen rows, and the deviation of their elements before and after."""
    std = lambda v, name: reference_stats(v.join(ids, "id", "left_semi")).select(F.col("std").alias(name))
    return moves(before, after).crossJoin(F.broadcast(std(before, "std_before"))).crossJoin(F.broadcast(std(after, "std_after")))


def parameter_counts(models: DataFrame) -> DataFrame:
    """``models`` (vocab_size, hidden_size, n_layers, n_heads, n_kv_heads, head_dim, intermediate_size, tie_word_embeddings) with counts of parameters and cache bytes a token."""
    v, h, layers, kv, hd, inner = (F.col(c) for c in ("vocab_size", "hidden_size", "n_layers", "n_kv_heads", "head_dim", "intermediate_size"))
    emb = v * h
    layer = 2 * h * h + 2 * h * (kv * hd) + 3 * h * inner
    total = emb + layers * layer + F.when(F.col("tie_word_embeddings"), F.lit(0)).otherwise(emb)
    return models.select("*", emb.alias("embedding_params"), total.alias("total_params"), F.round(emb / total, 4).alias("embedding_share"), kv_bytes_per_token(layers, kv, hd).alias("kv_bytes_per_token"))


def kv_bytes_per_token(layers: Column, kv_heads: Column, head_dim: Column, width: int = 2) -> Column:
    """Keys and values of all layers."""
    return 2 * layers * kv_heads * head_dim * width


def kv_cache_mb(tokens: Column, per_token: Column) -> Column:
    return tokens * per_token / float(1 << 20)
