"""Exact and MinHash near-duplicate removal, host caps, stable hash splits and leakage.

Order matters for "keep first": callers name a column that gives it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import hashing
from .budget import global_rank, running_sum


def exact_dedup(docs: DataFrame, key: str = "sha256", order: str = "ord") -> DataFrame:
    """The first row of each key; rows without a key are one key. A running minimum is combined before the shuffle, so hot keys don't gather."""
    first = docs.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    return docs.join(first, F.col(key).eqNullSafe(F.col("__key")) & F.col(order).eqNullSafe(F.col("__first"))).select(*docs.columns)


def host_cap(docs: DataFrame, host: str, order: str, cap: int, share: float = 0.0, max_docs: int = 0) -> DataFrame:
    """The first ``cap`` rows of each host in order; rows without a host aren't capped.

    Each of many parts of a host is capped first, so that a host with very many
    rows meets in one task with ``cap`` rows a part at most.
    """
    cap = max(cap, int(share * max_docs)) if share > 0 else cap
    free = F.coalesce(F.col(host), F.lit("")) == ""
    spread = F.xxhash64(order)

    def capped(df: DataFrame, parts: int) -> DataFrame:
        # Rows that aren't capped are dealt by their own hash, so the input is read once.
        part = F.when(free, spread).otherwise(F.pmod(spread, F.lit(parts)))
        rank = F.row_number().over(Window.partitionBy(host, "__part").orderBy(order))
        return df.withColumn("__part", part).withColumn("__rank", rank).filter(free | (F.col("__rank") <= cap)).drop("__part", "__rank")

    return capped(capped(docs, 64), 1)


def host_stats(docs: DataFrame, host: str, cap: int) -> DataFrame:
    """Each host's rows, the rows a cap keeps, and whether it binds."""
    n = F.count("*")
    return docs.groupBy(host).agg(n.alias("n_seen"), F.least(n, F.lit(cap)).alias("n_kept"), (n > cap).cast("int").alias("capped"))


# --- MinHash with the published signature -------------------------------------

SHINGLE, BOTTOM, PERMUTATIONS, BANDS, THRESHOLD, SEED = 8, 512, 64, 16, 0.80, 42
PRIME = np.uint64((1 << 61) - 1)


def shingles(text: str, size: int = SHINGLE) -> set[str]:
    """Distinct character shingles of the text with single blanks."""
    t = " ".join(text.split()).ljust(size)
    return {t[i : i + size] for i in range(len(t) - size + 1)}


def shingle_hashes(text: str, size: int = SHINGLE, bottom: int = BOTTOM) -> np.ndarray:
    """The smallest 32-bit BLAKE2b hashes of the distinct character shingles."""
    make = hashlib.blake2b
    found = np.unique(np.frombuffer(b"".join([make(s.encode(), digest_size=4).digest() for s in shingles(text, size)]), ">u4"))
    return found[:bottom].astype(np.uint64)


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers, then offsets, of a seeded generator."""
    rng = np.random.default_rng(seed)
    top = (1 << 61) - 1
    return rng.integers(1, top, n, dtype=np.uint64), rng.integers(0, top, n, dtype=np.uint64)


def minhash_udf(n: int = PERMUTATIONS, seed: int = SEED):
    """Arrow UDF: signature as longs. Products wrap at 2**64 before the modulus."""

    @F.pandas_udf("array<bigint>")
    def f(s: pd.Series) -> pd.Series:
        a, b = permutations(n, seed)

        def one(text):
            h = shingle_hashes(text or "")
            with np.errstate(over="ignore"):
                v = (a[:, None] * h[None, :] + b[:, None]) % PRIME
            return (v.min(axis=1) & np.uint64(0xFFFFFFFF)).astype(np.int64)

        return s.map(one)

    return f


def agreement(a: Column, b: Column, n: int = PERMUTATIONS) -> Column:
    """Share of equal slots of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(n)


def near_edges(signed: DataFrame, id_: str = "ord", signature: str = "signature", bands: int = BANDS, rows: int = PERMUTATIONS // BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): each member of a bucket whose signature agrees enough with the bucket's first member.

    Signatures meet only for pairs with the first, so a bucket of any size costs
    its size. The first is a minimum, combined before the shuffle.
    """
    banded = signed.select(F.col(id_).alias("id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(signature, i * rows + 1, rows)))).alias("band", "key"))
    first = banded.groupBy("band", "key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("band", "key", "first")
    pairs = banded.join(first, ["band", "key"]).filter("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    own = signed.select(F.col(id_), signature)
    both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    return both.filter(agreement(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges lead to. Minimum labels with pointer jumping; each round is a written table."""
    both = scratch.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"), F.lit(True).alias("changed")))
    while True:
        now = labels.select("id", "component")
        near = both.join(now.toDF("b", "low"), "b").groupBy("a").agg(F.min("low").alias("low"))
        step = now.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("old"), F.least("component", "low").alias("low"))
        best = F.least("low", "jump")
        new = scratch.cut(step.join(now.toDF("low", "jump"), "low").select("id", best.alias("component"), (F.col("old") != best).alias("changed")))
        scratch.release(labels)
        labels = new
        if labels.filter("changed").isEmpty():
            return labels.select("id", "component")


def near_dedup(signed: DataFrame, id_: str = "ord", signature: str = "signature") -> DataFrame:
    """(id, component, kept) of every row; the smallest id of a component is kept."""
    signed = scratch.cut(signed.select(id_, signature))
    found = components(near_edges(signed, id_, signature))
    rows = signed.select(F.col(id_).alias("id")).join(found, "id", "left")
    return rows.select("id", F.coalesce("component", "id").alias("component")).withColumn("kept", F.col("id") == F.col("component"))


# --- Splits ---------------------------------------------------------------------

TRAIN, DEV = 0.90, 0.05


def _bucket(u: Column, train: float, dev: float, test: float) -> Column:
    if abs(train + dev + test - 1) > 1e-9 or min(train, dev, test) < 0:
        raise ValueError("shares of the splits must add up to 1")
    return F.when(u < train, F.lit("train")).when(u < train + dev, F.lit("dev")).otherwise(F.lit("final_test"))


def hash_split(doc_id: Column, seed: int = 42, train: float = TRAIN, dev: float = DEV, test: float = 0.05) -> Column:
    """Split by a keyed BLAKE2b hash: a document's split never depends on the others."""
    return _bucket(hashing.blake2b_unit(64)(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), train, dev, test)


def hash_split_sha256(doc_id: Column, seed: int = 42, train: float = TRAIN, dev: float = DEV, test: float = 0.05) -> Column:
    """The same by SHA-256, in native expressions."""
    return _bucket(hashing.sha256_unit(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), train, dev, test)


def audit_half(sample_id: Column) -> Column:
    """dev or holdout of an audit sample."""
    return F.when(hashing.blake2b_unit(32)(sample_id) < 0.67, F.lit("dev")).otherwise(F.lit("holdout"))


def stable_sample(df: DataFrame, id_: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_).limit(k)


def split_audit(docs: DataFrame, split: str = "split", key: str = "sha256") -> DataFrame:
    """Rows, distinct contents and inner duplicates by split."""
    return docs.groupBy(split).agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_distinct"), (F.count("*") - F.countDistinct(key)).alias("n_inner_duplicates"))


def leakage(docs: DataFrame, split: str = "split", key: str = "sha256") -> DataFrame:
    """Contents shared by each pair of splits, from each content's set of splits."""
    sets = docs.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count("*").alias("n_shared"))


def mixed_pool(pools: DataFrame, shares: dict[str, float], budget: int, slack: float = 1.15) -> DataFrame:
    """Documents of several languages so that each keeps its share of bytes.

    The next document is of the language furthest below its share: in the order
    of bytes so far over the share. ``pools``: lang, ord, n_bytes.
    """
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("lang")]
    rows = running_sum(pools.filter(F.col("lang").isin(list(shares))), "ord", F.col("n_bytes"), "__upto", by=("lang",)).withColumn("__before", F.col("__upto") - F.col("n_bytes"))
    rows = rows.withColumn("level", F.col("__before") / share).filter(F.col("__before") < share * (budget * slack))
    ranked = global_rank(rows, [F.col("level"), F.col("lang"), F.col("ord")], "pool_ord")
    return ranked.withColumn("pool_ord", F.col("pool_ord") - 1).drop("__before", "__upto")
