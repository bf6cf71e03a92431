"""Roll-ups over stored metric tables: the accounting audit, gaps and recoveries, and the claim table.

Runs are named by roles: ``runs`` has run_id, arm, schedule, seed, and metric rows
join it. Evidence that is missing is null and never a pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats, verdicts

#: The ids of the claims and what each measures.
CLAIMS = {
    "C1": "change of tokens per byte",
    "C2": "change of prefill time on equal raw text",
    "C3": "final gap over training seeds",
    "C4": "gap on held-out documents",
    "C5": "gap under the cosine and the constant schedule",
    "C6": "gap at equal updates",
    "C7": "gain of the warm start",
    "C8": "gain of the late decay",
    "C9": "cost of pruning alone",
}


def accounting(ledger: DataFrame, configs: DataFrame) -> DataFrame:
    """By run: recorded bytes, tokens and updates; tokens that whole updates applied; and the tail that none did.

    ``ledger``: run_id, raw_bytes_seen, tokens_seen, updates. ``configs``: run_id, seq_len, micro, accumulate.
    """
    rows = ledger.join(configs, "run_id")
    applied = F.col("updates") * F.col("seq_len") * F.col("micro") * F.col("accumulate")
    return rows.select("run_id", "raw_bytes_seen", "tokens_seen", "updates", applied.alias("tokens_applied"), (F.col("tokens_seen") - applied).alias("tokens_left"))


def finals(metrics: DataFrame, runs: DataFrame, checkpoint: str = "final") -> DataFrame:
    """(arm, schedule, seed, domain, bpb) of one checkpoint of the named runs; null where it isn't there exactly once."""
    own = metrics.filter(F.col("checkpoint") == checkpoint)
    rows = runs.join(own.select("run_id", "domain", "bpb"), "run_id", "left")
    return rows.groupBy("arm", "schedule", "seed", "domain").agg(F.when(F.count("bpb") == 1, F.max("bpb")).alias("bpb"))


def gaps(before: DataFrame, after: DataFrame, control: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """By key: bits per byte before, after, and of the control; gap, recovery, and distances from the untouched base (b0 - u0, bf - cf)."""
    rows = before.select(*by, F.col("bpb").alias("b0")).join(after.select(*by, F.col("bpb").alias("bf")), by).join(control.select(*by, F.col("bpb").alias("cf")), by).join(base.select(*by, F.col("bpb").alias("u0")), by)
    b0, bf, cf = F.col("b0"), F.col("bf"), F.col("cf")
    return rows.select(*by, "b0", "bf", "cf", (bf - cf).alias("gap"), verdicts.recovery(b0, bf, cf).alias("recovery"), (b0 - F.col("u0")).alias("d0"))


def paired_recovery(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean, deviation and t interval over seeds of the difference of two recoveries (seed, recovery)."""
    both = a.select("seed", F.col("recovery").alias("x")).join(b.select("seed", F.col("recovery").alias("y")), "seed")
    return stats.describe(both.select((F.col("y") - F.col("x")).alias("diff")), [], "diff")


def tokens_per_byte(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Ratio of sums over domains."""
    return metrics.groupBy(*by).agg(F.try_divide(F.sum("n_tokens"), F.sum("n_bytes")).alias("tok_per_byte"))


def claim_rows(compression: DataFrame, system: DataFrame, lm: DataFrame, heldout: DataFrame, updates: DataFrame, items: DataFrame, samples: int = 10_000) -> DataFrame:
    """(id, claim, n, value, low, high, holds) of the nine claims.

    ``compression``: arm (base, new), n_tokens, n_bytes. ``system``: arm (base,
    new), raw_chars, prefill_ms. ``lm``: arm (base, new, pruned), schedule (cosine,
    constant, warm, wsd), seed, bpb. ``heldout``: doc, nll_a, bytes_a (base), nll_b,
    bytes_b (new). ``updates``: seed, d_full, d_upd, gaps at equal text and at equal
    updates. ``items``: correct_a (pruned), correct_b (base).
    """
    spark = lm.sparkSession
    none = F.lit(None).cast("double")

    def row(df: DataFrame, name: str, n, value, low=none, high=none, holds=None) -> DataFrame:
        own = F.lit(None).cast("boolean") if holds is None else holds
        return df.select(F.lit(name).alias("id"), n.cast("bigint").alias("n"), value.cast("double").alias("value"), low.cast("double").alias("low"), high.cast("double").alias("high"), own.alias("holds"))

    of = lambda arm, c, extra=True: F.max(F.when((F.col("arm") == arm) & F.lit(extra), F.col(c)))
    tpb = tokens_per_byte(compression, ["arm"]).agg((of("new", "tok_per_byte") / of("base", "tok_per_byte") - 1).alias("v"))
    out = [row(tpb, "C1", F.lit(1), F.col("v"), holds=F.col("v") < 0)]
    prefill = system.groupBy("raw_chars").agg((F.try_divide(of("new", "prefill_ms"), of("base", "prefill_ms")) - 1).alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out.append(row(prefill, "C2", F.col("n"), F.col("v"), F.col("lo"), F.col("hi"), F.col("hi") < 0))
    side = lambda arm, schedule, name: lm.filter((F.col("arm") == arm) & (F.col("schedule") == schedule)).select("seed", F.col("bpb").alias(name))
    gap = lambda schedule: side("new", schedule, "x").join(side("base", schedule, "y"), "seed").select("seed", (F.col("x") - F.col("y")).alias("d"))
    seeds = stats.describe(gap("constant"), [], "d")
    out.append(row(seeds, "C3", F.col("n"), F.col("mean"), F.col("ci_lo"), F.col("ci_hi"), F.col("mean") > 0))
    held = stats.paired_ratio_bootstrap(heldout, [], samples)
    out.append(row(held, "C4", F.col("n_docs"), F.col("diff"), F.col("ci_lo"), F.col("ci_hi"), verdicts.confirmed(F.col("ci_lo"))))
    two = gap("cosine").withColumnRenamed("d", "cos").join(gap("constant"), "seed").agg(F.count("*").alias("n"), F.avg(F.col("d") - F.col("cos")).alias("v"), F.avg("cos").alias("lo"), F.avg("d").alias("hi"))
    out.append(row(two, "C5", F.col("n"), F.col("v"), F.col("lo"), F.col("hi"), F.col("v") < 0))
    upd = updates.agg(F.count("*").alias("n"), F.avg("d_upd").alias("v"), F.avg(verdicts.rho(F.col("d_full"), F.col("d_upd"))).alias("r"))
    out.append(row(upd, "C6", F.col("n"), F.col("v"), F.col("r"), none, verdicts.rho_class(F.col("r")) == "small"))
    base = side("base", "constant", "y")
    warm = side("new", "constant", "x").join(side("new", "warm", "w"), "seed").join(base, "seed").agg(F.count("*").alias("n"), F.avg((F.col("x") - F.col("y")) - (F.col("w") - F.col("y"))).alias("v"))
    out.append(row(warm, "C7", F.col("n"), F.col("v"), holds=~verdicts.warm_gate(F.col("v"))))
    wsd = side("new", "constant", "x").join(side("new", "wsd", "w"), "seed").join(base, "seed").join(side("base", "wsd", "v"), "seed").agg(F.count("*").alias("n"), F.avg(F.col("w") - F.col("x")).alias("d"), F.avg((F.col("w") - F.col("x")) - (F.col("v") - F.col("y"))).alias("r"))
    out.append(row(wsd, "C8", F.col("n"), F.col("d"), F.col("r"), none, (F.col("d") >= 0) & (F.col("r") >= 0)))
    pruned = side("pruned", "cosine", "x").join(side("base", "cosine", "y"), "seed").agg(F.avg(F.col("x") / F.col("y") - 1).alias("v"))
    counts = items.agg(F.count("*").alias("n"), F.avg(F.col("correct_b").cast("int") - F.col("correct_a").cast("int")).alias("d"))
    from .evaluation import paired_difference

    interval = paired_difference(items.select(F.col("correct_b").alias("correct_a"), F.col("correct_a").alias("correct_b")), [], samples)
    nine = pruned.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(interval.select("ci_lo", "ci_hi")))
    out.append(row(nine, "C9", F.col("n"), F.col("v"), F.col("ci_lo"), F.col("ci_hi"), (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0)))
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    names = spark.createDataFrame(list(CLAIMS.items()), "id string, claim string")
    return names.join(rows, "id", "left").select("id", "claim", "n", "value", "low", "high", "holds")
