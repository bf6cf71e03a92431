"""Quality rules: a learned decision list over text statistics.

The statistics are DataFrame expressions over the whole text, computed row by
row without a shuffle. Sequential covering learns the list on the driver from
the statistics of a bounded labelled sample: a rule for low quality grows by the
threshold condition of greatest information gain on two thirds of the rows left,
is pruned from its end on the other third, and is kept while it is precise
there; the rows it covers leave, and the next rule is learned. The list is
emitted as one ordered ``CASE`` expression, which the plan evaluates.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows get equal verdicts; with no labelled rows of one class the list is
empty and keeps what the base rules keep. Statistics are of the whole text,
however long. Input columns with the name of an added one are replaced. An id
with both labels isn't learned from; of a repeated id the least text is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT = 30  # percent
_SPACE = "[ \\t-\\r]+"
_BLANKS = " \t\n\x0b\x0c\r"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def word_list(text: Column) -> Column:
    """Runs of characters that aren't blanks."""
    return common.let(_trimmed(text), lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, _SPACE)))


def repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more, first occurrences included."""
    n = F.size(words)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda e, k: ((k > 0) & (s[k - 1]["h"] == e["h"])) | ((k < F.size(s) - 1) & (s[k + 1]["h"] == e["h"])))
        starts = common.let(pairs, lambda s: F.sort_array(F.transform(again(s), lambda e: e["i"])))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(starts, zero, lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total")))["total"]

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    some = common.let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n > WINDOW, some).otherwise(F.lit(0)).cast("bigint")


#: Columns that the operator adds; those of its input with such names go.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "__words", "__lines", "__distinct", "__cries", "__capitals")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the counts that the rules use; the text goes."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ADDED])
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("text", text).withColumn("__words", word_list(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_trimmed(x)) > 0)
    both = lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("again"))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    return rows.select(
        *[c for c in docs.columns if c != "text"],
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        without("[#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        common.let(lines, both).alias("__lines"),
        common.let(F.col("__words"), repeated_words).alias("n_repeat_words"),
        F.size(F.array_distinct("__words")).alias("__distinct"),
        without("!+").alias("__cries"),
        without("\\p{Lu}{2,}").alias("__capitals"),
    ).withColumn("n_dup_lines", F.col("__lines.again").cast("bigint"))


def features() -> dict[str, Column]:
    """The learner's columns, over ``statistics``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    # Direct symptoms come first: of conditions with equal gain the first is taken.
    return {
        "symbols": F.col("n_symbols") / n,
        "cries": F.col("__cries") / n,
        "capitals": F.col("__capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "repeat_words": F.col("n_repeat_words").cast("double"),
        "line_copies": F.col("n_dup_lines") / F.greatest(F.col("__lines.n"), F.lit(1)),
        "distinct": F.col("__distinct") / n,
        "word_length": F.col("word_chars") / n,
        "variety": F.col("__distinct") / F.sqrt(n),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def expression(self) -> Column:
        c = features()[self.feature]
        return c >= self.threshold if self.above else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Conditions of greatest information gain, until only positives are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    for _ in range(most):
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f, values in x.items():
            v, own = values[inside], y[inside]
            for t in cuts[f]:
                up = v >= t
                for above in (True, False):
                    side = up if above else ~up
                    p, n = int(own[side].sum()), int((~own[side]).sum())
                    if p:
                        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(f, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n) on other rows."""

    def worth(r: Rule) -> float:
        inside = _holds(r, x, len(y))
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)


def learn(x: dict[str, np.ndarray], y: np.ndarray, rules: int = 12, most: int = 4, precision: float = 0.9, least: int = 5, seed: int = 5) -> list[Rule]:
    """An ordered list of rules for ``y``."""
    rng = np.random.default_rng(seed)
    out: list[Rule] = []
    left = np.arange(len(y))
    while len(out) < rules and y[left].sum() >= least:
        part = rng.random(len(left)) < 2 / 3
        take = lambda rows: ({f: v[rows] for f, v in x.items()}, y[rows])
        (gx, gy), (px, py) = take(left[part]), take(left[~part])
        cuts = {f: np.unique(np.quantile(v[left], np.linspace(0, 1, 66)[1:-1])) for f, v in x.items()}
        rule = prune(grow(gx, gy, cuts, most), px, py)
        inside = _holds(rule, {f: v[left] for f, v in x.items()}, len(left))
        p, n = int(y[left][inside].sum()), int((~y[left][inside]).sum())
        if not rule or p < least or p / (p + n) < precision:
            break
        out.append(rule)
        left = left[~inside]
    return out


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list covers the row: an ordered CASE."""
    out = None
    for rule in rules:
        all_of = rule[0].expression()
        for c in rule[1:]:
            all_of = all_of & c.expression()
        out = F.when(all_of, F.lit(False)) if out is None else out.when(all_of, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", per_class: int = 3000) -> list[Rule]:
    """The list for label 0, from at most ``2 * per_class`` labelled rows that satisfy ``train``."""
    rows = common.labelled_texts(docs, labels, label, train, per_class)
    named = features()
    data = statistics(rows).select("label", *(c.alias(f) for f, c in named.items())).collect()
    data.sort(key=tuple)
    y = np.array([r["label"] == 0 for r in data], bool)
    if not len(y) or y.all() or not y.any():
        return []
    return learn({f: np.array([r[f] for r in data], float) for f in named}, y)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The base counts and the verdict of every row."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, common.table(spark, sf_dir, "labels"), common.fold("doc_id", 5) != 0)
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
