"""Document quality: profiles, the first reason to reject, and statistics of reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Profile:
    """Thresholds. The defaults are those of the Korean profile."""

    min_chars: int = 200
    max_chars: int = 200_000
    min_hangul: float = 0.15
    min_latin: float = 0.0
    min_language_score: float = 0.60
    max_line_repeat: float = 0.30
    min_distinct_ngram: float = 0.25
    max_digit: float = 0.30
    min_mean_line: float = 10.0
    ngram: int = 5
    check_lines: bool = True
    check_ngrams: bool = True


# The profiles by language.
PROFILES = {
    "ko": Profile(),
    "en": Profile(min_hangul=0.0, min_latin=0.50, min_language_score=0.0),
    "code": Profile(min_chars=120, min_hangul=0.0, min_language_score=0.0, max_digit=0.60, min_mean_line=3.0, check_lines=False, check_ngrams=False),
}
#: Most Hangul that a profile with a Latin floor allows.
MAX_KOREAN_IN_ENGLISH = 0.05


def profile(language: str) -> Profile:
    if language not in PROFILES:
        raise ValueError(f"no quality profile for {language!r}: {', '.join(PROFILES)}")
    return PROFILES[language]


def first_reason(tests: list[tuple[str, Column]], rest: Column | None = None) -> Column:
    """The name of the first condition that holds, else ``rest`` (null by default)."""
    case = F.when(tests[0][1], F.lit(tests[0][0]))
    for name, condition in tests[1:]:
        case = case.when(condition, F.lit(name))
    return case if rest is None else case.otherwise(rest)


def reason(own: Profile, text: Column, score: Column | None = None) -> Column:
    """The first reason to reject, cheap ones first; null if there is none.

    Lines and the squeezed text are bound where they are first needed, so that
    they are computed once, and not at all for texts that fail before.
    """
    cheap = [("too_short", F.length(text) < own.min_chars), ("too_long", F.length(text) > own.max_chars)]
    if score is not None:
        cheap.append(("low_language_score", score < own.min_language_score))
    cheap.append(("low_hangul", T.ratio(text, T.HANGUL) < own.min_hangul))
    if own.min_latin > 0:
        cheap += [("low_latin", T.ratio(text, T.LATIN) < own.min_latin), ("korean_in_english", T.ratio(text, T.HANGUL) > MAX_KOREAN_IN_ENGLISH)]
    cheap.append(("digit_heavy", T.ratio(text, T.DIGIT) > own.max_digit))
    ngrams = T.bound(T.squeezed(text), lambda s: F.when(T.distinct_ngram_ratio(s, own.ngram) < own.min_distinct_ngram, F.lit("repeated_ngram"))) if own.check_ngrams else None

    def by_lines(lines: Column) -> Column:
        tests = [("short_lines", T.mean_line_chars(lines) < own.min_mean_line)]
        if own.check_lines:
            tests.append(("repeated_lines", T.line_repeat_ratio(lines) > own.max_line_repeat))
        return first_reason(tests, ngrams)

    return first_reason(cheap, T.bound(T.lines(text), by_lines))


def check(docs: DataFrame, language: str, text: str = "text", score: str | None = None) -> DataFrame:
    """``docs`` with ``reject_reason``: null for documents that pass."""
    return docs.withColumn("reject_reason", reason(profile(language), F.col(text), F.col(score) if score else None))


def passing(checked: DataFrame) -> DataFrame:
    """Rows of ``check`` without a reason.

    The test stays where it stands: a deterministic filter would be moved below
    joins and exchanges, where there are more rows or fewer tasks.
    """
    return checked.filter(F.when(F.monotonically_increasing_id() >= 0, F.col("reject_reason").isNull()))


def reason_stats(checked: DataFrame) -> DataFrame:
    """Each reason's count and percentage of all documents; ``kept`` for those that pass."""
    total = F.sum("n").over(Window.partitionBy())
    return checked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")).withColumn("percent", 100.0 * F.col("n") / total)
