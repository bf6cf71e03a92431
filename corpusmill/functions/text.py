"""Text functions as column expressions; Arrow UDFs only where Spark has no builtin."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PHASES

# Character classes, as code points. Java regex syntax.
INVISIBLE = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
SPACES = r"[\xA0\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
HANGUL = r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"
LATIN = "[A-Za-z]"
HANJA = r"[\x{4E00}-\x{9FFF}]"
KANA = r"[\x{3040}-\x{30FF}]"
DIGIT = "[0-9]"
#: Han as the benchmark scorer and as the vocabulary census see it: they differ in the last range.
HAN_BENCH = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"
HAN_CENSUS = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]"
#: White space that can remain in normalised text.
BLANK = r"[ \t\n\x{2028}\x{2029}]"
CLASSES = {"hangul": HANGUL, "latin": LATIN, "hanja": HANJA, "kana": KANA, "digit": DIGIT}


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _normal(form: str):
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x))

    return f


def nfc(text: Column) -> Column:
    return _normal("NFC")(text)


def nfkc(text: Column) -> Column:
    return _normal("NFKC")(text)


def clean_spaces(text: Column) -> Column:
    """The steps of normalisation after NFC, in their order."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, INVISIBLE, "")
    t = F.regexp_replace(t, SPACES, " ")
    t = F.regexp_replace(t, r"(?md)[ \t]+$", "")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, rf"\A{BLANK}+|{BLANK}+\z", "")


def normalize_text(text: Column) -> Column:
    """NUL dropped, NFC, line ends, invisible characters, spaces, blank lines; null is empty."""
    return clean_spaces(nfc(F.translate(F.coalesce(text, F.lit("")), "\x00", "")))


def ratio(text: Column, pattern: str) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)), F.length(text)), F.lit(0.0))


def char_stats(text: Column) -> Column:
    """Struct of n_chars and the share of each character class; zeros if empty."""
    return F.struct(F.length(text).alias("n_chars"), *(ratio(text, p).alias(f"{n}_ratio") for n, p in CLASSES.items()))


def latin_share(text: Column) -> Column:
    """latin / (hangul + latin); 0 without either."""
    latin, hangul = (F.regexp_count(text, F.lit(p)) for p in (LATIN, HANGUL))
    return F.coalesce(F.try_divide(latin, hangul + latin), F.lit(0.0))


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"{BLANK}+"), lambda x: x != ""))


def lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")


def line_repeat_ratio(own: Column) -> Column:
    """Share of lines that occur more than once; 0 under four lines. ``own``: a column of ``lines``."""
    ordered = F.sort_array(own)
    again = F.transform(F.array(ordered), lambda s: F.size(F.filter(s, lambda x, i: ((i > 0) & (s[i - 1] == x)) | ((i < F.size(s) - 1) & (s[i + 1] == x)))))[0]
    return F.when(F.size(own) < 4, F.lit(0.0)).otherwise(again / F.size(own))


def mean_line_chars(own: Column) -> Column:
    total = F.aggregate(own, F.lit(0), lambda a, x: a + F.length(x))
    return F.coalesce(F.try_divide(total, F.size(own)), F.lit(0.0))


def squeezed(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, rf"{BLANK}+", "")


def grams(squeezed_text: Column, n: int) -> Column:
    """All character n-grams, overlapping."""
    return F.regexp_extract_all(squeezed_text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def distinct_ngram_ratio(squeezed_text: Column, n: int = 5) -> Column:
    """Distinct share of character n-grams; 1 for texts under 8n characters."""
    size = F.length(squeezed_text)
    return F.when(size < 8 * n, F.lit(1.0)).otherwise(F.size(F.array_distinct(grams(squeezed_text, n))) / (size - n + 1))


def contamination_form(text: Column) -> Column:
    """NFKC, lower case, no white space."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"(?U)\s+", "")


def host_of(url: Column) -> Column:
    """Lower-case host, leading dots dropped; empty for a malformed URL."""
    whole = F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("http://"), url))
    return F.ltrim(F.lower(F.coalesce(F.try_parse_url(whole, F.lit("HOST")), F.lit(""))), F.lit("."))


def preview(text: Column, n: int = 180) -> Column:
    return F.translate(F.substring(text, 1, n), "\t\n\r", "   ")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def note_value(note: Column, key: str) -> Column:
    """The number after ``key=`` in a free-text note; null if it isn't there."""
    found = F.regexp_extract(note, rf"(?:^|\s){key}=([+-]?[0-9.]+)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def parse_argv(argv: Column) -> Column:
    """``--key value`` and ``--flag`` as a map; a flag's value is the empty text."""
    pairs = F.regexp_extract_all(argv, F.lit(r"--([A-Za-z0-9_-]+)(?:[= ](?!--)(\S+))?"), F.lit(0))
    key = lambda x: F.regexp_extract(x, r"--([A-Za-z0-9_-]+)", 1)
    value = lambda x: F.regexp_extract(x, r"--[A-Za-z0-9_-]+[= ](\S+)", 1)
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(key(x), value(x))))


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def run_id(phase: Column, *parts: Column, seed: Column | None = None) -> Column:
    """Name of a run: the phase, the cleaned parts that aren't empty, and the seed; null if no valid name comes of it.

    Of a part that is a path the last component counts.
    """
    clean = lambda p: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), -1)), "[^a-z0-9_.-]+", "-"), "-{2,}", "-"), F.lit("-"))
    own = [F.nullif(clean(p.cast("string")), F.lit("")) for p in parts]
    name = F.concat_ws("_", phase, *own, *([F.concat(F.lit("seed"), seed.cast("string"))] if seed is not None else []))
    return F.when(phase.isin(PHASES) & name.rlike("^[a-z0-9][a-z0-9_.-]*$"), name)


def has_class(text: Column, pattern: str) -> Column:
    """Whether a character of the class is there."""
    return text.rlike(pattern)


def pure_class(text: Column, pattern: str) -> Column:
    """Whether the text is not empty and all its characters are of the class."""
    return text.rlike(rf"\A{pattern}+\z")


def token_bytes(token: Column) -> Column:
    """Bytes that a byte-level token stands for: its length within the alphabet, else its UTF-8 size."""
    inside = "".join(byte_alphabet().values()).replace("\\", "\\\\").replace("]", "\\]").replace("[", "\\[").replace("^", "\\^").replace("-", "\\-").replace("&", "\\&")
    return F.when(token.rlike(f"^[{inside}]+$"), F.length(token)).otherwise(F.octet_length(token))


def byte_surface(strict: bool):
    """Arrow UDF: a byte-level token's text; bad UTF-8 is null if ``strict``, else replaced."""
    table = {c: b for b, c in byte_alphabet().items()}

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        def one(token):
            if token is None or any(c not in table for c in token):
                return None if strict else token
            data = bytes(table[c] for c in token)
            try:
                return data.decode("utf-8", "strict" if strict else "replace")
            except UnicodeDecodeError:
                return None

        return s.map(one)

    return f
