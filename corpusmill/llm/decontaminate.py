"""Benchmark decontamination: word windows of test items in training texts.

The windows of the benchmark (``WINDOW`` consecutive normalised words; a
shorter item is one window) are numbered word by word and kept as a hash set
that is broadcast. Each task scans the word windows of its texts with a rolling
hash over the same numbers, looks them up, and verifies every find word by word.

The set's size is checked before it is broadcast: a benchmark of over
``block_bytes`` of text is dealt into blocks by hash, and the texts are scanned
once a block, each pass adding to the spans and items found so far. A block is
built of arrays and takes 4 to 25 times its text (some 40 MB for 8 MB of prose).

Defined results: a null or empty text has no words and no hits; a null or empty
item has no windows; items that share a window are all reported; a null item id
is reported as ``null``; repeated rows give equal results. Lower-casing is of
A-Z only and words are runs of ASCII digits, letters and non-ASCII characters. An
input column with the name of the added one (``found``) is replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Text of one block. What is built of it is up to 25 times as large, where all words differ.
BLOCK_BYTES = 8 << 20
#: UTF-8 bytes to lower-case word bytes or a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
SIEVE = 20


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The numbered windows of one block of the benchmark, in arrays.

    ``stream`` has the word numbers of all items end to end; a window is a place
    in it. For each window length there are the windows' hashes in order, their
    places and their items: 24 bytes a word, and the words' numbers.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.names = sorted({item for item, _ in items})
        rank = {item: k for k, item in enumerate(self.names)}
        numbers: dict[bytes, int] = {}
        parts, owners, sizes = [], [], []
        for item, text in items:
            own = words(text)
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in own), np.int32, len(own)))
            owners.append(rank[item])
            sizes.append(len(own))
        self.numbers = numbers
        self.stream = np.concatenate([np.zeros(0, np.int32), *parts])
        size, owner = np.array(sizes, np.int64), np.array(owners, np.int32)
        begin = np.cumsum(size) - size
        self.by_length = []
        for n in sorted({min(x, window) for x in sizes if x}):
            mine = np.flatnonzero(np.minimum(size, window) == n)
            count = size[mine] - n + 1
            at = np.repeat(begin[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            h = self.hashes(self.stream, n)[at]
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << SIEVE, bool)
            sieve[h >> np.uint64(64 - SIEVE)] = True
            self.by_length.append((n, h[order], at[order], np.repeat(owner[mine], count)[order], sieve))

    def nbytes(self) -> int:
        """Bytes of the arrays and about those of the words' numbers."""
        return self.stream.nbytes + sum(x.nbytes for _, *own in self.by_length for x in own) + sum(len(w) + 110 for w in self.numbers)

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n numbers from each place on (places near the end wrap and are masked by the caller)."""
        a = ids.astype(np.uint64)
        h = a.copy()
        for k in range(1, n):
            h *= BASE
            h[: len(a) - k] += a[k:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, its hit spans [start, end) in words, merged, and its items."""
        gap, get = self.window, self.numbers.get
        parts, starts, counts, at = [], [], [], 0
        for t in texts:
            own = words(t)
            counts.append(len(own))
            starts.append(at)
            parts.append(np.fromiter(map(get, own, repeat(0)), np.int32, len(own)))
            parts.append(np.zeros(gap, np.int32))
            at += len(own) + gap
        out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(n, [], []) for n in counts]
        if not self.by_length or not at:
            return out
        ids = np.concatenate(parts)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        spans, items = defaultdict(list), defaultdict(list)
        for n, hashes, places, owners, sieve in self.by_length:
            if len(ids) < n:
                continue
            h = self.hashes(ids, n)[: len(ids) - n + 1]
            place = np.flatnonzero(sieve[h >> np.uint64(64 - SIEVE)] & (known[n:] - known[:-n] == n))
            first, last = np.searchsorted(hashes, h[place], "left"), np.searchsorted(hashes, h[place], "right")
            some = np.flatnonzero(first < last)
            docs = np.searchsorted(starts, place[some], "right") - 1
            step = np.arange(n)
            for p, lo, hi, d in zip(place[some].tolist(), first[some].tolist(), last[some].tolist(), docs.tolist(), strict=True):
                same = (self.stream[places[lo:hi, None] + step] == ids[p : p + n]).all(axis=1)
                if same.any():
                    spans[d].append((p - starts[d], p - starts[d] + n))
                    items[d].append(np.unique(owners[lo:hi][same]))
        for d, own in spans.items():
            out[d] = (counts[d], merged(own), [self.names[i] for i in np.unique(np.concatenate(items[d]))])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "found") -> DataFrame:
    """``docs`` with a struct column: number of words, hit spans in words, items found."""
    spark = docs.sparkSession
    common.prepare(spark)
    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")).filter("text is not null").distinct()
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    kind = "struct<" + FOUND.replace(" bigint", ":bigint", 1).replace("spans ", "spans:").replace("items ", "items:") + ">"
    df = docs.drop(out)
    for k in range(blocks):
        part = source.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else source
        shared = spark.sparkContext.broadcast(Windows([(r["item"], bytes(r["text"])) for r in part.collect()], window))

        def values(shared=shared, more=k > 0):
            def f(b: pa.RecordBatch) -> list[pa.Array]:
                now = shared.value.scan(common.raw_texts(b))
                old = b.column(out).to_pylist() if more else [None] * len(now)
                rows = []
                for (n, spans, items), o in zip(now, old, strict=True):
                    if o:
                        spans = merged(spans + [(s["start"], s["stop"]) for s in o["spans"]])
                        items = sorted({*items, *o["items"]})
                    rows.append({"n_words": n, "spans": [{"start": a, "stop": z} for a, z in spans], "items": items})
                return [pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))]))]

            return f

        df = _pass(df, out, kind, values)
    return df


def _pass(df: DataFrame, out: str, kind: str, values) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out) + f", `{out}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = values()
        for b in batches:
            if b.num_rows:
                own = [n for n in b.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own), *f(b)], names=[*own, out])

    return df.mapInArrow(run, schema)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the stretch from the first to the last word of each span."""
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, last = [], 0
    for a, z in spans:
        out.append(text[last : at[a][0]])
        last = at[z - 1][1]
    return "".join([*out, text[last:]])


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window, or with those stretches cut out of their texts."""
    found = scan(docs, benchmark, window, block_bytes, "__found")
    if what == "documents":
        return found.filter(F.size("__found.spans") == 0).drop("__found")
    if what != "spans":
        raise ValueError("what is 'documents' or 'spans'")
    place = found.columns.index("text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [cut_spans(t, [(s["start"], s["stop"]) for s in f["spans"]]) if f["spans"] else t for t, f in zip(b.column("text").to_pylist(), b.column("__found").to_pylist(), strict=True)]
            columns = [b.column(n) for n in names]
            columns[place] = pa.array(new, b.column("text").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(run, docs.schema)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    rows = scan(docs, common.table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
