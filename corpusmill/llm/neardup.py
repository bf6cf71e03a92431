"""Near-duplicate documents by SetSketch registers, verified on full sets.

A document is the set of its word shingles, as 64-bit hashes. A SetSketch
register keeps the truncated minimum of exponentially spaced values over the
set: ``floor(1 - log_B(x))`` of the smallest exponential variate (Ertl, 2021).
Registers of a union are the maxima of the registers, and equal registers are as
likely as the sets are similar. The plan:

1. One Arrow pass gives each text its set's digest, size and registers; equal
   sets become one class (sums per task come before the shuffle).
2. Registers are banded in two arrangements. Keys that one class alone has go.
   The classes of a band are ranked by how many classes share their bands: in a
   group of near copies the text that the others were made from comes first.
3. Each class has one candidate: the band leader that it meets in most bands.
   So there is at most one pair a class, however large a group is. The pair is
   estimated jointly by maximum likelihood from the counts of larger, smaller
   and equal registers, then the full sets are compared exactly. Leaders rank
   above their followers, so the links are a forest, and pointer jumping gives
   its roots.
4. Bands that still hold several components are searched completely. In small
   ones all pairs across components are estimated and compared. Large ones are
   dealt into cells of at most CELL_ROWS rows of each side: the component with
   most classes is one side, the others are held against all; a task estimates
   a cell's pairs in arrays, compares the likely ones on their full sets, and
   gives no more links than join the cell's components.
5. Components of what was linked come from minimum labels and pointer jumping on
   the contracted graph, cut by written tables.

Texts are not shuffled to be compared: a table of at most SLOTS hashes of the
wanted ids is broadcast and filters the scan; only what passes is joined by id,
and only then becomes a set.

Two documents of similarity 0.8 share no band with a chance of about 1e-5; links
inside a band are lost only where the estimate is MARGIN standard errors off.

Defined results: no words or a null text is the empty set, linked with nothing;
fewer words than a shingle are one shingle; repeated rows are one class; rows
with a null id are kept and their component is null; an id stands for one
document, so rows that share an id are in one component whatever their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import components
from . import common
from .tokens import _Kept

BASE = 1.01
ROWS = 6
BANDS = 26  # of each arrangement
REGISTERS = ROWS * BANDS
ARRANGEMENTS = 2
#: Registers are shifted so that the largest exponential variate has register 0.
SHIFT = 400
MARGIN = 5.0
#: Hashes of wanted ids that are broadcast at most.
SLOTS = 1 << 18
#: Bands of up to so many classes give pairs; larger ones are dealt into cells.
SMALL = 64
#: Rows, and bytes of full sets, that a cell holds of each of its two sides.
CELL_ROWS = 2048
CELL_BYTES = 32 << 20
_RNG = np.random.default_rng(20210101)
_A = _RNG.integers(1, 1 << 32, REGISTERS, np.uint32) | np.uint32(1)
_S = _RNG.integers(0, 1 << 32, REGISTERS, np.uint32) | np.uint32(1)
_ORDER = np.concatenate([np.arange(REGISTERS), _RNG.permutation(REGISTERS)])
_MIX = _RNG.integers(1, 1 << 63, ROWS, np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 1 << 63, BANDS * ARRANGEMENTS, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int):
        self.size = size
        self.kept = _Kept(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.kept.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a nonempty set of hashes."""
    low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 512):
        y = low[at : at + 512, None] * _A
        y ^= high[at : at + 512, None] * _S
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        y *= np.uint32(0x297A2D39)
        np.minimum(least, y.min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + SHIFT, 0, 65535).astype(np.uint16)


def bands(r: np.ndarray) -> np.ndarray:
    """Keys of all bands: (n, registers) to (n, bands)."""
    own = r[:, _ORDER].reshape(len(r), BANDS * ARRANGEMENTS, ROWS).astype(np.uint64)
    return mix((own * _MIX).sum(axis=2, dtype=np.uint64) ^ _BAND).view(np.int64)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, given the registers and sizes of both sets."""
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    same = ra.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(na, nb)[:, None] / np.maximum(na, nb)[:, None]
    j = np.linspace(0, 1, 101)[None, :] * top
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    pa_, pb = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda n, q: np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0)
        value = term(more, pa_) + term(less, pb) + term(same, 1 - pa_ - pb)
    return np.take_along_axis(j, value.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, digest, registers) of every row."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for b in batches:
            n, digest, regs = [], [], []
            for t in common.raw_texts(b):
                s = shingles(t)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "digest", "regs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, digest binary, regs binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, id, n): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = bands(matrix(b.column("regs")))
                ids, n = (np.repeat(b.column(c).to_numpy(), k.shape[1]) for c in ("id", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(ids), pa.array(n)], names=["key", "id", "n"])

    return classes.select("id", "n", "regs").mapInArrow(run, "key bigint, id bigint, n bigint")


def shared_bands(classes: DataFrame) -> DataFrame:
    """(key, id, n, weight) of the bands that several ids share; weight: how many ids meet the id, over its bands."""
    rows = common.cut(band_rows(classes))
    many = common.cut(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    met = common.cut(rows.join(many, "key"))
    weight = common.cut(met.groupBy("id").agg(F.sum("c").alias("weight")))
    out = common.cut(met.join(weight, "id").select("key", "id", "n", "weight"))
    common.release(rows, many, met, weight)
    return out


def first_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): for each id b at most one candidate a, of the leaders of its bands the one it meets in most of them.

    A band's leader is its id of greatest weight, the smaller id of equals.
    """
    rank = F.struct("weight", (-F.col("id")).alias("last"))
    leads = common.cut(shared.groupBy("key").agg(F.max(rank).alias("top")).select("key", (-F.col("top.last")).alias("a"), F.col("top.weight").alias("weight_a")))
    pairs = shared.select("key", F.col("id").alias("b")).join(leads, "key").filter("a != b")
    times = pairs.groupBy("b", "a", "weight_a").agg(F.count("*").alias("times"))
    best = times.groupBy("b").agg(F.max(F.struct("times", "weight_a", (-F.col("a")).alias("last"))).alias("top"))
    out = common.cut(best.select((-F.col("top.last")).alias("a"), "b"))
    common.release(leads)
    return out


def least_estimate(threshold: float) -> float:
    return threshold - MARGIN * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


def reaches(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether ``estimate`` is ``least`` or more: the likelihood, which has one maximum, still rises there."""
    more, less, na, nb = (np.asarray(x, float) for x in (more, less, na, nb))
    same = REGISTERS - more - less
    u = na / (na + nb)
    v = 1 - u
    c = (BASE - 1) / BASE
    x, y = u - v * least, v - u * least
    fits = (x >= 0) & (y >= 0)
    x, y = np.maximum(x, 1e-12), np.maximum(y, 1e-12)
    p, q = -np.log1p(-c * x) / np.log(BASE), -np.log1p(-c * y) / np.log(BASE)
    dp, dq = c / ((1 - c * x) * np.log(BASE)), c / ((1 - c * y) * np.log(BASE))
    return fits & (same * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12) >= more * v * dp / p + less * u * dq / q)


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, ...) whose estimate isn't MARGIN standard errors under the threshold."""
    own, names = classes.select("id", "n", "regs"), pairs.columns
    rows = pairs.join(own.toDF("a", "na", "ra"), "a").join(own.toDF("b", "nb", "rb"), "b")
    least = least_estimate(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ra, rb = matrix(b.column("ra")), matrix(b.column("rb"))
                ok = reaches((ra > rb).sum(1), (ra < rb).sum(1), b.column("na").to_numpy(), b.column("nb").to_numpy(), least)
                yield b.select(names).filter(pa.array(ok))

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(threshold * 100)
    return rows.filter(fits).select(*names, "na", "nb", "ra", "rb").mapInArrow(run, pairs.schema).distinct()


def slot(c: str) -> F.Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS))


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, set) of the texts of the wanted ids; others are passed over in the scan."""
    hashes = ids.select(slot("id").alias("__slot")).distinct()
    near = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").filter("id is not null").join(F.broadcast(hashes), slot("id") == F.col("__slot"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t).tobytes() for t in common.raw_texts(b)], pa.binary())], names=["id", "set"])

    return near.join(ids, "id", "left_semi").mapInArrow(run, "id bigint, set binary")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union holds for two full sets."""
    both = np.frombuffer(x + y, np.uint64).copy()
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return inter > 0 and 100 * inter >= percent * (len(both) - inter)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) with 100 * intersection >= percent * union, on full sets."""
    names = pairs.columns
    rows = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x, y, percent) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)]
            yield b.select(names).filter(pa.array(ok, pa.bool_()))

    return rows.select(*names, "sa", "sb").mapInArrow(run, pairs.schema)


def rooted(edges: DataFrame) -> DataFrame:
    """(id, comp): the root of each id of a forest of edges from b to its parent a."""
    labels = common.cut(edges.select(F.col("b").alias("id"), F.col("a").alias("comp")).distinct())
    while True:
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("upper"))
        new = common.cut(labels.select("id", "comp").join(up, "comp", "left").select("id", F.coalesce("upper", "comp").alias("comp"), F.col("upper").isNotNull().alias("moved")))
        moved = not new.filter("moved").isEmpty()
        common.release(labels)
        labels = new
        if not moved:
            break
    out = common.cut(labels.select("id", "comp").unionByName(labels.select(F.col("comp").alias("id"), "comp").distinct()))
    common.release(labels)
    return out


def open_bands(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, n, comp, most, c, others, bytes) of the bands that hold several components.

    most: the component with most of the band's c ids; others: ids outside it.
    """
    rows = common.cut(shared.select("key", "id", "n").join(labels, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp")))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    top = F.max(F.struct("c", "comp"))
    state = sizes.groupBy("key").agg(top["comp"].alias("most"), F.sum("c").alias("c"), (F.sum("c") - F.max("c")).alias("others"), (8 * F.sum("n")).alias("bytes"))
    state = common.cut(state.filter("others > 0"))
    out = common.cut(rows.join(state, "key"))
    common.release(rows, state)
    return out


def pairs_inside(rows: DataFrame) -> DataFrame:
    """(a, b, ca, cb): ids of different components in one band of at most SMALL ids."""

    def pairs(key: np.ndarray, ids: np.ndarray, comp: np.ndarray) -> pa.RecordBatch:
        two = []
        for d in range(1, min(SMALL, len(key))):
            i = np.flatnonzero((key[d:] == key[:-d]) & (comp[d:] != comp[:-d]))
            if not (key[d:] == key[:-d]).any():
                break
            two.append(np.stack([ids[i], ids[i + d], comp[i], comp[i + d]], 1))
        two = np.unique(np.concatenate(two), axis=0) if two else np.zeros((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(two[:, k]) for k in range(4)], names=["a", "b", "ca", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column(c).to_numpy() for c in ("key", "id", "comp")]))
                n += b.num_rows
                if n >= 20_000:
                    now = np.concatenate(held, axis=1)
                    last = int(np.searchsorted(now[0], now[0, -1]))  # the last band may go on
                    yield pairs(*now[:, :last])
                    held, n = [now[:, last:]], now.shape[1] - last
        if held:
            yield pairs(*np.concatenate(held, axis=1))

    # By key, and by id inside it, so that a < b.
    source = rows.select("key", "id", "comp").repartition("key").sortWithinPartitions("key", "id")
    return source.mapInArrow(run, "a bigint, b bigint, ca bigint, cb bigint").distinct()


class Cell:
    """Rows of one band, some of them queries, some of them held against the queries, some both."""

    def __init__(self, key: int, ids, comp, n, regs, sets, asks, held, threshold: float):
        self.key, self.ids, self.comp, self.n, self.regs, self.sets = key, ids, comp, n, regs, sets
        self.q, self.b = np.flatnonzero(asks), np.flatnonzero(held)
        self.percent, self.least = round(100 * threshold), least_estimate(threshold)
        #: Of a pair at the threshold more registers are equal, but for a chance of 1e-8.
        self.equal = int(threshold * REGISTERS - 6 * np.sqrt(threshold * (1 - threshold) * REGISTERS))
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root.setdefault(up, up)
        return x

    def likely(self, q: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each query of a block, the rows that may be linked with it and don't meet it in an earlier band."""
        b, n = self.b, self.n
        same = (self.regs[q][:, None, :] == self.regs[b][None]).sum(2, dtype=np.uint8)
        fits = np.minimum(n[q][:, None], n[b][None]) * 100 >= np.maximum(n[q][:, None], n[b][None]) * self.percent
        r, c = np.nonzero((same >= self.equal) & (self.comp[q][:, None] != self.comp[b][None]) & fits)
        keep = np.zeros(len(r), bool)
        for at in range(0, len(r), 8192):
            i, j = q[r[at : at + 8192]], b[c[at : at + 8192]]
            x, y = self.regs[i], self.regs[j]
            ok = np.flatnonzero(reaches((x > y).sum(1), (x < y).sum(1), n[i], n[j], self.least))
            kx, ky = bands(x[ok]), bands(y[ok])
            first = (kx == ky).argmax(1)
            keep[at + ok] = kx[np.arange(len(ok)), first] == self.key
        r, c = r[keep], c[keep]
        ends = np.searchsorted(r, np.arange(len(q) + 1))
        for k in range(len(q)):
            if ends[k] < ends[k + 1]:
                yield int(q[k]), b[c[ends[k] : ends[k + 1]]]

    def links(self) -> list[tuple[int, int]]:
        """Components that a verified pair joins; only as many as join those of the cell."""
        out, flat = [], None
        for at in range(0, len(self.q), 64):
            for i, some in self.likely(self.q[at : at + 64]):
                if len(some) > 16:
                    if flat is None:
                        size = np.array([len(self.sets[j]) // 8 for j in range(len(self.ids))])
                        values, flat = np.unique(np.frombuffer(b"".join(self.sets), np.uint64), return_inverse=True)
                        start, seen = np.cumsum(size) - size, np.zeros(len(values), np.int64)
                    own = flat[start[i] : start[i] + size[i]]
                    seen[own] = 1
                    inter = np.add.reduceat(seen[flat], start)
                    seen[own] = 0
                    some = some[100 * inter[some] >= self.percent * (size[i] + size[some] - inter[some])]
                for j in some.tolist():
                    x, y = self.find(int(self.comp[i])), self.find(int(self.comp[j]))
                    if x != y and similar(self.sets[i], self.sets[j], self.percent):
                        self.root[max(x, y)] = min(x, y)
                        out.append((int(self.comp[i]), int(self.comp[j])))
        return out


def cells(rows: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(ca, cb): components joined by a verified pair in a band of more than SMALL ids."""
    parts = lambda n, share: F.greatest(F.ceil(n / CELL_ROWS), F.ceil(F.col("bytes") * share / CELL_BYTES), F.lit(1)).cast("int")
    rows = rows.withColumn("bs", parts(F.col("c"), 1.0)).withColumn("qs", parts(F.col("others"), F.col("others") / F.col("c")))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), "bs").cast("int")).withColumn("q", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), "qs").cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = F.transform(upto("qs"), lambda k: F.struct(k.alias("cq"), F.col("b").alias("cb")))
    asks = F.transform(upto("bs"), lambda k: F.struct(F.col("q").alias("cq"), k.alias("cb")))
    at = F.when(F.col("comp") == F.col("most"), held).otherwise(F.array_union(asks, held))
    rows = rows.withColumn("cell", F.explode(at)).select("key", "cell.cq", "cell.cb", "id", "comp", ((F.col("comp") != F.col("most")) & (F.col("q") == F.col("cell.cq"))).alias("asks"), (F.col("b") == F.col("cell.cb")).alias("held"))
    full = common.cut(classes.select("id", "n", "regs").join(rows.select("id").distinct(), "id", "left_semi").join(sets, "id"))
    names = ["key", "cq", "cb", "id", "comp", "asks", "held", "n", "regs", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[dict]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r["id"], r["n"], r["set"]))
            ids, comp, n = (np.array([r[c] for r in rows], np.int64) for c in ("id", "comp", "n"))
            regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(-1, REGISTERS)
            found = Cell(rows[0]["key"], ids, comp, n, regs, [r["set"] for r in rows], *(np.array([r[c] for r in rows], bool) for c in ("asks", "held")), threshold).links()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["ca", "cb"])

        own: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if own and (r["key"], r["cq"], r["cb"]) != (own[0]["key"], own[0]["cq"], own[0]["cb"]):
                    yield links(own)
                    own = []
                own.append(r)
        if own:
            yield links(own)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = rows.join(full, "id").select(*names).repartition(tasks, "key", "cq", "cb").sortWithinPartitions("key", "cq", "cb")
    return source.mapInArrow(run, "ca bigint, cb bigint").distinct()


def of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): an id of several rows and the class of each of them."""
    again = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    named = rows.join(common.cut(again), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "id"), "digest")
    return named.filter("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()


def linked(docs: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(id, component) of the ids that are linked with others."""
    percent, spare = round(100 * threshold), []

    def cut(df: DataFrame) -> DataFrame:
        spare.append(common.cut(df))
        return spare[-1]

    shared = shared_bands(classes)
    near = cut(likely(first_pairs(shared), classes, threshold))
    edges = verified(near, cut(full_sets(docs, cut(ends(near).distinct()), shingle)), percent)
    labels = rooted(edges)
    rest = open_bands(shared, labels)
    large = rest.filter(F.col("c") > SMALL)
    near = cut(likely(pairs_inside(rest.filter(F.col("c") <= SMALL)), classes, threshold))
    sets = cut(full_sets(docs, cut(ends(near).unionByName(large.select("id")).distinct()), shingle))
    more = verified(near, sets, percent).select("ca", "cb")
    if not large.isEmpty():
        more = more.unionByName(cells(large, classes, sets, threshold))
    more = more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    same = cut(of_one_id(rows, classes))
    if not same.isEmpty():
        for end in ("a", "b"):
            same = same.join(labels.toDF(end, "comp"), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
        more = more.unionByName(same.filter("a != b"))
    joined = components(cut(more.distinct())).withColumnRenamed("component", "comp")
    nodes = labels.unionByName(joined.select("id", F.col("id").alias("comp"))).distinct()
    nodes = cut(nodes.join(joined.toDF("comp", "upper"), "comp", "left").select("id", F.coalesce("upper", "comp").alias("comp")))
    least = cut(nodes.groupBy("comp").agg(F.min("id").alias("component")))
    out = common.cut(nodes.join(least, "comp").select("id", "component"))
    common.release(*spare, shared, labels, rest)
    return out


def link(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    common.prepare(docs.sparkSession)
    rows = common.cut(sketches(docs, shingle))
    classes = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = common.cut(classes)
    found = linked(docs, rows, classes, shingle, threshold)
    named = rows.select("doc_id", "n", "digest").join(common.cut(classes.select("digest", F.col("id").alias("class_id"))), "digest", "left")
    named = named.withColumn("id", F.coalesce("class_id", "doc_id")).join(found, "id", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each component: of the smallest id; of an id's rows the least by text.

    Rows with a null id stay. Texts are moved only where a row's id may be one
    that goes or that several rows have.
    """
    decided = common.cut(link(docs, shingle, threshold).filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("c"), F.max("kept").alias("kept")))
    special = common.cut(decided.filter("c > 1 or not kept"))
    hashes = special.select(slot("__id").alias("__slot")).distinct()
    id_ = F.col("doc_id").cast("bigint")
    rows = docs.withColumn("__id", id_)
    on = F.pmod(F.xxhash64("__id"), F.lit(SLOTS)) == F.col("__slot")
    plain = rows.join(F.broadcast(hashes), on, "left_anti").select(*docs.columns)
    asked = rows.filter("__id is not null").join(F.broadcast(hashes), on, "left_semi")
    asked = asked.join(special.filter("not kept").select("__id"), "__id", "left_anti")
    asked = asked.join(special.filter("kept").select("__id", F.lit(True).alias("__again")), "__id", "left")
    alone = asked.filter("__again is null").select(*docs.columns)
    first = F.min(F.struct(F.coalesce(F.col("text"), F.lit("")).alias("__text"), F.struct(*docs.columns).alias("__row")))
    several = asked.filter("__again").groupBy("__id").agg(first["__row"].alias("__row")).select("__row.*")
    return plain.unionByName(alone).unionByName(several.select(*docs.columns))


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, threshold=0.8)
