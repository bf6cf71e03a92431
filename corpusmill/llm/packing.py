"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; pieces of exactly that
length are sequences of their own. The others are dealt by a hash of a row
number into blocks of about ``block`` pieces, so that no key and no group of
copies decides where rows go. A block is evolved on several islands (rows of a
DataFrame, so tasks of any executor). A chromosome is a list of bins; those of the
first population come from best fit in random order. Crossover injects whole
well-filled bins of one parent into the other, drops the bins that then hold
duplicates, dissolves some of the emptiest, and best-fits the displaced pieces,
longest first. After each epoch an island's elite migrates to the next island of
its block. A block that has reached its lower bound isn't evolved further. The bins that are still
under nine tenths full in each block are packed once more together.

Defined results: a null or empty text is the single end id; repeated rows are
packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
BLOCK = 8192
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 14
POPULATION = 4
#: Tasks that islands are dealt to at most.
TASKS = 20_000
END_ID = 0
#: Bytes of batches whose texts are encoded together.
TOGETHER = 1 << 23
Chromosome = tuple[list[list[int]], list[int]]
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, joined as long as they have at most ``size`` bytes together."""
    held, held_bytes = [], 0
    for b in batches:
        if held and held_bytes + b.nbytes > size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
        held.append(b)
        held_bytes += b.nbytes
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document's ids (with the end id), and where it lies."""
    common.prepare(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.worker_wide(("ids", vocabulary), lambda: tokens.WordIds(vocabulary))
        for b in gathered(batches, TOGETHER):
            doc, piece, start, length, crc = [], [], [], [], []
            for i, ids in zip(b.column("doc_id").to_pylist(), tokenizer.batch(b.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Packer:
    """Bins for the sizes of one block. A chromosome is (bins, their loads); bins are never changed in place."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)
        self.bound = -(-sum(sizes) // capacity)

    def fill(self, bins: list[list[int]], loads: list[int], loose: list[int]) -> Chromosome:
        """Best fit of the loose items, in their order, into the bins and new ones."""
        sizes, cap = self.sizes, self.capacity
        by_room: list[list[int]] = [[] for _ in range(cap + 1)]
        rooms = 0  # bit r: some bin has exactly r tokens of room
        for k, load in enumerate(loads):
            if load < cap:
                by_room[cap - load].append(k)
                rooms |= 1 << (cap - load)
        for i in loose:
            s = sizes[i]
            fits = rooms >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                stack = by_room[room]
                k = stack.pop()
                if not stack:
                    rooms ^= 1 << room
                bins[k] = [*bins[k], i]
                loads[k] += s
            else:
                k, room = len(bins), cap
                bins.append([i])
                loads.append(s)
            if room > s:
                by_room[room - s].append(k)
                rooms |= 1 << (room - s)
        return bins, loads

    def value(self, chromosome: Chromosome) -> tuple[int, int]:
        """Fewer bins first, then the more uneven fill."""
        return -len(chromosome[0]), sum(x * x for x in chromosome[1])

    def first(self) -> Chromosome:
        """A chromosome of the first population: best fit in random order."""
        order = list(range(len(self.sizes)))
        self.rng.shuffle(order)
        return self.fill([], [], order)

    def cross(self, a: Chromosome, b: Chromosome) -> Chromosome:
        """Well-filled bins of b go into a; bins of a with duplicates go; the displaced are best-fitted."""
        sizes, rng = self.sizes, self.rng
        full = [k for k, load in enumerate(b[1]) if load == self.capacity]
        if len(full) < len(b[0]) // 10:
            full = sorted(range(len(b[0])), key=lambda k: -b[1][k])[: max(1, len(b[0]) // 4)]
        taken = rng.sample(full, max(1, int(len(full) * rng.uniform(0.3, 0.9))))
        inside = {i for k in taken for i in b[0][k]}
        keep = sorted((k for k, own in enumerate(a[0]) if inside.isdisjoint(own)), key=lambda k: a[1][k])
        # Mutation: the emptiest bins that stay are dissolved too.
        keep = keep[max(1, int(len(keep) * rng.uniform(0, 0.8))) :]
        stays = set(keep)
        loose = [i for k, own in enumerate(a[0]) if k not in stays for i in own if i not in inside]
        loose.sort(key=lambda i: (-sizes[i], i))
        return self.fill([b[0][k] for k in taken] + [a[0][k] for k in keep], [b[1][k] for k in taken] + [a[1][k] for k in keep], loose)

    def evolve(self, population: list[Chromosome], generations: int, size: int) -> tuple[list[Chromosome], list[int]]:
        """The population after so many children, best first, and the fewest bins after each of them.

        There are no children where the lower bound is met already.
        """
        population = population or [self.first() for _ in range(size)]
        population.sort(key=self.value, reverse=True)
        history = [len(population[0][0])]
        for _ in range(generations):
            if history[-1] <= self.bound or len(population) < 2:
                break
            a, b = self.rng.sample(population, 2)
            child = self.cross(a, b)
            if self.value(child) > self.value(population[-1]):
                population[-1] = child
                population.sort(key=self.value, reverse=True)
            history.append(len(population[0][0]))
        return population[:size], history


def encode(bins: list[list[int]], n: int) -> bytes:
    """The bin of each item."""
    out = np.zeros(n, np.int32)
    for k, own in enumerate(bins):
        out[own] = k
    return out.tobytes()


def decode(data: bytes, sizes: list[int]) -> Chromosome:
    place = np.frombuffer(data, np.int32)
    order = np.argsort(place, kind="stable")
    ends = np.flatnonzero(np.diff(place[order])) + 1
    loads = np.bincount(place, np.array(sizes, np.int64)).astype(np.int64).tolist() if len(place) else []
    return [x.tolist() for x in np.split(order, ends)] if len(place) else [], loads


STATE = "block bigint, island int, sizes array<int>, population array<binary>, history array<int>, bins int, done boolean"
_STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("population", pa.list_(pa.binary())), ("history", pa.list_(pa.int32())), ("bins", pa.int32()), ("done", pa.bool_())])


def _epoch(state: DataFrame, capacity: int, generations: int, size: int, epoch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                p = Packer(r["sizes"], capacity, seed=r["block"] * 1000 + r["island"] * 10 + epoch)
                now, history = p.evolve([decode(x, r["sizes"]) for x in r["population"]], generations, size)
                best = len(now[0][0])
                row = {"block": r["block"], "island": r["island"], "sizes": r["sizes"], "population": [encode(x[0], len(r["sizes"])) for x in now], "history": [*r["history"], *history], "bins": best, "done": best <= p.bound}
                yield pa.RecordBatch.from_pylist([row], schema=_STATE)

    return state.mapInArrow(run, STATE)


def evolve(blocks: DataFrame, count: int, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """(block, sizes), ``count`` rows, to (block, bins, best, history).

    best: the bin of each item in the best chromosome of any island; history: the
    fewest bins of that island at its start and after each child, epoch by epoch.
    """
    tasks = max(1, min(count * islands, TASKS))
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.array().cast("array<binary>").alias("population"), F.array().cast("array<int>").alias("history"))
    for e in range(epochs):
        state = _epoch(state.repartition(tasks, "block", "island"), capacity, generations, population, e)
        met = state.groupBy("block").agg(F.first("sizes").alias("sizes"), F.sort_array(F.collect_list(F.struct("island", "bins", "done", "population", "history"))).alias("all"))
        if e < epochs - 1:
            # Each island goes on with its own population and its neighbour's elite;
            # a block that has reached its bound keeps one island.
            done = F.exists("all", lambda x: x["done"])
            last = F.array_min(F.transform(F.filter("all", lambda x: x["done"]), lambda x: x["island"]))
            own = F.element_at("all", F.col("k") + 1)
            elite = F.slice(F.element_at("all", F.pmod(F.col("k") + 1, F.lit(islands)) + 1)["population"], 1, 1)
            state = met.withColumn("k", F.explode(F.when(done, F.array(last)).otherwise(F.sequence(F.lit(0), F.lit(islands - 1))))).select("block", F.col("k").alias("island"), "sizes", F.when(done, F.slice(own["population"], 1, 1)).otherwise(F.concat(own["population"], elite)).alias("population"), own["history"].alias("history"))
    fewest = F.array_min(F.transform("all", lambda x: x["bins"]))
    best = F.element_at(F.filter("all", lambda x: x["bins"] == F.array_min(F.transform("all", lambda y: y["bins"]))), 1)
    return met.select("block", fewest.alias("bins"), F.element_at(best["population"], 1).alias("best"), best["history"].alias("history"))


ITEM = "length int, row bigint, doc_id bigint, piece int, start bigint, ids_crc32 bigint"
PLACED = PIECES + ", row bigint, bin bigint, offset bigint, filled bigint"


def pack_blocks(rest: DataFrame, count: int, capacity: int, block: int) -> DataFrame:
    """Pieces shorter than a sequence, with their bin, offset, and the bin's fill."""
    n = max(1, math.ceil(count / block))
    item = F.struct(F.col("length").cast("int").alias("length"), "row", "doc_id", "piece", "start", "ids_crc32")
    blocks = rest.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(item), asc=False).alias("rows"))
    blocks = common.cut(blocks)
    best = evolve(blocks.select("block", F.col("rows.length").alias("sizes")), n, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, rows, data in zip(b.column("block").to_pylist(), b.column("rows"), b.column("best").to_pylist(), strict=True):
                rows = rows.values
                length = rows.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.frombuffer(data, np.int32)
                order = np.argsort(place, kind="stable")
                filled = np.bincount(place, length).astype(np.int64)
                offset = np.empty(len(place), np.int64)
                offset[order] = np.cumsum(length[order]) - length[order] - (np.cumsum(filled) - filled)[place[order]]
                columns = {f: rows.field(f) for f in ("doc_id", "piece", "start")}
                yield pa.RecordBatch.from_arrays([columns["doc_id"], columns["piece"], columns["start"], pa.array(length), rows.field("ids_crc32"), rows.field("row"), pa.array((np.int64(k) << 20) + place), pa.array(offset), pa.array(filled[place])], names=["doc_id", "piece", "start", "length", "ids_crc32", "row", "bin", "offset", "filled"])

    return blocks.join(best, "block").select("block", "rows", "best").mapInArrow(run, PLACED)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Every piece with its sequence and its place there."""
    whole = common.cut(pieces(docs, vocabulary, capacity).withColumn("row", F.monotonically_increasing_id()))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = whole.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("bigint"))
    rest = whole.filter(F.col("length") < capacity)
    count = rest.count()
    placed = pack_blocks(rest, count, capacity, block)
    if count > block:
        placed = common.cut(placed)
        loose = F.col("filled") < 0.9 * capacity
        again = placed.filter(loose)
        last = pack_blocks(again.select(*rest.columns), again.count(), capacity, block)
        placed = placed.filter(~loose).unionByName(last.withColumn("bin", F.col("bin") + (1 << 62)))
    return full.select(*out).unionByName(placed.withColumnRenamed("bin", "sequence_id").select(*out))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
