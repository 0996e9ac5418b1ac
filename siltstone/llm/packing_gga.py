"""Operator 6, best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces (ids of a public tokenizer, then id 0; only documents longer than a
sequence are cut, at multiples of the sequence length), and every piece gets a number of its own. Full
pieces are sequences of their own. The others are dealt by a hash of their number into blocks of about
``block`` pieces, so equal rows and null ids spread like any others. Each block starts with best-fit
decreasing; a block that meets the lower bound ``ceil(total / length)`` with it is done. The others are
evolved by ``islands`` islands, each a task with its own population; after every epoch each
island's elite migrates to the next island of the ring. The best individual of a block is used.

Individuals are groupings: the genes are bins. Crossover injects whole well-filled bins of the
second parent into the first, removes the bins that hold a duplicate of an injected piece, and
puts the displaced pieces back: first by swaps that fill a bin better (a piece of a bin for a larger displaced
one), then by best fit, largest first. Mutation empties the worst bins. Evolution of a block ends early where it
meets the lower bound, and an epoch after ``patience`` generations without a better child, or when its children have put
about ``work`` pieces into bins: a block of thousands, which best fit misses by a sequence or two, gets a short search.

Blocks are independent, so work and memory are proportional to the pieces, whatever their keys;
what a block loses against one global packing is at most one sequence in about ``block / 2``.

Defined results: null text is empty, an empty document is the single id 0; repeated rows and null
ids are packed like any other rows; other columns are left behind; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from unicodedata import is_normalized
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.tables import parts, stored, with_text


@dataclass(frozen=True)
class PackParams:
    tokenizer: str = "word_bpe_49k.json"
    length: int = 2048
    block: int = 4096
    islands: int = 3
    epochs: int = 3
    generations: int = 40
    patience: int = 12
    population: int = 8
    work: int = 40_000
    well_filled: float = 0.97
    cache_words: int = 120_000


# ---------------------------------------------------------------- tokens


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?%$&*#|\"()"]] = True


def apart(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with A-Z folded and a space between a letter and the marks after it.

    The tokenizer folds case and starts a new piece there by itself, so ids stay the same; there are fewer
    different words to look up. Rows that may spell a special token must not pass through here.
    """
    low = _LOWER[buf]
    cut = _LETTER[low[:-1]] & _MARK[low[1:]] if len(low) > 1 else np.zeros(0, bool)
    at = np.flatnonzero(cut) + 1
    if not len(at):
        return low, off
    new = np.insert(low, at, 32)
    return new, off + np.searchsorted(at, off, "left")


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space before it splits, and no merge crosses it, so a text's ids are
    its words' ids one after another; words are looked up in a cache of bounded size. A word of nothing
    but lower-case letters in composed form needs none of the tokenizer's normalising and splitting and
    goes to its model directly, byte by byte in the byte-level alphabet.
    """

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.tok, self.most, self.known = Tokenizer.from_file(path), most, {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _learn(self, words: list[bytes]) -> None:
        model, other = self.tok.model, []
        for w in words:
            t = w.decode()
            if t.isalpha() and t == t.lower() and (w.isascii() or is_normalized("NFC", t)):
                ids = [x.id for x in model.tokenize(t if w.isascii() else w.decode("latin-1").translate(self.alphabet))]
                self.known[w] = array("I", ids).tobytes()
            else:
                other.append(w)
        for w, e in zip(other, self.tok.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
            self.known[w] = array("I", e.ids).tobytes()

    def encode(self, buf: np.ndarray, off: np.ndarray) -> list[bytes]:
        raw = buf.tobytes()
        texts = [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        wide, at = apart(buf, off)
        low = wide.tobytes()
        split = [(t if b"<|" in t else low[at[i] : at[i + 1]]).split() for i, t in enumerate(texts)]
        here = set(chain.from_iterable(split))
        new = here.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {w: self.known[w] for w in here if w in self.known}
        self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def tokenizer_path(p: PackParams) -> str:
    """A bare name is one of the public tokenizers installed on each executor; anything else is a path there."""
    if "/" in p.tokenizer:
        return p.tokenizer
    import public_tokenizers

    return public_tokenizers.path(p.tokenizer)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, p: PackParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = Encoder(tokenizer_path(p), p.cache_words)
        for part, buf, off in K.chunks(batches, "text"):
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            rows: list[tuple] = []
            for doc, got in zip(ids, enc.encode(buf, off), strict=True):
                got += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(got), 4 * p.length)):
                    one = got[at : at + 4 * p.length]
                    rows.append((doc, k, at // 4, len(one) // 4, crc32(one)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        del enc
        K.release()

    return docs.mapInArrow(run, PIECES)


# ---------------------------------------------------------------- evolution


def best_fit(bins: list[list[int]], free: list[int], todo: list[int], sizes: list[int], cap: int) -> None:
    """Put ``todo`` (largest first) into the open bin that leaves the least room, else into a new one."""
    room = sorted((f, i) for i, f in enumerate(free))
    for x in todo:
        s = sizes[x]
        k = bisect_left(room, (s, -1))
        if k < len(room):
            f, i = room.pop(k)
        else:
            f, i = cap, len(bins)
            bins.append([])
            free.append(cap)
        bins[i].append(x)
        free[i] = f - s
        if f > s:
            insort(room, (f - s, i))


def fitness(free: list[int], cap: int) -> tuple[int, float]:
    """Fewest bins first, then Falkenauer's mean squared fill."""
    return -len(free), sum((1 - f / cap) ** 2 for f in free) / max(1, len(free))


class Island:
    """One population of groupings of one block's pieces."""

    def __init__(self, sizes: np.ndarray, cap: int, seed: int, p: PackParams):
        self.sizes, self.cap, self.p = sizes.tolist(), cap, p
        self.rng = np.random.default_rng(seed)
        self.bound = -(-sum(self.sizes) // cap)
        self.order = np.argsort(-sizes, kind="stable")
        rounds = p.work // max(1, len(sizes))
        self.generations, self.population = min(p.generations, max(4, rounds)), min(p.population, max(3, rounds // 2))

    def born(self, noise: float) -> list[list[int]]:
        """Best-fit decreasing of sizes with a little noise in the order."""
        order = self.order
        if noise:
            s = np.array(self.sizes)
            order = np.argsort(-s * (1 + noise * self.rng.standard_normal(len(s))), kind="stable")
        bins: list[list[int]] = []
        best_fit(bins, [], order.tolist(), self.sizes, self.cap)
        return bins

    def free(self, bins: list[list[int]]) -> list[int]:
        return [self.cap - sum(map(self.sizes.__getitem__, b)) for b in bins]

    def put_back(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Loose pieces into the bins: swaps first, then best fit. A swap puts the largest loose piece that fits in
        place of a smaller one of the bin, where that fills the bin best; fullest bins first."""
        sizes, free = self.sizes, self.free(bins)
        pool = sorted((sizes[x], x) for x in loose)
        for k in sorted(range(len(bins)), key=free.__getitem__):
            gain, pick = 0, None
            for j, x in enumerate(bins[k]) if free[k] else ():
                at = bisect_left(pool, (sizes[x] + free[k] + 1, -1)) - 1
                if at >= 0 and pool[at][0] - sizes[x] > gain:
                    gain, pick = pool[at][0] - sizes[x], (j, at)
            if pick:
                j, at = pick
                x, bins[k][j] = bins[k][j], pool.pop(at)[1]
                insort(pool, (sizes[x], x))
                free[k] -= gain
        best_fit(bins, free, [x for _, x in reversed(pool)], sizes, self.cap)
        return bins

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        least = (1 - self.p.well_filled) * self.cap
        good = [x for x, f in zip(b, self.free(b), strict=True) if f <= least]
        pick = self.rng.random(len(good)) < 0.3
        injected = [list(x) for x, y in zip(good, pick, strict=True) if y]
        inside = {i for x in injected for i in x}
        kept, loose = injected, []
        for x in a:
            if inside.isdisjoint(x):
                kept.append(list(x))
            else:
                loose += [i for i in x if i not in inside]
        return self.put_back(kept, loose)

    def mutate(self, a: list[list[int]]) -> list[list[int]]:
        free = np.array(self.free(a))
        n = max(1, len(a) // 25)
        worst = set(np.argsort(-free - self.rng.random(len(a)), kind="stable")[:n].tolist()) | set(self.rng.integers(0, len(a), n).tolist())
        return self.put_back([list(x) for i, x in enumerate(a) if i not in worst], [i for k in worst for i in a[k]])

    def evolve(self, population: list[list[list[int]]]) -> list[list[list[int]]]:
        score = lambda x: fitness(self.free(x), self.cap)
        ranked = sorted(((score(x), k, x) for k, x in enumerate(population)), key=lambda y: (y[0], -y[1]), reverse=True)
        idle = 0
        for _ in range(self.generations):
            if -ranked[0][0][0] <= self.bound or idle >= self.p.patience:
                break
            a, b = self.rng.integers(0, len(ranked), 2)
            child = self.cross(ranked[min(a, b)][2], ranked[max(a, b) if a != b else 0][2])
            child = self.mutate(child)
            s = score(child)
            idle = 0 if s > ranked[0][0] else idle + 1
            if s > ranked[-1][0]:
                ranked[-1] = (s, -1, child)
                ranked.sort(key=lambda y: y[0], reverse=True)
        return [x for _, _, x in ranked[: self.population]]


def _pack(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _unpack(blob: bytes) -> list[list[int]]:
    a = np.frombuffer(blob, np.int32)
    order = np.argsort(a, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(a[order])) + 1)] if len(a) else []


STATE = "block long, island int, sizes binary, population array<binary>, elite binary, bins long, fill double"
FIELDS = [x.split()[0] for x in STATE.split(", ")]


def evolve(state: DataFrame, epoch: int, p: PackParams) -> DataFrame:
    """One epoch on each island: a row in, a row out. A population of one is filled up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = np.frombuffer(r["sizes"], np.int32)
                island = Island(sizes, p.length, hash((r["block"], r["island"], epoch)) & 0x7FFFFFFF, p)
                pop = [_unpack(x) for x in r["population"]]
                pop += [island.born(0.01 * (1 + r["island"] + k)) for k in range(len(pop), island.population)]
                pop = island.evolve(pop)
                bins, fill = fitness(island.free(pop[0]), p.length)
                blobs = [_pack(x, len(sizes)) for x in pop]
                yield pa.RecordBatch.from_pylist([r | {"population": blobs, "elite": blobs[0], "bins": -bins, "fill": fill}], b.schema)

    return state.select(*FIELDS).mapInArrow(run, STATE)


def groupings(items: DataFrame, p: PackParams) -> DataFrame:
    """(block, elite, bins, first_bins): the packing of each block's items (block, num, length) in the order of num."""

    def first(t: pa.Table) -> pa.Table:
        sizes = t.sort_by("num").column("length").to_numpy().astype(np.int32)
        island = Island(sizes, p.length, 0, p)
        bins = island.born(0.0)
        n, fill = fitness(island.free(bins), p.length)
        return pa.table({"block": t.column("block").slice(0, 1), "sizes": pa.array([sizes.tobytes()], pa.binary()), "elite": pa.array([_pack(bins, len(sizes))], pa.binary()), "bins": [-n], "fill": [fill], "bound": [island.bound]})

    begun = stored(items.groupBy("block").applyInArrow(first, "block long, sizes binary, elite binary, bins long, fill double, bound long"), "groupings")
    state = begun.where("bins > bound").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(p.islands - 1)))).withColumn("population", F.array("elite")).select(*FIELDS)
    todo = begun.where("bins > bound").count()
    for epoch in range(p.epochs if todo else 0):
        if epoch:
            guest = state.select("block", F.pmod(F.col("island") + 1, F.lit(p.islands)).alias("island"), F.col("elite").alias("guest"))
            state = state.join(guest, ["block", "island"]).withColumn("population", F.concat(F.array("guest"), "population")).select(*FIELDS)
        state = stored(evolve(state.repartition(min(p.islands * todo, 100_000), "block", "island"), epoch, p), "islands")
    every = begun.select("block", "bins", "fill", F.lit(-1).alias("island"), "elite").unionByName(state.select("block", "bins", "fill", "island", "elite"))
    best = every.groupBy("block").agg(F.min(F.struct("bins", (-F.col("fill")).alias("f"), "island", "elite")).alias("b"))
    return best.select("block", "b.elite", "b.bins").join(begun.select("block", F.col("bins").alias("first_bins")), "block")


def pack(docs: DataFrame, params: PackParams | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    p = params or PackParams()
    spark = docs.sparkSession
    K.small_batches(spark)
    cut = stored(pieces(with_text(docs), p).withColumn("num", F.monotonically_increasing_id()), "pieces")  # from here on a number is fixed
    loose = cut.where(F.col("length") < p.length)
    blocks = parts(spark, loose.count(), p.block)
    items = loose.withColumn("block", F.pmod(F.xxhash64("num"), F.lit(blocks).cast("long")))
    best = groupings(items.select("block", "num", "length"), p).select("block", "elite")

    def place(t: pa.Table, winner: pa.Table) -> pa.Table:
        t = t.sort_by("num")
        where = np.frombuffer(winner.column("elite")[0].as_buffer(), np.int32)
        size = t.column("length").to_numpy()
        order = np.argsort(where, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.searchsorted(where[order], where[order])  # of the sequence's pieces
        offset = np.empty(len(size), np.int64)
        offset[order] = before - before[first] if len(size) else before
        sequence = (t.column("block").to_numpy() << 32) + where
        return t.drop_columns(["block", "num"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    out = items.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(place, PIECES + ", sequence_id long, offset long")
    full = cut.where(F.col("length") >= p.length).withColumn("sequence_id", -1 - F.col("num")).withColumn("offset", F.lit(0).cast("long")).drop("num")
    return out.unionByName(full)
