"""Operator 3, LM scoring by a gated recurrent network (``gru``), with an add-one unigram score beside it.

*Counts.* Every training document's tokens (words with A-Z folded, then one end) are counted exactly:
pre-aggregated in each task, summed by word hash. From them come N, V, the frequent words that are symbols
of the network, a table of at most ``heavy`` counts that is broadcast (bounded by its threshold, which is
read from a histogram of counts), and the totals of the rare classes.

*Training.* Every training document is learned from, whole, in one of the ``rounds`` (told by a hash of its id).
In a round every replica starts from the common weights, makes a truncated
backpropagation pass over its documents of the round, and the weights are averaged by tokens: each
sends its weights as packed blocks of fixed size, which are summed as they arrive. A replica is a task of the training scan;
splits are put together until there is no more than one for each ``lot`` tokens, since an average of replicas that have each
seen little has learned little. So what a replica learns from does not shrink as tasks grow, and small inputs give the same
model however they are split; splits longer than a lot stay whole.

*Scoring.* All documents, whole: state is carried over windows. A word outside the symbols costs its rare
class given the state, then its share of that class, ``(c + 1) / (N_class + V_class + 1)``, which leaves the
mass of one unseen word; so the score is a normalised probability over words, like the base score. Shares
add up outside the network: counts of words beyond the broadcast table are joined to (row, word) pairs.

Words are known by 64-bit hashes (see ``kernels``). Defined results: null text is empty (one token, the end);
a null doc_id is a training document; repeated rows count, are learned from and are scored each; an empty table gives an empty
result; without training documents every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import gru
from siltstone.llm import kernels as K
from siltstone.llm.tables import stored, with_text


@dataclass(frozen=True)
class LmParams:
    modulus: int = 7
    held: int = 2
    heavy: int = 1 << 18
    rounds: int = 2
    lot: int = 1 << 19
    rate: float = 0.15
    lanes: int = 512
    pool: int = 4 << 20
    chunk: int = 1 << 20
    packed: int = 4096
    shape: gru.Shape = field(default_factory=gru.Shape)


END = np.uint64(1)
LN10 = log(10.0)


def tokens(buf: np.ndarray, off: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows (each row's words, then END), rare class of each token, tokens of each row."""
    s, e, first = K.words(buf, off)
    h = K.hashes(buf, s, e, fold=True)
    a, z = buf[s].astype(np.uint64), buf[e - 1].astype(np.uint64)
    cls = (K.mix(a * np.uint64(256) + z) % np.uint64(rare)).astype(np.int32)
    n = len(off) - 1
    out, kind = np.full(len(h) + n, END), np.zeros(len(h) + n, np.int32)
    at = np.arange(len(h)) + K.row_of(np.arange(len(h)), first)
    out[at], kind[at] = h, cls
    return out, kind, np.diff(first) + 1


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, n, r = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(inverse, weights=n).astype(np.int64), r[first]


def count(docs: DataFrame, p: LmParams) -> DataFrame:
    """(h, n, r): exact counts of the training documents' tokens, and each word's rare class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(u, n, r):
            for k in range(0, len(u), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(u[k : k + 50_000])), pa.array(n[k : k + 50_000]), pa.array(r[k : k + 50_000])], ["h", "n", "r"])

        parts, size = [], 0
        for _, buf, off in K.chunks(batches, "text"):
            h, r, _ = tokens(buf, off, p.shape.rare)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((u, n, r[first]))
            size += len(u)
            if size > 1_500_000:
                one = _sum_up(parts)
                parts, size = [one], len(one[0])
                if size > 750_000:
                    yield from give(*one)
                    parts, size = [], 0
        if parts:
            yield from give(*_sum_up(parts))

    rows = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "h long, n long, r int")
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("r").alias("r"))


@dataclass
class Lexicon:
    """What scoring needs of the counts; at most ``heavy`` words."""

    h: np.ndarray  # sorted
    symbol: np.ndarray  # of the network, or -1
    logc: np.ndarray  # ln(c + 1)
    rare_total: np.ndarray  # ln(N_class + V_class + 1)
    n: int
    v: int

    def __post_init__(self) -> None:
        some = self.symbol >= 0
        self.few, self.few_symbol = self.h[some], self.symbol[some]

    def few_symbols(self, h: np.ndarray, r: np.ndarray, frequent: int) -> np.ndarray:
        """The network's symbols alone, from the small table of its frequent words."""
        if not len(self.few):
            return frequent + r
        at = np.minimum(np.searchsorted(self.few, h), len(self.few) - 1)
        return np.where(self.few[at] == h, self.few_symbol[at], frequent + r)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in the table, and whether it is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def symbols(self, h: np.ndarray, r: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, there = self.look(h)
        sym = np.where(there, self.symbol[at], -1) if len(self.h) else np.full(len(h), -1)
        return np.where(sym >= 0, sym, frequent + r).astype(np.int64), at, there


def lexicon(counts: DataFrame, p: LmParams) -> tuple[Lexicon, np.ndarray, np.ndarray, int]:
    """The lexicon, counts of the symbols (frequent, rare), and the count from which a word is in the lexicon."""
    level = F.floor(F.log2("n") * 8).cast("int")
    hist = sorted(((r.l, r.words) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, have = None, 0
    for at, words in hist:
        if have + words > p.heavy:
            break
        least, have = at, have + words
    rare = counts.groupBy("r").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n_r, v_r = np.zeros(p.shape.rare), np.zeros(p.shape.rare)
    for r in rare:
        n_r[r.r], v_r[r.r] = r.n, r.v
    n, v = int(n_r.sum()), int(v_r.sum())
    got = counts.where(level >= least if least is not None else F.lit(False)).toArrow()
    h = got.column("h").to_numpy().view(np.uint64) if got.num_rows else np.zeros(0, np.uint64)
    c, cls = (got.column(k).to_numpy() if got.num_rows else np.zeros(0, np.int64) for k in ("n", "r"))
    order = np.lexsort((h, -c, h != END))  # the end is symbol 0
    h, c, cls = h[order], c[order], cls[order]
    top = p.shape.frequent
    freq = np.zeros(top)
    freq[: min(top, len(c))] = c[:top]
    n_r -= np.bincount(cls[:top], weights=c[:top], minlength=p.shape.rare)
    v_r -= np.bincount(cls[:top], minlength=p.shape.rare)
    symbol = np.where(np.arange(len(h)) < top, np.arange(len(h)), -1)
    by = np.argsort(h)
    lex = Lexicon(h[by], symbol[by], np.log(c[by] + 1.0), np.log(n_r + v_r + 1.0), n, v)
    return lex, freq, n_r, least if least is not None else 1 << 20


def fit(docs: DataFrame, lex, freq: np.ndarray, rare: np.ndarray, p: LmParams) -> np.ndarray:
    """Weights after the training rounds. ``lex`` is a broadcast Lexicon."""
    spark, shape = docs.sparkSession, p.shape
    replicas = max(1, lex.value.n // (p.rounds * p.lot))
    flat = gru.Model.born(shape, freq, rare).flat
    for k in range(p.rounds):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            model = gru.Model(shape, start.value.copy())
            memory, seen = np.full(shape.total, 1e-6, np.float32), 0
            pooled: list[tuple[np.ndarray, np.ndarray]] = []

            def learn() -> None:
                sym, n = (np.concatenate(x) for x in zip(*pooled, strict=True))
                gru.train(model, sym, n, 0, memory, p.rate / (1 + k), most=p.lanes)
                pooled.clear()

            for _, buf, off in K.chunks(batches, "text", p.chunk):
                h, r, n = tokens(buf, off, shape.rare)
                pooled.append((lex.value.few_symbols(h, r, shape.frequent).astype(np.int16 if shape.symbols < 1 << 15 else np.int32), n))
                seen += len(h)
                if sum(len(x) for x, _ in pooled) > p.pool:
                    learn()
            if pooled:
                learn()
            if seen:
                parts = [model.flat[i : i + p.packed].tobytes() for i in range(0, shape.total, p.packed)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary()), pa.array(np.full(len(parts), seen, np.int64))], ["block", "w", "n"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            count: dict[int, int] = {}
            for b in batches:
                for block, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    add = np.frombuffer(w, np.float32).astype(np.float64) * n
                    total[block] = total[block] + add if block in total else add
                    count[block] = count.get(block, 0) + n
            at = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([(total[i] / count[i]).astype(np.float32).tobytes() for i in at], pa.binary()), pa.array([count[i] for i in at], pa.int64())], ["block", "w", "n"])

        part = docs.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(p.rounds)) == k))
        sent, form = part.select("text").coalesce(replicas).mapInArrow(run, "block int, w binary, n long"), "block int, w binary, n long"
        got = sent.repartition(-(-shape.total // p.packed), "block").mapInArrow(mean, form).collect()  # one model
        if got:
            flat = np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(got, key=lambda r: r.block)])
    return flat


ROW = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, times array<int>"


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def score(docs: DataFrame, params: LmParams | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each document."""
    p = params or LmParams()
    spark, shape = docs.sparkSession, p.shape
    K.small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % p.modulus == p.held, F.lit(False))
    d = with_text(docs).withColumn("held_out", held)
    counts = stored(count(d, p), "counts")
    found, freq, rare, least = lexicon(counts, p)
    lex = spark.sparkContext.broadcast(found)
    weights = spark.sparkContext.broadcast(fit(d, lex, freq, rare, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lx = gru.Model(shape, weights.value), lex.value
        pooled: list[tuple[np.ndarray, np.ndarray]] = []
        ready: list[tuple] = []

        def give() -> Iterator[pa.RecordBatch]:
            """The pooled documents run through the network together, so that its lanes are long and full."""
            sym, n = (np.concatenate(x) for x in zip(*pooled, strict=True))
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=gru.score(model, sym, n, 0, most=p.lanes), minlength=len(n))
            at = 0
            for cols, size, known, base, share, tail, times in ready:
                k = len(size)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(size.astype(np.int64)), pa.array(known), pa.array(base / LN10), pa.array((total[at : at + k] + share) / LN10), tail, times], [x.split()[0] for x in ROW.split(", ")])
                at += k
            pooled.clear()
            ready.clear()

        for part, buf, off in K.chunks(batches, "text", p.chunk):
            h, r, n = tokens(buf, off, shape.rare)
            sym, at, there = lx.symbols(h, r, shape.frequent)
            logc = np.where(there, lx.logc[at], 0.0) if len(lx.h) else np.zeros(len(h))
            doc = np.repeat(np.arange(len(n)), n)
            share = np.bincount(doc, weights=np.where(sym >= shape.frequent, logc - lx.rare_total[r], 0.0), minlength=len(n))
            key = np.flatnonzero(~there)
            order = key[np.lexsort((h[key], doc[key]))]
            ho, do = h[order], doc[order]
            new = np.append(True, (ho[1:] != ho[:-1]) | (do[1:] != do[:-1])) if len(ho) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(ho))).astype(np.int32)
            cut = np.searchsorted(do[first], np.arange(len(n) + 1))
            known = np.bincount(doc, weights=there, minlength=len(n)).astype(np.int64)
            base = np.bincount(doc, weights=logc, minlength=len(n)) - n * log(lx.n + lx.v + 1)
            pooled.append((sym.astype(np.int16 if shape.symbols < 1 << 15 else np.int32), n))
            cols = [part.column(part.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out")]
            ready.append((cols, n, known, base, share, _lists(K.signed(ho[first]), cut), _lists(times, cut)))
            if sum(len(x) for x, _ in pooled) > p.pool:
                yield from give()
        if pooled:
            yield from give()

    rows = stored(d.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, ROW), "scored")
    light = counts.where(F.floor(F.log2("n") * 8).cast("int") < least).select("h", "n")
    pairs = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.times").alias("k"))
    more = pairs.join(light, "h").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"), F.sum("k").alias("found"))
    add = F.coalesce("more", F.lit(0.0))
    return rows.join(more, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(found.n).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("score") + add).alias("score"))
