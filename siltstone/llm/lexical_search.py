"""Operator 11, ranked lexical search by dense blocked matrix multiplication.

Terms are the runs of digits, ASCII letters and all characters beyond ASCII, A-Z folded. Every document is scored for every
item: ``sum of w * impact`` over the item's terms, repeats included, all in whole numbers (see ``weight`` and ``impacts``).

The items are the stated query set. They are read in blocks of at most ``block_entries`` (item, term) entries, and
each block is broadcast, so the broadcast has a bound whatever the number of items. For a block:

1. one pass over the texts keeps of each document its length and the counts of the block's terms (two short lists) and
   writes them; texts do not move;
2. document frequencies are summed from those lists, one row for each task and term;
3. each task takes its documents by ``doc_tile`` and the items by ``item_tile``, cuts the item tile's own compact vocabulary
   into tiles, and multiplies weights (items x terms) with impacts (terms x documents) in float64. A vocabulary tile ends
   where its largest possible sum would reach 2^53, so every partial sum is an exact integer whatever order the
   library adds in; tiles are added up in 64-bit integers;
4. of each product the ``k`` best documents of an item are kept; equal scores at the border go by ascending doc_id,
   which tiles are sorted by. A task hands on k rows an item, and a window ranks those of all tasks: a million tasks make ten
   million short rows an item, sorted in parts.

Terms are known by 64-bit hashes (see ``kernels``).

Defined results: null and empty texts have no terms, count nowhere and are never found; a row of ``docs`` is a document, also
where it repeats another; a null doc_id comes last among equal scores; rows of ``items`` with equal item_id and text are one
item, with other texts items of their own under that id; an item without terms, or whose terms no document has, has no
rows; other columns are left behind; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.tables import stored

#: Bytes that terms are made of: 0-9, A-Z, a-z, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
#: No impact reaches this.
IMPACT = 1_000_000
FOUND = "item int, item_id long, doc_id long, score long"


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    item_tile: int = 128
    vocabulary_tile: int = 2048
    doc_tile: int = 1024
    block_entries: int = 1 << 20


@dataclass
class Block:
    """Items with their terms as (item, term, count) entries over the block's sorted vocabulary."""

    ids: list[int | None]
    vocabulary: np.ndarray
    item: np.ndarray
    term: np.ndarray
    count: np.ndarray


def term_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = TERM[buf]
    return K.runs(keep, keep, off)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the hashes of each different item's terms in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in K.chunks(batches, "text"):
            s, e, first = term_runs(buf, off)
            h = K.signed(K.hashes(buf, s, e, fold=True))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h))], ["item_id", "terms"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().mapInArrow(run, "item_id long, terms array<long>")


def blocks(items: DataFrame, most: int) -> Iterator[Block]:
    """The items one block after another; an item with more terms than a block has room for is a block of its own."""
    ids: list[int | None] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    entries = 0

    def made() -> Block:
        size = [len(t) for t, _ in held]
        all_terms = np.concatenate([t for t, _ in held])
        vocabulary, at = np.unique(all_terms, return_inverse=True)
        return Block(ids, vocabulary, np.repeat(np.arange(len(held)), size), at, np.concatenate([n for _, n in held]))

    for row in item_terms(items).toLocalIterator():
        t, n = np.unique(np.array(row.terms, np.int64).view(np.uint64), return_counts=True)
        if held and entries + len(t) > most:
            yield made()
            ids, held, entries = [], [], 0
        if len(t):
            ids.append(row.item_id)
            held.append((t, n))
            entries += len(t)
    if held:
        yield made()


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: its length in terms, and the vocabulary's terms in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part, buf, off in K.chunks(batches, "text"):
            s, e, first = term_runs(buf, off)
            h = K.hashes(buf, s, e, fold=True)
            at = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h)
            pair, count = np.unique(K.row_of(hit, first) * len(known) + at[hit], return_counts=True)
            n = np.diff(first)
            some = np.flatnonzero(n)
            ends = np.searchsorted(pair, (np.append(some, len(n))) * len(known))  # rows between have no terms
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (pair % len(known), count)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(n[some]), *lists], ["doc_id", "n", "terms", "counts"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and each row's number of values."""
    c = batch.column(batch.schema.get_field_index(column))
    return c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False)


def statistics(kept: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and the documents that hold each of the ``size`` terms of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, length = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(lists(b, "terms")[0], minlength=size)
            rows += b.num_rows
            length += int(b.column(b.schema.get_field_index("n")).to_numpy(zero_copy_only=False).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at]).astype(np.int32)), pa.array(np.concatenate([[rows, length], df[at]]))], ["term", "n"])

    sums = kept.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    total = dict(zip(term[term < 0].tolist(), n[term < 0].tolist(), strict=True))
    df = np.zeros(size, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return total.get(-1, 0), total.get(-2, 0), df


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(count: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L; Python's integers where 64 bits would not do."""
    if int(n.max(initial=0)) * 75 * documents >= 1 << 63:
        m = np.array([25 + 75 * int(x) * documents // length for x in n.tolist()], np.int64)
    else:
        m = 25 + 75 * n.astype(np.int64) * documents // length
    tf = count.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def vocabulary_tiles(term: np.ndarray, value: np.ndarray, item: np.ndarray, width: int, items: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights: items x terms) of an item tile's compact vocabulary. The largest row sum of a tile times the largest
    impact stays below 2^53; a single entry too large for that is dealt to several tiles."""
    room = EXACT // IMPACT - 1
    while len(term):
        now = np.minimum(value, room)
        order = np.argsort(term, kind="stable")
        columns, start = np.unique(term[order], return_index=True)
        high = np.maximum.reduceat(now[order], start)  # what a column adds to a row at most
        take = max(1, min(width, int(np.searchsorted(np.cumsum(high), room, "right"))))
        columns = columns[:take]
        mine = term <= columns[-1]
        dense = np.zeros((items, take))
        dense[item[mine], np.searchsorted(columns, term[mine])] = now[mine]
        yield columns, dense
        value = np.where(mine, value - now, value)
        left = value > 0
        term, value, item = term[left], value[left], item[left]


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest positive scores of each row; at the border the first columns win."""
    if scores.shape[1] > k:
        border = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        above, equal = scores > border, scores == border
        take = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        take = np.ones(scores.shape, bool)
    return np.nonzero(take & (scores > 0))


def merged(rows: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each item among (item, score, doc_id, is null) columns."""
    item, score, doc, null = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((doc, null, -score, item))
    item, score, doc, null = item[order], score[order], doc[order], null[order]
    first = np.searchsorted(item, item)
    keep = np.arange(len(item)) - first < k
    return item[keep], score[keep], doc[keep], null[keep]


def found(kept: DataFrame, block: Block, documents: int, length: int, df: np.ndarray, p: SearchParams) -> DataFrame:
    """``FOUND`` rows: the k best documents of each item in each task."""
    w = np.array([weight(documents, int(x)) if x else 0 for x in df.tolist()], np.int64)
    value = block.count.astype(np.int64) * w[block.term]
    some = value > 0
    shared = kept.sparkSession.sparkContext.broadcast((block.item[some], block.term[some], value[some], block.ids))
    size = len(block.vocabulary)

    def product(docs: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
        item, term, value, ids = shared.value
        doc, null, n, per, terms, counts = (np.concatenate(x) for x in zip(*docs, strict=True))
        order = np.lexsort((doc, null))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        column, impact = np.repeat(place, per), impacts(counts, np.repeat(n, per), documents, length)
        own = np.full(size, -1, np.int64)
        for low in range(0, len(ids), p.item_tile):
            a, b = np.searchsorted(item, [low, low + p.item_tile])
            rows = min(p.item_tile, len(ids) - low)
            scores = np.zeros((rows, len(doc)), np.int64)
            for columns, dense in vocabulary_tiles(term[a:b], value[a:b], item[a:b] - low, p.vocabulary_tile, rows):
                own[columns] = np.arange(len(columns))
                at = own[terms]
                hit = at >= 0
                tile = np.zeros((len(columns), len(doc)))
                tile[at[hit], column[hit]] = impact[hit]
                scores += (dense @ tile).astype(np.int64)
                own[columns] = -1
            r, c = best(scores, p.k)
            yield r + low, scores[r, c], doc[order][c], null[order][c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value[3]
        top: list[tuple[np.ndarray, ...]] = []
        for part in tiles(batches, p.doc_tile):
            top = [merged([*top, *product(part)], p.k)]
        if top and len(top[0][0]):
            item, score, doc, null = top[0]
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array([ids[i] for i in item], pa.int64()), pa.array(doc, mask=null), pa.array(score)], ["item", "item_id", "doc_id", "score"])
        K.release()

    return kept.mapInArrow(run, FOUND)


def tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """The rows in lots of ``most`` documents: (doc_id, is null, n, number of terms, terms, counts) arrays."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            batch = batch.slice(part.num_rows)
            ids = part.column(part.schema.get_field_index("doc_id"))
            terms, per = lists(part, "terms")
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), part.column(part.schema.get_field_index("n")).to_numpy(zero_copy_only=False), per, terms, lists(part, "counts")[0]))
            rows += part.num_rows
            if rows == most:
                yield held
                held, rows = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    p = params or SearchParams()
    spark = docs.sparkSession
    K.small_batches(spark)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    out = None
    for block in blocks(items, p.block_entries):
        kept = stored(postings(docs, block.vocabulary), "postings")
        documents, length, df = statistics(kept, len(block.vocabulary))
        top = found(kept, block, documents, length, df, p).withColumn("rank", rank).where(F.col("rank") <= p.k).select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
