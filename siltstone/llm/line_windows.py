"""Operator 9, line deduplication by overlapping three-line windows.

A text's lines are its ``\\n``-split parts; lines with a word (see ``kernels``) count, blank ones are
passed over. Every ``window`` counting lines in a row are hashed. For each hash found more than once
anywhere, its first occurrence - smallest doc_id (null first), then text fingerprint, then position -
stays; all later ones are covered, from their first line to their last, and the union of the covered
lines is removed from each text. A window that overlaps the first occurrence and repeats it is a later one like any
other: of four equal lines the first stays.

Occurrences are 40-byte rows. The first occurrence is found by a partial aggregation, so a window that
a third of all documents share arrives as one row a task; the join back is split by the adaptive
planner. A document's covered spans are as many as its own lines at most. Spans of a few megabytes in all are broadcast;
beyond that, texts that surely have none (told by a bitmap of fixed size) do not move, the others are joined to theirs.

Defined results: null text is empty and stays as it is; a text with fewer than ``window`` counting lines
never changes; rows with equal doc_id and equal text are one document and change alike; a null doc_id is
an id of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.tables import key_bitmap, rows_by_bitmap, stored

WINDOW = 3
#: Spans up to this size are broadcast.
BROADCAST_BYTES = 8 << 20


def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines: starts, ends (without \\n), first line of each row, and whether a line has a word."""
    nl = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([off[:-1], nl + 1]), kind="stable")
    first = np.concatenate([[0], np.cumsum(1 + K.sums((buf == 10).astype(np.int64), off))])
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    if len(first) > 1:
        ends[first[1:] - 1] = off[1:]
    # a row that ends in \n has an empty last line that starts where the next row does
    dark = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~K.SPACE[buf], out=dark[1:])
    return starts, ends, first, dark[ends] > dark[starts]


def fingerprint(column: str = "text"):
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, f, a, b, h): each window with its first and last line number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in K.chunks(batches, "text"):
            s, e, first, some = lines_of(buf, off)
            at = np.flatnonzero(some)
            own = np.searchsorted(at, first)
            h, k = K.windows(K.hashes(buf, s[at], e[at]), own, window)
            row = K.row_of(k, own)
            take = pa.array(row)
            a, b = at[k] - first[row], at[k + window - 1] - first[row]
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(K.signed(h))], ["doc_id", "f", "a", "b", "h"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint().alias("f"), "text").mapInArrow(run, "doc_id long, f long, a int, b int, h long")


def covered_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, f, spans): the covered spans of each document that has any."""
    w = stored(occurrences(docs, window), "windows")
    first = w.groupBy("h").agg(F.min(F.struct("doc_id", "f", "a")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    later = w.join(first, "h").where(~F.struct("doc_id", "f", "a").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "f").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


CUT = "text string, n_lines long, n_removed long, removed_lines array<int>"


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    out: tuple[list, list, list] = ([], [], [])
    for t, own in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        lines = (t or "").split("\n")
        gone = np.zeros(len(lines), bool)
        for s in own or ():
            gone[s["a"] : s["b"] + 1] = True
        at = np.flatnonzero(gone)
        for o, v in zip(out, ("\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if len(at) else t, len(lines), at.tolist()), strict=True):
            o.append(v)
    n = [len(x) for x in out[2]]
    return pa.StructArray.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(n, pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["text", "n_lines", "n_removed", "removed_lines"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` after removal, and three new columns: n_lines, n_removed, removed_lines.

    Columns of ``docs`` with one of the three new names are replaced.
    """
    K.small_batches(docs.sparkSession)
    results = ["n_lines", "n_removed", "removed_lines"]
    rest = [F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)]
    own = docs.select(*rest, F.col("doc_id").cast("long").alias("id"), fingerprint().alias("f"), F.col("text").cast("string").alias("old"))
    own = own.withColumn("key", F.xxhash64("id", "f"))
    spans = stored(covered_spans(docs, window), "spans").select(F.col("doc_id").alias("sid"), F.col("f").alias("sf"), "spans")
    same = F.col("id").eqNullSafe(F.col("sid")) & (F.col("f") == F.col("sf"))
    size = spans.agg(F.sum(F.size("spans") * 16 + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # few spans go to the texts
        spans = F.broadcast(spans)
        hit, rest = own.join(spans, same), own.join(spans, same, "left_anti")
    else:
        bitmap = key_bitmap(spans.select(F.xxhash64("sid", "sf").alias("key")), "key")
        hit, rest = rows_by_bitmap(own, "key", bitmap, True).join(spans, same, "left"), rows_by_bitmap(own, "key", bitmap, False)
    cut = hit.withColumn("cut", F.arrow_udf(_cut, CUT)("old", "spans"))
    whole = F.struct(F.col("old").alias("text"), F.size(F.split(F.coalesce("old", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<int>").alias("removed_lines"))
    rest = rest.withColumn("cut", whole)
    kept = [(F.col("cut.text") if c == "text" else F.col(f"in_{k}")).alias(c) for k, c in enumerate(docs.columns) if c not in results]
    done = [*kept, *[F.col(f"cut.{c}").alias(c) for c in results]]
    return cut.select(*done).unionByName(rest.select(*done))
