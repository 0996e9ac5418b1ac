"""Operator 2, quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Tokens are runs of word bytes (letters, digits, any non-ASCII byte) and runs of other visible
bytes, case kept; features are token unigrams and bigrams, each hashed into ``buckets`` buckets.
Two multinomials are estimated: ``raw`` from every document, ``target`` from the trusted ones.
A document's ratio is the mean over its features of ``log(p_target / p_raw)``, and every
document is kept if, and only if, that mean is at least ``threshold`` - one fixed number, no
quantile, so a document's verdict does not depend on its neighbours.

The trusted sample is bounded: the ``trusted`` labelled documents (quality 1, and not marked toxic) with the smallest
``xxhash64(doc_id)``; only their ids reach the executors. Bucket counts are a fixed-size table
(two times ``buckets`` rows at any corpus size), so it can be collected and broadcast; the counting runs
over all rows of all documents, pre-aggregated per task.

Smoothing: a bucket with raw count r is expected e = r * T / R times in the target. Its ratio is
``(t + backing * prior) / (e + backing)``: for a unigram the prior is 1, for a bigram the geometric
mean of the ratios of its two words. So what is rare in a small corpus says little by itself and a
bigram falls back on its words, while a feature that is expected often and never seen costs much.

Defined results: null text counts as empty; a text without features has ratio 0 and is judged by
the base rules alone; null doc_id never is trusted; repeated rows are each judged alike; an empty
corpus gives an empty result; without trusted documents the ratio is 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm import tables


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 18
    trusted: int = 8192
    backing: float = 4.0
    threshold: float = -0.2
    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8


_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 word, 2 other
_CLASS[33:] = 2
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = 1
_CLASS[:33] = np.where(K.SPACE[:33], 0, 2)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def features(buf: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of each unigram and then of each bigram, whose buckets follow those of unigrams; and the place of
    each bigram's first word among the unigrams."""
    kind = _CLASS[buf]
    s, e, first = K.runs(kind, kind > 0, off)
    h = K.hashes(buf, s, e)
    two, at = K.windows(h, first, 2)
    bucket = np.concatenate([h % np.uint64(buckets), two % np.uint64(buckets) + np.uint64(buckets)]).astype(np.int64)
    return bucket, np.concatenate([K.row_of(np.arange(len(h)), first), K.row_of(at, first)]), at


def ngram_counts(docs: DataFrame, trusted_ids: list[int], p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts per bucket, over all rows. Each task sends a bucket at most once."""
    ids = np.array(sorted(trusted_ids), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * p.buckets, np.int64), np.zeros(2 * p.buckets, np.int64)
        for part, buf, off in K.chunks(batches, "text"):
            bucket, row, _ = features(buf, off, p.buckets)
            raw += np.bincount(bucket, minlength=2 * p.buckets)
            mine = part.column(part.schema.get_field_index("doc_id")).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            good = np.isin(mine, ids)
            if good.any():
                target += np.bincount(bucket[good[row]], minlength=2 * p.buckets)
        at = np.flatnonzero(raw)
        for k in range(0, len(at), 50_000):
            i = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(raw[i]), pa.array(target[i])], ["bucket", "raw", "target"])

    got = tables.with_text(docs).mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(2 * p.buckets), np.zeros(2 * p.buckets)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return raw, target


def ratios(raw: np.ndarray, target: np.ndarray, p: QualityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(p_target / p_raw) of unigram buckets; target counts and expected ones of bigram buckets."""
    n = p.buckets
    if not target[:n].sum():
        return np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
    expected = np.concatenate([x * (t.sum() / max(x.sum(), 1)) for x, t in ((raw[:n], target[:n]), (raw[n:], target[n:]))])
    one = np.log((target[:n] + p.backing) / (expected[:n] + p.backing))
    return one.astype(np.float32), target[n:].astype(np.float32), expected[n:].astype(np.float32)


def mean_ratios(buf: np.ndarray, off: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """The mean log ratio and the number of features of each row."""
    one, target, expected = tables
    bucket, row, at = features(buf, off, p.buckets)
    words, pairs = np.split(bucket, [len(bucket) - len(at)])
    word, pair = one[words], pairs - p.buckets
    prior = np.exp((word[at] + word[at + 1]) / 2)
    value = np.concatenate([word, np.log((target[pair] + p.backing * prior) / (expected[pair] + p.backing))])
    count = np.bincount(row, minlength=len(off) - 1)
    return np.bincount(row, weights=value, minlength=len(off) - 1) / np.maximum(count, 1), count


def base_stats(buf: np.ndarray, off: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    n = len(off) - 1
    s, e, first = K.words(buf, off)
    dark = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(K.chars(buf) * ~K.SPACE[buf], out=dark[1:])
    out = {"n_words": np.diff(first), "word_chars": dark[off[1:]] - dark[off[:-1]], "n_symbols": K.sums(_SYMBOL[buf], off)}
    # repeated windows: sort (row, hash), mark runs, then cover the words of each marked window
    h, at = K.windows(K.hashes(buf, s, e), first, window)
    row = K.row_of(at, first)
    out["n_repeat_words"] = K.sums(_covered(_repeated(h, row), at, window, len(s)), first)
    # lines with a word; equal to an earlier line of the same row
    nl = np.flatnonzero(buf == 10)
    cut = np.union1d(nl, off[1:] - 1) + 1 if len(buf) else np.zeros(0, np.int64)
    ls = np.concatenate([[0], cut[:-1]]) if len(cut) else cut
    le = cut - (buf[cut - 1] == 10) if len(cut) else cut
    some = (dark[le] - dark[ls]) > 0 if len(cut) else np.zeros(0, bool)
    ls, le = ls[some], le[some]
    lh, lrow = K.hashes(buf, ls, le), K.row_of(ls, off)
    order = np.lexsort((lh, lrow))
    again = np.zeros(len(lh), np.int64)
    if len(lh) > 1:
        a, b = order[1:], order[:-1]
        again[a] = (lh[a] == lh[b]) & (lrow[a] == lrow[b])
    out["n_dup_lines"] = np.bincount(lrow, weights=again, minlength=n).astype(np.int64)[:n]
    return out


def _repeated(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    key = h ^ K.mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def _covered(marked: np.ndarray, at: np.ndarray, window: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    w = at[marked]
    np.add.at(edge, w, 1)
    np.add.at(edge, w + window, -1)
    return (np.cumsum(edge)[:n] > 0).astype(np.int64)


def trusted_ids(labels: DataFrame, most: int) -> list[int]:
    """Ids of the ``most`` labelled good documents with the smallest hashes: a bounded sample by its parameter."""
    clean = F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 0 if "toxic" in labels.columns else F.lit(True)
    good = labels.where("quality = 1 and doc_id is not null").where(clean).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return [r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_features long"


def _verdicts(docs: DataFrame, labels: DataFrame, p: QualityParams):
    """A function of a batch's bytes and offsets: statistics, whether the base rules fail, the ratio, features, whether it is kept."""
    spark = docs.sparkSession
    K.small_batches(spark)
    ratio = spark.sparkContext.broadcast(ratios(*ngram_counts(docs, trusted_ids(labels, p.trusted), p), p))

    def judge(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        st = base_stats(buf, off, p.window)
        mean, count = mean_ratios(buf, off, ratio.value, p)
        failed = (st["n_words"] < p.min_words) | (100 * st["n_repeat_words"] > p.repeat_percent * st["n_words"])
        return st, failed, mean, count, ~failed & (mean >= p.threshold)

    return judge


def score(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """One row per document: base statistics, the length-normalised ratio and the verdict."""
    judge = _verdicts(docs, labels, params or QualityParams())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in K.chunks(batches, "text"):
            st, failed, mean, count, kept = judge(buf, off)
            stats = [pa.array(st[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *stats, pa.array(failed), pa.array(kept), pa.array(mean.astype(np.float64)), pa.array(count.astype(np.int64))], [x.split()[0] for x in RESULT.split(", ")])

    return tables.with_text(docs).mapInArrow(run, RESULT)


def filter_documents(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """The documents that are kept, with all their columns.

    The verdict is taken next to the text in the same pass: rows are not joined back, so repeated
    or null ids need no care.
    """
    judge = _verdicts(docs, labels, params or QualityParams())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in K.chunks(batches, "text"):
            yield part.filter(pa.array(judge(buf, off)[-1]))

    return docs.mapInArrow(run, docs.schema)
