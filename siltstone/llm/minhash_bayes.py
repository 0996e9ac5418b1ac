"""Operator 8, MinHash near-duplicates with sequential Bayesian verification.

1. *Sets.* Words (A-Z folded) of the whole text, distinct 5-word shingles as 64-bit hashes; a text
   with fewer words is one shingle. Documents with equal sets (128-bit sum and size) form one class,
   named by its smallest doc_id; copies are never compared again.
2. *Bands.* ``bands`` x ``rows`` min-hashes; a class is a candidate where a band equals another
   class's. Bands that only one class has are dropped by an aggregation before anything wider moves.
3. *Sequential verification.* Signatures (16 bits a hash) are compared batch
   by batch. After each batch of ``batch`` hashes a pair is dropped when the posterior probability
   (uniform prior, so Beta(m + 1, n - m + 1)) of a similarity of at least the threshold is below ``miss``.
4. *Exact verification* of what is left, on full sets with integers, ``100 * common >= percent * union``.
5. Components of the confirmed links by large-star/small-star.

Candidates are taken in two turns. First each class is compared with one centre only, the smallest class of
most of its buckets: a dense group of copies with edits costs as many comparisons as it has members, and is one
component afterwards. Then the buckets that still hold several components are compared across
components; their survivors leave a bucket as a spanning forest, never as all pairs, forests are joined to clusters, and
inside a cluster pairs of different components that pass the sequential test are verified. Large
buckets and clusters are cut into blocks, a task each: members of the largest component stay in their block,
which all others visit. Work on a group is so its size times what is outside its largest component.

Chance of missing a link of similarity s: banding ``(1 - s**rows) ** bands`` (about 1e-6 at 0.85 with
5 x 24) plus ``miss`` for the sequential test. Nothing is capped or sampled.

Defined results: null or empty text has an empty set and is linked with nothing; repeated rows with one
doc_id give one row each and are one document when their texts agree (an id with differing texts is compared
by one of them, and its rows share one component); a null doc_id gives a row without a component, and is kept;
other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.components import components
from siltstone.llm.tables import key_bitmap, may_hold, parts, rows_by_bitmap, stored, with_text


@dataclass(frozen=True)
class NearParams:
    percent: int = 85
    shingle: int = 5
    bands: int = 24
    rows: int = 5
    batch: int = 24
    miss: float = 1e-7
    block: int = 512


def fewest_matches(p: NearParams) -> list[tuple[int, int]]:
    """For each batch end n, the fewest matching hashes with which a pair goes on.

    P(J >= t | m of n) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    out, t = [], p.percent / 100
    for n in range(p.batch, p.bands * p.rows + 1, p.batch):
        total, m = 0.0, -1
        while total < p.miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = K.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:n] | np.uint64(1), seed[n:]


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    s, e, first = K.words(buf, off)
    h = K.hashes(buf, s, e, fold=True)
    w, at = K.windows(h, first, size)
    cut = np.searchsorted(at, first)
    out = []
    for i in range(len(off) - 1):
        n = first[i + 1] - first[i]
        if n >= size:
            out.append(np.unique(w[cut[i] : cut[i + 1]]))
        elif n:
            out.append(K.windows(h[first[i] : first[i + 1]], np.array([0, n]), int(n))[0] ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Min-hashes, one row for each non-empty set: the upper 32 bits of a * x + b."""
    a, b = _coefficients(n)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])]) if sets else np.zeros(0, np.int64)
    out = np.empty((len(sets), n), np.uint32)
    for k in range(n if len(sets) else 0):
        out[:, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


DOCS = "doc_id long, n_shingles long, f1 long, f2 long"


def fingerprints(docs: DataFrame, p: NearParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in K.chunks(batches, "text"):
            sets = shingle_sets(buf, off, p.shingle)
            f1 = np.array([K.mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
            f2 = np.array([K.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64)
            cols = [part.column(part.schema.get_field_index("doc_id")), pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(K.signed(f1)), pa.array(K.signed(f2))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "f1", "f2"])

    return docs.mapInArrow(run, DOCS)


def signed_rows(docs: DataFrame, p: NearParams) -> DataFrame:
    """(rep, keys, sig) of each row of docs with a set: band keys and the 16-bit signature."""
    n = p.bands * p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in K.chunks(batches, "text"):
            sets = shingle_sets(buf, off, p.shingle)
            some = np.array([len(x) > 0 for x in sets], bool)
            sig = signatures([x for x in sets if len(x)], n)
            keys = np.empty((len(sig), p.bands), np.uint64)
            for k in range(p.bands):
                acc = np.full(len(sig), k + 1, np.uint64)
                for j in range(p.rows):
                    acc = K.mix(acc + sig[:, k * p.rows + j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keys[:, k] = acc
            ids = part.column(part.schema.get_field_index("doc_id")).filter(pa.array(some))
            short = (sig ^ (sig >> np.uint32(16))).astype(np.uint16)
            band = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, p.bands, dtype=np.int32)), pa.array(K.signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays([ids, band, pa.array([x.tobytes() for x in short], pa.binary())], ["rep", "keys", "sig"])

    return docs.mapInArrow(run, "rep long, keys array<long>, sig binary")


class Forest:
    """Union-find over a task's own rows."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = nxt
                return nxt
            up = nxt


def survivors(one: np.ndarray, many: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Rows of ``many`` that the sequential test leaves for ``one``."""
    left, done, matches = np.arange(len(many)), 0, np.zeros(len(many), np.int32)
    for n, least in steps:
        matches = matches + (many[left, done:n] == one[done:n]).sum(axis=1, dtype=np.int32)
        ok = matches >= least
        left, matches, done = left[ok], matches[ok], n
        if not len(left):
            break
    return left


def passing(one: np.ndarray, two: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs (rows of ``one`` and ``two``) that the sequential test leaves."""
    left, done, matches = np.arange(len(one)), 0, np.zeros(len(one), np.int32)
    for n, least in steps:
        matches = matches + (one[left, done:n] == two[left, done:n]).sum(axis=1, dtype=np.int32)
        ok = matches >= least
        left, matches, done = left[ok], matches[ok], n
    return left


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity, by their members."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


# What a row is in a task: of the group's largest component, at home; another at home; one from an earlier, from a later block.
MAJOR, HOME, EARLIER, LATER = range(4)


def _link(ids: np.ndarray, sig: np.ndarray, side: np.ndarray, comp: np.ndarray, steps: list[tuple[int, int]], exact=None) -> list[tuple[int, int]]:
    """A spanning forest, over the given components, of the pairs that pass."""
    order = np.lexsort((ids, side))
    ids, sig, side, comp = ids[order], sig[order], side[order], comp[order]
    forest, out = Forest(len(ids)), []
    _, first, inverse = np.unique(comp, return_index=True, return_inverse=True)
    forest.up = first[inverse]
    home = int(np.searchsorted(side, EARLIER))
    major = int(np.searchsorted(side, HOME))
    for i in range(major, len(ids)):
        most = i if i < home else home if side[i] == EARLIER else major
        roots = forest.roots()
        other = np.flatnonzero(roots[:most] != roots[i])
        for k in other[survivors(sig[i], sig[other], steps)] if len(other) else ():
            a, b = forest.root(i), forest.root(int(k))
            if a != b and (exact is None or exact(order[i], order[k])):
                forest.up[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[k])))
    return out


def in_blocks(rows: DataFrame, key: str, p: NearParams) -> DataFrame:
    """The rows (rep, comp) of groups with several components, with their ``task`` (block) and ``side``.

    A group of up to ``block`` rows is one task. In a larger one, rows of its largest component are in their own
    block's task only, all others in each block's. Sizes come from partial aggregations.
    """
    sizes = rows.groupBy(key, "comp").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n_group"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("n_comp"))
    r = rows.join(sizes.where("n_comp > 1"), key).withColumn("g", F.ceil(F.col("n_group") / p.block).cast("int"))
    r = r.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("g").cast("long")).cast("int")).withColumn("major", F.col("comp") == F.col("most.comp"))
    r = r.withColumn("task", F.explode(F.when(F.col("major"), F.array("b")).otherwise(F.sequence(F.lit(0), F.col("g") - 1))))
    side = F.when(F.col("major"), MAJOR).when(F.col("b") == F.col("task"), HOME).when(F.col("b") < F.col("task"), EARLIER).otherwise(LATER)
    return r.select(*rows.columns, "task", side.alias("side"))


def _in_bins(rows: DataFrame, key: str, p: NearParams) -> DataFrame:
    """Adds ``bin``: tasks of ``in_blocks`` dealt by hash into bins of about ``2 * block`` rows, so that small
    groups share one call of the Python function."""
    rows = stored(rows, "tasks")
    bins = parts(rows.sparkSession, rows.count(), 2 * p.block)
    return rows.withColumn("bin", F.pmod(F.xxhash64(key, "task"), F.lit(bins).cast("long")))


def _each(t: pa.Table, key: str, link) -> pa.Table:
    """``link`` applied to the rows of each task."""
    k, task = t.column(key).to_numpy(), t.column("task").to_numpy()
    order = np.lexsort((task, k))
    new = (np.diff(k[order]) != 0) | (np.diff(task[order]) != 0)
    out: list[tuple[int, int]] = []
    for at in np.split(order, np.flatnonzero(new) + 1):
        if len(at) > 1:
            out += link(at)
    return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    return _matrix(t.column("sig").to_pylist()), *(t.column(c).to_numpy() for c in ("rep", "side", "comp"))


def full_sets(d: DataFrame, wanted: DataFrame, p: NearParams) -> DataFrame:
    """(rep, shingles) of the wanted ids; texts that surely are not wanted are passed over by a bitmap."""
    bitmap = key_bitmap(wanted.select(F.xxhash64("rep").alias("key")), "key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(may_hold(bitmap.value, b.column(2).to_numpy(zero_copy_only=False)))) for b in batches)
        for part, buf, off in K.chunks(some, "text"):
            got = shingle_sets(buf, off, p.shingle)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array([x.tobytes() for x in got], pa.binary())], ["rep", "shingles"])

    full = d.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id")).mapInArrow(sets, "rep long, shingles binary")
    return full.join(wanted.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])


def with_centres(pairs: DataFrame, sigs: DataFrame, d: DataFrame, p: NearParams, steps: list[tuple[int, int]]) -> DataFrame:
    """(u, v): confirmed links between classes and the centre of most of their buckets. pairs: band, rep, centre."""
    votes = pairs.where("rep <> centre").groupBy("rep", "centre").agg(F.count("*").alias("n"))
    star = votes.groupBy("rep").agg(F.max(F.struct("n", (-F.col("centre")).alias("c"))).alias("b")).select("rep", (-F.col("b.c")).alias("centre"))
    both = star.join(sigs, "rep").join(sigs.select(F.col("rep").alias("centre"), F.col("sig").alias("sig_c")), "centre")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = passing(_matrix(b.column("sig").to_pylist()), _matrix(b.column("sig_c").to_pylist()), steps) if b.num_rows else []
            yield b.select(["rep", "centre"]).take(pa.array(at, pa.int64()))

    left = stored(both.mapInArrow(test, "rep long, centre long"), "star")
    sets = stored(full_sets(d, left.select("rep").unionByName(left.select(F.col("centre").alias("rep"))).distinct(), p), "star-sets")
    both = left.join(sets, "rep").join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("shingles_c")), "centre")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = zip(b.column("shingles"), b.column("shingles_c"), strict=True)
            ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), p.percent) for x, y in two]
            yield pa.RecordBatch.from_arrays(b.select(["rep", "centre"]).filter(pa.array(ok, pa.bool_())).columns, ["u", "v"])

    return stored(both.mapInArrow(confirm, "u long, v long"), "star-links")


def near_classes(docs: DataFrame, params: NearParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    p = params or NearParams()
    K.small_batches(docs.sparkSession)
    steps = fewest_matches(p)
    d = with_text(docs)
    prints = stored(fingerprints(d, p), "prints")
    key = ["f1", "f2", "n_shingles"]
    classes = prints.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    member = stored(prints.join(classes, key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")

    # One signature for each class: that of the row whose id is the class's own. (A repeated id may bring its rows twice: harmless.)
    own_id = member.where("n_shingles > 0 and doc_id = rep").select("rep").distinct()
    signs = stored(signed_rows(d, p).join(own_id, "rep", "left_semi"), "signatures")
    bands = signs.select("rep", F.explode("keys").alias("band")).distinct()
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("centre")).where("n > 1").drop("n")
    pairs = stored(bands.join(shared, "band"), "bands")
    sigs = stored(signs.select("rep", "sig").join(pairs.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"]), "active")
    star = with_centres(pairs, sigs, d, p, steps)

    # Buckets that still hold several components.
    known = stored(components(star).select(F.col("node").alias("rep"), F.col("component").alias("comp")), "components")
    placed = pairs.select("band", "rep").join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    rest = _in_bins(in_blocks(placed, "band", p), "band", p)

    def compare(t: pa.Table) -> pa.Table:
        sig, rep, side, comp = _columns(t)
        return _each(t, "band", lambda at: _link(rep[at], sig[at], side[at], comp[at], steps))

    likely = rest.join(sigs, "rep").groupBy("bin").applyInArrow(compare, "u long, v long")
    # Clusters of components; of each component the classes that such a bucket holds.
    own = rest.select("rep", "comp").distinct()
    ends = likely.join(own.select(F.col("rep").alias("u"), F.col("comp").alias("a")), "u").join(own.select(F.col("rep").alias("v"), F.col("comp").alias("b")), "v")
    clusters = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
    inside = stored(own.join(clusters, "comp").select("rep", "comp", "cluster"), "clusters")
    sets = full_sets(d, inside, p)

    def confirm(t: pa.Table) -> pa.Table:
        sig, rep, side, comp = _columns(t)
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        return _each(t, "cluster", lambda at: _link(rep[at], sig[at], side[at], comp[at], steps, lambda i, k: alike(full[at[i]], full[at[k]], p.percent)))

    links = _in_bins(in_blocks(inside, "cluster", p), "cluster", p).join(sigs, "rep").join(sets, "rep").groupBy("bin").applyInArrow(confirm, "u long, v long")
    # A repeated id with differing texts belongs to several classes: its classes are linked through it.
    other = member.where("rep <> doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    twice = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("u"))
    done = components(known.select(F.col("rep").alias("u"), F.col("comp").alias("v")).unionByName(links).unionByName(other.join(twice, "u", "left_semi")))
    out = member.join(done.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, params: NearParams | None = None) -> DataFrame:
    """The documents whose doc_id names their component, with all their columns; one row for each doc_id.

    Only rows that may have to go move (told by a bitmap of fixed size): those of dropped ids and of ids with
    several rows. Rows with a null doc_id stay.
    """
    classes = stored(near_classes(docs, params), "classes")
    gone = classes.where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    twice = classes.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    bitmap = key_bitmap(gone.select(F.xxhash64("gone").alias("key")).unionByName(twice.select(F.xxhash64("doc_id").alias("key"))), "key")
    fields = [F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long")).alias("key"))
    named = rows.where("id is not null")
    some = rows_by_bitmap(named, "key", bitmap, True)
    some = some.join(gone, some["id"] == gone["gone"], "left_anti").dropDuplicates(["id"])
    return some.select(*fields).unionByName(rows_by_bitmap(named, "key", bitmap, False).select(*fields)).unionByName(rows.where("id is null").select(*fields))
