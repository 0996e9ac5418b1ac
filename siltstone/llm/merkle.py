"""Operator 12, a Merkle manifest of a dataset as a persistent tree with path copying.

A document's leaf is the hash of its five columns. Leaves ascend by doc_id within their source and every ``ARITY``
neighbours become their hash until one node is left, the source's subroot; subroots, by source, become the root in the same way.

The tree is built in aligned blocks of ARITY^``height`` nodes (2187), which no run of ``ARITY`` crosses at any level below the
block's own root:

1. leaves are made in one pass over the texts and written (some 100 bytes a row: texts do not move), range-partitioned by
   source and doc_id, and numbered within their source by partition counts, so a source with most of the rows is
   spread like any other;
2. each block of leaves gives its root; the roots of a source's blocks are the leaves of the next storey, and so on, each
   storey a block's size smaller, then the sources likewise. A storey's blocks give each of their nodes its *path*: for each
   level the nodes of its run before and after it. Paths are joined downwards, one row for each block of leaves;
3. a block of leaves meets its one path (a co-group by source and block) and is gone through once more. Every tampered leaf
   makes a *version* of the tree: it shares all nodes that are not above it and copies only its ancestors, first those
   within its block, then, along the block's path, those of the storeys above. The last copy is the version's root. A
   version is thus finished where its leaf is; no task sees the versions of more than one block.

``versions`` returns the copied nodes themselves (from the leaf's parent up to the root).

Defined results: a null column is hashed as ``-``; null source is a source of its own, before all others; rows with equal
source and doc_id stand next to each other, ordered by their leaves, and a null doc_id stands before all others; it is never
tampered with in the report; other columns are left behind; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.tables import stored

ARITY = 3
#: Levels of a block.
HEIGHT = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Hashes = list[bytes]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row of documents, of 32 bytes; with another text if one is given."""
    values = [text if c == "text" and text is not None else F.col(c) for c in COLUMNS]
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def without_line_ends() -> Column:
    """The report's tampering: the text of the rows it takes, without its line ends; null for the rest."""
    taken = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(taken, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))


def leaves(docs: DataFrame, tampered: Column | None = None, taken: Column | None = None) -> DataFrame:
    """grp, source, doc_id, leaf, changed, seq: ``changed`` is the leaf with ``tampered`` as its text, where ``taken``."""
    changed = F.lit(None).cast("binary") if tampered is None else F.when(F.lit(True) if taken is None else taken, leaf(tampered))
    d = docs.select(*[F.col(c).cast({"doc_id": "long", "n_chars": "long"}.get(c, "string")).alias(c) for c in COLUMNS])
    grp = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))  # never null, in the order of sources
    return d.select(grp.alias("grp"), "source", "doc_id", leaf().alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("seq"))


def numbered(rows: DataFrame, order: list[Column], what: str) -> DataFrame:
    """``rows`` with ``pos``, the place within ``grp`` by ``order`` (from 0), and ``total``, the rows of ``grp``."""
    by = [F.col("grp").asc(), *order]
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches):
        part, last, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(b.schema.get_field_index("grp"))
            code = codes.dictionary_encode().indices.to_numpy()
            start = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
            size = np.diff(np.append(start, len(code)))
            base = np.zeros(len(start), np.int64)
            base[0] = k if last is not None and last == codes[0].as_py() else 0
            at = np.arange(len(code)) - np.repeat(start, size) + np.repeat(base, size)
            last, k = codes[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(code), part, np.int64)), pa.array(at)], [*b.schema.names, "part", "k"])

    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, f"{schema}, part bigint, k bigint")
    ranged = stored(ranged, what)
    runs = ranged.groupBy("grp", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("grp", "part", F.coalesce(before, F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total"))
    return ranged.join(runs, ["grp", "part"]).withColumn("pos", F.col("base") + F.col("k")).drop("part", "k", "base")


def joined(nodes: Hashes) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def levels(nodes: Hashes, total: int, height: int) -> list[Hashes]:
    """The levels of a block: ``nodes``, then their hashes, up to one; where the block is one of several, since its group has
    more nodes in all, always ``height`` storeys, since nodes remain beside it."""
    out, several = [nodes], total > ARITY**height
    while (len(out) <= height) if several else len(out[-1]) > 1:
        last = out[-1]
        out.append([joined(last[k : k + ARITY]) for k in range(0, len(last), ARITY)])
    return out


def beside(tree: list[Hashes], k: int) -> list[tuple[bytes, bytes]]:
    """For each level of a block, what stands before and after the node above leaf ``k`` in its run."""
    out = []
    for level in tree[:-1]:
        first = k - k % ARITY
        out.append((b"".join(level[first:k]), b"".join(level[k + 1 : first + ARITY])))
        k //= ARITY
    return out


def _hex(column: pa.Array | pa.ChunkedArray) -> Hashes:
    return [x.hex().encode() for x in column.to_pylist()]


def _raw(text: bytes) -> bytes:
    return bytes.fromhex(text.decode())


def _block_root(height: int):
    size = ARITY**height

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        total = t.column("total")[0].as_py()
        top = levels(_hex(t.column("node")), total, height)[-1][0]
        return pa.table({"grp": t.column("grp").slice(0, 1), "pos": pa.array([t.column("pos")[0].as_py() // size]), "total": pa.array([-(-total // size)]), "node": pa.array([_raw(top)])})

    return run


PATH = "array<struct<before:binary,after:binary>>"
NODES = "grp string, pos bigint, total bigint, node binary"


def _block_paths(height: int):
    size = ARITY**height
    path_type = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        total, pos = t.column("total")[0].as_py(), t.column("pos").to_pylist()
        tree = levels(_hex(t.column("node")), total, height)
        paths = [[{"before": _raw(a), "after": _raw(z)} for a, z in beside(tree, k)] for k in range(len(pos))]
        n = len(pos)
        return pa.table({"grp": t.column("grp"), "pos": t.column("pos"), "up": pa.array([x // size for x in pos]), "upper": pa.array([-(-total // size)] * n), "path": pa.array(paths, path_type), "node": pa.array([_raw(tree[-1][0])] * n)})

    return run


def climbed(nodes: DataFrame, what: str, height: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (NODES, one row a node) up to one node for each grp: its rows (grp, node), and (grp, pos, path, node) of
    the nodes that began, ``node`` being the grp's last one."""
    block = F.expr(f"pos div {ARITY**height}").alias("up")
    storeys, here = [], nodes
    while here.where("total > 1").limit(1).count():
        done = stored(here.where("total > 1").groupBy("grp", block).applyInArrow(_block_paths(height), f"grp string, pos bigint, up bigint, upper bigint, path {PATH}, node binary"), what)
        storeys.append(done)
        here = done.where(f"pos % {ARITY**height} = 0").select("grp", F.col("up").alias("pos"), F.col("upper").alias("total"), "node").unionByName(here.where("total = 1"))
    tops = here.select("grp", "node")
    none = F.array().cast(PATH)
    if not storeys:
        return tops, nodes.select("grp", "pos", none.alias("path"), "node")
    whole = None
    for storey in reversed(storeys):
        if whole is None:
            whole = storey.select("grp", "pos", "path")
        else:
            above = whole.select("grp", F.col("pos").alias("up"), F.col("path").alias("rest"))
            whole = storey.join(above, ["grp", "up"], "left").select("grp", "pos", F.concat("path", F.coalesce("rest", none)).alias("path"))
    paths = nodes.select("grp", "pos").join(whole, ["grp", "pos"], "left").join(tops, "grp").select("grp", "pos", F.coalesce("path", none).alias("path"), "node")
    return tops, paths


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """From numbered leaves, one row for each block of them: grp, block, path (to the root), subroot, root."""
    block = F.expr(f"pos div {ARITY**height}").alias("up")
    base = rows.select("grp", "pos", "total", F.col("leaf").alias("node"))
    roots = stored(base.groupBy("grp", block).applyInArrow(_block_root(height), NODES), "blocks")
    subroots, own = climbed(roots, "storeys", height)
    # the sources are the leaves of the last tree: one group of them all
    sources = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node"), [F.col("of").asc()], "sources")
    sources = stored(sources, "subroots")
    tops, above = climbed(stored(sources.groupBy("grp", block).applyInArrow(_block_root(height), NODES), "tops"), "tops", height)
    low = sources.groupBy("grp", block).applyInArrow(_block_paths(height), f"grp string, pos bigint, up bigint, upper bigint, path {PATH}, node binary")
    last = low.select("pos", "up", "path").join(above.select(F.col("pos").alias("up"), F.col("path").alias("rest"), F.col("node").alias("root")), "up")
    last = sources.select("of", "pos", F.col("node").alias("subroot")).join(last, "pos").select(F.col("of").alias("grp"), "subroot", "root", F.concat("path", "rest").alias("rest"))
    return stored(own.select("grp", F.col("pos").alias("up"), "path").join(last, "grp").select("grp", "up", F.concat("path", "rest").alias("path"), "subroot", "root"), "manifest")


VERSION = "source string, doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"


def _versions(keep: bool, height: int):
    def run(rows: pa.Table, paths: pa.Table) -> pa.Table:
        t = rows.sort_by("pos")
        if not t.num_rows:
            return pa.table({n: pa.array([], y) for n, y in OUT.items()})
        path = [(x["before"].hex().encode(), x["after"].hex().encode()) for x in paths.column("path")[0].as_py()]
        subroot, root = (paths.column(c)[0].as_py().hex() for c in ("subroot", "root"))
        tail = b"".join(a + z for a, z in path)
        nodes = _hex(t.column("leaf"))
        tree = levels(nodes, t.column("total")[0].as_py(), height)
        proofs, folded, copies = [], [], []
        for k, changed in enumerate(t.column("changed").to_pylist()):
            own = beside(tree, k)
            proofs.append(sha256(b"".join(a + z for a, z in own) + tail).hexdigest())
            node = nodes[k] if changed is None else changed.hex().encode()
            new, copied = node != nodes[k], []
            for before, after in (*own, *path):
                node = sha256(before + node + after).hexdigest().encode()
                copied.append(node.decode())
            folded.append(node.decode())
            copies.append((copied if new else []) if keep else None)  # a version without a new leaf is the tree itself
        n = t.num_rows
        text = lambda v: pa.array([v] * n, pa.string())
        return pa.table({"source": t.column("source"), "doc_id": t.column("doc_id"), "leaf": pa.array([x.decode() for x in nodes]), "subroot": text(subroot), "root": text(root), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded]), "copied": pa.array(copies, pa.list_(pa.string()))})

    return run


OUT = {"source": pa.string(), "doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_(), "copied": pa.list_(pa.string())}


def versions(docs: DataFrame, tampered: Column | None = None, taken: Column | None = None, keep_copies: bool = True, height: int = HEIGHT) -> DataFrame:
    """One row for each document (VERSION): leaf, proof and roots of the tree of ``docs``; and, where ``taken``, the root of
    the version in which its text is ``tampered``, with the nodes copied for it from the leaf's parent to the root."""
    K.small_batches(docs.sparkSession)
    made = stored(leaves(docs, tampered, taken), "leaves")
    rows = numbered(made, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("seq").asc()], "ranged")
    rows = stored(rows.withColumn("up", F.expr(f"pos div {ARITY**height}")).drop("seq"), "numbered")
    blocks = manifest(rows, height)
    return rows.groupBy("grp", "up").cogroup(blocks.groupBy("grp", "up")).applyInArrow(_versions(keep_copies, height), VERSION)


def tamper_report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: with the tampering of ``without_line_ends``."""
    text = without_line_ends()
    done = versions(docs, text, text.isNotNull(), keep_copies=False, height=height)
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
