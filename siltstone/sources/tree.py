"""A Spark data source for source trees: ``spark.read.format("siltstone_tree")``.

Spark's own file readers pass over names that begin with an underscore, ``__init__.py`` among them. Here a *listing* says
what to read: a folder of Parquet with (path, package, locked), made on executors by ``sources.listing``. Each part-file of
it is a partition of the source; the driver sees the names of the parts, never the paths in them.

Options: ``listing``, that folder; ``workspace``, a prefix to cut from reported names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.text import valid_text
from siltstone.operators import post
from siltstone.operators.manifest_rules import PIN_MANIFESTS
from siltstone.sources import discovery, listing

RAW = "path string, package string, file string, locked boolean, content binary"
_RAW = pa.schema([("path", pa.string()), ("package", pa.string()), ("file", pa.string()), ("locked", pa.bool_()), ("content", pa.binary())])
#: Contents in a batch, in bytes.
BATCH = 4 << 20
PARTITION_BYTES = 16 << 20


class Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _where(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = options["listing"]
        self.workspace = options.get("workspace") or None

    def partitions(self) -> list[InputPartition]:
        system, folder = _where(self.listing)
        found = system.get_file_info(fs.FileSelector(folder))
        return [Part(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _where(self.listing)
        root = Path(self.workspace) if self.workspace else None
        rows, held = [], 0
        with system.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(4096, columns=["path", "package", "locked"]):
                for r in batch.to_pylist():
                    try:
                        content = Path(r["path"]).read_bytes()
                    except OSError:
                        content = None
                    rows.append((r["path"], r["package"], discovery.relative(r["path"], root), r["locked"], content))
                    held += len(content or b"")
                    if held >= BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RAW.types, strict=True)], schema=_RAW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_tree"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def as_files(raw: DataFrame) -> DataFrame:
    """``schema.FILES`` of rows with path, package, file, locked and content."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(F.expr("instr(substring(element_at(split(path, '/'), -1), 2), '.') > 0"), F.substring_index(name, ".", -1)).otherwise("")
    return raw.select("path", F.split("path", "/").alias("path_key"), "file", "package", name.alias("name"), ext.alias("ext"), valid_text(F.col("content")).alias("text"), "locked")


def tree_files(spark: SparkSession, packages: dict[str, str], loose: str | None = None, exclude: tuple[str, ...] = (), workspace: Path | None = None) -> DataFrame:
    """(path, package, locked, size) of all files of a run: the packages' sources and the manifests above them."""
    ceiling = str(workspace) if workspace else None
    sources = listing.list_files(spark, packages, loose, exclude)
    roots = spark.createDataFrame([(n, os.path.normpath(p)) for n, p in packages.items()], "package string, root string")
    names = listing.written(listing.names_in(listing.chains(roots, ceiling)), "names")
    manifests = listing.nearest_manifests(roots, names, ceiling)
    claimed = listing.first_claims(sources, manifests).join(sources.groupBy("path").agg(F.max("size").alias("size")), "path", "left")
    named = claimed.withColumn("name", F.element_at(F.split("path", "/"), -1))
    locked = post.with_locks(named, names)
    return locked.select("path", "package", (F.col("name").isin(*PIN_MANIFESTS) & F.col("locked")).alias("locked"), F.coalesce("size", F.lit(0)).alias("size"))


def read_tree(spark: SparkSession, files: dict[str, str] | DataFrame, workspace: Path | None = None) -> DataFrame:
    """``schema.FILES`` of the files in a listing: ``tree_files``, or path to package for a few."""
    spark.dataSource.register(TreeSource)
    if isinstance(files, dict):
        rows = [(p, n, os.path.basename(p) in PIN_MANIFESTS and discovery.locked(p), os.path.getsize(p) if os.path.exists(p) else 0) for p, n in files.items()]
        files = spark.createDataFrame(rows, "path string, package string, locked boolean, size bigint")
    total = files.agg(F.sum(F.col("size") + 4096)).first()[0] or 0
    folder = listing.new_folder(spark, "tree")
    files.repartition(max(1, -(-total // PARTITION_BYTES)), "path").write.parquet(folder)
    return as_files(spark.read.format("siltstone_tree").option("listing", folder).option("workspace", str(workspace or "")).load())
