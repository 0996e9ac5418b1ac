"""A sink that makes one document of a sorted table: ``df.write.format("siltstone_report")``.

Every task writes the entries of its part to a file of its own and sends back a short message: the file's name and counts of what is
in it. When all are there the driver writes the document - head, the parts in order as streams of bytes, tail - under a
name of its own and moves it into place. Totals come from the messages; no finding is ever in the driver's memory. Files of
tasks that failed or ran twice are in no message and are deleted with the parts.

Options: ``path`` of the document; ``kind``: json, text or baseline; ``counters``, JSON of the run's counters.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from siltstone.plans import layout

CHUNK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    counts: dict[str, dict[str, int]] = field(default_factory=dict)


def where(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "json")
        self.counters = json.loads(options.get("counters", "{}"))
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, folder = where(self.parts)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        form, n, counts = layout.FORMS[self.kind], 0, {c: Counter() for c in ("severity", "confidence")}
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                r = row.asDict()
                out.write(((form.between if n else "") + form.entry(r)).encode())
                n += 1
                for c, k in counts.items():
                    if c in r:
                        k[r[c]] += 1
        return Written(name, n, {c: dict(k) for c, k in counts.items()})

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = where(self.parts)
        _, path = where(self.path)
        done = [m for m in messages if m is not None and m.rows]
        total = sum(m.rows for m in done)
        counts = {c: sum((Counter(m.counts.get(c, {})) for m in done), Counter()) for c in ("severity", "confidence")}
        form = layout.FORMS[self.kind]
        new = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as out:
            out.write(form.head(total, counts, self.counters).encode())
            for k, m in enumerate(done):
                if k:
                    out.write(form.between.encode())
                with system.open_input_stream(f"{folder}/{m.name}") as part:
                    while block := part.read(CHUNK):
                        out.write(block)
            out.write(form.tail(total, counts, self.counters).encode())
        system.move(new, path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = where(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_report"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(dict(self.options))
