"""Word-processor files as a data source of Spark: one relation of them, in a batch or as they arrive.

    spark.dataSource.register(DocxSource)
    spark.read.format("docx").option("relation", "runs").load("/data/theses")
    spark.readStream.format("docx").option("relation", "blocks").load("/data/inbox")

A partition is a group of files of about `group_bytes`; of each file only the parts are parsed which the relation needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from vellum.sources.docx import SCHEMAS, parsed

GROUP_BYTES = 32 << 20
SEED = 42  # of the hash that Spark's xxhash64() is


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def filesystem(path: str):
    """The file system of a path and the path in it, with what makes its names those that Spark gives to files."""
    from pyarrow import fs

    if "://" not in path:
        local = "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path
        return fs.LocalFileSystem(), local, "file:"
    system, at = fs.FileSystem.from_uri(path)
    return system, at, "file:" if isinstance(system, fs.LocalFileSystem) else path.split("://")[0] + "://"


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of the word-processor files at or below a path, oldest first."""
    from pyarrow import fs

    system, at, _ = filesystem(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".docx"))


def groups(files: list[tuple[int, str, int]], size: int) -> list[Files]:
    out: list[Files] = []
    held = size
    for _, path, n in files:
        if held >= size:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += max(n, 1)
    return out


class Reading:
    """What a batch and a stream share: options, and the rows of a group of files."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.relation = [f.name for f in schema.fields], options.get("relation", "blocks")
        self.path, self.size = options["path"], int(options.get("group_bytes", GROUP_BYTES))

    def read(self, partition: Files) -> Iterator[tuple]:
        import xxhash

        system, _, prefix = filesystem(self.path)
        for at in partition.paths:
            with system.open_input_file(at) as f:
                content = f.read()
            path = prefix + at
            number = xxhash.xxh64_intdigest(path.encode(), SEED)
            known = {"doc_id": number - (1 << 64) * (number >> 63), "path": path, "sha256": hashlib.sha256(content).hexdigest()}
            try:
                rows = [row for kind, row in parsed(content, {self.relation}) if kind == self.relation]
            except Exception as e:  # an odd file is a row of errors, not the job's end
                rows = [{"message": f"{type(e).__name__}: {e}"}] if self.relation == "errors" else []
            for row in rows:
                row = known | row
                yield tuple(row.get(c) for c in self.columns)


class BatchReader(Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return groups(listed(self.path), self.size)


class StreamReader(Reading, DataSourceStreamReader):
    """Files by the time of their change, each once; the offset is the last file's time and path."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        inside = [f for f in listed(self.path) if (start["time"], start["path"]) < f[:2] <= (end["time"], end["path"])]
        return groups(inside, self.size)

    def commit(self, end: dict) -> None:
        return


class DocxSource(DataSource):
    """Options: path, relation (one of vellum.sources.docx.SCHEMAS, `blocks` by default) and group_bytes."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        relation = self.options.get("relation", "blocks")
        if relation not in SCHEMAS:
            raise ValueError(f"no relation {relation}; there are {', '.join(SCHEMAS)}")
        return f"doc_id long, path string, sha256 string, {SCHEMAS[relation]}"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(schema, dict(self.options))
