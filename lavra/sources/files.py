"""A folder tree of files as a Spark data source: every file is a row, those of no bytes too.

The driver lists names and sizes, once and each file once, and plans partitions by size; contents are read by the
tasks. Any file system that pyarrow knows by its address works (plain paths, file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "lavra_files"
SCHEMA = "doc_id long, path string, suffix string, size long, content binary, error string"
PART_BYTES, PART_FILES, BATCH_BYTES, OPEN_COST = 64 << 20, 5_000, 8 << 20, 64 << 10
NAMES = ["doc_id", "path", "suffix", "size", "content", "error"]


def file_id(path: str) -> int:
    """The hash that ``xxhash64`` gives of the path in Spark."""
    return int.from_bytes(xxhash.xxh64(path.encode(), seed=42).digest(), "big", signed=True)


def listed(paths: list[str]) -> list[tuple[str, int]]:
    """(address, size) of all files at and below the paths, in order, each once. A path that doesn't exist is an error."""
    out: dict[str, int] = {}
    for path in paths:
        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        scheme = path.split("://")[0] + "://" if "://" in path else ""
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        local = isinstance(system, fs.LocalFileSystem)
        out |= {(f.path if local else scheme + f.path): f.size for f in found if f.is_file}
    return sorted(out.items())


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int, bool]]  # address, size, whether another file has its id


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[Part]:
        files = listed(self.paths)[: self.limit]
        ids = Counter(file_id(p) for p, _ in files)
        parts, room = [Part([])], PART_BYTES
        for path, size in files:
            room -= size + OPEN_COST
            if (room < 0 or len(parts[-1].files) >= PART_FILES) and parts[-1].files:
                parts.append(Part([]))
                room = PART_BYTES - size - OPEN_COST
            parts[-1].files.append((path, size, ids[file_id(path)] > 1))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, size, twice in partition.files:
            suffix = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
            content, error = None, "another file has the same id" if twice else None
            if error is None:
                try:
                    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                    with system.open_input_stream(name) as f:
                        content = f.read()
                except Exception as problem:  # one file that can't be read is an outcome of its own
                    error = f"{type(problem).__name__}: {problem}"
            rows.append((file_id(path), path, suffix, size, content, error))
            held += size
            if held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def read_files(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """doc_id, path, suffix, size, content, error of every file below the paths, once each; with ``limit``, the first in path order."""
    spark.dataSource.register(Files)
    reader = spark.read.format(FORMAT).option("paths", json.dumps(list(paths)))
    return (reader if limit is None else reader.option("limit", str(limit))).load()
