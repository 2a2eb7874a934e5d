"""Files of a tree as rows, whatever their names: Spark's own file sources pass over names that begin with ``_`` or ``.``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "relative_path string, path string, modificationTime timestamp, length long, content binary"
#: Bytes and files of a partition, as far as files are not larger; a file is read whole.
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 1000


def opened(root: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of a path and the path in it, or null if pyarrow knows none."""
    try:
        return fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


class Bundle(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, root: str, names: list[str] | None):
        self.root, self.names = root, None if names is None else set(names)

    def partitions(self) -> list[InputPartition]:
        """Files by size: the listing is made once, on the driver, as that of Spark's sources."""
        system, inner = opened(self.root)
        found, held, size = [], [], 0
        for f in sorted(system.get_file_info(fs.FileSelector(inner, recursive=True)), key=lambda f: f.path):
            if f.type != fs.FileType.File or self.names is not None and f.base_name not in self.names:
                continue
            if held and (size + f.size > PARTITION_BYTES or len(held) >= PARTITION_FILES):
                found.append(Bundle(held))
                held, size = [], 0
            held.append((f.path[len(inner.rstrip("/")) + 1 :], f.path, f.mtime, f.size))
            size += f.size
        return [*found, Bundle(held)] if held or not found else found

    def read(self, partition: Bundle) -> Iterator[tuple]:
        system, _ = opened(self.root)
        for relative, path, mtime, size in partition.files:
            with system.open_input_stream(path) as file:
                yield relative, path, mtime, size, file.read()


class FileTree(DataSource):
    """Options: path; names, a JSON list of the file names that are wanted."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        names = self.options.get("names")
        return TreeReader(self.options["path"], None if names is None else json.loads(names))


def read_tree(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """Every file below ``root`` (SCHEMA), or those by one of ``names``. A root that is not there raises."""
    spark.dataSource.register(FileTree)
    reader = spark.read.format("filetree").option("path", root)
    return (reader if names is None else reader.option("names", json.dumps(names))).load()


def _write(root: str):
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(root)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, text in zip(paths, batch.column("text").to_pylist(), strict=True):
                target = f"{inner.rstrip('/')}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as file:
                    file.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)], pa.int64())], names=["n"])

    return partition


def write_tree(notes: DataFrame, root: str) -> int:
    """Notes (path, text) as files below ``root``, each written whole, so that a task that runs again changes nothing. Returns their number."""
    from pyspark.sql import functions as F

    done = notes.select("path", "text").mapInArrow(_write(root), "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
