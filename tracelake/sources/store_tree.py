"""A data source that lists a folder tree: every file and folder, hidden ones and empty folders too, and the content of files of
one name.

Spark's own file sources pass over names that begin with `.` or `_` and over folders without files; this one lists through
Arrow's file systems (local, HDFS, object stores by URI).  The driver goes down level by level, listing folders only, until
there are enough of them to share out, each partition then walks its folders to the end; what the driver holds are the
names of the folders of the upper levels.

    spark.dataSource.register(StoreTree)
    spark.read.format("store_tree").option("path", root).option("content", "spec.md").load()

Rows: path (relative to the root), is_dir, bytes (null for folders), content (of files with the name asked for, else null).
A root that isn't there has no rows.  Files are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelake.sources.shared import cut

SCHEMA = "path string, is_dir boolean, bytes long, content binary"
#: Folders that the driver lists down to, unless the option `folders` says otherwise; and bytes of a batch of rows.
FOLDERS, BATCH_BYTES = 64, 8 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/") or "/"


def children(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)), key=lambda f: f.path)


class Folders(InputPartition):
    """Folders to walk (whole: with all below) or only to list."""

    def __init__(self, paths: list[str], whole: bool):
        self.paths, self.whole = paths, whole


class StoreTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "store_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], self.options.get("content"), int(self.options.get("folders", FOLDERS)))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, content: str | None, folders: int):
        self.root, self.content, self.folders = root, content, folders

    def partitions(self) -> list[Folders]:
        store, top = opened(self.root)
        if store.get_file_info(top).type != fs.FileType.Directory:
            return []
        level, listed = [top], []
        while 0 < len(level) < self.folders:
            listed += level
            level = [c.path for f in level for c in children(store, f) if c.type == fs.FileType.Directory]
        share = lambda paths, whole: [Folders(p, whole) for k in range(self.folders) if (p := paths[k :: self.folders])]
        return share(listed, False) + share(level, True)

    def read(self, partition: Folders | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where there are none
            return
        yield from listed(self.root, partition.paths, partition.whole, self.content)


def listed(root: str, folders: list[str], whole: bool, content: str | None) -> Iterator[pa.RecordBatch]:
    """SCHEMA of what lies in the folders, and below them if `whole`."""
    store, top = opened(root)
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.binary()]
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "is_dir", "bytes", "content"])

    todo = list(folders)
    while todo:
        for info in children(store, todo.pop()):
            folder = info.type == fs.FileType.Directory
            if folder and whole:
                todo.append(info.path)
            value = None
            if not folder and info.base_name == content:
                with store.open_input_file(info.path) as f:
                    value = f.read()
            rows.append((info.path[len(top) :].lstrip("/"), folder, None if folder else info.size, value))
            size += 200 + len(value or b"")
            if size > BATCH_BYTES:
                yield batch()
                size = 0
    yield batch()


def tree(spark: SparkSession, root: str, content: str | None = None, folders: int = FOLDERS) -> DataFrame:
    """SCHEMA of all below root."""
    spark.dataSource.register(StoreTree)
    of = spark.read.format("store_tree").option("path", root).option("folders", str(folders))
    return (of.option("content", content) if content else of).load()


def by_level(spark: SparkSession, root: str, content: str | None = None, each: int = 500, levels: int = 16) -> DataFrame:
    """SCHEMA of all below root, written: each level of folders is listed by tasks of about `each` folders, so that neither the
    driver nor the task of one wide folder goes through all that lies below.  What is deeper than `levels` is walked whole."""
    store, top = opened(root)
    if store.get_file_info(top).type != fs.FileType.Directory:
        return spark.createDataFrame([], SCHEMA)

    def below(whole: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from listed(root, [f"{top.rstrip('/')}/{p}".rstrip("/") or "/" for p in batch.column(0).to_pylist()], whole, content)

        return of

    folders, out = spark.createDataFrame([("",)], "path string"), None
    for level in range(levels + 1):
        rows = cut(folders.mapInArrow(below(level == levels), SCHEMA))
        out = rows if out is None else out.unionByName(rows)
        folders = rows.where("is_dir").select("path")
        if level == levels or (n := folders.count()) == 0:
            break
        folders = folders.repartition(-(-n // each))
    return out
