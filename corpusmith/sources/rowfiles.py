"""A file for each row, as a Spark data source: written so that a repeated task leaves nothing half or double, and read by an index instead of listing folders.

Every attempt of a task writes into a folder of its own, its files first and then an index of them (label, id, name, size, checksum). When all tasks are done, the driver puts one small file
in place that names the attempts that count, a line a task; whatever else lies there was never written as far as a reader can tell, and goes when the job is given up. A read is
planned from these lines: a partition for each attempt, whose index names the files, so no folder is listed and a file that isn't whole is an error.

Any store will do that pyarrow opens by its URI, from driver and executors alike.

    register(spark)
    df.write.format("corpusmith_row_files").option("label", "target").option("id", "idx").option("text", "func").mode("append").save(path)
    spark.read.format("corpusmith_row_files").load(path)     # label, id, text

Rows with a null label, id or text are left out. Repeated ids are files of their own. Overwriting replaces what was committed before, in one step for readers that come after.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "corpusmith_row_files"
#: Characters of a quoted id in a file's name; the index has the whole id.
LONGEST = 100


def opened(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


def put(store: fs.FileSystem, name: str, content: bytes) -> None:
    with store.open_output_stream(name) as f:
        f.write(content)


def get(store: fs.FileSystem, name: str) -> bytes:
    with store.open_input_stream(name) as f:
        return f.read()


def commits(store: fs.FileSystem, root: str) -> dict[str, dict]:
    """What each job that was committed and not replaced since has written, by the job."""
    found = store.get_file_info(fs.FileSelector(f"{root}/_committed", allow_not_found=True))
    said = {f.base_name.removesuffix(".json"): json.loads(get(store, f.path)) for f in found if f.base_name.endswith(".json")}
    replaced = {job for x in said.values() for job in x["replaces"]}
    return {job: x for job, x in said.items() if job not in replaced}


@dataclass
class Attempt(InputPartition):
    folder: str = ""
    n: int = 0

    def __init__(self, folder: str, n: int):
        super().__init__(folder)
        self.folder, self.n = folder, n


@dataclass
class Written(WriterCommitMessage):
    folder: str
    n: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.columns = [options.get(c, c) for c in ("label", "id", "text")]

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = opened(self.path)
        context = TaskContext.get()
        task = f"{context.partitionId()}-{context.attemptNumber()}" if context else "0-0"
        folder, index, made = f"data/{self.job}/{task}-{uuid.uuid4().hex[:8]}", [], set()
        for row in rows:
            label, key, text = (row[c] for c in self.columns)
            if label is None or key is None or text is None:
                continue
            place, content = f"{root}/{folder}/{quote(str(label), safe='')[:LONGEST]}", text.encode()
            if place not in made:
                store.create_dir(place, recursive=True)
                made.add(place)
            name = f"{place}/{len(index):08d}-{quote(str(key), safe='')[:LONGEST]}"
            put(store, name, content)
            index.append(json.dumps([str(label), str(key), name.removeprefix(f"{root}/"), len(content), zlib.crc32(content)]))
        if index:  # an index says that all files before it are there
            put(store, f"{root}/{folder}/_index", "\n".join(index).encode())
        return Written(folder, len(index))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(f"{root}/_committed", recursive=True)
        before = commits(store, root) if self.overwrite else {}
        said = {"replaces": sorted(before), "attempts": [[m.folder, m.n] for m in messages if m is not None and m.n]}
        put(store, f"{root}/_committed/{self.job}.part", json.dumps(said).encode())
        store.move(f"{root}/_committed/{self.job}.part", f"{root}/_committed/{self.job}.json")
        kept = {folder for folder, _ in said["attempts"]}
        for f in store.get_file_info(fs.FileSelector(f"{root}/data/{self.job}", allow_not_found=True)):
            if f.path.removeprefix(f"{root}/") not in kept:  # attempts that were repeated
                store.delete_dir(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/data/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/data/{self.job}")


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Attempt]:
        store, root = opened(self.path)
        return [Attempt(folder, n) for _, x in sorted(commits(store, root).items()) for folder, n in x["attempts"]]

    def read(self, partition: Attempt | None) -> Iterator[tuple]:
        if partition is None or not partition.folder:
            return
        store, root = opened(self.path)
        lines = get(store, f"{root}/{partition.folder}/_index").decode().split("\n")
        if len(lines) != partition.n:
            raise OSError(f"{partition.folder}: {len(lines)} of {partition.n} rows")
        for label, key, name, size, crc in map(json.loads, lines):
            content = get(store, f"{root}/{name}")
            if len(content) != size or zlib.crc32(content) != crc:
                raise OSError(f"{name} is not what was written")
            yield label, key, content.decode()


class RowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "label string, id string, text string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RowFiles)
