"""A data source of text files whose names are a column: (file, line), one file for each name.

Written with ``write_named``: the lines of a file come to one task in their order and are streamed into it, under a
hidden name until it is whole, so a repeated task replaces its files by the same ones.  Each task leaves a list of
its files; a commit is one small file that names the lists of the successful tasks and counts files by folder.  No
list of all files goes through the driver.

Read as a batch, the folders are dealt to tasks, which list them (a large folder to several tasks, by a hash of
names; the commits say which folders there are and how large; a folder without commits is walked); equality on ``file`` or its beginning leaves folders out.  Read as a
stream, the offset is the number of commits and a batch has the files of the new ones.  A folder is listed by each of
the tasks that share it, so their number is bounded (``most_tasks``): more files make larger tasks, which stream them.

A file's name is a path below the folder; parts that are empty or begin with . or _ raise an error.  A null line
gives a file without lines, if no other comes.  Lines hold no line breaks; they are read back without them.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.shared import unused
from tessera.sources.storage import Store

SCHEMA = "file string, line string"
COMMITS, LISTS = "_commits", "_commits/lists"
ROWS = 8192


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: where its list is, and files by folder."""

    listed: str | None
    folders: dict[str, int] = field(default_factory=dict)


@dataclass
class Folder(InputPartition):
    """Folders of a task; of each, the names whose hash has this remainder."""

    parts: Sequence[tuple[str, int, int]]


@dataclass
class Listed(InputPartition):
    """A task's list of files."""

    name: str


def _checked(file: str | None) -> str:
    if file is None or any(not p or p[0] in "._" for p in file.split("/")):
        raise ValueError(f"not a file's name: {file!r}")
    return file


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(file, its lines) of rows that come sorted by file; the lines are to be taken before the next file."""

    def runs() -> Iterator[tuple[str, list[str]]]:
        for batch in batches:
            if not len(batch):
                continue
            file, line, start = pc.run_end_encode(batch.column(0)), batch.column(1).to_pylist(), 0
            for name, end in zip(file.values.to_pylist(), file.run_ends.to_pylist(), strict=True):
                yield name, line[start:end]
                start = end

    def own(first: list[str], name: str) -> Iterator[bytes]:
        nonlocal ahead
        lines = first
        while True:
            yield "".join([f"{x}\n" for x in lines if x is not None]).encode()
            ahead = next(rest, None)
            if ahead is None or ahead[0] != name:
                return
            lines = ahead[1]

    rest, last = runs(), None
    ahead = next(rest, None)
    while ahead is not None:
        name, first = ahead
        if last is not None and not _checked(name) > last:
            raise ValueError(f"the lines of {name} don't come together: use write_named")
        last = _checked(name)
        yield name, own(first, name)


class _Commits:
    def __init__(self, path: str):
        self.store = Store(path)

    def names(self) -> list[str]:
        return [n for n, folder in self.store.entries(COMMITS) if not folder]

    def load(self, name: str) -> dict:
        return json.loads(self.store.read(f"{COMMITS}/{name}"))

    def add(self, messages: list[Written | None], source: str | None = None) -> None:
        """The next commit; one of a stream's batch that is there already is not added again."""
        tasks = [m for m in messages if m is not None and m.listed]
        folders: dict[str, int] = {}
        for m in tasks:
            for f, n in m.folders.items():
                folders[f] = folders.get(f, 0) + n
        body = json.dumps({"lists": sorted(m.listed for m in tasks), "folders": folders, "source": source}).encode()
        names = self.names()
        if source is not None and any(self.load(n)["source"] == source for n in names):
            return
        number = len(names)
        while not self.store.create(f"{COMMITS}/{number:08d}.json", body):
            number += 1


def _write(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """Files of one task and its list; the list's name is a hash of what it says, so a repeated task writes it again."""
    store, names, folders = Store(path), [], {}
    for name, lines in _files(batches):
        store.write(name, lines)
        names.append(name)
        top = name.rpartition("/")[0]
        folders[top] = folders.get(top, 0) + 1
    if not names:
        return Written(None)
    body = "\n".join(names).encode()
    listed = hashlib.sha1(body).hexdigest()
    store.write(f"{LISTS}/{listed}", [body])
    return Written(listed, folders)


class Writer(DataSourceArrowWriter):
    """``source`` names what is written, as a stream and its batch: the same is committed once, however often it is written."""

    def __init__(self, path: str, source: str | None = None):
        self.path, self.source = path, source

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _Commits(self.path).add(messages, self.source)


def _lines(store: Store, names: Iterator[str]) -> Iterator[pa.RecordBatch]:
    file, line = [], []
    for name in names:
        with store.open(name) as f:
            for raw in f:
                file.append(name)
                line.append(raw.rstrip(b"\n").decode())
                if len(line) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(line, pa.string())], ["file", "line"])
                    file, line = [], []
    yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(line, pa.string())], ["file", "line"])


def _names(names: Iterator[str]) -> Iterator[pa.RecordBatch]:
    """Files as rows with a null line."""
    while file := list(islice(names, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.nulls(len(file), pa.string())], ["file", "line"])


class Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int, most_tasks: int = 100, lines: bool = True):
        self.path, self.per_task, self.most_tasks, self.lines, self.begins = path, per_task, most_tasks, lines, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """What ``file`` is or begins with; Spark still checks each row."""
        for f in filters:
            if getattr(f, "attribute", None) == ("file",):
                if isinstance(f, (EqualTo, StringStartsWith)):
                    self.begins = [f.value]
                elif isinstance(f, In):
                    self.begins = list(f.value)
            yield f

    @staticmethod
    def _walked(store: Store) -> Iterator[str]:
        waiting = [""]
        while waiting:
            yield (folder := waiting.pop())
            waiting += [f"{folder}/{n}".lstrip("/") for n, is_dir in store.entries(folder) if is_dir]

    def _wanted(self, folder: str) -> bool:
        return self.begins is None or not folder or any(b.startswith(f"{folder}/") or f"{folder}/".startswith(b) for b in self.begins)

    def partitions(self) -> list[Folder]:
        commits, size = _Commits(self.path), {}
        for name in commits.names():
            for folder, n in commits.load(name)["folders"].items():
                size[folder] = size.get(folder, 0) + n
        per_task = max(self.per_task, -(-sum(size.values()) // self.most_tasks))
        out, now, room = [], [], 0
        for folder in sorted(size) or self._walked(commits.store):
            if not self._wanted(folder):
                continue
            n = size.get(folder, per_task)
            pieces = -(-n // per_task)
            for i in range(pieces):
                now.append((folder, i, pieces))
                room += n // pieces
                if room >= per_task:
                    out.append(Folder(now))
                    now, room = [], 0
        return [*out, Folder(now)] if now else out

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        found = ((folder, short) for folder, piece, pieces in partition.parts for short in store.files(folder) if zlib.crc32(short.encode()) % pieces == piece)
        names = (f"{folder}/{short}".lstrip("/") for folder, short in found)
        if self.begins is not None:
            names = (n for n in names if n.startswith(tuple(self.begins)))
        return _lines(store, names) if self.lines else _names(names)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"commit": 0}

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"commit": len(_Commits(self.path).names())}

    def partitions(self, start: dict, end: dict) -> list[Listed]:
        commits = _Commits(self.path)
        return [Listed(x) for name in commits.names()[start["commit"] : end["commit"]] for x in commits.load(name)["lists"]]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        return _lines(store, iter(store.read(f"{LISTS}/{partition.name}").decode().split("\n")))


class NamedFiles(DataSource):
    """Options: path; to read files_per_task (1000), most_tasks (100), lines (true); to write source (see Writer)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._path(), int(self.options.get("files_per_task", "1000")), int(self.options.get("most_tasks", "100")), self.options.get("lines", "true") == "true")

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802 - Spark's name
        return StreamReader(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("named files are added or replaced one by one: write with mode append")
        return Writer(self._path(), self.options.get("source"))


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NamedFiles)
    return spark


def together(lines: DataFrame, *order: str) -> DataFrame:
    """(file, line) with a file's lines in one task, in order."""
    rank = [unused(["file", "line"], f"_{i}") for i in range(len(order))]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select("file", "line", *(F.col(c).alias(r) for c, r in zip(order, rank, strict=True)))
    return rows.repartition(n, "file").sortWithinPartitions("file", *rank, "line").select("file", "line")


def write_named(lines: DataFrame, path: str, *order: str, source: str | None = None) -> None:
    """Write (file, line) rows, in the order of further columns and then of the line; files of that name are replaced."""
    registered(lines.sparkSession)
    out = together(lines, *order).write.format("named_files").mode("append").option("path", path)
    (out.option("source", source) if source else out).save()


def write_stream(lines: DataFrame, path: str, checkpoint: str, *order: str) -> StreamingQuery:
    """Write a stream's batches; a batch that is repeated is committed once.  A file's lines must come in one batch."""
    write = lambda df, number: write_named(df, path, *order, source=f"{checkpoint}/{number}")
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_named(spark: SparkSession, path: str, files_per_task: int = 1000) -> DataFrame:
    return registered(spark).read.format("named_files").option("path", path).option("files_per_task", files_per_task).load()


def list_named(spark: SparkSession, path: str) -> DataFrame:
    """(file) of a folder's files, listed by tasks; none is opened and the driver sees no names."""
    return registered(spark).read.format("named_files").option("path", path).option("lines", "false").load().select("file")


def stream_named(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).readStream.format("named_files").option("path", path).load()
