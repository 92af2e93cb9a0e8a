"""Trees of raw files, as a data source of Spark: a file is a row, and what its place in the tree says are columns, by which whole folders are skipped before anything is opened.

A tree is written once, by tasks that put each file under its final name only when it is whole, and list it, with its digest, in a manifest of JSON lines. Files and folders are
reached through the file system that the address names, so the tree may lie wherever driver and executors can both look."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from tidelake.sources.store import kept

#: Where in a tree a file's facts stand. Folders of dates may lie below folders of parts.
LAYOUTS = {
    "monthly": r"(?P<y>\d{4})-(?P<m>\d{1,2})/t(?P<table>\d{2})[^/]*_taraf(?P<part>\d+)\.json",
    "quarterly": r"(?:(?P<part>.+)/)?(?P<y>\d{4})-(?P<m>\d{1,2})/tablo(?P<table>\d+)\.json",
    "weekly": r"(?:(?P<part>.+)/)?(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})/tablo(?P<table>\d+)\.html",
}
FOLDER = re.compile(r"(\d{4})-(\d{1,2})|(\d{4})(\d{2})(\d{2})")
SCHEMA = "period date, table_no int, part string, path string, bytes long, content string"
MANIFEST = "_manifest"
#: Bytes and files of a task, bytes of a batch.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 32 << 20, 2000, 1 << 20


class BrokenTree(ValueError):
    """A file of the tree that can't be read as text; args[0] says which."""


@dataclass
class Files(InputPartition):
    """What one task reads: (path, size) and the facts of each."""

    files: list[tuple[str, int, datetime.date, int, str]]

    def __init__(self, files):
        super().__init__(None)
        self.files = files


def _date(y: str, m: str, d: str | None) -> datetime.date | None:
    try:
        return datetime.date(int(y), int(m), int(d or 1))
    except ValueError:
        return None


TESTS = {
    EqualTo: lambda x, f: x == f.value, In: lambda x, f: x in f.value, GreaterThan: lambda x, f: x > f.value, GreaterThanOrEqual: lambda x, f: x >= f.value,
    LessThan: lambda x, f: x < f.value, LessThanOrEqual: lambda x, f: x <= f.value, IsNotNull: lambda x, f: True,
}


class TreeReader(DataSourceReader):
    """Filters on period, table_no and part are answered from names alone; a folder of a period that they exclude is never listed."""

    def __init__(self, options: dict[str, str]):
        self.root, self.layout = options["path"].rstrip("/"), re.compile(LAYOUTS[options["layout"]])
        self.known: list[tuple[str, Filter]] = []
        self.listed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("period",), ("table_no",), ("part",)) and getattr(f, "value", 0) is not None:
                self.known.append((f.attribute[0], f))
            else:
                yield f

    def fits(self, **facts) -> bool:
        return all(TESTS[type(f)](facts[name], f) for name, f in self.known if name in facts)

    def _walk(self, fs: pafs.FileSystem, folder: str, base: str) -> Iterator[tuple[str, int, datetime.date, int, str]]:
        self.listed.append(folder[len(base) :])
        for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
            name = info.base_name
            if info.type == pafs.FileType.Directory:
                when = FOLDER.fullmatch(name)
                day = _date(*(when.group(1, 2) + (None,) if when[1] else when.group(3, 4, 5))) if when else None
                if not name.startswith("_") and (when is None or (day is not None and self.fits(period=day))):
                    yield from self._walk(fs, info.path, base)
            elif at := self.layout.fullmatch(info.path[len(base) :].lstrip("/")):
                x = at.groupdict()
                day = _date(x["y"], x["m"], x.get("d"))
                if day is not None and self.fits(period=day, table_no=int(x["table"]), part=x["part"] or ""):
                    yield info.path, info.size or 0, day, int(x["table"]), x["part"] or ""

    def partitions(self) -> Sequence[InputPartition]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        out, some, size = [], [], 0
        for f in self._walk(fs, base, base):
            some.append(f)
            size += f[1]
            if size >= TASK_BYTES or len(some) >= TASK_FILES:
                out.append(Files(some))
                some, size = [], 0
        return [*out, Files(some)] if some or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        rows, size = [], 0
        schema = pa.schema([("period", pa.date32()), ("table_no", pa.int32()), ("part", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("content", pa.string())])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for path, n, day, table, part in partition.files:
            with fs.open_input_stream(path) as f:
                raw = f.read()
            try:
                rows.append((day, table, part, path[len(base) :], n, raw.decode("utf-8")))
            except UnicodeDecodeError as e:
                raise BrokenTree(f"{path} isn't text in UTF-8: {e.reason} at {e.start}") from e
            size += n
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    manifest: str
    files: int


class TreeWriter(DataSourceWriter):
    """Rows (path, content) as files. A file takes its name when it is whole, so a task that runs twice leaves the same tree; its manifest counts once the job commits."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        if not {"path", "content"} <= set(columns):
            raise ValueError("a tree is written from columns path and content")
        self.root = options["path"].rstrip("/")

    def write(self, iterator) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.root)
        own, lines, made = uuid.uuid4().hex, [], set()
        for row in iterator:
            raw, path = (row.content or "").encode(), row.path.lstrip("/")
            folder = f"{base}/{path}".rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(f"{folder}/_{own}") as f:
                f.write(raw)
            fs.move(f"{folder}/_{own}", f"{base}/{path}")
            lines.append(json.dumps({"path": path, "sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw), "fetched_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")}))
        fs.create_dir(f"{base}/{MANIFEST}", recursive=True)
        with fs.open_output_stream(f"{base}/{MANIFEST}/_{own}") as f:
            f.write("".join(x + "\n" for x in lines).encode())
        return Written(own, len(lines))

    def commit(self, messages) -> None:
        fs, base = pafs.FileSystem.from_uri(self.root)
        for m in messages:
            if m is not None:
                fs.move(f"{base}/{MANIFEST}/_{m.manifest}", f"{base}/{MANIFEST}/{m.manifest}.jsonl")

    def abort(self, messages) -> None:
        fs, base = pafs.FileSystem.from_uri(self.root)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{base}/{MANIFEST}/_{m.manifest}")


class RawTree(DataSource):
    """Options: path, and to read layout, one of LAYOUTS."""

    @classmethod
    def name(cls) -> str:
        return "raw_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options, schema.fieldNames())


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RawTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write(files: DataFrame, root: str) -> None:
    registered(files.sparkSession)
    files.select("path", "content").write.format("raw_tree").mode("append").save(root)


def scan(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """period, table_no, part, path (from the root), bytes, content: a row for each file of a tree."""
    return registered(spark).read.format("raw_tree").option("layout", layout).load(root)


def archived(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """Where the session's tree of that name is; make() gives its files (path, content) the first time."""
    return kept(spark, sf_dir, f"raw-{name}", lambda root: write(make(), root))
