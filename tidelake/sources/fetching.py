"""What may be fetched and read: safe addresses hop by hop, limits of size, uploads, workbooks, one deadline for a turn. Refusals are typed by their reason."""

from __future__ import annotations

import io
import posixpath
import threading
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a fetch, and of all that a turn does.
MAX_REDIRECTS, MAX_BYTES, MAX_PAGES = 5, 10 << 20, 50
TURN_SECONDS, FETCH_SECONDS, RENDER_SECONDS = 60, 15, 15
#: Blocks of IPv4 addresses that aren't reachable by all (the registry of special-purpose addresses), as prefix and length.
SPECIAL = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
LOCAL_NAMES = ("localhost", "local", "internal", "lan", "home", "corp", "intranet")


class DocumentRefused(ValueError):
    """A body that can't be read; reason: unsupported, extraction, too_large, empty."""

    def __init__(self, reason: str, said: str = ""):
        super().__init__(said or reason)
        self.reason = reason


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#\\]*)", 1))


def host_of(url: Column) -> Column:
    """The host without credentials, port and a last dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def ipv4(host: Column) -> Column:
    """A dotted quad as a number, else null."""
    parts = F.split(host, r"\.")
    number = lambda i: F.get(parts, i).try_cast("long")
    value = ((number(0) * 256 + number(1)) * 256 + number(2)) * 256 + number(3)
    plain = host.rlike(r"^(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$") & ~host.endswith(".")
    return F.when(plain, value)


def block(prefix: str, length: int) -> tuple[int, int]:
    """The first and the last address of a block."""
    a, b, c, d = map(int, prefix.split("."))
    first = ((a * 256 + b) * 256 + c) * 256 + d
    return first, first + (1 << 32 - length) - 1


def refusal(url: Column) -> Column:
    """Why an address may not be fetched, else null: scheme (not http or https), credentials, host (none), literal (an address in brackets or in an odd notation), private (a local name, or an address that not all can reach)."""
    host, number = host_of(url), ipv4(host_of(url))
    special = F.lit(False)
    for prefix, length in SPECIAL:
        first, last = block(prefix, length)
        special = special | number.between(first, last)
    local = F.substring_index(host, ".", -1).isin(*LOCAL_NAMES) | (~F.contains(host, F.lit(".")) & number.isNull())
    return (
        F.when(url.isNull() | ~url.rlike(r"(?i)^https?://"), "scheme")
        .when(F.contains(authority(url), F.lit("@")), "credentials")
        .when(host == "", "host")
        .when(F.startswith(host, F.lit("[")) | (number.isNull() & F.substring_index(host, ".", -1).rlike(r"^(?:[0-9]+|0x[0-9a-f]*)$")), "literal")
        .when(F.coalesce(special, F.lit(False)) | local, "private")
    )


def chain_refusal(hops: Column) -> Column:
    """The same for an address and all it redirects to, each of which is looked at: redirects if there are more than allowed."""
    bad = F.filter(F.transform(hops, refusal), lambda r: r.isNotNull())
    return F.when(F.size(hops) > MAX_REDIRECTS + 1, "redirects").otherwise(F.get(bad, F.lit(0)))


def upload(files: DataFrame, body: str = "body", most: int = MAX_BYTES) -> DataFrame:
    """files with bytes, digest (null where refused) and refusal: empty, too_large or null. The digest says where a document came from."""
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long")
    why = F.when(size == 0, "empty").when(size > most, "too_large")
    return files.withColumn("bytes", size).withColumn("refusal", why).withColumn("digest", F.when(F.col("refusal").isNull(), F.sha2(body, 256)))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MAX_SHEETS, MAX_SHEET_ROWS, MAX_SHEET_COLS, MAX_PART = 50, 2000, 200, 64 << 20


def _part(book: zipfile.ZipFile, name: str) -> bytes:
    if book.getinfo(name).file_size > MAX_PART:
        raise DocumentRefused("too_large", name)
    return book.read(name)


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def read_workbook(body: bytes | None) -> list[tuple[str, str, bool]]:
    """(sheet, text, cut) of a workbook: rows are lines, cells are parted by tabs, empty cells are kept in their place; cut: whether the limits left anything out. The older binary format is unsupported."""
    if not body:
        raise DocumentRefused("empty")
    if body[:4] == b"\xd0\xcf\x11\xe0":
        raise DocumentRefused("unsupported", "the binary workbook format")
    try:
        book = zipfile.ZipFile(io.BytesIO(body))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(_part(book, "xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(_part(book, "xl/_rels/workbook.xml.rels"))}
        sheets = list(ElementTree.fromstring(_part(book, "xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        return [_sheet(book, s.get("name", ""), targets[s.get(_REL)], shared, len(sheets) > MAX_SHEETS) for s in sheets[:MAX_SHEETS]]
    except (KeyError, ValueError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError) as e:
        if isinstance(e, DocumentRefused):
            raise
        raise DocumentRefused("extraction", str(e)) from e


def _sheet(book: zipfile.ZipFile, name: str, target: str, shared: list[str], cut: bool) -> tuple[str, str, bool]:
    path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    lines = []
    for row in ElementTree.fromstring(_part(book, path)).iter(f"{_MAIN}row"):
        if len(lines) == MAX_SHEET_ROWS:
            cut = True
            break
        cells: list[str] = []
        for at, c in enumerate(row.iter(f"{_MAIN}c")):
            here = _column(c.get("r")) if c.get("r") else at
            if here >= MAX_SHEET_COLS:
                cut = True
                break
            value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (c.findtext(f"{_MAIN}v") or "")
            cells += [""] * (here - len(cells)) + [shared[int(value)] if c.get("t") == "s" and value else value]
        lines.append("\t".join(cells))
    return name, "\n".join(lines), cut


def extract_workbooks(files: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """(key, sheet, text, cut, refusal): a row for each sheet; a body that is refused has one row that says why."""
    schema = pa.schema([("id", pa.int64()), ("sheet", pa.string()), ("text", pa.string()), ("cut", pa.bool_()), ("refusal", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                try:
                    rows = [(i, *s, None) for s in read_workbook(raw)]
                except DocumentRefused as e:
                    rows = [(i, None, None, None, e.reason)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    out = files.select(F.col(key).cast("long").alias("id"), F.col(body).alias("body")).mapInArrow(run, "id long, sheet string, text string, cut boolean, refusal string")
    return out.withColumnRenamed("id", key)


class Deadline:
    """One wall clock for all that a turn runs. Work beyond it is cancelled on the cluster, and what was done before counts."""

    def __init__(self, spark: SparkSession, seconds: float = TURN_SECONDS):
        self.spark, self.end = spark, time.monotonic() + seconds

    @property
    def left(self) -> float:
        return max(0.0, self.end - time.monotonic())

    def run(self, work: dict[str, Callable[[], object]]) -> tuple[dict[str, object], list[str]]:
        """What each piece of work returned, in turn, and the names of those that were not reached or not finished."""
        done, late = {}, []
        for name, one in work.items():
            group = f"deadline-{uuid.uuid4().hex}"
            if not self.left:
                late.append(name)
                continue
            fired = threading.Event()
            timer = threading.Timer(self.left, lambda g=group, f=fired: (f.set(), self.spark.sparkContext.cancelJobGroup(g)))
            self.spark.sparkContext.setJobGroup(group, name, interruptOnCancel=True)
            timer.start()
            try:
                done[name] = one()
            except Exception:
                if not fired.is_set():
                    raise
                late.append(name)
            finally:
                timer.cancel()
                self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return done, late
