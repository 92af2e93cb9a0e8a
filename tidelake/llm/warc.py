"""Operator 4, WARC: writing archives and reading them back by boundary-chain verification.

Writing is native: each record is one string, and Spark's text writer parts records with the CR LF CR LF that the format asks for, under its own
commit protocol. A payload that an earlier page has becomes a revisit record that names the response's page and digest.

Reading uses Spark's text splits with the version line as separator, so tasks read byte ranges of any file system. At each version line a task parses
a candidate record and its successor, the offset its lengths lead to. A payload may hold a version line, even a whole record; so a candidate counts
only if it can be reached from the start of its file. Within a split the candidates form a forest (the parent of a record is its successor); its
pre-order numbers tell which records an entry reaches, and only the entries of splits are found by pointer jumping over the whole file. Records whose
payload holds a version line are put together again from their segments.

Defined cases: a null html is an empty payload, a null url an empty target. Rows without a page id are written and read back with a null id. Rows that
repeat id and payload are all responses. An empty table gives an empty archive and result. Other columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.llm.common import Scratch, map_batches

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes are deduplicated.
LEAST_BYTES = 0
SLOTS = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in base 32: each 20 bits of it are four digits."""
    digest = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5))), HEX32, BASE32)


def _payload(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A")
    page = pages.select(F.col(page_id).cast("long").alias("page_id"), safe.alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return page.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))


def write_warc(pages: DataFrame, path: str, tmp: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """One record for each row of pages, in archives under path."""
    page = _payload(pages, page_id, url, html)
    own = page.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = tmp.cut(own, "repeated")
    # a page whose digest shares no slot with a repeated one has nothing to be joined with, so its payload isn't shuffled; there are SLOTS slots at most to broadcast
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).cast("int")
    slots = tmp.cut(own.select(slot.alias("slot")).distinct().withColumn("maybe", F.lit(True)), "slots")
    page = page.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left").drop("slot")
    alone = page.where("maybe IS NULL").drop("maybe").withColumn("first", F.lit(None).cast("long"))
    page = alone.unionByName(page.where("maybe").drop("maybe").join(own.hint("merge"), "digest", "left"))
    again = (F.col("size") >= least_bytes) & (F.col("page_id") > F.col("first"))
    again = F.coalesce(again, F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">\r\n"))
    length = F.octet_length("http") + F.when(F.col("again"), 0).otherwise(F.col("size"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn("page_id"), F.lit(f"WARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.when(F.col("again"), F.concat(F.lit("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: "), urn("first"))).otherwise("\r\n"),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END), F.col("http"), F.when(F.col("again"), "").otherwise(F.col("html")),
    )
    page.withColumn("again", again).withColumn("http", http).select(record.alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


_HEADER = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def _parse(text: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Fields, bytes of the header, bytes of the block, of what follows a version line; None if it's no record header."""
    head = text.find(b"\r\n\r\n")
    if head < 0:
        return None
    fields, at = {}, 0
    while at < head + 2:
        m = _HEADER.match(text, at)
        if not m:
            return None
        fields[m[1].lower()] = m[2].strip()
        at = m.end()
    size = fields.get(b"content-length", b"")
    return (fields, head + 4, int(size)) if size.isdigit() and b"warc-type" in fields and len(size) < 19 else None


_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _record(fields: dict[bytes, bytes], block: bytes) -> dict:
    """What a whole record says; intact: its response payload has the digest that its header gives."""
    kind = fields[b"warc-type"].decode("ascii", "replace")
    number = lambda k: int(m[1]) if (m := re.fullmatch(rb"<urn:x-page:(-?\d+)>", fields.get(k, b""))) else None
    told = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    head, _, payload = block.partition(b"\r\n\r\n")
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        length = re.search(rb"(?mi)^content-length:[ \t]*(\d+)", head)
        size, digest = int(length[1]) if length else None, told
    return {"page_id": number(b"warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(b"warc-refers-to"), "intact": digest == told}


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the version lines, by file and split in its order."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _by_split(batches) -> Iterator[tuple[tuple, bytes]]:
    for batch in batches:
        yield from zip(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), strict=True), batch.column("value").to_pylist(), strict=True)


_CANDIDATES = "file string, split long, total long, at long, succ long, exit long, pre int, post int, whole boolean, "


def _candidates(batches) -> Iterator[pa.RecordBatch]:
    """For each split its candidates in order: offsets relative to the split's first segment, the first offset of their chain beyond the split's candidates, the range of pre-order numbers of those that reach them; and a row with the split's total."""
    schema = _arrow(_CANDIDATES + _FIELDS)

    def close(key, found, total):
        index = {c["at"]: i for i, c in enumerate(found)}
        size, exits = [1] * len(found), [0] * len(found)
        parent = [index.get(c["succ"], -1) for c in found]
        for i, p in enumerate(parent):  # parents come later
            if p >= 0:
                size[p] += size[i]
        start, free = [0] * len(found), 0
        nexts: dict[int, int] = {}
        for i in range(len(found) - 1, -1, -1):
            p = parent[i]
            if p < 0:
                start[i], free, exits[i] = free, free + size[i], found[i]["succ"]
            else:
                start[i] = nexts.get(p, start[p] + 1)
                nexts[p] = start[i] + size[i]
                exits[i] = exits[p]
        rows = [c | {"file": key[0], "split": key[1], "total": total, "exit": e, "pre": s, "post": s + n - 1} for c, e, s, n in zip(found, exits, start, size, strict=True)]
        rows.append({"file": key[0], "split": key[1], "total": total})
        for k in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_pylist(rows[k : k + 5000], schema=schema)

    key, found, total = None, [], 0
    for now, value in _by_split(batches):
        if now != key:
            if key is not None:
                yield from close(key, found, total)
            key, found, total = now, [], 0
        if parsed := _parse(value):
            fields, head, size = parsed
            end = head + size + 4
            whole = end == len(value)
            found.append({"at": total - len(MAGIC), "succ": total + end, "whole": whole} | (_record(fields, value[head : head + size]) if whole else {}))
        total += len(value) + len(MAGIC)
    if key is not None:
        yield from close(key, found, total)


def _reach(cand: DataFrame, tmp: Scratch) -> DataFrame:
    """(file, at) of the candidates at which chains from the file starts enter splits, by pointer jumping: in round k each hop spans 2 ** k splits."""
    hop = tmp.cut(cand.select("file", "at", "exit"), "hop-0")
    seen = tmp.cut(hop.where("at = 0").select("file", "at"), "seen-0")
    most = cand.select("file", "split").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for k in range(1, most.bit_length() + 1 if most > 1 else 1):
        ahead = seen.join(hop.hint("merge"), ["file", "at"]).select("file", F.col("exit").alias("at"))
        seen = tmp.cut(seen.union(ahead.join(hop.select("file", "at").hint("merge"), ["file", "at"], "left_semi")).distinct(), f"seen-{k}")
        twice = hop.select("file", F.col("at").alias("exit"), F.col("exit").alias("next"))
        hop = tmp.cut(hop.join(twice.hint("merge"), ["file", "exit"], "left").select("file", "at", F.coalesce("next", "exit").alias("exit")), f"hop-{k}")
        tmp.drop(f"seen-{k - 1}", f"hop-{k - 1}")
    return seen


def read_warc(spark: SparkSession, path: str, tmp: Scratch) -> DataFrame:
    """The records of the archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    raw = tmp.cut(_segments(spark, path).mapInArrow(_candidates, _CANDIDATES + _FIELDS), "candidates")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = raw.where("at IS NULL").groupBy("file", "split").agg(F.max("total").alias("total")).select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    base = tmp.cut(base, "base")
    moved = [(F.col(c) + F.col("base")).alias(c) for c in ("at", "succ", "exit")]
    names = [c for c in raw.columns if c not in ("at", "succ", "exit", "total")]
    cand = tmp.cut(raw.where("at IS NOT NULL").join(base.hint("merge"), ["file", "split"]).select(*names, *moved).where("at >= 0"), "placed")
    entry = _reach(cand, tmp)
    pre = cand.join(entry.hint("merge"), ["file", "at"], "left_semi").groupBy("file", "split").agg(F.min_by("pre", "at").alias("entry"))
    kept = tmp.cut(cand.join(tmp.cut(pre, "entries").hint("merge"), ["file", "split"]).where("entry BETWEEN pre AND post"), "kept")
    columns = [c.split()[0] for c in _FIELDS.split(", ")]
    out = kept.where("whole").select(*columns)
    if not kept.where("NOT whole").isEmpty():
        out = out.union(_joined(spark, path, kept, base, tmp).select(*columns))
    return out


def _joined(spark: SparkSession, path: str, kept: DataFrame, base: DataFrame, tmp: Scratch) -> DataFrame:
    """The records whose payload holds a version line, put together from their segments. A segment belongs to the last record that begins before it."""

    def placed(batches):
        schema = _arrow("file string, split long, at long, value binary")
        key, total = None, 0
        for now, value in _by_split(batches):
            key, total = (key, total) if now == key else (now, 0)
            yield pa.RecordBatch.from_pylist([{"file": key[0], "split": key[1], "at": total - len(MAGIC), "value": value}], schema=schema)
            total += len(value) + len(MAGIC)

    seg = _segments(spark, path).mapInArrow(placed, "file string, split long, at long, value binary").join(base.hint("merge"), ["file", "split"]).select("file", (F.col("at") + F.col("base")).alias("at"), "value")
    broken = tmp.cut(kept.where("NOT whole").select("file", F.col("at").alias("owner"), "succ"), "broken")
    # positions alone are put in order, file by file; payloads meet them afterwards
    starts = kept.select("file", "at", F.col("at").alias("start"))
    known = F.last("start", True).over(Window.partitionBy("file").orderBy("at", F.col("start").isNull()))
    owned = seg.select("file", "at", F.lit(None).cast("long").alias("start")).withColumn("here", F.lit(True)).union(starts.withColumn("here", F.lit(False))).withColumn("owner", known).where("here")
    owned = tmp.cut(owned.join(broken.hint("merge"), ["file", "owner"]).where("at < succ").select("file", "at", "owner"), "owned")
    parts = seg.join(owned.hint("merge"), ["file", "at"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))

    def whole(batch: pa.RecordBatch) -> dict:
        rows = []
        for parts in batch.column("parts").to_pylist():
            text = MAGIC.encode().join(p["value"] for p in parts)
            fields, head, size = _parse(text)
            rows.append(_record(fields, text[head : head + size]))
        return {c.split()[0]: [r[c.split()[0]] for r in rows] for c in _FIELDS.split(", ")}

    return map_batches(parts, whole, _FIELDS)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages as archives under path (None: the shared folder) and reads these back."""
    tmp = Scratch(pages.sparkSession, "warc")
    path = path or tmp.path("archives")
    write_warc(pages, path, tmp)
    return read_warc(pages.sparkSession, path, tmp)


#: The same in DuckDB, which has no SHA-1 and no base 32: the digest is left out there.
SQL = None
