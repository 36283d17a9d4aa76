"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing: every row becomes one record, a gzip member of its own. Of rows with equal
payloads (of at least `min_bytes`) the one with the largest page_id carries the
payload as a response; the others are revisit records that point to it. Rows that
tie on that page_id (repeated rows) are all responses. Tasks write archives into the
shared folder and report them in a manifest, itself a committed table: files of failed
or repeated attempts are in no manifest and so are never read.

Reading: members are checked (gzip CRC, header syntax, lengths, payload digest). After
a failed check the reader looks for the next gzip magic or WARC version line that
starts a valid record and goes on from there; the bytes in between are reported as a
gap with their place and reason. A member may hold many records: a bad one among them is a
gap inside the member, and of a member that is cut short or fails its CRC the records are
kept whose payload digest holds. Nothing is lost but the damaged records. read() gives
records and gaps in one table, split() the two apart, and round_trip() logs its gaps.

Defined results: null html is an empty payload; null url leaves out the target header
and reads back as null; null page_id likewise; urls are written as they are, and once more in
a header of their own where line breaks or outer spaces would not survive; a member, and so a
very long payload, is held whole by the task that reads it; an empty table gives no archive
and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import batches, materialize, shared_dir, small_batches

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
MEMBER = re.compile(rb"\x1f\x8b\x08")
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Compressed bytes after which a task begins another archive.
ROLL_BYTES = 64 << 20
BLOCK = 1 << 20
#: Members are unpacked in pieces of so many bytes; a piece that fails is tried again byte by byte.
PIECE = 1 << 16
#: The end of a plain record's header is looked for in steps that begin with this; only its own bounds end the search.
HEADER = 64 << 10
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


#: Holds a target URI, percent-encoded where it would not survive in a header line.
EXACT_URI = "X-Exact-Target-URI"


def url_headers(url: str) -> list[str]:
    plain = re.sub(r"[\r\n]", "", url).strip()
    return [f"WARC-Target-URI: {plain}"] + ([f"{EXACT_URI}: {quote(url, safe=':/?#[]@!$&()*+,;=')}"] if plain != url else [])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head += url_headers(url)
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damage(Exception):
    """A failed check."""


def parse_record(data: bytes, begin: int = 0) -> tuple[dict, int]:
    """The record at begin, and its length; Damage if a check fails. `verified` tells whether a digest covers its payload."""
    end = data.find(b"\r\n\r\n", begin)
    if not data.startswith(b"WARC/1.", begin) or end < 0:
        raise Damage("header")
    fields: dict[str, str] = {}
    for line in data[begin:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError):
        raise Damage("content length") from None
    stop = end + 4 + size
    if size < 0 or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("record end")
    block, kind = data[end + 4 : stop], fields.get("warc-type", "")
    out = {"record_type": kind, "url": None, "page_id": None, "refers_to": None, "payload_bytes": None, "payload_digest": None, "payload": None, "verified": False}
    if EXACT_URI.lower() in fields:
        out["url"] = unquote(fields[EXACT_URI.lower()])
    else:
        out["url"] = fields.get("warc-target-uri")
    try:
        for key, name in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page")):
            if name in fields:
                out[key] = int(fields[name])
        if kind in ("response", "revisit"):
            http, gap, body = block.partition(b"\r\n\r\n")
            length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            if not gap:
                raise Damage("http header")
            out["payload_bytes"] = int(length[1]) if length else len(body)
            out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response":
                if len(body) != out["payload_bytes"] or out["payload_digest"] not in ("", digest(body)):
                    raise Damage("payload digest")
                out["payload"], out["verified"] = body, out["payload_digest"] != ""
    except ValueError:
        raise Damage("number") from None
    return out, stop + 4 - begin


class Source:
    """Random access to a file by blocks, the last few of which are remembered."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size, self.held = read_at, size, {}

    def block(self, k: int) -> bytes:
        if k not in self.held:
            if len(self.held) > 8:
                self.held.pop(next(iter(self.held)))
            self.held[k] = self.read_at(min(BLOCK, self.size - k * BLOCK), k * BLOCK)
        return self.held[k]

    def from_(self, pos: int) -> Iterator[bytes]:
        k = pos // BLOCK
        while k * BLOCK < self.size:
            yield self.block(k)[max(0, pos - k * BLOCK) :]
            k += 1

    def take(self, pos: int, n: int) -> bytes:
        out = b""
        for part in self.from_(pos):
            out += part
            if len(out) >= n:
                break
        return out[:n]

    def next_start(self, pos: int, pattern: re.Pattern = START) -> int:
        """The next place at or after pos where a member or version line may begin; the size if none."""
        tail, at = b"", pos
        for part in self.from_(pos):
            data = tail + part
            if m := pattern.search(data):
                return at - len(tail) + m.start()
            at += len(part)
            tail = data[-9:]
        return self.size


def member(source: Source, pos: int) -> tuple[bytes, int, str]:
    """The bytes of the gzip member at pos as far as they unpack, where that ends, and the failed check ("" if none)."""
    d, out, used = zlib.decompressobj(31), [], 0
    for block in source.from_(pos):
        for k in range(0, len(block), PIECE):
            part = block[k : k + PIECE]
            before = d.copy()
            try:
                out.append(d.decompress(part))
            except zlib.error:
                for i in range(len(part)):  # what unpacks before the damage
                    try:
                        out.append(before.decompress(part[i : i + 1]))
                    except zlib.error:
                        return b"".join(out), pos + used + i, "gzip"
            used += len(part) - len(d.unused_data)
            if d.eof:
                return b"".join(out), pos + used, ""
    return b"".join(out), source.size, "truncated member"


def in_member(data: bytes, failed: str) -> Iterator[tuple[str, dict, int, int]]:
    """Records and gaps of unpacked bytes, with their places in them. Of a member that failed, records that a digest covers."""
    pos, gap, reason = 0, None, ""
    while pos < len(data):
        try:
            record, n = parse_record(data, pos)
            if failed and not record["verified"]:
                raise Damage(failed)
        except Damage as e:
            if gap is None:
                gap, reason = pos, str(e)
            m = VERSION_LINE.search(data, pos + 1)
            pos = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", {"reason": reason}, gap, pos
            gap = None
        yield "record", record, pos, pos + n
        pos += n
    if gap is not None:
        yield "gap", {"reason": reason}, gap, len(data)


def plain(source: Source, pos: int) -> tuple[dict, int]:
    """The uncompressed record at pos, and where it ends."""
    head, n = source.take(pos, HEADER), HEADER
    if not head.startswith(b"WARC/1."):
        raise Damage("no record here")
    # A header line is of any length, but what follows the first line of another record is not this one's header.
    while b"\r\n\r\n" not in head and len(head) == n and b"\r\nWARC/1." not in head:
        n *= 4
        head = source.take(pos, n)
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head.partition(b"\r\n\r\n")[0])
    if not length:
        raise Damage("content length")
    need = head.find(b"\r\n\r\n") + 4 + int(length[1]) + 4
    if pos + need > source.size:
        raise Damage("truncated record")
    record, n = parse_record(source.take(pos, need))
    return record, pos + n


def salvage(source: Source) -> Iterator[tuple[str, dict, int, int]]:
    """("record", fields, start, end) and ("gap", {"reason"}, start, end) in file order.

    Gaps inside a sound member have its place in the file, and their own in it as inner_start and inner_end."""
    pos, gap, reason = 0, None, ""
    while pos < source.size:
        found: list[tuple[str, dict, int, int]] = []
        failed, after = "", pos + 1
        if source.take(pos, 3) == MAGIC:
            data, end, failed = member(source, pos)
            found = list(in_member(data, failed))
            if failed:
                found = [x for x in found if x[0] == "record"]
                # Text in a member's stored blocks is no plain record; only another member may begin in what was unpacked.
                after = min(source.next_start(pos + 1, MEMBER), max(end, pos + 1))
            elif not any(kind == "record" for kind, *_ in found):
                failed, found = (found[0][1]["reason"] if found else "no record here"), []
        else:
            try:
                record, end = plain(source, pos)
                found = [("record", record, pos, end)]
            except Damage as e:
                failed = str(e)
        if gap is not None and found:
            yield "gap", {"reason": reason}, gap, pos
            gap = None
        for kind, fields, a, b in found:
            yield kind, fields | ({"inner_start": a, "inner_end": b} if kind == "gap" else {}), pos, end
        if failed:
            if gap is None:
                gap, reason = pos, failed
            pos = source.next_start(after)
        else:
            pos = end
    if gap is not None:
        yield "gap", {"reason": reason}, gap, source.size


def open_fs(uri: str):
    """The file system and path of a URI, as the executors see it."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _writer(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, path, size, n, k, done = None, "", 0, 0, 0, []
        where, base = open_fs(folder)
        for b in batches(it):
            columns = [b.column(c).to_pylist() for c in (0, 1)]
            payloads, refers = b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()
            for page_id, url, payload, to in zip(*columns, payloads, refers, strict=True):
                if out is None:
                    where.create_dir(base, recursive=True)
                    path, size, n, k = f"{name}-{k:03d}.warc.gz", 0, 0, k + 1
                    out = where.open_output_stream(f"{base}/{path}", compression=None)
                z = zlib.compressobj(6, wbits=31)
                data = z.compress(encode_record(page_id, url, payload or b"", to)) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((f"{folder}/{path}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n, size))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "n_records", "n_bytes"), map(list, zip(*done, strict=True)), strict=True)))

    return run


def write(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages (page_id, url, html) as archives; returns the manifest (path, n_records, n_bytes)."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    last = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("last"))
    # A payload with very many copies is one key: both sides are shuffled for the join, so that skewed partitions can be split.
    joined = rows.join(last.hint("merge"), "sha", "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return materialize(joined.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(_writer(folder), "path string, n_records long, n_bytes long"))


READ = "kind string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, start long, end long, inner_start long, inner_end long, reason string, payload binary"
_ARROW = pa.schema([("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("reason", pa.string()), ("payload", pa.binary())])


def _reader(with_payload: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for path in b.column(0).to_pylist():
                where, name = open_fs(path)
                with where.open_input_file(name) as f:
                    rows: list[dict] = []
                    held = 0
                    for kind, fields, start, end in salvage(Source(lambda n, pos, f=f: f.read_at(n, pos), f.size())):
                        row = dict.fromkeys(_ARROW.names) | fields | {"kind": kind, "path": path, "start": start, "end": end}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def read(paths: DataFrame, with_payload: bool = False, tasks: int | None = None) -> DataFrame:
    """Records and gaps of the archives listed in column `path`, a task for each few archives."""
    n = tasks or max(1, paths.count())
    return paths.select("path").repartition(n).mapInArrow(_reader(with_payload), READ)


def read_files(spark: SparkSession, paths: list[str], with_payload: bool = False) -> DataFrame:
    return read(spark.createDataFrame([(p,) for p in paths], "path string"), with_payload)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What read() gives as records, and as the log of quarantined gaps (path, start, end, inner_start, inner_end, reason)."""
    return rows.where("kind = 'record'").drop("kind", "inner_start", "inner_end", "reason"), rows.where("kind = 'gap'").select("path", "start", "end", "inner_start", "inner_end", "reason")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page, read the archives back, one row per record. Gaps are logged; archives just written have none."""
    records, gaps = split(materialize(read(write(pages, min_bytes))))
    lost = gaps.agg(F.count("path").alias("n"), F.sum(F.col("end") - F.col("start")).alias("size")).first()
    if lost.n:
        logging.getLogger(__name__).warning("%d gaps of %d bytes; %s", lost.n, lost.size, gaps.limit(20).collect())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
