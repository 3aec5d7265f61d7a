"""WARC archives: writing one gzip member a record, and a sequential, verifying reader.

``write_archives`` collects the records of a task into archives of bounded size, and Spark's text
writer, with one row a file, stores each as a file of its own: the bytes go through Spark's commit
protocol to any file system, and a lost executor's files are written anew. A gzip member ends with
the upper byte of its length, zero below 16 MiB; that last byte is left to the writer as its line
separator. Where it isn't zero an empty member follows.

``read_archives`` goes through each archive member by member, inflating in steps of bounded size from
an open file, frames each record by its Content-Length and checks the digests that are there. Payloads
are held only if they are asked for. What is damaged gives a row that names the problem, and reading
goes on at the next member. Headers have no limit: a record's is held whole, as its URL is (what doesn't begin like a
record is left at once); of a block's HTTP header only the line being read is held, and no more than ``STEP`` of that.

Cases: a null payload is empty, a null id or URL gives an empty header value; of records with equal
payloads the one with the smallest id is the response (null ids only if there is no other; of repeated ids that with the
smallest URL, of rows equal in all three any one), the others are revisits that name it; an empty table gives no archives and an
empty result; a very long URL or payload is written and read like any other; other columns of the input are not looked at. Records of other kinds and of other writers are read too: digests are
optional, ids are texts, and page_id is null where the id isn't one of this writer's numbers.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import FEW, scratch_path, ship, stored

#: Payloads of fewer bytes are always stored, never revisited.
MIN_REVISIT = 0
ARCHIVE_BYTES = 32 << 20
#: Bytes that are read or inflated at once.
STEP = 1 << 16
DATE = "2020-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string, record_id string, refers_to_id string"
_EMPTY_MEMBER = zlib.compressobj(0, zlib.DEFLATED, 31).flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _value(x) -> str:
    """A header value on one line: control characters and % are written as %XX."""
    return "".join(c if c > " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in ("" if x is None else str(x)))


def _plain(x: str) -> str:
    if "%" not in x:
        return x
    head, *rest = x.split("%")
    return head + "".join(chr(int(p[:2], 16)) + p[2:] for p in rest)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 6) -> bytes:
    """One gzip member: a response with its payload or a revisit without."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{_value(page_id)}>",
        f"WARC-Target-URI: {_value(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if url is None:
        head.remove("WARC-Target-URI: ")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_value(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()
    return member if member[-1] == 0 else member + _EMPTY_MEMBER


class Damage(Exception):
    """What is wrong with a member."""


class Member:
    """The inflated bytes of the gzip member at a place of a stream, in steps."""

    def __init__(self, stream: BinaryIO, at: int, step: int = STEP) -> None:
        self.stream, self.end, self.step = stream, at, step
        self.inflate, self.held = zlib.decompressobj(31), b""
        stream.seek(at)

    def read(self) -> bytes:
        """At most ``step`` bytes or so; none at the end of the member."""
        while not self.inflate.eof:
            data = self.held or self.stream.read(self.step)
            try:
                out = self.inflate.decompress(data, self.step)
            except zlib.error as e:
                raise Damage("gzip") from e
            self.held = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            self.end += len(data) - len(self.held) - len(self.inflate.unused_data)
            if out:
                return out
            if not data and not self.inflate.eof:
                raise Damage("the archive ends inside a gzip member")
        return b""


class _Bytes:
    """A member's bytes by line and by number."""

    def __init__(self, member: Member) -> None:
        self.member, self.held = member, b""

    def at_end(self) -> bool:
        self.held = self.held or self.member.read()
        return not self.held

    def head(self, begin: bytes) -> bytes:
        """What stands before an empty line, which is passed; it must begin with ``begin``."""
        head, seen = bytearray(self.held), 0
        while (end := head.find(b"\r\n\r\n", seen)) < 0:
            if len(head) >= len(begin) and not head.startswith(begin):
                raise Damage("no header")
            seen = max(0, len(head) - 3)
            more = self.member.read()
            if not more:
                raise Damage("no header")
            head += more
        self.held = bytes(head[end + 4 :])
        return bytes(head[:end])

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in parts, or fewer at the end of the member."""
        while n and not self.at_end():
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class _HttpHead:
    """Passes over an HTTP header as it comes in, and keeps its Content-Length."""

    def __init__(self) -> None:
        self.line, self.length = bytearray(), None

    def feed(self, part: bytes) -> bytes | None:
        """What follows the header, once it has ended."""
        self.line += part
        while (end := self.line.find(b"\r\n")) >= 0:
            if end == 0:
                return bytes(self.line[2:])
            name, _, value = bytes(self.line[:end]).partition(b":")
            if name.strip().lower() == b"content-length":
                self.length = value.strip().decode("utf-8", "replace")
            del self.line[: end + 2]
        if len(self.line) > STEP:  # of a line that long only its beginning and a last \r matter
            del self.line[STEP // 2 : -1]
        return None


class _Digest:
    """Checks a labelled digest, base32 or hexadecimal, as bytes come in; labels it can't check pass."""

    def __init__(self, label: str | None) -> None:
        kind, _, self.value = (label or "").partition(":")
        self.hash = hashlib.new(kind.lower().replace("-", "")) if kind.lower().replace("-", "") in ("sha1", "sha256", "sha512", "md5") else None

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def fails(self) -> bool:
        if not self.hash:
            return False
        raw = self.hash.digest()
        return self.value.rstrip("=").upper() != base64.b32encode(raw).decode().rstrip("=") and self.value.lower() != raw.hex()


def _number(x: str | None) -> int | None:
    n = (x or "").removeprefix("<urn:page:").removesuffix(">")
    return int(n) if x and x.startswith("<urn:page:") and n.lstrip("-").isdigit() and -(1 << 63) <= int(n) < 1 << 63 else None


def _record(data: _Bytes, with_payload: bool) -> tuple:
    version, head = _fields(data.head(b"WARC/"))
    if not version.startswith("WARC/"):
        raise Damage("no WARC header")
    if not (length := head.get("content-length", "")).isdigit():
        raise Damage("no Content-Length")
    kind, size = head.get("warc-type"), int(length)
    label = head.get("warc-payload-digest")
    block, payload, own = _Digest(head.get("warc-block-digest")), _Digest(label), hashlib.sha1()
    http = _HttpHead() if head.get("content-type", "").lower().startswith("application/http") else None
    kept, got, n, inside = [], 0, 0, http is not None
    for part in data.take(size):
        got += len(part)
        block.update(part)
        if inside:
            rest = http.feed(part)
            if rest is None:
                continue
            part, inside = rest, False
        n += len(part)
        payload.update(part)
        own.update(part)
        if with_payload:
            kept.append(part)
    said = http.length if http and not inside else None
    tail = b"".join(data.take(4))
    revisit = kind == "revisit"
    problem = None
    if got != size or tail != b"\r\n\r\n":
        problem = "framing"
    elif block.fails():
        problem = "block digest"
    elif not revisit and (payload.fails() or said is not None and said.isdigit() and int(said) != n):
        problem = "payload digest"
    digest = label.removeprefix("sha1:") if label else None if revisit else base64.b32encode(own.digest()).decode()
    bytes_ = (int(said) if said and said.isdigit() else None) if revisit else n
    url = head.get("warc-target-uri")
    names = head.get("warc-record-id"), head.get("warc-refers-to")
    body = b"".join(kept) if with_payload and not revisit else None
    return _number(names[0]), None if url is None else _plain(url), kind, _number(names[1]) if revisit else None, bytes_, digest, body, problem, *names


def _next_member(stream: BinaryIO, at: int) -> int | None:
    """Where the next bytes that may begin a gzip member stand."""
    stream.seek(at)
    before = b""
    while part := stream.read(STEP):
        seen = before + part
        if (i := seen.find(b"\x1f\x8b\x08")) >= 0:
            return at - len(before) + i
        at += len(part)
        before = seen[-2:]
    return None


def read_records(archive: BinaryIO | bytes, with_payload: bool = True, step: int = STEP) -> Iterator[tuple]:
    """The values of ``RECORDS`` for each record; problem names what is damaged or didn't verify."""
    stream = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    at: int | None = 0
    damaged = False
    while at is not None:
        stream.seek(at)
        if not stream.read(1):
            return
        member = Member(stream, at, step)
        data = _Bytes(member)
        try:
            while not data.at_end():
                yield _record(data, with_payload)
                damaged = False
            at = member.end
        except Damage as e:
            if not damaged:  # what follows is the same damage until a record is found
                yield (*(None,) * 7, str(e), None, None)
            damaged = True
            at = _next_member(stream, at + 1)


def _archives(limit: int):
    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["archive"])

        for batch in batches:
            for page, url, html, first, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
                record = write_record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), first.as_py(), revisit.as_py())
                held.append(record)
                size += len(record)
                if size >= limit:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _one_response(rows: DataFrame) -> DataFrame:
    """Rows that repeat the id and payload of their group's response: one, of the smallest URL, is the response, the others are revisits.

    Rows equal in all three can't be told apart, so they are counted and written as often as they came.
    """
    each = rows.groupBy("digest", "page_id", "first", "url").agg(F.count("*").alias("n"), F.max("html").alias("html"))
    best = each.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url"))["url"].alias("best"))
    each = each.join(best, "digest").withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    return each.withColumn("revisit", ~((F.col("copy") == 1) & F.col("url").eqNullSafe(F.col("best"))))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, limit: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row; files of about ``limit`` bytes below ``path``."""
    ship(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    # Payloads that several pages share, merged before the shuffle. The pages themselves move only if those are many;
    # that join splits a payload that very many share.
    by_id = rows.filter(F.col("size") >= min_revisit).groupBy("digest", "page_id").agg(F.count("*").alias("twins"))
    groups = by_id.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("twins").alias("n"), F.sum(F.when(F.col("page_id").isNull(), F.col("twins"))).alias("of_none"), F.min_by("twins", "page_id").alias("twins"))
    groups = groups.filter("n > 1").select("digest", "first", F.coalesce("twins", "of_none").alias("twins"))
    groups = stored(groups, "copies")
    n, several = groups.agg(F.count("*"), F.count_if(F.col("twins") > 1)).first()
    joined = rows.join(F.broadcast(groups) if n <= FEW else groups, "digest", "left")
    copy = (F.col("size") >= min_revisit) & F.col("twins").isNotNull()
    named = copy & F.col("page_id").eqNullSafe(F.col("first"))
    if several:
        joined = joined.withColumn("again", F.coalesce(named & (F.col("twins") > 1), F.lit(False)))
        written = ["page_id", "url", "html", "first", "revisit"]
        twins = _one_response(joined.filter("again")).select(*written)
        joined = joined.filter("NOT again").withColumn("revisit", F.coalesce(copy & ~named, F.lit(False))).select(*written).unionByName(twins)
    else:
        joined = joined.select("page_id", "url", "html", "first", F.coalesce(copy & ~named, F.lit(False)).alias("revisit"))
    archives = joined.mapInArrow(_archives(limit), "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").option("compression", "none").text(path)


def read_archives(spark, path: str, with_payload: bool = True, pattern: str = "part-*", opener: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """A row for each record of the files below ``path``.

    Files are read from an open handle, a step at a time: those of a file system that is mounted, or
    of any other by ``opener`` (which executors call with the file's URI). Without it, files that
    only Spark can read come whole, so they must be smaller than 2 GB and fit in memory.
    """
    ship(spark)
    fields = [c.split() for c in RECORDS.split(", ")]
    by_path = opener is not None or urlparse(path).scheme in ("", "file")
    open_file = opener or (lambda uri: open(unquote(urlparse(uri).path), "rb"))

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

        for batch in batches:
            for one in batch.column(0):
                rows, size = [], 0
                with open_file(one.as_py()) if by_path else io.BytesIO(one.as_py()) as stream:
                    for row in read_records(stream, with_payload):
                        size += len(row[6] or b"")
                        rows.append(row)
                        if len(rows) == 10_000 or size > STEP * 256:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path" if by_path else "content").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read those back; ``clear_scratch`` removes the archives."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, with_payload=False).drop("payload")
