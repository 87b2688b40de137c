"""Legacy archives to WARC: ARC header lines are read by the version their file declares, bodies by their declared
length; the WARC identifiers, timestamps, types and digests they lack are derived from them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import BATCH_BYTES, materialize, need_integral, released, shared_dir, within_bounds
from newsloom.session import ship

#: Fixed values of the two ARC versions: the fields of a URL record, in order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed values of WARC 1.1.
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: Payloads shorter than this are never replaced by a revisit.
REVISIT_LEAST = 1000
#: Compressed bytes after which an archive file is closed: a file holds this much, or one record more.
FILE_BYTES = 16 << 20
#: Where the pages have no capture time of their own.
ARC_DATE = "20240101000000"
ID_HEADER = "X-Page-Id"


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 newsloom\n{ARC_FIELDS[version]}\n"
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n{body}".encode()


def arc_record(version: int, url: str, page_id, payload: bytes, offset: int, name: str, date: str) -> bytes:
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "urn:page:none"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if page_id is None else f"{ID_HEADER}: {page_id}\r\n") + f"Content-Length: {len(payload)}\r\n\r\n"
    doc = http.encode() + payload
    middle = "" if version == 1 else f" 200 {hashlib.md5(doc).hexdigest()} - {offset} {name}"
    return f"\n{url} 0.0.0.0 {date} text/html{middle} {len(doc)}\n".encode() + doc


#: A header line: what stands before it, and any fields that end in a length.
HEADER = re.compile(rb"(?:^|\n)([^\s][^\n]* [0-9]+)\r?\n")


def parse_arc(data: bytes, problems: list[tuple[int, str]] | None = None) -> Iterator[dict]:
    """Records of an ARC file; URL, IP, date, type and body. The version line in the file's first block says which fields a header line has.

    A URL with blanks keeps them: the fields are counted from the end of the line. What can't be read raises ValueError; with a
    list of problems it is noted there, as (byte, reason), and passed over up to the next line that can be a header.
    """

    def refuse(at: int, reason: str) -> None:
        if problems is None:
            raise ValueError(f"{reason} at byte {at}")
        problems.append((at, reason))

    try:
        at = data.index(b"\n") + 1
        length = int(data[:at].split()[-1])
        names = ARC_FIELDS[int(data[at : at + length].split(b" ", 1)[0])].split()
    except (ValueError, IndexError, KeyError):
        return refuse(0, "no ARC version block")
    at += length
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        values = data[at : max(end, at)].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
        if end < 0 or len(values) != len(names) or not values[0] or not values[-1].isascii() or not values[-1].isdigit():
            refuse(at, f"header line with {len(values)} of {len(names)} fields")
            following = HEADER.search(data, max(end, at))
            if end < 0 or not following:
                return
            at = following.start(1)
            continue
        fields = dict(zip(names, values))
        n = int(fields["Archive-length"])
        if end + 1 + n > len(data):
            refuse(at, f"record declares {n} bytes; the file ends earlier,")
            return
        yield fields | {"body": data[end + 1 : end + 1 + n]}
        at = end + 1 + n


def arc_files(frames: Iterator[pd.DataFrame]) -> Iterator[bytes]:
    """ARC files of pages (k, u, h); versions 1 and 2 in turn. A file holds some MB at most, or one page."""
    number = 0
    for frame in frames:
        parts, size = [], 0
        for i, (k, u, h) in enumerate(zip(frame["k"], frame["u"], frame["h"])):
            if not parts:
                number += 1
                version, name = 1 + number % 2, f"newsloom-{number}.arc"
                parts, size = [arc_head(version, name, ARC_DATE)], 0
            parts.append(arc_record(version, u, k, (h or "").encode(), size, name, ARC_DATE))
            size += len(parts[-1])
            if size >= BATCH_BYTES or i == len(frame) - 1:
                yield b"".join(parts)
                parts = []


def page_rows(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    ship(pages.sparkSession)
    return pages.select(pages[key].cast("string").alias("k"), pages[url].alias("u"), pages[html].alias("h"))


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Legacy archives, one file's bytes a row (column content)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in arc_files(frames):
            yield pd.DataFrame({"content": [content]})

    return page_rows(pages, key, url, html).mapInPandas(released(batches), "content binary")


# --- ARC records as WARC ------------------------------------------------------------------------------------------


def record_id(page_id: int | None, text: str = "") -> str:
    """A version-8 UUID that holds the page's number, so that a rerun gives the same one; version 5 of text without a number."""
    if page_id is None:
        return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}"
    n = page_id & (1 << 64) - 1
    return f"urn:uuid:{uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | 2 << 62 | n & 0xFFFF)}"


def page_of(identifier: str) -> int | None:
    u = uuid.UUID(identifier.strip("<>")[9:])
    if u.version != 8:
        return None
    n = (u.int >> 80) << 16 | u.int & 0xFFFF
    return n - (1 << 64) if n >> 63 else n


def split_http(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    head, _, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head, payload, {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}


def arc_problems(arcs: DataFrame) -> DataFrame:
    """at, reason: what arc_to_records() passes over in the ARC files in column content; null and empty files have one problem each."""
    ship(arcs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple[int, str]] = []
            for content in frame["content"]:
                for _ in parse_arc(content or b"", found):
                    pass
            yield pd.DataFrame(found, columns=["at", "reason"])

    return arcs.select("content").mapInPandas(released(batches), "at long, reason string")


def warc_date(d: str) -> str:
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


#: Columns of a record: its page, its place, its HTTP head and body, the body's SHA-1 in hex.
RECORD = {"page_id": "long", "uri": "string", "date": "string", "head": "binary", "payload": "binary", "digest": "string", "payload_bytes": "long"}
NARROW = ("page_id", "digest", "payload_bytes")


def record_frames(contents: Iterator[bytes | None], kept: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """The kept columns of the records of ARC files, a frame a file."""
    for content in contents:
        rows = []
        for r in parse_arc(content or b"", []):
            head, payload, fields = split_http(r["body"])
            number = fields.get(ID_HEADER.lower(), "")
            page = int(number) if re.fullmatch("-?[0-9]{1,19}", number) else None
            rows.append((page, r["URL"], warc_date(r["Archive-date"]), head, payload, hashlib.sha1(payload).hexdigest(), len(payload)))
        if rows:
            yield pd.DataFrame(rows, columns=list(RECORD)).astype({"page_id": "Int64"})[list(kept)]


def schema_of(kept: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {RECORD[c]}" for c in kept)


def arc_to_records(arcs: DataFrame, kept: tuple[str, ...] = tuple(RECORD)) -> DataFrame:
    """One row per record of the ARC files in column content, with the kept columns of RECORD. Malformed records are passed
    over (see arc_problems); a record without a page's number has a null page_id."""
    ship(arcs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return record_frames((c for f in frames for c in f["content"]), kept)

    return arcs.select("content").mapInPandas(released(batches), schema_of(kept))


def pages_to_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", kept: tuple[str, ...] = tuple(RECORD)) -> DataFrame:
    """arc_to_records() of pages_to_arc(), in one Python worker instead of two."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return record_frames(arc_files(frames), kept)

    return page_rows(pages, key, url, html).mapInPandas(released(batches), schema_of(kept))


def revisits(records: DataFrame, least: int = REVISIT_LEAST, salts: int = 16) -> DataFrame:
    """page_id, refers_to: of records with equal payloads of at least `least` bytes, all refer to that with the largest page_id."""
    narrow = records.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest", "payload_bytes")
    groups = narrow.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    # a digest may hold a third of all rows: its rows are dealt over the salts, its group's row is repeated for each
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    return salted.join(groups, ["digest", "payload_bytes", "salt"]).where("page_id < refers_to").select("page_id", "refers_to").distinct()


def warc_record(page_id, uri: str, date: str, head: bytes, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    block = head + b"\r\n\r\n" + (b"" if revisit else payload)
    b32 = lambda h: "sha1:" + base64.b32encode(h).decode()
    lines = [
        WARC_VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, uri)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {b32(bytes.fromhex(digest))}", f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def warc_info(date: str) -> bytes:
    block = f"software: newsloom\r\nformat: {WARC_VERSION}\r\n".encode()
    return f"{WARC_VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{record_id(None, f'info {date}')}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def member(record: bytes) -> bytes:
    """A gzip member that holds one record, or nothing."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (with refers_to) as compressed archives under path: one gzip member a record, a warcinfo record first in each file.

    Spark's text sink writes one row a file, on any file system that Spark knows and with Spark's commit protocol: a lost
    executor leaves no half archive. The sink ends a row with a separator, a zero byte here. A file ends in an empty
    member, whose last byte is zero too, so the row leaves that byte to the sink and the file's bytes are exact.
    """
    ship(records.sparkSession)
    end = member(b"")[:-1]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for frame in frames:
            ids = [None if pd.isna(x) else int(x) for x in frame["page_id"]]
            to = [None if pd.isna(x) else int(x) for x in frame["refers_to"]]
            for row in zip(ids, frame["uri"], frame["date"], frame["head"], frame["payload"], frame["digest"], to):
                if not parts:
                    parts = [member(warc_info(row[2]) + RECORD_END.encode())]
                parts.append(member(warc_record(*row) + RECORD_END.encode()))
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    yield pd.DataFrame({"file": [b"".join([*parts, end])]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"file": [b"".join([*parts, end])]})

    files = records.select("page_id", "uri", "date", "head", "payload", "digest", "refers_to").mapInPandas(released(batches), "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(n := int(fields["content-length"]))
        if len(block) != n:
            raise ValueError(f"record {fields.get('warc-record-id')} declares {n} bytes; the file ends earlier")
        yield fields, block


def read_warc(spark, path: str) -> DataFrame:
    """page_id, uri, record_type, refers_to, payload_bytes, payload_digest (of the full payload), payload (null for revisits): one row per response or revisit.

    Compressed and plain files are read, by one member or many; records of other types are passed over. A record that ends
    early or differs from its digest raises ValueError: these are the operator's own archives.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                rows, size = [], 0
                for fields, block in parse_warc(stream):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    _, payload, http = split_http(block)
                    declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if fields["warc-type"] == "response":
                        n, digest, to = len(payload), hashlib.sha1(payload).hexdigest(), None
                        if digest != declared:
                            raise ValueError(f"record {fields['warc-record-id']}: its payload differs from its digest")
                    else:
                        n, digest, to, payload = int(http["content-length"]), declared, page_of(fields["warc-refers-to"]), None
                    rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], to, n, digest, payload))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield framed(rows)
                        rows, size = [], 0
                if rows:
                    yield framed(rows)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(released(batches), "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


@within_bounds()
def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages to legacy ARC, to WARC files in the shared folder, and back: the rows of read_warc().

    A null html counts as empty, a null url as urn:page:none; white space in a URL is percent-encoded. Records with a
    null page_id are responses. Rows that repeat the kept page_id are responses too. Keys that are no integers are
    refused. Other columns are ignored; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    need_integral(pages, key)
    # which records repeat others is told from their digests, written once; payloads are converted once more to be written
    narrow = materialize(pages_to_records(pages, key, url, html, NARROW), "digests")
    path = f"{shared_dir(spark)}/newsloom-warc-{uuid.uuid4().hex}"
    write_warc(pages_to_records(pages, key, url, html).join(materialize(revisits(narrow), "revisits"), "page_id", "left"), path)
    return read_warc(spark, path)
