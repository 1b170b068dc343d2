"""WARC from legacy archives: ARC records are parsed by their version's header lines and written as WARC."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import new_path

ARCHIVE_BYTES = 16 << 20  # of records in an archive file, before compression
LEAST_REVISIT = 1000  # bytes of payload from which equal payloads are revisits
BROADCAST_ROWS = 200_000  # repeated payloads up to which their table (some 40 bytes a row) is broadcast
EPOCH = datetime(2000, 1, 1)

# The record definitions of ARC versions 1 and 2.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def arc_bytes(pages: Iterable[tuple[int | None, str | None, bytes]], version: int, name: str) -> bytes:
    """One ARC file of the version: its version block, then a header line and the stored response per page."""
    definition = f"{version} {0 if version == 1 else 1} crawl\n{ARC_FIELDS[version]}\n\n".encode()
    where, when = "0.0.0.0", EPOCH.strftime("%Y%m%d%H%M%S")
    tail = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} {where} {when} text/plain{tail} {len(definition)}\n".encode(), definition]
    at = sum(map(len, out))
    for page_id, url, html in pages:
        number = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(html)}\r\n\r\n".encode() + html
        stamp = (EPOCH + timedelta(seconds=(page_id or 0) % 10**8)).strftime("%Y%m%d%H%M%S")
        target = (url or "unknown:").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
        more = f" 200 - - {at} {name}" if version == 2 else ""
        out += [f"{target} {where} {stamp} text/html{more} {len(block)}\n".encode(), block, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: the header fields that its version block defines, and ``block``.

    A header line is split from the right, as old crawlers left blanks in URLs. Declared lengths alone say
    where a record ends. A header or length that doesn't fit raises ValueError: nothing is skipped.
    """
    at, names = 0, ARC_FIELDS[1].split()
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8")
        describes = line.startswith("filedesc://")
        length = line.rpartition(" ")[2]
        if end < 0 or not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"bad ARC header at byte {at}: {line[:200]!r}")
        block = data[end + 1 : end + 1 + int(length)]
        at = end + 1 + int(length)
        if describes:
            lines = block.decode("utf-8").split("\n")
            if lines[0].split(" ")[0] not in ("1", "2") or len(lines) < 2:
                raise ValueError(f"unknown ARC version block {block[:80]!r}")
            names = lines[1].split()
            continue
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"ARC header has {len(values)} fields, not {len(names)}: {line[:200]!r}")
        yield dict(zip(names, values)) | {"block": block}


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes and payload of a stored HTTP response; other blocks are all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
    return fields, head + mark, payload


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, whichever task makes it."""
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def warc_record(url: str, ip: str, stamp: str, page_id: int | None, digest: str, block: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (headers only) of page ``refers_to``. The closing blank lines are the writer's."""
    revisit = refers_to is not None
    if revisit:
        block = http_parts(block)[1]
    date = datetime.strptime(stamp, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; blocks end where Content-Length says."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8").split("\r\n")[1:])
        start, size = end + 4, int(fields["Content-Length"])
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, data[start : start + size]
        at = start + size
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1


def _write(archives: DataFrame, path: str, line_end: str) -> str:
    """One gzipped file per row: the text sink writes the row's bytes as they are and ends them by ``line_end``."""
    rows = archives.select(F.col("archive").cast("string").alias("value"))
    rows.write.option("lineSep", line_end).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write ``pages`` as ARC files under ``path``, version 1 and 2 in turn. Null html is empty; nothing is shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size, made = [], 0, 0

        def archive() -> pa.RecordBatch:
            data = arc_bytes(held, 1 + made % 2, f"crawl-{made}.arc")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.large_binary()).cast(pa.binary())], names=["archive"])

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in range(3))):
                held.append((page_id, url, html or b""))
                size += len(held[-1][2]) + 300
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size, made = [], 0, made + 1
        if held:
            yield archive()

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    return _write(slim.mapInArrow(run, "archive binary"), path, "\n")


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """A row per record of the ARC files under ``path``: ``page_id``, ``digest`` and ``size`` of the payload, and with ``blocks`` also ``url``, ``ip``, ``stamp``, ``block``."""

    def run(batches: Iterator) -> Iterator:
        import gzip
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for r in parse_arc(gzip.decompress(content.as_buffer())):
                    fields, _, payload = http_parts(r["block"])
                    page = fields.get("X-Page-Id")
                    row = (None if page is None else int(page), hashlib.sha1(payload).hexdigest(), len(payload))
                    rows.append((*row, r["URL"], r["IP-address"], r["Archive-date"], r["block"]) if blocks else row)
                    held += len(r["block"]) if blocks else 64
                    if held >= 4 << 20:
                        yield batch_of(rows, pa)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows, pa)

    kinds = "page_id long, digest string, size long" + (", url string, ip string, stamp string, block binary" if blocks else "")

    def batch_of(rows: list[tuple], pa):
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = ["page_id", "digest", "size", "url", "ip", "stamp", "block"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names[: len(rows[0])])

    return _files(spark, path).mapInArrow(run, kinds)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least_revisit: int = LEAST_REVISIT) -> str:
    """Convert the ARC files under ``arc_path`` to gzipped WARC files under ``warc_path``.

    Of records whose payloads are equal (by SHA-1) and at least ``least_revisit`` bytes long, that with the
    largest page id is the response and others are revisits of it; smaller ones are all responses. Rows that
    repeat the largest id are all responses. A null id is never the one referred to. The digests are found
    in a first pass over the archives, without their blocks; only payloads that occur more than once are
    joined back, by broadcast while there are at most ``BROADCAST_ROWS`` of them and else by a shuffle.
    """
    again = read_arc(spark, arc_path, blocks=False).where(F.col("size") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    again = spark.read.schema(again.schema).parquet(_kept(again))
    few = again.count() <= BROADCAST_ROWS
    rows = read_arc(spark, arc_path).join(F.broadcast(again) if few else again, "digest", "left")
    rows = rows.select("page_id", "digest", "url", "ip", "stamp", "block", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last")).alias("refers_to"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], names=["archive"])

        for batch in batches:
            for page_id, digest, url, ip, stamp, block, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(warc_record(url, ip, stamp, page_id, digest, block, refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return _write(rows.mapInArrow(run, "archive binary"), warc_path, "\r\n\r\n")


def _kept(df: DataFrame) -> str:
    path = new_path(df.sparkSession, "warc-again")
    df.write.parquet(path)
    return path


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` per record of the WARC files under ``path``.

    Length and digest are those of the full payload, also for revisits, whose stored headers carry them. The
    digest of every stored payload is computed again; one that differs raises ValueError.
    """

    def run(batches: Iterator) -> Iterator:
        import gzip
        import hashlib

        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(gzip.decompress(content.as_buffer())):
                    http, _, payload = http_parts(block)
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    page, target = http.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    size = int(http["Content-Length"]) if kind == "revisit" else len(payload)
                    rows.append((None if page is None else int(page), size, digest, kind, None if target is None else int(target)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    return _files(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def pages_through_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Store ``pages`` as legacy archives, convert them to WARC and read the WARC files back: one row per page.

    Repeated rows stay rows; an empty table gives no archive and an empty table. Columns other than the three
    named are not read. Both sets of archives stand in the shared folder.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, new_path(spark, "arc"), id_col, url_col, html_col)
    return read_warc(spark, arc_to_warc(spark, arc, new_path(spark, "warc")))
