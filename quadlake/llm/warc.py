"""WARC archives in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each with some whole records, then a seek table: a skippable frame
with the compressed and decompressed size of each frame. Decompressed as a whole it is a plain WARC file. The index, a table, maps the
identifier of each record to its bundle, its frame and its place in the decompressed frame, so that one record costs one frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, joined_hot, materialize, new_path
from .planes import _fs

# Fixed values of the seekable format: magic numbers of the skippable frame that holds the table and of the table's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: The profile of a record whose payload is in another one.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in a frame, and of compressed frames in a bundle: a record or frame more is in none.
FRAME, BUNDLE = 1 << 20, 256 << 20
#: Equal payloads of fewer bytes are stored each.
LEAST_REVISITED = 100

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
_INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "record_id string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to_record string, refers_to long, payload binary"
_RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_NAME = re.compile(r"<urn:page:(-?\d*):(-?\d+)>")


class BundleWriter:
    """Writes one bundle; holds one frame and the sizes of all frames in memory."""

    def __init__(self, out, level: int = 3, frame: int = FRAME):
        import zstandard

        self.out, self.frame, self.press = out, frame, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.rest, self.sizes, self.place = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame of the record and its place there."""
        if self.rest and len(self.rest) + len(record) > self.frame:
            self.flush()
        at = len(self.sizes), len(self.rest)
        self.rest += record
        return at

    def flush(self) -> None:
        if self.rest:
            data = self.press.compress(bytes(self.rest))
            self.out.write(data)
            self.sizes.append((len(data), len(self.rest)))
            self.place += len(data)
            self.rest = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(source) -> list[tuple[int, int, int]]:
    """Place, compressed size and decompressed size of each frame of an open bundle."""
    end = source.size()
    source.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    source.seek(end - 9 - count * width)
    table, frames, place = source.read(count * width), [], 0
    for k in range(count):
        small, large = struct.unpack_from("<II", table, k * width)
        frames.append((place, small, large))
        place += small
    return frames


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    source.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(source.read(frame[1]), max_output_size=frame[2])


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def record_bytes(name: str, date: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or with refers_to a revisit record, which leaves its payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record of `data` that begins at `at`, as a row of RECORD, and where it ends. Digest and size of a stored payload are taken of its bytes."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(head["content-length"])
    body = data.index(b"\r\n\r\n", end + 4) + 4
    stop = end + 4 + size
    if data[stop : stop + 4] != b"\r\n\r\n" or body > stop:
        raise ValueError(f"a broken record at {at}")
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    row = {"record_id": head["warc-record-id"], "record_type": head["warc-type"], "url": head.get("warc-target-uri"), "refers_to_record": head.get("warc-refers-to"), "refers_to": None}
    row["page_id"] = int(x) if (x := _NAME.fullmatch(row["record_id"])[1]) else None
    if row["record_type"] == "revisit":
        x = _NAME.fullmatch(row["refers_to_record"])[1]
        http = data[end + 4 : body].decode("latin-1")
        row |= {"refers_to": int(x) if x else None, "payload": None, "payload_digest": digest, "payload_bytes": int(re.search(r"(?i)\r\ncontent-length: *(\d+)", http)[1])}
    else:
        payload = data[body:stop]
        row |= {"payload": payload, "payload_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload)}
        if row["payload_digest"] != digest:
            raise ValueError(f"a payload without its digest in {row['record_id']}")
    return row, stop + 4


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, date: str | None = None, level: int = 3, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Write one record for each row of pages; return the index: record_id, page_id, bundle (path), frame, offset (in the frame), length, folder.

    Of rows with equal payloads of LEAST_REVISITED bytes or more, the one of the least page_id (null last; of equal ones the first row) is a response
    record, the others are revisit records that refer to it; rows of shorter payloads are all response records. Payloads are taken for equal if
    length and SHA-256 agree. Null html is the empty payload; a null url leaves WARC-Target-URI out, white space and control characters in it are
    percent-encoded. Repeated rows get a record each. Other columns of pages are ignored, whatever their names. An empty
    table gives an empty index.

    Rows are numbered in a written table. Types are found by length and digest alone, hot groups by broadcast; then texts are shuffled
    once, by row number, to the tasks that write bundles. A repeated task writes bundles of other names; the index names
    only those of finished tasks.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"), "payload"), "pages")
    keys = rows.where(F.col("size") >= LEAST_REVISITED).select("row", "page_id", "size", "digest")
    order = F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    groups = keys.groupBy("size", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = materialize(groups.select("size", "digest", F.col("first.row").alias("of_row"), F.col("first.id").alias("of_page"), "copies"), "payload_groups")
    again = joined_hot(keys, groups, ["size", "digest"], "copies", rows.count()).where("row <> of_row")
    again = materialize(again.select("row", "of_row", "of_page"), "revisits")
    work = joined(rows, again.hint("merge"), ["row"], "left").select("row", "page_id", "url", "digest", "payload", "of_row", "of_page")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        writer = out = None
        for batch in batches:
            found = []
            for row, page, address, digest, payload, of_row, of_page in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is not None and writer.place >= bundle:
                    writer.close()
                    out.close()
                    writer = None
                if writer is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(path, compression=None)
                    writer = BundleWriter(out, level, frame)
                name = record_id(page, row)
                record = record_bytes(name, date, address, payload, digest, None if of_row is None else record_id(of_page, of_row))
                number, at = writer.add(record)
                found.append((name, page, path, number, at, len(record)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), _INDEX.types)], schema=_INDEX)
        if writer is not None:
            writer.close()
            out.close()

    return materialize(work.mapInArrow(write, INDEX), "warc_index").withColumn("folder", F.lit(folder))


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of an index name, read by their frames: record_id, page_id, record_type, url, payload_bytes, payload_digest, refers_to_record,
    refers_to (page_id), payload (null in revisits, and without `payloads`).

    An index row that does not lead to its record is an error. Each bundle is read by one task, each frame once; an empty index gives an empty result.
    """
    spark = index.sparkSession
    first = index.select("folder").first()
    folder = first[0] if first else None
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        path = source = table = None
        number, data = -1, b""
        for batch in batches:
            found, size = [], 0
            for name, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != path:
                    if source is not None:
                        source.close()
                    path, source, number = bundle, fs.open_input_file(bundle), -1
                    table = seek_table(source)
                if frame != number:
                    number, data = frame, read_frame(source, table[frame])
                row, end = parse_record(data, offset)
                if row["record_id"] != name or end != offset + length:
                    raise ValueError(f"the index is wrong about {name}")
                if not payloads:
                    row["payload"] = None
                found.append(row)
                size += row["payload_bytes"] if payloads else 0
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(found, schema=_RECORD)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=_RECORD)
        if source is not None:
            source.close()

    dealt = index.select("record_id", "bundle", "frame", "offset", "length").repartition(n, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(read, RECORD)


def scan_archives(bundles: DataFrame, folder: str) -> DataFrame:
    """The records of whole bundles (column `bundle`, paths in `folder`), frame after frame, without an index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as source:
                    for frame in seek_table(source):
                        data, at, found = read_frame(source, frame), 0, []
                        while at < len(data):
                            row, at = parse_record(data, at)
                            found.append(row)
                        yield pa.RecordBatch.from_pylist(found, schema=_RECORD)

    n = int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bundles.select("bundle").distinct().repartition(n, "bundle").mapInArrow(read, RECORD)
