"""Token ids in binary files: fixed-size blocks, transposed to byte or bit planes, each plane compressed with zstandard.

A file is the blocks' planes one after the other, then a chunk index, then 24 bytes: the index's place and length
(little-endian 64-bit) and b"QLPLANE1". The index is zstandard-compressed JSON: ids a block, kind of planes, for each
block [place, ids, sizes of the planes], and for each document [doc_id or null, ids]. Ids of a document may lie over
several blocks.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path
from .tokens import default_tokenizer, encoded

MAGIC = b"QLPLANE1"
BLOCK = 65_536
#: Bytes of text, and 16 a document, for a file: what bounds the file and its index at every input size.
FILE_BYTES = 256 << 20
#: Documents that a Python worker is handed at a time: a whole partition's texts would else be there three times over.
BATCH = 500


def to_planes(ids: bytes, kind: str) -> list[bytes]:
    """Little-endian 32-bit ids to 4 byte planes or 32 bit planes, the low one first."""
    import numpy as np

    table = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [table[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(table, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], count: int, kind: str) -> bytes:
    import numpy as np

    if kind == "byte":
        return np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1).tobytes() if count else b""
    bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=count, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


class PlaneWriter:
    """Writes one file; holds one block of ids and the index in memory."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 1):
        import zstandard

        self.out, self.kind, self.block, self.press = out, kind, block, zstandard.ZstdCompressor(level=level)
        self.rest, self.place, self.blocks, self.docs = bytearray(), 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append([doc_id, len(ids) // 4])
        self.rest += ids
        while len(self.rest) >= 4 * self.block:
            self._flush(bytes(self.rest[: 4 * self.block]))
            del self.rest[: 4 * self.block]

    def _flush(self, ids: bytes) -> None:
        planes = [self.press.compress(p) for p in to_planes(ids, self.kind)]
        self.blocks.append([self.place, len(ids) // 4, [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.place += len(p)

    def close(self) -> None:
        if self.rest:
            self._flush(bytes(self.rest))
        index = self.press.compress(json.dumps({"block": self.block, "kind": self.kind, "blocks": self.blocks, "docs": self.docs}).encode())
        self.out.write(index)
        self.out.write(struct.pack("<QQ", self.place, len(index)) + MAGIC)


def read_index(source) -> dict:
    import zstandard

    source.seek(source.size() - 24 if callable(getattr(source, "size", None)) else -24, 0 if callable(getattr(source, "size", None)) else 2)
    place, size = struct.unpack("<QQ", (tail := source.read(24))[:16])
    if tail[16:] != MAGIC:
        raise ValueError("not a plane file")
    source.seek(place)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(size)))


def read_block(source, index: dict, k: int) -> bytes:
    """Ids of block k alone: random access by the index."""
    import zstandard

    place, count, sizes = index["blocks"][k]
    source.seek(place)
    press = zstandard.ZstdDecompressor()
    width = count if index["kind"] == "byte" else (count + 7) // 8
    return from_planes([press.decompress(source.read(n), max_output_size=width) for n in sizes], count, index["kind"])


def read_documents(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) in file order, one block in memory beside the document."""
    index = read_index(source)
    rest, k = bytearray(), 0
    for doc_id, count in index["docs"]:
        while len(rest) < 4 * count:
            rest += read_block(source, index, k)
            k += 1
        yield doc_id, bytes(rest[: 4 * count])
        del rest[: 4 * count]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 2, kind: str = "byte", block: int = BLOCK, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all docs in ascending doc_id order (null first); return the manifest: file_no, path, first_id, n_docs, n_tokens.

    Each file holds one range of documents; files follow each other in the order of file_no. There are as many as keep a file at
    about `file_bytes`, and one a shuffle partition at least. A task that is repeated
    writes a file of another name; the manifest is written once and names only files of finished tasks. Null
    text is empty: the end id alone. Equal (or null) doc_ids follow each other in the order of their texts' first 32 characters, then of a hash of the
    texts; however many they are, they may lie in many files. Other columns of docs are ignored. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder, tokenizer = folder or new_path(spark, "planes"), tokenizer or default_tokenizer()
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        writer = out = None
        docs_n = tokens = 0
        for batch in batches:
            ids_of = encoded(batch.column(1).to_pylist(), tokenizer)
            for d, no, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ids_of):
                if writer is None:
                    name, first, number = f"{root}/part-{no:05d}-{uuid.uuid4().hex}.qlp", d, no
                    out = fs.open_output_stream(name)
                    writer = PlaneWriter(out, kind, block)
                writer.add(d, ids + end)
                docs_n, tokens = docs_n + 1, tokens + len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file_no": number, "path": name, "first_id": first, "n_docs": docs_n, "n_tokens": tokens}], schema=pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(doc_id).cast("long").alias("_d"), F.col(text).alias("_t"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("_t"), F.lit(0)) + F.lit(16).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    order = ["_d", "_a", "_h", "_n"]
    rows = rows.select("_d", "_t", F.substring("_t", 1, 32).alias("_a"), F.xxhash64("_t").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    # the last key tells rows apart that are equal in all else, so that any number of them spreads over files
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions("_d", "_a", "_h", "_t")
    rows = rows.select("_d", "_t", F.spark_partition_id().alias("_p"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH)
    try:
        manifest = materialize(rows.mapInArrow(write, "file_no int, path string, first_id long, n_docs long, n_tokens long"), "manifest")
    finally:
        spark.conf.set(setting, before)
    return manifest.withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document: doc_id, start (ids before it in all files), n_tokens, ids (little-endian 32-bit integers).

    Null and equal doc_ids come back as they were written, each with its own row. An empty manifest gives an empty result. Other columns of the
    manifest than those of write_token_files are ignored.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    first = manifest.first()
    folder = first["folder"] if first else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                with fs.open_input_file(path) as source:
                    for d, ids in read_documents(source):
                        rows.append({"doc_id": d, "start": start, "n_tokens": len(ids) // 4, "ids": ids})
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size > 2_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # About one file a task: their rows are few, so that Spark would read many of them in one.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return files.repartition(parts, "file_no").select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
