"""Best-two-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, hash_prefix, materialize
from .tokens import default_tokenizer, encoded


def tokenized_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 0, max_len: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of at most max_len ids: doc_id, row, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit).

    Each document's ids end with end_id. Only documents above max_len are cut; then the first piece takes the
    remainder and all others are full. Null text is empty: the end id alone. `row` tells rows with equal doc_id apart.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")
    kind = [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for d, r, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2).to_pylist(), tokenizer)):
                ids += end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n - 1) % max_len + 1 if piece == 0 else max_len
                    part = ids[4 * at : 4 * (at + length)]
                    out.append((d, r, piece, at, length, zlib.crc32(part)) + (part,) * with_ids)
                    at, piece, size = at + length, piece + 1, size + 4 * length
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kind)], schema=pa.schema(kind))
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kind)], schema=pa.schema(kind))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("_t"))
    return rows.mapInArrow(cut, "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins for counts[length] pieces of each length: [(lengths in a bin, number of such bins)].

    Best-two-fit. A bin is filled greedily, always with the longest piece that fits. If a gap is left, the bin's
    smallest piece is taken out and the two unpacked pieces that fit the widened gap most tightly are put in, when
    these fill more. The choice depends only on which lengths are left, so a bin is repeated as often as its lengths
    last; the plan costs the square of `capacity` at most, whatever the number of pieces.
    """
    import numpy as np

    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    present = [x for x in range(1, capacity + 1) if left[x]]
    bins: list[tuple[list[int], int]] = []
    while present:
        own = {}
        gap, items = capacity, []
        at = len(present) - 1
        while gap and at >= 0:
            import bisect

            at = min(at, bisect.bisect_right(present, gap) - 1)
            if at < 0:
                break
            x = present[at]
            free = int(left[x]) - own.get(x, 0)
            take = min(free, gap // x)
            if take:
                # equal pieces one after the other: each is still the longest that fits
                items += [x] * take
                own[x] = own.get(x, 0) + take
                gap -= x * take
            at -= 1
        if gap and len(items) > 1:
            small = items[-1]
            room = gap + small
            best, pair = small, None
            free = [x for x in present if x < room and left[x] > own.get(x, 0)]
            lo, hi = 0, len(free) - 1
            while lo <= hi:
                a, b = free[lo], free[hi]
                if a + b > room:
                    hi -= 1
                    continue
                if a + b > best and (a != b or left[a] - own.get(a, 0) >= 2):
                    best, pair = a + b, (b, a)
                    if best == room:
                        break
                lo += 1
            if pair:
                items.pop()
                own[small] -= 1
                for x in pair:
                    own[x] = own.get(x, 0) + 1
                    items.append(x)
                own = {x: k for x, k in own.items() if k}
        times = min(int(left[x]) // k for x, k in own.items())
        bins.append((items, times))
        for x, k in own.items():
            left[x] -= k * times
        if any(not left[x] for x in own):
            present = [x for x in present if left[x]]
    return bins


def places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[int], list[int], list[int], list[int]]]:
    """For each length the slots of its pieces, by rank: first ranks, pieces a bin, first bin, offset of the first one, length."""
    out: dict[int, tuple[list[int], list[int], list[int], list[int]]] = {}
    rank: dict[int, int] = {}
    first = 0
    for items, times in bins:
        at = 0
        for x in dict.fromkeys(items):
            k = items.count(x)
            rows = out.setdefault(x, ([], [], [], []))
            for r, v in zip(rows, (rank.get(x, 0), k, first, at)):
                r.append(v)
            rank[x] = rank.get(x, 0) + k * times
            at += k * x
        first += times
    return out


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", key: tuple[str, ...] = ("doc_id", "row", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: as few sequences of at most `capacity` as best-two-fit finds, gapless from 0.

    The driver sees one number for each length. Pieces get a rank within their length without any task holding all
    of them, and the rank alone decides the place. `pieces` must be a written table. Lengths below 1 or above
    capacity, or null, raise. An empty table gives an empty result.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError("a piece's length must be from 1 to the capacity")
    table = places(plan(counts, capacity))
    ranked = hash_prefix(pieces, [length], list(key), None, "_rank", buckets_for(sum(counts.values())))
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(table)
    columns = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        arrays = {x: [np.array(c, dtype=np.int64) for c in rows] for x, rows in shared.value.items()}
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (length, "_rank"))
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for some in np.split(order, cuts) if len(order) else []:
                x = int(lengths[some[0]])
                starts, per, first, at = arrays[x]
                k = np.searchsorted(starts, ranks[some], side="right") - 1
                n = ranks[some] - starts[k]
                sequence[some] = first[k] + n // per[k]
                offset[some] = at[k] + x * (n % per[k])
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """Tokenise and pack docs: one row for each piece, without the ids themselves (tokenized_pieces has them).

    A null text is empty: the end id alone. Texts above the capacity are cut, none is dropped. Repeated rows and null doc_ids are packed each. Other
    columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    pieces = materialize(tokenized_pieces(docs, max_len=capacity, with_ids=False, **options), "pieces")
    return pack(pieces, capacity)
