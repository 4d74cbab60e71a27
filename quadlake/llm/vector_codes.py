"""Vectors as codes of codebook entries, found by annular pruning on norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this size would take sums of squares out of 64 bits.
_LARGEST = 1 << 24


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, an error where that goes beyond 24 bits."""
    whole = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * scale <= _LARGEST, whole(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))


def nearest_entries(points, entries):
    """Index of the nearest entry of each point and its squared distance; ties go to the lower index. Both arrays hold integers.

    Annular norm pruning: entries are sorted by norm. A point starts at the entry of the norm next to its own; any entry at least as near
    has a norm that differs from the point's by the best distance so far at most. So each point goes outwards from its start, one entry
    a step on either side, and a side ends where binary search put the end of the annulus that the first distance allows, or sooner where the
    best distance has shrunk below the gap of norms. What lies within the annulus, its edges included, is evaluated exactly, in integers.
    """
    import numpy as np

    n, k = len(points), len(entries)
    norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((np.arange(k), norms))
    sorted_norms, sorted_entries = norms[order], entries[order]
    mine = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
    start = np.clip(np.searchsorted(sorted_norms, mine), 0, k - 1)
    best = ((points - sorted_entries[start]) ** 2).sum(axis=1)
    index = order[start].astype(np.int64)
    # the edges are a little wider than the roots, whose last bits may be wrong
    slack = 1e-6 + 1e-9 * (mine + (sorted_norms[-1] if k else 0))
    reach = np.sqrt(best.astype(np.float64)) + slack
    low, high = np.searchsorted(sorted_norms, mine - reach, "left"), np.searchsorted(sorted_norms, mine + reach, "right") - 1
    for side, end in ((-1, low), (1, high)):
        at = np.arange(n)
        place = start.copy()
        while True:
            place = place + side
            more = place >= end[at] if side < 0 else place <= end[at]
            at, place = at[more], place[more]
            if not len(at):
                break
            gap = np.abs(sorted_norms[place] - mine[at]) - slack[at]
            more = (gap <= 0) | (gap * gap <= best[at])
            at, place = at[more], place[more]  # norms go on from here: no later entry of this side can be as near
            d, number = ((points[at] - sorted_entries[place]) ** 2).sum(axis=1), order[place]
            better = (d < best[at]) | ((d == best[at]) & (number < index[at]))
            best[at[better]], index[at[better]] = d[better], number[better]
    return index, best


def _matrix(column: pa.Array, width: int):
    """Lists as rows of a matrix, zeros after the end of short ones."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(ends), width), dtype=np.int64)
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def codebooks_digest(books: list) -> str:
    """SHA-256 of the decimal components of all entries, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def trained_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list, int]:
    """Codebooks (for each part an array of entries) of the integer vectors `_v` of a written table (vec_id, _v), and the width that vectors are padded to.

    Each round is one pass: a task assigns its parts and adds up the members of each entry, Spark adds the tasks' sums, and the
    driver gets one row for each part, entry and position, a number that doesn't depend on the table's size.
    """
    import numpy as np

    longest = vectors.agg(F.max(F.size("_v"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    step = width // parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    seeds = np.array([list(r[0]) + [0] * (width - len(r[0])) for r in first], dtype=np.int64).reshape(-1, width)
    books = [seeds[:, p * step : (p + 1) * step] for p in range(parts)]
    for _ in range(rounds if len(seeds) else 0):
        now = books

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, len(now[0]), step), dtype=np.int64), np.zeros((parts, len(now[0])), dtype=np.int64)  # noqa: B023
            for b in batches:
                v = _matrix(b.column(0), width)
                for p in range(parts):
                    x = v[:, p * step : (p + 1) * step]
                    index, _ = nearest_entries(x, now[p])  # noqa: B023
                    np.add.at(total[p], index, x)
                    count[p] += np.bincount(index, minlength=len(count[p]))
            part, entry = np.nonzero(count)
            place = np.tile(np.arange(step), len(part))
            part, entry = np.repeat(part, step), np.repeat(entry, step)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, place, total[part, entry, place], count[part, entry])], names=["part", "entry", "place", "total", "members"])

        found = vectors.select("_v").mapInArrow(sums, "part long, entry long, place long, total long, members long")
        found = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect()
        books = [b.copy() for b in books]
        for r in found:
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["members"]
    return books, width


def vector_codes(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row for each row with a usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Components become integers floor(scale * x); vectors are cut into `parts` equal parts, each with a codebook of its own: at first that part of the
    vectors of the `entries` least vec_ids (null last, ties by the vector), then for `rounds` rounds the floor of the mean of the parts
    assigned to an entry; entries that none is assigned to stay. code has two hex digits for each part's entry; error is the
    sum of squared distances of its parts, label_error its sum over the rows of the same label (null is a label, too).
    Rows whose vector is null, or has a null or non-finite component, go. Vectors shorter than the longest, or than a multiple of
    `parts`, end with zeros; empty ones are all zeros. Components beyond 2**24 after scaling are an error. With fewer rows than entries codebooks have fewer. Repeated
    rows count and come back each. Other columns are ignored. An empty table gives an empty result.
    """
    import numpy as np

    if entries > 256:
        raise ValueError("a part of the code has two hex digits")
    kept = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("_label"), F.col(vector).alias("_x")).where(usable(F.col("_x")))
    vectors = materialize(kept.select("vec_id", "_label", scaled(F.col("_x"), scale).alias("_v")), "vectors")
    books, width = trained_codebooks(vectors.select("vec_id", "_v"), parts, entries, rounds)
    digest, step = codebooks_digest(books), width // parts

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(2), width)
            found = [nearest_entries(v[:, p * step : (p + 1) * step], books[p]) for p in range(parts)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "_label", "code", "error"])

    kinds = dict(vectors.dtypes)
    coded = materialize(vectors.mapInArrow(assign, f"vec_id {kinds['vec_id']}, _label {kinds['_label']}, code string, error long"), "codes")
    labels = materialize(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label_errors")
    out = joined_hot(coded, labels, ["_label"], "_n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for vector_codes() on a table `embeddings` with unique vec_id and vectors of one length, divisible by `parts`."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT p.vec_id, p.part, e, list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{r} ON p.part = b{r}.part),
a{r} AS (SELECT vec_id, part, e, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT part, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT a{r}.part, e, unnest(y) AS x, generate_subscripts(y, 1) AS i FROM a{r} JOIN p USING (vec_id, part)) GROUP BY ALL),
m{r} AS (SELECT part, e, list(m ORDER BY i) AS c FROM s{r} GROUP BY ALL),
b{r + 1} AS (SELECT b{r}.part, b{r}.e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} ON b{r}.part = m{r}.part AND b{r}.e = m{r}.e)""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, k, part, list_slice(x, part * (len(x) // {parts}) + 1, (part + 1) * (len(x) // {parts})) AS y FROM (SELECT *, unnest(range({parts})) AS part FROM v)),
b0 AS (SELECT part, k AS e, y AS c FROM p WHERE k < {entries}),{",".join(steps)},
h AS (SELECT sha256(string_agg(t, ',' ORDER BY part, e)) AS digest FROM (SELECT part, e, array_to_string(c, ',') AS t FROM b{rounds})),
g AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT g.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM g JOIN v USING (vec_id), h"""
