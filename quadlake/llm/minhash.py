"""Near-duplicate detection by DartMinHash signatures of word shingle sets and exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, joined_hot, materialize, numbered, placed, stable, without
from .hashing import _P, mix64, span_hashes

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 20, 4, 0.8
_PIECE = 1_000_000
#: Members of a bucket's part, which meet in one task, and centres that all parts of a bucket share.
_PART, _CENTRES = 256, 8


def word_hashes(texts: list[str]):
    """64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of the texts, and the number of its text."""
    import numpy as np

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    h = span_hashes(b, start, end)
    first = np.cumsum([1] + [len(r) + 1 for r in raw])[:-1]
    return h, np.searchsorted(first, start, side="right") - 1


def shingle_sets(texts: list[str], size: int = SHINGLE) -> Iterator[tuple]:
    """(sorted distinct shingle hashes, their counts) of each text. A text of fewer words is one shingle; without words none."""
    import numpy as np

    h, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    factor = [np.uint64(pow(_P, 3 * k + 5, 1 << 64)) for k in range(size)]
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        w = h[a:z]
        if len(w) >= size:
            s = w[: len(w) - size + 1] * factor[0]
            for k in range(1, size):
                s = s + w[k : len(w) - size + 1 + k] * factor[k]
        elif len(w):
            s = np.array([sum(int(x) * int(f) for x, f in zip(w, factor)) + len(w) & (1 << 64) - 1], dtype=np.uint64)
        else:
            s = w
        yield np.unique(mix64(s), return_counts=True)


@lru_cache(maxsize=64)
def _poisson(area: float):
    """Cumulative chances of 0, 1, 2, ... darts in a region."""
    import numpy as np

    most = int(area + 12 * math.sqrt(area) + 30)
    logs = np.array([-area + k * math.log(area) - math.lgamma(k + 1) for k in range(most)])
    return np.cumsum(np.exp(logs))


def dart_signatures(elements, weights, owner, documents: int, k: int):
    """DartMinHash: an array of documents x k dart ids; two documents agree in a coordinate with the chance of their weighted Jaccard similarity.

    Every element has one endless plane of darts, made from its hash: across it goes weight, up it goes rank. A document
    sees the darts left of the element's weight. Each dart names a coordinate; of a coordinate's darts the one of least
    rank counts. Darts are thrown by regions (doubling widths of weight and rank), lowest ranks first, until every coordinate
    has one: about k ln k + 2k darts a document, however many elements it has, and all documents see the same darts.
    """
    import numpy as np

    sig, rank = np.zeros((documents, k), dtype=np.uint64), np.full((documents, k), np.inf)
    total = np.bincount(owner, weights=weights, minlength=documents)
    reach = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-9), 0)
    open_docs = total > 0
    level, low, high = 0, 0.0, 1 / 16
    with np.errstate(over="ignore"):
        while open_docs.any():
            use = open_docs[owner]
            e, w, o = elements[use], weights[use], owner[use]
            cell, left, right = 0, 0.0, 1.0
            while True:
                inside = w > left
                if not inside.any():
                    break
                e, w, o = e[inside], w[inside], o[inside]
                seed = mix64(e + np.uint64((level * 64 + cell + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))
                count = np.searchsorted(_poisson((right - left) * (high - low)), (seed >> np.uint64(11)) * 2.0**-53)
                at = np.flatnonzero(count)
                many = count[at]
                which = np.repeat(at, many)
                number = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                dart = mix64(seed[which] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
                x = left + (mix64(dart ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)) * 2.0**-53 * (right - left)
                seen = x < w[which]
                dart, own = dart[seen], o[which][seen]
                r = low + (mix64(dart ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(11)) * 2.0**-53 * (high - low)
                place = own * k + ((dart >> np.uint64(7)) % np.uint64(k)).astype(np.int64)
                order = np.argsort(-r, kind="stable")
                place, r, dart = place[order], r[order], dart[order]
                best_r, best = np.full(documents * k, np.inf), np.zeros(documents * k, dtype=np.uint64)
                best_r[place], best[place] = r, dart  # of equal places the last one stays: the least rank
                better = best_r < rank.ravel()
                rank.ravel()[better], sig.ravel()[better] = best_r[better], best[better]
                cell, left, right = cell + 1, right, right * 2
            open_docs &= (high < reach) | np.isinf(rank).any(axis=1)
            level, low, high = level + 1, high, high * 2
    return sig


def sketch(texts: list[str], bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE):
    """For each text: shingles, two 64-bit hashes of the shingle set, a hash for each band, and a byte for each coordinate, of bits that do not tell the coordinate. Every shingle has weight 1, as links are defined on sets."""
    import numpy as np

    sets = list(shingle_sets(texts, size))
    n = np.array([len(s) for s, _ in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    elements = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, dtype=np.uint64)
    sig = dart_signatures(elements, np.ones(len(elements)), owner, len(texts), bands * rows)
    with np.errstate(over="ignore"):
        band = np.zeros((len(texts), bands), dtype=np.uint64)
        for r in range(rows):
            band = mix64(band * np.uint64(_P) + sig[:, r::rows])
        one = [int(s.sum()) for s, _ in sets]
        two = [int(np.bitwise_xor.reduce(mix64(s + np.uint64(99)))) if len(s) else 0 for s, _ in sets]
    return n, np.array(one, dtype=np.uint64), np.array(two, dtype=np.uint64), band, (sig >> np.uint64(48)).astype(np.uint8).view(np.int8)


def _batches(texts: list[str | None]) -> Iterator[list[str]]:
    some: list[str] = []
    size = 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= _PIECE:
            yield some
            some, size = [], 0
    if some:
        yield some


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """row, doc_id, n_shingles, s1, s2 (of the shingle set), bands and bytes (of the signature) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            parts = [sketch(t, bands, rows, size) for t in _batches(b.column(2).to_pylist())]
            n, one, two, band, byte = (np.concatenate([p[i] for p in parts]) for i in range(5))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (band.astype(np.int64), byte)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64)), *lists], names=["row", "doc_id", "n_shingles", "s1", "s2", "bands", "bytes"])

    source = placed(stable(docs), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t")).select("row", "doc_id", "_t")
    return source.mapInArrow(run, "row long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, bytes array<tinyint>")


def shingles_of(docs: DataFrame, wanted: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """row and sorted shingles of the rows of docs, which must be stable(), that `wanted` (row) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            at = 0
            for texts in _batches(b.column(1).to_pylist()):
                sets = [s.astype(np.int64) for s, _ in shingle_sets(texts, size)]
                ends = np.cumsum([0] + [len(s) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), lists], names=["row", "shingles"])
                at += len(texts)

    rows = placed(docs, F.col(text).alias("_t")).select("row", "_t")
    # merge: what is wanted grows with the corpus and is not broadcast, however small Spark takes it for
    return rows.join(wanted.select(F.col("row").alias("_w")).hint("merge"), F.col("row") == F.col("_w"), "left_semi").mapInArrow(run, "row long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) of the nodes in edges (a, b), by hooking to the least neighbour and pointer jumping."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = joined(both.withColumnRenamed("b", "node"), labels, ["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = joined(labels, near, ["node"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = joined(new, far, ["label"], "left").select("node", "old", F.least("label", "next").alias("label"))
        new = materialize(new, "labels")
        labels, changed = new.select("node", "label"), new.where("label <> old")
        if changed.isEmpty():
            return labels


def _agreement(a, b, least: int):
    """In how many coordinates each row of a agrees with each row of b; 0 where these are fewer than least."""
    import numpy as np

    agree = np.zeros((len(a), len(b)), dtype=np.int16)
    for c in range(a.shape[1]):
        agree += a[:, c, None] == b[None, :, c]
    agree[agree < least] = 0
    return agree


def _centre(block: dict, ids: tuple, least: int):
    """Key, node and score of the member that agrees most with all others."""
    import numpy as np

    agree = _agreement(block["bytes"], block["bytes"], least)
    np.fill_diagonal(agree, 0)
    total = agree.sum(axis=1)
    k = int(total.argmax())
    return np.array([ids[0]], dtype=np.int64), block["node"][k : k + 1], np.array([total[k] / len(total)])


def _bucket_choice(block: dict, least: int):
    """For each member that one of the bucket's centres or its own part's whose signature agrees most with it, in `least` coordinates or more: node, other, agree."""
    import numpy as np

    node, centre = block["node"], block["centre"].copy()
    agree = _agreement(block["bytes"], block["bytes"], least)
    agree[node[:, None] == node[None, :]] = 0
    centre[agree.sum(axis=1).argmax()] = True
    agree = agree[:, centre]
    best = agree.argmax(axis=1)
    value = agree[np.arange(len(node)), best]
    found = value > 0
    return node[found], node[centre][best[found]], value[found].astype(np.int32)


def _open_members(block: dict, ids: tuple, least: int, rows: int):
    """Members of a block that may link to one of another label: key, _i, _j, side, node, label. A pair counts in the first band that it shares, by the
    bands' own hashes: it has met there."""
    import numpy as np

    side, node, label, byte, band, bands = (block[c] for c in ("side", "node", "label", "bytes", "band", "bands"))
    one, two = (np.flatnonzero(~side), np.flatnonzero(side)) if ids[1] != ids[2] else (np.arange(len(node)),) * 2
    fits = label[one][:, None] != label[two][None, :]
    if fits.any():
        agree, shared = np.zeros(fits.shape, dtype=np.int16), np.zeros(fits.shape, dtype=bool)
        for b in range(byte.shape[1] // rows):
            for c in range(b * rows, (b + 1) * rows):
                agree += byte[one, c][:, None] == byte[two, c][None, :]
            if b < band[0]:
                shared |= bands[one, b][:, None] == bands[two, b][None, :]
        fits &= (agree >= least) & ~shared
    keep = np.zeros(len(node), dtype=bool)
    keep[one[fits.any(axis=1)]] = True
    keep[two[fits.any(axis=0)]] = True
    k = int(keep.sum())
    return (*(np.full(k, x) for x in ids), side[keep], node[keep], label[keep])


def _linked_members(node, side, label, sets, one_part: bool, threshold: float):
    """Edges that join members of a block whose sets are as similar as the threshold: all intersections at once, as products of 0/1 matrices."""
    import numpy as np

    n = np.array([len(x) for x in sets])
    words, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(words, return_inverse=True, return_counts=True)
    use = count[column] > 1
    column, owner = np.unique(column[use], return_inverse=True)[1], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    one, two = (np.arange(len(sets)),) * 2 if one_part else (np.flatnonzero(~side), np.flatnonzero(side))
    common, width, low = np.zeros((len(one), len(two)), dtype=np.float64), 4096, 0
    while len(column) and low <= column[-1]:
        a, z = np.searchsorted(column, (low, low + width))
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[a:z], column[a:z] - low] = 1
        common += has[one] @ has[two].T
        low += width
    similar = (common >= threshold * (n[one][:, None] + n[two][None, :] - common)) & (label[one][:, None] != label[two][None, :])
    x, y = np.nonzero(similar)
    x, y = one[x], two[y]
    least = np.arange(len(sets))  # each member's least known member of its component
    while len(x):
        low_of = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low_of)
        np.minimum.at(new, y, low_of)
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(sets)))
    a, b = node[moved], node[least[moved]]
    return np.minimum(a, b), np.maximum(a, b)


def _in_blocks(rows: DataFrame, key: list[str], columns: list[str], run, schema: str) -> DataFrame:
    """run(block, key) for each group of rows with equal key, a block being a dictionary of arrays; blocks must be of bounded size."""
    names = [x.split()[0] for x in schema.split(", ")]

    def array(t: pa.Table, c: str):
        import numpy as np

        x = t.column(c).combine_chunks()
        if c == "shingles":
            ends, flat = x.offsets.to_numpy(), x.values.to_numpy()
            out = np.empty(len(x), dtype=object)
            for k in range(len(x)):
                out[k] = flat[ends[k] : ends[k + 1]]
            return out
        return x.flatten().to_numpy().reshape(t.num_rows, -1) if c in ("bytes", "bands") else x.to_numpy(zero_copy_only=False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def found(t: pa.Table) -> pa.RecordBatch:
            arrays, ids = {c: array(t, c) for c in columns}, [t.column(c).to_numpy() for c in key]
            edge = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
            out = [run({c: v[f:e] for c, v in arrays.items()}, tuple(x[f] for x in ids)) for f, e in zip([0, *edge.tolist()], [*edge.tolist(), t.num_rows])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

        kept: list[pa.RecordBatch] = []  # a block that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*kept, batch])
            last = [t.column(c)[-1].as_py() for c in key]
            at = int(np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(key, last)]).argmax())
            if at:
                yield found(t.slice(0, at))
            kept = t.slice(at).to_batches()
        if kept:
            yield found(pa.Table.from_batches(kept))

    dealt = rows.select(*key, *columns).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(work, schema)


def _parted(members: DataFrame) -> DataFrame:
    """Buckets (key, n, node, ...) dealt into parts `_p` of about _PART members."""
    return members.withColumn("_p", F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("n") / F.lit(_PART))).cast("int"))


def _parts_of(n: str = "n"):
    return F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / F.lit(_PART)).cast("int") - 1))


def _centre_pairs(members: DataFrame, least: int, most: int = 3) -> DataFrame:
    """a < b: each node with the centres that agree most with it, one of each bucket (key, n, node, bytes), `most` in all. The members that agree most
    in their parts compete for being centres of their bucket, and these are put into all of its parts."""
    dealt = _parted(members).withColumn("centre", F.lit(False))
    big = dealt.where(F.col("n") > _PART)
    best = _in_blocks(big, ["key", "_p"], ["node", "bytes"], lambda b, ids: _centre(b, ids, least), "key long, node long, score double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "node"))
    best = materialize(best.withColumn("_k", rank).where(F.col("_k") <= _CENTRES).select(F.col("key").alias("_key"), F.col("node").alias("_c")), "centres")
    if not best.isEmpty():
        copies = big.join(best.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("node") == F.col("_c"))).drop("_key", "_c").withColumn("centre", F.lit(True))
        dealt = dealt.unionByName(copies.withColumn("_p", _parts_of()))
    found = _in_blocks(dealt, ["key", "_p"], ["node", "bytes", "centre"], lambda b, _: _bucket_choice(b, least), "node long, other long, agree int")
    # a node has one choice in each of its buckets, a centre one more for each part, so that no window is large
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("agree"), "other"))
    found = found.distinct().withColumn("_k", rank).where(F.col("_k") <= most)
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _remaining_links(now: DataFrame, sets: DataFrame, least: int, rows: int, threshold: float) -> DataFrame:
    """a < b: edges for all links between labels in the buckets of now (key, n, band, node, label, bytes, bands), all of which hold several labels.

    Parts of a bucket meet in blocks; signatures tell which members may link to another label, and only these bring their sets.
    """
    q = _parted(now).withColumn("_q", _parts_of())
    met = q.withColumn("_i", F.least("_p", "_q")).withColumn("_j", F.greatest("_p", "_q")).withColumn("side", F.col("_p") > F.col("_q"))
    members = "key long, _i int, _j int, side boolean, node long, label long"
    open_ = _in_blocks(met, ["key", "_i", "_j"], ["side", "node", "label", "bytes", "band", "bands"], lambda b, ids: _open_members(b, ids, least, rows), members)
    open_ = materialize(open_, "open")
    own = sets.withColumnRenamed("row", "node").hint("merge")
    run = lambda b, ids: _linked_members(b["node"], b["side"], b["label"], list(b["shingles"]), ids[1] == ids[2], threshold)
    return _in_blocks(joined(open_, own, ["node"]), ["key", "_i", "_j"], ["side", "node", "label", "shingles"], run, "a long, b long").distinct()


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets are similar."""
    side = lambda key, name: sets.select(F.col("row").alias(key), F.col("shingles").alias(name)).hint("merge")
    found = joined(joined(pairs, side("a", "x"), ["a"]), side("b", "y"), ["b"]).withColumn("_i", F.size(F.array_intersect("x", "y")))
    return found.where(F.col("_i") >= F.lit(threshold) * (F.size("x") + F.size("y") - F.col("_i"))).select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: row, doc_id, class_id, class_size, kept.

    Linked texts have five-word shingle sets of Jaccard similarity `threshold` or more; classes are the components of the links,
    class_id is the least doc_id in one, whose (first) row is kept. Texts of equal shingle sets are one node. Nodes meet
    in bands of DartMinHash signatures; a pair of similarity 0.8 misses all 20 bands of 4 with a chance of 3 in 100,000.
    Every link comes from an exact check of both sets. First each node is checked with up to three centres of its buckets. In
    buckets that then hold several classes, all members of different classes whose signatures agree in `least` coordinates are checked, four
    standard deviations below what a pair at the threshold agrees in (3 in 100,000 are lost): blocks of parts of a bucket
    compare their sets by matrix products, and give edges of a spanning forest, never pairs.
    Null and wordless texts are never linked. A text of fewer than five words is one shingle. Null doc_id sorts last. Other
    columns of docs are ignored. Repeated rows are copies of each other. An empty table gives an empty result.
    """
    docs = stable(docs)
    all_rows = materialize(signatures(docs, text, doc_id, bands, rows, size), "signatures")
    shingled = all_rows.where("n_shingles > 0")
    nodes = shingled.groupBy("n_shingles", "s1", "s2").agg(F.min_by(F.struct("bands", "bytes"), "row").alias("_s"), F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.select("n_shingles", "s1", "s2", "node", "copies", "_s.bands", "_s.bytes"), "nodes")
    members = nodes.select("node", "bytes", F.posexplode("bands").alias("band", "key")).withColumn("key", F.xxhash64("key", "band"))
    shared = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = materialize(joined_hot(members, shared, ["key"], "n", bands * nodes.count()), "buckets")
    sets = materialize(shingles_of(docs, members.select(F.col("node").alias("row")).distinct(), text, size), "sets")
    least = int(bands * rows * threshold - 4 * math.sqrt(bands * rows * threshold * (1 - threshold)))
    links = materialize(_checked(materialize(_centre_pairs(members, least), "candidates"), sets, threshold), "links")
    labels = None if links.isEmpty() else components(links)
    now = members.withColumn("label", F.col("node"))
    if labels is not None:
        now = joined(members, labels.hint("merge"), ["node"], "left").withColumn("label", F.coalesce("label", "node"))
    now = materialize(_parted(now), "labelled")
    mixed = now.groupBy("key", "_p").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("n").alias("n"))
    mixed = mixed.groupBy("key").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.first("n").alias("n")).where("x <> y")
    now = joined(now, mixed.select("key", _parts_of().alias("_p")).hint("merge"), ["key", "_p"], "left_semi").drop("_p")
    now = joined(now, nodes.select("node", "bands").hint("merge"), ["node"])
    more = materialize(_remaining_links(now, sets, least, rows, threshold), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "node long, label long")
    of_set = joined(nodes.select("n_shingles", "s1", "s2", "node", "copies"), labels, ["node"], "left").select("n_shingles", "s1", "s2", "copies", F.coalesce("label", "node").alias("label"))
    found = joined_hot(shingled.drop("bands", "bytes"), materialize(of_set, "sets_labelled"), ["n_shingles", "s1", "s2"], "copies", all_rows.count()).select("row", "doc_id", "label")
    found = materialize(found.unionByName(all_rows.where("n_shingles = 0").select("row", "doc_id", F.col("row").alias("label"))), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("class_id"), F.col("row").alias("keep"))).alias("first")
    classes = found.groupBy("label").agg(first, F.count(F.lit(1)).alias("class_size")).select("label", "first.class_id", "first.keep", "class_size")
    out = joined_hot(found, materialize(classes, "class_sizes"), ["label"], "class_size", all_rows.count())
    return out.select("row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("keep")).alias("kept"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class of near_duplicates; columns unchanged, whatever their names.

    Null, empty and wordless texts stay. Of repeated rows one stays. An empty table gives an empty result.
    """
    docs = stable(docs)
    return without(numbered(docs), near_duplicates(docs, **options).where("NOT kept"))
