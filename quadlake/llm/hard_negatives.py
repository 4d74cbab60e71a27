"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With M the largest norm, each vector x gets one more component, sqrt(M^2 - |x|^2), and an anchor q gets a zero. All rows then lie on a sphere, and
distance^2 = |q|^2 + M^2 - 2 q.x: higher inner products are smaller distances, and a window of scores is an annulus of distances around the
anchor. The upper levels of the tree come from a bounded sample and deal all rows to leaves; a leaf's rows are cut into blocks of
bounded size, and a task that holds a block makes the lower levels. Bounds on distances only skip what can't matter; every score that counts is an exact integer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, joined_hot, materialize
from .vector_codes import SCALE, _matrix, scaled, usable

#: Rows that the upper tree is fitted on, its leaves at most, and rows it aims at in a leaf.
SAMPLE, LEAVES, LEAF_ROWS = 4096, 256, 1024
#: Rows of a block, anchors that meet a block at once, and rows in a leaf of a block's tree.
BLOCK_ROWS, ANCHORS, BUCKET = 4096, 1024, 256
_LOW, _HIGH = -(1 << 62), 1 << 62


def _norms(v):
    return (v.astype("float64") ** 2).sum(axis=1)


def _exact_as_floats(q, v) -> bool:
    """Whether inner products of the rows of q and v are exact in 64-bit floating point."""
    import numpy as np

    return (int(np.abs(q).max(initial=0)) + 1) * (int(np.abs(v).max(initial=0)) + 1) * max(1, v.shape[1]) < 1 << 53


def _distances(v, at, largest: float):
    """Distances of the augmented rows of v to the augmented vector `at`."""
    import numpy as np

    mine, its = _norms(v), float(_norms(at[None])[0])
    lift = lambda n: np.sqrt(np.maximum(0.0, largest - n))
    d = mine + its - 2.0 * (v.astype(np.float64) @ at.astype(np.float64)) + (lift(mine) - lift(its)) ** 2
    return np.sqrt(np.maximum(0.0, d))


@dataclass
class Node:
    """A vantage point, with the least and greatest distance to it in either half; a leaf has none, but a number and, within a block, its rows."""

    at: object = None
    children: list = field(default_factory=list)
    reach: list = field(default_factory=list)
    radius: float = 0.0
    leaf: int = -1
    rows: object = None


def _vantage(v, largest: float):
    """Of a few rows, spread over v, the one whose distances to the others vary most."""
    import numpy as np

    picks = np.unique(np.linspace(0, len(v) - 1, 5).astype(int))
    probe = v[np.unique(np.linspace(0, len(v) - 1, 64).astype(int))]
    return v[max(picks, key=lambda k: (float(_distances(probe, v[k], largest).std()), -k))]


def upper_tree(sample, leaves: int, largest: float) -> Node:
    """Tree over a sample with about `leaves` leaves; halves by the median distance. Rows at one distance stay together."""
    count = 0

    def make(v, wanted: int) -> Node:
        nonlocal count
        if wanted > 1 and len(v) > 1:
            at = _vantage(v, largest)
            d = _distances(v, at, largest)
            radius = float(sorted(d)[len(d) // 2])
            near = d < radius
            if near.any() and not near.all():
                return Node(at, [make(v[near], wanted // 2), make(v[~near], wanted - wanted // 2)], [], radius)
        count += 1
        return Node(leaf=count - 1)

    return make(sample, leaves)


def _routed(tree: Node, v, largest: float, depth: int):
    """Leaf of each row of v, and its distances to the vantage points on its way (nan beyond them)."""
    import numpy as np

    leaf, way = np.zeros(len(v), dtype=np.int32), np.full((len(v), depth), np.nan)

    def go(node: Node, rows, level: int) -> None:
        if node.at is None:
            leaf[rows] = node.leaf
        elif len(rows):
            d = _distances(v[rows], node.at, largest)
            way[rows, level] = d
            near = d < node.radius
            go(node.children[0], rows[near], level + 1)
            go(node.children[1], rows[~near], level + 1)

    go(tree, np.arange(len(v)), 0)
    return leaf, way


def _depth(tree: Node) -> int:
    return 0 if tree.at is None else 1 + max(map(_depth, tree.children))


def block_tree(v, largest: float) -> tuple[Node, int]:
    """Tree over the rows of a block, and its number of leaves. Halves by rank, so that rows at one distance can't make it deep."""
    import numpy as np

    count = 0

    def make(rows) -> Node:
        nonlocal count
        if len(rows) <= BUCKET:
            count += 1
            return Node(leaf=count - 1, rows=rows)
        at = _vantage(v[rows], largest)
        d = _distances(v[rows], at, largest)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        parts = order[:half], order[half:]
        return Node(at, [make(rows[x]) for x in parts], [(float(d[x].min()), float(d[x].max())) for x in parts])

    return make(np.arange(len(v))), count


def _bounded(tree: Node, q, largest: float) -> list[tuple[Node, object, object]]:
    """Every node with the greatest and least score that each anchor of q can have in it."""
    import numpy as np

    mine = _norms(q)
    base, slack = mine + largest, 1e-7 * math.sqrt(largest) + 1e-6
    found: list = []

    def go(node: Node, low, high) -> None:
        more = 1e-9 * base + 1e-6
        found.append((node, (base - low * low) / 2 + more, (base - high * high) / 2 - more))
        if node.at is not None:
            d = np.sqrt(np.maximum(0.0, base - 2.0 * (q.astype(np.float64) @ node.at.astype(np.float64))))
            for child, (near, far) in zip(node.children, node.reach):
                go(child, np.maximum(low, np.maximum(d - far, near - d) - slack), np.minimum(high, d + far + slack))

    go(tree, np.zeros(len(q)), np.full(len(q), np.inf))
    return found


class BlockSearch:
    """The rows of a block, searched for one anchor at a time, nearest first. Rows are kept in the tree's order, so that a leaf is a slice."""

    def __init__(self, v, ids, rows, labels, q, largest: float):
        import numpy as np

        self.tree, _ = block_tree(v, largest)
        bounded = _bounded(self.tree, q, largest)
        self.bounds = {id(n): (best.tolist(), least.tolist()) for n, best, least in bounded}
        leaves = [n for n, _, _ in bounded if n.at is None]
        self.place = np.concatenate([n.rows for n in leaves])
        ends = np.cumsum([0] + [len(n.rows) for n in leaves]).tolist()
        for n, a, z in zip(leaves, ends, ends[1:]):
            n.rows = slice(a, z)
        self.v, self.ids, self.rows, self.labels = v[self.place], ids[self.place], rows[self.place], labels[self.place]
        self.q = q
        if _exact_as_floats(q, v):
            self.v, self.q = self.v.astype(np.float64), q.astype(np.float64)

    def opened(self, anchor: int, leaf: slice, wanted):
        """-score, id and row of the leaf's wanted rows, nearest first."""
        import numpy as np

        keep = np.flatnonzero(wanted(leaf))
        s, ids, rows = -(self.v[leaf] @ self.q[anchor])[keep], self.ids[leaf][keep], self.rows[leaf][keep]
        order = np.lexsort((rows, ids, s))
        return s[order], ids[order], rows[order]

    def nearest(self, anchor: int, low: int, high: int, wanted, cache: dict) -> Iterator[tuple[int, int, int]]:
        """(-score, id, row) of rows with scores in the window and a `wanted` label, one after the other: the annulus is entered at its inner edge, and
        a node is opened only when it may hold the next row. `cache` keeps the anchor's opened leaves for its other windows, which want the same labels."""
        heap: list = []
        order = 0

        def push(node: Node) -> None:
            nonlocal order
            best, least = (x[anchor] for x in self.bounds[id(node)])
            if best >= low and least <= high:
                order += 1
                heapq.heappush(heap, (-min(best, high), _LOW, _LOW, order, node, 0))

        push(self.tree)
        while heap:
            key, number, row, _, what, at = heapq.heappop(heap)
            if isinstance(what, Node):
                if what.at is not None:
                    for child in what.children:
                        push(child)
                    continue
                if what.leaf not in cache:
                    cache[what.leaf] = self.opened(anchor, what.rows, wanted)
                what = cache[what.leaf]
                at = int(what[0].searchsorted(-high))
            else:
                yield key, number, row
                at += 1
            if at < len(what[0]) and what[0][at] <= -low:
                order += 1
                heapq.heappush(heap, (int(what[0][at]), int(what[1][at]), int(what[2][at]), order, what, at))


_QUERY = "q long, q_id long, label long, v array<long>, low array<long>, high array<long>"
_FOUND = "q long, slot int, score long, id long, row long"


def _searched(cells: pa.Table, queries: pa.Table, width: int, largest: float, same: bool, most: int) -> pa.Table:
    """For each query and each of its windows the first `most` rows of a block, of the query's label or of any other."""
    out: list = []
    if cells.num_rows and queries.num_rows:
        column = lambda t, c: t.column(c).to_numpy()
        rows, ids, labels = (column(cells, c) for c in ("row", "id", "label"))
        names, q_labels = column(queries, "q"), column(queries, "label")
        search = BlockSearch(_matrix(cells.column("v"), width), ids, rows, labels, _matrix(queries.column("v"), width), largest)
        windows = zip(queries.column("low").to_pylist(), queries.column("high").to_pylist())
        for k, (lows, highs) in enumerate(windows):
            cache: dict = {}
            if same:
                wanted = lambda at, k=k: (search.labels[at] == q_labels[k]) & (search.rows[at] != names[k])
            else:
                wanted = lambda at, k=k: search.labels[at] != q_labels[k]
            for slot, (low, high) in enumerate(zip(lows, highs)):
                for n, (key, number, row) in enumerate(search.nearest(k, low, high, wanted, cache) if low <= high else (), 1):
                    out.append((int(names[k]), slot, -key, number, row))
                    if n == most:
                        break
    kinds = [("q", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())]
    return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(kinds)})


class Index:
    """All rows in blocks under the leaves of the upper tree; `rows` is a written table (row, id, label, v)."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE):
        import numpy as np

        self.spark = rows.sparkSession
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("m"), F.max(F.size("v")).alias("w")).first()
        self.count, self.largest, self.width = facts["n"], float(facts["m"] or 0.0), max(1, facts["w"] or 0)
        picked = rows.orderBy(F.xxhash64("id", "row"), "row").limit(sample).select("v").collect()
        seeds = np.zeros((len(picked), self.width), dtype=np.int64)
        for k, r in enumerate(picked):
            seeds[k, : len(r[0])] = r[0]
        self.tree = upper_tree(seeds, max(1, min(LEAVES, len(seeds) // 8, -(-self.count // LEAF_ROWS))), self.largest)
        tree, width, largest, depth = self.tree, self.width, self.largest, max(1, _depth(self.tree))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf, way = _routed(tree, _matrix(b.column(3), width), largest, depth)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1) * depth, pa.int32()), pa.array(way.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), lists], names=["row", "id", "label", "v", "leaf", "way"])

        routed = materialize(rows.mapInArrow(route, "row long, id long, label long, v array<long>, leaf int, way array<double>"), "routed")
        edges = [f(F.nanvl(F.col("way")[i], F.lit(None))).alias(f"{n}{i}") for i in range(depth) for n, f in (("a", F.min), ("z", F.max))]
        found = {r["leaf"]: r for r in routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *edges).collect()}
        self.parts = {leaf: -(-r["n"] // BLOCK_ROWS) for leaf, r in found.items()}

        def reach(node: Node, level: int) -> set[int]:
            """Fill in the distances in each half, of all rows; gives the leaves below."""
            if node.at is None:
                return {node.leaf}
            below = [reach(c, level + 1) for c in node.children]
            for leaves in below:
                mine = [found[x] for x in leaves if x in found and found[x][f"a{level}"] is not None]
                node.reach.append((min((r[f"a{level}"] for r in mine), default=math.inf), max((r[f"z{level}"] for r in mine), default=-math.inf)))
            return below[0] | below[1]

        reach(self.tree, 0)
        parts = self.spark.createDataFrame(list(self.parts.items()), "leaf int, parts int")
        self.leaves = F.broadcast(parts)  # LEAVES rows at most
        dealt = routed.drop("way").join(self.leaves, "leaf").withColumn("b", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
        self.blocks = materialize(dealt, "blocks")

    def planned(self, queries: DataFrame) -> DataFrame:
        """queries with the leaves that can hold a row of one of their windows, best first."""
        tree, width, largest, filled = self.tree, self.width, self.largest, set(self.parts)

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for b in batches:
                ends = [(n.leaf, best, least) for n, best, least in _bounded(tree, _matrix(b.column(3), width), largest) if n.at is None and n.leaf in filled]
                leaves = np.array([x[0] for x in ends])
                best, least = np.stack([x[1] for x in ends], axis=1), np.stack([x[2] for x in ends], axis=1)
                out = []
                for k, (lows, highs) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                    key = np.full(len(leaves), -np.inf)
                    for low, high in zip(lows, highs):
                        if low <= high:
                            open_ = (best[k] >= low) & (least[k] <= high)
                            key[open_] = np.maximum(key[open_], np.minimum(best[k][open_], high) + np.maximum(least[k][open_], low))
                    order = np.argsort(-key, kind="stable")
                    out.append(leaves[order[key[order] > -np.inf]].tolist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=["q", "q_id", "label", "v", "low", "high", "leaves"])

        return queries.select("q", "q_id", "label", "v", "low", "high").mapInArrow(plan, _QUERY + ", leaves array<int>")

    def visited(self, queries: DataFrame, leaves: Column, same: bool, most: int, anchors: int) -> DataFrame:
        """What the blocks of the given leaves hold for each query: _FOUND."""
        width, largest = self.width, self.largest
        sent = queries.withColumn("leaf", F.explode(leaves)).drop("leaves").join(self.leaves, "leaf")
        sent = sent.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-anchors // ANCHORS)))).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        sent = materialize(sent, "visits")
        key = ["leaf", "b", "part"]
        wanted = sent.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select("leaf", "b", (F.col("part") + 0).alias("part"))
        cells = joined(self.blocks, wanted.hint("merge"), ["leaf", "b"])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return _searched(left, right, width, largest, same, most)

        return cells.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(run, _FOUND)

    def first(self, queries: DataFrame, same: bool, most: int) -> DataFrame:
        """For each query and window the first `most` rows of all: _FOUND with rank.

        Each query goes to its best leaf first; what it finds there narrows its windows, and the other leaves that may still hold better rows follow.
        """
        planned = materialize(self.planned(queries), "planned")
        anchors = planned.count()
        near = materialize(self.visited(planned, F.slice("leaves", 1, 1), same, most, anchors), "near")
        rank = F.row_number().over(Window.partitionBy("q", "slot").orderBy(F.desc("score"), "id", "row"))
        best = near.withColumn("rank", rank).where(F.col("rank") <= most)
        worst = best.groupBy("q", "slot").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == most)
        worst = worst.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("worst"))
        narrowed = F.transform(F.col("low"), lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("worst", i), x)))
        again = joined(planned.withColumn("home", F.get("leaves", F.lit(0))), worst.hint("merge"), ["q"], "left").withColumn("low", narrowed)
        home = again.where(F.size("leaves") > 1).select("q", "home")
        again = joined(self.planned(again), home.hint("merge"), ["q"])
        far = self.visited(again, F.filter("leaves", lambda x: x != F.col("home")), same, most, anchors)
        both = materialize(best.drop("rank").unionByName(far), "found")
        return both.withColumn("rank", rank).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, sample: int = SAMPLE) -> DataFrame:
    """One row for each hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is an integer inner product. Anchors are the rows whose vec_id is divisible by `every`. An anchor's
    positives are the first `positives` other rows of its label, by score (higher first), then vec_id; for each, the first `negatives` rows of
    other labels follow whose scores are `low` to `high` hundredths of the positive's, both included. A positive of negative score has none.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Vectors shorter than the longest end with zeros. Components beyond 2**24 after
    scaling are an error. A repeated row is another row: it can be an anchor's positive and is an anchor again; its ties go by row.
    Other columns are ignored. An empty table gives an empty result. The result is exact; only the upper tree's shape depends on the sample of `sample` rows.
    """
    kept = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("_l"), F.col(vector).alias("_x"))
    kept = kept.where(F.col("id").isNotNull() & F.col("_l").isNotNull() & usable(F.col("_x")))
    whole = dict(kept.dtypes)["_l"] in ("tinyint", "smallint", "int", "bigint")
    kept = kept.select(F.monotonically_increasing_id().alias("row"), "id", F.col("_l").cast("long").alias("label") if whole else F.col("_l"), scaled(F.col("_x"), scale).alias("v"))
    kept = materialize(kept, "vectors")
    if not whole:
        names = materialize(kept.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")).withColumn("label", F.monotonically_increasing_id()), "labels")
        kept = materialize(joined_hot(kept, names, ["_l"], "_n", kept.count()).select("row", "id", "label", "v"), "vectors")
    index = Index(kept, sample)
    queries = kept.where(F.col("id") % every == 0).select(F.col("row").alias("q"), F.col("id").alias("q_id"), "label", "v", F.array(F.lit(_LOW)).alias("low"), F.array(F.lit(_HIGH)).alias("high"))
    found = materialize(index.first(queries, True, positives).select("q", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    edge = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    windows = found.select("q", "rank", (-edge(F.lit(-low) * F.col("positive_score"))).alias("low"), edge(F.lit(high) * F.col("positive_score")).alias("high"))
    windows = windows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("_w"))
    asked = joined(queries.drop("low", "high"), windows.hint("merge"), ["q"]).select("q", "q_id", "label", "v", F.col("_w.low").alias("low"), F.col("_w.high").alias("high"))
    hard = index.first(materialize(asked, "windows"), False, negatives).withColumnRenamed("rank", "_k").withColumn("rank", F.col("slot") + 1)
    out = joined(hard.select("q", "rank", "_k", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), found.hint("merge"), ["q", "rank"])
    out = joined(out, queries.select("q", F.col("q_id").alias("anchor_id")).hint("merge"), ["q"])
    return out.select("anchor_id", "positive_id", F.col("_k").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
