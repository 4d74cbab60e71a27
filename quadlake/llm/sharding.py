"""Shards of equal row counts by balanced label propagation over links between equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, hash_prefix, joined, materialize


def _pick(values: list[int], index: Column) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])[index]


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _grants(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the rows asked[s][t] may go from shard s to t: round in circles, so that no shard grows, then into room, also what these moves make."""
    left, room, shards = [list(r) for r in asked], list(room), range(len(room))

    def circle() -> list[int] | None:
        seen: set[int] = set()
        for start in shards:
            path, tries = [start], [iter(shards)]
            while path and path[-1] not in seen:
                for t in tries[-1]:
                    if left[path[-1]][t] and t not in seen:
                        if t in path:
                            return path[path.index(t) :]
                        path.append(t)
                        tries.append(iter(shards))
                        break
                else:
                    seen.add(path.pop())
                    tries.pop()
        return None

    while (found := circle()) is not None:
        edges = list(zip(found, [*found[1:], found[0]]))
        n = min(left[s][t] for s, t in edges)
        for s, t in edges:
            left[s][t] -= n
    moved = True
    while moved:
        moved = False
        for t in shards:
            for s in shards:
                n = min(left[s][t], room[t])
                if n:
                    left[s][t], room[t], room[s], moved = left[s][t] - n, room[t] - n, room[s] + n, True
    return [[x - y for x, y in zip(*rows)] for rows in zip(asked, left)]


def propagate(state: DataFrame, quota: list[int], buckets: int) -> DataFrame:
    """Move linked rows towards their neighbours' shards; state and result: h1, h2 (a group of equal texts), shard, n.

    In a group all rows are linked, so a row's neighbours in a shard are the group's count there; the group stands for its
    links, and no pair is made. In each round rows ask for a shard that has more of their neighbours than their own: in
    turn the one with most, the one with most among those with room, and any. A shard that the group fills is not
    asked for. Rows that ask for each other's shards change places, also round a circle of shards, and room is filled; of
    the requests from one shard to another whole groups come together, the last one in part. Every move adds links inside
    shards, so rounds come to an end: when none of the three kinds moves a row.
    """
    shards, turn, idle = len(quota), 0, 0
    while idle < 3:
        room = [q - n for q, n in zip(quota, _loads(state, shards))]
        rank = F.struct("n", F.xxhash64("h1", "shard").alias("tie"), "shard")
        order = F.xxhash64(F.lit(turn), "h1", "shard") if turn % 3 == 2 else F.lit(0).cast("long")
        open_ = _pick(room, F.col("shard")) > 0 if turn % 3 == 1 else F.col("n") < _pick(quota, F.col("shard"))
        best = F.max(F.when(open_, F.struct(order.alias("order"), rank.alias("rank")))).over(Window.partitionBy("h1", "h2"))
        wished = state.withColumn("_best", best["rank"]).withColumn("to", F.when(F.col("_best") > rank, F.col("_best.shard"))).drop("_best")
        wished = materialize(wished, "wishes")
        turn, idle = turn + 1, idle + 1
        asked = [[0] * shards for _ in range(shards)]
        for r in wished.where("to IS NOT NULL").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():
            asked[r["shard"]][r["to"]] = r["n"]
        grants = [n for row in _grants(asked, room) for n in row]
        if not any(grants):
            continue
        idle = 0
        moves = hash_prefix(wished.where("to IS NOT NULL"), ["shard", "to"], ["h1", "h2"], "n", "before", buckets)
        granted = F.greatest(F.lit(0), F.least(F.col("n"), _pick(grants, F.col("shard") * shards + F.col("to")) - F.col("before")))
        moves = materialize(moves.withColumn("granted", granted), "moves")
        rows = wished.where("to IS NULL").select("h1", "h2", "shard", "n")
        rows = rows.unionByName(moves.select("h1", "h2", "shard", (F.col("n") - F.col("granted")).alias("n")))
        rows = rows.unionByName(moves.select("h1", "h2", F.col("to").alias("shard"), F.col("granted").alias("n"))).where("n > 0")
        state = materialize(rows.groupBy("h1", "h2", "shard").agg(F.sum("n").alias("n")), "labels")
    return state


def balanced_shards(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: row, doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: the row counts of any two shards differ by one at most. Rows start on shards in turn, in hash order; rows
    of equal texts then gather by propagate(), never above the quotas; rows without links fill what is left. A group
    as large as a shard or larger fills one or several from the start. Texts are equal by two 64-bit hashes. Null text has size 8, the crc of an empty
    text and no links. slot numbers a shard's rows from 0. grown_shard is null under this law. Repeated rows are linked
    rows. Other columns of docs are ignored. An empty table gives an empty result.
    """
    row = F.monotonically_increasing_id()
    value = F.col(text).cast("string")
    base = docs.select(
        row.alias("row"),
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(value.isNotNull(), F.xxhash64(value)).otherwise(row).alias("h1"),
        F.when(value.isNotNull(), F.xxhash64(F.lit(7), value)).alias("h2"),
    )
    base = materialize(base, "rows")
    rows = base.count()
    buckets = buckets_for(rows)
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    # groups as large as a shard, two for each shard at most, fill the last shards; what is left of them comes behind the other rows
    large = base.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, quota[-1])).orderBy("h1", "h2").collect() if rows >= shards else []
    seats, turn, open_ = [], rows - sum(r["n"] for r in large), shards
    rest = [r["n"] for r in large]
    for k, r in enumerate(large):
        while open_ and rest[k] >= quota[open_ - 1]:
            open_ -= 1
            rest[k] -= quota[open_]
            seats.append((r["h1"], r["h2"], open_, quota[open_]))
    for r, left in zip(large, rest):
        seats += [(r["h1"], r["h2"], s, len(range(turn + (s - turn) % open_, turn + left, open_))) for s in range(open_) if left]
        turn += left
    seats = base.sparkSession.createDataFrame([x for x in seats if x[3]], "h1 long, h2 long, shard int, n long")
    is_large = F.lit(False)
    for r in large:
        is_large = is_large | ((F.col("h1") == r["h1"]) & F.col("h2").eqNullSafe(r["h2"]))
    base = materialize(hash_prefix(base.withColumn("_large", is_large), ["_large"], ["row"], None, "_turn", buckets), "turns")
    labels = base.where("NOT _large").groupBy("h1", "h2", F.pmod("_turn", F.lit(max(1, open_))).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    base = base.drop("_large")
    total = F.sum("n").over(Window.partitionBy("h1", "h2"))
    labels = labels.withColumn("_t", total).where("_t > 1").drop("_t").unionByName(seats)
    state = propagate(materialize(labels, "labels"), quota, buckets)

    loads = _loads(state, shards)
    by_shard = Window.partitionBy("h1", "h2").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    state = hash_prefix(state, ["shard"], ["h1", "h2"], "n", "slot", buckets).withColumn("before", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    shares = state.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("before", "n", "shard", "slot"))).alias("shares"))
    ranked = materialize(hash_prefix(base.drop("_turn"), ["h1", "h2"], ["row"], None, "_r", buckets, extra=shares), "ranks")
    linked = ranked.where("shares IS NOT NULL")
    share = F.filter("shares", lambda x: (F.col("_r") >= x["before"]) & (F.col("_r") < x["before"] + x["n"]))[0]
    linked = linked.withColumn("_s", share).select("row", "doc_id", "size", "text_crc32", F.col("_s.shard").alias("shard"), (F.col("_s.slot") + F.col("_r") - F.col("_s.before")).alias("slot"))

    starts = [sum(quota[:s]) - sum(loads[:s]) for s in range(shards)]
    free = hash_prefix(ranked.where("shares IS NULL").drop("shares", "_r"), [], ["row"], None, "_r", buckets)
    at = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in starts]), lambda x: x <= F.col("_r"))) - 1
    free = free.withColumn("shard", at).withColumn("slot", F.col("_r") - _pick(starts, F.col("shard")) + _pick(loads, F.col("shard")))
    out = linked.unionByName(free.select("row", "doc_id", "size", "text_crc32", "shard", "slot"))
    return out.select("row", "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
