"""Sharding by balanced label propagation.

Documents with equal texts are linked (a star around the group's smallest row). Linked documents start
in a shard by hash. In each round a centre first moves to the shard where most of its neighbours are,
then the neighbours move to their centre's shard, both only as far as the quotas allow: what comes into
a shard is at most its room (its quota, a hundredth over its even share of the bytes, less what it holds;
negative where it holds more) and what leaves it in the same step, so shards exchange documents even where none has room. Rows are let
through by chance, in that proportion; what is over by chance counts against the next step. Rounds end
when no link is cut, or when a round mends less than a thousandth of the links. Documents without links cut no edge wherever
they are, so they fill the shards up to even sizes at the end, along one running sum.

A group of many rows is spread over as many keys as its count asks for, in every join; counts and votes
are combined before they are shuffled.

Defined results: null texts count as empty (size one) and are linked with empty ones; a text of any
length is one row of its size; repeated rows are separate, linked documents; of equally voted shards
the smaller number wins, of rows in a block the earlier comes first; a group larger than a shard's share
is split; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, remove

SHARDS = 8
#: Rows of a group that are one key of a join, at least; groups of more are at most HEAVY_GROUPS.
KEY_ROWS, HEAVY_GROUPS = 250_000, 10_000
#: A shard's quota while documents move, in even shares.
QUOTA = 1.01


def _unit(*of: Column) -> Column:
    """A reproducible number in [0, 1) from a row's keys."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pick(column: Column, values: list) -> Column:
    """values[column], for a shard number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), column + 1)


def documents_to_nodes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, size, text_crc32 and g (128-bit hash of the text) of each row."""
    t = F.coalesce(df[text].cast("string"), F.lit(""))
    return df.select(
        F.monotonically_increasing_id().alias("row"), df[key].cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.md5(t.cast("binary"))).alias("g"),
    )


def _stars(nodes: DataFrame, shards: int, key_rows: int) -> DataFrame:
    """row, size, hub, salts (keys of the group), salt (the row's) and first shard of every node that is linked."""
    groups, _ = cut(nodes.groupBy("g").agg(F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1").select("g", "hub", F.ceil(F.col("n") / key_rows).cast("int").alias("salts")), "groups")
    heavy = groups.where("salts > 1").select("g", "salts")  # at most HEAVY_GROUPS rows, which bounds the broadcast
    salted = nodes.select("row", "size", "g").join(F.broadcast(heavy), "g", "left").select("row", "size", "g", F.pmod(F.hash("row"), F.coalesce("salts", F.lit(1))).alias("salt"))
    wanted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return salted.join(wanted.hint("merge"), ["g", "salt"]).select("row", "size", "hub", "salts", "salt", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))


def exchange(wishes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each shard the part of the bytes wishing to move there that may.

    The greatest parts for which no shard takes in more than its room and what leaves it; room is negative
    where a shard holds too much, which then loses more than it takes.
    """
    wishes = wishes * (1 - np.eye(len(room)))
    want = wishes.sum(0)
    part = np.ones(len(room))
    for _ in range(10_000):
        allowed = np.maximum(room + (wishes * part).sum(1), 0)
        new = np.minimum(part, np.where(want > 0, np.minimum(1, allowed / np.maximum(want, 1e-9)), 1))
        if np.abs(new - part).max() < 1e-7:
            break
        part = new
    return part


def _allowed(moves: DataFrame, load: np.ndarray, quota: float) -> np.ndarray:
    """exchange() of the wishes of a table, which it reads as at most one row a pair of shards."""
    wishes = np.zeros((len(load), len(load)))
    for r in moves.where("shard <> wish").groupBy("shard", "wish").agg(F.sum("size").alias("b")).collect():
        wishes[r["shard"], r["wish"]] = r["b"]
    return exchange(wishes, quota - load)


def _loads(members: DataFrame, shards: int) -> np.ndarray:
    load = np.zeros(shards)
    for r in members.groupBy("shard").agg(F.sum("size").alias("b")).collect():
        load[r["shard"]] = r["b"]
    return load


def propagate(members: DataFrame, share: float, shards: int = SHARDS, least: float = 1e-3) -> tuple[DataFrame, np.ndarray]:
    """members with settled shards, as a table in the shared folder, and the shards' loads.

    least: the part of the links that a round must mend for another one to follow.
    """
    now, path = cut(members, "labels")
    load = _loads(now, shards)
    before = None
    for r in count():
        hubs = now.where("row = hub").select("hub", "size", "salts", "shard")
        votes = now.where("row <> hub").groupBy("hub", "shard").agg(F.count("*").alias("c")).groupBy("hub").agg(F.max(F.struct("c", (-F.col("shard")).alias("s"))).alias("top"))
        wishes, wish_path = cut(hubs.join(votes, "hub").select("hub", "size", "salts", "shard", (-F.col("top.s")).alias("wish")), "wishes")
        part = _allowed(wishes, load, QUOTA * share)
        follow = _unit(F.col("hub"), F.lit(2 * r)) < _pick(F.col("wish"), part.tolist())
        centres = wishes.select("hub", "salts", F.when(follow, F.col("wish")).otherwise(F.col("shard")).alias("wish"))
        # every member meets its centre's label by (hub, salt), so no large group meets in one task; the planner
        # does not see that rows were multiplied, hence the hint against a broadcast
        spread = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        wishing, wishing_path = cut(now.join(spread.hint("merge"), ["hub", "salt"]).select("row", "size", "hub", "salts", "salt", F.when(F.col("row") == F.col("hub"), F.col("wish")).otherwise(F.col("shard")).alias("shard"), "wish"), "wishing")
        part = _allowed(wishing, _loads(wishing, shards), QUOTA * share)
        go = (F.col("shard") != F.col("wish")) & (_unit(F.col("row"), F.lit(2 * r + 1)) < _pick(F.col("wish"), part.tolist()))
        new, new_path = cut(wishing.select("row", "size", "hub", "salts", "salt", F.when(go, F.col("wish")).otherwise(F.col("shard")).alias("shard"), (go | (F.col("shard") == F.col("wish"))).alias("joined")), "labels")
        state = new.agg(F.count("*").alias("n"), F.count_if(~F.col("joined")).alias("cut")).first()
        remove(members.sparkSession, path, wish_path, wishing_path)
        now, path = new.drop("joined"), new_path
        load = _loads(now, shards)
        if state["cut"] == 0 or (before is not None and before - state["cut"] < least * state["n"]):
            return now, load
        before = state["cut"]


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rows_per_block: int = 200_000, key_rows: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless within a shard) and linked of each row."""
    nodes, _ = cut(documents_to_nodes(df, key, text), "nodes")
    total = nodes.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    share = (total["b"] or 0) / shards
    members, load = propagate(_stars(nodes, shards, key_rows or max(KEY_ROWS, total["n"] // HEAVY_GROUPS)), share, shards)
    room = np.maximum(share - load, 0)
    fill = np.cumsum(room * ((total["b"] or 0) - load.sum()) / max(room.sum(), 1e-9))
    blocks = max(1, -(-total["n"] // rows_per_block))
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int")
    placed = nodes.join(members.select("row", F.col("shard").alias("own")), "row", "left").withColumn("block", block).select("row", "doc_id", "size", "text_crc32", "own", "block")
    rows, _ = cut(placed, "placed")
    free = rows.where("own IS NULL")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = free.groupBy("block").agg(F.sum("size").alias("b")).select("block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("from"))  # one row a block
    running = F.sum("size").over(Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("from") + F.col("upto") - F.col("size") / 2
    chosen = sum((F.when(middle >= float(edge), 1).otherwise(0) for edge in fill[:-1]), F.lit(0))
    filled = free.withColumn("upto", running).join(starts, "block").select("row", "doc_id", "size", "text_crc32", "block", chosen.cast("int").alias("shard"), F.lit(False).alias("linked"))
    done, _ = cut(filled.unionByName(rows.where("own IS NOT NULL").select("row", "doc_id", "size", "text_crc32", "block", F.col("own").alias("shard"), F.lit(True).alias("linked"))), "sharded")
    offsets = done.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from")
    )
    ranked = done.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1)
    return ranked.join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("from") + F.col("rank")).cast("long").alias("slot"), "linked")
