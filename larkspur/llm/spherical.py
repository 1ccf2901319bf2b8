"""Embedding near-duplicates by spherical-cap filters over structured random product codes.

Under each of several random rotations a unit vector is cut into blocks (two, or three for very large
tables); a filter direction is one of L random directions per block, so there are L**blocks of them a
rotation. Each vector takes all filters whose cap it is in, that is, whose product with it is at least
the height; they are list-decoded block by block, never enumerated: a partial sum goes on only if the
best directions of the blocks to come can still lift it to the height. There is one height for all,
set from the dimension so that a vector is in `caps` filters on average. Vectors with a common filter
are compared exactly, in double precision.

Rotations are independent, so a pair lacks a common filter in all T of them with probability p**T.
p is measured, for each code and height and for the dimension at hand, on random pairs at the
threshold; T is then the least number with p**T at most MISS, taking p three standard errors too high.
Of the codes that is chosen which makes the least work by a model of the costs. So the filters of a
vector do not grow with the table but for the logarithm that is in T. Only tables of under FEW vectors
of one dimension, and those of under four dimensions, are compared all with all, block by block.

A filter that holds more than HOT vectors is split into blocks of so many, and each pair of blocks is
a key of its own: a dense cluster, a third of all rows even, is many small tasks. (Its links are still
as many as its pairs, each of which is compared, since n_links counts them.)

Null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of
different length are not compared; a very long vector is only compared with those of its length. Equal
vectors are one class and are not paired up. Repeated ids are separate vectors; a row without an id
counts as a link but is never kept. A cosine equal to the threshold links. An empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .components import components

#: Probability that a pair at the threshold has no common filter.
MISS = 1e-6
#: Rough seconds for a multiplication, a filter of a vector and a candidate pair.
MULTIPLY, ENTRY, CANDIDATE = 1e-10, 2e-6, 4e-6
#: Fewer vectors than these are compared all with all.
FEW = 4096
#: Vectors of one filter that are one key of the join.
HOT = 1024
BLOCK_BYTES = 16 << 20


def cap_height(d: int, blocks: int, share: float) -> float:
    """The product with a filter (whose square is `blocks`) that a random unit vector reaches with probability share."""
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - t * t, 0) ** ((d - 3) / 2)
    tail = np.cumsum(density[::-1])
    return float(math.sqrt(blocks) * t[::-1][np.searchsorted(tail, share * tail[-1])])


class Filters:
    """The first product codes of `blocks` times `size` directions for vectors of d dimensions, one a rotation."""

    def __init__(self, d: int, blocks: int, size: int, caps: float, rotations: int, seed: int = 7) -> None:
        self.blocks, self.size = blocks, size
        self.d = -(-d // blocks) * blocks
        self.height = cap_height(self.d, blocks, caps / size**blocks)
        self.codes = []
        for t in range(rotations):
            rng = np.random.default_rng([seed, d, blocks, size, t])
            turn = np.linalg.qr(rng.standard_normal((self.d, self.d)))[0][:d]
            code = rng.standard_normal((blocks, size, self.d // blocks))
            self.codes.append((turn.astype(np.float32), (code / np.linalg.norm(code, axis=2, keepdims=True)).astype(np.float32)))

    def passed(self, x: np.ndarray, rotation: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters of a rotation whose caps the unit vectors are in; numbers of different rotations differ."""
        turn, code = self.codes[rotation]
        n = len(x)
        turned = (x.astype(np.float32) @ turn).reshape(n, self.blocks, self.d // self.blocks)
        products = turned.transpose(1, 0, 2) @ code.transpose(0, 2, 1)
        top = products.max(axis=2)
        rest = np.concatenate([np.cumsum(top[::-1], axis=0)[::-1][1:], np.zeros((1, n), np.float32)])  # what later blocks can add
        row, value, index = np.arange(n), np.zeros(n, np.float32), np.full(n, rotation, np.int64)
        for b in range(self.blocks):
            # directions that the best ones of all other blocks lift to the height, joined to the sums so far by row
            own, j = np.nonzero(products[b] >= (self.height - (top.sum(0) - top[b]) - 1e-5)[:, None])
            at = np.searchsorted(own, np.arange(n + 1))
            many = at[row + 1] - at[row]
            from_ = np.repeat(np.arange(len(row)), many)
            to = np.arange(len(from_)) - np.repeat(np.cumsum(many) - many, many) + at[row][from_]
            total, row = value[from_] + products[b][own[to], j[to]], row[from_]
            keep = total >= self.height - rest[b][row]
            value, index, row = total[keep], (index[from_] * self.size + j[to])[keep], row[keep]
        return row, index


def pairs_at(cosine: float, d: int, n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at that cosine."""
    rng = np.random.default_rng([seed, d])
    x, y = (_unit(rng.standard_normal((n, d))) for _ in range(2))
    y = _unit(y - np.einsum("ij,ij->i", x, y)[:, None] * x)
    return x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y


def met(codes: Filters, x: np.ndarray, y: np.ndarray, rotation: int) -> np.ndarray:
    """For each pair of rows whether they have a filter of the rotation in common."""
    (i, f), (j, g) = codes.passed(x, rotation), codes.passed(y, rotation)
    width = codes.size**codes.blocks
    found = np.intersect1d(i * width + f % width, j * width + g % width)
    return np.isin(np.arange(len(x)), found // width)


def plan(d: int, n: int, threshold: float, sample: np.ndarray, rotations: int = 8) -> tuple[int, int, float, int] | None:
    """(blocks, L, caps, T) that lose a pair at the threshold with probability MISS; None where all pairs are to be compared.

    sample holds some of the unit vectors: how often they meet by chance tells the number of candidates.
    """
    if d < 4 or n < FEW or not -1 < threshold < 1:
        return None
    x, y = pairs_at(threshold, d, 384)
    possible = max(1, len(sample) * (len(sample) - 1) // 2) * rotations
    least, chosen = math.inf, None
    for blocks, size in [(2, 1 << k) for k in range(4, 13)] + [(3, 1 << k) for k in range(8, 11)]:
        if d < 2 * blocks or not n / 16 <= size**blocks <= 64 * n or (blocks == 3 and n < 1 << 24):
            continue
        for caps in (3.0, 6.0):
            codes = Filters(d, blocks, size, caps, rotations)
            missed = 1 - np.array([met(codes, x, y, t) for t in range(rotations)]).mean(1)
            p = min(max(missed.mean() + 3 * missed.std(ddof=1) / math.sqrt(rotations), 1e-3), 1 - 1e-9)
            turns = math.ceil(math.log(MISS) / math.log(p))
            many = np.concatenate([np.unique(codes.passed(sample, t)[1], return_counts=True)[1] for t in range(rotations)]) if len(sample) else np.zeros(0, np.int64)
            chance = float((many * (many - 1) // 2).sum() + 1) / possible
            work = turns * (n * caps * ENTRY + n * d * (d + size) * MULTIPLY + chance * n * n / 2 * CANDIDATE)
            if work < least:
                least, chosen = work, (blocks, size, caps, turns)
    return chosen


def colliding(passed: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b), a < b, of the vectors with a common filter, once each; passed has f, d and cid.

    Filters of more than `hot` vectors are joined by pairs of blocks of them.
    """
    large, _ = cut(passed.groupBy("f", "d").agg(F.count("*").alias("c")).where(F.col("c") > hot), "hot-filters")
    left, right = (passed.select("f", "d", F.col("cid").alias(x)) for x in "ab")
    if large.isEmpty():
        return left.join(right, ["f", "d"]).where("a < b").select("a", "b").distinct()
    cold = passed.join(large.select("f", "d"), ["f", "d"], "left_anti")
    left, right = (cold.select("f", "d", F.col("cid").alias(x)) for x in "ab")
    pairs = left.join(right, ["f", "d"]).where("a < b").select("a", "b")
    blocks = F.ceil(F.col("c") / hot).cast("int")
    members = passed.join(large, ["f", "d"]).withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    sent = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("f", "d", "cid", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    one, two = (sent.where(f"own = {x}").select("f", "d", "i", "j", F.col("cid").alias(y)) for x, y in (("i", "a"), ("j", "b")))
    met_ = one.hint("merge").join(two, ["f", "d", "i", "j"]).where("i <> j OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(met_).distinct()


def _pack(column: pa.Array) -> list[bytes | None]:
    """Each usable vector as doubles; None for the others."""
    ends = np.asarray(column.offsets)
    values = column.values.cast(pa.float64())
    null = np.asarray(values.is_null())
    x = np.asarray(values.fill_null(0.0))
    upto = np.zeros((2, len(x) + 1), np.int64)  # components that forbid a vector, and those that make it one
    np.cumsum(null | ~np.isfinite(x), out=upto[0, 1:])
    np.cumsum(x != 0, out=upto[1, 1:])
    bad, good = upto[:, ends[1:]] - upto[:, ends[:-1]]
    usable = (bad == 0) & (good > 0) & np.asarray(column.is_valid())
    return [x[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), usable.tolist(), strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def all_pairs(classes: DataFrame, counts: dict[int, int], threshold: float) -> DataFrame:
    """(a, b), a < b, of classes(cid, v, d) of equal d, by single-precision products less a margin for their error.

    Each pair of blocks of vectors meets in one task; counts are those of each d.
    """
    spark = classes.sparkSession
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    blocks = {d: max(-(-n * d * 4 // BLOCK_BYTES), min(8, -(-n // 1024))) for d, n in counts.items()}

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [_unit(np.frombuffer(v)[None]).astype(np.float32).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(u, pa.binary()), b.column(2)], ["cid", "u", "d"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if not len(t):
            return
        i, j, d = (t.column(k)[0].as_py() for k in ("i", "j", "d"))
        cid, own = t.column("cid").to_numpy(), t.column("block").to_numpy()
        x = np.frombuffer(b"".join(t.column("u").to_pylist()), np.float32).reshape(len(t), d)
        (ca, xa), (cb, xb) = ((cid[own == k], x[own == k]) for k in (i, j))
        least = threshold - 1e-6 * (d + 10)
        for r in range(0, len(xa), 2048):
            for c in range(r if i == j else 0, len(xb), 2048):
                p, q = np.nonzero(xa[r : r + 2048] @ xb[c : c + 2048].T >= least)
                a, b = ca[r + p], cb[c + q]
                once = r + p < c + q if i == j else slice(None)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[once]), pa.array(np.maximum(a, b)[once])], ["a", "b"])

    number = F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("d"))
    rows = classes.select("cid", "v", "d").mapInArrow(shorten, "cid long, u binary, d int").withColumn("block", F.pmod(F.xxhash64("cid"), number).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), number - 1))).select("cid", "u", "d", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return met.groupBy("d", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of df."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_pack(b.column(2)), pa.binary())], ["row", "vec_id", "v"])

    source = df.select(F.monotonically_increasing_id().alias("row"), df[key].cast("long").alias("vec_id"), df[vector].cast("array<double>").alias("e"))
    rows, _ = cut(source.mapInArrow(pack, "row long, vec_id long, v binary"), "vectors")
    classes, _ = cut(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("row").alias("cid"), F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    classes = classes.withColumn("d", (F.length("v") / 8).cast("int"))
    plans: dict[int, tuple[int, int, float, int] | None] = {}
    counts = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    for d, n in counts.items():
        some = classes.where(F.col("d") == d).orderBy(F.xxhash64("cid")).limit(1024).select("v").collect() if n >= FEW else []
        plans[d] = plan(d, n, threshold, _unit(np.array([np.frombuffer(r["v"]) for r in some]))) if some else None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Filters] = {}
        for b in batches:
            ids, vectors = b.column(0).to_numpy(), b.column(1).to_pylist()
            lengths = np.array([len(v) // 8 for v in vectors])
            for d in np.unique(lengths).tolist():
                if d not in codes:
                    codes[d] = Filters(d, *plans[d])
                own = np.flatnonzero(lengths == d)
                for at in range(0, len(own), 512):
                    part = own[at : at + 512]
                    x, cid = _unit(np.frombuffer(b"".join(vectors[i] for i in part)).reshape(-1, d)), ids[part]
                    found = [codes[d].passed(x, t) for t in range(plans[d][3])]
                    filters = np.concatenate([f for _, f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(filters), pa.array(np.full(len(filters), d, np.int32)), pa.array(np.concatenate([cid[r] for r, _ in found]))], ["f", "d", "cid"])

    scanned = [d for d, p in plans.items() if p is None]
    candidates = all_pairs(classes.where(F.col("d").isin(scanned)), {d: counts[d] for d in scanned}, threshold)
    if len(scanned) < len(plans):
        passed, _ = cut(classes.where(~F.col("d").isin(scanned)).select("cid", "v").repartition("cid").mapInArrow(decode, "f long, d int, cid long"), "filters")
        found = colliding(passed)
        candidates = candidates.unionByName(found) if scanned else found

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                va, vb = part.column(2).to_pylist(), part.column(3).to_pylist()
                length = np.array([len(x) for x in va])
                for k in np.unique(length):
                    i = np.flatnonzero(length == k)
                    x, y = (_unit(np.frombuffer(b"".join(v[j] for j in i)).reshape(len(i), -1)) for v in (va, vb))
                    keep[at + i] = np.einsum("ij,ij->i", x, y) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    vec = classes.select("cid", "v")
    joined = candidates.join(vec.select(F.col("cid").alias("a"), F.col("v").alias("va")), "a").join(vec.select(F.col("cid").alias("b"), F.col("v").alias("vb")), "b")
    pairs, _ = cut(joined.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long"), "vector-links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("cid").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cid")
    member = components(pairs).select(F.col("node").alias("cid"), "root")
    roots = member.join(classes.select("cid", "rep"), "cid").groupBy("root").agg(F.min("rep").alias("component"))
    found = member.join(roots, "root").select("cid", "component")
    resolved = classes.join(near, "cid", "left").join(found, "cid", "left").select(
        "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    component = F.coalesce("component", "vec_id")
    return rows.join(resolved, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )
