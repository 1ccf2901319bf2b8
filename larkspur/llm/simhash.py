"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments (23, 23 and 18 bits). Two fingerprints that differ in at
most three bits either agree in one segment and differ in at most one bit of another, or differ in
exactly one bit of each. Words of 23 bits that differ in one bit share a key when one side gives its
nearest codeword of the perfect Golay code and the other all codewords within distance four (one, or
six). So an exact segment with a Golay index, or two Golay indices with the three parities flipped,
join every such pair; the join then counts the differing bits. Only distinct fingerprints are joined.

Defined results: null and empty texts have fingerprint zero, linked like any other; texts of one or two
words are one shingle; a very long text is one fingerprint of all its shingles; a bit that is set in just
half of them is 0; repeated rows count as documents; an empty table gives an empty result; other columns
are ignored by `near_duplicates` and kept by `representatives`, which may not have one named _row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, cut, text_bytes
from .components import components

SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0xAE3


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        h = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        stops = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], stops[: -width]]).tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[i:j], SEED) for i, j in zip(starts, (stops[width - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of each row's whole text; fp is the fingerprint as a signed long."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in text_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- Golay
def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; by syndrome the error patterns up to weight 4, and how many."""
    upper = np.array([_remainder(i << 11) for i in range(4096)], dtype=np.int64)
    single = [_remainder(1 << i) for i in range(23)]
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for i in bits:
                s ^= single[i]
                e |= 1 << i
            patterns[s].append(e)
    count = np.array([len(p) for p in patterns])
    table = np.array([p + p[:1] * (6 - len(p)) for p in patterns], dtype=np.int64)
    return upper, table, count


class Golay:
    def __init__(self) -> None:
        self.upper, self.table, self.count = _tables()

    def decode(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword indices (n, 6) within distance four, the nearest first, and which of them count."""
        s = self.upper[word >> 11] ^ (word & 2047)
        return (word[:, None] ^ self.table[s]) >> 11, np.arange(6) < self.count[s][:, None]


def keys(fp: np.ndarray, golay: Golay) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((row, key) for the index, (row, key) for the probe) of fingerprints as uint64."""
    seg = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [golay.decode(s) for s in seg]
    row = np.arange(len(fp))
    index, probe = [], []
    for t, (e, g) in enumerate((e, g) for e in range(3) for g in range(3) if e != g):
        top = (np.int64(t) << 40) | (seg[e] << 12)
        code, real = near[g]
        index.append((row, top | code[:, 0]))
        i, j = np.nonzero(real)
        probe.append((i, top[i] | code[i, j]))
    parity = sum(((np.bitwise_count(s).astype(np.int64) & 1) << k for k, s in enumerate(seg)), np.zeros(len(fp), np.int64))
    (ca, ra), (cb, rb) = near[0], near[1]
    top = np.int64(6) << 40
    index.append((row, top | (parity << 24) | (ca[:, 0] << 12) | cb[:, 0]))
    i, j, k = np.nonzero(ra[:, :, None] & rb[:, None, :])
    probe.append((i, top | ((parity[i] ^ 7) << 24) | (ca[i, j] << 12) | cb[i, k]))
    return tuple((np.concatenate([x for x, _ in side]), np.concatenate([x for _, x in side])) for side in (index, probe))


def links(classes: DataFrame) -> DataFrame:
    """(a, b) of the distinct fingerprints of column fp that differ in one to three bits, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            all_fp = b.column(0).to_numpy()
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at : at + 4096]
                for side, (row, key) in enumerate(keys(fp.view(np.uint64), golay)):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(np.full(len(row), side == 1))], ["k", "fp", "probe"])

    keyed = classes.select("fp").mapInArrow(run, "k long, fp long, probe boolean")
    index = keyed.where("NOT probe").select("k", F.col("fp").alias("a"))
    probe = keyed.where("probe").select("k", F.col("fp").alias("b"))
    # Sizes of mapped rows are not known to the planner: without the hint it broadcasts the index.
    return index.hint("merge").join(probe, "k").where("a < b AND bit_count(a ^ b) <= 3").select("a", "b").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, n_near and component_id (smallest doc_id reachable) of each row."""
    prints, _ = cut(fingerprints(df, key, text), "prints")
    classes, _ = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    pairs, _ = cut(links(classes), "links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    member = components(pairs).select(F.col("node").alias("fp"), "root")
    root = member.join(classes, "fp").groupBy("root").agg(F.min("rep").alias("component"))
    linked = member.join(root, "root").select("fp", "component").join(near.withColumnRenamed("a", "fp"), "fp")
    resolved = classes.join(linked, "fp", "left").select(
        "fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(resolved, "fp").select("doc_id", "fp", "n_near", "component_id")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", unnamed: bool = False) -> DataFrame:
    """The rows of df that stand for their group of near-duplicates (the smallest doc_id), all columns.

    Groups are of rows, whatever their doc_id: of rows that repeat the smallest doc_id of one group one
    stays, rows of different groups that share a doc_id all do. Rows without a doc_id are not compared
    and stay, unless unnamed: then they are like others, and stand for a group where no row has a doc_id.
    """
    # rows are numbered in a table, since a plan that is run again may number them otherwise
    rows, _ = cut(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    compared = rows if unnamed else rows.where(F.col(key).isNotNull())
    groups, _ = cut(near_duplicates(compared, "_row", text).select(F.col("doc_id").alias("_row"), "component_id"), "groups")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "_row")
    named = groups.join(rows.select("_row", F.col(key).cast("long").alias("id")), "_row")
    best, _ = cut(named.groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best._row").alias("_row")), "kept")
    kept = compared.join(best.hint("shuffle_hash"), "_row", "left_semi").select(*df.columns)
    return kept if unnamed else kept.unionByName(rows.where(F.col(key).isNull()).select(*df.columns))
