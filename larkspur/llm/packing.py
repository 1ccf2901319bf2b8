"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are at most the capacity, so a histogram of lengths, which never has more than `capacity`
entries, is all that planning needs, at any size of the corpus. Single, pair and triple sums of the
lengths are indexed. Under the gap that the longest length leaves, combinations that fill it exactly
are consumed as often as counts allow; what is left goes, longest first, to the open sequence with the
smallest gap that takes it. The plan is a list of patterns with repeat counts; pieces take their places
in it by their rank within their length.

Defined results: null and empty texts are one piece, the end id; a very long text is cut into pieces
as `cuts` says; repeated rows are separate pieces; pieces of equal length take their places in the
order of their rows, which decides all ties; an empty table gives an empty result; other columns of a
table of documents are ignored, whatever their names, and `pack` keeps those of a table of pieces but
refuses one that has sequence_id or offset already.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded_batches, cut

CAPACITY = 2048
END_ID = 0
#: Equal to the vocabulary's own pattern on texts without two white-space characters in a row.
_FAST = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_RUN = re.compile(r"\s\s|[\x1c-\x1f]")


class Encoder:
    """Ids of the byte-level BPE tokenizer file: by ranks of the same vocabulary, else by the file itself.

    The rank table needs no merges to be replayed and is several times faster; texts with the string of
    a special token go to the tokenizer file, whose ids are the reference for both.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.file = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.file.get_added_tokens_decoder().values()]
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=_FAST, mergeable_ranks=table, special_tokens={})
        self.full = tiktoken.Encoding("full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.file.encode(text, add_special_tokens=False).ids
        return (self.full if _RUN.search(text) else self.fast).encode_ordinary(text)


_WORKER: dict[tuple, Encoder] = {}


def _encoder(*paths: str | None) -> Encoder:
    if paths not in _WORKER:
        _WORKER[paths] = Encoder(*paths)
    return _WORKER[paths]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32[, ids] of the pieces of each row's whole text.

    Each text is followed by the end id, so null and empty texts are one piece of one token. `row`
    tells apart rows that repeat a doc_id.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks)
        recent: OrderedDict[str, list[tuple]] = OrderedDict()
        kept = 0
        for b in batches:
            out: list[tuple] = []
            rows, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for r, d, t in zip(rows, ids, b.column(2).to_pylist(), strict=True):
                t = t or ""
                made = recent.get(t)
                if made is None:
                    tokens = np.array([*encode(t), END_ID], dtype="<u4")
                    made = [(p, s, n, zlib.crc32(x := tokens[s : s + n].tobytes()), x if keep_ids else None) for p, (s, n) in enumerate(cuts(len(tokens), capacity))]
                    if len(t) < 1 << 16:
                        recent[t] = made
                        kept += len(t)
                        while kept > 8 << 20:
                            kept -= len(recent.popitem(last=False)[0])
                out += [(r, d, *m) for m in made]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 6 + keep_ids], names[: 6 + keep_ids])

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return df.select(F.monotonically_increasing_id().alias("row"), df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan
class Complements:
    """An index of the single, pair and triple sums of the lengths in `counts`, read under what is left of them.

    counts only falls, so an entry one of whose lengths is used up is gone for good: each sum has a
    cursor, and what lies before it is not looked at again. A triple sum is kept as the lengths that
    leave a pair sum, the pairs being those of that sum.
    """

    def __init__(self, counts: np.ndarray, balanced: bool = True) -> None:
        self.counts = counts
        have = np.flatnonzero(counts)
        i, j = np.triu_indices(len(have))
        low, total = have[i], have[i] + have[j]
        keep = total < len(counts)
        low, total = low[keep], total[keep]
        order = np.lexsort((-low if balanced else low, total))
        self.low = low[order].tolist()
        bounds = np.searchsorted(total[order], np.arange(len(counts) + 1)).tolist()
        self.pair_at, self.pair_end = bounds[:-1], bounds[1:]
        self.have, self.triple_at = have[::-1].tolist(), [0] * len(counts)

    def _gone(self, *lengths: int) -> bool:
        return any(self.counts[n] < lengths.count(n) for n in lengths)

    def _pair(self, total: int, *held: int) -> list[int] | None:
        if total < 2:
            return None
        i, end = self.pair_at[total], self.pair_end[total]
        while i < end and self._gone(self.low[i], total - self.low[i]):
            i += 1
        self.pair_at[total] = i
        for k in range(i, end):
            pair = [total - self.low[k], self.low[k]]
            if not self._gone(*pair, *held):
                return pair
        return None

    def filling(self, gap: int, anchor: int) -> list[int] | None:
        """At most three lengths, as few as can be, that add up to gap and are there besides the anchor."""
        if gap < 1:
            return None
        if not self._gone(gap, anchor):
            return [gap]
        if (pair := self._pair(gap, anchor)) is not None:
            return pair
        k, stuck = self.triple_at[gap], False
        while k < len(self.have):
            a = self.have[k]
            if a < gap - 1 and self.counts[a] > 0:
                if not self._gone(a, anchor) and (pair := self._pair(gap - a, a, anchor)) is not None:
                    return [a, *pair]
                stuck |= self.pair_at[gap - a] < self.pair_end[gap - a]
            if not stuck:
                self.triple_at[gap] = k + 1
            k += 1
        return None


def _exact(counts: np.ndarray, balanced: bool) -> list[tuple[list[int], int]]:
    """Full sequences, each the longest length left and an exact complement of it; counts keeps what has none."""
    capacity = len(counts) - 1
    index = Complements(counts, balanced)
    patterns: list[tuple[list[int], int]] = []
    for longest in range(capacity, 0, -1):
        while counts[longest] > 0:
            parts = [] if longest == capacity else index.filling(capacity - longest, longest)
            if parts is None:
                break  # it stays, and may fill the gap of a shorter one
            lengths, uses = np.unique([longest, *parts], return_counts=True)
            times = int((counts[lengths] // uses).min())
            counts[lengths] -= uses * times
            patterns.append((sorted([longest, *parts], reverse=True), times))
    return patterns


def _best_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Longest first, each into the open sequence with the smallest gap that takes it; like sequences are one group."""
    capacity = len(counts) - 1
    open_by_gap: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        gap = length
        while left:
            while gap <= capacity and not open_by_gap[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // length
                if left >= each:
                    open_by_gap[capacity - each * length].append(([length] * each, left // each))
                if left % each:
                    open_by_gap[capacity - left % each * length].append(([length] * (left % each), 1))
                left = 0
                continue
            own, n = open_by_gap[gap].pop()
            used = min(n, left)
            if n > used:
                open_by_gap[gap].append((own, n - used))
            open_by_gap[gap - length].append(([*own, length], used))
            left -= used
            gap = length
    return [g for groups in open_by_gap for g in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, longest first), how many such sequences].

    Exact complements, then best fit of the residuals. Consuming exact fits can leave residuals that
    pack badly, so where the plan is longer than the sum of lengths demands, it is made again with the
    complements taken in the other order, then with all lengths as residuals; the shortest plan stands.
    """
    whole = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        whole[length] = n
    least = -(-int((whole * np.arange(capacity + 1)).sum()) // capacity)
    best: list[tuple[list[int], int]] | None = None
    for balanced in (True, False, None):
        counts = whole.copy()
        made = ([] if balanced is None else _exact(counts, balanced)) + _best_fit(counts)
        if best is None or sum(t for _, t in made) < sum(t for _, t in best):
            best = made
        if sum(t for _, t in best) <= least:
            break
    return best or []


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, uses per sequence and first offset of each pattern."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            uses = lengths.count(length)
            out.setdefault(length, []).append((taken.get(length, 0), sequence, uses, offset))
            taken[length] = taken.get(length, 0) + uses * times
            offset += uses * length
        sequence += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_block: int = 200_000) -> DataFrame:
    """pieces, with sequence_id and offset.

    pieces has row, piece and length (1 to capacity) and may be read twice, so it should be a table.
    Ranks within a length are counted in blocks of rows, so no length is brought into one task.
    """
    spark: SparkSession = pieces.sparkSession
    if clash := {"sequence_id", "offset", "_block", "_own", "_rank"} & set(pieces.columns):
        raise ValueError(f"pieces has columns {sorted(clash)} already")
    totals = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in totals.collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    blocks = max(1, -(-sum(histogram.values()) // rows_per_block))
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("int"))
    before = (
        blocked.groupBy("length", "_block").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = blocked.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_block").orderBy("row", "piece")) - 1)
    ranked = ranked.join(before.hint("shuffle_hash"), ["length", "_block"]).withColumn("_rank", F.col("_before") + F.col("_own")).select(*pieces.columns, "_rank")
    at = len(pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            length, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(at).to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for k in np.unique(length):
                i = np.flatnonzero(length == k)
                first, seq, uses, off = table[int(k)]
                p = np.searchsorted(first, rank[i], "right") - 1
                within = rank[i] - first[p]
                sequence[i] = seq[p] + within // uses[p]
                offset[i] = off[p] + within % uses[p] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(sequence), pa.array(offset)], [*b.schema.names[:at], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id and offset of every piece of every row."""
    pieces, _ = cut(tokenized_pieces(df, key, text, capacity, keep_ids=keep_ids), "pieces")
    return pack(pieces, capacity).drop("row")
