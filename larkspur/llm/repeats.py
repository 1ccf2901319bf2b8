"""Repeated strings by the difference-cover algorithm, kept to equality of prefixes.

Wanted: every start of a `width`-byte string that also starts anywhere else, in any text. A full suffix
order sorts every suffix; here only the names of suffix prefixes matter, so the algorithm keeps of the
order what decides them (the two stated departures: no full order is built, and names are hashes):

* Sample: with D a difference cover modulo v, any two starts i and j have a common shift d < v that
  puts both i + d and j + d into the sample {p : p mod v in D}. If the strings at i and j are equal,
  so are the (width - v + 1)-byte tuples of the two sampled places.
* Name and sort: the tuples are named by hashes, sorted, and neighbours compared. A place whose
  name is unique is settled and is discarded, with every start that no repeated place supports.
* Recurse: the starts left are sampled with the next finer cover (273, then 31) and longer tuples.
* Merge: the last cover is modulo 1, where tuples are the whole strings: each remaining start is
  compared with its neighbours in sorted order by a name of 127 bits (two hashes) over all `width` bytes.
  Coarser levels only discard, so their 31-bit names cost work where they clash, never a byte.

Several widths may be asked for at once. The narrowest goes through all levels; a start can only repeat
at a wider width where all narrower strings within it do, so each further width is one last level more.

Texts travel once, into a bucketed table of packets; afterwards only sorted name lists (four or sixteen
bytes a place, each name once a packet) are shuffled by name range, and one bit a name returns. So a
string that half the corpus holds is one name from each packet, in one range among many. Packets and
ranges grow with the square root of the text (4 MB up to 64 GB, 128 MB at 64 TB and beyond), so that
a packet still has several names for each range. Whole texts that are equal are found first in the
same way; one of them stands for all.

Defined results: null texts are empty; texts shorter than `width` lose nothing; of equal texts of at
least `width` bytes every byte is removed; a very long text is one packet of its own; rows with equal
ids are separate texts; an empty table gives an empty result; input columns named like a result column
are dropped. There are no ties: a string either starts elsewhere or does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import POWERS_2, U64, bounded_batches, cut, gathered, prefix_hash, released, scratch_path, spans, text_buffer, window_hash

WIDTH = 400
#: Fifty words of five bytes, the space counted: what a passage of over fifty words has at least in prose.
PASSAGE = 250
#: Perfect difference sets: every difference modulo v occurs.
COVERS = {
    273: (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256),
    183: (0, 1, 3, 31, 45, 50, 56, 65, 77, 125, 143, 147, 160, 176),
    133: (0, 1, 3, 17, 21, 58, 65, 73, 100, 105, 111, 124),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    31: (1, 5, 11, 24, 25, 27),
    7: (1, 2, 4),
    1: (0,),
}
LEAST_PACKET, MOST_PACKET = 4 << 20, 128 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")


def moduli(widths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(width, v, bytes of a name that are shuffled) of the levels: tuples of a quarter of the width at least.

    Widths ascend; each after the first has only the last level.
    """
    fits = [v for v in sorted(COVERS, reverse=True) if v > 7 and widths[0] - v + 1 >= widths[0] // 4]
    coarse = fits[:1] + [31] * (len(fits) > 1)
    return [(widths[0], v, 4) for v in coarse] + [(w, 1, 16) for w in widths]


def packet_size(total: int) -> int:
    """Bytes of a packet, and of the names of a range."""
    return min(MOST_PACKET, max(LEAST_PACKET, int(16 * total**0.5)))


class Names:
    """The distinct names of a packet at one level, as sent, and the way back from replies to places.

    At the last level a name is two hashes; the second tells apart what the first does not.
    """

    def __init__(self, h: np.ndarray, ranges: int, second: np.ndarray | None = None) -> None:
        self.unique, first, self.inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.second = None if second is None else second[first]
        if second is not None and (self.second[self.inverse] != second).any():
            both = np.zeros(len(h), [("a", np.uint64), ("b", np.uint64)])
            both["a"], both["b"] = h, second
            pairs, self.inverse, count = np.unique(both, return_inverse=True, return_counts=True)
            self.unique, self.second = pairs["a"].copy(), pairs["b"].copy()
        self.several = count > 1
        self.range = ((self.unique >> U64(32)) * U64(ranges)) >> U64(32)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """(range, names with their lowest bit telling whether the packet has them more than once, second hashes)."""
        word = (self.unique & ~U64(1)) | self.several.astype(U64)
        word = word.astype("<u4") if self.second is None else word
        for r, i, j in self.slices():
            yield r, word[i:j].tobytes() + (b"" if self.second is None else self.second[i:j].tobytes())

    def slices(self) -> Iterator[tuple[int, int, int]]:
        """(range, from, to) of the sorted names."""
        at = [*np.flatnonzero(np.diff(self.range, prepend=self.range[:1] + U64(1))).tolist(), len(self.range)]
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield int(self.range[i]), i, j

    def repeated(self, replies: dict[int, bytes]) -> np.ndarray:
        """For each place whether its name occurs elsewhere."""
        out = np.zeros(len(self.unique), bool)
        for r, i, j in self.slices():
            out[i:j] = np.unpackbits(np.frombuffer(replies[r], np.uint8), count=j - i) == 1
        return (out | self.several)[self.inverse]


def compare(blobs: list[bytes], size: int) -> list[bytes]:
    """Sort the names of a range over all packets, compare neighbours, answer one bit a name."""
    lengths = [len(b) // size for b in blobs]
    word = np.concatenate([np.frombuffer(b, "<u4" if size == 4 else "<u8", n) for b, n in zip(blobs, lengths, strict=True)])
    order = np.argsort(word >> 1)
    name = word[order] >> 1
    same = name[1:] == name[:-1]
    if size > 8:
        second = np.concatenate([np.frombuffer(b, "<u8", n, 8 * n) for b, n in zip(blobs, lengths, strict=True)])
        alike = second[order][1:] == second[order][:-1]
        if (same & ~alike).any():  # only here does the order within equal first hashes matter
            order = np.lexsort((second, word >> 1))
            name, alike = word[order] >> 1, second[order][1:] == second[order][:-1]
            same = name[1:] == name[:-1]
        same &= alike
    twice = np.zeros(len(word), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(word), bool)
    hit[order] = twice
    hit |= (word & 1) == 1
    ends = np.cumsum(lengths)
    return [np.packbits(hit[e - n : e]).tobytes() for n, e in zip(lengths, ends, strict=True)]


def compare_texts(bids: list[int], blobs: list[bytes]) -> list[bytes]:
    """For each whole-text digest of a range: whether this packet's copy stands for the text, and whether it has others."""
    parts = [np.frombuffer(b, "V17") for b in blobs]
    owner = np.repeat(np.array(bids), [len(p) for p in parts])
    raw = np.concatenate(parts).view(np.uint8).reshape(-1, 17)
    a, b = (np.ascontiguousarray(raw[:, i : i + 8]).view("<u8").ravel() for i in (0, 8))
    order = np.lexsort((owner, b, a))
    first = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    group = np.cumsum(first) - 1
    many = (np.bincount(group) > 1)[group]
    stands, copied = np.zeros(len(raw), bool), raw[:, 16] == 1
    stands[order] = first
    copied[order] |= many
    copied[order] |= np.bincount(group, copied[order].astype(float))[group] > 0
    ends = np.cumsum([len(p) for p in parts])
    return [np.packbits(np.concatenate([stands[e - len(p) : e], copied[e - len(p) : e]])).tobytes() for p, e in zip(parts, ends, strict=True)]


class Packet:
    """The texts of one packet, and what replies have told of them so far."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, ranges: list[int]) -> None:
        self.data, self.offsets, self.ranges = data, offsets, ranges
        self.long = np.flatnonzero(np.diff(offsets) >= width)

    # whole texts
    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct digests of the long texts in order, how often each occurs, and which text has which."""
        raw = b"".join(hashlib.md5(self.data[self.offsets[i] : self.offsets[i + 1]]).digest() for i in self.long)
        unique, inverse, count = np.unique(np.array([raw[k : k + 16].hex() for k in range(0, len(raw), 16)], dtype="U32"), return_inverse=True, return_counts=True)
        return unique, inverse, count

    def text_messages(self) -> Iterator[tuple[int, bytes]]:
        unique, _, count = self.digests()
        rng = [int(u[:8], 16) * self.ranges[0] >> 32 for u in unique]
        for r in dict.fromkeys(rng):
            yield r, b"".join(bytes.fromhex(str(u)) + bytes([int(c > 1)]) for u, c, own in zip(unique, count, rng, strict=True) if own == r)

    def texts(self, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the texts that stand for all their copies, the texts that have copies)."""
        unique, inverse, _ = self.digests()
        stands, copied = np.zeros(len(unique), bool), np.zeros(len(unique), bool)
        rng = np.array([int(u[:8], 16) * self.ranges[0] >> 32 for u in unique], dtype=np.int64)
        for r in np.unique(rng):
            i = np.flatnonzero(rng == r)
            bits = np.unpackbits(np.frombuffer(replies[int(r)], np.uint8), count=2 * len(i)) == 1
            stands[i], copied[i] = bits[: len(i)], bits[len(i) :]
        first = np.zeros(len(self.long), bool)
        first[np.unique(inverse, return_index=True)[1]] = True
        return self.long[first & stands[inverse]], self.long[copied[inverse]] if len(self.long) else self.long

    # strings
    def starts(self, texts: np.ndarray, width: int) -> np.ndarray:
        """Mask of the places where a string of full width starts in one of the texts."""
        texts = texts[self.offsets[texts + 1] - self.offsets[texts] >= width]
        edge = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(edge, self.offsets[texts], 1)
        np.add.at(edge, self.offsets[texts + 1] - width + 1, -1)
        return np.cumsum(edge[:-1], dtype=np.int8) > 0

    def wider(self, repeated: np.ndarray, texts: np.ndarray, narrow: int, width: int) -> np.ndarray:
        """The starts of the wider width all of whose narrower strings repeat."""
        upto = np.zeros(len(repeated) + 1, np.int64)
        np.cumsum(repeated, out=upto[1:])
        place = np.flatnonzero(self.starts(texts, width) & repeated)
        out = np.zeros(len(repeated), bool)
        out[place[upto[place + width - narrow + 1] - upto[place] == width - narrow + 1]] = True
        return out

    def sample(self, candidates: np.ndarray, v: int) -> np.ndarray:
        """The sampled places p with a candidate start in (p - v, p]."""
        n = len(self.data)
        if v == 1:
            return np.flatnonzero(candidates)
        place = (np.arange(0, n, v)[:, None] + np.array(COVERS[v])).ravel()
        place = place[place < n]
        upto = np.zeros(n + 1, np.int32)
        np.cumsum(candidates, dtype=np.int32, out=upto[1:])
        return place[upto[place + 1] > upto[np.maximum(place - v + 1, 0)]]

    def narrow(self, candidates: np.ndarray, place: np.ndarray, v: int) -> np.ndarray:
        """The candidates i with one of the (repeated) places in [i, i + v)."""
        if v == 1:
            out = np.zeros(len(candidates), bool)
            out[place] = True
            return out
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, np.maximum(place - v + 1, 0), 1)
        np.add.at(edge, place + 1, -1)
        return candidates & (np.cumsum(edge[:-1]) > 0)


def _inside(p: Packet, place: np.ndarray, size: int) -> np.ndarray:
    """Places whose tuple ends within their text."""
    return place[p.offsets[np.searchsorted(p.offsets, place, "right")] - place >= size]


def advance(p: Packet, replies: dict[int, dict[int, bytes]], level: int, levels: list[tuple[int, int, int]]) -> tuple[Names | None, list[np.ndarray], np.ndarray]:
    """(names of the level, the repeated starts of each width that is done, the texts with copies), from the replies below it."""
    stand, copied = p.texts(replies.get(0, {}))
    candidates = p.starts(stand, levels[0][0])
    h = h2 = None
    done: list[np.ndarray] = []
    for k, (width, v, _) in enumerate(levels, 1):
        if k > 1 and width != levels[k - 2][0]:
            candidates = p.wider(candidates, stand, levels[k - 2][0], width)
        place = _inside(p, p.sample(candidates, v), width - v + 1)
        if h is None and len(place):
            h = prefix_hash(p.data)
        if v == 1 and h2 is None and len(place):
            h2 = prefix_hash(p.data, POWERS_2)
        stop, none = place + (width - v + 1), np.zeros(0, U64)
        names = Names(window_hash(h, place, stop) if len(place) else none, p.ranges[k], None if v > 1 else window_hash(h2, place, stop, POWERS_2) if len(place) else none)
        if k == level:
            return names, done, copied
        candidates = p.narrow(candidates, place[names.repeated(replies.get(k, {}))], v)
        if v == 1:
            done.append(candidates)
    return None, done, copied


def _result(p: Packet, repeated: np.ndarray, copied: np.ndarray, width: int) -> Iterator[tuple[int, int, int, str, bytes, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256, kept and kept_text of each text of the packet.

    kept_text leaves out the remains of characters that a removed span cuts through.
    """
    whole = set(copied[p.offsets[copied + 1] - p.offsets[copied] >= width].tolist())
    has = np.zeros(len(p.data) + 1, np.int32)
    np.cumsum(repeated, dtype=np.int32, out=has[1:])
    for i, (a, b) in enumerate(zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True)):
        n = b - a
        if i in whole:
            yield n, n, 1, EMPTY_SHA, b"", ""
        elif has[b] == has[a]:
            kept = p.data[a:b].tobytes()
            yield n, 0, 0, hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")
        else:
            start = np.flatnonzero(repeated[a:b])
            edge = np.zeros(n + 1, np.int32)
            edge[start] += 1
            edge[start + width] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            turns = np.flatnonzero(np.diff(gone, prepend=True, append=True)).tolist()
            parts = [p.data[a + i : a + j].tobytes() for i, j in zip(turns[::2], turns[1::2], strict=True)]
            kept = b"".join(parts)
            yield n, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept, "".join(x.decode("utf-8", "ignore") for x in parts)


def remove_repeats(
    df: DataFrame, text: str = "text", width: int = WIDTH, keep: tuple[str, ...] = ("kept",), packet_bytes: int | None = None, range_bytes: int | None = None,
    passage: int | None = None,
) -> DataFrame:
    """The columns of df but `text`, and n_bytes, n_removed, n_spans, kept_sha256 and those of `keep`: kept (bytes), kept_text.

    With `passage`, a narrower width, also n_passage_bytes and passage_text: what goes and what stays at that width.
    """
    if passage is not None and not 0 < passage < width:
        raise ValueError("passage is a width narrower than the other")
    spark = df.sparkSession
    bounded_batches(spark)
    added = (*RESULTS, "n_passage_bytes", "passage_text") if passage else RESULTS
    rest = [f for f in df.schema if f.name != text and f.name not in added]
    body = df.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{f.name}`") for f in rest])
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    levels = moduli((passage, width) if passage else (width,))
    least = levels[0][0]
    packet_bytes, range_bytes = packet_bytes or packet_size(total), range_bytes or packet_size(total)
    buckets = max(4, min(100_000, total // (24 << 20)))
    ranges = [max(1, int(total * share // range_bytes)) for share in (0.01, *(len(COVERS[v]) / v * size * (1.0 if k == 0 else 0.3) for k, (_, v, size) in enumerate(levels)))]

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in gathered(batches, packet_bytes):
            data, offsets = text_buffer(b.column(0))
            others = b.select(b.schema.names[1:]) if b.num_columns > 1 else None
            for i, j in spans(offsets, packet_bytes):
                blob = b""
                if others is not None:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, others.schema) as w:
                        w.write_batch(others.slice(i, j - i))
                    blob = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([(offsets[i : j + 1] - offsets[i]).tobytes()], pa.binary()), pa.array([data[offsets[i] : offsets[j]].tobytes()], pa.binary()), pa.array([blob], pa.binary())],
                    ["bid", "offsets", "data", "rest"],
                )
                number += 1

    path = scratch_path(spark, "packets")
    table = f"packets_{path[-32:]}"  # the two go together
    made = body.mapInArrow(released(packets), "bid long, offsets binary, data binary, rest binary")
    made.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "bid").saveAsTable(table)
    source = spark.table(table)
    answers: list[DataFrame] = []

    def with_replies(columns: list[str]) -> DataFrame:
        base = source.select(*columns)
        if not answers:
            return base.withColumn("replies", F.lit(None).cast("array<struct<level:int,rng:int,mask:binary>>"))
        every = answers[0]
        for a in answers[1:]:
            every = every.unionByName(a)
        # as many partitions as buckets, else the packets would be shuffled to match the replies
        told = every.repartition(buckets, "bid").groupBy("bid").agg(F.collect_list(F.struct("level", "rng", "mask")).alias("replies"))
        return base.join(told.hint("shuffle_hash"), "bid", "left").select(*columns, "replies")

    def read(row: dict) -> tuple[Packet, dict[int, dict[int, bytes]]]:
        replies: dict[int, dict[int, bytes]] = {}
        for r in row["replies"] or []:
            replies.setdefault(r["level"], {})[r["rng"]] = r["mask"]
        return Packet(np.frombuffer(row["data"], np.uint8), np.frombuffer(row["offsets"], np.int64), least, ranges), replies

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(len(b)):
                yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}

    def asking(level: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                p, replies = read(row)
                sent = list(p.text_messages() if level == 0 else advance(p, replies, level, levels)[0].messages())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in sent], pa.int32()), pa.array([row["bid"]] * len(sent), pa.int64()), pa.array([m for _, m in sent], pa.binary())], ["rng", "bid", "names"]
                )

        return ask

    def answering(level: int):
        def answer(group: pa.Table) -> pa.Table:
            bids, blobs = group.column("bid").to_pylist(), group.column("names").to_pylist()
            masks = compare_texts(bids, blobs) if level == 0 else compare(blobs, levels[level - 1][2])
            return pa.table([group.column("bid"), pa.array([level] * len(bids), pa.int32()), group.column("rng"), pa.array(masks, pa.binary())], names=["bid", "level", "rng", "mask"])

        return answer

    for level in range(len(levels) + 1):
        asked = with_replies(["bid", "offsets", "data"]).mapInArrow(released(asking(level)), "rng int, bid long, names binary")
        told, _ = cut(asked.groupBy("rng").applyInArrow(answering(level), "bid long, level int, rng int, mask binary"), f"replies-{level}")
        answers.append(told)

    arrow = df.limit(0).select(*[F.col(f"`{f.name}`") for f in rest]).toArrow().schema if rest else pa.schema([])
    kinds = {n: pa.int64() if n.startswith("n_") else pa.binary() if n == "kept" else pa.string() for n in added}
    names = [n for n in added if n in keep or n not in ("kept", "kept_text")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            p, replies = read(row)
            _, repeated, copied = advance(p, replies, 0, levels)
            columns = dict(zip(RESULTS, zip(*_result(p, repeated[-1], copied, width), strict=True), strict=True))
            if passage:
                short = list(zip(*_result(p, repeated[0], copied, passage), strict=True))
                columns |= {"n_passage_bytes": short[1], "passage_text": short[5]}
            others = pa.ipc.open_stream(row["rest"]).read_next_batch().columns if row["rest"] else []
            yield pa.RecordBatch.from_arrays([*others, *(pa.array(columns[n], kinds[n]) for n in names)], [*arrow.names, *names])

    plain = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{n} {plain[kinds[n]]}" for n in names])
    return with_replies(["bid", "offsets", "data", "rest"]).mapInArrow(released(finish), fields)
