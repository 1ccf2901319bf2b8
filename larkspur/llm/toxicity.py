"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of word unigrams, bigrams and skip-grams (one and two words left out) in a
32-bit hash space. Per-coordinate learning rates and the L1 penalty leave a few thousand weights,
which is what is broadcast.

All labelled rows are learnt from. FTRL goes from row to row, so shares of about ROWS rows, by hash of the
id, are learnt side by side in two steps. First each share is learnt alone from all slots; a slot that gets a
weight in any share is a candidate. Then all rows, reduced to candidates, are learnt in shares of about
FEW_ROWS, each of which bears its part of the penalties; after every epoch the shares' states are averaged, and
all go on from there. Every row's gradient thus counts the same. A table of one share is learnt in the first
step alone. What the driver gets grows with the shares times the candidates, not with the texts.

Defined results: null and empty texts have no feature and score by the bias alone; a very long text is
scored whole, two megabytes of others at a time beside it, but not learnt from above `max_bytes`; repeated
rows get the same score; labelled rows of equal hash come in the order of label and text, so training does
not depend on partitions;
without labels of both classes all scores are those of the label there is, or 0.5; an empty table gives
an empty result; `score_texts` ignores other columns and `accepted` keeps them all, whatever their names.
A score equal to the threshold counts as toxic.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, cut, filtered, gathered, remove, spans, text_buffer
from .labelled import known, texts_of
from .textfeat import grams, words

BITS = 32
#: Labelled rows of a share, on average, and the bytes of text above which a share is divided.
ROWS = 6_000
BYTES = 32 << 20
#: The same where rows are reduced to candidates; the bytes are those of their slots.
FEW_ROWS = 20_000
FEW_BYTES = 16 << 20


@dataclass(frozen=True)
class Settings:
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 15
    #: Slots in fewer documents of a share are left out at once.
    min_docs: int = 4
    #: The longest text that is learnt from: the only bound on training.
    max_bytes: int = 1 << 20
    threshold: float = 0.7


@dataclass(frozen=True)
class Weights:
    slots: np.ndarray
    values: np.ndarray
    bias: float


def features(batch_text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct slots of each text."""
    data, offsets = text_buffer(batch_text)
    out = []
    for a, b in spans(offsets):
        part = offsets[a : b + 1] - offsets[a]
        _, _, owner, h = words(data[offsets[a] : offsets[b]], part)
        owner, slots = grams(owner, h, BITS)
        key = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | slots.astype(np.uint64))
        at = np.searchsorted(key >> np.uint64(BITS), np.arange(b - a + 1))
        low = (key & np.uint64((1 << BITS) - 1)).astype(np.uint32)
        out += [low[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
    return out


class State:
    """FTRL-proximal's sums over n_slots slots and the bias, which comes last and has no L1; share is the part of the penalties that the rows bear."""

    def __init__(self, n_slots: int, s: Settings, share: float = 1.0) -> None:
        self.z, self.n = np.zeros(n_slots + 1), np.zeros(n_slots + 1)
        self.l1, self.l2, self.s = np.full(n_slots + 1, s.l1 * share), s.l2 * share, s
        self.l1[-1] = 0.0

    def weight(self, i: np.ndarray) -> np.ndarray:
        zi, l1 = self.z[i], self.l1[i]
        w = -(zi - np.sign(zi) * l1) / ((self.s.beta + np.sqrt(self.n[i])) / self.s.alpha + self.l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    def epoch(self, rows: Iterable[tuple[np.ndarray, int]]) -> None:
        """One pass over rows of (places of slots, label), in their order."""
        bias = np.array([len(self.z) - 1])
        for x, y in rows:
            i = np.concatenate([x, bias])
            w = self.weight(i)
            g = 1 / (1 + np.exp(-min(max(w.sum(), -35.0), 35.0))) - y
            n = self.n[i]
            grown = np.sqrt(n + g * g)
            self.z[i] += g - (grown - np.sqrt(n)) / self.s.alpha * w
            self.n[i] += g * g

    def weights(self, slots: np.ndarray) -> Weights:
        w = self.weight(np.arange(len(self.z)))
        used = np.flatnonzero(w[:-1])
        return Weights(slots[used], w[used], float(w[-1]))


def ftrl(rows: list[tuple[np.ndarray, int]], s: Settings) -> Weights:
    """FTRL-proximal in the given order of rows (slots, label)."""
    if not rows or len({y for _, y in rows}) < 2:
        p = 0.5 if not rows else (0.001, 0.999)[rows[0][1]]
        return Weights(np.zeros(0, np.uint32), np.zeros(0), float(np.log(p / (1 - p))))
    slots, docs = np.unique(np.concatenate([x for x, _ in rows]), return_counts=True)
    slots = slots[docs >= s.min_docs]
    coded = []
    for x, y in rows:
        at = np.minimum(np.searchsorted(slots, x), max(len(slots) - 1, 0))
        coded.append((at[slots[at] == x] if len(slots) else at[:0], y))
    state = State(len(slots), s)
    for _ in range(s.epochs):
        state.epoch(coded)
    return state.weights(slots)


def shares_alone(rows: DataFrame, n_rows: int, s: Settings) -> list[tuple[set[int], Weights]]:
    """The labels and the model of each share of rows (o, y, text)."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, BYTES, 2):
            y = b.column(1).to_pylist()
            w = ftrl(list(zip(features(b.column(2)), y, strict=True)), s)
            yield pa.RecordBatch.from_arrays([pa.array([bytes(sorted(set(y)))]), pa.array([w.slots.tobytes()], pa.binary()), pa.array([w.values.tobytes()], pa.binary()), pa.array([w.bias])], ["y", "slots", "values", "bias"])

    ordered = rows.repartition(-(-n_rows // ROWS) or 1, "o").sortWithinPartitions("o", "y", "text")
    made = ordered.mapInArrow(train, "y binary, slots binary, `values` binary, bias double").collect()
    return [(set(r[0]), Weights(np.frombuffer(r[1], np.uint32), np.frombuffer(r[2], np.float64), r[3])) for r in made]


def shares_together(rows: DataFrame, n_rows: int, slots: np.ndarray, s: Settings) -> Weights:
    """The model over the given sorted slots of all rows (o, y, text): states of shares, averaged after each epoch."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(slots)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, place = hits(b.column(2), shared.value)
            ends = np.searchsorted(row, np.arange(len(b) + 1))
            x = [place[a:e].astype(np.int32).tobytes() for a, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["o", "y", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(gathered(batches, FEW_BYTES, 2)):
            y, x = np.array(b.column(1).to_pylist(), np.int8), b.column(2).to_pylist()
            size = np.array([len(v) // 4 for v in x], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0)[:1], pa.array([k], pa.int32()), *(pa.array([v], pa.binary()) for v in (y.tobytes(), size.tobytes(), b"".join(x)))], ["o", "k", "y", "size", "x"])

    few = rows.mapInArrow(reduce, "o long, y int, x binary").repartition(-(-n_rows // FEW_ROWS) or 1, "o").sortWithinPartitions("o", "y", "x")
    table, path = cut(few.mapInArrow(pack, "o long, k int, y binary, size binary, x binary"), "candidates")
    state = State(len(slots), s, 1 / table.count())

    def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                y, size, x = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in ((2, np.int8), (3, np.int64), (4, np.int32)))
                own = copy.deepcopy(state)
                own.epoch(zip(np.split(x, np.cumsum(size)[:-1]), y.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], b.column(1)[i : i + 1], pa.array([own.z.tobytes()], pa.binary()), pa.array([own.n.tobytes()], pa.binary())], ["o", "k", "z", "n"])

    for _ in range(s.epochs):
        made = sorted(table.mapInArrow(epoch, "o long, k int, z binary, n binary").collect(), key=lambda r: (r.o, r.k))
        state.z, state.n = (sum(np.frombuffer(r[c]) for r in made) / len(made) for c in ("z", "n"))
    remove(spark, path)
    return state.weights(slots)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), modulus: int = 3, held: int = 1) -> Weights:
    """Weights from all labelled rows that are not held out."""
    bounded_batches(docs.sparkSession)
    rows, path = cut(texts_of(docs, known(labels, "toxic", modulus, held), modulus, held, settings.max_bytes), "labelled")
    n_rows = rows.count()
    alone = shares_alone(rows, n_rows, settings)
    found = set().union(*(y for y, _ in alone))
    if len(found) < 2:
        model = ftrl([(np.zeros(0, np.uint32), y) for y in found], settings)
    elif len(alone) == 1:
        model = alone[0][1]
    else:
        model = shares_together(rows, n_rows, np.unique(np.concatenate([w.slots for _, w in alone])), settings)
    remove(docs.sparkSession, path)
    return model


def hits(column: pa.Array, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs (text, place of one of its slots in the given sorted ones); only what is near one is ever sorted."""
    data, offsets = text_buffer(column)
    seen = np.zeros(1 << 20, bool)
    seen[slots >> np.uint32(BITS - 20)] = True
    pairs = [np.zeros(0, np.int64)]
    for a, b in spans(offsets):
        _, _, owner, h = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        owner, grown = grams(owner, h, BITS)
        near = np.flatnonzero(seen[grown >> (BITS - 20)])
        if len(near) == 0 or len(slots) == 0:
            continue
        at = np.minimum(np.searchsorted(slots, grown[near]), len(slots) - 1)
        hit = slots[at] == grown[near]
        pairs.append(np.unique((a + owner[near][hit].astype(np.int64)) * len(slots) + at[hit]))
    pair = np.concatenate(pairs)
    return pair // max(len(slots), 1), pair % max(len(slots), 1)


def score_batch(column: pa.Array, w: Weights) -> np.ndarray:
    """Probabilities of the texts."""
    row, place = hits(column, w.slots)
    total = w.bias + np.bincount(row, w.values[place], len(column))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score_texts(df: DataFrame, w: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row's whole text."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_batch(b.column(1), shared.value))], ["doc_id", "score"])

    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(df: DataFrame, w: Weights, threshold: float = Settings.threshold, text: str = "text") -> DataFrame:
    """The rows of df that score below the threshold, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(w)
    return filtered(df, text, lambda column: score_batch(column, shared.value) < threshold)
