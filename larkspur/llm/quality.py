"""Quality by Bradley-Terry pairwise ranking over dense text statistics.

The chance that document a is better than b is the logistic of w . (x_a - x_b); w minimises the
logistic loss over all pairs of a row labelled good and a row labelled bad. A document's raw score is
w . x, and the threshold is the quantile of the raw scores of all labelled rows that leaves as many
below as are labelled bad.

The loss of a pair depends on the difference of two scores alone, so no pair is ever made. Scores fall
into panels of width two; in each, the logistic function is its interpolant at ORDER Chebyshev points
to 14 digits (its poles lie pi away from the real line), and the sums over all pairs follow from each class's
moments at those points. Newton's method then takes two passes over the statistics a step.

Defined results: null and empty texts have all-zero statistics and are scored like any other; a very
long text is trained on and scored whole; repeated rows get equal scores; rows that share a labelled id
are all trained on; labelled rows come by hash, label and statistics, so training does not depend on
partitions; of equal raw scores the quantile takes all or none; without labelled rows of both
classes every text has the same score, above the threshold; an empty table gives an empty result; `score_texts` ignores other columns
and `accepted` keeps them all, whatever their names. A score equal to the threshold is accepted.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev
from pyspark.sql import DataFrame, functions as F

from .common import U64, bounded_batches, cut, filtered, gathered, prefix_hash, released, remove, spans, text_buffer, window_hash
from .labelled import known, remainder
from .textfeat import LOWER, WORD, words

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_PLAIN = np.isin(_BYTE, [ord(c) for c in ".,;:'\"-()?"])
_SYMBOL = ~WORD & ~_SPACE & ~_PLAIN
CLASSES = (_UPPER, _DIGIT, _SPACE, _PLAIN, _SYMBOL, _BYTE >= 128, _BYTE == 10)
N_FEATURES = len(CLASSES) + 11
#: Labelled rows of a partition of the training table, on average; a pass sends the moments of each to the driver.
ROWS = 20_000
#: Chebyshev points of a panel, and the map from values of Chebyshev polynomials to weights of the points.
ORDER = 18
POINTS = chebyshev.chebpts1(ORDER)
TO_POINTS = chebyshev.chebvander(POINTS, ORDER - 1).T * (np.where(np.arange(ORDER) == 0, 1, 2) / ORDER)[:, None]

#: Calls a function (statistics, labels) on all labelled rows, part by part, and lists what it returns in a fixed order.
Each = Callable[[Callable], list]


@dataclass(frozen=True)
class Settings:
    l2: float = 1e-3
    #: Newton's steps after which training that has not converged is an error; about a dozen are taken.
    steps: int = 300
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    spread: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (standard(x, self.mean, self.scale) * self.weight).sum(1)  # unlike a matrix product, the same for equal rows

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the raw score, and exactly `threshold` at the quantile cut."""
        at = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.spread + at, -35, 35)))


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per text."""
    key = np.unique((owner.astype(U64) << U64(40)) | (h >> U64(24)))
    return np.bincount((key >> U64(40)).astype(np.int64), minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """N_FEATURES dense statistics of each whole text."""
    data, offsets = text_buffer(column)
    out = np.zeros((len(column), N_FEATURES))
    for a, b in spans(offsets):
        part, local, n = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], b - a
        size = np.maximum(np.diff(local), 1).astype(float)
        x = out[a:b]
        for k, table in enumerate(CLASSES):
            sums = np.zeros(len(part) + 1, np.int32)
            np.cumsum(table[part], dtype=np.int32, out=sums[1:])
            x[:, k] = (sums[local[1:]] - sums[local[:-1]]) / size
        k = len(CLASSES)
        start, end, owner, h = words(part, local)
        count = np.bincount(owner, minlength=n)
        some = np.maximum(count, 1).astype(float)
        length = (end - start).astype(float)
        same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        mean = np.bincount(owner, length, n) / some
        x[:, k] = np.log1p(count)
        x[:, k + 1] = mean
        x[:, k + 2] = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
        x[:, k + 3] = np.bincount(owner, length <= 3, n) / some
        x[:, k + 4] = np.bincount(owner, length > 20, n) / some
        x[:, k + 5] = np.bincount(owner[1:][same], minlength=n) / some
        x[:, k + 6] = _distinct(owner, h, n) / some
        x[:, k + 7] = x[:, k + 6] * np.log1p(count)
        x[:, k + 8] = np.bincount(owner, _UPPER[part[start]] & _UPPER[part[end - 1]] & (length > 1), n) / some
        # lines: how many are said before
        breaks = np.flatnonzero(part == 10)
        first = np.unique(np.concatenate([local[:-1][np.diff(local) > 0], breaks + 1]))
        first = first[first < len(part)]
        if len(first):
            stop = np.append(first[1:], len(part))
            line_owner = np.searchsorted(local, first, "right") - 1
            stop = np.minimum(stop, local[line_owner + 1])
            lines = np.bincount(line_owner, minlength=n)
            x[:, k + 9] = 1 - _distinct(line_owner, window_hash(prefix_hash(LOWER[part]), first, stop), n) / np.maximum(lines, 1)
            x[lines == 0, k + 9] = 0
        x[:, k + 10] = np.minimum(x[:, k + 5] * some, 50)
    return out


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _panels(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each score's panel, and the weights of the panel's points at it."""
    panel = np.floor(raw / 2).astype(np.int64)
    return panel, chebyshev.chebvander(raw - (2 * panel + 1), ORDER - 1) @ TO_POINTS


class _Pairs:
    """The mean logistic loss over all pairs (good, bad) at w, with its derivatives, from moments of each class."""

    def __init__(self, each: Each, model: Model, l2: float, n: np.ndarray) -> None:
        def moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            panel, at = _panels(model.raw(x))
            columns = np.hstack([np.ones((len(x), 1)), standard(x, model.mean, model.scale)])
            own, place = np.unique(panel, return_inverse=True)
            out = np.zeros((len(own), 2, ORDER, 1 + N_FEATURES))
            for p in range(len(own)):
                for c in (0, 1):
                    some = np.flatnonzero((place == p) & (y == c))
                    out[p, c] = at[some].T @ columns[some]
            return own, out

        parts = each(moments)
        self.each, self.model, self.l2, self.n = each, model, l2, n
        self.panels = np.unique(np.concatenate([own for own, _ in parts]))
        m = np.zeros((len(self.panels), 2, ORDER, 1 + N_FEATURES))
        for own, some in parts:
            m[np.searchsorted(self.panels, own)] += some
        m = m.transpose(1, 0, 2, 3).reshape(2, -1, 1 + N_FEATURES) / n[:, None, None]
        (bad, bad_x), (good, good_x) = ((m[c, :, 0], m[c, :, 1:]) for c in (0, 1))
        at = (2 * self.panels[:, None] + 1 + POINTS).ravel()
        self.value, self.slope, self.cross = l2 / 2 * (model.weight @ model.weight), l2 * model.weight, np.zeros((N_FEATURES, N_FEATURES))
        #: Mean second derivative over the other class, at each point, for bad and good rows.
        self.bend = np.zeros((2, len(at)))
        for a in range(0, len(at), ORDER):
            p = slice(a, a + ORDER)
            gap = at[p, None] - at
            chance = 0.5 * (1 + np.tanh(gap / 2))
            second = 0.25 / np.cosh(np.clip(gap / 2, -350, 350)) ** 2
            self.value += bad[p] @ np.logaddexp(0, gap) @ good
            self.slope = self.slope + bad_x[p].T @ (chance @ good) - good_x.T @ (bad[p] @ chance)
            self.cross += bad_x[p].T @ second @ good_x
            self.bend[0, p] = second @ good
            self.bend[1] += bad[p] @ second

    def curvature(self) -> np.ndarray:
        model, panels, bend, n = self.model, self.panels, self.bend.reshape(2, -1, ORDER), self.n

        def own(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            panel, at = _panels(model.raw(x))
            z = standard(x, model.mean, model.scale)
            return z.T @ (z * ((at * bend[y, np.searchsorted(panels, panel)]).sum(1) / n[y])[:, None])

        return sum(self.each(own)) - self.cross - self.cross.T + self.l2 * np.eye(N_FEATURES)


def ranking(each: Each, s: Settings) -> Model:
    """The minimum of the logistic loss over all pairs of good and bad rows, by Newton's method."""
    parts = each(lambda x, y: (np.bincount(y, minlength=2), x.sum(0)))
    n = sum((c for c, _ in parts), np.zeros(2))
    if n.min() == 0:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -1.0, 1.0, s.threshold)
    mean = sum(x for _, x in parts) / n.sum()
    scale = np.sqrt(sum(each(lambda x, y: ((x - mean) ** 2).sum(0))) / n.sum())
    scale[scale < 1e-9] = 1.0
    now = _Pairs(each, Model(mean, scale, np.zeros(N_FEATURES), 0.0, 1.0, s.threshold), s.l2, n)
    for _ in range(s.steps):
        step = np.linalg.solve(now.curvature(), now.slope)
        gain, size = now.slope @ step, 1.0
        # Where hardly anything is left to gain, the loss has too few digits to judge a step, and none is needed.
        while (new := _Pairs(each, replace(now.model, weight=now.model.weight - size * step), s.l2, n)).value > now.value - 1e-4 * size * gain and gain > 1e-10:
            size /= 2
        now = new
        if gain < 1e-14:
            return now.model
    raise RuntimeError(f"no minimum of the ranking loss after {s.steps} steps")


def bradley_terry(x: np.ndarray, y: np.ndarray, s: Settings) -> Model:
    """`ranking` of rows in memory."""
    return ranking(lambda f: [f(x, y)] if len(x) else [], s)


def _ordered(raw: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the numbers."""
    bits = (raw + 0.0).view(np.uint64)
    return np.where(bits >> U64(63), ~bits, bits | U64(1 << 63))


def score_at(each: Each, model: Model, rank: int) -> float:
    """The raw score of a rank (from 0) among all rows, found by sixteen bits a pass."""
    key = 0
    for shift in (48, 32, 16, 0):

        def digits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = _ordered(model.raw(x)) >> U64(shift)
            return np.unique(k[k >> U64(16) == key] & U64(0xFFFF), return_counts=True)

        count = np.zeros(1 << 16, np.int64)
        for digit, some in each(digits):
            count[digit.astype(np.int64)] += some
        until = np.cumsum(count)
        d = int(np.searchsorted(until, rank, "right"))
        rank -= int(until[d] - count[d])
        key = key << 16 | d
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def with_threshold(each: Each, model: Model) -> Model:
    """The cut leaves as many of all labelled rows below it as are labelled bad; it lies midway to the next score."""
    bad, good = sum(each(lambda x, y: np.bincount(y, minlength=2)), np.zeros(2, int)).tolist()
    if min(bad, good) == 0:
        return model
    at = (score_at(each, model, bad - 1) + score_at(each, model, bad)) / 2
    spread = sum(each(lambda x, y: float(np.abs(model.raw(x) - at).sum()))) / (bad + good)
    return replace(model, cut=at, spread=max(spread / 4, 1e-6))


def threshold_by_quantile(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """The same in memory, for rows that weigh unequally: the cut leaves as large a weight of rows below it as is labelled bad."""
    if len(x) == 0 or len(set(y.tolist())) < 2:
        return model
    raw = model.raw(x)
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order]) / weight.sum()
    i = int(np.searchsorted(below, (weight * (y == 0)).sum() / weight.sum()))
    i = min(max(i, 0), len(raw) - 2)
    cut = (raw[order[i]] + raw[order[i + 1]]) / 2
    spread = max(float(np.abs(raw - cut).mean()) / 4, 1e-6)
    return Model(model.mean, model.scale, model.weight, float(cut), spread, model.threshold)


def labelled_parts(docs: DataFrame, labels: DataFrame, modulus: int, held: int) -> tuple[Each, str]:
    """All rows with a label that is not held out, and the scratch table of their statistics, one row a part.

    Statistics are taken where the texts lie, so only they are moved by the join; parts and their order
    depend on the rows alone.
    """
    some = known(labels, "quality", modulus, held)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in statistics(b.column(1))], pa.binary())], ["doc_id", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(gathered(batches, ROWS * N_FEATURES * 8, 2)):
            y, x = b.column(1).to_numpy(zero_copy_only=False).astype(np.int8), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0)[:1], pa.array([k], pa.int32()), pa.array([y.tobytes()], pa.binary()), pa.array([b"".join(x)], pa.binary())], ["h", "k", "y", "x"])

    rows = texts.mapInArrow(released(extract), "doc_id long, x binary").join(some, "doc_id").select(F.xxhash64("doc_id", "x").alias("h"), "y", "x")
    rows = rows.repartition(-(-some.count() // ROWS) or 1, "h").sortWithinPartitions("h", "y", "x")
    table, path = cut(rows.mapInArrow(pack, "h long, k int, y binary, x binary"), "labelled")

    def each(f: Callable) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [pickle.dumps(f(np.frombuffer(x).reshape(-1, N_FEATURES), np.frombuffer(y, np.int8))) for y, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["h", "k", "r"])

        return [pickle.loads(r.r) for r in sorted(table.mapInArrow(run, "h long, k int, r binary").collect(), key=lambda r: (r.h, r.k))]

    return each, path


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), modulus: int = 5, held: int = 0) -> Model:
    """Ranking and threshold from all labelled rows that are not held out, however many and however long."""
    bounded_batches(docs.sparkSession)
    each, path = labelled_parts(docs, labels, modulus, held)
    model = with_threshold(each, ranking(each, settings))
    remove(docs.sparkSession, path)
    return model


def score_texts(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row's whole text."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(statistics(b.column(1))))], ["doc_id", "score"])

    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df that score at least the threshold, with all their columns."""
    return filtered(df, text, lambda column: model.score(statistics(column)) >= model.threshold)
