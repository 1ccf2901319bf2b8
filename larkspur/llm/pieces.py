"""SentencePiece-style encoding by sampled segmentation, and lossless decoding.

A text is spelt with one leading and all other spaces as U+2581; its lattice has an edge for every
vocabulary piece at every place. Characters outside the vocabulary, and any literal U+2581, are spelt
as byte pieces. Filtering forward gives every lattice place the total weight of the ways to it;
sampling backward from the end draws each piece in proportion to the weight of the ways through it, so
whole segmentations are drawn from their exact distribution. Weights are exp(alpha * log-probability);
for a vocabulary that only ranks its merges, the log-probability is that of Zipf's law at the piece's
rank.

The lattice falls apart, without loss, wherever no piece can lie across: where the vocabulary has no
piece with these two characters side by side. The parts between (units) are what is filtered, each
distinct one once; the lattices of units are kept from batch to batch within a bound.

The random numbers are a hash of the row's key and the place in the text, so a row is segmented alike
in any partitioning, and on any retry.

Defined results: null and empty texts have no pieces; a very long text is handled whole, alone in its
run; equal texts under different keys may be segmented differently but decode to the same text, equal
keys and texts are segmented alike; a null key counts as 0; repeated rows stay; an empty table gives an
empty result; other columns of the table are ignored, whatever their names. There are no ties.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import POWERS, U64, bounded_batches, mix, window_hash

SPACE = "▁"
#: Edges of lattices that a worker keeps.
MOST_EDGES = 3_000_000


class Lattices:
    """A vocabulary, and the lattices of all distinct units of some texts built and sampled at once."""

    def __init__(self, model_file: str, alpha: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes, self.names, score = {}, {}, []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.names[i] = model.id_to_piece(i)
                score.append(model.get_score(i))
        scores = np.array(score)
        # merge ranks come as scores 0, -1, -2, ...; anything else is taken as log-probabilities
        ranked = bool((scores <= 0).all() and (scores == np.round(scores)).all())
        logp = alpha * (-np.log(np.maximum(-scores, 0) + 2.7) if ranked else scores)
        self.byte_logp = float(logp.min()) - 2.0
        weight = dict(zip(self.names.values(), logp.tolist(), strict=True))
        number = {n: i for i, n in self.names.items()}
        # which characters stand side by side in a piece, by a hash: where two do not, no piece lies across
        self.joined = np.zeros(1 << 22, bool)
        text = np.frombuffer("".join(n + "\0" for n in number).encode("utf-32-le"), "<u4")
        inside = (text[:-1] != 0) & (text[1:] != 0)
        self.joined[self._pair(text[:-1][inside], text[1:][inside])] = True
        self.forget()
        # by length: sorted hashes of all prefixes of pieces, with the piece's id or -1
        prefixes: list[set[str]] = []
        for name in number:
            for k in range(1, len(name) + 1):
                while len(prefixes) < k:
                    prefixes.append(set())
                prefixes[k - 1].add(name[:k])
        self.tables = []
        for k, words in enumerate(prefixes, 1):
            ordered = sorted(words)
            h = self._hash(np.frombuffer("".join(ordered).encode("utf-32-le"), "<u4"))
            start = np.arange(len(ordered)) * k
            h = window_hash(h, start, start + k)
            order = np.argsort(h)
            ids = np.array([number.get(w, -1) for w in ordered], dtype=np.int64)
            self.tables.append((h[order], ids[order], np.array([weight.get(w, 0.0) for w in ordered])[order]))

    def forget(self) -> None:
        """Drop the lattices that are kept."""
        self.known: dict[str, int] = {}
        self.last = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.upto, self.origin, self.pieces = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (b.astype(np.uint32) * np.uint32(0x85EBCA6B))) >> np.uint32(10)

    @staticmethod
    def spelt(text: str) -> np.ndarray:
        """Code points, spaces as U+2581 and literal U+2581 as 0."""
        raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return np.where(raw == 32, ord(SPACE), np.where(raw == ord(SPACE), 0, raw)).astype(np.uint32)

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of all texts one after another, and how many each text has."""
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        whole = "".join(" " + t for t in texts if t)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        code = self.spelt(whole)
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~self.joined[self._pair(code[:-1], code[1:])]
        ends = np.cumsum(lengths)
        cut[ends] = True
        at = np.flatnonzero(cut)
        counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
        places = at.tolist()
        return [whole[i:j] for i, j in zip(places[:-1], places[1:], strict=True)], counts

    def keep(self, units: list[str]) -> None:
        """Build the lattices of units that are not kept yet."""
        fresh = [u for u in dict.fromkeys(units) if u not in self.known]
        if len(self.upto) > MOST_EDGES:
            self.forget()
            fresh = list(dict.fromkeys(units))
        if not fresh:
            return
        first, upto, origin, piece, last = self.build(fresh)
        nodes, edges = len(self.first) - 1, len(self.upto)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.last = np.concatenate([self.last, last + nodes])
        self.first = np.concatenate([self.first, first[1:] + edges])
        self.upto, self.origin, self.pieces = np.concatenate([self.upto, upto]), np.concatenate([self.origin, origin + nodes]), np.concatenate([self.pieces, piece])

    @staticmethod
    def _hash(code: np.ndarray) -> np.ndarray:
        up = POWERS.grow(len(code) + 1)
        out = np.zeros(len(code) + 1, U64)
        np.cumsum((code.astype(U64) + U64(1)) * up[: len(code)], out=out[1:])
        return out

    def build(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering: (first edge of each node, edges' shares summed up, origins, pieces, last node of each unit).

        A node is a place in a unit, before or after a character; an edge, a piece that ends there. Edges
        that spell a character as bytes have minus one minus its code point for a piece.
        """
        size = np.fromiter(map(len, units), np.int64, len(units))
        raw = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        code = self.spelt("".join(units))
        owner = np.repeat(np.arange(len(units)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters to the unit's end
        h, alive = self._hash(code), np.arange(len(code))
        begin, length, piece, logp = [], [], [], []
        single = np.zeros(len(code), bool)
        for k, (names, ids, weight) in enumerate(self.tables, 1):
            alive = alive[left[alive] >= k]
            if len(alive) == 0:
                break
            w = window_hash(h, alive, alive + k)
            at = np.minimum(np.searchsorted(names, w), len(names) - 1)
            hit = names[at] == w
            alive, at = alive[hit], at[hit]
            real = ids[at] >= 0
            begin.append(alive[real])
            length.append(np.full(int(real.sum()), k))
            piece.append(ids[at[real]])
            logp.append(weight[at[real]])
            if k == 1:
                single[alive[real]] = True
        spelt = np.flatnonzero(~single)
        width = 1 + (raw[spelt] > 0x7F).astype(int) + (raw[spelt] > 0x7FF) + (raw[spelt] > 0xFFFF)
        begin, length = np.concatenate([*begin, spelt]), np.concatenate([*length, np.ones(len(spelt), np.int64)])
        piece, logp = np.concatenate([*piece, -1 - raw[spelt].astype(np.int64)]), np.concatenate([*logp, self.byte_logp * width])
        origin = begin + owner[begin]
        target = origin + length
        nodes = len(code) + len(units)
        head = np.cumsum(size + 1) - size - 1
        step = np.arange(nodes) - np.repeat(head, size + 1)  # a node's place in its unit
        order = np.lexsort((target, step[target]))
        o, t, w = origin[order], target[order], logp[order]
        total = np.full(nodes, -np.inf)
        total[head] = 0.0
        share = np.zeros(len(o))
        bounds = np.searchsorted(step[t], np.arange(1, int(size.max()) + 2)) if len(size) else []
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            x, end = total[o[i:j]] + w[i:j], t[i:j]
            first = np.flatnonzero(np.diff(end, prepend=-1))
            many = np.diff(np.append(first, j - i))
            top = np.maximum.reduceat(x, first)
            part = np.exp(x - np.repeat(top, many))
            summed = np.add.reduceat(part, first)
            total[end[first]] = top + np.log(summed)
            share[i:j] = part / np.repeat(summed, many)
        order2 = np.lexsort((-share, t))
        o, t, share, pieces = o[order2], t[order2], share[order2], piece[order][order2]
        first = np.searchsorted(t, np.arange(nodes + 1))
        # summed up within each node alone, so that rounding does not depend on what else is in the batch
        upto, at, end = share.copy(), first[:-1] + 1, first[1:]
        while len(at):
            more = at < end
            at, end = at[more], end[more]
            upto[at] += upto[at - 1]
            at = at + 1
        upto[first[1:][first[1:] > first[:-1]] - 1] = 2.0  # the last edge of a node takes what is left
        return first, upto, o, pieces, head + size

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Backward sampling of all units of all texts at once; ids of each text."""
        units, counts = self.units(texts)
        if not units:
            return [np.zeros(0, np.int32) for _ in texts]
        self.keep(units)
        unit = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        first, upto, origin, pieces, last = self.first, self.upto, self.origin, self.pieces, self.last
        row = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
        state = mix(mix(seeds.astype(U64))[row] + place.astype(U64) * U64(0x9E3779B97F4A7C15))
        node, active = last[unit], np.arange(len(unit))
        of_unit, of_piece = [], []
        while len(active):
            u = (state >> U64(11)).astype(np.float64) * (1.0 / (1 << 53))
            edge, open_ = first[node], np.arange(len(node))
            while len(open_):
                open_ = open_[u[open_] >= upto[edge[open_]]]
                edge[open_] += 1
            of_unit.append(active)
            of_piece.append(pieces[edge])
            node = origin[edge]
            more = first[node + 1] > first[node]  # only a unit's first node has no edge
            active, node, state = active[more], node[more], mix(state[more] + U64(0xD1B54A32D192ED03))
        # the last steps come first in each unit
        owner, piece = np.concatenate(of_unit[::-1]), np.concatenate(of_piece[::-1])
        order = np.argsort(owner, kind="stable")
        owner, piece = owner[order], piece[order]
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            codes, which = np.unique(-1 - piece[odd], return_inverse=True)
            spelt = [[self.bytes[x] for x in chr(c).encode()] for c in codes.tolist()]
            n = np.ones(len(piece), np.int64)
            n[odd] = np.array([len(x) for x in spelt])[which]
            padded = np.array([x + [0] * (4 - len(x)) for x in spelt])
            source = np.repeat(np.arange(len(piece)), n)
            within = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
            slot = np.full(len(piece), -1)
            slot[odd] = which
            piece = np.where(slot[source] >= 0, padded[np.maximum(slot[source], 0), within], piece[source])
            owner = owner[source]
        ends = np.searchsorted(owner, np.cumsum(counts), "left")
        return np.split(piece.astype(np.int32), ends[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids, whatever its segmentation."""
        if not hasattr(self, "raw"):
            self.raw = {i: n.replace(SPACE, " ").encode() for i, n in self.names.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode()[1:]


_WORKER: dict[tuple, Lattices] = {}


def lattices(model_file: str | None, alpha: float) -> Lattices:
    """One set of lattices for each worker process, shared by its tasks."""
    if (model_file, alpha) not in _WORKER:
        import public_tokenizers

        _WORKER[model_file, alpha] = Lattices(model_file or public_tokenizers.path("piece_bpe_32k.model"), alpha)
    return _WORKER[model_file, alpha]


def sampled_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, alpha: float = 1.0, model_file: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless (it decodes to the text) and (keep_ids) ids of each row's whole text."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattices(model_file, alpha)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            keys = np.array([k or 0 for k in b.column(0).to_pylist()], dtype=np.int64).view(np.uint64) ^ mix(np.array([seed], U64))
            ids: list[np.ndarray] = []
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 2 << 20):
                    size += len(texts[to])
                    to += 1
                ids += lattice.sample(texts[at:to], keys[at:to])
                at = to
            back = [lattice.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            columns = [b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array(back, pa.bool_())]
            if keep_ids:
                columns.append(pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"][: len(columns)])

    schema = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids binary" * keep_ids
    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, schema)


def decoded(df: DataFrame, ids: str = "ids", model_file: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids as sampled_pieces gives them; null ids decode to null."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattices(model_file, 1.0)
        for b in batches:
            texts = [None if x is None else lattice.decode(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", ids).mapInArrow(run, "doc_id long, text string")
