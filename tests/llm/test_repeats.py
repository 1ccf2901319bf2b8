"""Removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import common, repeats


def slow(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(width, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(width // 3) for _ in range(4)]
    texts = [None, "", "short", "a" * (width - 1), "a" * (width + 1), "a" * (3 * width), "ab" * width]
    for _ in range(30):
        parts = [prose(rng.randint(1, width // 2))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : len(s) - rng.randint(0, len(s) // 3)], prose(rng.randint(1, 30))]
        texts.append(rng.choice(["", " "]).join(parts))
    same = prose(width)
    return texts + [same, same, same, texts[10], texts[12][: len(texts[12]) // 2], same[5:], same[: width + 3]]


@pytest.mark.parametrize(("width", "packet", "seed"), [(400, 3000, 1), (400, 4 << 20, 2), (250, None, 4), (60, 500, 3)])
def test_matches_brute_force(spark, width, packet, seed):
    texts = corpus(width, seed)
    df = spark.createDataFrame([(i, t, f"s{i}", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_bytes string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(df, width=width, packet_bytes=packet, range_bytes=300).collect()}
    for i, want in enumerate(slow(texts, width)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and r.source == f"s{i}"


@pytest.mark.parametrize(("width", "passage", "packet", "seed"), [(400, 250, 3000, 5), (90, 60, 500, 6), (61, 60, None, 7)])
def test_two_widths_match_brute_force(spark, width, passage, packet, seed):
    texts = corpus(width, seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(df, width=width, passage=passage, keep=("kept_text",), packet_bytes=packet, range_bytes=300).collect()}
    for i, (wide, narrow) in enumerate(zip(slow(texts, width), slow(texts, passage))):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wide, i
        assert r.n_passage_bytes == narrow[1] and len(r.passage_text) <= len(r.kept_text)


def test_second_hash_decides():
    """Names of equal first hashes are only equal where the second ones are."""
    h, second = np.array([6, 6, 6, 2], np.uint64) << np.uint64(40), np.array([1, 2, 1, 5], np.uint64)
    names = repeats.Names(h, 1, second)
    (_, mine), = names.messages()
    other = repeats.Names(h[:2], 1, np.array([2, 9], np.uint64))
    (_, theirs), = other.messages()
    replies = repeats.compare([mine, theirs], 16)
    assert names.repeated({0: replies[0]}).tolist() == [True, True, True, False]
    assert other.repeated({0: replies[1]}).tolist() == [True, False]


def test_passage_of_fifty_one_words(spark):
    """What no 400-byte string holds: the pipeline's stage removes it wherever it stands, and leaves other text."""
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 7)))
    passage = " ".join(word() for _ in range(51))
    own = [" ".join(word() for _ in range(120)) for _ in range(3)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{passage} {own[2]}", own[2][: len(own[2]) // 3], None, ""]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, df, "").collect()}
    assert passage not in got[0].text and passage not in got[1].text and got[0].text.startswith(own[0]) and got[0].text.endswith(own[1])
    assert [r.n_chars for r in got.values()] == [len(r.text or "") for r in got.values()] and len(got) == 5
    assert repeats.remove_repeats(df).agg({"n_removed": "sum"}).first()[0] == 0


def test_packets_grow():
    assert [repeats.packet_size(n) for n in (0, 1 << 30, 10**12, 10**14)] == [4 << 20, 4 << 20, 16_000_000, 128 << 20]
    assert repeats.moduli((400,)) == [(400, 273, 4), (400, 31, 4), (400, 1, 16)]
    assert repeats.moduli((250, 400)) == [(250, 183, 4), (250, 31, 4), (250, 1, 16), (400, 1, 16)]


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("v", sorted(repeats.COVERS))
def test_covers(v):
    assert {(a - b) % v for a in repeats.COVERS[v] for b in repeats.COVERS[v]} == set(range(v))


def test_workers_keep_few_powers(spark):
    """Two widths use both bases; a text of three megabytes is one packet."""
    text = random.Random(5).randbytes(1_500_000).hex()
    repeats.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"), passage=250).count()

    def kept(batches):
        import pyarrow as pa
        from larkspur.llm import common

        list(batches)
        yield pa.record_batch([pa.array([sum(x.nbytes for p in (common.POWERS, common.POWERS_2) for x in vars(p).values() if hasattr(x, "nbytes"))])], ["n"])

    assert max(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect()) <= 2 * 8 * (2 << 20) + 64


def test_window_hashes_do_not_depend_on_the_powers_grown():
    data = np.frombuffer(random.Random(6).randbytes(300), np.uint8)
    start, stop = np.array([0, 7, 123, 299]), np.array([5, 7, 300, 300])
    for base, powers in ((common.BASE, common.Powers(common.BASE)), (common.BASE_2, common.Powers(common.BASE_2))):
        word = [sum((int(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(data[a:b])) % (1 << 64) for a, b in zip(start, stop, strict=True)]
        want = common.mix(np.array(word, np.uint64) ^ (np.uint64(0x632BE59BD9B4E019) * (stop - start).astype(np.uint64)))
        for n in (1, 70_000):
            powers.grow(n)
            assert (common.window_hash(common.prefix_hash(data, powers), start, stop, powers) == want).all()
