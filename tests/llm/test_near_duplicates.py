"""SimHash, components and spherical filters against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import simhash, spherical
from larkspur.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_golay_keys_join_every_pair_within_three_bits():
    rng = random.Random(1)
    golay = simhash.Golay()
    pairs = []
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        pairs.append((a, b))
    for part in range(2):
        (ir, ik), _ = simhash.keys(np.array([p[part] for p in pairs], np.uint64), golay)
        _, (pr, pk) = simhash.keys(np.array([p[1 - part] for p in pairs], np.uint64), golay)
        found = {(r, k) for r, k in zip(ir.tolist(), ik.tolist())} & {(r, k) for r, k in zip(pr.tolist(), pk.tolist())}
        assert {r for r, _ in found} == set(range(len(pairs)))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["ÄÖ", "Mixed\x0bCase", " x"]
    texts = [None, "", " \t", "One", "one two", "a b c"] + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    for t in list(texts[6:30]):
        w = t.split(" ")
        texts += [t, t.upper() if rng.random() < 0.3 else " ".join(w[:-1] + ["z"]), t + "\nend"]
    rows = [(i * 3, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, n long")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.n_near, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fp = {i: slow_fingerprint(t) for i, t, _, _ in rows}
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    group = slow_groups(fp, linked)
    for i in fp:
        assert got[i] == (fp[i], sum(i in p for p in linked), group[i])


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 60), (60, 50), (70, 60)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {n: r for n, r in slow_groups(nodes, [e for e in edges if e[0] != e[1]]).items()}


def test_spherical_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24)).astype(np.float32)
    near = [b + rng.standard_normal(24).astype(np.float32) * s for b in base[:20] for s in (0.05, 0.2, 0.4)]
    rows = [v.tolist() for v in [*base, *near, base[3], base[3] * 2]]
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i + 5, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in spherical.near_duplicates(df).collect()}
    ok = {}
    for i, v in enumerate(rows):
        if v and all(c is not None for c in v):
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and np.linalg.norm(x) > 0:
                ok[i + 5] = x / np.linalg.norm(x)
    linked = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9]
    group = slow_groups([i + 5 for i in range(len(rows))], linked)
    assert len(linked) > 60
    for i in got:
        assert got[i] == (sum(i in p for p in linked), group[i], group[i] == i)
    assert len(got) == len(rows)


@pytest.mark.parametrize("d,n", [(64, 10_000), (64, 3_000_000), (64, 300_000_000), (32, 30_000_000), (24, 1_000_000), (16, 1_000_000), (8, 100_000)])
def test_spherical_plans_lose_few_pairs(d, n):
    """At any size of the table, pairs at the threshold meet in a filter."""
    sample = spherical._unit(np.random.default_rng(5).standard_normal((512, d)))
    *code, rotations = spherical.plan(d, n, 0.9, sample)
    x, y = spherical.pairs_at(0.9005, d, 5000, seed=6)
    left = np.arange(5000)
    codes = spherical.Filters(d, *code, rotations)
    for t in range(rotations):
        left = left[~spherical.met(codes, x[left], y[left], t)]
    assert len(left) == 0


def test_filters_are_all_whose_caps_hold_the_vector():
    """The list decoding against an enumeration of all directions, for two and three blocks."""
    x = spherical._unit(np.random.default_rng(2).standard_normal((50, 12)))
    for blocks, size in ((2, 16), (3, 6)):
        codes = spherical.Filters(12, blocks, size, 4.0, 2)
        for t, (turn, code) in enumerate(codes.codes):
            parts = (x @ turn).reshape(50, blocks, -1)
            sure, perhaps = set(), set()
            for number in range(size**blocks):
                at = [number // size ** (blocks - 1 - b) % size for b in range(blocks)]
                total = sum(parts[:, b] @ code[b, at[b]] for b in range(blocks))
                for found, height in ((sure, codes.height + 1e-5), (perhaps, codes.height - 1e-5)):
                    found |= {(int(i), t * size**blocks + number) for i in np.flatnonzero(total >= height)}
            row, f = codes.passed(x, t)
            got = set(zip(row.tolist(), f.tolist()))
            assert sure <= got <= perhaps and len(got) == len(row) and len(sure) > 100


@pytest.mark.parametrize("d", [4, 16, 64, 256])
def test_cap_height_gives_the_number_of_caps(d):
    x = spherical._unit(np.random.default_rng(d).standard_normal((400, d)))
    codes = spherical.Filters(d, 2, 64, 6.0, 30)
    assert abs(sum(len(codes.passed(x, t)[0]) for t in range(30)) / (400 * 30) - 6) < 0.5


@pytest.mark.parametrize("d", [2, 8, 16])
def test_spherical_loses_none_in_low_dimensions(spark, d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((1500, d))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert {r.vec_id: r.n_links for r in spherical.near_duplicates(df).collect()} == dict(enumerate(want.tolist()))


def test_spherical_filters_and_scan_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((500, 24))
    x = np.concatenate([base, base + rng.standard_normal(base.shape) * 0.4])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, spherical.near_duplicates(df).collect()))  # few vectors: all pairs
    assert sum(r[1] for r in want) > 200
    monkeypatch.setattr(spherical, "FEW", 10)
    assert sorted(map(tuple, spherical.near_duplicates(df).collect())) == want


@pytest.mark.parametrize("hot", [7, 1000])
def test_hot_filters_are_split(spark, hot):
    rng = np.random.default_rng(4)
    rows = [(1, 8, i) for i in range(50)] + [(2, 8, i) for i in range(40, 60)] + [(1, 9, 3), (3, 8, 7)] + [(int(rng.integers(4, 9)), 8, i) for i in range(30)]
    members = {}
    for f, d, c in rows:
        members.setdefault((f, d), set()).add(c)
    want = {(a, b) for m in members.values() for a in m for b in m if a < b}
    got = [tuple(r) for r in spherical.colliding(spark.createDataFrame(rows, "f long, d int, cid long"), hot).collect()]
    assert set(got) == want and len(got) == len(want)


def test_extra_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, v int")
    assert [r.n_links for r in spherical.near_duplicates(df.withColumn("n_links", F.lit("x"))).collect()] == [1, 1]
