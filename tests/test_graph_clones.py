"""Graphs and clones on the small shapes they are known by."""

import os
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.operators import clones as C, graph as G


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, call_line int")


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "idx long")


@pytest.mark.parametrize(
    ("pairs", "seeds", "depth", "want"),
    [
        ([], [1], 3, {1: 0}),
        ([(1, 2), (2, 3), (3, 4)], [1], 2, {1: 0, 2: 1, 3: 2}),
        ([(1, 2), (1, 3), (2, 4), (3, 4)], [1], 5, {1: 0, 2: 1, 3: 1, 4: 2}),
        ([(1, 2), (2, 1)], [1], 9, {1: 0, 2: 1}),
        ([(1, 2), (3, 2), (2, 4)], [1, 3], 2, {1: 0, 3: 0, 2: 1, 4: 2}),
        ([(1, 2)], [1], 0, {1: 0}),
    ],
)
def test_bfs(spark, pairs, seeds, depth, want):
    assert {r.idx: r.depth for r in G.bfs(edges(spark, pairs), ids(spark, *seeds), depth).collect()} == want


def test_paths(spark):
    path = lambda p, a, b: [r.path for r in G.shortest_path(edges(spark, p), ids(spark, *a), ids(spark, *b), 8).collect()]
    chain = [(1, 2), (2, 3), (4, 3)]
    assert path(chain, [1], [4]) == [[1, 2, 3, 4]] and path(chain, [1], [1]) == [[1]] and path(chain, [1], [9]) == []
    assert path([(1, 2), (1, 3), (2, 4), (3, 4)], [1], [4]) == [[1, 2, 4]]
    assert path([(1, 5), (2, 6)], [1, 2], [6, 7]) == [[2, 6]]


def test_paths_of_any_length(spark):
    chain = [(i, i + 1) for i in range(36)]
    assert [r.path for r in G.shortest_path(edges(spark, chain), ids(spark, 0), ids(spark, 36)).collect()] == [list(range(37))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_shortest_path_query_against_plain_search(spark):
    from larkspur.plans import code

    near: dict[int, set[int]] = {}
    for r in code.edges(spark, "/root/testdata/sf0.1").collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    paths = {1: [1]}
    level = [1]
    while level and 90 not in paths:
        grown: dict[int, list[int]] = {}
        for a in level:
            for b in near[a] - paths.keys():
                grown[b] = min(grown.get(b, [*paths[a], b]), [*paths[a], b])
        paths |= grown
        level = list(grown)
    assert len(paths[90]) > 7
    assert [r.path for r in code.shortest_path(spark, "/root/testdata/sf0.1").collect()] == [">".join(map(str, paths[90]))]


def slow_tree(children, roots, depth):
    out, met = [], set()

    def visit(node, level):
        if level < depth:
            for c in children.get(node, []):
                out.append((level + 1, c, c in met))
                if c not in met:
                    met.add(c)
                    visit(c, level + 1)

    for r in roots:
        met.add(r)
        out.append((0, r, False))
        visit(r, 0)
    return out


def test_flow_tree(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 3)])
    assert G.flow_tree(e, 1, 3) == [(0, 1, False), (1, 2, False), (2, 3, False), (3, 1, True), (1, 3, True)]
    assert G.flow_tree(e, 1, 3, {3}) == [(0, 1, False), (1, 2, False)] and G.flow_tree(e, 1, 0) == [(0, 1, False)]
    # a node met at the depth limit is a back-reference wherever it is met again
    assert G.flow_tree(edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)]), 0, 2) == [(0, 0, False), (1, 1, False), (2, 2, False), (1, 2, True)]
    rng = random.Random(3)
    some = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(60)})
    children = {}
    for a, b in some:
        children.setdefault(a, []).append(b)
    frame = spark.createDataFrame(some, "src long, dst long")
    for roots, depth in (([3], 4), ([3, 7, 3], 3), ([1, 2], 1)):
        assert G.flow_tree(frame, roots, depth) == slow_tree(children, roots, depth)


def test_long_chain(spark):
    chain = edges(spark, [(i, i + 1) for i in range(40)])
    assert G.shortest_path(chain, ids(spark, 0), ids(spark, 40)).first().path == list(range(41))


def test_flow_tree_of_many_edges(spark):
    wide = spark.range(10, 100_010).select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1).alias("call_line"))
    tree = G.flow_tree(wide.unionByName(edges(spark, [(0, 1), (0, 2), (2, 5)])), 0, 2)
    assert len(tree) == 100_004 and tree[-2:] == [(1, 2, False), (2, 5, False)]


@pytest.fixture(scope="module")
def symbols(spark):
    pair = "array<struct<a:string,b:string>>"
    rows = [
        (0, "mod_a::Foo", "struct", "src/a.rs", 1, 5, False, [], [], [], []),
        (1, "mod_a::Foo::bar", "function", "src/a.rs", 10, 20, False, ["baz"], [("self", "x"), ("p", "y"), ("q", "z")], [("p", "&mut crate::Point<T>")], [("q", "Other"), ("p", "Shadow")]),
        (2, "mod_b::baz", "function", "src/b.rs", 3, 9, False, ["mod_a::Foo::bar"], [], [], []),
        (3, "Drawable", "trait", "src/t.rs", 1, 2, False, [], [], [], []),
        (4, "Drawable for Foo", "impl", "src/t.rs", 4, 8, False, [], [], [], []),
        (5, "mod_b::tests::baz", "function", "tests/b.rs", 3, 9, True, ["MOD_B::BAZ"], [], [], []),
    ]
    return spark.createDataFrame(rows, f"idx long, name string, kind string, file string, start_line int, end_line int, is_test boolean, calls array<string>, field_accesses {pair}, param_types {pair}, local_types {pair}").withColumn("types", F.when(F.col("idx") == 2, F.array(F.lit("Foo"))).otherwise(F.array().cast("array<string>")))


def test_resolution(spark, symbols):
    name = lambda x: sorted(r.idx for r in G.resolve_symbol(symbols, x).collect())
    assert name("MOD_B::BAZ") == [2] and name("baz") == [2, 5] and name("foo") == [0] and name("none") == []
    calls = symbols.select(F.col("idx").alias("src"), F.explode("calls").alias("callee")).withColumn("call_line", F.lit(7))
    assert sorted((r.src, r.dst) for r in G.edges_by_name(symbols, calls).collect()) == [(1, 2), (2, 1), (5, 2)]
    raw = spark.createDataFrame([(1, "x", "src/b.rs", 4, 1), (1, "x", "src/b.rs", 4, 2), (2, "mod_a::Foo::bar", None, None, 3), (2, "x", "src/zzz.rs", 1, 3)], "src long, callee string, callee_file string, callee_start_line int, line int")
    assert sorted(tuple(r) for r in G.edges_by_place(symbols, raw).collect()) == [(1, 2, 1), (2, 1, 3)]
    assert [tuple(r)[:2] for r in G.type_edges(symbols).collect()] == [(2, 0)]
    assert [tuple(r) for r in G.trait_impls(symbols).collect()] == [(3, 4)]
    assert sorted(r.idx for r in G.expand_traits(ids(spark, 3), G.trait_impls(symbols)).collect()) == [3, 4]
    assert sorted(tuple(r) for r in G.field_access(symbols).collect()) == [("crate::point::y", 1), ("foo::x", 1), ("other::z", 1)]
    assert {r.idx: r.called_by for r in G.called_by(symbols).collect()} == {1: ["mod_b::baz"], 2: ["mod_a::Foo::bar", "mod_b::tests::baz"], 5: ["mod_a::Foo::bar"]}


def test_places_of_many_nodes_make_no_pairs(spark):
    """Many nodes and calls at one place: each call meets the smallest node alone."""
    nodes = spark.range(100, 4100).select(F.col("id").alias("idx"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit("a.rs").alias("file"), F.lit(1).alias("start_line"))
    raw = nodes.select((F.col("idx") + 9000).alias("src"), F.lit("none").alias("callee"), "file", F.lit(2).alias("callee_start_line"), F.lit(5).alias("line")).withColumnRenamed("file", "callee_file")
    found = G.edges_by_place(nodes, raw)
    assert found.agg(F.count("*"), F.min("dst"), F.max("dst")).first() == (4000, 100, 100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [file" in plan and "min(idx" in plan


def test_names(spark):
    df = spark.createDataFrame([("pub(crate) a::b::{closure#0}::{closure#1}",), ("export x",)], "n string")
    assert [r.x for r in df.select(G.plain_name(F.col("n")).alias("x")).collect()] == ["a::b", "x"]
    sig = spark.createDataFrame([("fn f<T: A + B, 'a>(x: T) where U: C, V: D {",)], "s string")
    assert sig.select(G.generic_bounds(F.col("s")).alias("x")).first().x == [("t", "a"), ("u", "c"), ("v", "d")]


def test_context_and_dead(spark, symbols):
    e = edges(spark, [(1, 2), (5, 2), (2, 0)])
    got = {r.idx: (r.role, r.call_line) for r in G.context(symbols, e, ids(spark, 2)).collect()}
    assert got == {2: ("definition", 0), 1: ("caller", 1), 5: ("test", 1), 0: ("type", 0)}
    n = symbols.withColumn("signature", F.when(F.col("idx") == 9, "pub fn x()").otherwise("fn x()")).withColumn("in_trait", F.lit(False))
    assert [r.idx for r in G.dead_code(n, e).collect()] == [1]
    assert {r.crate: r.prod_fn for r in G.crate_stats(symbols).collect()}[None] == 2
    chunks = spark.createDataFrame([("f", "n", True, 1, 2), ("f", "n", False, 5, 6), ("f", "m", True, 1, 1)], "file string, name string, is_test boolean, start_line int, end_line int")
    assert sorted((r.name, r.is_test) for r in G.prefer_production(chunks).collect()) == [("m", True), ("n", False)]


def test_jaccard_of_neighbours(spark):
    e = edges(spark, [(1, 7), (1, 8), (2, 7), (2, 8), (3, 7)])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (8, 9), (1, 9)], "a long, b long")
    assert {(r.a, r.b): (r.j, r.verdict) for r in G.neighbour_jaccard(e, pairs).collect()} == {(1, 2): (1.0, "SAFE"), (1, 3): (0.5, "REVIEW"), (8, 9): (1.0, "SAFE"), (1, 9): (0.0, "DIFFERENT")}


# ---------------------------------------------------------------- clones
def test_similar_pairs_lose_none(spark):
    base = " ".join(f"word{i} call{i % 7}" for i in range(60))
    texts = [base, base, base.replace("word3 ", "other "), base.replace("word1", "w"), " ".join(f"x{i}" for i in range(40)), "too short", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    sigs = C.signatures(df, "id", "text")
    got = {r.id: r.sig for r in sigs.collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[0] == got[1]
    groups, member = C.classes(sigs)
    assert {r.id: r.rep for r in member.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    share = lambda a, b: sum(x == y for x, y in zip(got[a], got[b])) / 64
    for threshold in (0.1, 0.5, 0.9):
        want = {(a, b) for a in (0, 2, 3, 4) for b in (0, 2, 3, 4) if a < b and share(a, b) >= threshold}
        assert {(r.a, r.b) for r in C.similar_pairs(groups, threshold).collect()} == want
    assert {(r.a, r.b) for r in C.banded_pairs(groups, 0.8).collect()} <= {(a, b) for a in got for b in got if share(a, b) >= 0.8}
    back = sigs.select("sig", C.from_hex(C.to_hex(F.col("sig"))).alias("b"))
    assert back.where("sig <> b").count() == 0


def test_unified_scores_every_candidate_by_both(spark):
    """Structure is compared for token pairs too, texts without a signature have structure, and classes are no pairs."""
    one, other = [1] * 64, [1] * 40 + [2] * 24
    far = [3] * 44 + [1] * 20
    texts = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h"), (4, "g"), (5, "k"), (6, "k"), (7, "k"), (8, None), (9, "z")], "id long, h string")
    sigs = spark.createDataFrame([(1, one), (2, other), (3, one), (4, other), (8, far), (10, one)], "id long, sig array<long>")
    groups, member = C.clone_classes(texts, sigs)
    assert {r.id: r.rep for r in member.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10}
    got = {(r.a, r.b): (r.score, round(r.j, 4), r.tag) for r in C.unified(groups, 0.3).collect()}
    assert got == {
        (1, 2): (1.0, 0.625, "AST+Token"), (1, 4): (0.625, 0.625, "Token"), (2, 4): (1.0, 1.0, "Token"), (1, 10): (1.0, 1.0, "Token"), (2, 10): (0.625, 0.625, "Token"), (4, 10): (0.625, 0.625, "Token"),
        (1, 8): (0.3125, 0.3125, "Weak"), (8, 10): (0.3125, 0.3125, "Weak"),
    }


def test_separate_keeps_the_largest(spark):
    """Against the greedy choice, longest first, of chunks that overlap none chosen before."""
    rng = random.Random(6)
    rows = []
    for i in range(160):
        start = rng.randrange(900)
        rows.append((rng.choice("hk"), i, rng.choice("fg"), start, start + rng.randrange(1, 300)))
    want = set()
    kept = []
    for h, i, f, a, b in sorted(rows, key=lambda r: (r[3] - r[4], r[1])):
        if not any(h == x and f == y and a <= d and c <= b for x, y, c, d in kept):
            kept.append((h, f, a, b))
            want.add(i)
    got = C.separate(spark.createDataFrame(rows, "hash string, id long, file string, start_line int, end_line int")).collect()
    assert {r.id for r in got} == want and len(got) == len(want)


def test_separate_makes_no_pairs(spark, monkeypatch):
    """Chunks that all overlap cost what they are, not their pairs; one without an id, or without a place, overlaps nothing."""
    from larkspur import checkpoints

    made = []

    def counted(df, name="step", settled=checkpoints.settled):
        made.append(settled(df, name).count())
        return settled(df, name)

    monkeypatch.setattr(checkpoints, "settled", counted)
    rows = [("h", i, "f", i, 1000 - i) for i in range(400)] + [("h", 900, "f", 999, 1), ("h", 901, None, 1, 2), ("h", 902, "f", 2000, 1999)]
    got = C.separate(spark.createDataFrame(rows, "hash string, id long, file string, start_line int, end_line int")).collect()
    assert sorted(r.id for r in got) == [0, 901, 902]
    assert all(n <= len(rows) for n in made)
    lone = spark.createDataFrame([("h", 1, "f", 1, 9), ("h", None, "f", 1, 20), (None, 2, "f", 1, 9)], "hash string, id long, file string, start_line int, end_line int")
    assert C.separate(lone).count() == 3


def test_pairs_of_chunks(spark):
    chunks = spark.createDataFrame([(1, "f", 1, 10, False), (2, "f", 5, 30, False), (3, "g", 5, 30, True), (4, "src/tests/x", 1, 99, False)], "id long, file string, start_line int, end_line int, is_test boolean")
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (2, 9, 0.7)], "a long, b long, j double")
    left = C.without_overlaps(pairs, chunks)
    assert sorted((r.a, r.b) for r in left.collect()) == [(1, 3), (2, 9)] and [(r.a, r.b) for r in C.best_pairs(left, 1).collect()] == [(2, 9)]
    assert [r.id for r in C.candidates(chunks, 11).collect()] == [2] and {r.id for r in C.candidates(chunks, 11, tests=True).collect()} == {2, 3, 4}


def test_banded_pairs_find_most(spark):
    """Bands of four places: at eight equal places in ten a pair is lost once in some five thousand."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 30, (500, 64))
    near = base.copy()
    for row in near:
        row[rng.choice(64, 12, replace=False)] += 1
    sigs = [(i, v.tolist()) for i, v in enumerate([*base, *near])]
    groups = spark.createDataFrame(sigs, "rep long, sig array<long>")
    found = {(r.a, r.b) for r in C.banded_pairs(groups, 0.8).collect()}
    exact = {(r.a, r.b) for r in C.similar_pairs(groups, 0.8).collect()}
    assert exact == {(i, i + 500) for i in range(500)} and found <= exact and len(found) >= 0.99 * len(exact)


@pytest.mark.parametrize(("a", "b", "want"), [((1, 5), (1, 5), True), ((1, 5), (5, 9), True), ((1, 9), (3, 4), True), ((1, 4), (5, 9), False), ((3, 3), (3, 3), True)])
def test_overlap(spark, a, b, want):
    col = lambda v: F.lit(v)
    assert spark.range(1).select(C.overlap(col("f"), col(a[0]), col(a[1]), col("f"), col(b[0]), col(b[1])).alias("x")).first().x is want


def test_sub_blocks(spark):
    rows = [(1, "f", 1, 100, "h", 10, 20), (2, "f", 5, 50, "h", 10, 20), (3, "g", 1, 50, "h", 1, 11), (4, "g", 60, 70, "k", 60, 61)]
    got = C.sub_blocks(spark.createDataFrame(rows, "id long, file string, start_line int, end_line int, hash string, s int, e int")).collect()
    assert [(r.id_a, r.id_b) for r in got] == [(2, 3)]


def test_keys_of_many_meet_in_parts(spark, monkeypatch):
    """Pairs against brute force where keys have more representatives than meet in one place: each once, none lost, weak ones by their bits."""
    monkeypatch.setattr(C, "MEET", 3)
    monkeypatch.setattr(C, "TILE", 4)
    rng = np.random.default_rng(5)
    sigs = rng.integers(0, 3, (150, 64)) + rng.integers(0, 2, (150, 1)) * 10
    bits = 1 << rng.integers(0, 4, 150)
    p, v = np.tile(np.arange(64), 150), sigs.ravel()
    c = np.array([(sigs[:, i] == x).sum() for i, x in zip(p, v)])
    lists = [pa.ListArray.from_arrays(np.arange(0, 9601, 64, dtype=np.int32), pa.array(x)) for x in (p.astype(np.int32), v.astype(np.int32), c)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(bits), *lists], ["rep", "bits", "p", "v", "c"])
    keyed = pa.Table.from_batches(list(C._keys(iter([rows]), 64 - 20 + 1))).sort_by([("key", "ascending"), ("cell", "ascending"), ("side", "ascending")])
    got = [tuple(r.values()) for b in C._meet(iter(keyed.combine_chunks().to_batches(max_chunksize=97)), 26, 20) for r in b.to_pylist()]
    same = (sigs[:, None] == sigs[None]).sum(2)
    want = {(a, b, same[a, b] / 64) for a in range(150) for b in range(a + 1, 150) if same[a, b] >= (20 if bits[a] & bits[b] else 26)}
    assert len(got) == len(want) and set(got) == want and len(want) > 100


def test_signatures_hash_words_once(spark, monkeypatch):
    """Signatures by hand, of repeated words, numbers and texts that are too short; each word and pair is hashed once."""
    seen = []
    monkeypatch.setattr(C.T, "content_keys", lambda x, keys=C.T.content_keys: (seen.append(len(x)), keys(x))[1])
    texts = ["a b a b 12 a 345 b b a " * 50, "a b", "", " a b c d e f g h i 7 "]
    ids, got = C._least(np.arange(4), pa.array(texts), 10)
    assert ids.tolist() == [0, 3] and seen == [11, 16]
    for text, sig in zip((texts[0], texts[3]), got.to_pylist(), strict=True):
        t = ["$N" if w.isdigit() else w for w in text.split()]
        f = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % C.PRIME for w in {*t, *(f"{x}_{y}" for x, y in zip(t, t[1:]))}]
        assert sig == [min((x * a + b) % C.PRIME for x in f) for a, b in zip(C.MULTIPLIERS, C.OFFSETS)]
