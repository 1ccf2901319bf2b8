"""Vectors, tokenizers, filters, Hangul letters, formatting, BM25 and fusion by closed forms."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from larkspur.errors import InvalidArgument
from larkspur.functions import embed, text as T, vectors as V
from larkspur.operators import bm25, fusion, knn as K


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- vectors
def test_distances(spark):
    a, b, z = [0.9, 0.1, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    call = lambda m, x, y: one(spark, V.METRICS[m](F.col("a"), F.col("b")), a=x, b=y)
    assert call("l2", a, b) == pytest.approx(0.02)
    assert call("neg_dot", a, b) == pytest.approx(-0.9)
    assert call("cosine", a, b) == pytest.approx(1 - 0.9 / math.hypot(0.9, 0.1))
    assert call("cosine", a, z) == 1.0 and call("cosine", b, b) == 0.0
    assert one(spark, V.parse_vector(F.col("a")), a="0.1, -2") == [0.1, -2.0]


@given(st.integers(1, 5), st.integers(0, 12), st.sampled_from(["cosine", "l2", "neg_dot"]))
@settings(max_examples=6, deadline=None)
def test_knn_against_expressions(spark, dim, n, metric):
    rng = np.random.default_rng(n * 7 + dim)
    rows = [(i, rng.integers(-2, 3, dim).astype(float).tolist()) for i in range(n)] + [(90, None), (91, [1.0] * (dim + 1))]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = rng.integers(-2, 3, dim).astype(float).tolist()
    got = K.knn(points, spark.createDataFrame([(1, q)], "qid long, qv array<double>"), 4, metric).orderBy("rank").collect()
    want = K.knn_expression(points, q, 4, metric).collect()
    assert [(r.id, round(r.d, 5)) for r in got] == [(r.id, round(r.d, 5)) for r in want]


def test_knn_corner_cases(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, qv array<double>")
    assert K.knn(points, q, 0).count() == 0
    assert [r.id for r in K.knn(points, q, 10).orderBy("rank").collect()] == [1, 2, 3]
    assert K.knn(points.limit(0), q, 3).count() == 0 and K.knn(points, q.limit(0), 3).count() == 0


def test_ivf_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("qv"))
    indexed, centres = K.ivf_cells(e)
    assert indexed.count() == e.count()
    found = K.ivf_search(indexed, centres, q, 10, max(1, (len(centres) * 2 + 2) // 3))
    assert K.recall(found, K.knn(e, q, 10), 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_sq8(spark):
    df = spark.createDataFrame([([0.0, 5.0],), ([1.0, 5.0],), ([0.5, 5.0],)], "v array<float>")
    low, span = V.sq8_arrays(V.sq8_train(df, "v"))
    assert (low, span) == ([0.0, 5.0], [1.0, 0.0])
    codes = df.select(V.sq8_encode(F.col("v"), low, span).alias("c")).collect()
    assert [r.c for r in codes] == [[0, 0], [255, 0], [128, 0]]
    assert one(spark, V.sq8_encode(F.col("a"), low, span), a=[7.0, -9.0]) == [255, 0]
    with pytest.raises(ValueError):
        V.sq8_arrays(V.sq8_train(df.limit(0), "v"))


def test_pooled_embeddings(spark):
    tokens = spark.createDataFrame([("a", [1.0, 0.0], 1.0), ("b", [0.0, 2.0], 3.0)], "token string, vector array<double>, weight double")
    docs = spark.createDataFrame([(1, "A b unknown"), (2, "unknown"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.vector for r in embed.pooled(docs, tokens).collect()}
    x = np.array([0.25, 1.5])
    assert set(got) == {1} and got[1] == pytest.approx((x / np.linalg.norm(x)).tolist())


# ---------------------------------------------------------------- text
@pytest.mark.parametrize(
    ("tokenizer", "text", "want"),
    [
        ("whitespace", "Hello\tWORLD\n x", ["hello", "world", "x"]),
        ("whitespace", " a　b ", ["a", "b"]),
        ("simple", "a-b, C! 日本 é", ["a", "b", "c", "日本", "é"]),
        ("simple", "...!?", []),
        ("code", "camelCase snake_case SCREAMING_CASE HTMLParser vec3d x", ["camel", "case", "snake", "case", "screaming", "case", "html", "parser", "vec"]),
        ("code", "fn let self a.b->foo", ["foo"]),
        ("code", "aBcDe", ["bc", "de"]),
    ],
)
def test_tokenizers(spark, tokenizer, text, want):
    assert one(spark, T.TOKENIZERS[tokenizer](F.col("t")), t=text) == want


def test_bigrams_and_filters(spark):
    assert one(spark, T.bigrams(T.simple_tokens(F.col("t"))), t="a b c") == ["a\x01b", "b\x01c"]
    assert one(spark, T.bigrams(T.simple_tokens(F.col("t"))), t="a") == []
    filters = T.chain(T.without_stopwords(["The"]), T.lowered, T.of_length(2))
    assert one(spark, filters(F.split(F.col("t"), " ")), t="The Cat a 한글 글") == ["cat", "한글"]


def test_hangul(spark):
    t = F.col("t")
    assert one(spark, T.choseong(t), t="한글 A") == "ㅎㄱ" and one(spark, T.choseong(t), t="대한민국") == "ㄷㅎㅁㄱ"
    assert one(spark, T.decompose(t), t="한글") == "ㅎㅏㄴㄱㅡㄹ"
    assert one(spark, T.matches_choseong(t, F.lit("ㅎㄱ")), t="한글 프로그래밍") and not one(spark, T.matches_choseong(t, F.lit("ㄱㅎ")), t="한글")
    assert [one(spark, T.fusion_alpha(t), t=x) for x in ("한 x", "plain 😀")] == [0.4, 0.7]
    assert [one(spark, T.token_kind(t), t=x) for x in ("NNG", "VV", "JKS", "SN", "SL", "SF", "XPN")] == ["noun", "verb", "particle", "number", "foreign", "punctuation", "unknown"]


def test_formatting(spark):
    t = F.col("t")
    assert one(spark, T.truncated(t, 4), t="abécd") == "abé..." and one(spark, T.truncated(t, 3), t="abé") == "ab..." and one(spark, T.truncated(t, 9), t="abécd") == "abécd"
    body = "[function] x\nFile: ./src/a.rs:10-20\nSignature: s\n\n Does it \nTypes: T"
    assert one(spark, T.description(t), t=body) == "Does it" and one(spark, T.line_range(t), t=body) == "10-20"
    assert one(spark, T.relative_path(t, "/home/u"), t="/home/u/src/a") == "src/a"
    assert [one(spark, T.is_test_path(t), t=x) for x in ("a/tests/b.rs", "a_test.go", "src/attest.rs")] == [True, True, False]
    assert one(spark, T.minhash_tokens(t), t="let x = 12; // no\n/* a\nb */ y\n# skip") == ["let", "x", "$N", "y"]


# ---------------------------------------------------------------- BM25 and fusion
CORPUS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "the lazy cat sleeps all day"), (3, "quick quick fox fox jumps jumps"), (4, None)]


def test_bm25_closed_forms(spark):
    assert one(spark, bm25.idf(F.lit(3), F.lit(10))) == pytest.approx(math.log(7.5 / 3.5 + 1))
    assert one(spark, bm25.idf(F.lit(0), F.lit(10))) == 0.0
    assert one(spark, bm25.tf_norm(F.lit(2.0), F.lit(100.0), F.lit(100.0))) == pytest.approx(4.4 / 3.2)
    assert [one(spark, bm25.fieldnorm_code(F.lit(n))) for n in (0, 1, 2, 16, 10**12)] == [0, 0, 8, 32, 255]


@pytest.mark.parametrize("norm", ["exact", "quantized"])
def test_bm25_ranks(spark, norm):
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    q = spark.createDataFrame([(1, "quick fox"), (2, "nothing"), (3, None), (4, "fox fox")], "qid long, qtext string")
    terms = bm25.query_terms(q)
    got = bm25.scores(bm25.build(docs), terms, norm).collect()
    by = {(r.qid, r.id): r.s for r in got}
    assert by[1, 3] > by[1, 1] and (1, 2) not in by and not any(k[0] in (2, 3) for k in by)
    once = {(r.qid, r.id): r.s for r in bm25.scores(bm25.build(docs), bm25.query_terms(q.where("qid = 4").selectExpr("qid", "'fox' AS qtext")), norm).collect()}
    assert by[4, 1] == pytest.approx(2 * once[4, 1], abs=2e-6)
    with pytest.raises(ValueError):
        bm25.scores(bm25.build(docs), terms, "other")


def test_best_is_the_head_of_all_scores(spark, tmp_path, monkeypatch):
    """For several blocks of queries, several groups of documents, ties, and an index read back."""
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "w1 w2"), (62, "w2 w1"), (3, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(9)] + [(9, "absent"), (10, None)], "qid long, qtext string")
    terms = bm25.query_terms(q)
    monkeypatch.setattr(bm25, "GROUP", 20)
    index = bm25.build(docs)
    assert index.stats.first()["n"] == len(rows) and index.stats.first()["total"] == sum(len((t or "").split()) for _, t in rows)
    bm25.save(index, f"{tmp_path}/index")
    again = bm25.load(spark, f"{tmp_path}/index")
    want = sorted(map(tuple, fusion.top(bm25.scores(index, terms), 5, -F.col("s")).select("qid", "id", "s", "rank").collect()))
    assert len(want) > 40
    for it, block in ((index, 4), (again, 4096)):
        assert sorted(map(tuple, bm25.best(it, terms, 5, block=block).select("qid", "id", "s", "rank").collect())) == want
    given = spark.createDataFrame([(1,), (61,)], "id long")
    assert {r.id for r in bm25.scores(again, terms, given=given).collect()} <= {1, 61}
    assert bm25.best(index, terms.limit(0), 5).count() == 0 and bm25.best(bm25.build(docs.limit(0)), terms, 5).count() == 0


def test_index_counts_terms_where_they_lie(spark, monkeypatch):
    """Counts by hand over slices of a batch; the table of postings is written without an exchange unless ids are repeated."""
    monkeypatch.setattr(bm25, "TOKENS", 4)
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array([["a", "b", "a", "b"], [], ["c"], ["b", "b", "b"]], pa.list_(pa.string()))], ["doc_id", "tokens"])
    got = sorted((str(r["term"]), r["doc_id"], r["dl"], r["tf"]) for b in bm25._counted(iter([batch]), True) for r in b.to_pylist())
    assert got == [("None", 5, 4, 1), ("None", 6, 0, 1), ("None", 7, 1, 1), ("None", 8, 3, 1), ("a", 5, 4, 2), ("a\x01b", 5, 4, 2), ("b", 5, 4, 2), ("b", 8, 3, 3), ("b\x01a", 5, 4, 1), ("b\x01b", 8, 3, 2), ("c", 7, 1, 1)]
    plans = []
    monkeypatch.setattr(bm25, "settled", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), df)[1])
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    bm25.build(docs)
    bm25.build(docs.unionByName(docs))
    assert ["Aggregate" in p for name, p in plans if name == "postings"] == [False, True]
    assert tuple(bm25.statistics(bm25.lengths(docs)).first()) == (4, 21, 5.25)


def test_bigrams_boost(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "green x red y blue")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red green")], "qid long, qtext string")
    got = {r.id: r.s for r in bm25.scores(bm25.build(docs, bigrams=True), bm25.query_terms(q, bigrams=True)).collect()}
    assert got[1] > got[2]


def fuse(spark, dense, sparse, alpha):
    d = spark.createDataFrame([(1, i, v) for i, v in dense], "qid long, id long, d double")
    s = spark.createDataFrame([(1, i, v) for i, v in sparse], "qid long, id long, s double")
    return {r.id: r.f for r in fusion.fuse(d, s, spark.createDataFrame([(1, alpha)], "qid long, alpha double")).collect()}


def test_fusion(spark):
    assert fuse(spark, [(1, 0.1), (2, 0.5), (3, 0.9)], [], 1.5) == {1: 1.0, 2: 0.5, 3: 0.0}
    assert fuse(spark, [], [(1, 5.0), (2, 3.0), (3, 1.0)], -0.3) == {1: 1.0, 2: 0.5, 3: 0.0}
    assert fuse(spark, [(1, 0.1), (2, 0.9)], [(1, 1.0), (2, 5.0)], 0.5) == {1: 0.5, 2: 0.5}
    assert fuse(spark, [], [], 0.5) == {} and fuse(spark, [(1, 0.2), (2, 0.2)], [], 1.0) == {1: 1.0, 2: 1.0}


def test_back_fill_and_relative(spark):
    every = spark.createDataFrame([(1, 1, 9.0), (1, 2, 3.0), (1, 3, 0.0)], "qid long, id long, s double")
    dense = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.2), (1, 4, 0.3)], "qid long, id long, d double")
    top = fusion.top(every, 1, -F.col("s"))
    assert sorted(r.id for r in fusion.back_fill(top, every, dense).collect()) == [1, 2]
    scored = spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.4), (2, 1, 0.0)], "qid long, id long, f double")
    assert sorted((r.qid, r.id, r.rel) for r in fusion.relative(scored, min_score=0.25).collect()) == [(1, 1, 1.0)]
    tags = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "id long, tags array<string>")
    assert [sorted(r.id for r in tags.where(fusion.has_tags(F.col("tags"), w)).collect()) for w in (["a", "b"], ["x"], [])] == [[1], [], [1, 2, 3]]


def test_errors_are_values_too():
    assert issubclass(InvalidArgument, ValueError)


def test_hashed_vectors_hash_each_word_once(spark, monkeypatch):
    """Word keys are those of SQL, made once a word of a batch; vectors are signs added up by hand."""
    words = ["a", "größe", "나무", "x" * 300]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert T.content_keys(pa.array(words)).tolist() == [r.k for r in frame.select(T.content_key(F.col("w")).alias("k")).collect()]
    seen = []
    monkeypatch.setattr(T, "content_keys", lambda x, keys=T.content_keys: (seen.append(len(x)), keys(x))[1])
    texts = ["a b a", None, "", "Größe, 나무! " * 3000]
    tokens = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    got = embed.hash_vectors(pa.array(tokens, pa.list_(pa.string())), 16).to_pylist()
    assert seen == [4]
    asked = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert np.allclose([r.v for r in asked.select("i", embed.hashed(F.col("t"), 16).alias("v")).orderBy("i").collect()], got)
    for some, v in zip(tokens, got, strict=True):
        want = np.zeros(16)
        for w in some:
            h = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
            want[h % 16] += 1 if (h >> 32) % 2 == 0 else -1
        assert np.allclose(v, want / max(np.sqrt(want @ want), 1e-12))


class Handed:
    """A frame whose mapInArrow runs the function here, over one batch, and keeps the rows of each batch that it gives."""

    def __init__(self, spark, rows, schema):
        self.schema, self.batch = spark.createDataFrame(rows, schema).schema, pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], ["id", "text"])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return [b.to_pylist() for b in run(iter([self.batch]))]


def test_tokens_are_handed_on_in_parts(spark, monkeypatch):
    """A batch of texts gives its tokens in parts, all of them, whatever the size of the batch."""
    frame = Handed(spark, [(i, "word " * 40) for i in range(30)] + [(30, None)], "id long, text string")
    whole = sum(T.offset_tokens(frame, "id", "text"), [])
    monkeypatch.setattr(T, "ROWS", 50)
    tokens = T.offset_tokens(frame, "id", "text")
    assert max(map(len, tokens)) <= 50 and sum(tokens, []) == whole and len(whole) == 40 * 30


def test_letters_of_all_syllables_at_once(spark):
    """Every syllable by its number, letters alone, and characters beyond the plane or of code 0, without a lambda a character."""
    every = "".join(map(chr, range(0xAC00, 0xD7A4))) + "ㅎᄀa\x00\U0001f600"
    df = spark.createDataFrame([(every,), ("",), (None,)], "t string").select(T.decompose(F.col("t")).alias("d"), T.choseong(F.col("t")).alias("c"))
    got = [tuple(r) for r in df.collect()]
    split = [(n // 588, n % 588 // 28, n % 28) for n in range(11172)]
    letters = "".join(T.CHOSEONG[a] + T.JUNGSEONG[b] + (T.JONGSEONG[c - 1] if c else "") for a, b, c in split)
    assert got == [(letters + every[11172:], "".join(T.CHOSEONG[a] for a, _, _ in split) + "ㅎᄀ"), ("", ""), (None, None)]
    assert "lambdafunction" not in df._jdf.queryExecution().analyzed().toString()
