"""The search object, SQL names, tags of symbols and partial edge refreshes."""

import pytest
from pyspark.sql import functions as F

from larkspur.errors import DimensionMismatch, InvalidArgument
from larkspur.functions import sql
from larkspur.operators import graph as G
from larkspur.search import QueryCache, Search, rerank
from larkspur.sources import readers as R


def embed(text):
    return [float("fox" in text), float("cat" in text), 0.1]


@pytest.fixture(scope="module")
def points(spark):
    rows = [(1, "the quick brown fox", ["a", "role:prod"]), (2, "the lazy cat", ["a"]), (3, "quick quick fox fox", ["b", "role:prod"]), (4, None, None)]
    return spark.createDataFrame([(i, embed(t or ""), t, f"s{i}", tags) for i, t, tags in rows], "id long, vector array<double>, text string, source string, tags array<string>")


def test_find(points):
    s = Search(points, embed, 3)
    got = s.find("quick fox", k=3, min_score=0.0).collect()
    assert got[0].id == 3 and got[0].score == 1.0 and got[0].source == "s3" and {r.id for r in got} >= {1, 3}
    assert [r.id for r in s.find("quick fox", tags=["a"], min_score=0.0).collect()][0] == 1
    assert {r.id for r in s.find("quick fox", exclude_tests=True, min_score=0.0).collect()} == {1, 3}
    assert [r.id for r in s.find("quick fox", tags=["a"], prefilter=True, min_score=0.0).collect()][0] == 1
    assert s.find("quick fox", tags=["none"]).count() == 0
    assert all(r.score >= 0.25 for r in s.find("quick fox").collect())
    many = s.find_all({1: "fox", 2: "cat"}, k=1, min_score=0.0).collect()
    assert [(r.qid, r.id) for r in many] in ([(1, 3), (2, 2)], [(1, 1), (2, 2)])
    assert [r.id for r in s.find_vector([0, 1, 0.1], 1).collect()] == [2]
    with pytest.raises(DimensionMismatch):
        s.find_vector([1.0])
    with pytest.raises(InvalidArgument):
        Search(points).find("x")
    s.reload(points.where("id = 2"))
    assert s.ping() and [r.id for r in s.find("cat", min_score=0.0).collect()] == [2]
    top = rerank(points.where("text IS NOT NULL"), lambda q, t: [float(len(x)) for x in t], "q").collect()
    assert [r.id for r in top][0] in (1, 3)


def test_query_cache():
    calls = []
    cache = QueryCache(lambda t: calls.append(t) or [1.0], 2)
    for t in ("a", "b", "a", "c", "a", "b"):
        cache(t)
    assert calls == ["a", "b", "c", "b"]


def test_sql_names(spark):
    assert "choseong" in sql.register(spark)
    row = spark.sql("SELECT l2_sq(array(0.9D, 0.1D), array(1D, 0D)) a, neg_dot(array(2D), array(3D)) b, cosine_dist(array(0D), array(1D)) c, bm25_tokens('A-b c') d, choseong('한글 x') e, minhash_jaccard(array(1L, 2L), array(1L, 3L)) f").first()
    assert row.a == pytest.approx(0.02) and (row.b, row.c, row.d, row.e, row.f) == (-6.0, 1.0, ["a", "b", "c"], "ㅎㄱ", 0.5)


def test_symbol_tags_and_unresolved(spark, tmp_path):
    n = spark.createDataFrame([(1, "a::f", "function", "x.rs", "pub fn f()", False, ["g"], ["a::g", "helper", "std::mem::swap", "x.unwrap"]), (2, "a::g", "function", "t.py", None, True, None, [])], "idx long, name string, kind string, file string, signature string, is_test boolean, called_by array<string>, calls array<string>")
    tags = {r.idx: r.t for r in n.select("idx", G.symbol_tags(n).alias("t")).collect()}
    assert tags == {1: ["kind:function", "lang:rust", "vis:pub", "role:prod", "caller:g"], 2: ["kind:function", "lang:python", "vis:private", "role:test"]}
    assert {r.callee for r in G.unresolved_calls(n, n.select("idx")).collect()} >= {"helper"}
    path = str(tmp_path / "edges")
    G.refresh_edges(spark.createDataFrame([(1, 2, "a"), (3, 4, "b")], "src long, dst long, crate string"), path)
    G.refresh_edges(spark.createDataFrame([(5, 6, "b")], "src long, dst long, crate string"), path)
    assert sorted((r.src, r.crate) for r in spark.read.parquet(path).collect()) == [(1, "a"), (5, "b")]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.md").write_text("x")
    assert R.input_kind(spark, str(tmp_path / "d")) == "markdown"
    with pytest.raises(InvalidArgument):
        R.input_kind(spark, str(tmp_path / "none"))
    assert points_by(n, "role:test") == [2]


def points_by(n, tag):
    return [r.idx for r in n.where(F.array_contains(G.symbol_tags(n), tag)).collect()]


def test_cache_eviction_and_update(spark, tmp_path):
    from larkspur.search import QueryCache

    cache = QueryCache(lambda t: [float(len(t))], 2)
    for t in ("a", "bb", "a", "ccc"):
        cache(t)
    cache.save(spark, f"{tmp_path}/cache")
    other = QueryCache(lambda t: [-1.0], 2)
    other.load(spark, f"{tmp_path}/cache")
    assert other("a") == [1.0] and other("ccc") == [3.0] and other("bb") == [-1.0]
    points = spark.createDataFrame([(1, [1.0, 0.0], "red fox", "s", ["x"]), (2, [0.0, 1.0], "blue sky", "s", ["x"])], "id long, vector array<double>, text string, source string, tags array<string>")
    s = Search(points, lambda t: [1.0, 0.0], 2)
    assert [r.id for r in s.find("sky", 1, alpha=0.0).collect()] == [2] and s.index is not None
    s.evict()
    assert s.index is not None and s.embed.kept
    s.evict(0, 0)
    assert s.index is None and not s.embed.kept
    s.update(points.where("id = 1").withColumn("text", F.lit("grey sky")), points.where("id = 2").select("id"))
    assert [r.id for r in s.find("sky", 5, alpha=0.0).collect()] == [1]


def test_sql_names_of_code_functions(spark):
    from larkspur.functions import text as T
    from larkspur.operators import clones as C

    sql.register(spark)
    texts = ["fn parseHTTPResponse2(x_y: &str) { let isOk = 'a\\n'; }", "/* gone */ a b c d e f 12 g h i # no\n# line\nx // tail\ny", "short", None, "a" + " tok_1" * 30 + " 99 /* open"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = df.selectExpr("id", "t", "code_tokens(t) AS c", "minhash64(t) AS m").select("*", T.code_tokens(F.col("t")).alias("w"))
    sigs = {r.id: r.sig for r in C.signatures(df, "id", "t").collect()}
    rows = got.collect()
    assert all(r.c == r.w for r in rows) and {r.id: r.m for r in rows if r.m} == sigs and len(sigs) == 2
