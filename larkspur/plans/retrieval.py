"""Queries over vectors and texts, each with DuckDB's account of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.checkpoints import reused, settled
from larkspur.functions import text as T, vectors as V
from larkspur.operators import bm25, fusion, knn as K
from larkspur.session import spread

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TOP = 10


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- vectors
def _queries(e: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("qv"))


_COS = "CASE WHEN list_inner_product(v, v) = 0 OR list_inner_product(qv, qv) = 0 THEN 1.0 ELSE 1.0 - least(greatest(list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv))), -1.0), 1.0) END"
_METRIC = {"cosine": _COS, "l2": "list_inner_product(v, v) - 2 * list_inner_product(v, qv) + list_inner_product(qv, qv)", "neg_dot": "-list_inner_product(v, qv)"}
_Q = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0)"


def _knn_sql(metric: str, where: str = "true", k: int = TOP) -> str:
    return f"""WITH {_Q}, p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE {where}),
d AS (SELECT qid, id, round({_METRIC[metric]}, 6) + 0.0 AS d FROM q, p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INT AS rank FROM d)
SELECT qid, id, d, rank FROM r WHERE rank <= {k}"""


@query(_knn_sql("cosine"))
def knn_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.knn(e, _queries(e), TOP, "cosine")


@query(_knn_sql("l2"))
def knn_l2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.knn(e, _queries(e), TOP, "l2")


@query(_knn_sql("neg_dot"))
def knn_neg_dot(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.knn(e, _queries(e), TOP, "neg_dot")


@query(_knn_sql("cosine", "label = 3"))
def knn_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.knn(e.where("label = 3"), _queries(e), TOP, "cosine")


@query("""SELECT len(embedding)::INT AS dim, count(*) AS n, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY 1""")
def vec_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))


_SQ8 = """f AS (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding)))::INT AS pos FROM embeddings),
t AS (SELECT pos, min(x) AS low, max(x) - min(x) AS "range" FROM f GROUP BY pos)"""


@query(f'WITH {_SQ8} SELECT pos, round(low, 6) AS low, round("range", 6) AS "range" FROM t')
def sq8_train(spark, sf_dir):
    return V.sq8_train(table(spark, sf_dir, "embeddings"), "embedding").select("pos", F.round("low", 6).alias("low"), F.round("range", 6).alias("range"))


_CODES = f"""{_SQ8}, u AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding)))::INT AS pos FROM embeddings),
c AS (SELECT vec_id, pos, low, "range" AS r, floor(least(greatest(CASE WHEN "range" > 0 THEN (x - low) / "range" ELSE 0 END, 0), 1) * 255 + 0.5)::INT AS code FROM u JOIN t USING (pos))"""


@query(f"WITH {_CODES} SELECT vec_id, sum(code)::BIGINT AS code_sum, array_to_string(list(code ORDER BY pos), ',') AS codes FROM c GROUP BY vec_id")
def sq8_encode(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    low, span = V.sq8_arrays(V.sq8_train(e, "embedding"))
    codes = V.sq8_encode(F.col("embedding"), low, span)
    return e.select("vec_id", codes.alias("c")).select("vec_id", F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.array_join(F.col("c").cast("array<string>"), ",").alias("codes"))


_TWO_STAGE = f"""{_CODES}, z AS (SELECT vec_id AS id, list(low + code / 255.0 * r ORDER BY pos) AS v FROM c GROUP BY vec_id), {_Q},
a AS (SELECT qid, id, round({_COS}, 6) + 0.0 AS d FROM q, z),
b AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM a) WHERE n <= 50),
x AS (SELECT qid, b.id, round({_COS}, 6) + 0.0 AS d FROM b JOIN (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) USING (id) JOIN q USING (qid)),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INT AS rank FROM x)"""


@query(f"WITH {_TWO_STAGE} SELECT qid, id, d, rank FROM s WHERE rank <= {TOP}")
def sq8_two_stage(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.two_stage(e, _queries(e), TOP, 50)


@query(f"""WITH {_TWO_STAGE}, e AS (SELECT qid, id, round({_COS}, 6) + 0.0 AS d FROM q, (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)),
g AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM e) WHERE n <= {TOP})
SELECT qid, (SELECT count(*) FROM g JOIN s USING (qid, id) WHERE g.qid = q.qid AND rank <= {TOP}) / {TOP}.0::DOUBLE AS recall FROM q""")
def recall_at_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = _queries(e)
    return K.recall(K.two_stage(e, q, TOP, 50), K.knn(e, q, TOP, "cosine"), TOP)


@query()
def ivf_knn(spark, sf_dir):
    """Every row is in a cell; a third of the cells is probed, for a recall above 0.9 on vectors without clusters."""
    e = table(spark, sf_dir, "embeddings")
    indexed, centres = K.ivf_cells(e)
    return K.ivf_search(indexed, centres, _queries(e), TOP, max(1, (len(centres) * 2 + 2) // 3))


# ---------------------------------------------------------------- tokens
_WS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
_SIMPLE = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s!-/:-@\[-`{-~]+'), lambda x: x <> '')"
_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\s(){}\[\]<>,;:.=+\-*/&|!?#@"''`~^%\\]+'), lambda x: x <> '')"""
_MARKED = "x"
for _b in (r"([a-z])([A-Z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])", r"([A-Z])([A-Z][a-z])"):
    for _ in range(2):
        _MARKED = f"regexp_replace({_MARKED}, '{_b}', '\\1_\\2', 'g')"
_STOP = ", ".join(f"'{w}'" for w in T.CODE_STOPWORDS)
_CODE = f"""list_filter(list_transform(flatten(list_transform({_WORDS}, lambda x: CASE WHEN replace(x, '_', '') = '' THEN [x] ELSE list_filter(regexp_split_to_array({_MARKED}, '_+'), lambda y: y <> '') END)), lambda z: lower(z)), lambda w: strlen(w) >= 2 AND w NOT IN ({_STOP}))"""


def _tokens(spark, sf_dir, tokenizer):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", T.TOKENIZERS[tokenizer](F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


def _tokens_sql(expr: str) -> str:
    return f"SELECT doc_id, len(t)::INT AS n, coalesce(array_to_string(t, ' '), '') AS tokens FROM (SELECT doc_id, {expr} AS t FROM documents)"


@query(_tokens_sql(_WS))
def tok_whitespace(spark, sf_dir):
    return _tokens(spark, sf_dir, "whitespace")


@query(_tokens_sql(_SIMPLE))
def tok_simple(spark, sf_dir):
    return _tokens(spark, sf_dir, "simple")


@query(_tokens_sql(_CODE))
def tok_code(spark, sf_dir):
    return _tokens(spark, sf_dir, "code")


_BIGRAMS = "list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1])"


@query(f"SELECT doc_id, len(b)::INT AS n, coalesce(array_to_string(b, ' '), '') AS grams FROM (SELECT doc_id, {_BIGRAMS} AS b FROM (SELECT doc_id, {_SIMPLE} AS t FROM documents))")
def bigrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.simple_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", T.bigrams(F.col("t")).alias("b")).select("doc_id", F.size("b").alias("n"), F.array_join("b", " ").alias("grams"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_SIMPLE}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"SELECT count(*) AS n, sum(dl)::BIGINT AS total, round(avg(dl), 6) AS avg FROM (SELECT len({_SIMPLE}) AS dl FROM documents)")
def corpus_stats(spark, sf_dir):
    return bm25.statistics(bm25.lengths(table(spark, sf_dir, "documents"))).select("n", "total", F.round("avg", 6).alias("avg"))


@query(f"""SELECT code, count(*) AS docs, round(CASE WHEN code = 0 THEN 1.0 ELSE pow(2.0, code / 8.0) END, 6) AS decoded
FROM (SELECT CASE WHEN dl = 0 THEN 0 ELSE least(greatest(floor(8 * log2(dl::DOUBLE) + 0.5), 0), 255) END::INT AS code FROM (SELECT len({_SIMPLE}) AS dl FROM documents)) GROUP BY code""")
def fieldnorms(spark, sf_dir):
    docs = bm25.lengths(table(spark, sf_dir, "documents"))
    return docs.groupBy(bm25.fieldnorm_code(F.col("dl")).alias("code")).agg(F.sum("rows").alias("docs")).select("code", "docs", F.round(bm25.fieldnorm_length(F.col("code")), 6).alias("decoded"))


# ---------------------------------------------------------------- BM25
def _bm25_cte(norm: str, grams: bool = False) -> str:
    """CTEs ending in bm(qid, id, s) over all documents and all benchmark texts."""
    terms = f"list_concat(t, {_BIGRAMS})" if grams else "t"
    dl = "CASE WHEN dl = 0 THEN 1.0 ELSE pow(2.0, least(greatest(floor(8 * log2(dl::DOUBLE) + 0.5), 0), 255) / 8.0) END" if norm == "quantized" else "dl::DOUBLE"
    return f"""dt AS (SELECT doc_id, {_SIMPLE} AS t FROM documents), dl0 AS (SELECT doc_id, len(t) AS dl FROM dt),
dl1 AS (SELECT doc_id, {dl} AS dl FROM dl0), st AS (SELECT count(*) AS n, avg(dl) AS avg FROM dl0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms}) AS term FROM dt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, term, count(*) AS weight FROM (SELECT qid, unnest({terms}) AS term FROM (SELECT item_id AS qid, {_SIMPLE} AS t FROM benchmark)) GROUP BY ALL),
bm AS (SELECT qid, doc_id AS id, round(sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 6) + 0.0 AS s
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl1 USING (doc_id), st GROUP BY ALL)"""


def _top_sql(norm: str, grams: bool = False) -> str:
    return f"WITH {_bm25_cte(norm, grams)} SELECT qid, id, s, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY -s, id)::INT AS rank FROM bm) WHERE rank <= {TOP}"


def _index(spark, sf_dir, grams: bool = False) -> bm25.Index:
    """The index of all documents, built once in an application while the table's files stay the same."""
    docs = table(spark, sf_dir, "documents")
    return reused(docs, ("bm25", sf_dir, grams), lambda: bm25.build(docs, bigrams=grams))


def _terms(spark, sf_dir, grams: bool = False) -> DataFrame:
    return bm25.query_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext")), bigrams=grams)


def _bm25_top(spark, sf_dir, norm, grams=False, k=TOP):
    return bm25.best(_index(spark, sf_dir, grams), _terms(spark, sf_dir, grams), k, norm)


@query(_top_sql("exact"))
def bm25_exact(spark, sf_dir):
    return _bm25_top(spark, sf_dir, "exact")


@query(_top_sql("quantized"))
def bm25_quantized(spark, sf_dir):
    return _bm25_top(spark, sf_dir, "quantized")


@query(_top_sql("quantized", True))
def bm25_bigram(spark, sf_dir):
    return _bm25_top(spark, sf_dir, "quantized", True)


@query(f"WITH {_bm25_cte('quantized')} SELECT qid, id, s FROM bm JOIN (SELECT doc_id AS id FROM documents WHERE lang = 'de') USING (id) WHERE s > 0")
def bm25_candidates(spark, sf_dir):
    """Scores of given documents only; statistics stay those of all."""
    given = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"))
    return bm25.scores(_index(spark, sf_dir), _terms(spark, sf_dir), "quantized", given=given).where("s > 0").select("qid", "id", "s")


# ---------------------------------------------------------------- hybrid
def _dense_queries(spark, sf_dir) -> DataFrame:
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id).select(F.col("item_id").alias("qid"), F.col("embedding").cast("array<double>").alias("qv"))


def _alpha(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.fusion_alpha(F.col("text")).alias("alpha"))


_HYBRID = f"""{_bm25_cte('quantized')}, hq AS (SELECT item_id AS qid, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON item_id = vec_id),
dk AS (SELECT qid, id, d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM
  (SELECT qid, vec_id AS id, round({_COS}, 6) + 0.0 AS d FROM hq, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))) WHERE n <= {2 * TOP}),
sk AS (SELECT qid, id, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY -s, id) AS n FROM bm) WHERE n <= {2 * TOP}),
en AS (SELECT * FROM sk UNION ALL SELECT qid, id, s FROM bm SEMI JOIN dk USING (qid, id) ANTI JOIN sk USING (qid, id) WHERE s > 0),
al AS (SELECT item_id AS qid, CASE WHEN regexp_matches(text, '[가-힯ᄀ-ᇿ㄰-㆏]') THEN 0.4 ELSE 0.7 END::DOUBLE AS alpha FROM benchmark),
nd AS (SELECT qid, id, CASE WHEN max(d) OVER w - min(d) OVER w <= 1.1920929e-7 THEN 1.0 ELSE (max(d) OVER w - d) / (max(d) OVER w - min(d) OVER w) END AS x FROM dk WINDOW w AS (PARTITION BY qid)),
ns AS (SELECT qid, id, CASE WHEN max(s) OVER w - min(s) OVER w <= 1.1920929e-7 THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS x FROM en WINDOW w AS (PARTITION BY qid)),
fu AS (SELECT qid, id, round(sum(x), 6) + 0.0 AS f FROM (SELECT qid, id, alpha * x AS x FROM nd JOIN al USING (qid) UNION ALL SELECT qid, id, (1 - alpha) * x FROM ns JOIN al USING (qid)) GROUP BY ALL)"""


def fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(qid, id, f): both lists of 2k, the sparse one back-filled, scaled and summed."""
    dense = settled(K.knn(table(spark, sf_dir, "embeddings"), _dense_queries(spark, sf_dir), 2 * k, "cosine").select("qid", "id", "d"), "dense")
    sparse = settled(_bm25_top(spark, sf_dir, "quantized", k=2 * k).select("qid", "id", "s"), "sparse")
    # only documents that the dense side found and the sparse list lacks are scored for the sake of filling up
    lacking = settled(dense.join(sparse, ["qid", "id"], "left_anti").select("qid", "id"), "lacking")
    filled = bm25.scores(_index(spark, sf_dir), _terms(spark, sf_dir), "quantized", given=lacking.select("id"))
    return fusion.fuse(dense, fusion.back_fill(sparse, filled, lacking), _alpha(spark, sf_dir))


@query(f"WITH {_HYBRID} SELECT qid, id, f FROM fu")
def fuse_convex(spark, sf_dir):
    return fused(spark, sf_dir, TOP)


@query(f"""WITH {_HYBRID}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY -f, id)::INT AS rank FROM fu),
k AS (SELECT qid, id, f, rank, round(CASE WHEN max(f) OVER (PARTITION BY qid) > 0 THEN f / max(f) OVER (PARTITION BY qid) ELSE 0 END, 6) AS rel FROM r WHERE rank <= {TOP})
SELECT qid, id, f, rank, rel, source, md5(text) AS text_md5 FROM k LEFT JOIN (SELECT doc_id AS id, source, text FROM documents) USING (id)""")
def hybrid_search(spark, sf_dir):
    best = fusion.relative(fusion.top(fused(spark, sf_dir, TOP), TOP, -F.col("f")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return best.join(docs, "id", "left").select("qid", "id", "f", "rank", "rel", "source", "text_md5")


@query(f"""WITH {_HYBRID}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY -f, id) AS n FROM fu) WHERE n <= {10 * TOP}),
t AS (SELECT r.qid, r.id, r.f FROM r JOIN documents ON doc_id = id WHERE lang = 'en'),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY -f, id)::INT AS rank FROM t) SELECT qid, id, f, rank FROM s WHERE rank <= {TOP}""")
def hybrid_tagged(spark, sf_dir):
    """Ten times as many are fused as asked for, then filtered by tags and cut."""
    more = fusion.top(fused(spark, sf_dir, TOP), 10 * TOP, -F.col("f")).drop("rank")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source")).alias("tags"))
    return fusion.top(more.join(docs, "id").where(fusion.has_tags(F.col("tags"), ["lang:en"])).select("qid", "id", "f"), TOP, -F.col("f"))


@query(f"""WITH {_HYBRID}, k AS (SELECT qid, id, f, round(CASE WHEN max(f) OVER (PARTITION BY qid) > 0 THEN f / max(f) OVER (PARTITION BY qid) ELSE 0 END, 6) AS rel FROM fu)
SELECT qid, id, f, rel FROM k WHERE rel >= 0.25""")
def relative_minscore(spark, sf_dir):
    return fusion.relative(fused(spark, sf_dir, TOP), min_score=0.25)


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src0'")
def tags_and(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("tags", F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source")))
    return d.where(fusion.has_tags(F.col("tags"), ["lang:en", "src:src0"])).select("doc_id")


@query("""WITH c AS (SELECT doc_id, replace(text, chr(10), ' ') AS c, 'home/x/' || source AS source FROM documents WHERE text IS NOT NULL), n AS (SELECT *, list_filter(range(30, 151), lambda i: strlen(left(c, i)) <= 150) AS x FROM c)
SELECT doc_id, CASE WHEN strlen(c) > 150 THEN left(c, list_max(x)) || '...' ELSE c END AS short, substr(source, 8) AS source FROM n""")
def compact_output(spark, sf_dir):
    """Texts on one line, cut between characters at 150 bytes, and paths without the home folder."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", T.compact(F.col("text")).alias("short"), T.without_home(F.concat(F.lit("/home/x/"), "source"), "/home/x").alias("source"))


_FIRSTS = ", ".join(f"'{c}'" for c in T.CHOSEONG)
_SECONDS = ", ".join(f"'{c}'" for c in T.JUNGSEONG)
_LASTS = ", ".join(f"'{c}'" for c in " " + T.JONGSEONG)
_HANGUL = "lambda c: unicode(c) BETWEEN 44032 AND 55203"


@query(f"""WITH w AS (SELECT doc_id, substr(coalesce(text, ''), 1, 0) || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || chr((44032 + doc_id * 7919 % 11172)::INT) || chr((44032 + doc_id * 104729 % 11172)::INT) || 'ㅎ' END AS w FROM documents),
x AS (SELECT doc_id, w, string_split(w, '') AS s FROM w),
y AS (SELECT doc_id, w, array_to_string(list_transform(s, lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN ([{_FIRSTS}])[(unicode(c) - 44032) // 588 + 1] WHEN unicode(c) BETWEEN 4352 AND 4607 OR unicode(c) BETWEEN 12593 AND 12686 THEN c ELSE '' END), '') AS first,
  array_to_string(list_transform(s, lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN ([{_FIRSTS}])[(unicode(c) - 44032) // 588 + 1] || ([{_SECONDS}])[(unicode(c) - 44032) % 588 // 28 + 1] || trim(([{_LASTS}])[(unicode(c) - 44032) % 28 + 1]) ELSE c END), '') AS letters FROM x)
SELECT doc_id, first, md5(letters) AS letters_md5, contains(first, 'ㅎ') AS hit, CASE WHEN doc_id % 3 = 0 THEN 0.7 ELSE 0.4 END::DOUBLE AS alpha FROM y""")
def jamo_choseong(spark, sf_dir):
    """Letters of whole texts, to two thirds of which syllables from all over the block are added."""
    k = F.col("doc_id")
    syllable = lambda n: F.decode(F.unhex(F.hex(44032 + k * n % 11172)), "UTF-16BE")
    w = F.concat(F.coalesce("text", F.lit("")), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), syllable(7919), syllable(104729), F.lit("ㅎ"))))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", w.alias("w")))
    w = F.col("w")
    return d.select("doc_id", T.choseong(w).alias("first"), F.md5(T.decompose(w).cast("binary")).alias("letters_md5"), T.matches_choseong(w, F.lit("ㅎ")).alias("hit"), T.fusion_alpha(w).alias("alpha"))
