"""Queries over formats, stores, token helpers and small functions, with DuckDB's account of each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.checkpoints import settled, shared_folder
from larkspur.functions import embed, formats as M, text as T, vectors as V
from larkspur.operators import bm25, clones as C, store as S
from larkspur.plans.code import _SIGS, _signatures
from larkspur.plans.retrieval import _CODES, _SIMPLE, _index, table
from larkspur.sources import readers as R
from larkspur.streaming import incremental as I

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- texts
@query("""WITH f AS (SELECT doc_id, text, doc_id % 3 AS k FROM documents) SELECT doc_id, CASE WHEN k < 2 THEN 'Title ' || doc_id END AS title, CASE WHEN k < 2 THEN '2024-01-0' || (1 + doc_id % 9) END AS date,
CASE WHEN k = 0 THEN 'a|b c|d' || doc_id WHEN k = 1 THEN '' END AS tags, CASE WHEN k < 2 THEN 'x: ' || doc_id END AS custom, k < 2 AS found FROM f""")
def frontmatter(spark, sf_dir):
    """Leading blocks of two thirds of the documents, parsed."""
    k, d = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    tags = F.when(k == 0, F.concat(F.lit("tags: [a, b c, d"), d, F.lit("]\n"))).otherwise("")
    head = F.concat(F.lit('---\ntitle: "Title '), d, F.lit('"\ndate: 2024-01-0'), (1 + F.col("doc_id") % 9).cast("string"), F.lit("\n"), tags, F.lit("extra: x: "), d, F.lit("\nno colon\n---\n"))
    fm = R.frontmatter(F.concat(F.when(k < 2, head).otherwise("-- no\n"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", fm.alias("m")).select("doc_id", "m.title", "m.date", F.array_join("m.tags", "|").alias("tags"), F.col("m.custom")["extra"].alias("custom"), F.col("m").isNotNull().alias("found"))


_STOPS = ", ".join(f"'{w}'" for w in T.KOREAN_STOPWORDS)


@query(f"""WITH t AS (SELECT doc_id, list_concat({_SIMPLE}, ['은', '그리고', 'Mixed', '나무']) AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter(t, lambda x: x NOT IN ({_STOPS}) AND length(x) >= 3), lambda x: lower(x)), ' ') AS kept FROM t""")
def token_filters(spark, sf_dir):
    """Stop words, a least length in characters and lower case, one after another."""
    more = F.array(*[F.lit(x) for x in ("은", "그리고", "Mixed", "나무")])
    tokens = F.concat(T.simple_tokens(F.coalesce("text", F.lit(""))), more)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.chain(T.without_stopwords(), T.of_length(3), T.lowered)(tokens), " ").alias("kept"))


_POS = ("NNG", "VV", "MAG", "MM", "JKS", "EC", "SN", "SL", "SH", "SF", "XPN")


@query("""WITH k AS (SELECT p_partkey AS idx, ['noun', 'verb', 'adverb', 'adjective', 'particle', 'particle', 'number', 'foreign', 'foreign', 'punctuation', 'unknown'][p_partkey % 11 + 1] AS kind FROM part)
SELECT idx, kind, kind IN ('noun', 'verb', 'adverb', 'adjective', 'number', 'foreign') AS searchable FROM k""")
def pos_kinds(spark, sf_dir):
    kind = T.token_kind(F.element_at(F.array(*[F.lit(x) for x in _POS]), (F.col("p_partkey") % 11 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), kind.alias("kind"), T.is_searchable(kind).alias("searchable"))


@query(r"""WITH s AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '\s+|\S+') AS s FROM conversations), u AS (SELECT conv_id, turn, unnest(s) AS w, unnest(range(len(s))) AS i FROM s),
p AS (SELECT *, coalesce(sum(strlen(w)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM u)
SELECT conv_id * 1000 + turn AS id, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS pos, w AS token, a AS "start", a + strlen(w) AS "end" FROM p WHERE NOT regexp_matches(w, '^\s')""")
def offset_tokens(spark, sf_dir):
    """Words with their places in bytes."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return T.offset_tokens(c, "id", "text")


@query("""SELECT k AS idx, 'term_' || k AS term, 'NNG' AS pos, CASE WHEN k % 4 = 1 THEN 'read ' || k ELSE 'term_' || k END AS reading, 'term_' || k || ',0,NNG,' || CASE WHEN k % 4 = 1 THEN 'read ' || k ELSE 'term_' || k END AS line
FROM (SELECT p_partkey AS k FROM part) WHERE k % 4 IN (0, 1)""")
def user_dictionary(spark, sf_dir):
    """Entries of two and three parts, comments and blank lines, read and rendered."""
    k = F.col("p_partkey").cast("string")
    n = F.col("p_partkey") % 4
    line = F.when(n == 0, F.concat(F.lit(" term_"), k, F.lit(" , NNG "))).when(n == 1, F.concat(F.lit("term_"), k, F.lit(",NNG, read "), k)).when(n == 2, F.concat(F.lit("# "), k, F.lit(",a,b,c,d"))).otherwise("  ")
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), T.dictionary_entry(line).alias("e")).where("e IS NOT NULL")
    return e.select("idx", "e.term", "e.pos", "e.reading", T.dictionary_line(F.col("e")).alias("line"))


@query("""SELECT p_partkey AS idx, 'Says ' || p_name AS said, (p_size || '-' || (p_size + 3)) AS lines, 'src/' || p_type AS short, p_size % 3 = 0 AS test FROM part""")
def text_parts(spark, sf_dir):
    """Description and lines of a rendered symbol, paths relative to a root, test paths."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("[function] f\nFile: ./a.rs:"), size, F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit("\nSignature: fn f()\n  Says "), "p_name", F.lit("\nmore"))
    path = F.concat(F.lit("src"), F.when(F.col("p_size") % 3 == 0, F.lit("/tests/")).otherwise("/attests/"), F.lit("a.rs"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"), T.description(text).alias("said"), T.line_range(text).alias("lines"), T.relative_path(F.concat(F.lit("/work/src/"), "p_type"), "/work").alias("short"), T.is_test_path(path).alias("test"),
    )


@query("""SELECT doc_id, md5(text) AS text_md5, lower(lpad(to_hex(('0x' || substr(md5(text), 1, 15))::BIGINT), 16, '0')) AS key, substr(md5(text), 15, 2) || substr(md5(text), 13, 2) || substr(md5(text), 11, 2) || substr(md5(text), 9, 2) || substr(md5(text), 7, 2) || substr(md5(text), 5, 2) || substr(md5(text), 3, 2) || substr(md5(text), 1, 2) AS hash FROM documents WHERE text IS NOT NULL""")
def content_hashes(spark, sf_dir):
    """Keys of contents: as stable ids, and the first eight bytes of the digest the other way round."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(t.cast("binary")).alias("text_md5"), F.lower(F.lpad(F.hex(T.content_key(t)), 16, "0")).alias("key"), T.content_hash(t).alias("hash"))


@query(f"WITH {_SIGS} SELECT id, md5(array_to_string(list_transform(sig, lambda x: printf('%016x', x)), '')) AS hex_md5, true AS same, true AS odd FROM sigs")
def signature_hex(spark, sf_dir):
    """Signatures as hexadecimal text and back; text of another length is none."""
    s = _signatures(spark, sf_dir).select("id", "sig", C.to_hex(F.col("sig")).alias("x"))
    return s.select("id", F.md5(F.col("x").cast("binary")).alias("hex_md5"), (C.from_hex(F.col("x")) == F.col("sig")).alias("same"), C.from_hex(F.concat("x", F.lit("0"))).isNull().alias("odd"))


_LINES = "t AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_LINES} SELECT doc_id, md5(array_to_string(list_concat(['new', ''], t), chr(10))) AS before, md5(array_to_string(list_concat(t[1:1], ['', 'new'], t[2:]), chr(10))) AS after, md5(array_to_string(list_concat(['new'], t[2:]), chr(10))) AS replaced FROM t""")
def symbol_edits(spark, sf_dir):
    """A body put before, after and in place of the first line of each text."""
    lines, new, one = F.split("text", "\n"), F.array(F.lit("new")), F.lit(1)
    md5 = lambda c: F.md5(F.array_join(c, "\n").cast("binary"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", md5(S.insert_before(lines, one, new)).alias("before"), md5(S.insert_after(lines, one, new)).alias("after"), md5(S.edited(lines, one, one, new)).alias("replaced"))


@query("""SELECT p_partkey AS idx, '[function] f_' || p_partkey || chr(10) || 'File: src/' || p_type || '.rs:' || p_size || '-' || (p_size + 3) || chr(10) || 'Signature: fn f()' || chr(10) || 'Returns: u8' || chr(10) || 'Types: A, B' || chr(10) || 'Calls: a@' || p_size || ', b' || chr(10) || 'Params: p: &T' || chr(10) || 'Strings: env::var("KEY")' AS text FROM part""")
def symbol_render(spark, sf_dir):
    """Symbol text parsed and rendered again."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("[function] pub f_"), k, F.lit("\nFile: ./src/"), "p_type", F.lit(".rs:"), size, F.lit("-"), (F.col("p_size") + 3).cast("string"),
        F.lit("\nSignature: fn f()\nReturns: u8\nTypes: A, B\nCalls: a@"), size, F.lit(', b\nParams: p: &T\nStrings: env::var("KEY")'),
    )
    parsed = R.parse_symbols(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), text.alias("text")))
    return parsed.select("idx", R.render_symbols(parsed).alias("text"))


@query("""WITH p AS (SELECT p_partkey AS idx, p_size FROM part) SELECT idx, 'kind' AS key, 'function' AS value FROM p UNION ALL SELECT idx, 'name', 'f_' || idx FROM p UNION ALL SELECT idx, 'visibility', 'pub' FROM p UNION ALL SELECT idx, 'start_line', p_size::VARCHAR FROM p
UNION ALL SELECT idx, 'end_line', '0' FROM p UNION ALL SELECT idx, 'calls', 'a|b' FROM p WHERE idx % 2 = 0 UNION ALL SELECT idx, 'local_types', 'x' || chr(9) || 'T|y' || chr(9) || 'U' FROM p""")
def custom_maps(spark, sf_dir):
    """The typed map of symbols, one row an entry."""
    pair, none = "array<struct<a:string,b:string>>", F.lit(None)
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"), F.lit("function").alias("kind"), F.concat(F.lit("f_"), F.col("p_partkey").cast("string")).alias("name"), F.lit("pub").alias("visibility"), F.col("p_size").alias("start_line"), none.cast("int").alias("end_line"),
        none.cast("string").alias("signature"), none.cast("string").alias("return_type"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("calls"),
        F.array().cast("array<string>").alias("types"), none.cast(pair).alias("string_args"), F.array().cast(pair).alias("param_flows"),
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("x", "T"), ("y", "U"))]).alias("local_types"),
    )
    flat = p.select("idx", F.explode(M.custom_map()).alias("key", "v"))
    return flat.select("idx", "key", F.coalesce("v.s", F.col("v.i").cast("string"), F.array_join("v.l", "|")).alias("value"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'q ' || o_orderkey END AS query, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 10 ELSE 3 END AS k, CASE WHEN o_orderkey % 5 <> 0 THEN 'a|b' END AS tags,
CASE WHEN o_orderkey % 5 <> 0 THEN '{"jsonrpc":"2.0","id":' || o_orderkey || ',"result":{"results":[{"id":1,"score":0.5}],"total_docs":7}}' END AS answer FROM orders""")
def requests(spark, sf_dir):
    """Search requests parsed, defaults filled in, and answers; lines that are no requests are null."""
    o = F.col("o_orderkey").cast("string")
    k = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise('"k":3,')
    good = F.concat(F.lit('{"id":'), o, F.lit(',"method":"search","params":{"query":"q '), o, F.lit('",'), k, F.lit('"tags":["a","b"]}}'))
    r = M.request(F.when(F.col("o_orderkey") % 5 == 0, "{no json").otherwise(good))
    hits = F.array(F.struct(F.lit(1).alias("id"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("url")))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), r.alias("r"))
    return d.select("id", "r.params.query", F.coalesce("r.params.k", F.lit(0)).alias("k"), F.array_join("r.params.tags", "|").alias("tags"), F.when(F.col("r").isNotNull(), M.response(F.col("r.id"), hits, F.lit(7))).alias("answer"))


@query("SELECT o_orderkey AS id, strftime(DATE '1970-01-01' + (o_orderkey % 40000)::INT, '%Y-%m-%d') AS day FROM orders")
def civil_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), M.civil(F.col("o_orderkey") % 40000).alias("day"))


_NEIGHBOURS = "g AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS s FROM lineitem GROUP BY 1)"


@query(f"WITH {_NEIGHBOURS} SELECT id, array_to_string(list_transform(s, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - s[i - 1] END), ',') AS gaps, array_to_string(s, ',') AS back FROM g")
def neighbour_gaps(spark, sf_dir):
    """Neighbour lists as gaps, and back."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey").cast("long")).alias("s")).select("id", M.gaps(F.col("s")).alias("d"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return g.select("id", joined(F.col("d")).alias("gaps"), joined(M.from_gaps(F.col("d"))).alias("back"))


# ---------------------------------------------------------------- vectors
@query("SELECT vec_id, round(list_inner_product(v, u), 5) AS unit_cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS u FROM embeddings)".replace("round(list_inner_product(v, u), 5)", "round(1 - least(greatest(list_inner_product(v, u), -1), 1), 5) + 0.0"))
def parsed_vector(spark, sf_dir):
    """The distance to a query given as text, for vectors of unit length."""
    e = table(spark, sf_dir, "embeddings")
    text = ", ".join(repr(float(x)) for x in e.where("vec_id = 0").first()["embedding"])
    return e.select("vec_id", (F.round(V.unit_cosine_dist(F.col("embedding"), V.parse_vector(F.lit(text))), 5) + 0.0).alias("unit_cosine"))


@query(f"""WITH {_CODES}, z AS (SELECT vec_id, list(low + code / 255.0 * r ORDER BY pos) AS v FROM c GROUP BY vec_id)
SELECT vec_id, round(list_inner_product(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) + 0.0 AS product FROM z""")
def sq8_products(spark, sf_dir):
    """A query's product with quantised vectors by its table, the parameters written and read back."""
    e = table(spark, sf_dir, "embeddings")
    s = S.Store(spark, f"{shared_folder(spark)}/larkspur/sq8-{uuid.uuid4().hex}")
    q = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    s.create("p", len(q))
    s.save_sq8("p", V.sq8_train(e, "embedding"))
    low, span = V.sq8_arrays(s.sq8("p"))
    return e.select("vec_id", (F.round(V.sq8_dot(V.sq8_encode(F.col("embedding"), low, span), q, low, span), 5) + 0.0).alias("product"))


@query(f"""WITH t AS (SELECT doc_id, unnest({_SIMPLE}) AS token, unnest(range(len({_SIMPLE}))) AS pos FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM t WHERE strlen(token) % 3 <> 0),
m AS (SELECT doc_id, sum(strlen(token) * (1 + strlen(token) % 2)) / sum(1 + strlen(token) % 2) AS x, sum(1.0::DOUBLE * (1 + strlen(token) % 2)) / sum(1 + strlen(token) % 2) AS y FROM k WHERE n <= 512 GROUP BY doc_id)
SELECT doc_id, round(x / sqrt(x * x + y * y), 6) AS x, round(y / sqrt(x * x + y * y), 6) AS y FROM m""")
def pooled_embeddings(spark, sf_dir):
    """Static embeddings by a table of the corpus's tokens: unknown ones dropped, the first 512 pooled by weight."""
    d = table(spark, sf_dir, "documents")
    tokens = settled(_index(spark, sf_dir).df.select(F.col("term").alias("token")).where(F.octet_length("token") % 3 != 0), "tokens")
    n = F.octet_length("token").cast("double")
    vectors = tokens.select("token", F.array(n, F.lit(1.0)).alias("vector"), (1 + n % 2).alias("weight"))
    made = embed.pooled(d, vectors)
    return made.select("doc_id", F.round(F.get("vector", F.lit(0)), 6).alias("x"), F.round(F.get("vector", F.lit(1)), 6).alias("y"))


# ---------------------------------------------------------------- stores
@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'later' ELSE source END AS source, md5(text) AS text_md5, len(embedding)::INT AS dim FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id <> 3""")
def store_points(spark, sf_dir):
    """A collection made, filled, upserted, filled with raw files, a point removed, compacted and renamed."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = settled(d.join(e, d.doc_id == e.vec_id).select(F.col("doc_id").alias("id"), F.col("embedding").alias("vector"), "source", F.array(F.concat(F.lit("lang:"), "lang")).alias("tags"), "text"), "rows")
    root = f"{shared_folder(spark)}/larkspur/store-{uuid.uuid4().hex}"
    s = S.Store(spark, root)
    s.create("a", len(e.first()["embedding"]))
    s.insert("a", rows.where("id % 2 = 1"))
    s.insert("a", rows.where("id % 4 = 1").withColumn("source", F.lit("later")))
    raw = rows.where("id % 2 = 0").withColumn("removed", F.lit(False)).withColumn("seq", F.lit(0).cast("long"))
    raw.write.parquet(f"{root}/raw")
    s.bulk_load("a", f"{root}/raw")
    s.remove("a", 3)
    s.compact("a")
    s.rename("a", "b")
    return s.points("b").select("id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("vector").alias("dim"))


@query("SELECT doc_id AS id, 16 AS dim FROM documents WHERE source = 'src1'")
def store_embedded(spark, sf_dir):
    """Texts inserted with vectors made from their first 8,000 bytes, and found by source."""
    s = S.Store(spark, f"{shared_folder(spark)}/larkspur/store-{uuid.uuid4().hex}")
    s.create("a", 16)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.array(F.concat(F.lit("lang:"), "lang")).alias("tags"), "text")
    s.insert_embedded("a", rows, lambda t: embed.hashed(t, 16))
    p = s.points("a")
    return S.by_source(p, "src1").join(p, "id").select("id", F.size("vector").alias("dim"))


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id % 3 <> 0")
def unchanged_skipped(spark, sf_dir):
    """Only records whose body hash or text differs from what is stored are written again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("body_hash"), "text", "source")
    k = F.col("id") % 3
    stored = d.withColumn("body_hash", F.when(k == 1, "old").otherwise(F.col("body_hash"))).withColumn("text", F.when(k == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return S.unchanged_records(stored, d).select("id", "source")


@query(f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'changed text now' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0) SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_SIMPLE}) AS term FROM n) GROUP BY ALL""")
def index_update(spark, sf_dir):
    """Postings after documents were removed and changed, without a new index of the others."""
    d = table(spark, sf_dir, "documents")
    old = _index(spark, sf_dir).postings.select("doc_id", "term", "tf")
    changed = d.where("doc_id % 5 = 1").select("doc_id", F.lit("changed text now").alias("text"))
    added = bm25.build(changed).postings.select("doc_id", "term", "tf")
    return I.updated_postings(old, d.where("doc_id % 5 = 0").select("doc_id"), added)


_REASONS = "r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)"


@query(f"""WITH {_REASONS} SELECT 'u' || user_id AS symbol, 'why ' || user_id AS why, max(c)::INT AS steps, count_if(n = c)::INT AS resolved, 'failed ' || max(event_id) AS last_failure, user_id % 2 = 0 AS noted FROM r WHERE user_id % 10 <> 0 GROUP BY user_id""")
def reasons(spark, sf_dir):
    """Decision records of users' histories: saved, the last failure of each resolved (or invalidated), some deleted, listed."""
    e = table(spark, sf_dir, "events")
    step = F.struct(F.lit("modify").alias("action"), F.lit("2024-01-01").alias("date"), F.lit(None).cast("string").alias("note"), F.concat(F.lit("failed "), F.col("event_id").cast("string")).alias("failure"), *[F.lit(None).cast("string").alias(c) for c in ("fix", "root_cause")], F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("commit"))
    history = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", step.alias("step")))).alias("h"))
    u = F.col("user_id").cast("string")
    none = {"decision": "string", "constraints": "array<string>", "rejected": "array<struct<approach:string,reason:string,condition:string>>", "file_path": "string", "line_range": "array<long>", "related_symbols": "array<string>"}
    made = history.select(F.concat(F.lit("u"), u).alias("symbol"), F.concat(F.lit("why "), u).alias("why"), F.transform("h", lambda x: x.step).alias("history"), "user_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    even = S.resolve_last_failure(made.where("user_id % 2 = 0"), "not so")
    odd = S.resolve_last_failure(made.where("user_id % 2 <> 0"))
    store = S.Reasons(spark, f"{shared_folder(spark)}/larkspur/reasons-{uuid.uuid4().hex}")
    store.save(made.where("user_id % 3 = 0"))
    store.save(even.unionByName(odd))
    kept = store.list().where(~F.col("symbol").rlike("0$"))
    last = F.element_at("history", -1)
    return kept.select("symbol", "why", F.size("history").alias("steps"), F.size(F.filter("history", lambda x: x.resolved)).alias("resolved"), last.failure.alias("last_failure"), F.coalesce(last.note.startswith("[INVALIDATED: not so]"), F.lit(False)).alias("noted"))


# ---------------------------------------------------------------- sources of code
@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT 'src::m' || k || '::f_' || k AS name, 'function' AS kind, 1 AS start_line, 2 AS end_line, 'pub' AS visibility FROM p WHERE k % 2 = 0 UNION ALL SELECT 'src::m' || k || '::_G', 'class', 4, 6, 'private' FROM p WHERE k % 2 = 0
UNION ALL SELECT 'src::m' || k || '::_G::h', 'function', 5, 6, 'pub' FROM p WHERE k % 2 = 0 UNION ALL SELECT 'src::m' || k || '::j_' || k, 'function', 1, 3, 'pub' FROM p WHERE k % 2 = 1""")
def source_symbols(spark, sf_dir):
    """Symbols of Python and JavaScript sources."""
    return _extracted(spark, sf_dir)[0].select("name", "kind", "start_line", "end_line", "visibility")


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT 'src::m' || k || '::f_' || k AS caller, 'g.x' AS callee, 2 AS line FROM p WHERE k % 2 = 0 UNION ALL SELECT 'src::m' || k || '::_G::h', 'f_' || k, 6 FROM p WHERE k % 2 = 0 UNION ALL SELECT 'src::m' || k || '::j_' || k, 'call_' || k, 2 FROM p WHERE k % 2 = 1""")
def source_calls(spark, sf_dir):
    return _extracted(spark, sf_dir)[1].select("caller", "callee", "line")


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey").cast("string")
    python = F.concat(F.lit("def f_"), k, F.lit("(a):\n    return g.x(a)\n\nclass _G:\n    def h(self):\n        return f_"), k, F.lit("(1)\n"))
    script = F.concat(F.lit("export function j_"), k, F.lit("(a) {\n  return call_"), k, F.lit("(a)\n}\n"))
    even = F.col("p_partkey") % 2 == 0
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("src/m"), k, F.when(even, ".py").otherwise(".js")).alias("path"), F.when(even, python).otherwise(script).alias("text"))
    return R.extract_symbols(files)
