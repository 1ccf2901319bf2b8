"""Queries over the call graph derived from `part`, and over clones, with DuckDB's account of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.operators import clones as C, graph as G
from larkspur.checkpoints import reused, settled
from larkspur.plans.retrieval import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_NODES = """nodes AS (SELECT p_partkey AS idx, 'crate_' || p_brand || '::' || p_name || '_' || p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN 'struct' WHEN 1 THEN 'enum' ELSE 'function' END AS kind,
  'src/' || p_brand || '/' || p_type || '.rs' AS file, p_size % 10 = 0 AS is_test, CASE WHEN p_size % 3 = 0 THEN 'pub fn x()' ELSE 'fn x()' END AS signature, p_size % 7 = 0 AS in_trait FROM part)"""
_EDGES = """n AS (SELECT count(*) AS n FROM part), edges AS (SELECT src, dst, min(call_line)::BIGINT AS call_line FROM (
  SELECT p_partkey AS src, (p_partkey * 7 + 3) % n AS dst, p_size AS call_line FROM part, n WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey, p_partkey // 5, p_size + 1 FROM part WHERE p_size % 2 = 0) WHERE src <> dst GROUP BY ALL)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.cast("long").alias("idx"), F.concat(F.lit("crate_"), "p_brand", F.lit("::"), "p_name", F.lit("_"), key.cast("string")).alias("name"),
        F.when(key % 5 == 0, "struct").when(key % 5 == 1, "enum").otherwise("function").alias("kind"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", F.lit(".rs")).alias("file"),
        (F.col("p_size") % 10 == 0).alias("is_test"), F.when(F.col("p_size") % 3 == 0, "pub fn x()").otherwise("fn x()").alias("signature"), (F.col("p_size") % 7 == 0).alias("in_trait"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("line"))
    n = p.agg(F.count("*").alias("n"))  # one row
    far = p.where("k % 3 <> 0").crossJoin(F.broadcast(n)).select(F.col("k").alias("src"), ((F.col("k") * 7 + 3) % F.col("n")).alias("dst"), F.col("line").alias("call_line"))
    near = p.where("line % 2 = 0").select(F.col("k").alias("src"), F.floor(F.col("k") / 5).alias("dst"), (F.col("line") + 1).alias("call_line"))
    return G.dedup_edges(far.unionByName(near))


def _ids(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "idx long")


@query(f"WITH {_EDGES} SELECT src, dst, call_line FROM edges")
def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {_NODES}, m AS (SELECT *, CASE WHEN lower(name) = lower(x) THEN 0 WHEN ends_with(lower(name), '::' || lower(x)) THEN 1 END AS c FROM nodes, (SELECT substr(name, instr(name, '::') + 2) AS x FROM nodes WHERE idx = 7)) SELECT idx, name FROM m WHERE c = (SELECT min(c) FROM m)")
def resolve_symbol(spark, sf_dir):
    n = nodes(spark, sf_dir)
    asked = n.where("idx = 7").first()["name"]
    return G.resolve_symbol(n, asked.split("::", 1)[1].upper()).select("idx", "name")


@query(f"""WITH {_NODES}, calls AS (SELECT idx AS src, CASE WHEN idx % 2 = 0 THEN upper(name) ELSE substr(name, instr(name, '::') + 2) END AS callee, idx % 50 AS call_line FROM nodes),
e AS (SELECT lower(name) AS k, max(idx) AS e FROM nodes GROUP BY 1), s AS (SELECT lower(split_part(name, '::', -1)) AS k, min(idx) AS s FROM nodes GROUP BY 1),
x AS (SELECT (src + 1) % (SELECT count(*) FROM nodes) AS src, coalesce(e, s) AS dst, call_line FROM calls LEFT JOIN e ON lower(callee) = e.k LEFT JOIN s ON split_part(lower(callee), '::', -1) = s.k)
SELECT src, dst, min(call_line) AS call_line FROM x WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL""")
def edges_by_name(spark, sf_dir):
    n = nodes(spark, sf_dir)
    count = n.count()
    name = F.col("name")
    calls = n.select(((F.col("idx") + 1) % count).alias("src"), F.when(F.col("idx") % 2 == 0, F.upper(name)).otherwise(F.regexp_replace(name, "^.*?::", "")).alias("callee"), (F.col("idx") % 50).alias("call_line"))
    return G.edges_by_name(n, calls)


_RBFS = "b AS (SELECT 5::BIGINT AS idx, 0 AS depth UNION SELECT src, depth + 1 FROM b JOIN edges ON dst = idx WHERE depth < 4), r AS (SELECT idx, min(depth)::INT AS depth FROM b GROUP BY idx)"


@query(f"WITH RECURSIVE {_EDGES}, b AS (SELECT unnest([7, 11])::BIGINT AS idx, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN edges ON src = idx WHERE depth < 5) SELECT idx, min(depth)::INT AS depth FROM b GROUP BY idx")
def bfs_forward(spark, sf_dir):
    return G.bfs(edges(spark, sf_dir), _ids(spark, 7, 11), 5)


@query(f"""WITH RECURSIVE {_NODES}, {_EDGES}, {_RBFS}, j AS (SELECT r.idx, depth, is_test FROM r JOIN nodes USING (idx))
SELECT idx, depth, is_test, CASE WHEN depth = 0 THEN 'target' WHEN depth <= 2 THEN 'd' || depth ELSE 'd3+' END AS tag,
(SELECT count(*) FROM j WHERE depth > 0 AND NOT is_test) AS prod, (SELECT count(*) FROM j WHERE depth > 0 AND is_test) AS test FROM j""")
def bfs_reverse_blast(spark, sf_dir):
    return G.blast(nodes(spark, sf_dir), edges(spark, sf_dir), _ids(spark, 5), 4).select("idx", "depth", "is_test", "tag", "prod", "test")


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
w AS (SELECT 1::BIGINT AS idx, [1::BIGINT] AS path UNION ALL SELECT b, list_append(path, b) FROM w JOIN u ON a = idx WHERE len(path) < 7 AND NOT list_contains(path, b)),
h AS (SELECT path FROM w WHERE idx = 90 ORDER BY len(path), path LIMIT 1) SELECT array_to_string(path, '>') AS path FROM h""")
def shortest_path(spark, sf_dir):
    """Of any length. The SQL enumerates paths of up to seven nodes: where the nearest is longer it finds none."""
    found = G.shortest_path(edges(spark, sf_dir), _ids(spark, 1), _ids(spark, 90))
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH {_NODES}, {_EDGES}, p AS (SELECT 5::BIGINT AS idx, 0 AS p UNION ALL SELECT src, CASE WHEN is_test THEN 4 ELSE 1 END FROM edges JOIN nodes ON src = idx WHERE dst = 5
UNION ALL SELECT dst, CASE WHEN kind IN ('struct', 'enum', 'trait', 'type') THEN 3 ELSE 2 END FROM edges JOIN nodes ON dst = idx WHERE src = 5 AND NOT is_test)
SELECT idx, ['definition', 'caller', 'callee', 'type', 'test'][min(p) + 1] AS role, coalesce((SELECT call_line FROM edges WHERE src = p.idx AND dst = 5), 0) AS call_line FROM p GROUP BY idx""")
def context_roles(spark, sf_dir):
    return G.context(nodes(spark, sf_dir), edges(spark, sf_dir), _ids(spark, 5))


@query(f"""WITH {_NODES}, {_EDGES} SELECT idx, name FROM nodes WHERE kind = 'function' AND NOT is_test AND idx NOT IN (SELECT dst FROM edges) AND NOT starts_with(signature, 'pub ') AND NOT in_trait AND ends_with(file, '.rs')""")
def dead_nodes(spark, sf_dir):
    return G.dead_code(nodes(spark, sf_dir), edges(spark, sf_dir)).select("idx", "name")


@query(f"""WITH {_NODES} SELECT split_part(name, '::', 1) AS crate, count_if(kind = 'function' AND NOT is_test)::BIGINT AS prod_fn, count_if(kind = 'function' AND is_test)::BIGINT AS test_fn,
count_if(kind = 'struct')::BIGINT AS structs, count_if(kind = 'enum')::BIGINT AS enums FROM nodes GROUP BY ROLLUP (1)""")
def crate_stats_rollup(spark, sf_dir):
    return G.crate_stats(nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, f AS (SELECT split_part(name, '::', 1) AS crate, idx % 3 <> 0 AS covered FROM nodes WHERE kind = 'function')
SELECT crate, count_if(covered)::BIGINT AS covered, count(*) AS total, round(count_if(covered) * 100.0::DOUBLE / count(*), 4) AS percent FROM f GROUP BY ROLLUP (crate)""")
def coverage(spark, sf_dir):
    n = nodes(spark, sf_dir).where("kind = 'function'")
    return G.coverage(n.select(G.crate_of(F.col("name")).alias("crate"), (F.col("idx") % 3 != 0).alias("covered")))


@query(f"""WITH {_NODES}, {_EDGES}, c AS (SELECT src, list(dst) AS c FROM edges GROUP BY src), p AS (SELECT idx AS a, (idx * 3 + 1) % n AS b FROM nodes, n),
x AS (SELECT a, b, coalesce(ca.c, []) AS u, coalesce(cb.c, []) AS v FROM p LEFT JOIN c ca ON ca.src = a LEFT JOIN c cb ON cb.src = b),
j AS (SELECT a, b, round(CASE WHEN len(u) + len(v) = 0 THEN 1.0 ELSE len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v)))::DOUBLE END, 6) AS j FROM x)
SELECT a, b, j, CASE WHEN j >= 1 THEN 'SAFE' WHEN j >= 0.5 THEN 'REVIEW' ELSE 'DIFFERENT' END AS verdict FROM j""")
def callee_jaccard(spark, sf_dir):
    n = nodes(spark, sf_dir)
    count = n.count()
    return G.neighbour_jaccard(edges(spark, sf_dir), n.select(F.col("idx").alias("a"), ((F.col("idx") * 3 + 1) % count).alias("b")))


@query(f"""WITH {_NODES}, f AS (SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM nodes GROUP BY 1), r AS (SELECT folder, (row_number() OVER (ORDER BY n DESC, folder) - 1)::INT AS r FROM f)
SELECT folder, CASE WHEN r < 26 THEN chr(65 + r) ELSE chr(64 + r // 26) || chr(65 + r % 26) END AS alias FROM r""")
def path_aliases(spark, sf_dir):
    return G.path_aliases(nodes(spark, sf_dir))


# ---------------------------------------------------------------- clones
_LEAST = ", ".join(f"list_min(list_transform(f, lambda x: (x * {a} + {b}) % {C.PRIME}))" for a, b in zip(C.MULTIPLIERS, C.OFFSETS, strict=True))
_TOK = r"list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)/\*.*?(\*/|\z)', ' ', 'g'), '(?m)^\s*#.*$|//.*$', ' ', 'g'), '[^\p{L}\p{N}_]+'), lambda x: x <> ''), lambda w: CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '$N' ELSE w END)"
_SIGS = f"""mt AS (SELECT doc_id AS id, {_TOK} AS t FROM documents), mf AS (SELECT id, list_transform(list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))), lambda g: ('0x' || substr(md5(g), 1, 15))::BIGINT % {C.PRIME}) AS f FROM mt WHERE len(t) >= {C.LEAST_TOKENS}),
sigs AS (SELECT id, [{_LEAST}] AS sig FROM mf), cls AS (SELECT sig, min(id) AS rep, count(*) AS n FROM sigs GROUP BY sig)"""


def _signatures(spark, sf_dir) -> DataFrame:
    """Signatures of all documents, made once in an application while the table's files stay the same."""
    docs = table(spark, sf_dir, "documents")
    return reused(docs, ("minhash", sf_dir), lambda: settled(C.signatures(docs, "doc_id", "text"), "signatures"))


@query(f"WITH {_SIGS} SELECT id, md5(array_to_string(sig, ',')) AS sig_md5, rep AS class_id FROM sigs JOIN cls USING (sig)")
def minhash_signatures(spark, sf_dir):
    sigs = _signatures(spark, sf_dir)
    _, member = C.classes(sigs)
    return sigs.select("id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",").cast("binary")).alias("sig_md5")).join(member.withColumnRenamed("rep", "class_id"), "id")


@query(f"""WITH {_SIGS}, v AS (SELECT rep, p, sig[p] AS v FROM cls, range(1, 65) r(p)), j AS (SELECT x.rep AS a, y.rep AS b, count(*) / 64.0::DOUBLE AS j FROM v x JOIN v y ON x.p = y.p AND x.v = y.v AND x.rep < y.rep GROUP BY ALL)
SELECT a, b, j FROM j WHERE j >= 0.5""")
def minhash_pairs(spark, sf_dir):
    """Pairs of classes of equal signatures; minhash_signatures has the members of each class."""
    groups, _ = C.classes(_signatures(spark, sf_dir))
    return C.similar_pairs(groups, 0.5)


@query()
def lsh_pairs(spark, sf_dir):
    groups, _ = C.classes(_signatures(spark, sf_dir))
    return C.banded_pairs(groups, 0.8)


@query("SELECT md5(text) AS hash, count(*) AS size, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def hash_clone_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return C.hash_groups(d, "doc_id", "h")


_UNIFIED = f"""{_SIGS}, v AS (SELECT rep, p, sig[p] AS v FROM cls, range(1, 65) r(p)), tp AS (SELECT x.rep AS x, y.rep AS y FROM v x JOIN v y ON x.p = y.p AND x.v = y.v AND x.rep < y.rep GROUP BY ALL HAVING count(*) BETWEEN 20 AND 63),
hs AS (SELECT doc_id AS id, md5(array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ')) AS h FROM documents WHERE text IS NOT NULL),
bo AS (SELECT coalesce(hs.id, sigs.id) AS id, h, sig FROM hs FULL JOIN sigs ON hs.id = sigs.id), cl AS (SELECT h, sig, min(id) AS rep FROM bo GROUP BY h, sig),
me AS (SELECT cl.rep, cl.h, cl.sig, cls.rep AS srep FROM cl LEFT JOIN cls ON cl.sig = cls.sig)"""


def _structure(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Structure hashes, here of the word set, and signatures of all documents, in classes."""
    words = F.array_sort(F.array_distinct(F.split(F.lower("text"), " ")))
    hashed = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.md5(F.array_join(words, " ").cast("binary")).alias("h"))
    return C.clone_classes(hashed, _signatures(spark, sf_dir))


@query(f"""WITH {_UNIFIED}, pa AS (SELECT f AS a, rep AS b FROM me JOIN (SELECT h, min(rep) AS f FROM cl WHERE h IS NOT NULL GROUP BY h) USING (h) WHERE rep <> f
  UNION SELECT srep, rep FROM me WHERE rep <> srep UNION SELECT least(p.rep, q.rep), greatest(p.rep, q.rep) FROM tp JOIN me p ON p.srep = tp.x JOIN me q ON q.srep = tp.y),
sc AS (SELECT a, b, coalesce(p.h = q.h, false) AS ast, CASE WHEN p.sig IS NULL OR q.sig IS NULL THEN 0.0 ELSE len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) / 64.0 END::DOUBLE AS j FROM pa JOIN cl p ON p.rep = a JOIN cl q ON q.rep = b)
SELECT a, b, greatest(ast::INT::DOUBLE, j) AS score, j, CASE WHEN ast AND j >= 0.5 THEN 'AST+Token' WHEN ast THEN 'AST' WHEN j >= 0.5 THEN 'Token' ELSE 'Weak' END AS tag FROM sc WHERE greatest(ast::INT::DOUBLE, j) >= 0.4""")
def unified_clones(spark, sf_dir):
    """Pairs of classes; clone_members has the members of each."""
    return C.unified(settled(_structure(spark, sf_dir)[0], "classes"), 0.4)


@query(f"WITH {_UNIFIED} SELECT id, rep FROM bo JOIN cl ON bo.h IS NOT DISTINCT FROM cl.h AND bo.sig IS NOT DISTINCT FROM cl.sig")
def clone_members(spark, sf_dir):
    return _structure(spark, sf_dir)[1]


_BLOCKS = "blocks AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'f' || (l_orderkey % 40) AS file, l_orderkey % 500 AS start_line, l_orderkey % 500 + l_quantity::BIGINT AS end_line, l_partkey AS hash, l_orderkey % 500 + l_linenumber AS s, l_orderkey % 500 + l_linenumber + l_suppkey % 30 AS e FROM lineitem)"


@query(f"""WITH {_BLOCKS}, i AS (SELECT * FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM blocks o WHERE o.file = b.file AND o.hash = b.hash AND o.id <> b.id AND b.start_line <= o.start_line AND b.end_line >= o.end_line AND (b.start_line <> o.start_line OR b.end_line <> o.end_line)) AND e - s >= 3)
SELECT a.id AS id_a, b.id AS id_b, a.s AS s_a, a.e AS e_a, b.s AS s_b, b.e AS e_b FROM i a JOIN i b ON a.hash = b.hash AND a.id < b.id WHERE NOT (a.file = b.file AND a.s <= b.e AND b.s <= a.e) ORDER BY e_a - s_a DESC, id_a, id_b, s_a, s_b LIMIT 50""")
def subblock_clones(spark, sf_dir):
    """The fifty largest, as a report."""
    line = table(spark, sf_dir, "lineitem")
    at = F.col("l_orderkey") % 500
    return C.sub_blocks(line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("f"), (F.col("l_orderkey") % 40).cast("string")).alias("file"), at.alias("start_line"), (at + F.round("l_quantity").cast("long")).alias("end_line"),
        F.col("l_partkey").alias("hash"), (at + F.col("l_linenumber")).alias("s"), (at + F.col("l_linenumber") + F.col("l_suppkey") % 30).alias("e"),
    ))
