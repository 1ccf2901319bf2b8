"""Queries over symbols, their types, traits, places and calls, and over chunks, with DuckDB's account of each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.checkpoints import settled, shared_folder
from larkspur.operators import clones as C, graph as G
from larkspur.plans.code import _EDGES, _ids, edges
from larkspur.plans.retrieval import table
from larkspur.sources import readers as R

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_RICH = """rich AS (SELECT k AS idx, CASE k % 7 WHEN 0 THEN 'Trait_' || k WHEN 1 THEN 'Trait_' || (k - 1) || ' for Type_' || k WHEN 2 THEN 'Trait_' || (k - 2) || ' for Type_' || (k - 1) || '::method_' || k
  ELSE 'mod_' || k % 11 || '::Type_' || (k - k % 7 + 1) || '::fn_' || k END AS name, CASE k % 7 WHEN 0 THEN 'trait' WHEN 1 THEN 'impl' ELSE 'function' END AS kind,
  CASE WHEN k % 10 = 0 THEN 'src/tests/t' || k % 13 ELSE 'src/Lib/m' || k % 13 END || '.rs' AS file, (k % 50 * 10)::INT AS start_line, (k % 50 * 10 + p_size)::INT AS end_line, k % 20 = 0 AS is_test FROM (SELECT p_partkey AS k, p_size FROM part))"""
_NAMED = """ix AS (SELECT lower(name) AS k, max(idx) AS e FROM rich GROUP BY 1), sx AS (SELECT split_part(lower(name), '::', -1) AS k, min(idx) AS s FROM rich GROUP BY 1)"""


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traits, impls, their methods and functions of types, seven parts a family."""
    k = F.col("p_partkey").cast("long")
    s = lambda c: c.cast("string")
    name = (
        F.when(k % 7 == 0, F.concat(F.lit("Trait_"), s(k))).when(k % 7 == 1, F.concat(F.lit("Trait_"), s(k - 1), F.lit(" for Type_"), s(k)))
        .when(k % 7 == 2, F.concat(F.lit("Trait_"), s(k - 2), F.lit(" for Type_"), s(k - 1), F.lit("::method_"), s(k)))
        .otherwise(F.concat(F.lit("mod_"), s(k % 11), F.lit("::Type_"), s(k - k % 7 + 1), F.lit("::fn_"), s(k)))
    )
    at = (k % 50 * 10).cast("int")
    return table(spark, sf_dir, "part").select(
        k.alias("idx"), name.alias("name"), F.when(k % 7 == 0, "trait").when(k % 7 == 1, "impl").otherwise("function").alias("kind"),
        F.concat(F.when(k % 10 == 0, "src/tests/t").otherwise("src/Lib/m"), s(k % 13), F.lit(".rs")).alias("file"), at.alias("start_line"), (at + F.col("p_size")).cast("int").alias("end_line"), (k % 20 == 0).alias("is_test"),
    )


# ---------------------------------------------------------------- listing and names
@query(f"WITH {_RICH} SELECT idx, name, kind FROM rich WHERE contains(lower(name), 'type_1') AND NOT is_test AND file NOT LIKE '%/tests/%'")
def symbols_by_name(spark, sf_dir):
    return G.symbols(rich(spark, sf_dir), "TYPE_1").select("idx", "name", "kind")


@query(f"WITH {_RICH} SELECT idx, name, file FROM rich WHERE ends_with(file, 'm3.rs') AND kind = 'function' ORDER BY file, idx LIMIT 20")
def symbols_in_file(spark, sf_dir):
    """The first twenty of a file's functions, as a listing."""
    return G.symbols(rich(spark, sf_dir), "m3.rs", "Function", tests=True, limit=20).select("idx", "name", "file")


@query("""SELECT k AS idx, CASE k % 4 WHEN 0 THEN 'Foo_' || k WHEN 1 THEN 'Bar_' || k WHEN 2 THEN 'map' ELSE 'a::Baz_' || k END AS leaf, 'type_' || k AS owner, 'foo_' || k || '::bar' AS bare, 'a::b_' || k AS plain,
  't=search_' || k || ' u=ord v=copy' AS bounds FROM (SELECT p_partkey AS k FROM part)""")
def type_names(spark, sf_dir):
    """Types without wrappers, owners, generics, visibility and closures."""
    k = F.col("p_partkey").cast("string")
    n = F.col("p_partkey") % 4
    t = (
        F.when(n == 0, F.concat(F.lit("&'a mut Option<&Foo_"), k, F.lit("<T>, E>"))).when(n == 1, F.concat(F.lit("Vec<Bar_"), k, F.lit("<u8>>")))
        .when(n == 2, F.concat(F.lit("map<Foo_"), k, F.lit(", u8>"))).otherwise(F.concat(F.lit("dyn a::Baz_"), k))
    )
    owner = F.when(n < 2, F.concat(F.lit("m::Type_"), k, F.lit("<T>::f"))).otherwise(F.concat(F.lit("Tr for Type_"), k, F.lit("::g")))
    signature = F.concat(F.lit("fn f<'a, T: Search_"), k, F.lit("<K, V> + Clone, const N: usize, U: Ord>(x: T) where V: Copy, T: Other {"))
    pairs = F.transform(G.generic_bounds(signature), lambda p: F.concat_ws("=", p.a, p.b))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"), G.leaf_type(t).alias("leaf"), G.owning_type(owner).alias("owner"), G.without_generics(F.concat(F.lit("foo_"), k, F.lit("<a<b>, c>::bar"))).alias("bare"),
        G.plain_name(F.concat(F.lit("pub(in x) a::b_"), k, F.lit("::{closure#0}"))).alias("plain"), F.array_join(pairs, " ").alias("bounds"),
    )


@query(f"WITH {_RICH} SELECT idx, array_to_string(['kind:' || kind, 'lang:rust', CASE WHEN idx % 3 = 0 THEN 'vis:pub' ELSE 'vis:private' END, CASE WHEN is_test THEN 'role:test' ELSE 'role:prod' END], ' ') AS tags FROM rich WHERE NOT is_test")
def role_tags(spark, sf_dir):
    """Tags of symbols, and the search for production code by its tag."""
    from larkspur.operators import fusion

    n = rich(spark, sf_dir).withColumn("signature", F.when(F.col("idx") % 3 == 0, "pub fn f()").otherwise("fn f()")).withColumn("called_by", F.lit(None).cast("array<string>"))
    return n.select("idx", G.symbol_tags(n).alias("tags")).where(fusion.has_tags(F.col("tags"), ["role:prod"])).select("idx", F.array_join("tags", " ").alias("tags"))


# ---------------------------------------------------------------- traits, fields and types
@query(f"WITH {_RICH} SELECT t.idx AS trait, i.idx AS impl FROM rich t JOIN rich i ON i.kind = 'impl' AND t.name = split_part(i.name, ' for ', 1)")
def trait_pairs(spark, sf_dir):
    return G.trait_impls(rich(spark, sf_dir))


@query(f"WITH {_RICH} SELECT f.idx, max(i.idx) AS impl FROM rich f JOIN rich i ON f.kind = 'function' AND i.kind = 'impl' AND lower(f.name) LIKE lower(i.name) || '::%' AND NOT contains(substr(f.name, length(i.name) + 3), '::') GROUP BY f.idx")
def trait_methods(spark, sf_dir):
    return G.method_impls(rich(spark, sf_dir))


_BLAST = "r AS (SELECT idx, min(depth)::INT AS depth FROM b GROUP BY idx), j AS (SELECT r.idx, depth, is_test FROM r JOIN rich USING (idx))"
_COUNTS = "(SELECT count(*) FROM j WHERE depth > 0 AND NOT is_test) AS prod, (SELECT count(*) FROM j WHERE depth > 0 AND is_test) AS test"


@query(f"""WITH RECURSIVE {_RICH}, {_EDGES}, b AS (SELECT unnest([14, 15])::BIGINT AS idx, 0 AS depth UNION SELECT src, depth + 1 FROM b JOIN edges ON dst = idx WHERE depth < 2), {_BLAST}
SELECT idx, depth, CASE depth WHEN 0 THEN 'target' WHEN 1 THEN 'd1' ELSE 'd2' END AS tag, {_COUNTS} FROM j WHERE NOT is_test""")
def blast_of_trait(spark, sf_dir):
    """What a change of a trait reaches, its impls included; one step counts as two."""
    n = rich(spark, sf_dir)
    return G.blast(n, edges(spark, sf_dir), _ids(spark, 14), 1, tests=False, impls=settled(G.trait_impls(n), "impls")).select("idx", "depth", "tag", "prod", "test")


_FIELDS = "fa AS (SELECT idx, unnest(['type_' || (idx - idx % 7 + 1) || '::x', 'point_' || idx % 5 || '::y', 'foo::z']) AS key FROM rich WHERE kind = 'function')"


def _with_fields(spark, sf_dir) -> DataFrame:
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), (F.lit(b) if isinstance(b, str) else b).alias("b"))
    n = rich(spark, sf_dir)
    point = F.concat(F.lit("&mut Point_"), (F.col("idx") % 5).cast("string"), F.lit("<T>"))
    full = {"field_accesses": F.array(pair("self", "x"), pair("p", "y"), pair("Q", "Z"), pair("unknown", "w")), "param_types": F.array(pair("self", "Wrong"), pair("p", point)), "local_types": F.array(pair("q", "Option<Foo>"), pair("p", "Later"))}
    return n.where("kind = 'function'").withColumns(full)


@query(f"WITH {_RICH}, {_FIELDS} SELECT key, idx FROM fa")
def field_accesses(spark, sf_dir):
    return G.field_access(_with_fields(spark, sf_dir))


@query(f"""WITH RECURSIVE {_RICH}, {_EDGES}, {_FIELDS}, b AS (SELECT idx, 0 AS depth FROM fa WHERE key = 'point_3::y' UNION SELECT src, depth + 1 FROM b JOIN edges ON dst = idx WHERE depth < 2), {_BLAST}
SELECT idx, depth, CASE depth WHEN 0 THEN 'field' WHEN 1 THEN 'd1' ELSE 'd2' END AS tag, {_COUNTS} FROM j WHERE idx IN (SELECT idx FROM rich WHERE contains(file, 'Lib'))""")
def blast_of_field(spark, sf_dir):
    n = rich(spark, sf_dir)
    return G.field_blast(n, edges(spark, sf_dir), "Point_3.y", 2, scope="Lib", accesses=settled(G.field_access(_with_fields(spark, sf_dir)), "accesses")).select("idx", "depth", "tag", "prod", "test")


@query(f"""WITH {_RICH}, {_NAMED}, c AS (SELECT idx AS src, unnest(['TRAIT_' || (idx - idx % 7), 'fn_' || (idx + 3), 'nowhere']) AS callee FROM rich WHERE idx % 7 > 2)
SELECT src, coalesce(e, s) AS dst, 0 AS call_line FROM c LEFT JOIN ix ON lower(callee) = ix.k LEFT JOIN sx ON split_part(lower(callee), '::', -1) = sx.k WHERE coalesce(e, s) IS NOT NULL AND coalesce(e, s) <> src GROUP BY ALL""")
def type_references(spark, sf_dir):
    n, idx = rich(spark, sf_dir), F.col("idx")
    types = F.when(idx % 7 > 2, F.array(F.concat(F.lit("TRAIT_"), (idx - idx % 7).cast("string")), F.concat(F.lit("fn_"), (idx + 3).cast("string")), F.lit("nowhere"))).otherwise(F.array().cast("array<string>"))
    return G.type_edges(n.withColumn("types", types))


# ---------------------------------------------------------------- calls
def _with_calls(spark, sf_dir) -> DataFrame:
    idx = F.col("idx")
    s = lambda c: c.cast("string")
    calls = F.array(F.concat(F.lit("x::FN_"), s(idx + 7)), F.concat(F.lit("method_"), s(idx - 3)), F.concat(F.lit("lost_"), s(idx % 4)), F.lit("std::mem::swap"), F.lit("v.unwrap"), F.lit("unwrap"))
    return rich(spark, sf_dir).withColumn("calls", calls)


_CALLS = "ca AS (SELECT idx, name, unnest(['x::FN_' || (idx + 7), 'method_' || (idx - 3), 'lost_' || idx % 4]) AS c FROM rich), sh AS (SELECT *, lower(split_part(name, '::', -1)) AS k FROM rich)"


@query(f"WITH {_RICH}, {_CALLS} SELECT sh.idx, array_to_string(list_sort(list(DISTINCT ca.name)), '|') AS called_by FROM sh JOIN ca ON sh.k = lower(split_part(c, '::', -1)) WHERE ca.name <> sh.name GROUP BY sh.idx")
def callers_by_name(spark, sf_dir):
    return G.called_by(_with_calls(spark, sf_dir)).select("idx", F.array_join("called_by", "|").alias("called_by"))


@query(f"WITH {_RICH}, {_CALLS} SELECT DISTINCT idx, c AS callee FROM ca WHERE idx % 5 = 1 AND lower(split_part(c, '::', -1)) NOT IN (SELECT k FROM sh) UNION ALL SELECT idx, 'v.unwrap' FROM rich WHERE idx % 5 = 1")
def unresolved(spark, sf_dir):
    """Calls of some seeds that no symbol answers to; everyday library calls are no news."""
    n = _with_calls(spark, sf_dir)
    return G.unresolved_calls(n, n.where("idx % 5 = 1"))


@query(f"""WITH {_RICH}, {_NAMED}, w AS (SELECT idx AS src, idx % 40 AS line, CASE idx % 6 WHEN 0 THEN 'src/Lib/m3.rs' WHEN 1 THEN 'SRC/LIB/M4.RS' WHEN 2 THEN 'm5.rs' WHEN 3 THEN '/work/src/Lib/m6.rs' WHEN 4 THEN 'other.rs' END AS f, (idx % 50 * 10 + idx % 4 - 1)::INT AS at, 'fn_' || (idx + 1) AS callee FROM rich),
kf AS (SELECT DISTINCT file FROM rich), af AS (SELECT DISTINCT f FROM w WHERE f IS NOT NULL), ex AS (SELECT f, file FROM af JOIN kf ON lower(f) = lower(file)),
mf AS (SELECT f, file FROM ex UNION SELECT f, file FROM af JOIN kf ON ends_with(file, f) OR ends_with(f, file) WHERE f NOT IN (SELECT f FROM ex)),
hit AS (SELECT src, callee, line, min(struct_pack(file := r.file, p := p, idx := r.idx)) AS b FROM w JOIN mf USING (f) JOIN (VALUES (0, 0), (1, 1), (2, -1)) v(p, d) ON true JOIN rich r ON r.file = mf.file AND r.start_line = w.at + d GROUP BY ALL),
res AS (SELECT src, b.idx AS dst, line FROM hit UNION ALL SELECT w.src, coalesce(e, s), w.line FROM w LEFT JOIN ix ON lower(callee) = ix.k LEFT JOIN sx ON lower(callee) = sx.k WHERE w.src NOT IN (SELECT src FROM hit))
SELECT src, dst, min(line) AS call_line FROM res WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL""")
def edges_by_place(spark, sf_dir):
    """Files equal in any case, or one the end of the other; lines one off; names for the rest."""
    n, idx = rich(spark, sf_dir), F.col("idx")
    k = idx % 6
    f = F.when(k == 0, "src/Lib/m3.rs").when(k == 1, "SRC/LIB/M4.RS").when(k == 2, "m5.rs").when(k == 3, "/work/src/Lib/m6.rs").when(k == 4, "other.rs")
    raw = n.select(idx.alias("src"), F.concat(F.lit("fn_"), (idx + 1).cast("string")).alias("callee"), f.alias("callee_file"), (idx % 50 * 10 + idx % 4 - 1).cast("int").alias("callee_start_line"), (idx % 40).alias("line"))
    return G.edges_by_place(n, raw)


def _edge_files(spark, sf_dir) -> str:
    """Call edges of each module as <module>.edges.jsonl, as an extractor leaves them."""
    folder = f"{shared_folder(spark)}/larkspur/edges-{uuid.uuid4().hex}"
    idx = F.col("idx")
    rows = rich(spark, sf_dir).where("kind = 'function'").select(
        F.concat(F.lit("mod_"), (idx % 11).cast("string")).alias("crate"), F.col("name").alias("caller"), F.concat(F.lit(".\\"), F.replace("file", F.lit("/"), F.lit("\\"))).alias("caller_file"), F.lit("fn").alias("caller_kind"),
        F.concat(F.lit("fn_"), (idx + 1).cast("string")).alias("callee"), F.col("file").alias("callee_file"), (F.col("start_line") + 10).alias("callee_start_line"), (idx % 40).cast("int").alias("line"), (idx % 2 == 0).alias("is_local"),
    )
    rows.repartition("crate").write.partitionBy("crate").json(folder)
    return folder


@query(f"WITH {_RICH} SELECT 'mod_' || idx % 11 AS crate, name AS caller, 'fn_' || (idx + 1) AS callee, (idx % 40)::INT AS line, idx % 2 = 0 AS is_local FROM rich WHERE kind = 'function'")
def call_edge_files(spark, sf_dir):
    return R.read_edges(spark, _edge_files(spark, sf_dir), pattern="*.json").select("crate", "caller", "callee", "line", "is_local")


@query(f"""WITH {_RICH}, f AS (SELECT * FROM rich WHERE kind = 'function'), o AS (SELECT * FROM f ORDER BY idx LIMIT 1)
SELECT 'at' AS what, 'fn_' || (f.idx + 1) AS found FROM f, o WHERE f.file = o.file AND f.idx % 40 = o.idx % 40 UNION SELECT 'of', 'fn_' || (f.idx + 1) FROM f, o WHERE f.name = o.name UNION SELECT 'in', f.name FROM f, o WHERE f.idx % 11 = 3""")
def call_lookups(spark, sf_dir):
    """Callees at a place, callees of a caller, callers in a crate."""
    calls = R.read_edges(spark, _edge_files(spark, sf_dir), pattern="*.json")
    one = rich(spark, sf_dir).where("kind = 'function'").orderBy("idx").first()
    parts = {"at": G.callees_at(calls, f"./{one['file']}", one["idx"] % 40), "of": G.callees_of(calls, one["name"]).select("callee").distinct(), "in": G.callers_in(calls, "mod_3")}
    named = [p.toDF("found").select(F.lit(k).alias("what"), "found") for k, p in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(f"""WITH {_EDGES}, {_RICH}, p AS (SELECT idx AS a, (idx * 3 + 1) % n AS b FROM rich, n WHERE idx <> (idx * 3 + 1) % n), s AS (SELECT a, b, unnest([a, b]) AS seed FROM p),
l1 AS (SELECT a, b, seed, src AS idx FROM s JOIN edges ON dst = seed), l2 AS (SELECT a, b, seed, src AS idx FROM l1 JOIN edges ON dst = idx),
u AS (SELECT DISTINCT a, b, idx FROM (FROM l1 UNION ALL FROM l2) WHERE idx <> seed), k AS (SELECT a, b, count_if(NOT is_test) AS prod, count_if(is_test) AS test FROM u JOIN rich USING (idx) GROUP BY ALL),
ce AS (SELECT src AS k, list(dst) AS c FROM edges GROUP BY 1), cr AS (SELECT dst AS k, list(src) AS c FROM edges GROUP BY 1),
x AS (SELECT p.a, p.b, coalesce(e1.c, []) AS ea, coalesce(e2.c, []) AS eb, coalesce(r1.c, []) AS ra, coalesce(r2.c, []) AS rb FROM p LEFT JOIN ce e1 ON e1.k = a LEFT JOIN ce e2 ON e2.k = b LEFT JOIN cr r1 ON r1.k = a LEFT JOIN cr r2 ON r2.k = b),
y AS (SELECT a, b, round(CASE WHEN len(ea) + len(eb) = 0 THEN 1 ELSE len(list_intersect(ea, eb)) / len(list_distinct(list_concat(ea, eb)))::DOUBLE END, 6) AS callee_j, round(CASE WHEN len(ra) + len(rb) = 0 THEN 1 ELSE len(list_intersect(ra, rb)) / len(list_distinct(list_concat(ra, rb)))::DOUBLE END, 6) AS caller_j FROM x)
SELECT a, b, callee_j, caller_j, coalesce(prod, 0)::BIGINT AS prod, coalesce(test, 0)::BIGINT AS test, CASE WHEN callee_j >= 1 THEN 'SAFE' WHEN callee_j >= 0.5 THEN 'REVIEW' ELSE 'DIFFERENT' END AS verdict FROM y LEFT JOIN k USING (a, b)""")
def merge_safety(spark, sf_dir):
    n = rich(spark, sf_dir)
    count = n.count()
    pairs = n.select(F.col("idx").alias("a"), ((F.col("idx") * 3 + 1) % count).alias("b")).where("a <> b")
    return G.merge_safety(n, edges(spark, sf_dir), pairs)


@query()
def flow_tree(spark, sf_dir):
    """Two roots, four levels; a node is expanded where it is first met."""
    tree = G.flow_tree(edges(spark, sf_dir), [7, 11], 4)
    return spark.createDataFrame([(i, *row) for i, row in enumerate(tree)], "place int, level int, idx long, repeated boolean")


# ---------------------------------------------------------------- chunks
@query(f"WITH {_RICH} SELECT file, is_test, idx FROM (SELECT *, row_number() OVER (PARTITION BY file, idx % 3 ORDER BY is_test, start_line, end_line, idx) AS r FROM rich) WHERE r = 1")
def production_first(spark, sf_dir):
    """One chunk of each name in a file: production before test, then the earliest."""
    n = rich(spark, sf_dir).withColumn("name", (F.col("idx") % 3).cast("string"))
    return G.prefer_production(n, "idx").select("file", "is_test", "idx")


@query(f"""WITH {_RICH}, ol AS (SELECT * FROM rich WHERE idx % 3 <> 0), nw AS (SELECT * FROM rich WHERE idx % 13 IN (1, 2) AND idx % 10 <> 0)
SELECT idx, name || '!' AS name, file, 'new' AS state FROM nw UNION ALL SELECT idx, name, file, 'kept' FROM ol WHERE file NOT IN (SELECT file FROM nw) AND idx % 13 <> 5""")
def merged_chunks(spark, sf_dir):
    """New chunks replace those of their files, chunks of files that are gone are pruned, the others kept."""
    n = rich(spark, sf_dir).select("idx", "name", "file")
    new = n.where("idx % 13 IN (1, 2) AND idx % 10 <> 0").withColumn("name", F.concat("name", F.lit("!")))
    return G.merge_chunks(n.where("idx % 3 <> 0"), new, n.where("idx % 13 <> 5").select("file"))


@query(f"WITH {_RICH} SELECT idx FROM rich WHERE idx % 4 = 0")
def own_chunks(spark, sf_dir):
    """Without those of package caches and toolchains."""
    k = F.col("idx") % 4
    home = F.when(k == 1, "/home/u/.cargo/x/").when(k == 2, "/x/registry/").when(k == 3, "/opt/rustup/").otherwise("")
    return G.own_files(rich(spark, sf_dir).withColumn("file", F.concat(home, "file"))).select("idx")


@query(f"WITH {_RICH} SELECT DISTINCT split_part(name, '::', 1) AS crate FROM rich WHERE idx % 17 = 3")
def stale_crates(spark, sf_dir):
    """Crates one of whose chunks has moved since their edges were made."""
    n = rich(spark, sf_dir)
    moved = n.withColumn("start_line", F.col("start_line") + F.when(F.col("idx") % 17 == 3, 1).otherwise(0))
    return G.stale_crates(G.fingerprints(n), G.fingerprints(moved))


_CHUNKS = "ch AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 50 AS hash, 'f' || (l_orderkey % 40) AS file, (l_suppkey % 900)::INT AS start_line, (l_suppkey % 900 + l_quantity)::INT AS end_line, l_linenumber = 7 AS is_test FROM lineitem)"


def _chunks(spark, sf_dir) -> DataFrame:
    at = F.col("l_suppkey") % 900
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 50).alias("hash"), F.concat(F.lit("f"), (F.col("l_orderkey") % 40).cast("string")).alias("file"),
        at.cast("int").alias("start_line"), (at + F.round("l_quantity")).cast("int").alias("end_line"), (F.col("l_linenumber") == 7).alias("is_test"),
    )


@query(f"WITH {_CHUNKS} SELECT id FROM ch WHERE end_line - start_line + 1 >= 20 AND NOT is_test")
def clone_candidates(spark, sf_dir):
    return C.candidates(_chunks(spark, sf_dir), 20).select("id")


@query(f"""WITH {_CHUNKS}, pr AS (SELECT id AS a, lead(id) OVER (PARTITION BY hash ORDER BY id) AS b, (id % 97) / 97.0::DOUBLE AS j FROM ch)
SELECT a, b, j FROM pr JOIN ch x ON x.id = a JOIN ch y ON y.id = b WHERE NOT (x.file = y.file AND x.start_line <= y.end_line AND y.start_line <= x.end_line) ORDER BY j DESC, a, b LIMIT 40""")
def clone_top_pairs(spark, sf_dir):
    """The forty best pairs that are no parts of each other, as a report."""
    from pyspark.sql import Window

    c = _chunks(spark, sf_dir)
    pairs = c.select(F.col("id").alias("a"), F.lead("id").over(Window.partitionBy("hash").orderBy("id")).alias("b"), (F.col("id") % 97 / 97.0).cast("double").alias("j")).where("b IS NOT NULL")
    return C.best_pairs(C.without_overlaps(pairs, c), 40)


@query(f"""WITH {_CHUNKS}, pr AS (SELECT id AS a, lead(id) OVER (PARTITION BY hash ORDER BY id) AS b, (id % 97) / 97.0::DOUBLE AS score FROM ch)
SELECT least(x.file, y.file) AS file_a, greatest(x.file, y.file) AS file_b, count(*) AS pairs, max(score) AS best FROM pr JOIN ch x ON x.id = a JOIN ch y ON y.id = b GROUP BY 1, 2""")
def clone_file_groups(spark, sf_dir):
    from pyspark.sql import Window

    c = _chunks(spark, sf_dir)
    pairs = c.select(F.col("id").alias("a"), F.lead("id").over(Window.partitionBy("hash").orderBy("id")).alias("b"), (F.col("id") % 97 / 97.0).cast("double").alias("score")).where("b IS NOT NULL")
    return C.file_groups(pairs, c)


@query()
def clone_groups(spark, sf_dir):
    """Members of hash groups, without those that overlap a larger one that stays."""
    return C.separate(_chunks(spark, sf_dir).select("hash", "id", "file", "start_line", "end_line"))


@query(f"""WITH {_RICH}, f AS (SELECT split_part(name, '::', 1) AS crate, file, count(*) AS total, count_if(idx % 3 <> 0) AS covered FROM rich WHERE kind = 'function' AND name LIKE 'mod%' GROUP BY ALL)
SELECT crate, sum(covered)::BIGINT AS covered, sum(total)::BIGINT AS total, round(sum(covered) * 100.0::DOUBLE / sum(total), 4) AS percent FROM f GROUP BY ROLLUP (crate)""")
def coverage_export(spark, sf_dir):
    """A coverage export, written as JSON, read and rolled up by crate."""
    n = rich(spark, sf_dir).where("kind = 'function' AND name LIKE 'mod%'").select(G.crate_of(F.col("name")).alias("crate"), "file", "idx")
    per = n.groupBy("crate", "file").agg(F.count("*").alias("count"), F.count_if(F.col("idx") % 3 != 0).alias("covered"))
    file = F.struct(F.concat("crate", F.lit("|"), "file").alias("filename"), F.struct(F.struct("count", "covered").alias("functions")).alias("summary"))
    path = f"{shared_folder(spark)}/larkspur/coverage-{uuid.uuid4().hex}"
    per.groupBy("crate").agg(F.array(F.struct(F.collect_list(file).alias("files"))).alias("data")).select("data").write.json(path)
    read = R.read_coverage(spark, path, lines=True)
    both = read.select(F.substring_index("filename", "|", 1).alias("crate"), "covered", "total")
    return G.coverage(both, counted=True)
