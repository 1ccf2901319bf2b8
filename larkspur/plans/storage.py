"""Queries over stored points, files, readers and streams, with DuckDB's account of each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.checkpoints import shared_folder
from larkspur.functions import embed
from larkspur.operators import store as S
from larkspur.plans.retrieval import table
from larkspur.session import spread
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


_LATEST = "l AS (SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"


@query(f"WITH {_LATEST} SELECT user_id, event_id, event_type, value FROM l")
def upsert_latest(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(f"WITH {_LATEST} SELECT user_id, event_id FROM l WHERE event_type <> 'error'")
def tombstone_anti(spark, sf_dir):
    last = S.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return S.without(last, last.where("event_type = 'error'"), "user_id").select("user_id", "event_id")


@query("SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id + 1000000, source, n_chars * 2 FROM documents WHERE source IN ('src1', 'src2')")
def replace_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = d.where(F.col("source").isin("src1", "src2")).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "source", (F.col("n_chars") * 2).alias("n_chars"))
    return S.replace_source(d, new)


_OLD = "SELECT 'd' || doc_id AS path, doc_id AS mtime, n_chars AS size, md5(text) AS content_hash FROM documents WHERE doc_id % 10 <> 0"
_NOW = "SELECT 'd' || doc_id AS path, doc_id + CASE WHEN doc_id % 10 IN (2, 3) THEN 1 ELSE 0 END AS mtime, n_chars AS size, md5(text || CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE '' END) AS content_hash FROM documents WHERE doc_id % 10 <> 1"


@query(f"""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged'
WHEN o.content_hash = n.content_hash THEN 'hash-skipped' ELSE 'modified' END AS state FROM ({_OLD}) o FULL JOIN ({_NOW}) n ON o.path = n.path""")
def file_delta(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path, k = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id") % 10
    old = d.where(k != 0).select(path, F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    mark = F.concat("text", F.when(k == 3, "x").otherwise("")).cast("binary")
    now = d.where(k != 1).select(path, (F.col("doc_id") + F.when(k.isin(2, 3), 1).otherwise(0)).alias("mtime"), F.col("n_chars").alias("size"), F.md5(mark).alias("content_hash"))
    return S.file_delta(old, now)


@query("SELECT page_id, max(root) AS root FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/[^/]+', 0) AS root FROM pages) WHERE root <> '' GROUP BY page_id")
def changed_roots(spark, sf_dir):
    """Nearest root above each path, the roots being the two-part prefixes of the addresses."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page"), "url")
    roots = p.select(F.regexp_extract("url", "^https?://[^/]+/[^/]+", 0).alias("root")).where("root <> ''")
    files = p.select(F.concat("url", F.lit("#"), "page").alias("path")).where(F.size(F.split("url", "/")) > 4).unionByName(p.where(F.size(F.split("url", "/")) == 4).select(F.concat("url", F.lit("/#"), "page").alias("path")))
    found = S.changed_crates(files, roots)
    return found.select(F.substring_index("path", "#", -1).cast("long").alias("page_id"), "root")


@query("SELECT doc_id AS id, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS x0, md5(text) AS text_md5 FROM documents JOIN embeddings ON doc_id = vec_id")
def export_points(spark, sf_dir):
    """Points as JSON lines and back."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    path = f"{shared_folder(spark)}/larkspur/export-{uuid.uuid4().hex}"
    d.join(e, d.doc_id == e.vec_id).select(F.col("doc_id").alias("id"), F.col("embedding").alias("vector"), "text").write.mode("overwrite").json(path)
    records, _ = R.read_jsonl(spark, path)
    return records.select("id", F.size("vector").alias("dim"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x0"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {_LATEST} SELECT user_id, event_id, event_type, value FROM l")
def stream_update(spark, sf_dir):
    """The same as upsert_latest, through a stream that reads each file once."""
    base = f"{shared_folder(spark)}/larkspur/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    I.replay(spark, sf_dir, events.schema, f"{base}/sink", f"{base}/state", "user_id", ("ts", "event_id"), pattern="events.parquet").awaitTermination()
    return I.current(spark, f"{base}/sink", "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query()
def md_chunks(spark, sf_dir):
    """Documents as markdown: each source line is a paragraph."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n")).alias("text"))
    return R.markdown_chunks(d, "doc_id", "text")


@query("""SELECT p_partkey AS idx, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'struct' END AS kind, p_name AS name, 'src/' || p_type || '.rs' AS file, p_size AS start_line, p_size + 3 AS end_line, 'a@' || p_size AS call, 2::INT AS n_calls FROM part""")
def symbol_parse(spark, sf_dir):
    """Symbols rendered as text and parsed again."""
    size = F.col("p_size").cast("string")
    kind = F.when(F.col("p_size") % 2 == 0, "function").otherwise("struct")
    text = F.concat(F.lit("["), kind, F.lit("] pub "), "p_name", F.lit("\nFile: ./src/"), "p_type", F.lit(".rs:"), size, F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit("\nCalls: a@"), size, F.lit(", b"))
    p = R.parse_symbols(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), text.alias("text")))
    call = F.concat(F.get("calls", F.lit(0)), F.lit("@"), F.get("call_lines", F.lit(0)).cast("string"))
    return p.select("idx", "kind", "name", "file", "start_line", "end_line", call.alias("call"), F.size("calls").alias("n_calls"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query(r"""WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s!-/:-@\[-`{-~]+'), lambda x: x <> '')) AS w FROM conversations),
h AS (SELECT conv_id, turn, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM t), p AS (SELECT conv_id, turn, h % 16 AS p, sum(CASE WHEN (h >> 32) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM h GROUP BY ALL),
n AS (SELECT conv_id, turn, sum(p * x) AS a, sum(CASE WHEN p = 3 THEN x ELSE 0 END) AS b, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM p GROUP BY ALL)
SELECT conv_id, turn, 16 AS dim, round(coalesce(a / n, 0), 6) + 0.0 AS weighed, round(coalesce(b / n, 0), 6) + 0.0 AS third FROM conversations LEFT JOIN n USING (conv_id, turn)""")
def hashed_embeddings(spark, sf_dir):
    v = F.col("v")
    weighed = F.aggregate(F.transform(v, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    made = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", embed.hashed(F.col("text"), 16).alias("v"))
    return made.select("conv_id", "turn", F.size("v").alias("dim"), (F.round(weighed, 6) + 0.0).alias("weighed"), (F.round(F.get(v, F.lit(3)), 6) + 0.0).alias("third"))

