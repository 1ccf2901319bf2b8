"""BM25 over unigrams and bigrams, with exact or quantised length normalisation.

An index is a table of postings that carry their document's length. `scores` is a join, for any number
of queries and for given documents; `best` is the search: the stated query set passes through the driver
in blocks, the postings of its terms are brought together by groups of documents, and each group gives
k candidates a query, so what follows grows with the queries and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.checkpoints import settled
from larkspur.functions import text as T
from larkspur.session import spread

#: Queries of a block, documents of a group, and queries that a group scores at once.
BLOCK, GROUP, AT_ONCE = 4096, 4096, 256
K1, B = 1.2, 0.75


def fieldnorm_code(length: Column) -> Column:
    """Eight steps a doubling, 0 to 255; 0 for no tokens."""
    return F.when(length <= 0, 0).otherwise(F.least(F.greatest(F.floor(8 * F.log2(length.cast("double")) + 0.5), F.lit(0)), F.lit(255))).cast("int")


def fieldnorm_length(code: Column) -> Column:
    return F.when(code <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), code / 8.0))


def idf(df: Column, n: Column) -> Column:
    return F.when((df <= 0) | (n <= 0), F.lit(0.0)).otherwise(F.ln((n - df + 0.5) / (df + 0.5) + 1))


def tf_norm(tf: Column, dl: Column, avg: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))


@dataclass(frozen=True)
class Index:
    """postings(doc_id, term, tf, dl), df(term, df), docs(doc_id, dl, rows) and stats (one row: n, total, avg)."""

    postings: DataFrame
    df: DataFrame
    docs: DataFrame
    stats: DataFrame

    @classmethod
    def of(cls, table: DataFrame, df: DataFrame | None = None) -> Index:
        """The index in a table of postings, in which each document also has a row without a term."""
        postings = table.where("term IS NOT NULL")
        docs = table.where("term IS NULL").select("doc_id", "dl", F.col("tf").alias("rows"))
        return cls(postings, postings.groupBy("term").agg(F.count("*").alias("df")) if df is None else df, docs, statistics(docs))


def terms_of(text: Column, tokenizer: str = "simple", bigrams: bool = False) -> Column:
    tokens = T.TOKENIZERS[tokenizer](text)
    return F.concat(tokens, T.bigrams(tokens)) if bigrams else tokens


def lengths(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "simple") -> DataFrame:
    """docs(doc_id, dl, rows) of an index, without its postings."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return spread(documents.select(key, text)).select(F.col(key).alias("doc_id"), F.size(T.TOKENIZERS[tokenizer](t)).alias("dl")).groupBy("doc_id", "dl").agg(F.count("*").alias("rows"))


def statistics(docs: DataFrame) -> DataFrame:
    """One row of docs(doc_id, dl, rows): n, total, avg."""
    return docs.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.sum(F.col("rows") * F.col("dl")).alias("total")).withColumn("avg", F.try_divide("total", "n"))


def build(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "simple", bigrams: bool = False) -> Index:
    """An index of all documents, as a table in the shared folder.

    Null texts are documents without terms; rows that share an id and a length count apart in the
    statistics, and together as one document. Lengths count unigrams. Terms are counted where their text lies, and
    shuffled only if ids are repeated.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = spread(documents.select(key, text)).select(F.col(key).alias("doc_id"), T.TOKENIZERS[tokenizer](t).alias("tokens"))
    kind = documents.schema[key].dataType.simpleString()
    flat = base.mapInArrow(lambda batches: _counted(batches, bigrams), f"doc_id {kind}, term string, dl int, tf long")
    if not documents.groupBy(key).count().where("count > 1").isEmpty():
        flat = flat.groupBy("doc_id", "term", "dl").agg(F.sum("tf").alias("tf"))
    table = settled(flat, "postings")
    return Index.of(table, settled(Index.of(table).df, "document-frequencies"))


#: Tokens that are counted together.
TOKENS = 500_000


def _counted(batches: Iterator[pa.RecordBatch], bigrams: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, term, dl, tf) of the rows of (doc_id, tokens), and one of each row without a term."""
    for batch in batches:
        part = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)) // TOKENS
        starts = np.unique(part, return_index=True)[1].tolist()
        for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
            some = batch.slice(start, end - start)
            dl = some.column(1).value_lengths().to_numpy(zero_copy_only=False)
            row, flat = np.repeat(np.arange(len(dl)), dl), some.column(1).flatten()
            if bigrams and len(flat) > 1:
                inner = row[:-1] == row[1:]
                two = pc.binary_join_element_wise(flat.slice(0, len(flat) - 1), flat.slice(1), "\x01").filter(pa.array(inner))
                row, flat = np.concatenate([row, row[:-1][inner]]), pa.concat_arrays([flat, two])
            words = flat.dictionary_encode()
            n = max(1, len(words.dictionary))
            found, tf = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = np.concatenate([np.arange(len(dl)), found // n])
            term = pa.concat_arrays([pa.nulls(len(dl), pa.string()), words.dictionary.take(pa.array(found % n))])
            tf = np.concatenate([np.ones(len(dl), np.int64), tf])
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), term, pa.array(dl[row].astype(np.int32)), pa.array(tf)], ["doc_id", "term", "dl", "tf"])


def save(index: Index, path: str) -> None:
    """Write the index: postings sorted by term, frequent terms split by document, so that scans skip by term."""
    marks = index.docs.select("doc_id", F.lit(None).cast("string").alias("term"), "dl", F.col("rows").alias("tf"))
    table = index.postings.select("doc_id", "term", "dl", "tf").unionByName(marks)
    table.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    index.df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/df")


def load(spark: SparkSession, path: str) -> Index:
    return Index.of(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/df"))


def query_terms(queries: DataFrame, tokenizer: str = "simple", bigrams: bool = False, key: str = "qid", text: str = "qtext") -> DataFrame:
    """(qid, term, weight): a term said twice counts twice."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return queries.select(F.col(key).alias("qid"), F.explode(terms_of(t, tokenizer, bigrams)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("weight"))


def _length(length_norm: str) -> Column:
    if length_norm not in ("quantized", "exact"):
        raise ValueError("length_norm is quantized or exact")
    return fieldnorm_length(fieldnorm_code(F.col("dl"))) if length_norm == "quantized" else F.col("dl").cast("double")


def scores(index: Index, terms: DataFrame, length_norm: str = "quantized", k1: float = K1, b: float = B, given: DataFrame | None = None) -> DataFrame:
    """(qid, id, s) of every document with a query term, or of those in given(id), s rounded.

    Postings are cut to the query's terms and weighed before they are joined and summed; statistics
    stay those of all documents. The one row of statistics is broadcast.
    """
    dl = _length(length_norm)
    wanted = index.postings
    if given is not None:
        wanted = wanted.join(given.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    wanted = wanted.join(index.df.join(terms.select("term").distinct(), "term", "left_semi"), "term")
    one = F.broadcast(index.stats.select("n", "avg"))  # a single row
    part = idf(F.col("df"), F.col("n")) * tf_norm(F.col("tf"), dl, F.col("avg"), k1, b)
    hits = wanted.crossJoin(one).select("term", F.col("doc_id").alias("id"), part.alias("w")).join(terms, "term")
    return hits.groupBy("qid", "id").agg((F.round(F.sum(F.col("w") * F.col("weight")), 6) + 0.0).alias("s"))


def best(index: Index, terms: DataFrame, k: int, length_norm: str = "quantized", k1: float = K1, b: float = B, block: int = BLOCK) -> DataFrame:
    """(qid, id, s, rank) of the k best documents of each query, s rounded; ties go to the smaller id."""
    spark = terms.sparkSession
    stats = index.stats.first()
    if k < 1 or not stats["n"]:
        return spark.createDataFrame([], "qid long, id long, s double, rank int")
    groups = max(1, -(-stats["n"] // GROUP))
    weighed = index.postings.withColumn("part", tf_norm(F.col("tf"), _length(length_norm), F.lit(stats["avg"]), k1, b))
    parts = [_block(index, weighed, *q, k, groups, stats["n"]) for q in _query_blocks(terms, block)]
    if not parts:
        return spark.createDataFrame([], "qid long, id long, s double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    from larkspur.operators import fusion

    return fusion.top(found.withColumn("s", F.round("s", 6) + 0.0), k, -F.col("s"))


def _query_blocks(terms: DataFrame, block: int) -> Iterator[tuple[list[int], list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(qids, terms, and by term: where its queries begin, query numbers, weights) of blocks of the stated queries."""

    def made(rows: list) -> tuple:
        qids, words = sorted({r["qid"] for r in rows}), sorted({r["term"] for r in rows})
        number, code = {q: i for i, q in enumerate(qids)}, {w: i for i, w in enumerate(words)}
        rows.sort(key=lambda r: (code[r["term"]], r["qid"]))
        at = np.searchsorted([code[r["term"]] for r in rows], np.arange(len(words) + 1))
        return qids, words, at, np.array([number[r["qid"]] for r in rows]), np.array([float(r["weight"]) for r in rows])

    rows: list = []
    seen = 0
    last = None
    for r in terms.orderBy("qid").toLocalIterator():
        if r["qid"] != last:
            if seen == block:
                yield made(rows)
                rows, seen = [], 0
            last, seen = r["qid"], seen + 1
        rows.append(r)
    if rows:
        yield made(rows)


def _block(index: Index, weighed: DataFrame, qids: list[int], words: list[str], at: np.ndarray, who: np.ndarray, weight: np.ndarray, k: int, groups: int, n: int) -> DataFrame:
    """The candidates of one block of queries, k of each group of documents and a few whose rounded scores may tie."""
    spark = weighed.sparkSession
    coded = spark.createDataFrame(pa.table([words, pa.array(range(len(words)), pa.int32())], names=["term", "code"]).to_pandas(), "term string, code int")
    df = index.df.join(F.broadcast(coded), "term")  # as many rows as the block has terms
    shared = spark.sparkContext.broadcast((np.array(qids), at, who, weight))
    part = (idf(F.col("df"), F.lit(n)) * F.col("part")).alias("w")
    wanted = weighed.join(F.broadcast(df.select("term", "code", "df")), "term").select(F.col("doc_id").cast("long").alias("id"), "code", part, F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"))

    def score(t: pa.Table) -> pa.Table:
        qids, at, who, weight = shared.value
        ids, own = np.unique(t.column("id").to_numpy(), return_inverse=True)
        code, w = t.column("code").to_numpy(), t.column("w").to_numpy()
        size = at[code + 1] - at[code]
        row = np.repeat(np.arange(len(code)), size)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + at[code][row]
        query, value, own = who[entry], w[row] * weight[entry], own[row]
        out = []
        for a in range(0, len(qids), AT_ONCE):
            some = (query >= a) & (query < a + AT_ONCE)
            width = min(AT_ONCE, len(qids) - a)
            total = np.bincount(own[some] * width + query[some] - a, value[some], len(ids) * width).reshape(len(ids), width).T
            cut = np.partition(total, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)] - 2e-6
            i, j = np.nonzero((total > 0) & (total >= cut[:, None]))
            out.append((qids[a + i], ids[j], total[i, j]))
        q, d, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["qid", "id", "s"])

    return wanted.groupBy("g").applyInArrow(score, "qid long, id long, s double")
