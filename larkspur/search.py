"""One object to search with: hybrid, dense or sparse, over a point table."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.errors import DimensionMismatch, InvalidArgument
from larkspur.functions import text as T
from larkspur.operators import bm25, fusion, knn

CACHED_QUERIES = 1000


class QueryCache:
    """The embeddings of the last queries; least recently used ones go first."""

    def __init__(self, embed: Callable[[str], Sequence[float]], size: int = CACHED_QUERIES) -> None:
        self.embed, self.size, self.kept = embed, size, OrderedDict()

    def __call__(self, text: str) -> list[float]:
        if text not in self.kept:
            self.kept[text] = list(self.embed(text))
            while len(self.kept) > self.size:
                self.kept.popitem(last=False)
        self.kept.move_to_end(text)
        return self.kept[text]

    def save(self, spark: SparkSession, path: str) -> None:
        """What is kept, in the order of its use: at most `size` rows."""
        rows = [(i, t, [float(x) for x in v]) for i, (t, v) in enumerate(self.kept.items())]
        spark.createDataFrame(rows, "used int, text string, vector array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        for r in spark.read.schema("used int, text string, vector array<double>").parquet(path).orderBy("used").collect():
            self.kept[r["text"]] = list(r["vector"])
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)


class Search:
    """points has id, vector, text, source and tags; the index is built at the first text query and kept."""

    def __init__(self, points: DataFrame, embed: Callable[[str], Sequence[float]] | None = None, dim: int | None = None, metric: str = "cosine", tokenizer: str = "simple", bigrams: bool = True, length_norm: str = "quantized") -> None:
        self.points, self.dim, self.metric, self.tokenizer, self.bigrams, self.length_norm = points, dim, metric, tokenizer, bigrams, length_norm
        self.embed = QueryCache(embed) if embed else None
        self.index: bm25.Index | None = None
        self.used = time.monotonic()

    def evict(self, embedder_seconds: float = 300, index_seconds: float = 600) -> None:
        """Drop the kept embeddings and the index if they have not been used for so long; the next search makes them again."""
        idle = time.monotonic() - self.used
        if self.embed and idle >= embedder_seconds:
            self.embed.kept.clear()
        if idle >= index_seconds:
            self.index = None

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    def ping(self) -> bool:
        return True

    def update(self, points: DataFrame, removed: DataFrame) -> None:
        """New and changed points (the columns of `points`) and removed(id) take effect; the index is made again when next needed."""
        gone = removed.select("id").unionByName(points.select("id")).distinct()
        self.reload(self.points.join(gone, "id", "left_anti").select(*self.points.columns).unionByName(points.select(*self.points.columns)))

    def reload(self, points: DataFrame | None = None) -> None:
        """Forget the index; take other points if given."""
        self.index, self.points = None, points if points is not None else self.points

    def _sparse(self, queries: DataFrame, k: int, dense: DataFrame, keep: DataFrame | None) -> DataFrame:
        """The k best of each query (among `keep`), and the scores of dense results that are not among them."""
        if self.index is None:
            self.index = bm25.build(self.points, "id", "text", self.tokenizer, self.bigrams)
        terms = bm25.query_terms(queries, self.tokenizer, self.bigrams)
        if keep is None:
            top = bm25.best(self.index, terms, k, self.length_norm)
        else:
            top = fusion.top(bm25.scores(self.index, terms, self.length_norm, given=keep), k, -F.col("s"))
        return fusion.back_fill(top, bm25.scores(self.index, terms, self.length_norm, given=dense), dense)

    def _dense(self, vectors: dict[int, Sequence[float]], k: int) -> DataFrame:
        for v in vectors.values():
            if self.dim and len(v) != self.dim:
                raise DimensionMismatch(f"{len(v)} components, {self.dim} wanted")
        queries = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "qid long, qv array<double>")
        return knn.knn(self.points, queries, k, self.metric, "id", "vector").select("qid", "id", "d")

    def find_vector(self, vector: Sequence[float], k: int = 10) -> DataFrame:
        """id, d (distance) and score (similarity) of the nearest points."""
        return self._dense({0: vector}, k).select("id", "d", (1 - F.col("d")).alias("score")).orderBy("d", "id")

    def find(self, text: str, k: int = 10, tags: Sequence[str] = (), min_score: float = 0.25, alpha: float | None = None, exclude_tests: bool = False, prefilter: bool = False, overfetch: int = 2) -> DataFrame:
        """id, score (relative to the best), source, tags and text of the k best for one query."""
        return self.find_all({0: text}, k, tags, min_score, alpha, exclude_tests, prefilter, overfetch).drop("qid")

    def find_all(self, texts: dict[int, str], k: int = 10, tags: Sequence[str] = (), min_score: float = 0.25, alpha: float | None = None, exclude_tests: bool = False, prefilter: bool = False, overfetch: int = 2) -> DataFrame:
        """The same for several numbered queries, with qid; ten times k are fused when tags filter afterwards."""
        if self.embed is None:
            raise InvalidArgument("no embedder")
        self.used = time.monotonic()
        wanted = [*tags, *(["role:prod"] if exclude_tests else [])]
        queries = self.spark.createDataFrame(list(texts.items()), "qid long, qtext string")
        weight = queries.select("qid", F.lit(alpha).cast("double").alias("alpha") if alpha is not None else T.fusion_alpha(F.col("qtext")).alias("alpha"))
        keep = self.points.where(fusion.has_tags(F.col("tags"), wanted)).select("id") if wanted else None
        vectors = {i: self.embed(t) for i, t in texts.items()}
        inner = Search(self.points.join(keep, "id", "left_semi"), None, self.dim, self.metric) if prefilter and keep is not None else self
        dense = inner._dense(vectors, overfetch * k)
        sparse = self._sparse(queries, overfetch * k, dense, keep if prefilter else None)
        best = fusion.top(fusion.fuse(dense, sparse, weight), k if keep is None else 10 * k, -F.col("f")).drop("rank")
        if keep is not None:
            best = fusion.top(best.join(keep, "id", "left_semi"), k, -F.col("f")).drop("rank")
        scored = fusion.relative(best, min_score=min_score)
        return scored.join(self.points.select("id", "source", "tags", "text"), "id", "left").select("qid", "id", F.col("rel").alias("score"), "source", "tags", "text").orderBy("qid", F.desc("score"), "id")


def rerank(results: DataFrame, score: Callable[[list[str], list[str]], list[float]], query: str, text: str = "text") -> DataFrame:
    """results ordered by a cross-encoder: score(queries, texts) is called with batches of rows."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score([query] * len(texts), texts.fillna("").tolist()), dtype="float64")

    return results.withColumn("rerank", scored(F.col(text))).orderBy(F.desc("rerank"), "id")
