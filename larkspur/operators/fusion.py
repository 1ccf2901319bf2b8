"""Dense and sparse results fused by min-max scaling and a convex sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPSILON = 1.1920929e-7


def top(df: DataFrame, k: int, score: Column, *ties: str) -> DataFrame:
    """The k best rows of each query by ascending `score`, then id."""
    w = Window.partitionBy("qid").orderBy(score, "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop(*ties)


def min_max(df: DataFrame, value: str, inverted: bool) -> Column:
    """Scaled to 0..1 within each query; all 1 where they hardly differ."""
    w = Window.partitionBy("qid")
    low, high = F.min(value).over(w), F.max(value).over(w)
    span = high - low
    share = (high - F.col(value)) / span if inverted else (F.col(value) - low) / span
    return F.when(span <= EPSILON, F.lit(1.0)).otherwise(share)


def fuse(dense: DataFrame, sparse: DataFrame, alpha: DataFrame) -> DataFrame:
    """(qid, id, f) from dense(qid, id, d), sparse(qid, id, s) and alpha(qid, alpha) clamped to 0..1.

    An id on one side only has nothing from the other.
    """
    a = alpha.select("qid", F.least(F.greatest("alpha", F.lit(0.0)), F.lit(1.0)).alias("alpha"))
    left = dense.select("qid", "id", min_max(dense, "d", True).alias("x"), F.lit(True).alias("side"))
    right = sparse.select("qid", "id", min_max(sparse, "s", False).alias("x"), F.lit(False).alias("side"))
    weighed = left.unionByName(right).join(a, "qid")
    part = F.when(F.col("side"), F.col("alpha")).otherwise(1 - F.col("alpha")) * F.col("x")
    return weighed.groupBy("qid", "id").agg((F.round(F.sum(part), 6) + 0.0).alias("f"))


def back_fill(top_sparse: DataFrame, all_sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """The sparse list, and the sparse scores above zero of dense results that it lacks."""
    extra = all_sparse.join(dense.select("qid", "id"), ["qid", "id"], "left_semi").where("s > 0").join(top_sparse.select("qid", "id"), ["qid", "id"], "left_anti")
    return top_sparse.select("qid", "id", "s").unionByName(extra.select("qid", "id", "s"))


def relative(df: DataFrame, score: str = "f", min_score: float = 0.0) -> DataFrame:
    """With rel = score / best score of the query (0 if that is not positive), rows under min_score dropped."""
    best = F.max(score).over(Window.partitionBy("qid"))
    return df.withColumn("rel", F.round(F.when(best > 0, F.col(score) / best).otherwise(0.0), 6)).where(F.col("rel") >= min_score)


def has_tags(tags: Column, wanted: list[str]) -> Column:
    """All of the wanted tags; none wanted is always true."""
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), F.coalesce(tags, F.array().cast("array<string>")))) == 0 if wanted else F.lit(True)
