"""Static embeddings: a table of token vectors pooled by weighted mean, and a hashed table for want of a model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions import text as T

MOST_TOKENS = 512
FLOOR = 1e-12


def pooled(documents: DataFrame, token_table: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "simple", most: int = MOST_TOKENS) -> DataFrame:
    """(key, vector) by token_table(token, vector, weight): unknown tokens are dropped, the first `most` known ones pooled, the length made one.

    The model's window of `most` tokens is part of its definition.
    """
    tokens = documents.select(key, F.posexplode(T.TOKENIZERS[tokenizer](F.coalesce(F.col(text), F.lit("")))).alias("pos", "token"))
    known = tokens.join(token_table, "token")
    from pyspark.sql import Window

    kept = known.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= most)
    flat = kept.select(key, "weight", F.posexplode("vector").alias("dim", "x"))
    mean = flat.groupBy(key, "dim").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
    rows = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select(key, F.transform("v", lambda s: s.x).alias("v"))
    return rows.select(key, unit(F.col("v")).alias("vector"))


def unit(v: Column) -> Column:
    n = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(FLOOR))
    return F.transform(v, lambda x: x / n)


def hash_vectors(tokens: pa.Array, dim: int) -> pa.Array:
    """The unit vectors of lists of tokens; each word of them is hashed once."""
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    h = T.content_keys(words.dictionary)
    place, sign = h % dim, np.where((h >> 32) % 2 == 0, 1.0, -1.0)
    code, row = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    v = np.bincount(row * dim + place[code], sign[code], len(sizes) * dim).reshape(-1, dim)
    v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), FLOOR)
    return pa.ListArray.from_arrays(np.arange(0, v.size + 1, dim, dtype=np.int32), pa.array(v.ravel()))


def hashed(text: Column, dim: int = 64, tokenizer: str = "simple") -> Column:
    """A deterministic unit vector: each token adds a sign to one of `dim` places."""

    @F.arrow_udf("array<double>")
    def vectors(tokens: pa.Array) -> pa.Array:
        return hash_vectors(tokens, dim)

    # said not to be deterministic, so that no filter above it makes it again
    return vectors.asNondeterministic()(T.TOKENIZERS[tokenizer](F.coalesce(text, F.lit(""))))
