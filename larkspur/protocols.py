"""What may be put in place of the engine's own parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession

Metric = Callable[[Column, Column], Column]
Tokenizer = Callable[[Column], Column]
TokenFilter = Callable[[Column], Column]
EmbeddingModel = Callable[[str], Sequence[float]]


@runtime_checkable
class VectorReader(Protocol):
    def __call__(self, spark: SparkSession, path: str) -> DataFrame: ...


@runtime_checkable
class VectorStore(Protocol):
    """Collections of points, as store.Store has them."""

    def create(self, name: str, dim: int, metric: str = "cosine", m: int = 16, ef: int = 200) -> dict: ...
    def insert(self, name: str, rows: DataFrame) -> DataFrame: ...
    def remove(self, name: str, id_: int) -> None: ...
    def points(self, name: str) -> DataFrame: ...


@runtime_checkable
class VectorIndex(Protocol):
    """A search object, as search.Search is one."""

    def find_vector(self, vector: Sequence[float], k: int = 10) -> DataFrame: ...
    def reload(self, points: DataFrame | None = None) -> None: ...
