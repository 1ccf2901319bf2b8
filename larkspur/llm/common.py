"""What the training-data operators share: scratch tables, Arrow text access, vectorised hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: An odd multiplier of the polynomial window hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xD6E8FEB86659FD93
U64 = np.uint64


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a machine's own only where it is unset and Spark runs in one process.

    On a cluster such a folder would hold only what its executors write, so there an unset one is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/larkspur/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def scratch_released(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables made within are removed at the end, but for the paths put into the list: those of results."""
    start, keep = len(_MADE), []
    yield keep
    gone = [p for p in _MADE[start:] if p not in keep]
    for t in spark.catalog.listTables("default"):
        if t.name.startswith("packets_") and any(p.endswith(t.name.removeprefix("packets_")) for p in gone):
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    remove(spark, *gone)
    _MADE[start:] = keep


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: the lineage ends there, executors may die."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bounded_batches(spark: SparkSession, n_bytes: int = 16 << 20) -> None:
    """Arrow batches are cut by bytes as well as by rows, so long texts do not fill a worker."""
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", n_bytes),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000),
    ):
        spark.conf.set(key, str(value))


def filtered(df: DataFrame, text: str, mask) -> DataFrame:
    """The rows of df, all columns, for which mask(text column) holds; texts are not moved."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(mask(b.column(at))))

    return df.mapInArrow(released(run), df.schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch in one uint8 buffer, and the n + 1 offsets into it; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def gathered(batches: Iterator[pa.RecordBatch], n_bytes: int, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches put together until the texts of a column come to n_bytes, or as far as there are any."""
    some: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        some.append(b)
        size += b.column(column).nbytes
        if size >= n_bytes:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, size = [], 0
    if size or any(len(b) for b in some):
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def spans(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about limit bytes together; one longer text makes a run alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Powers:
    """Powers of an odd base modulo 2**64, grown on demand; of more than KEPT none outlive a task that is `released`."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U64(base), pow(base, -1, 1 << 64)
        self.up = np.ones(1, U64)

    def grow(self, n: int) -> np.ndarray:
        if len(self.up) <= n:
            up = np.full(max(n + 1, 1 << 16), self.base, U64)
            up[0] = 1
            self.up = np.cumprod(up, dtype=U64, out=up)
        return self.up

    def shifted(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """x * base**-place, from the powers grown so far: base**-i is base**(last - i) * base**-last."""
        last = len(self.up) - 1
        return x * self.up[last - place] * U64(pow(self.inverse, last, 1 << 64))


POWERS, POWERS_2 = Powers(BASE), Powers(BASE_2)
#: Powers that a worker keeps from task to task: enough for runs of `spans`.
KEPT = (2 << 20) + 2


def give_back() -> None:
    """Drop the powers of longer texts, and return to the system what the worker has freed."""
    for powers in (POWERS, POWERS_2):
        if len(powers.up) > KEPT:
            powers.up = np.ones(1, U64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with `give_back` at the end of its task: workers outlive stages, and idle ones count as memory of their executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def prefix_hash(data: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """H with H[i] = sum of (data[k] + 1) * base**k over k < i, modulo 2**64."""
    up = powers.grow(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    term = data.astype(U64)
    term += U64(1)
    term *= up[: len(data)]
    np.cumsum(term, out=out[1:])
    return out


def window_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Position-independent, mixed hashes of data[start:stop], lengths included."""
    powers.grow(len(h))
    return mix(powers.shifted(h[stop] - h[start], start) ^ (U64(0x632BE59BD9B4E019) * (stop - start).astype(U64)))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
