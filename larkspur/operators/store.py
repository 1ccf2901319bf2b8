"""Point tables: upserts, tombstones, sources, deltas of files, collections."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkspur.checkpoints import settled
from larkspur.errors import InvalidArgument, NotFound
from larkspur.functions import text as T


def latest(versions: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each key; later columns of `order` break ties."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def without(points: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return points.join(tombstones.select(key).distinct(), key, "left_anti")


def replace_source(points: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """All rows of the sources in `new` give way to the rows of `new`."""
    return points.join(new.select(source).distinct(), source, "left_anti").select(*points.columns).unionByName(new.select(*points.columns))


def file_delta(old: DataFrame, now: DataFrame) -> DataFrame:
    """path and state: new, deleted, modified (hash differs), hash-skipped (touched only) or unchanged.

    Both have path, mtime, size and content_hash.
    """
    a = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("mtime", "size", "content_hash")])
    touched = (F.col("mtime") != F.col("o_mtime")) | (F.col("size") != F.col("o_size"))
    state = (
        F.when(F.col("o_mtime").isNull(), "new").when(F.col("mtime").isNull(), "deleted").when(~touched, "unchanged")
        .when(F.col("content_hash").eqNullSafe(F.col("o_content_hash")), "hash-skipped").otherwise("modified")
    )
    return a.join(now.select("path", "mtime", "size", "content_hash"), "path", "full").select("path", state.alias("state"))


def unchanged_records(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows of `new` whose body hash and text differ from what is stored."""
    return new.join(stored.select(key, "body_hash", "text"), [key, "body_hash", "text"], "left_anti")


def changed_crates(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The nearest package root above each changed path: every folder above is tried, the longest wins."""
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return above.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def get(points: DataFrame, ids: list[int], key: str = "id", vector: str = "vector") -> DataFrame:
    """Text, dimension and first five components of some points."""
    return points.where(F.col(key).isin(ids)).select(key, "text", F.size(vector).alias("dim"), F.slice(vector, 1, 5).alias("head"))


def custom_value(value: Column, kind: str) -> Column:
    """One typed entry of the custom map: s, i, f, b or l of a struct, the others null."""
    kinds = {"s": "string", "i": "long", "f": "double", "b": "boolean", "l": "array<string>"}
    if kind not in kinds:
        raise InvalidArgument(f"no value kind {kind}")
    return F.struct(*[(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


POINTS = "id long, vector array<float>, source string, tags array<string>, text string, removed boolean, seq long"


def by_source(points: DataFrame, source: str) -> DataFrame:
    return points.where(F.col("source") == source).select("id")


class Store:
    """Collections of point tables under one root; each is <root>/collections/<name> with config.json beside its parts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise InvalidArgument(f"bad collection name {name!r}")
        return f"{self.root}/collections/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self._path(name))
        return fs.exists(p)

    def create(self, name: str, dim: int, metric: str = "cosine", m: int = 16, ef: int = 200) -> dict:
        if dim <= 0 or m < 2 or ef < m:
            raise InvalidArgument("dim must be positive, m at least 2, ef at least m")
        if self.exists(name):
            raise InvalidArgument(f"{name} exists")
        config = {"dim": dim, "metric": metric, "m": m, "ef": ef}
        self.spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{self._path(name)}/config")
        return config

    def config(self, name: str) -> dict:
        if not self.exists(name):
            raise NotFound(name)
        return json.loads(self.spark.read.text(f"{self._path(name)}/config").first()[0])

    def list(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/collections")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str) -> None:
        if not self.exists(name):
            raise NotFound(name)
        fs, p = self._fs(self._path(name))
        fs.delete(p, True)

    def rename(self, name: str, new: str) -> None:
        if not self.exists(name):
            raise NotFound(name)
        if self.exists(new):
            raise InvalidArgument(f"{new} exists")
        fs, p = self._fs(self._path(name))
        fs.rename(p, self._fs(self._path(new))[1])

    def points(self, name: str) -> DataFrame:
        """The last version of every point that is not removed."""
        every = self.versions(name)
        return latest(every, "id", "seq").where("NOT removed").drop("removed", "seq")

    def versions(self, name: str) -> DataFrame:
        self.config(name)
        return self.spark.read.schema(POINTS).parquet(f"{self._path(name)}/points")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").parquet(f"{self._path(name)}/points")

    def _next(self, name: str) -> int:
        fs, p = self._fs(f"{self._path(name)}/points")
        return (self.versions(name).agg(F.max("seq")).first()[0] or 0) + 1 if fs.exists(p) else 1

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """Upsert id, vector, source, tags, text; rows of another dimension are returned, not stored."""
        dim, seq = self.config(name)["dim"], self._next(name)
        fits = F.coalesce(F.size("vector") == dim, F.lit(False))
        self._append(name, rows.where(fits).select("id", F.col("vector").cast("array<float>"), "source", "tags", "text", F.lit(False).alias("removed"), F.lit(seq).cast("long").alias("seq")))
        return rows.where(~fits)

    def insert_embedded(self, name: str, rows: DataFrame, embed: Callable[[Column], Column], most_bytes: int = 8000) -> DataFrame:
        """Upsert id, source, tags, text with the vectors that embed(text column) gives of the first most_bytes bytes."""
        return self.insert(name, rows.withColumn("vector", embed(T.clipped(F.coalesce("text", F.lit("")), most_bytes))))

    def bulk_load(self, name: str, path: str) -> None:
        """Parquet files with the columns of a point table become its points as they are, without checks of single rows."""
        if (found := self.spark.read.parquet(path).columns) != [f.split()[0] for f in POINTS.split(", ")]:
            raise InvalidArgument(f"columns {found}")
        self._append(name, self.spark.read.schema(POINTS).parquet(path))

    def save_sq8(self, name: str, params: DataFrame) -> None:
        """Quantisation parameters (pos, low, range) beside the points."""
        params.select("pos", "low", "range").coalesce(1).write.mode("overwrite").parquet(f"{self._path(name)}/sq8")

    def sq8(self, name: str) -> DataFrame:
        fs, p = self._fs(f"{self._path(name)}/sq8")
        if not fs.exists(p):
            raise NotFound(f"{name} has no quantisation parameters")
        return self.spark.read.schema("pos int, low double, range double").parquet(str(p))

    def remove(self, name: str, id_: int) -> None:
        if self.points(name).where(F.col("id") == id_).isEmpty():
            raise NotFound(str(id_))
        none = {"vector": "array<float>", "source": "string", "tags": "array<string>", "text": "string"}
        row = self.spark.createDataFrame([(id_,)], "id long").select("id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(True).alias("removed"), F.lit(self._next(name)).cast("long").alias("seq"))
        self._append(name, row)

    def info(self, name: str) -> dict:
        return self.config(name) | {"points": self.points(name).count()}

    def export(self, name: str, path: str) -> None:
        """id, vector and text as JSON lines."""
        self.points(name).select("id", "vector", "text").write.mode("overwrite").json(path)

    def compact(self, name: str) -> None:
        """Rewrite the table with the last versions only."""
        kept = settled(latest(self.versions(name), "id", "seq").where("NOT removed"), "compact")
        kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{self._path(name)}/points")


# ---------------------------------------------------------------- symbol edits: pure functions of lines
def edited(lines: Column, start: Column, stop: Column, new: Column) -> Column:
    """lines with start..stop (from 1, inclusive) replaced by `new`; stop = start - 1 inserts before start."""
    return F.concat(F.slice(lines, F.lit(1), start - 1), new, F.slice(lines, stop + 1, F.greatest(F.size(lines) - stop, F.lit(0))))


def insert_after(lines: Column, stop: Column, new: Column) -> Column:
    """After the symbol, with an empty line before the new body."""
    return edited(lines, stop + 1, stop, F.concat(F.array(F.lit("")), new))


def insert_before(lines: Column, start: Column, new: Column) -> Column:
    return edited(lines, start, start - 1, F.concat(new, F.array(F.lit(""))))


def grown_start(lines: list[str], start: int) -> int:
    """The first line of the comments, attributes and decorators directly above line `start` (from 1)."""
    while start > 1 and lines[start - 2].lstrip().startswith(("///", "//!", "#[", "@", "/**", "*", "*/", "#")):
        start -= 1
    return start


def history_appended(entries: DataFrame, symbol: str, action: Column, date: Column) -> DataFrame:
    """Decision records with an action appended to the history of one symbol's entry."""
    step = F.array(F.struct(date.alias("date"), action.alias("action")))
    return entries.withColumn("history", F.when(F.col("symbol") == symbol, F.concat("history", step)).otherwise(F.col("history")))


def related_entries(entries: DataFrame, symbol: str) -> DataFrame:
    return entries.where((F.col("symbol") == symbol) | F.array_contains("related", symbol))


ENTRY = (
    "symbol string, decision string, why string, constraints array<string>, rejected array<struct<approach:string,reason:string,condition:string>>, "
    "history array<struct<action:string,date:string,note:string,failure:string,fix:string,root_cause:string,resolved:boolean,commit:string>>, "
    "file_path string, line_range array<long>, related_symbols array<string>"
)


class Reasons:
    """Decision records by symbol: versions in one table, of which the last counts; a deleted symbol has a last version without content."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/reasons"

    def _versions(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"{ENTRY}, removed boolean, seq long"
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def list(self) -> DataFrame:
        """All records, by symbol."""
        return latest(self._versions(), "symbol", "seq").where("NOT removed").drop("removed", "seq").orderBy("symbol")

    def load(self, symbol: str) -> DataFrame:
        return self.list().where(F.col("symbol") == symbol)

    def at(self, file: str, line: int) -> DataFrame:
        """Records of the symbols at a place."""
        return self.list().where((F.col("file_path") == file) & (F.get("line_range", F.lit(0)) <= line) & (F.get("line_range", F.lit(1)) >= line))

    def _put(self, entries: DataFrame, removed: bool) -> None:
        seq = (self._versions().agg(F.max("seq")).first()[0] or 0) + 1
        columns = [f.split()[0] for f in ENTRY.split(", ")]
        self.spark.createDataFrame([], ENTRY).unionByName(entries.select(*columns)).withColumn("removed", F.lit(removed)).withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(self.path)

    def save(self, entries: DataFrame) -> None:
        """Records replace those of the same symbols."""
        self._put(entries, False)

    def delete(self, symbol: str) -> bool:
        found = settled(self.load(symbol), "reason")
        if found.isEmpty():
            return False
        self._put(found, True)
        return True


def _last_open(history: Column) -> Column:
    """Places (from 0) of unresolved failures; the last one is the one to settle."""
    opened = F.filter(F.transform(history, lambda x, i: F.when(x.failure.isNotNull() & ~F.coalesce(x.resolved, F.lit(False)), i)), lambda i: i.isNotNull())
    return F.array_max(opened)


def resolve_last_failure(entries: DataFrame, invalidated: str | None = None) -> DataFrame:
    """The last unresolved failure of each history is marked as resolved, or with a reason as invalid in its note too; settled tells whether there was one."""
    at = _last_open(F.col("history"))

    def mark(x: Column, i: Column) -> Column:
        done = x.withField("resolved", F.lit(True))
        if invalidated is not None:
            done = done.withField("note", F.concat_ws(" ", F.lit(f"[INVALIDATED: {invalidated}]"), x.note))
        return F.when(i == at, done).otherwise(x)

    return entries.withColumn("settled", at.isNotNull()).withColumn("history", F.when(F.col("settled"), F.transform("history", mark)).otherwise(F.col("history")))


Embedder = Callable[[Column], Column]
