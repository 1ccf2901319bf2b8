"""Readers: JSON lines, fvecs and bvecs, markdown folders, symbol and edge files, coverage."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.errors import InvalidArgument
from larkspur.functions.text import content_key

RECORD = "id long, vector array<float>, text string, source string, tags array<string>, title string"
SKIPPED_FOLDERS = ("node_modules", "target", "__pycache__", "venv", ".venv", "dist", "build", ".git", ".svn", ".hg", ".idea", ".vscode", ".cache", ".obsidian")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): blank lines are skipped, bad lines and lines without id, text or vector are rejects.

    A missing id becomes a hash of file and line.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", RECORD + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    usable = F.col("r").isNotNull() & F.col("r._corrupt").isNull() & ((F.coalesce(F.col("r.text"), F.lit("")) != "") | F.col("r.vector").isNotNull())
    good = parsed.where(usable).select(
        F.coalesce("r.id", content_key(F.col("file"), F.col("value"))).alias("id"), "r.vector", "r.text", F.coalesce("r.source", "file").alias("source"), F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"), "r.title",
    )
    return good, parsed.where(~usable).select("value", "file")


def parse_vectors(data: bytes, kind: str) -> np.ndarray:
    """The rows of an fvecs (float32) or bvecs (uint8) file."""
    if len(data) < 4:
        raise InvalidArgument("vector file under four bytes")
    dim = int.from_bytes(data[:4], "little")
    each = 4 + dim * (4 if kind == "fvecs" else 1)
    if dim == 0 or len(data) % each:
        raise InvalidArgument("size is no multiple of the record")
    raw = np.frombuffer(data, np.uint8).reshape(-1, each)
    if (raw[:, :4] != raw[0, :4]).any():
        raise InvalidArgument("records of different dimensions")
    body = raw[:, 4:]
    return np.ascontiguousarray(body).view("<f4") if kind == "fvecs" else body.astype(np.float32)


def read_vecs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """source, id (place in the file) and vector of binary vector files; a file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = parse_vectors(content, kind)
                for at in range(0, len(x), 8192):
                    part = x[at : at + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float32()))], ["source", "id", "vector"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "source string, id long, vector array<float>")


def open_reader(spark: SparkSession, path: str) -> DataFrame:
    """By extension: jsonl, ndjson, fvecs, bvecs, parquet, md, markdown."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "ndjson"):
        return read_jsonl(spark, path)[0]
    if kind in ("fvecs", "bvecs"):
        return read_vecs(spark, path, kind)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("md", "markdown"):
        return read_markdown(spark, path)
    raise InvalidArgument(f"no reader for .{kind}")


def input_kind(spark: SparkSession, path: str) -> str:
    """markdown, jsonl, vectors or parquet of a path; a folder is judged by what it holds, up to five levels down."""
    kinds = {"md": "markdown", "markdown": "markdown", "jsonl": "jsonl", "ndjson": "jsonl", "fvecs": "vectors", "bvecs": "vectors", "parquet": "parquet"}
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise InvalidArgument(f"{path} does not exist")
    level = [fs.getFileStatus(p)]
    for _ in range(6):
        below = []
        for status in level:
            if status.isDirectory():
                below += list(fs.listStatus(status.getPath()))
            elif (found := kinds.get(status.getPath().getName().rsplit(".", 1)[-1].lower())) is not None:
                return found
        level = below
    raise InvalidArgument(f"nothing readable in {path}")


# ---------------------------------------------------------------- markdown
def read_markdown(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, text, mtime and size of markdown files, usual tool folders left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not path.endswith((".md", ".markdown")):
        reader = reader.option("pathGlobFilter", "*.{md,markdown}")
    skip = "|".join(re.escape(x) for x in SKIPPED_FOLDERS + exclude)
    return reader.load(path).where(~F.col("path").rlike(rf"/({skip}|\.larkspur[^/]*)/")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))


def frontmatter(text: Column) -> Column:
    """title, date, tags and custom of a leading --- block; null without one."""
    block = F.regexp_extract(text, r"(?s)\A---(.*?)\n---", 1)
    has = text.rlike(r"(?s)\A---.*?\n---")
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = lambda name: F.get(F.filter(pairs, lambda p: p.key == name), F.greatest(F.size(F.filter(pairs, lambda p: p.key == name)) - 1, F.lit(0))).value
    tags = F.filter(F.transform(F.split(F.regexp_replace(last("tags"), r"^[\[\]]+|[\[\]]+$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    custom = F.map_from_entries(F.filter(pairs, lambda p: ~p.key.isin("title", "date", "tags")))
    return F.when(has, F.struct(F.regexp_replace(last("title"), r'^"+|"+$', "").alias("title"), last("date").alias("date"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), custom.alias("custom")))


_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def markdown_events(text: str) -> Iterator[tuple[str, object]]:
    """("heading", (level, text)), ("code", text) and ("paragraph", text) of a markdown body, in order."""
    lines, i, para = text.split("\n"), 0, []

    def flush() -> Iterator[tuple[str, object]]:
        if para:
            yield "paragraph", "\n".join(x.strip() for x in para)
            para.clear()

    while i < len(lines):
        line = lines[i]
        fence, head = _FENCE.match(line), _HEADING.match(line)
        if fence:
            yield from flush()
            body, mark = [], fence.group(1)
            i += 1
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                body.append(lines[i])
                i += 1
            yield "code", "".join(x + "\n" for x in body)
        elif head:
            yield from flush()
            yield "heading", (len(head.group(1)), (head.group(2) or "").strip())
        elif not line.strip():
            yield from flush()
        else:
            para.append(line)
        i += 1
    yield from flush()


def chunk_markdown(text: str, target: int = 1000, overlap: int = 200, least: int = 100, headings: bool = True) -> list[tuple[str, list[str], int, int]]:
    """(text, heading path, start, end) of the chunks.

    A section is closed at the next heading and, once it has `target` bytes, after a paragraph, whose
    last `overlap` characters begin the next chunk. A section of less than `least` bytes is not closed
    by a heading: it becomes part of the next heading's text. A short rest at the end is dropped.
    """
    if text.startswith("---") and (end := text.find("\n---", 3)) >= 0:
        text = text[end + 4 :]
    size = lambda s: len(s.encode())
    out: list[tuple[str, list[str], int, int]] = []
    now, path, at, start = "", [], 0, 0
    for kind, value in markdown_events(text):
        if kind == "heading":
            level, title = value
            if now and size(now) >= least:
                out.append((now, list(path), start, at))
                now, start = "", at
            del path[level - 1 :]
            at += size(title)
            title = (now + title).strip()
            path.append(title)
            now = f"{title}\n\n" if headings and title else ""
        elif kind == "code":
            at += size(value)
            now += f"```\n{value}\n```\n"
        else:
            if now and not now.endswith("\n"):
                now += "\n"
            now += value + "\n\n"
            at += size(value) + 2
            if size(now) >= target:
                out.append((now, list(path), start, at))
                now = now[-overlap:] if overlap > 0 else ""
                start = at - size(now)
    if now and size(now) >= least:
        out.append((now, list(path), start, at))
    return out


def markdown_chunks(df: DataFrame, key: str, text: str, **config) -> DataFrame:
    """key, chunk_index, text, heading_path, start_offset and end_offset of every chunk of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, *c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(chunk_markdown(t or "", **config))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, "chunk_index", "text", "heading_path", "start_offset", "end_offset"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_index int, text string, heading_path array<string>, start_offset long, end_offset long")


# ---------------------------------------------------------------- code
EDGES = "caller string, caller_file string, caller_kind string, callee string, callee_file string, callee_start_line int, line int, is_local boolean"
CHUNKS = "name string, file string, kind string, start_line int, end_line int, signature string, visibility string, is_test boolean"


def read_edges(spark: SparkSession, folder: str, crate: str | None = None, pattern: str = "*.edges.jsonl") -> DataFrame:
    """Call edges with their crate: the name of the file before .edges.jsonl, or of the folder crate=<name> it is in."""
    rows = spark.read.schema(EDGES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(folder)
    name = F.input_file_name()
    named, filed = F.regexp_extract(name, r"([^/]+)\.edges\.jsonl$", 1), F.regexp_extract(name, r"/crate=([^/]+)/[^/]*$", 1)
    rows = rows.withColumn("crate", F.when(named != "", named).otherwise(filed))
    return rows.where(F.col("crate") == crate) if crate else rows


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNKS).option("pathGlobFilter", "*.chunks.jsonl").json(folder)


def read_coverage(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """filename, covered and total functions of coverage exports, one a file, or one a line."""
    schema = "data array<struct<files:array<struct<filename:string,summary:struct<functions:struct<count:long,covered:long>>>>>>"
    files = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path).select(F.explode("data").alias("d")).select(F.explode("d.files").alias("f"))
    return files.select("f.filename", F.col("f.summary.functions.covered").alias("covered"), F.col("f.summary.functions.count").alias("total"))


def _pairs(body: Column, mark: str) -> Column:
    good = F.filter(F.transform(F.split(body, ", "), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(mark)))
    n = len(mark)
    return F.transform(good, lambda x: F.struct(F.substring_index(x, mark, 1).alias("a"), F.substr(x, F.instr(x, mark) + n).alias("b")))


def parse_symbols(df: DataFrame, text: str = "text") -> DataFrame:
    """Symbols from their rendered text: "[kind] vis name" and labelled lines; other texts are left out."""
    t = F.col(text)
    line = lambda label: F.regexp_extract(t, rf"(?m)^{label}: (.*)$", 1)
    items = lambda label: F.filter(F.transform(F.split(line(label), ", "), lambda x: F.trim(x)), lambda x: x != "")
    calls = items("Calls")
    place = F.regexp_extract(line("File"), r"^(.*):(\d+)-(\d+)\s*$", 1)
    number = lambda g: F.regexp_extract(line("File"), r"^(.*):(\d+)-(\d+)\s*$", g).try_cast("int")
    none = lambda c: F.when(c != "", c)
    rest = F.trim(F.regexp_extract(t, r"\A\[[^\]]*\](.*)", 1))
    kind = F.regexp_extract(t, r"\A\[([^\]]*)\]", 1)
    name = F.when(kind.isin("impl", "trait"), F.regexp_replace(rest, r"^(pub\(crate\) |pub )", "")).otherwise(F.regexp_replace(rest, r"^(pub\(crate\) |pub |export )", ""))
    out = df.where(t.rlike(r"\A\[[^\]]*\]") & (line("File") != "")).select(
        *df.columns, kind.alias("kind"), name.alias("name"), F.regexp_replace(F.regexp_replace(F.when(place != "", place).otherwise(F.trim(line("File"))), r"\\", "/"), r"^\./", "").alias("file"), number(2).alias("start_line"), number(3).alias("end_line"),
        none(F.trim(line("Signature"))).alias("signature"), none(F.trim(line("Returns"))).alias("return_type"),
        F.transform(calls, lambda x: F.regexp_replace(x, r"@\d+$", "")).alias("calls"), F.transform(calls, lambda x: F.coalesce(F.regexp_extract(x, r"@(\d+)$", 1).try_cast("int"), F.lit(0))).alias("call_lines"),
        items("Types").alias("types"), items("Variants").alias("enum_variants"), _pairs(line("Params"), ": ").alias("param_types"), _pairs(line("Fields"), ": ").alias("field_types"), _pairs(line("Locals"), ": ").alias("local_types"),
        _pairs(line("Bindings"), "=").alias("let_call_bindings"), _pairs(line("FieldAccesses"), ".").alias("field_accesses"), _pairs(line("Flows"), "→").alias("param_flows"),
        F.transform(F.filter(items("Strings"), lambda x: x.rlike(r"^[^(]*\(.*\)")), lambda x: F.struct(F.substring_index(x, "(", 1).alias("a"), F.regexp_replace(F.regexp_extract(x, r"^[^(]*\((.*)\)", 1), r'^"+|"+$', "").alias("b"))).alias("string_args"),
    )
    return out


def render_symbols(df: DataFrame) -> Column:
    """The inverse of parse_symbols, for its columns."""
    pairs = lambda c, mark: F.array_join(F.transform(c, lambda p: F.concat(p.a, F.lit(mark), p.b)), ", ")
    listed = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    calls = F.array_join(F.zip_with("calls", "call_lines", lambda n, at: F.when(at > 0, F.concat(n, F.lit("@"), at.cast("string"))).otherwise(n)), ", ")
    where = F.when(F.col("start_line").isNotNull(), F.concat(F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))).otherwise("")
    return F.concat_ws(
        "\n", F.concat(F.lit("["), "kind", F.lit("] "), "name"), F.concat(F.lit("File: "), "file", where), listed("Signature", F.col("signature")), listed("Returns", F.col("return_type")), listed("Types", F.array_join("types", ", ")), listed("Calls", calls),
        listed("Params", pairs("param_types", ": ")), listed("Fields", pairs("field_types", ": ")), listed("Locals", pairs("local_types", ": ")), listed("Bindings", pairs("let_call_bindings", "=")),
        listed("FieldAccesses", pairs("field_accesses", ".")), listed("Flows", pairs("param_flows", "→")), listed("Variants", F.array_join("enum_variants", ", ")),
        listed("Strings", F.array_join(F.transform("string_args", lambda p: F.concat(p.a, F.lit('("'), p.b, F.lit('")'))), ", ")),
    )


def python_symbols(content: str, file: str) -> tuple[list[tuple], list[tuple]]:
    """(name, file, kind, start, end, signature, visibility, is_test) and (caller, file, kind, callee, line) of a Python file."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return [], []
    module = re.sub(r"\.py$", "", file).strip("/").replace("/", "::")
    chunks: list[tuple] = []
    edges: list[tuple] = []

    def walk(node: ast.AST, prefix: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}::{x.name}"
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                sig = f"class {x.name}" if kind == "class" else f"def {x.name}({ast.unparse(x.args)})"
                chunks.append((name, file, kind, x.lineno, x.end_lineno, sig, "private" if x.name.startswith("_") else "pub", x.name.startswith("test") or "/test" in file))
                if kind == "function":
                    edges.extend((name, file, kind, ast.unparse(c.func), c.lineno) for c in ast.walk(x) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute)))
                walk(x, name)
            else:
                walk(x, prefix)

    walk(tree, module)
    return chunks, edges


_JS = re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*(\w+)|class\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)")
_JS_CALL = re.compile(r"(?<![\w.])([A-Za-z_$][\w$.]*)\s*\(")


def script_symbols(content: str, file: str) -> tuple[list[tuple], list[tuple]]:
    """The same of a JavaScript or TypeScript file, by patterns and the depth of braces."""
    module = re.sub(r"\.\w+$", "", file).strip("/").replace("/", "::")
    lines = content.split("\n")
    chunks: list[tuple] = []
    edges: list[tuple] = []
    for i, line in enumerate(lines):
        m = _JS.search(line)
        if not m or line.lstrip().startswith("//"):
            continue
        depth, end = 0, i
        for j in range(i, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            end = j
            if depth <= 0 and (j > i or "}" in lines[j] or "{" not in lines[j]):
                break
        kind, name = ("class", m.group(2)) if m.group(2) else ("function", m.group(1) or m.group(3))
        full = f"{module}::{name}"
        chunks.append((full, file, kind, i + 1, end + 1, line.strip().rstrip("{").strip(), "pub" if "export" in line else "private", bool(re.search(r"(\.|_)(test|spec)\.", file))))
        if kind == "function":
            for j in range(i, end + 1):
                body = lines[j][m.end() :] if j == i else lines[j]
                edges += [(full, file, kind, c.group(1), j + 1) for c in _JS_CALL.finditer(body) if c.group(1) not in ("if", "for", "while", "switch", "catch", "return", "function")]
    return chunks, edges


def extract_symbols(df: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunks, edges) of source files (Python, JavaScript, TypeScript) in the columns of CHUNKS and of EDGES."""

    def run_with(which: int, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = python_symbols(t or "", p) if p.endswith(".py") else script_symbols(t or "", p) if p.endswith((".js", ".ts", ".jsx", ".tsx")) else ([], [])
                    rows += found[which]
                kinds = {int: pa.int32(), str: pa.string(), bool: pa.bool_()}
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                types = [kinds[int] if n.endswith("line") else kinds[bool] if n == "is_test" else kinds[str] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        return run

    src = df.select(path, text)
    chunks = src.mapInArrow(run_with(0, ["name", "file", "kind", "start_line", "end_line", "signature", "visibility", "is_test"]), CHUNKS)
    edges = src.mapInArrow(run_with(1, ["caller", "caller_file", "caller_kind", "callee", "line"]), "caller string, caller_file string, caller_kind string, callee string, line int")
    none = lambda t: F.lit(None).cast(t)
    return chunks, edges.select("caller", "caller_file", "caller_kind", "callee", none("string").alias("callee_file"), none("int").alias("callee_start_line"), "line", F.lit(False).alias("is_local"))

