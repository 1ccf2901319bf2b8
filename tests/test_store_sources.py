"""Stores, readers, the chunker, extractors and the stream."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from larkspur.errors import InvalidArgument, NotFound
from larkspur.operators import store as S
from larkspur.sources import readers as R
from larkspur.streaming import incremental as I

POINT = "id long, vector array<float>, source string, tags array<string>, text string"


def test_store(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    store.create("a", 2)
    for bad in (lambda: store.create("a", 2), lambda: store.create("b", 0), lambda: store.create("b", 2, m=1), lambda: store.create("b", 2, m=9, ef=3), lambda: store.create("../x", 2)):
        with pytest.raises(InvalidArgument):
            bad()
    rejected = store.insert("a", spark.createDataFrame([(1, [1.0, 2.0], "s", ["t"], "one"), (2, [1.0], "s", [], "two"), (3, None, "s", [], "x")], POINT))
    assert sorted(r.id for r in rejected.collect()) == [2, 3]
    store.insert("a", spark.createDataFrame([(1, [3.0, 4.0], "s", ["t"], "new"), (4, [0.0, 1.0], "u", None, None)], POINT))
    assert {r.id: r.text for r in store.points("a").collect()} == {1: "new", 4: None}
    assert [(r.dim, r.head) for r in S.get(store.points("a"), [1]).collect()] == [(2, [3.0, 4.0])]
    store.remove("a", 4)
    with pytest.raises(NotFound):
        store.remove("a", 4)
    store.compact("a")
    assert store.info("a") == {"dim": 2, "metric": "cosine", "m": 16, "ef": 200, "points": 1}
    store.export("a", str(tmp_path / "out"))
    good, bad = R.read_jsonl(spark, str(tmp_path / "out"))
    assert [(r.id, r.vector) for r in good.collect()] == [(1, [3.0, 4.0])] and bad.count() == 0
    store.rename("a", "b")
    assert store.list() == ["b"]
    store.delete("b")
    with pytest.raises(NotFound):
        store.config("b")


def test_deltas(spark):
    schema = "path string, mtime long, size long, content_hash string"
    old = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "h"), ("c", 1, 1, "h"), ("d", 1, 1, "h")], schema)
    now = spark.createDataFrame([("a", 1, 1, "h"), ("b", 2, 1, "h"), ("c", 2, 1, "i"), ("e", 1, 1, None)], schema)
    assert {r.path: r.state for r in S.file_delta(old, now).collect()} == {"a": "unchanged", "b": "hash-skipped", "c": "modified", "d": "deleted", "e": "new"}
    files, roots = spark.createDataFrame([("a/b/src/x.rs",), ("a/y.rs",), ("z.rs",)], "path string"), spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {r.path: r.root for r in S.changed_crates(files, roots).collect()} == {"a/b/src/x.rs": "a/b", "a/y.rs": "a"}
    stored = spark.createDataFrame([(1, "h", "t"), (2, "h", "t")], "id long, body_hash string, text string")
    new = spark.createDataFrame([(1, "h", "t"), (2, "i", "t"), (3, "h", "t")], "id long, body_hash string, text string")
    assert sorted(r.id for r in S.unchanged_records(stored, new).collect()) == [2, 3]
    value = spark.range(1).select(S.custom_value(F.lit(5), "i").alias("v")).first().v
    assert (value.i, value.s, value.l) == (5, None, None)


def test_edits(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "x array<string>")
    x, new = F.col("x"), F.array(F.lit("N"))
    call = lambda c: df.select(c.alias("y")).first().y
    assert call(S.edited(x, F.lit(2), F.lit(2), new)) == ["a", "N", "c"]
    assert call(S.edited(x, F.lit(1), F.lit(3), F.array().cast("array<string>"))) == []
    assert call(S.insert_after(x, F.lit(3), new)) == ["a", "b", "c", "", "N"]
    assert call(S.insert_before(x, F.lit(1), new)) == ["N", "", "a", "b", "c"]
    assert S.grown_start(["x", "/// doc", "#[test]", "fn f() {}"], 4) == 2
    entries = spark.createDataFrame([("s", ["r"], [("d", "a")]), ("t", ["s"], [])], "symbol string, related array<string>, history array<struct<date:string,action:string>>")
    assert [len(r.history) for r in S.history_appended(entries, "s", F.lit("x"), F.lit("y")).orderBy("symbol").collect()] == [2, 0]
    assert S.related_entries(entries, "s").count() == 2


def test_jsonl(spark, tmp_path):
    lines = [{"id": 1, "vector": [1.0], "text": "a", "tags": ["t"]}, {"text": "no id", "source": "s"}, {"id": 3, "text": ""}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{bad\n")
    good, bad = R.read_jsonl(spark, str(tmp_path))
    assert sorted((r.text, r.source == "s") for r in good.collect()) == [("a", False), ("no id", True)] and bad.count() == 2
    assert good.where("id IS NULL").count() == 0


def test_vector_files(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<I2f", 2, i, i + 1) for i in range(3)))
    (tmp_path / "b.bvecs").write_bytes(struct.pack("<I3B", 3, 1, 2, 255))
    assert [r.vector for r in R.open_reader(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()] == [[0, 1], [1, 2], [2, 3]]
    assert [r.vector for r in R.open_reader(spark, str(tmp_path / "b.bvecs")).collect()] == [[1, 2, 255]]
    for broken in (b"", b"abc", struct.pack("<I", 0), struct.pack("<If", 2, 1.0)):
        with pytest.raises(InvalidArgument):
            R.parse_vectors(broken, "fvecs")
    with pytest.raises(InvalidArgument):
        R.open_reader(spark, "x.csv")


def test_markdown(spark, tmp_path):
    head = '---\ntitle: "T: x"\ntags: [a, b, ]\ndate: 2024\n\nk: v:w\n---\n# One\n'
    got = spark.createDataFrame([(head,), ("no block",), ("---\nopen",)], "t string").select(R.frontmatter(F.col("t")).alias("f")).collect()
    assert got[0].f.title == "T: x" and got[0].f.tags == ["a", "b"] and got[0].f.date == "2024" and got[0].f.custom == {"k": "v:w"} and got[1].f is None and got[2].f is None
    body = "# A\n\n" + "x" * 120 + "\n\n## B\n\nshort\n\n# C\n\n```py\ncode # no\n```\n" + "y" * 200
    chunks = R.chunk_markdown(body)
    assert [c[1] for c in chunks] == [["A"], ["B\n\nshort\n\nC"]]
    assert "```\ncode # no\n\n```" in chunks[-1][0]
    # the end of a paragraph counts two bytes
    assert R.chunk_markdown("z" * 97) == [] and len(R.chunk_markdown("z" * 98)) == 1 and R.chunk_markdown("   ") == []
    long = R.chunk_markdown("\n\n".join(["p" * 400] * 6), target=1000, overlap=50)
    assert len(long) == 2 and long[1][0].startswith("p" * 48 + "\n\n") and long[0][3] - long[1][2] == 50
    assert not R.chunk_markdown("\n\n".join(["p" * 600] * 4), overlap=0)[1][0].startswith("\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "skip.md").write_text("x")
    (tmp_path / "a.md").write_text(head + "text " * 50)
    files = R.read_markdown(spark, str(tmp_path))
    assert files.count() == 1
    rows = R.markdown_chunks(files, "path", "text").collect()
    assert [(r.chunk_index, r.heading_path) for r in rows] == [(0, ["One"])]


def test_symbols(spark):
    text = (
        "[function] pub Foo::bar\nFile: ./src/a.rs:3-9\nSignature: fn bar()\nReturns: u8\nTypes: A, B\nCalls: x@4, y\nParams: p: &T, q: U<V, W>\nFields: f: G\nLocals: l: H\n"
        'Bindings: v=make\nFieldAccesses: self.x, p.y\nFlows: p→sink\nVariants: One, Two\nStrings: env::var("KEY")'
    )
    df = spark.createDataFrame([(1, text), (2, "no kind"), (3, "[impl] pub T for U<D>\nFile: b.rs"), (4, "[x] y"), (5, None)], "id long, text string")
    p = R.parse_symbols(df)
    got = {r.id: r for r in p.collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert (r.name, r.file, r.start_line, r.end_line, r.calls, r.call_lines, r.types, r.return_type) == ("Foo::bar", "src/a.rs", 3, 9, ["x", "y"], [4, 0], ["A", "B"], "u8")
    assert [tuple(x) for x in r.field_accesses] == [("self", "x"), ("p", "y")] and tuple(r.param_types[0]) == ("p", "&T") and tuple(r.string_args[0]) == ("env::var", "KEY") and tuple(r.param_flows[0]) == ("p", "sink")
    assert got[3].name == "T for U<D>" and got[3].start_line is None
    again = R.parse_symbols(p.select("id", R.render_symbols(p).alias("text"))).drop("text").collect()
    assert sorted(again) == sorted(p.drop("text").collect())


def test_extractors(spark, tmp_path):
    py = "class A:\n    def f(self, x):\n        return g(x).h()\n\ndef test_g(): pass\n"
    js = "export function go(a) {\n  if (a) { call(a.b()); }\n}\nconst arrow = (x) => { run(x) }\nclass K {\n}\n"
    df = spark.createDataFrame([("pkg/m.py", py), ("w.ts", js), ("bad.py", "def ("), ("n.rs", "fn x() {}"), ("e.py", None)], "path string, text string")
    chunks, edges = R.extract_symbols(df)
    got = {(r.name, r.kind, r.start_line, r.end_line, r.is_test) for r in chunks.collect()}
    assert got == {("pkg::m::A", "class", 1, 3, False), ("pkg::m::A::f", "function", 2, 3, False), ("pkg::m::test_g", "function", 5, 5, True), ("w::go", "function", 1, 3, False), ("w::arrow", "function", 4, 4, False), ("w::K", "class", 5, 6, False)}
    assert {("w::go", "call"), ("w::arrow", "run"), ("pkg::m::A::f", "g")} <= {(r.caller, r.callee) for r in edges.collect()}
    edges.write.json(str(tmp_path / "c"))
    assert R.read_edges(spark, str(tmp_path / "c")).count() == 0  # other file names


def test_coverage_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"files": [{"filename": "a.rs", "summary": {"functions": {"count": 4, "covered": 3}}}]}]}))
    assert [tuple(r) for r in R.read_coverage(spark, str(tmp_path)).collect()] == [("a.rs", 3, 4)]


def test_stream_takes_each_file_once(spark, tmp_path):
    schema = "k long, v long, seq long"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: I.replay(spark, str(tmp_path / "in"), schema, str(tmp_path / "sink"), str(tmp_path / "state"), "k", ("seq",)).awaitTermination()
    add([(1, 1, 1), (1, 2, 2), (2, 1, 1)])
    go()
    add([(2, 9, 3)])
    go()
    go()
    assert {r.k: r.v for r in I.current(spark, str(tmp_path / "sink"), "k", ("seq",)).collect()} == {1: 2, 2: 9}
    p = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, term string")
    new = I.updated_postings(p, p.where("doc_id = 1"), spark.createDataFrame([(2, "c")], p.schema))
    assert [tuple(r) for r in new.collect()] == [(2, "c")]


# ---------------------------------------------------------------- records, dictionaries, small formats
def test_reasons(spark, tmp_path):
    s = S.Reasons(spark, str(tmp_path))
    step = lambda f, done=False: ("modify", "2024-01-01", "was" if f == "b" else None, f, None, None, done, None)
    rows = [("x::y", "d", "w", ["c"], [("a", "r", None)], [step("a"), step("b"), step("c", True), step(None)], "f.rs", [3, 9], ["z"]), ("z", None, None, None, None, [step(None)], None, None, None)]
    entries = spark.createDataFrame(rows, S.ENTRY)
    assert s.list().count() == 0 and s.delete("x::y") is False
    s.save(entries)
    s.save(entries.where("symbol = 'z'").withColumn("why", F.lit("new")))
    assert [(r.symbol, r.why) for r in s.list().collect()] == [("x::y", "w"), ("z", "new")]
    assert [r.symbol for r in s.at("f.rs", 9).collect()] == ["x::y"] and s.at("f.rs", 10).count() == 0
    marked = {r.symbol: r for r in S.resolve_last_failure(s.list(), "wrong").collect()}
    assert marked["x::y"].settled and not marked["z"].settled
    assert [(h.failure, h.resolved, h.note) for h in marked["x::y"].history] == [("a", False, None), ("b", True, "[INVALIDATED: wrong] was"), ("c", True, None), (None, False, None)]
    assert s.delete("x::y") and [r.symbol for r in s.list().collect()] == ["z"] and s.load("x::y").count() == 0


def test_dictionary_errors(spark):
    from larkspur.functions import text as T

    lines = spark.createDataFrame([("a,b,c,d",)], "l string")
    with pytest.raises(Exception, match="bad dictionary entry"):
        lines.select(T.dictionary_entry(F.col("l"))).collect()


@pytest.mark.parametrize("text", ["", "abc", "é" * 9, "aé" * 7, "日本語テキスト", "a😀b😀c", "�x�y"])
def test_clipped_at_every_length(spark, text):
    from larkspur.functions import text as T

    df = spark.createDataFrame([(text,)], "t string")
    for most in range(1, 12):
        want, size = "", 0
        for c in text:
            size += len(c.encode())
            if size > most:
                break
            want += c
        r = df.select(T.clipped(F.col("t"), most).alias("c"), T.truncated(F.col("t"), most).alias("d")).first()
        assert (r.c, r.d) == (want, text if len(text.encode()) <= most else want + "...")


def test_xorshift_and_levels(spark):
    from larkspur.functions import formats as M

    def slow(x):
        mask = (1 << 64) - 1
        x = x or 1
        x ^= x << 13 & mask
        x ^= x >> 7
        return x ^ (x << 17 & mask)

    for state in (0, 1, 42, 2**63 - 1, -5):
        got = spark.range(1).select(M.xorshift(F.lit(state).cast("long")).alias("x")).first().x
        assert got & (2**64 - 1) == slow(state & (2**64 - 1))
    u = spark.createDataFrame([(1.0,), (0.06,), (1e-300,)], "u double")
    assert [r.x for r in u.select(M.level(F.col("u")).alias("x")).collect()] == [0, 1, 249]


def test_offset_tokens_are_places_in_bytes(spark):
    from larkspur.functions import text as T

    df = spark.createDataFrame([(1, " Ab  é日 x\t"), (2, None), (3, "")], "id long, t string")
    raw = " ab  é日 x\t".encode()
    got = T.offset_tokens(df, "id", "t").collect()
    assert [(r.id, r.pos, r.token) for r in got] == [(1, 0, "ab"), (1, 1, "é日"), (1, 2, "x")]
    assert all(raw[r.start : r.end].decode() == r.token for r in got)


def test_embedded_store_and_protocols(spark, tmp_path):
    from larkspur import protocols
    from larkspur.sources import readers

    s = S.Store(spark, str(tmp_path))
    assert isinstance(s, protocols.VectorStore) and isinstance(readers.open_reader, protocols.VectorReader)
    s.create("a", 2)
    with pytest.raises(Exception, match="quantisation"):
        s.sq8("a")
    rows = spark.createDataFrame([(1, "s", ["t"], "é" * 5000), (2, "s", ["t"], None)], "id long, source string, tags array<string>, text string")
    s.insert_embedded("a", rows, lambda t: F.array(F.octet_length(t).cast("double"), F.lit(1.0)))
    assert {r.id: list(r.vector) for r in s.points("a").collect()} == {1: [8000.0, 1.0], 2: [0.0, 1.0]}
    spark.range(1).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        s.bulk_load("a", f"{tmp_path}/bad")


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from larkspur.checkpoints import shared_folder

    none = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: none, master=master), conf=none)
        with pytest.raises(RuntimeError):
            shared_folder(session)
