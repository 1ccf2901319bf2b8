"""Media, WARC, packing, piece sampling, sharding and the classifiers on small fixtures."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from larkspur.llm import media, packing, pieces, quality, sharding, toxicity, warc
from larkspur.llm.common import text_buffer

TEXTS = [None, "", " ", "a", "héllo wörld", "x" * 575, "x" * 576, "x" * 577, "tie", "tie", "long " * 5000, "a\n\nb  c\t", "<|endoftext|> in text", "日本語 😀"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(3, "a", "clash", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, feature string, length int")


# ---------------------------------------------------------------- media
@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (4, 3, 3), (9, 2, 3)])
def test_image_formats_round_trip(shape):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_netpbm(x)) == x).all()
    assert (media.decode(media.encode_bmp(x)) == x).all()


def test_netpbm_variants():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n255\n7 250\n").tolist() == [[7, 250]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(media.encode_netpbm(np.array([[300, 2]], np.uint16))).tolist() == [[300, 2]]
    assert media.decode(b"P2 2 1 3 3 1").tolist() == [[255, 85]] and media.decode(b"P5 2 1 1000\n" + bytes([3, 232, 0, 0])).tolist() == [[65535, 0]]
    for bad in (b"P2 1 1 255 99999999999999999999", b"P2 1 1 255 300", b"P2 1 1 255 -1", b"P2 1 1 255 x", b"P5 1 1 9\n\x0a", b"P5 99999999999999999999 1 255\n", b"P2 1 1 99999999999999999999 1", b"", b"P5\n2 2\n255\nab", b"P9 1 1", b"P5\n-1 2\n255\n", b"BM123"):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)


@pytest.mark.parametrize(("h", "w", "m", "n"), [(7, 5, 3, 2), (2, 3, 8, 9), (1, 1, 4, 4), (40, 24, 16, 16)])
def test_area_resize_is_the_mean_over_areas(h, w, m, n):
    x = np.random.default_rng(h).integers(0, 256, (h, w)).astype(np.uint8)
    fine = np.repeat(np.repeat(x.astype(float), m, 0), n, 1)  # every target cell is whole on the fine grid
    want = fine.reshape(m, h, n, w).mean((1, 3))
    for rows in (1, 3, 1024):
        assert np.allclose(media.area_resize(x, m, n, rows), want)


def test_text_media(docs):
    got = media.text_media(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert media.decode(media.store(payload)).tobytes() == payload
        assert r.media_sha256 == hashlib.sha256(media.store(payload)).hexdigest() and len(r.feature) == 16
        assert np.load(io.BytesIO(bytes(r.tile))).shape[:2] == (media.TILE, media.TILE)


def test_bmp_masks_and_palettes():
    import struct

    def bmp(bits, packed, raster, masks=b"", w=2, h=1, colours=0):
        at = 54 + len(masks)
        return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + len(raster), 0, 0, at, 40, w, h, 1, bits, packed, len(raster), 0, 0, colours, 0) + masks + raster

    assert media.decode(bmp(16, 0, struct.pack("<HH", 0x7C00, 0x001F))).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    rgb565 = struct.pack("<III", 0xF800, 0x07E0, 0x001F)
    assert media.decode(bmp(16, 3, struct.pack("<HH", 0x07E0, 0xFFFF), rgb565)).tolist() == [[[0, 255, 0], [255, 255, 255]]]
    other = struct.pack("<III", 0x000000FF, 0x0000FF00, 0x00FF0000)
    assert media.decode(bmp(32, 3, bytes([1, 2, 3, 0, 4, 5, 6, 0]), other)).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    for bad in (bmp(32, 3, bytes(8), bytes(12)), bmp(24, 3, bytes(8)), bmp(8, 0, bytes(4), colours=1 << 30), bmp(32, 3, bytes(8), struct.pack("<III", 5, 2, 1))):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)


def test_sixteen_bits_make_a_tile_like_eight():
    x = np.arange(64, dtype=np.uint8).reshape(8, 8) * 4
    wide = x.astype(np.uint16) * 257
    assert media.npy_tile(wide, 4) == media.npy_tile(x, 4) and media.difference_hash(wide) == media.difference_hash(x)


def test_media_query_digests(spark, tmp_path):
    """The query's own columns, each recomputed: the stored form, the hash of the resized image and the tile."""
    from larkspur.llm import queries

    texts = [None, "", "abc", "z" * 700, "é" * 900, "abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op1_media(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = np.frombuffer(raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576)), np.uint8)
        blocks = len(payload) // 576
        image = payload.reshape((24 * blocks, 24) if blocks % 3 == 1 else (8 * blocks, 24, 3))
        stored = media.encode_bmp(image) if blocks % 3 == 0 else b"P%d\n24 %d\n255\n" % (5 if blocks % 3 == 1 else 6, len(image)) + payload.tobytes()
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        plane = image.astype(float) if image.ndim == 2 else image.astype(float) @ [0.299, 0.587, 0.114]

        def cells(m, n, x):
            fine = np.repeat(np.repeat(x, m, 0), n, 1)
            return fine.reshape(m, len(x), n, x.shape[1]).mean((1, 3))

        small = np.round(cells(8, 9, plane), 6)
        assert r.feature == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
        planes = [cells(16, 16, c) for c in (np.moveaxis(image.astype(float), 2, 0) if image.ndim == 3 else [image.astype(float)])]
        tile = np.rint(np.round(np.stack(planes, 2) if image.ndim == 3 else planes[0], 9)).astype(np.uint8)
        out = io.BytesIO()
        np.save(out, tile)
        assert r.tile_sha256 == hashlib.sha256(out.getvalue()).hexdigest()


def test_media_features_of_bad_images(spark):
    good = media.encode_bmp(np.zeros((4, 4, 3), np.uint8))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (3, bytearray(b"")), (4, bytearray(b"P2 1 1 255 99999999999999999999"))], "id long, image binary")
    got = media.media_features(df, "image", "id").collect()
    assert [(r.width, r.error is None, r.tile is None) for r in got] == [(4, True, False), (None, True, True), (None, False, True), (None, False, True), (None, False, True)]


# ---------------------------------------------------------------- WARC
def test_warc_links_and_round_trip(spark, tmp_path):
    html = "<head><title> A &amp; B </title><style>p{}</style></head><p>Hi&nbsp;<b>you</b><br>1 &lt; 2<!-- x --><script>var a='</p>'</script><a href='u'>l</a>"
    pages = spark.createDataFrame([(1, "http://a/", html, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, block string")
    responses = warc.responses(pages)
    rows = warc.record_bytes(warc.derive(responses)).collect()
    assert len(rows) == 6
    ids = {r.record_id for r in responses.collect()}
    for r in rows:
        assert r.refers_to in ids and r.record_id not in ids
        (headers, block), = warc.parse(bytes(r.warc))
        assert block == r.block.encode() and headers["warc-refers-to"] == r.refers_to and headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert int(headers["content-length"]) == r.content_length
    text = next(r for r in rows if r.source_id == 1 and r.record_type == "conversion")
    assert text.block == "Hi you\n1 < 2 l" and text.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    meta = next(r for r in rows if r.source_id == 1 and r.record_type == "metadata").block
    assert "title: A & B\r\n" in meta and "outlinks: 1\r\n" in meta and "Content-Type: text/html" in meta
    body = (warc.HEADERS + "\r\n" + html).encode()
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: d\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    back = warc.read_responses(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.payload, r.http_headers) for r in back] == [("<urn:uuid:1>", html, warc.HEADERS)] * 2


def _record(body: bytes, http: str = "", kind: str = "response", extra: str = "", length: str | None = None, version: str = "1.1") -> bytes:
    block = ("HTTP/1.1 200 OK\r\n" + http).encode() + b"\r\n" + body
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <r>\r\n{extra}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_warc_digests_are_those_of_the_bytes(spark, tmp_path):
    import gzip

    latin = "<p>caf\xe9</p>".encode("latin-1")
    records = [
        _record(latin, "Content-Type: text/html; charset=iso-8859-1\r\n", extra="WARC-Payload-Digest: sha1:ABC\r\n"),
        _record(b'<meta charset="latin-1">' + latin), _record(b"\xff\xfe bad"), _record(b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n", "Transfer-Encoding: chunked\r\n"),
        _record(gzip.compress(b"zipped"), "Content-Encoding: gzip\r\n"), _record(b"not zipped", "Content-Encoding: gzip\r\n", version="1.0"), _record(b"x", kind="request"), _record(b"", "X: 1\r\n"),
    ]
    bodies = [latin, b'<meta charset="latin-1">' + latin, b"\xff\xfe bad", b"abcde", gzip.compress(b"zipped"), b"not zipped", b""]
    texts = ["<p>caf\xe9</p>", '<meta charset="latin-1"><p>caf\xe9</p>', "\ufffd\ufffd bad", "abcde", "zipped", "not zipped", ""]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "empty.warc").write_bytes(b"")
    for name, times in (("a.warc", 1), ("b.warc.gz", 1), ("", 2)):
        responses = warc.read_responses(spark, f"{tmp_path}/{name}")
        rows = responses.collect()
        want = [(t, "sha256:" + hashlib.sha256(b).hexdigest()) for t, b in zip(texts, bodies)]
        assert Counter((r.payload, r.payload_digest) for r in rows) == Counter(want * times)
        assert Counter(r.declared_digest for r in rows) == {"sha1:ABC": times, None: 6 * times}
    derived = warc.record_bytes(warc.derive(warc.read_responses(spark, f"{tmp_path}/a.warc"))).where("record_type = 'conversion' AND declared_digest IS NOT NULL").collect()
    assert len(derived) == 1 and derived[0].block == "caf\xe9" and derived[0].source_payload_digest == "sha256:" + hashlib.sha256(latin).hexdigest()
    (headers, _), = warc.parse(bytes(derived[0].warc))
    assert headers["warc-source-declared-digest"] == "sha1:ABC" and headers["warc-refers-to"] == "<r>"


def test_warc_files_that_do_not_tally(spark, tmp_path):
    """A record within a record, a wrong and a missing length, and a file that ends early."""
    inner = _record(b"inner")
    (tmp_path / "nested.warc").write_bytes(_record(b"start\r\n\r\n" + inner + b"end") + _record(b"after"))
    (tmp_path / "odd.warc").write_bytes(_record(b"lost", length="x") + _record(b"kept") + _record(b"cut off", length="999"))
    (tmp_path / "good.warc").write_bytes(_record(b"good"))
    (tmp_path / "junk.warc").write_bytes(b"nothing of the kind")
    got = Counter(r.payload for r in warc.read_responses(spark, str(tmp_path)).collect())
    assert got == Counter(["start\r\n\r\n" + inner.decode() + "end", "after", "kept", "cut off\r\n\r\n", "good"])


# ---------------------------------------------------------------- packing
def test_packing_places_every_piece_once(docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for i, t in [*enumerate(TEXTS), (3, "a")]:
        ids = [*file.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for p, (s, e) in enumerate([(0, first), *((k, k + 2048) for k in range(first, len(ids), 2048))]):
            want[i, p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_uses_each_length_as_often_as_it_occurs(histogram):
    plan = packing.plan(histogram, 64)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == Counter(histogram)
    gaps: list[int] = []
    for n in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fit = min((i for i, g in enumerate(gaps) if g >= n), key=lambda i: gaps[i], default=None)
        if fit is None:
            gaps.append(64 - n)
        else:
            gaps[fit] -= n
    assert sum(t for _, t in plan) <= len(gaps)  # never more than best fit by single pieces


@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), max_size=9), st.lists(st.tuples(st.integers(1, 24), st.integers(1, 24)), max_size=12), st.booleans())
@settings(max_examples=150, deadline=None)
def test_complements_against_all_combinations(histogram, asked, balanced):
    """The index finds a filling of one, two or three lengths exactly where there is one, while counts fall."""
    counts = np.zeros(25, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    index = packing.Complements(counts, balanced)
    for gap, anchor in asked:
        if counts[anchor] == 0:
            continue
        stock = [n for n, c in enumerate(counts.tolist()) for _ in range(c)]
        stock.remove(anchor)
        fewest = next((k for k in (1, 2, 3) if any(sum(x) == gap for x in combinations(stock, k))), None)
        found = index.filling(gap, anchor)
        assert (None if found is None else len(found)) == fewest
        if found:
            assert sum(found) == gap and not Counter(found) - Counter(stock)
            for n in (*found, anchor):
                counts[n] -= 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- pieces
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=150, deadline=None)
def test_pieces_decode_to_the_text(text):
    lattice = pieces.lattices(None, 1.0)
    assert lattice.decode(lattice.sample([text], np.array([7], np.uint64))[0]) == text


def all_segmentations(lattice, text):
    """Every segmentation of a whole text with its weight: all vocabulary pieces at all places, bytes for other characters."""
    weight = {lattice.names[i]: math.exp(w) for _, ids, ws in lattice.tables for i, w in zip(ids.tolist(), ws.tolist()) if i >= 0}
    number = {n: i for i, n in lattice.names.items()}
    spelt = [("\0" if c == "▁" else "▁" if c == " " else c) for c in " " + text]

    def ways(at):
        if at == len(spelt):
            yield (), 1.0
            return
        steps = [((number[p],), at + k, weight[p]) for k in range(1, len(spelt) - at + 1) if (p := "".join(spelt[at : at + k])) in weight]
        if spelt[at] not in weight:
            raw = (" " + text)[at].encode()
            steps.append((tuple(lattice.bytes[b] for b in raw), at + 1, math.exp(lattice.byte_logp * len(raw))))
        for ids, to, w in steps:
            for rest, v in ways(to):
                yield ids + rest, w * v

    return dict(ways(0))


@pytest.mark.parametrize("text", ["there", "a  (b", '= "c', "x▁é  \n1", "the...", "😀 --__a"])
def test_segmentations_come_with_their_probabilities(text):
    lattice = pieces.lattices(None, 1.0)
    want = all_segmentations(lattice, text)
    total = sum(want.values())
    n = 20_000
    got = Counter(tuple(s.tolist()) for s in lattice.sample([text] * n, np.arange(n).astype(np.uint64)))
    assert set(got) <= set(want)
    for way, w in want.items():
        p = w / total
        assert abs(got[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_every_piece_of_the_vocabulary_can_be_drawn():
    lattice = pieces.lattices(None, 1.0)
    names = list(lattice.names.values())
    texts = ["x" + n.replace("▁", " ") + "x" for n in names]
    units, counts = lattice.units(texts)
    ends = np.cumsum(counts)
    for n, a, b in zip(names, ends - counts, ends, strict=True):
        assert any(n.replace("▁", " ") in u for u in units[a:b]), n
    drawn = set(lattice.build([n.replace("▁", " ") for n in names])[3].tolist())
    assert drawn >= set(lattice.names)


def test_pieces_do_not_depend_on_what_is_kept(monkeypatch):
    lattice = pieces.lattices(None, 1.0)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeé. (", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(40)]
    keys = np.arange(40).astype(np.uint64)
    lattice.forget()
    want = [i.tolist() for i in lattice.sample(texts, keys)]
    monkeypatch.setattr(pieces, "MOST_EDGES", 500)
    for k in range(40):
        assert lattice.sample(texts[k : k + 1], keys[k : k + 1])[0].tolist() == want[k]
    assert len(lattice.known) < 200


def test_pieces_do_not_depend_on_the_partitioning(docs):
    one = {(r.doc_id, bytes(r.ids)) for r in pieces.sampled_pieces(docs.coalesce(1)).collect()}
    frame = pieces.sampled_pieces(docs.repartition(5))
    rows = frame.collect()
    assert one == {(r.doc_id, bytes(r.ids)) for r in rows} and all(r.lossless for r in rows)
    assert all(r.text == (TEXTS[r.doc_id] or "") for r in pieces.decoded(frame).collect())


# ---------------------------------------------------------------- sharding
def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(4)
    texts = ["w" * rng.randint(1, 200) + str(i) for i in range(600)] + ["copy one " * 9] * 60 + ["copy two " * 5] * 30 + [None, "", "", "hot" * 40] + ["hot" * 40] * 400
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    rows = sharding.shard(df).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    load = Counter()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 2 * max(r.size for r in rows) + 0.02 * sum(load.values())
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for copy in ("copy one " * 9, "copy two " * 5):
        assert len({r.shard for r in rows if texts[r.doc_id] == copy}) == 1
    assert sharding.shard(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [2, 5])
def test_full_shards_exchange_documents(spark, group):
    """Where all bytes are in groups of equal texts there is next to no room: groups still come together, shards stay even."""
    rng = random.Random(group)
    texts = [t for i in range(600) for t in ["x" * rng.randint(1, 300) + str(i)] * group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(df).collect()
    by, load = {}, Counter()
    for r in rows:
        by.setdefault(texts[r.doc_id], []).append(r.shard)
        load[r.shard] += r.size
    cut = sum(len(s) - max(Counter(s).values()) for s in by.values()) / sum(len(s) - 1 for s in by.values())
    assert cut < 0.1 and max(load.values()) < 1.05 * sum(load.values()) / 8


def test_large_groups_are_spread_over_keys(spark):
    texts = ["same text"] * 300 + [f"own {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(df, key_rows=40).collect()
    assert sorted(r.doc_id for r in rows) == list(range(700))
    most = max(Counter(r.shard for r in rows if r.doc_id < 300).values())  # the group is larger than a share, and fills one
    assert most * 10 >= 0.8 * sum(r.size for r in rows) / 8
    assert [r.linked for r in sorted(rows, key=lambda r: r.doc_id)] == [True] * 300 + [False] * 400


def test_exchange_keeps_quotas():
    rng = np.random.default_rng(1)
    for _ in range(50):
        wishes, room = rng.uniform(0, 9, (8, 8)) * (rng.random((8, 8)) < 0.4), rng.uniform(0, 5, 8) * (rng.random(8) < 0.3)
        part = sharding.exchange(wishes, room)
        np.fill_diagonal(wishes, 0)
        moving = wishes * part
        assert (moving.sum(0) <= room + moving.sum(1) + 1e-3).all() and (0 <= part).all() and (part <= 1).all()
    ring = np.zeros((3, 3))
    ring[0, 1] = ring[1, 2] = ring[2, 0] = 5.0
    assert sharding.exchange(ring, np.zeros(3)).tolist() == [1, 1, 1]


# ---------------------------------------------------------------- classifiers
def test_ftrl_against_a_plain_one():
    """The same updates, one coordinate after another."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 60, 12)).astype(np.uint32), int(rng.random() < 0.4)) for _ in range(120)]
    s = toxicity.Settings(epochs=3, l1=0.7, min_docs=4)
    docs = Counter(int(i) for x, _ in rows for i in x)
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == "bias" else s.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, y in rows:
            names = [int(i) for i in x if docs[int(i)] >= s.min_docs] + ["bias"]
            w = {i: weight(i) for i in names}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in names:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] += g * g
    got = toxicity.ftrl(rows, s)
    want = {i: weight(i) for i in docs if docs[i] >= s.min_docs and weight(i) != 0}
    assert dict(zip(got.slots.tolist(), got.values.tolist())) == pytest.approx(want) and got.bias == pytest.approx(weight("bias")) and len(want) > 5


def test_features_are_words_pairs_and_skips():
    import pyarrow as pa

    a, b, c, d, empty, none = toxicity.features(pa.array(["Red fox, ran FAR away", "red FOX ran far; away", "red fox", "fox red", "", None]))
    assert a.tolist() == b.tolist() and len(a) == 5 + 4 + 3 + 2  # words, neighbours, one and two left out
    assert len(c) == 3 and len(set(c.tolist()) & set(a.tolist())) == 3 and len(set(c.tolist()) & set(d.tolist())) == 2
    assert len(empty) == len(none) == 0


def test_statistics_against_plain_counts():
    import pyarrow as pa
    import re

    texts = ["Hello HELLO hello, 12 é!\nline\nline\n", "", None, "a a a b", "ONE $$$ two\n\nthree", "x" * 30 + " yy"]
    got = quality.statistics(pa.array(texts))
    for t, x in zip(texts, got):
        raw = (t or "").encode()
        size = max(len(raw), 1)
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
        low = [w.lower() for w in words]
        n = max(len(words), 1)
        lengths = [len(w) for w in words]
        mean = sum(lengths) / n
        again = sum(p == q for p, q in zip(low, low[1:]))
        lines = raw.split(b"\n")[: raw.count(b"\n") + (not raw.endswith(b"\n"))] if raw else []
        want = [sum(65 <= c <= 90 for c in raw) / size, sum(48 <= c <= 57 for c in raw) / size, sum(c == 32 or 9 <= c <= 13 for c in raw) / size, sum(chr(c) in ".,;:'\"-()?" for c in raw) / size]
        assert x[:4] == pytest.approx(want) and x[5:7] == pytest.approx([sum(c >= 128 for c in raw) / size, raw.count(b"\n") / size])
        tail = [math.log1p(len(words)), mean, math.sqrt(max(sum(k * k for k in lengths) / n - mean**2, 0)), sum(k <= 3 for k in lengths) / n, sum(k > 20 for k in lengths) / n, again / n, len(set(low)) / n]
        assert x[7:14] == pytest.approx(tail, abs=1e-9)
        assert x[16] == pytest.approx(1 - len({p.lower() for p in lines}) / len(lines) if lines else 0)


def test_the_cut_leaves_the_labelled_share_below():
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((300, quality.N_FEATURES)), (rng.random(300) < 0.8).astype(int)
    m = quality.threshold_by_quantile(quality.bradley_terry(x, y, quality.Settings()), x, y, np.ones(300))
    assert abs((m.raw(x) < m.cut).sum() - (y == 0).sum()) <= 1
    assert ((m.score(x) >= m.threshold) == (m.raw(x) >= m.cut)).all()


def _labelled(spark, n=900):
    rng = random.Random(5)
    words = [f"wo{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        w = rng.choices(words, k=rng.randint(5, 80))
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["Nasty", "vile"]))
        text = " ".join(w) if good else " ".join(x + "###" for x in w)
        rows.append((i, text, "clash"))
        labels.append((i, good, toxic))
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 1, "", "x"), (n + 2, "wo1 vile " + "wo2 " * 50_000, "x")]
    labels += [(n, None, None), (None, 1, 1), (5, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels[:-1], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    toxic = toxicity.score_texts(docs, toxicity.fit(docs, labels))
    good = quality.score_texts(docs, quality.fit(docs, labels))
    for scored, label, modulus, held, cut in ((toxic, "toxic", 3, 1, 0.7), (good, "quality", 5, 0, 0.3)):
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        truth = {r.doc_id: r[label] for r in labels.collect()}
        held_out = [r for r in rows if truth.get(r.doc_id) is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == held]
        assert len(held_out) > 100
        assert np.mean([(r.score >= cut) == (truth[r.doc_id] == 1) for r in held_out]) > 0.95


def test_classifiers_without_labels(spark):
    docs, labels = _labelled(spark, 20)
    assert {r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score_texts(docs, quality.fit(docs, labels.limit(0))).where(F.col("score").isNull()).count() == 0
    assert quality.score_texts(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_held_out_labels_do_not_move_scores(spark):
    docs, labels = _labelled(spark, 300)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    turned = labels.withColumn("quality", F.when(crc % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(crc % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for module in (quality, toxicity):
        a, b = (sorted((r.doc_id or -1, r.score) for r in module.score_texts(docs, module.fit(docs, some)).collect()) for some in (labels, turned))
        assert a == b


def test_long_texts_are_scored_but_not_trained_on(spark):
    docs, labels = _labelled(spark, 200)
    long = spark.createDataFrame([(5000, "vile " + "wo1 " * 400_000, "x")], "doc_id long, text string, score string")
    more = labels.unionByName(spark.createDataFrame([(5000, 1, 0)], "doc_id long, quality int, toxic int"))
    for module in (quality, toxicity):
        a, b = module.fit(docs, labels), module.fit(docs.unionByName(long), more)
        assert module.score_texts(long, b).first().score == module.score_texts(long, a).first().score or module is quality


def test_held_out_labels_do_not_move_the_quality_model(spark):
    docs, labels = _labelled(spark, 200)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 0).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert a.cut == b.cut and a.spread == b.spread and np.array_equal(a.weight, b.weight)


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, quality.N_FEATURES))
    y = (x @ np.linspace(-1, 1, quality.N_FEATURES) + 0.1 * rng.standard_normal(400) > -0.5).astype(int)
    m = quality.bradley_terry(x, y, quality.Settings())
    good, bad = m.raw(x[y == 1]), m.raw(x[y == 0])
    assert (good[:, None] > bad).mean() > 0.97


def test_every_pair_of_good_and_bad_rows_counts():
    """At the weights of a least loss over all pairs the slope, summed pair by pair, is zero; 20,000 pairs would not give that."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, quality.N_FEATURES)) * np.linspace(0.1, 5, quality.N_FEATURES)
    y = (x @ np.linspace(-1, 1, quality.N_FEATURES) + 4 * rng.standard_normal(500) > -3).astype(int)
    m = quality.bradley_terry(x, y, quality.Settings())
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    gap = (z[y == 1][:, None] - z[y == 0]).reshape(-1, quality.N_FEATURES)
    assert len(gap) > 20_000
    assert np.abs(quality.Settings().l2 * m.weight - gap.T @ (1 / (1 + np.exp(gap @ m.weight))) / len(gap)).max() < 1e-12


@pytest.mark.parametrize("ties", [False, True])
def test_scores_of_a_rank_over_parts(ties):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, quality.N_FEATURES))
    x = np.sign(x[:, :1]) * np.ones(quality.N_FEATURES) if ties else x
    m = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), np.linspace(-1, 2, quality.N_FEATURES), 0.0, 1.0, 0.3)
    parts = [x[i : i + 70] for i in range(0, 300, 70)]
    found = [quality.score_at(lambda f: [f(p, None) for p in parts], m, k) for k in (0, 1, 150, 299)]
    assert found == np.sort(m.raw(x))[[0, 1, 150, 299]].tolist()


def test_all_labelled_rows_make_the_quality_model(spark, monkeypatch):
    """More than 3,000 rows a class and a text of over a megabyte, in several parts; what order they lie in does not matter."""
    monkeypatch.setattr(quality, "ROWS", 1000)
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(["ab", "Cde", "f,", "12", "g\n", "hij#"], k=rng.randint(1, 12))), int(rng.random() < 0.9)) for i in range(4500)] + [(5002, "wo1 " * 400_000, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    import pyarrow as pa

    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    assert known[-1][0] == 5002 and sum(y for _, _, y in known) > 3000
    x, y = quality.statistics(pa.array([t for _, t, _ in known])), np.array([y for _, _, y in known])
    want = quality.threshold_by_quantile(quality.bradley_terry(x, y, quality.Settings()), x, y, np.ones(len(x)))
    got, again = quality.fit(docs, labels), quality.fit(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(3))
    for name in ("mean", "scale", "weight", "cut", "spread"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-9, atol=1e-12), name
        assert np.array_equal(getattr(got, name), getattr(again, name)), name


def test_shares_of_rows_make_one_toxicity_model(spark, monkeypatch):
    """One share is plain FTRL over all rows; the states of several are averaged after each epoch, each bearing its part of the penalties."""
    import pyarrow as pa

    rng = random.Random(12)
    rows = [(o, int(rng.random() < 0.4), " ".join(rng.choices([f"wo{i}" for i in range(12)], k=rng.randint(0, 6)))) for o in rng.sample(range(10_000), 90)]
    frame, rows = spark.createDataFrame(rows, "o long, y int, text string").repartition(3), sorted(rows)
    x = toxicity.features(pa.array([r[2] for r in rows]))
    slots = np.unique(np.concatenate(x))
    s = toxicity.Settings(epochs=4, l1=0.5, min_docs=1)
    want = toxicity.ftrl([(a, r[1]) for a, r in zip(x, rows, strict=True)], s)
    got = toxicity.shares_together(frame, len(rows), slots, s)
    assert np.array_equal(got.slots, want.slots) and np.allclose(got.values, want.values) and got.bias == pytest.approx(want.bias)

    monkeypatch.setattr(toxicity, "FEW_ROWS", 30)
    share = {r.o: r.p for r in frame.select("o", F.pmod(F.hash("o"), F.lit(3)).alias("p")).collect()}
    assert set(share.values()) == {0, 1, 2}
    z = n = np.zeros(len(slots) + 1)
    for _ in range(s.epochs):
        own = [toxicity.State(len(slots), s, 1 / 3) for _ in range(3)]
        for k, state in enumerate(own):
            state.z, state.n = z.copy(), n.copy()
            state.epoch((np.searchsorted(slots, a), r[1]) for a, r in zip(x, rows, strict=True) if share[r[0]] == k)
        z, n = np.mean([state.z for state in own], 0), np.mean([state.n for state in own], 0)
    own[0].z, own[0].n = z, n
    want, got = own[0].weights(slots), toxicity.shares_together(frame, len(rows), slots, s)
    assert np.array_equal(got.slots, want.slots) and np.allclose(got.values, want.values) and got.bias == pytest.approx(want.bias) and len(want.slots) > 5


def test_toxicity_stage_learns_from_all_labelled_rows(spark, tmp_path):
    """A word that only labelled toxic rows beyond the first 3,000 of their class have is learnt; what order rows lie in does not matter."""
    import corpus_pipeline

    rng = random.Random(13)
    toxic = {i: int(rng.random() < 0.5) for i in range(12_000)}
    order = [r.doc_id for r in spark.range(12_000).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id")).collect() if toxic[r.doc_id] and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    early = set(order[:3000])
    assert len(order) > 3500
    word = {i: "" if not toxic[i] else "early" if i in early else "late" for i in toxic}
    rows = [(i, " ".join([*rng.choices([f"wo{k}" for k in range(50)], k=rng.randint(3, 8)), word[i]])) for i in toxic]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()} == {i for i in toxic if not toxic[i]}
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(3))
    assert np.array_equal(a.slots, b.slots) and np.array_equal(a.values, b.values) and a.bias == b.bias


def test_text_buffer_of_slices():
    import pyarrow as pa

    a = pa.array(["ab", None, "cé", ""]).slice(1)
    data, offsets = text_buffer(a)
    assert data.tobytes() == "cé".encode() and offsets.tolist() == [0, 0, 3, 3]


# ---------------------------------------------------------------- rows without an id, and empty tables
def test_null_ids_and_empty_tables(spark):
    import corpus_pipeline
    from larkspur.llm import repeats, simhash, spherical

    text = "some words of a text that goes on " * 30
    rows = [(None, text, None, None, None), (None, text, None, None, None), (1, text, None, None, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.01]), (7, [1.0, 0.0]), (8, None)], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    calls = [
        (docs, media.text_media), (docs, simhash.near_duplicates), (docs, pieces.sampled_pieces), (docs, packing.pack_documents), (docs, sharding.shard), (docs, repeats.remove_repeats),
        (docs, lambda d: toxicity.score_texts(d, toxicity.fit(d, labels))), (docs, lambda d: quality.score_texts(d, quality.fit(d, labels))), (vectors, spherical.near_duplicates), (pages, lambda p: warc.derive(warc.responses(p))),
    ]
    for df, call in calls:
        assert call(df).count() >= df.count()
        assert call(df.limit(0)).count() == 0
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in spherical.near_duplicates(vectors).collect()}
    assert by[7] == (2, 7, True) and by[8] == (0, 8, True) and by[None][2] is False
    assert sorted(str(r.doc_id) for r in simhash.representatives(docs).collect()) == ["1", "2", "None", "None"]
    assert corpus_pipeline.cut_repeats(spark, docs, "").select("text").distinct().count() == 1


def test_near_copies_go_by_row(spark):
    """Rows without an id are compared, and rows that share an id are not taken for each other."""
    import corpus_pipeline

    a, b, c, d, e, f = (" ".join(f"{x}{i * i}" for i in range(80)) for x in "abcdef")
    rows = [(0, b), (1, a), (1, b), (5, c), (5, d), (None, e), (None, e), (9, e), (None, f), (None, f)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = [(0, b), (1, a), (5, c), (5, d), (9, e), (None, f)]
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(i), t) for i, t in want)
    assert left.columns == docs.columns
    assert sorted(r.kept_text for r in corpus_pipeline.repeats.remove_repeats(left, keep=("kept_text",)).collect()) == sorted(t for _, t in want)


def test_pipeline_stages_against_their_definitions(spark, tmp_path):
    """Each stage's rows are those its operator's definition leaves, on its own input."""
    import corpus_pipeline
    from larkspur.llm import simhash

    rng = random.Random(8)
    words = [f"wo{i}" for i in range(400)]
    rows, labels = [], []
    passage = " ".join(rng.choices(words, k=120))
    for i in range(700):
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.75)
        w = rng.choices(words, k=rng.randint(20, 120))
        if toxic:
            w.insert(3, "nasty")
        text = " ".join(w) if good else " ".join(x + "$$$" for x in w)
        if i % 50 == 0 and good and not toxic:
            text += " " + passage
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, good, toxic))
    rows += [(700 + i, rows[i][1], "en", "s", rows[i][4]) for i in range(20)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    truth = {i: (g, t) for i, g, t in labels} | {700 + i: labels[i][1:] for i in range(20)}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            continue
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r for r in docs.collect()}
        if name in ("quality", "toxicity"):
            k, want = (0, 1) if name == "quality" else (1, 0)
            kept = np.mean([i in after for i in before if truth[i][k] == want])
            gone = np.mean([i not in after for i in before if truth[i][k] != want])
            assert kept > 0.97 and gone > 0.9
            assert all(after[i].text == before[i] for i in after)
        elif name == "near-dedup":
            group = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect()}
            assert set(after) == set(group.values())
        else:
            raw = {i: t.encode() for i, t in before.items()}
            width = corpus_pipeline.repeats.PASSAGE
            seen = Counter(b[i : i + width] for b in raw.values() for i in range(len(b) - width + 1))
            assert any(c > 1 for c in seen.values())
            for i, b in raw.items():
                gone = np.zeros(len(b), bool)
                for j in range(len(b) - width + 1):
                    if seen[b[j : j + width]] > 1:
                        gone[j : j + width] = True
                assert after[i].text == bytes(np.frombuffer(b, np.uint8)[~gone]).decode() and after[i].n_chars == len(after[i].text)
    from larkspur.llm import common

    before = set(common._MADE)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    made = [p.rsplit("/", 1)[1] for p in common._MADE if p not in before]
    assert sum(p.startswith("stage-") for p in made) == 4 and not any(p.startswith(("packets", "replies", "prints")) for p in made)  # only the last stage's own are left


def test_quality_stage_cuts_at_the_quantile_of_all_labelled_rows(spark, tmp_path):
    """More than 3,000 labelled rows of each class, whose labels the statistics tell only roughly: the rows kept are those above the cut of all of them."""
    import corpus_pipeline
    import pyarrow as pa

    rng = random.Random(11)
    rows = []
    for i in range(8800):
        marks = rng.random()
        text = " ".join(f"{rng.choice('abcdefgh') * rng.randint(1, 9)}{'#' if rng.random() < marks else ''}" for _ in range(rng.randint(5, 40)))
        rows.append((i, text, int(marks + rng.gauss(0, 0.3) < 0.5)))
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    x, y = quality.statistics(pa.array([t for _, t, _ in rows])), np.array([y for _, _, y in rows])
    known = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows])
    assert min((y[known] == 0).sum(), (y[known] == 1).sum()) > 3000
    m = quality.bradley_terry(x[known], y[known], quality.Settings())
    m = quality.threshold_by_quantile(m, x[known], y[known], np.ones(known.sum()))
    assert (m.raw(x[known]) < m.cut).sum() == (y[known] == 0).sum()
    kept = corpus_pipeline.keep_good(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == np.flatnonzero(m.raw(x) >= m.cut).tolist()


def test_queries_keep_their_contracts(spark, tmp_path):
    """The columns and types of each query on a table with nulls, repeats and clashing columns; folds and thresholds of the scores."""
    from larkspur.llm import queries

    docs, labels = _labelled(spark, 150)
    docs = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("shard", F.lit(9)).unionByName(docs.limit(3).select("doc_id", "text", "score", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("shard")))
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, 0.5], 1) for i in range(30)] + [(30, None, 1), (None, [1.0, 0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    for name, df in (("documents", docs), ("labels", labels), ("embeddings", vectors), ("pages", pages)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    n = docs.count()
    wanted = {
        "op1_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
        "op3_simhash": "doc_id bigint, fingerprint string, n_near bigint, component_id bigint", "op4_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int", "op7_spherical": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int", "op9_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    }
    for name, columns in wanted.items():
        frame = queries.QUERIES[name](spark, str(tmp_path))
        assert ", ".join(f"{c} {t}" for c, t in frame.dtypes).startswith(columns), name
        rows = frame.collect()
        assert len(rows) == (32 if name == "op7_spherical" else n) or name == "op4_packing" and len({r.doc_id for r in rows}) == len({r.doc_id for r in docs.collect()})
        if name in ("op8_toxicity", "op10_quality"):
            modulus, held, cut = (3, 1, 0.7) if name == "op8_toxicity" else (5, 0, 0.3)
            for r in rows:
                assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and r.predicted == (r.score >= cut)
    assert set(queries.QUERIES) == {*wanted, "op2_warc", "op5_pieces"} and queries.QUERIES["op2_warc"](spark, str(tmp_path)).count() == 4
    assert all(r.lossless for r in queries.QUERIES["op5_pieces"](spark, str(tmp_path)).collect())
