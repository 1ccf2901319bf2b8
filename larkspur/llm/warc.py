"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Deriving stays in built-in expressions. Each derived record names its response in WARC-Refers-To,
repeats the response's target URI and date, carries the digest of the response's payload (and the one
that the source record declares, if any) beside its own block's digest, and the metadata block lists
the response's HTTP headers.

Plain text: comments, scripts, styles, templates and the head are left out; block tags end a line;
other tags vanish; the named entities below and nothing else are decoded; spaces and empty lines are
squeezed.

Reading keeps bytes until digests are taken: the payload's digest is that of the body without its
transfer coding; only then is it freed of content codings and decoded by the charset of its header,
else of its markup, else as UTF-8. Plain files are split by the reader, gzipped ones stream through a
task each; a file in which a record's length does not tally is read once more, whole, by its
Content-Length alone.

Defined results: a null payload is an empty one (both derived records exist, with empty text); a null
URI or header text is empty; a long payload stays whole, in one row; repeated responses give repeated
records with equal ids, so there are no ties; an empty table or file gives none; other input columns
are ignored, whatever their names. A record without a usable Content-Length is left out.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DATE = "2000-01-01T00:00:00Z"
HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|aside|blockquote|pre|hr|main|figure|form|dl|dt|dd)\b[^>]*>"
TAGS = r"<[!/?a-zA-Z][^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"(?i)<a\s[^>]*href\s*="


def _entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, DROPPED, " ")
    text = _entities(F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, ""))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]{2,}|[\t\r\f]", " "), r" ?\n[ \n]+| \n", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def _urn(c: Column) -> Column:
    """A urn:uuid from the md5 of a string."""
    h = F.md5(c.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def responses(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, headers: str = HEADERS) -> DataFrame:
    """Pages as response records: source_id, record_id, target_uri, warc_date, http_headers, payload."""
    uri = F.coalesce(df[url].cast("string"), F.lit(""))
    return df.select(
        df[key].cast("long").alias("source_id"), _urn(F.concat(F.lit("response "), F.coalesce(df[key].cast("string"), F.lit("")), F.lit(" "), uri)).alias("record_id"),
        uri.alias("target_uri"), F.lit(date).alias("warc_date"), F.lit(headers).alias("http_headers"), F.coalesce(df[html].cast("string"), F.lit("")).alias("payload"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("string").alias("declared_digest"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response: source_id, record_type, record_id, refers_to, target_uri, warc_date, content_type,
    content_length, block_digest, source_payload_digest, declared_digest and block.

    Where the responses have no payload_digest, it is taken of the payload's UTF-8.
    """
    given = lambda c: F.col(c) if c in responses.columns else F.lit(None).cast("string").alias(c)
    base = responses.select(
        "source_id", "record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), "warc_date",
        F.coalesce("http_headers", F.lit("")).alias("http_headers"), F.coalesce("payload", F.lit("")).alias("payload"), given("payload_digest"), given("declared_digest"),
    )
    made = base.select(
        "source_id", "record_id", "target_uri", "warc_date", F.coalesce("payload_digest", _digest(F.col("payload"))).alias("source_payload_digest"), "declared_digest", plain_text(F.col("payload")).alias("text"),
        F.concat(
            F.lit("title: "), F.trim(F.regexp_replace(_entities(F.regexp_extract("payload", TITLE, 1)), r"\s+", " ")),
            F.lit("\r\noutlinks: "), F.regexp_count("payload", F.lit(LINK)).cast("string"),
            F.lit("\r\nsource-length: "), F.octet_length("payload").cast("string"),
            F.lit("\r\nsource-headers: "), F.regexp_replace("http_headers", r"\r\n", " | "), F.lit("\r\n"),
        ).alias("meta"),
    )
    records = F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.col("meta").alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    ))
    out = made.select("source_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "source_payload_digest", "declared_digest", records.alias("r"))
    return out.select(
        "source_id", F.col("r.record_type").alias("record_type"), _urn(F.concat(F.col("r.record_type"), F.lit(" "), F.col("refers_to"))).alias("record_id"), "refers_to", "target_uri", "warc_date",
        F.col("r.content_type").alias("content_type"), F.octet_length("r.block").cast("long").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"), "source_payload_digest", "declared_digest", F.col("r.block").alias("block"),
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """records with `warc`, each record as the bytes of a WARC 1.1 file; fields that are null are left out."""
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_payload_digest")), line("WARC-Source-Declared-Digest", F.col("declared_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.withColumn("warc", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a WARC file, gzipped by record or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = _fields(data[at:end])
        n = headers.get("content-length", "")
        at = end + 4
        if n.isdecimal():
            yield headers, data[at : at + int(n)]
            at += int(n)


def _fields(head: bytes) -> dict[str, str]:
    """Named fields after the first line; names in lower case, continued lines joined."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


SEPARATOR = "\r\n\r\nWARC/1."


def _piece(piece: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers, block) of what lies between two separators; None if its length does not tally."""
    head, found, rest = piece.removeprefix(b"WARC/1.").partition(b"\r\n\r\n")
    headers = _fields(head)
    n = headers.get("content-length", "")
    if not re.fullmatch(rb"\d(?:\r\n.*)?", head, re.S) or not n.isdecimal() or (not found and int(n) > 0):
        return None
    n = int(n)
    return (headers, rest[:n]) if len(rest) >= n and not rest[n:].strip(b"\r\n") else None


def _dechunked(body: bytes) -> bytes:
    """A body without its chunked transfer coding; what is cut off or malformed stays as far as it goes."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            return body if at == 0 else b"".join(out)
        n = int(size, 16)
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if at else body


def _unpacked(body: bytes, coding: str) -> bytes:
    """A body without gzip or deflate; other codings, and bodies that are not in theirs, stay."""
    for kind in reversed([c.strip().lower() for c in coding.split(",")]):
        try:
            if kind in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body)
            elif kind == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
        except zlib.error:
            return body
    return body


def _decoded(body: bytes, content_type: str) -> str:
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    marked = re.search(rb"<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", body[:2048], re.I)
    for charset in (named and named.group(1), marked and marked.group(1).decode("ascii", "replace"), "utf-8"):
        try:
            if charset:
                return body.decode(charset, "replace")
        except (LookupError, ValueError):
            continue
    return body.decode("utf-8", "replace")


RESPONSE = "source_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string, declared_digest string"
_NAMES = [f.split()[0] for f in RESPONSE.split(", ")]


def _response(headers: dict[str, str], block: bytes) -> tuple | None:
    """The row of a response record, None for other records."""
    if headers.get("warc-type") != "response":
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    http = _fields(head)
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    digest = "sha256:" + hashlib.sha256(body).hexdigest()
    text = _decoded(_unpacked(body, http.get("content-encoding", "")), http.get("content-type", ""))
    return None, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), head.decode("utf-8", "replace") + "\r\n", text, digest, headers.get("warc-payload-digest")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.string()) for i in range(len(_NAMES))], _NAMES)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files: what derive takes (source_id is null)."""
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))

    def misfits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["file"]).filter(pa.array([_piece(p) is None and bool(p.strip()) for p in b.column(0).to_pylist()], pa.bool_()))

    broken = [r["file"] for r in pieces.mapInArrow(misfits, "file string").distinct().collect()]  # names of files, which the driver lists anyhow

    def from_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_piece(p) for p in b.column(0).to_pylist()]
            yield _batch([r for x in found if x is not None and (r := _response(*x)) is not None])

    def from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                for record in parse(content):
                    if (r := _response(*record)) is not None:
                        yield _batch([r])

    if not broken:
        return pieces.mapInArrow(from_pieces, RESPONSE)
    whole = spark.read.format("binaryFile").load(broken).select("content").mapInArrow(from_files, RESPONSE)
    return pieces.where(~F.col("file").isin(broken)).mapInArrow(from_pieces, RESPONSE).unionByName(whole)


def oracle_sql() -> str:
    """DuckDB's account of derive(responses(pages))."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def entities(c: str) -> str:
        for name, char in ENTITIES:
            c = f"replace({c}, {quote(name)}, {quote(char)})"
        return c

    def urn(c: str) -> str:
        h = f"md5({c})"
        return f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"

    text = f"regexp_replace(payload, {quote(DROPPED)}, ' ', 'g')"
    text = entities(f"regexp_replace(regexp_replace({text}, {quote(BREAKS)}, chr(10), 'g'), {quote(TAGS)}, '', 'g')")
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\f]{{2,}}|[\\t\\r\\f]', ' ', 'g'), ' ?\\n[ \\n]+| \\n', chr(10), 'g')"
    text = f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    head = quote(HEADERS).replace("\r\n", "' || chr(13) || chr(10) || '")
    crlf = "chr(13) || chr(10)"
    meta = (
        f"'title: ' || trim(regexp_replace({entities(f'regexp_extract(payload, {quote(TITLE)}, 1)')}, '\\s+', ' ', 'g')) || {crlf} || 'outlinks: ' || len(regexp_extract_all(payload, {quote(LINK)})) || {crlf}"
        f" || 'source-length: ' || strlen(payload) || {crlf} || 'source-headers: ' || replace({head}, {crlf}, ' | ') || {crlf}"
    )
    return f"""
WITH r AS (SELECT page_id AS source_id, {urn("'response ' || coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '')")} AS refers_to, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
m AS (SELECT source_id, refers_to, target_uri, 'sha256:' || sha256(payload) AS source_payload_digest, {text} AS t, {meta} AS meta FROM r),
d AS (SELECT source_id, refers_to, target_uri, source_payload_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type, meta AS block FROM m
      UNION ALL SELECT source_id, refers_to, target_uri, source_payload_digest, 'conversion', 'text/plain', t FROM m)
SELECT source_id, record_type, {urn("record_type || ' ' || refers_to")} AS record_id, refers_to, target_uri, '{DATE}' AS warc_date, content_type, strlen(block)::BIGINT AS content_length,
       'sha256:' || sha256(block) AS block_digest, source_payload_digest, NULL::VARCHAR AS declared_digest, block FROM d"""
