"""Tokenizers, token filters, Hangul letters and result formatting as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

try:
    from _md5 import md5  # twice as fast on short strings
except ImportError:
    from hashlib import md5

CODE_STOPWORDS = sorted(
    "abstract an and as be begin catch class const crate def do else end enum err false final fn for from func if impl import in int interface is it let match mod mut new no none "
    "not null of ok or package private protected pub public ref return self some static struct super the then this throw throws to true try type use var void while".split()
)
KOREAN_STOPWORDS = sorted(
    "가 같이 것 과 그래서 그러나 그러면 그리고 까지 께 는 더러 도 되다 등 때 또는 또한 로 를 마다 만 및 보다 부터 수 아니다 없다 에 에게 에서 와 으로 은 을 의 이 이다 있다 전 중 즉 처럼 하다 하지만 한테 후".split()
)
SPACES = r"(?U)\s+"
PUNCTUATION = r"(?:(?U:\s)|[!-/:-@\[-`{-~])+"
CODE_SPLIT = r"(?:(?U:\s)|[(){}\[\]<>,;:.=+\-*/&|!?#@\"'`~^%\\])+"
_IN_WORD = r"(?U:[^(){}\[\]<>,;:.=+\-*/&|!?#@\"'`~^%\\_\s])"
CODE_PARTS = CODE_SPLIT + rf"|(?<={_IN_WORD})_+|_+(?={_IN_WORD})|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: Between the two groups of each lies a boundary inside an identifier.
BOUNDARIES = (r"([a-z])([A-Z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])", r"([A-Z])([A-Z][a-z])")
HANGUL = r"[\uAC00-\uD7AF\u1100-\u11FF\u3130-\u318F]"
CHOSEONG = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
JUNGSEONG = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
JONGSEONG = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def _filled(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x != "")


def whitespace_tokens(text: Column) -> Column:
    return _filled(F.split(F.lower(text), SPACES))


def simple_tokens(text: Column) -> Column:
    """Split at white space and ASCII punctuation, lower-cased."""
    return _filled(F.split(F.lower(text), PUNCTUATION))


def split_identifier(word: Column) -> Column:
    """snake_case, camelCase, ACRONYMWord and letter-digit boundaries; a word of underscores stays whole."""
    marked = word
    for b in BOUNDARIES:
        # twice, as neighbouring matches share a character
        marked = F.regexp_replace(F.regexp_replace(marked, b, "$1_$2"), b, "$1_$2")
    parts = _filled(F.split(marked, "_+"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(word))


def code_tokens(text: Column) -> Column:
    """Identifier parts of at least two bytes that are no keywords: one split of the whole text.

    It splits at separators, at underscores beside a word, and at the boundaries inside identifiers.
    """
    parts = F.transform(_filled(F.split(text, CODE_PARTS)), lambda x: F.lower(x))
    return F.filter(parts, lambda x: (F.octet_length(x) >= 2) & ~x.isin(CODE_STOPWORDS))


TOKENIZERS = {"whitespace": whitespace_tokens, "simple": simple_tokens, "code": code_tokens}


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by U+0001."""
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat(F.element_at(tokens, i), F.lit("\x01"), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- token filters
def without_stopwords(words: list[str] = KOREAN_STOPWORDS):
    stop = list(words)
    return lambda tokens: F.filter(tokens, lambda x: ~x.isin(stop))


def of_length(least: int = 2):
    return lambda tokens: F.filter(tokens, lambda x: F.char_length(x) >= least)


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.lower(x))


def chain(*filters):
    """The filters one after another."""

    def run(tokens: Column) -> Column:
        for f in filters:
            tokens = f(tokens)
        return tokens

    return run


def token_kind(pos: Column) -> Column:
    """The kind of a part-of-speech tag."""
    first = F.substring(pos, 1, 1)
    return (
        F.when(first == "N", "noun").when(first == "V", "verb").when(pos.startswith("MA"), "adverb").when(first == "M", "adjective").when(first.isin("J", "E"), "particle")
        .when(pos.startswith("SN"), "number").when(pos.startswith("SL") | pos.startswith("SH"), "foreign").when(first == "S", "punctuation").otherwise("unknown")
    )


def is_searchable(kind: Column) -> Column:
    return kind.isin("noun", "verb", "adjective", "adverb", "foreign", "number")


#: Rows that a Python worker holds before it hands them on.
ROWS = 20_000


def offset_tokens(df, key: str, text: str, lowercase: bool = True):
    """key, pos, token, start and end (bytes of the possibly lower-cased text) of the words between white space."""
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()

    def made(rows: list[tuple], first: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (first, pa.int32(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "pos", "token", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first = [], b.schema.field(0).type
            for k, t in zip(b.column(0), b.column(1), strict=True):
                k, t = k.as_py(), t.as_py() or ""
                t = t.lower() if lowercase else t
                at = last = 0
                for i, m in enumerate(re.finditer(r"\S+", t)):
                    at += len(t[last : m.start()].encode())
                    size = len(m.group().encode())
                    rows.append((k, i, m.group(), at, at + size))
                    at, last = at + size, m.end()
                    if len(rows) >= ROWS:
                        yield made(rows, first)
                        rows = []
            yield made(rows, first)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, pos int, token string, start long, end long")


def dictionary_entry(line: Column) -> Column:
    """term, pos and reading of a user dictionary's line ("term,pos" reads as the term); null for blank lines and comments.

    Any other number of parts is an error of the query.
    """
    bare = F.trim(line)
    parts = F.transform(F.split(bare, ","), lambda x: F.trim(x))
    n = F.size(parts)
    fits = F.struct(F.get(parts, F.lit(0)).alias("term"), F.get(parts, F.lit(1)).alias("pos"), F.when(n == 3, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0))).alias("reading"))
    bad = F.raise_error(F.concat(F.lit("bad dictionary entry: "), bare)).cast("struct<term:string,pos:string,reading:string>")
    return F.when((bare != "") & ~bare.startswith("#"), F.when(n.isin(2, 3), fits).otherwise(bad))


def dictionary_line(entry: Column) -> Column:
    """The entry as the analyser's dictionary wants it: term, cost 0, pos, reading."""
    return F.concat_ws(",", entry.term, F.lit("0"), entry.pos, entry.reading)


# ---------------------------------------------------------------- Hangul
def _code(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")


def is_syllable(c: Column) -> Column:
    return _code(c).between(0xAC00, 0xD7A3)


def is_jamo(c: Column) -> Column:
    code = _code(c)
    return code.between(0x1100, 0x11FF) | code.between(0x3131, 0x318E)


def _characters(text: Column) -> Column:
    return _filled(F.split(text, ""))


def _mapped(texts: pa.Array, tables: tuple[np.ndarray, ...], kept: np.ndarray | None = None) -> pa.Array:
    """Texts with each syllable replaced by its entries of the tables (0 for none); other characters stay, or only those of `kept`."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts.to_pylist()]
    out = []
    for r in raw:
        c = np.frombuffer(r, "<u4")
        at = c.astype(np.int64) - 0xAC00
        is_in = (at >= 0) & (at < 11172)
        parts = np.zeros((len(c), len(tables)), "<u4")
        parts[:, 0] = np.where(is_in, 0, c) if kept is None else np.where(~is_in & np.isin(c, kept), c, 0)
        for k, t in enumerate(tables):
            parts[is_in, k] = t[at[is_in]]
        flat = parts.ravel()
        # the character 0 is no letter: it is told from an empty place by where it stood
        keep = flat != 0
        if kept is None:
            keep[:: len(tables)] |= ~is_in
        out.append(flat[keep].tobytes().decode("utf-32-le", "surrogatepass"))
    return pa.array(out, pa.string())


_AT = np.arange(11172)
_FIRST = np.array([ord(c) for c in CHOSEONG], "<u4")[_AT // 588]
_SECOND = np.array([ord(c) for c in JUNGSEONG], "<u4")[_AT % 588 // 28]
_LAST = np.array([0, *map(ord, JONGSEONG)], "<u4")[_AT % 28]
_ALONE = np.array([*range(0x1100, 0x1200), *range(0x3131, 0x318F)])


def decompose(text: Column) -> Column:
    """Syllables as their letters; everything else unchanged."""

    @F.arrow_udf("string")
    def letters(t: pa.Array) -> pa.Array:
        return _mapped(t, (_FIRST, _SECOND, _LAST))

    return F.when(text.isNotNull(), letters(F.coalesce(text, F.lit(""))))


def choseong(text: Column) -> Column:
    """The first letters of the syllables, and letters standing alone."""

    @F.arrow_udf("string")
    def first(t: pa.Array) -> pa.Array:
        return _mapped(t, (_FIRST,), _ALONE)

    return F.when(text.isNotNull(), first(F.coalesce(text, F.lit(""))))


def matches_choseong(text: Column, query: Column) -> Column:
    return F.contains(choseong(text), query)


def has_korean(text: Column) -> Column:
    return text.rlike(HANGUL)


def fusion_alpha(query: Column) -> Column:
    """The weight of the dense side: less for queries with Hangul."""
    return F.when(has_korean(query), F.lit(0.4)).otherwise(F.lit(0.7))


# ---------------------------------------------------------------- results
def clipped(text: Column, most: int) -> Column:
    """The first characters that have at most `most` bytes together: one more byte tells whether the last one is whole."""
    raw = F.encode(text, "UTF-8")
    # continuation bytes are 80 to BF: a cut lies before a byte that is none
    cut = F.element_at(F.filter(F.sequence(F.lit(most), F.lit(most - 3), F.lit(-1)), lambda i: (i <= 0) | ~F.hex(F.substring(raw, i + 1, F.lit(1))).rlike("^[89AB]")), 1)
    return F.when(F.octet_length(text) > most, F.substring(raw, F.lit(1), cut).cast("string")).otherwise(text)


def truncated(text: Column, most: int) -> Column:
    """At most `most` bytes, cut between characters, with dots where cut."""
    return F.when(F.octet_length(text) > most, F.concat(clipped(text, most), F.lit("..."))).otherwise(text)


def without_home(path: Column, home: str) -> Column:
    """Without the home folder and leading slashes."""
    return F.ltrim(F.when(path.startswith(home), F.substr(path, F.lit(len(home) + 1))).otherwise(path), F.lit("/"))


def compact(text: Column, most: int = 150) -> Column:
    return truncated(F.replace(text, F.lit("\n"), F.lit(" ")), most)


def description(text: Column) -> Column:
    """The first line after the heading that is no labelled line."""
    lines = F.transform(F.slice(F.split(text, "\n"), 2, 1_000_000), lambda x: F.trim(x))
    return F.get(F.filter(lines, lambda x: (x != "") & ~x.rlike("^(File|Signature|Types|Calls|Called by):")), F.lit(0))


def line_range(text: Column) -> Column:
    """"10-20" of the first line "File: path:10-20"."""
    found = F.regexp_extract(text, r"(?m)^[ \t]*File:.*:(\d[^:\n]*?)[ \t]*$", 1)
    return F.when(found != "", found)


def relative_path(path: Column, root: str) -> Column:
    return F.when(path.startswith(root), F.ltrim(F.substr(path, F.lit(len(root) + 1)), F.lit("/"))).otherwise(path)


def is_test_path(path: Column) -> Column:
    return path.rlike(r"[/\\]tests?[/\\]|_test\.(rs|go)$")


# ---------------------------------------------------------------- code tokens for MinHash
def minhash_words(text: Column) -> Column:
    """Words of code without comments, with a space between them."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?(\*/|\z)", " "), r"(?m)^\s*#.*$|//.*$", " ")
    return F.regexp_replace(body, r"[^\p{L}\p{N}_]+", " ")


def minhash_tokens(text: Column) -> Column:
    """Words of code without comments; numbers become one token."""
    return F.transform(_filled(F.split(minhash_words(text), " ")), lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("$N")).otherwise(x))


def content_key(*parts: Column) -> Column:
    """A 60-bit number from the md5 of the parts, the same in any engine: ids of chunks by source and place."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def content_keys(words: pa.Array) -> np.ndarray:
    """content_key of each of some strings."""
    digests = b"".join([md5(w).digest() for w in words.cast(pa.binary()).to_pylist()])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def content_hash(content: Column) -> Column:
    """The first eight bytes of the md5 as an unsigned little-endian number, in 16 hexadecimal digits."""
    h = F.md5(content.cast("binary"))
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
