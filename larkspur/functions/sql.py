"""The engine's scalar functions under SQL names, as temporary SQL functions: they are inlined, not called row by row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from larkspur.functions import text as T
from larkspur.operators import clones as C

_DOT = "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
_SELF = "aggregate(transform({0}, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 0D, (s, x) -> s + x)"
_NORMS = f"sqrt({_SELF.format('a')}) * sqrt({_SELF.format('b')})"
_SYLLABLES = "filter(split(t, ''), c -> c <> '')"
_CODE = "CAST(conv(hex(encode(c, 'UTF-16BE')), 16, 10) AS BIGINT)"



def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_STOP = ", ".join(f"'{w}'" for w in T.CODE_STOPWORDS)
_NUMBERS = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")"
_PLAIN = f"regexp_replace(regexp_replace(t, {_literal('(?s)/[*].*?([*]/|$(?!.))')}, ' '), {_literal('(?m)^[ \\t\\x0B\\f\\r\\n]*#.*$|//.*$')}, ' ')"
_CODE_WORDS = f"transform(filter(split({_PLAIN}, {_literal('[^\\p{L}\\p{N}_]+')}), x -> x <> ''), x -> CASE WHEN x RLIKE '^[0-9]+$' THEN '$N' ELSE x END)"
_GRAMS = "array_distinct(concat(w, CASE WHEN size(w) > 1 THEN transform(sequence(1, size(w) - 1), i -> concat(element_at(w, i), '_', element_at(w, i + 1))) ELSE array() END))"

#: A function may use those before it.
FUNCTIONS = {
    "l2_sq": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "neg_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"-{_DOT}"),
    "cosine_dist": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN {_NORMS} = 0 THEN 1D ELSE 1D - least(greatest({_DOT} / ({_NORMS}), -1D), 1D) END"),
    "bm25_tokens": ("t STRING", "ARRAY<STRING>", r"filter(split(lower(t), r'(?:(?U:\s)|[!-/:-@\[-`{-~])+'), x -> x <> '')"),
    "choseong": ("t STRING", "STRING", f"array_join(transform({_SYLLABLES}, c -> CASE WHEN {_CODE} BETWEEN 44032 AND 55203 THEN substr('{T.CHOSEONG}', CAST(floor(({_CODE} - 44032) / 588) AS INT) + 1, 1) WHEN {_CODE} BETWEEN 12593 AND 12686 THEN c ELSE '' END), '')"),
    "code_tokens": ("t STRING", "ARRAY<STRING>", f"filter(transform(filter(split(t, {_literal(T.CODE_PARTS)}), x -> x <> ''), x -> lower(x)), x -> octet_length(x) >= 2 AND NOT array_contains(array({_STOP}), x))"),
    "minhash_words": ("t STRING", "ARRAY<STRING>", _CODE_WORDS),
    "minhash_features": ("w ARRAY<STRING>", "ARRAY<BIGINT>", f"CASE WHEN size(w) >= {C.LEAST_TOKENS} THEN transform({_GRAMS}, g -> CAST(conv(substr(md5(CAST(g AS BINARY)), 1, 15), 16, 10) AS BIGINT) % {C.PRIME}) END"),
    "minhash_least": ("f ARRAY<BIGINT>", "ARRAY<BIGINT>", f"CASE WHEN f IS NOT NULL THEN transform(sequence(1, {C.K}), i -> array_min(transform(f, x -> (x * element_at({_NUMBERS(C.MULTIPLIERS)}, i) + element_at({_NUMBERS(C.OFFSETS)}, i)) % {C.PRIME}))) END"),
    "minhash64": ("t STRING", "ARRAY<BIGINT>", "minhash_least(minhash_features(minhash_words(coalesce(t, ''))))"),
    "minhash_jaccard": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", "CASE WHEN size(a) <> size(b) OR size(a) = 0 THEN 0D ELSE size(filter(zip_with(a, b, (x, y) -> x = y), x -> x)) / size(a) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return sorted(FUNCTIONS)
