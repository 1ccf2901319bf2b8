"""Requests and results as JSON, dates, the typed custom map, random numbers and neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REQUEST = "id bigint, method string, params struct<db:string,query:string,k:int,tags:array<string>,min_score:double,vector:array<double>>"


def request(line: Column) -> Column:
    """A JSON-RPC request for a search; null where the line is no JSON, k is 10 and tags are none if not given."""
    r = F.from_json(line, REQUEST)
    p = r.params
    filled = F.struct(p.db.alias("db"), p.query.alias("query"), F.coalesce(p.k, F.lit(10)).alias("k"), F.coalesce(p.tags, F.array().cast("array<string>")).alias("tags"), p.min_score.alias("min_score"), p.vector.alias("vector"))
    return F.when(r.method.isNotNull(), F.struct(r.id.alias("id"), r.method.alias("method"), filled.alias("params")))


def response(id_: Column, results: Column, total: Column) -> Column:
    """The answer to it; null fields are left out."""
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), id_.alias("id"), F.struct(results.alias("results"), total.alias("total_docs")).alias("result")))


def civil(days: Column) -> Column:
    """YYYY-MM-DD of days since 1970-01-01."""
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def _value(**given: Column) -> Column:
    kinds = {"s": "string", "i": "long", "l": "array<string>"}
    return F.struct(*[(given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def custom_map() -> Column:
    """The custom map of a symbol row (as parse_symbols gives it, and visibility): strings, integers and lists packed by tabs; empty ones are left out."""
    packed = lambda c, *names: F.transform(c, lambda x: F.concat_ws("\t", *[x[n].cast("string") for n in names]))
    text = lambda name: F.struct(F.lit(name).alias("key"), _value(s=F.col(name)).alias("value"), F.col(name).isNotNull().alias("has"))
    number = lambda name: F.struct(F.lit(name).alias("key"), _value(i=F.coalesce(F.col(name), F.lit(0))).alias("value"), F.lit(True).alias("has"))
    many = lambda name, c: F.struct(F.lit(name).alias("key"), _value(l=c).alias("value"), (F.coalesce(F.size(c), F.lit(0)) > 0).alias("has"))
    fields = F.array(
        text("kind"), text("name"), text("visibility"), number("start_line"), number("end_line"), text("signature"), text("return_type"), many("calls", F.col("calls")),
        many("type_refs", F.col("types")), many("string_args", packed(F.col("string_args"), "a", "b")), many("param_flows", packed(F.col("param_flows"), "a", "b")), many("local_types", packed(F.col("local_types"), "a", "b")),
    )
    return F.map_from_entries(F.transform(F.filter(fields, lambda f: f.has), lambda f: F.struct(f.key, f.value)))


def xorshift(state: Column) -> Column:
    """The next state of a 64-bit xorshift generator (13, 7, 17); 0 counts as 1."""
    x = F.when(state == 0, F.lit(1)).otherwise(state).cast("long")
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def level(u: Column, m: int = 16, most: int = 255) -> Column:
    """The layer of a node in a proximity graph for a uniform number in (0, 1]."""
    return F.least(F.floor(-F.ln(u) / F.ln(F.lit(float(m)))), F.lit(most)).cast("int")


def gaps(neighbours: Column) -> Column:
    """A list of distinct neighbours as its sorted first one and the gaps after it: small numbers for the file format's own delta and variable-length encodings."""
    s = F.array_sort(F.array_distinct(neighbours))
    return F.transform(s, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(s, F.greatest(i, F.lit(1)))))


def from_gaps(deltas: Column) -> Column:
    return F.transform(deltas, lambda x, i: F.aggregate(F.slice(deltas, 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y))
