"""Call graphs: resolution of names and places to symbols, traversal, context, dead code and statistics.

Nodes have idx, name, kind, file, is_test, ...; edges have src, dst and call_line.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.checkpoints import settled
from larkspur.errors import InvalidArgument
from larkspur.functions import text as T

VISIBILITY = r"^(pub\([^)]*\)|pub|export)\s+"


def crate_of(name: Column) -> Column:
    return F.substring_index(name, "::", 1)


def short_name(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def plain_name(name: Column) -> Column:
    """Without visibility and closure suffixes."""
    return F.regexp_replace(F.regexp_replace(name, VISIBILITY, ""), r"(::\{closure#\d+\})+.*$", "")


WRAPPERS = r"(?i)^(result|option|box|arc|rc|vec)$"


def _bare(t: Column) -> Column:
    """Without a reference, a lifetime, and mut, dyn or impl."""
    return F.regexp_replace(t, r"^&?('[^ ]* )?(mut )?(dyn )?(impl )?", "")


def leaf_type(t: Column) -> Column:
    """The type's own name without generics; that of the first type inside Result, Option, Box, Arc, Rc and Vec."""
    bare = _bare(t)
    outer = F.trim(F.substring_index(bare, "<", 1))
    inside = F.trim(F.substring_index(F.regexp_replace(F.regexp_replace(bare, r"^[^<]*<?", ""), r">+$", ""), ",", 1))
    inner = F.trim(F.substring_index(F.regexp_replace(inside, r"^&?(mut )?", ""), "<", 1))
    return F.when(outer.rlike(WRAPPERS) & (inner != "") & (inner != outer), inner).otherwise(outer)


def owning_type(name: Column) -> Column:
    """The lower-cased last part of the path before a name ("Trait for Type" gives the type); null for a bare name."""
    before = F.regexp_extract(name, r"^(.*)::", 1)
    leaf = F.substring_index(F.substring_index(before, "::", -1), " for ", -1)
    return F.when(F.contains(name, F.lit("::")), F.lower(F.substring_index(leaf, "<", 1)))


def without_generics(name: Column) -> Column:
    """Without anything in angle brackets, up to four of them deep."""
    for _ in range(4):
        name = F.regexp_replace(name, r"<[^<>]*>", "")
    return name


def generic_bounds(signature: Column) -> Column:
    """[{a: type parameter, b: its first bound}, ...] of the angle brackets and of the where clause, in lower case.

    Lifetimes and constants are left out; a parameter bound in the brackets is not taken from the clause again.
    """
    flat = signature
    for _ in range(4):  # commas inside nested brackets do not part parameters
        flat = F.regexp_replace(flat, r"(<[^<>]*)<[^<>]*>", "$1")
    none = F.array().cast("array<struct<a:string,b:string>>")

    def bounds(text: Column) -> Column:
        kept = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: ~x.rlike(r"^('|const )") & F.contains(x, F.lit(":")))
        made = F.transform(kept, lambda x: F.struct(
            F.lower(F.trim(F.substring_index(x, ":", 1))).alias("a"), F.lower(F.trim(F.substring_index(F.substring_index(F.regexp_replace(x, r"^[^:]*:", ""), "+", 1), "<", 1))).alias("b"),
        ))
        return F.coalesce(F.filter(made, lambda p: ~p.b.isin("", "?")), none)

    head = bounds(F.regexp_extract(flat, r"^[^<]*<([^>]*)>", 1))
    where = bounds(F.regexp_replace(F.regexp_extract(signature, r"(?i)\bwhere (.*)$", 1), r"\s*\{\s*", ""))
    return F.concat(head, F.filter(where, lambda p: ~F.exists(head, lambda q: q.a == p.a)))


# ---------------------------------------------------------------- resolution
def resolve_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of that name in any case; only if there is none, nodes whose path ends in it."""
    low = F.lower("name")
    ranked = nodes.withColumn("match", F.when(low == name.lower(), 0).when(low.endswith("::" + name.lower()), 1)).where("match IS NOT NULL")
    best = ranked.agg(F.min("match").alias("best"))  # one row
    return ranked.join(F.broadcast(best), F.col("match") == F.col("best")).drop("match", "best")


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, exact, idx): the last node of an exact name, the first of a short one."""
    exact = nodes.groupBy(F.lower("name").alias("key")).agg(F.max("idx").alias("idx")).withColumn("exact", F.lit(True))
    short = nodes.groupBy(F.lower(short_name(F.col("name"))).alias("key")).agg(F.min("idx").alias("idx")).withColumn("exact", F.lit(False))
    return exact.unionByName(short)


def edges_by_name(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """calls(src, callee, call_line) resolved by exact, else short name; no self-edges, one edge a pair (least line)."""
    index = name_index(nodes)
    c = calls.withColumn("k", F.lower("callee")).withColumn("s", F.lower(short_name(F.col("callee"))))
    exact = index.where("exact").select(F.col("key").alias("k"), F.col("idx").alias("e"))
    short = index.where("NOT exact").select(F.col("key").alias("s"), F.col("idx").alias("sh"))
    found = c.join(exact, "k", "left").join(short, "s", "left").select("src", F.coalesce("e", "sh").alias("dst"), "call_line")
    return dedup_edges(found)


def same_files(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, file): for each path of asked(file) the equal paths of known(file) in any case, else those one of which ends in the other.

    Ends are joined by equality on all ends of the distinct paths, whose number is that of their characters.
    """
    def ends(df: DataFrame) -> DataFrame:
        return df.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.length("file")), lambda i: F.substring("file", i, F.length("file")))).alias("end"))

    a, k = asked.select("file").where("file <> ''").distinct(), known.select("file").where("file <> ''").distinct()
    exact = a.join(k.select(F.col("file").alias("found")), F.lower("file") == F.lower("found")).select("file", "found")
    rest = a.join(exact.select("file"), "file", "left_anti")
    shorter = ends(rest).join(k.select(F.col("file").alias("end")), "end").select("file", F.col("end").alias("found"))
    longer = ends(k).select(F.col("file").alias("found"), "end").join(rest.select("file", F.col("file").alias("end")), "end").select("file", "found")
    return exact.unionByName(shorter).unionByName(longer).distinct().select(F.col("file").alias("asked"), F.col("found").alias("file"))


def edges_by_place(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """raw(src, callee, callee_file, callee_start_line, line): by file (equal, else one path's end) and line (exact, then one line off), else by name.

    Nullable places fall through to the name; of several places the first path and the smallest node win.
    """
    near = settled(raw.withColumn("rid", F.monotonically_increasing_id()), "raw-edges")
    located = near.where("callee_file IS NOT NULL AND callee_start_line IS NOT NULL").select("rid", F.col("callee_file").alias("asked"), "callee_start_line")
    files = same_files(located.select(F.col("asked").alias("file")), nodes)
    tried = located.join(files, "asked").select(
        "rid", "file", F.explode(F.array(*[F.struct((F.col("callee_start_line") + d).alias("start_line"), F.lit(p).alias("p")) for p, d in ((0, 0), (1, 1), (2, -1))])).alias("t")
    ).select("rid", "file", F.col("t.start_line").cast("int").alias("start_line"), F.col("t.p").alias("p"))
    # of the nodes of a place only the smallest can win, so a place of many costs no more than one
    first = nodes.groupBy("file", F.col("start_line").cast("int").alias("start_line")).agg(F.min("idx").alias("idx"))
    placed = tried.join(first, ["file", "start_line"]).groupBy("rid").agg(F.min(F.struct("file", "p", "idx")).alias("b")).select("rid", F.col("b.idx").alias("dst"))
    rest = near.join(placed, "rid", "left_anti")
    named = edges_by_name(nodes, rest.select("src", F.col("callee"), F.col("line").alias("call_line")))
    return dedup_edges(near.join(placed, "rid").select("src", "dst", F.col("line").alias("call_line")).unionByName(named))


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.where("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.min("call_line").alias("call_line"))


def type_edges(nodes: DataFrame) -> DataFrame:
    """Edges from symbols to the types they name (column types), without call lines."""
    refs = nodes.select(F.col("idx").alias("src"), F.explode("types").alias("callee")).withColumn("call_line", F.lit(0))
    return edges_by_name(nodes, refs)


def trait_impls(nodes: DataFrame) -> DataFrame:
    """(trait, impl) of idx: impls named "Trait for Type" or "<Type as Trait>", their trait found by its whole name, else by its last part."""
    low = F.lower("name")
    named = F.when(F.contains(low, F.lit(" for ")), F.substring_index(low, " for ", 1)).when(low.startswith("<") & F.contains(low, F.lit(" as ")), F.regexp_replace(F.regexp_replace(low, r"^.*? as ", ""), r">$", ""))
    impls = nodes.where("kind = 'impl'").select(F.col("idx").alias("impl"), named.alias("callee")).where("callee IS NOT NULL")
    index = name_index(nodes)
    exact = index.where("exact").select(F.col("key").alias("callee"), F.col("idx").alias("e"))
    short = index.where("NOT exact").select(F.col("key").alias("leaf"), F.col("idx").alias("s"))
    found = impls.withColumn("leaf", short_name(F.col("callee"))).join(exact, "callee", "left").join(short, "leaf", "left")
    return found.select(F.coalesce("e", "s").alias("trait"), "impl").where("trait IS NOT NULL").distinct()


def method_impls(nodes: DataFrame) -> DataFrame:
    """(idx, impl): functions whose path before their name is a trait's impl block; of equal blocks the last."""
    blocks = nodes.where("kind = 'impl'").where(F.contains(F.lower("name"), F.lit(" for "))).groupBy(F.lower("name").alias("parent")).agg(F.max("idx").alias("impl"))
    own = nodes.where("kind = 'function' AND name LIKE '%::%'").select("idx", F.regexp_extract(F.lower("name"), r"^(.*)::", 1).alias("parent"))
    return own.join(blocks, "parent").select("idx", "impl")


def field_access(nodes: DataFrame) -> DataFrame:
    """(key "type::field", idx), in lower case: receivers typed by self, then parameters, then locals, the first of each."""
    acc = nodes.select("idx", "name", F.explode("field_accesses").alias("a")).select("idx", "name", F.lower("a.a").alias("recv"), F.lower("a.b").alias("field"))
    typed = acc.where("recv = 'self'").select("idx", "recv", "field", F.lit(0).alias("p"), F.lit(0).alias("at"), owning_type(F.col("name")).alias("t"))
    for p, column in ((1, "param_types"), (2, "local_types")):
        own = nodes.select("idx", F.posexplode(column).alias("at", "d")).select("idx", "at", F.lower("d.a").alias("recv"), leaf_type(F.lower("d.b")).alias("t")).where("t <> ''")
        own = own if p == 2 else own.where("recv <> 'self'")
        typed = typed.unionByName(acc.join(own, ["idx", "recv"]).select("idx", "recv", "field", F.lit(p).alias("p"), "at", "t"))
    best = typed.where("t IS NOT NULL").groupBy("idx", "recv", "field").agg(F.min(F.struct("p", "at", "t")).alias("b"))
    return best.select(F.concat("b.t", F.lit("::"), "field").alias("key"), "idx").distinct()


# ---------------------------------------------------------------- traversal
def bfs(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(idx, depth) of everything within `depth` steps of the seeds, at its least distance; seeds at 0.

    Each level is one join of the frontier with the edges and an anti-join with what was seen, and ends
    in a table in the shared folder, so the plan does not grow with the depth.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(a).cast("long").alias("idx"), F.col(b).cast("long").alias("next")).distinct()
    seen = settled(seeds.select(F.col("idx").cast("long").alias("idx")).distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.select("idx").join(steps, "idx").select(F.col("next").alias("idx")).distinct()
        frontier = settled(reached.join(seen.select("idx"), "idx", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def expand_traits(seeds: DataFrame, impls: DataFrame) -> DataFrame:
    """The seeds, the impls of seed traits and the traits of seed impls: one hop."""
    down = seeds.select(F.col("idx").alias("trait")).join(impls, "trait").select(F.col("impl").alias("idx"))
    up = seeds.select(F.col("idx").alias("impl")).join(impls, "impl").select(F.col("trait").alias("idx"))
    return seeds.select("idx").unionByName(down).unionByName(up).distinct()


def _tagged(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, scope: str | None, tests: bool, first: str) -> DataFrame:
    reached = bfs(edges, seeds, 2 if depth == 1 else depth, reverse=True).join(nodes.select(F.col("idx").cast("long").alias("idx"), "name", "file", "is_test"), "idx")
    counts = reached.where("depth > 0").agg(F.count_if(~F.col("is_test")).alias("prod"), F.count_if("is_test").alias("test"))
    tag = F.when(F.col("depth") == 0, first).when(F.col("depth") <= 2, F.concat(F.lit("d"), F.col("depth").cast("string"))).otherwise("d3+")
    out = reached.crossJoin(F.broadcast(counts)).withColumn("tag", tag)  # counts is one row
    if scope:
        out = out.where(F.contains(F.col("file"), F.lit(scope)))
    return out if tests else out.where(~F.col("is_test"))


def blast(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, scope: str | None = None, tests: bool = True, impls: DataFrame | None = None) -> DataFrame:
    """idx, depth, tag, is_test, prod and test (counts before filters) of what a change of the seeds reaches.

    With impls (trait_impls) the seeds are first widened by one hop between traits and their impls.
    """
    return _tagged(nodes, edges, seeds if impls is None else expand_traits(seeds, impls), depth, scope, tests, "target")


def field_blast(nodes: DataFrame, edges: DataFrame, field: str, depth: int = 2, scope: str | None = None, tests: bool = True, accesses: DataFrame | None = None) -> DataFrame:
    """The same from "Type.field": its accessors are the seeds, tagged as field."""
    if "." not in field:
        raise InvalidArgument(f"{field!r} is not Type.field")
    key = field.lower().replace(".", "::", 1)
    seeds = (field_access(nodes) if accesses is None else accesses).where(F.col("key") == key).select("idx")
    return _tagged(nodes, edges, seeds, depth, scope, tests, "field")


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """One row with the shortest undirected path from any source to any target (the smallest of equal ones), or none.

    The search ends at a target or when nothing new is reached, or, if asked to, after `most` steps.
    """
    both = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    both = settled(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "undirected")
    goal = targets.select(F.col("idx").cast("long").alias("idx")).distinct()
    frontier = settled(sources.select(F.col("idx").cast("long").alias("idx")).distinct().select("idx", F.array("idx").alias("path")), "path")
    seen = frontier.select("idx")
    for step in count() if most is None else range(most + 1):
        hit = frontier.join(goal, "idx", "left_semi").agg(F.min("path").alias("path")).where("path IS NOT NULL")
        if not hit.isEmpty() or frontier.isEmpty():
            return hit
        grown = frontier.join(both, F.col("idx") == F.col("a")).select(F.col("b").alias("idx"), F.concat("path", F.array("b")).alias("path"))
        frontier = settled(grown.join(seen, "idx", "left_anti").groupBy("idx").agg(F.min("path").alias("path")), "path")
        seen = seen.unionByName(frontier.select("idx"))
        if step % 16 == 15:  # else the plan grows with the distance
            seen = settled(seen, "seen")
    return frontier.where("false").select("path")


def flow_tree(edges: DataFrame, roots: int | Sequence[int], depth: int, skip: set[int] = frozenset()) -> list[tuple[int, int, bool]]:
    """(level, idx, repeated) in preorder: Spark fetches all edges of the nodes to expand, the tree is drawn on the driver.

    Children come in the order of their call lines (then idx) where edges have them. A node is expanded
    where it is first met, in preorder over all roots; wherever else it is met it is a leaf, repeated. The
    driver holds the edges; more than spark.driver.maxResultSize of them is an error, none is left out.
    """
    spark = edges.sparkSession
    roots = [roots] if isinstance(roots, int) else list(roots)
    line = F.col("call_line") if "call_line" in edges.columns else F.lit(0)
    edges = edges.select("src", "dst", line.alias("line"))
    edges = edges.where(~F.col("dst").isin(*skip)) if skip else edges
    near = bfs(edges, spark.createDataFrame([(r,) for r in roots], "idx long"), max(0, depth - 1)).where(F.col("depth") < depth)
    rows = edges.join(near.select(F.col("idx").alias("src")), "src", "left_semi").groupBy("src", "dst").agg(F.min("line").alias("line")).orderBy("src", "line", "dst").collect()
    children: dict[int, list[int]] = {}
    for r in rows:
        children.setdefault(r["src"], []).append(r["dst"])
    out: list[tuple[int, int, bool]] = []
    met: set[int] = set()
    for root in roots:
        stack = [(0, root)]
        while stack:
            level, node = stack.pop()
            again = level > 0 and node in met
            out.append((level, node, again))
            met.add(node)
            if not again and level < depth:
                stack += [(level + 1, c) for c in reversed(children.get(node, []))]
    return out


ROLES = ("definition", "caller", "callee", "type", "test")


def context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """idx, role and call_line around the seeds; a node in several roles keeps the first of ROLES."""
    flags = nodes.select(F.col("idx").cast("long").alias("idx"), "is_test", "kind")
    s = seeds.select(F.col("idx").cast("long").alias("idx")).distinct()
    up = bfs(edges, s, depth, reverse=True).where("depth > 0").join(flags, "idx")
    down = bfs(edges, s, depth).where("depth > 0").join(flags, "idx")
    typed = F.col("kind").isin("struct", "enum", "trait", "type")
    parts = [
        s.select("idx", F.lit(0).alias("p")),
        up.select("idx", F.when(F.col("is_test"), 4).otherwise(1).alias("p")),
        down.where("NOT is_test").select("idx", F.when(typed, 3).otherwise(2).alias("p")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("idx").agg(F.min("p").alias("p"))
    lines = edges.join(s.select(F.col("idx").alias("dst")), "dst", "left_semi").groupBy(F.col("src").cast("long").alias("idx")).agg(F.min("call_line").alias("call_line"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("p") + 1)
    return every.join(lines, "idx", "left").select("idx", role.alias("role"), F.coalesce("call_line", F.lit(0)).alias("call_line"))


def dead_code(nodes: DataFrame, edges: DataFrame, include_public: bool = False, file_part: str | None = None) -> DataFrame:
    """Functions nothing calls: no tests, derives, entry points, trait methods, macro checks or (unless asked for) public ones.

    nodes has signature, in_trait (the function implements a trait) and n_callees besides.
    """
    name = F.col("name")
    out = nodes.where((F.col("kind") == "function") & ~F.col("is_test")).where(~name.rlike(r"^<.* as .*(Debug|Clone|PartialEq|Eq|Hash|Default|Ord|PartialOrd|Serialize|Deserialize)>"))
    if file_part:
        out = out.where(F.contains(F.col("file"), F.lit(file_part)))
    out = out.join(edges.select(F.col("dst").alias("idx")).distinct(), "idx", "left_anti")
    if not include_public:
        out = out.where(~F.coalesce(F.col("signature").rlike(r"^(pub |pub\(crate\))"), F.lit(False)))
    called = edges.groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("n_callees"))
    out = out.where(~F.col("in_trait")).where(~((name == "main") | name.endswith("::main") | name.endswith("::run"))).where(F.col("file").endswith(".rs"))
    out = out.where(~(F.contains(name, F.lit("::check::assert_impl")) | F.contains(name, F.lit("::{closure#0}::check"))))
    return out.join(called, "idx", "left").where(~(name.endswith("::new") & F.col("n_callees").isNull())).drop("n_callees")


def crate_stats(nodes: DataFrame) -> DataFrame:
    """Counts of functions, test functions, structs and enums by crate, and a total row with a null crate."""
    fn = F.col("kind") == "function"
    return nodes.rollup(crate_of(F.col("name")).alias("crate")).agg(
        F.count_if(fn & ~F.col("is_test")).alias("prod_fn"), F.count_if(fn & F.col("is_test")).alias("test_fn"),
        F.count_if(F.col("kind") == "struct").alias("structs"), F.count_if(F.col("kind") == "enum").alias("enums"),
    )


def coverage(functions: DataFrame, counted: bool = False) -> DataFrame:
    """functions(crate, covered), or counts(crate, covered, total): covered, total and percent by crate, and the total with a null crate."""
    total, hit = (F.sum("total"), F.sum("covered")) if counted else (F.count("*"), F.count_if("covered"))
    return functions.rollup("crate").agg(hit.alias("covered"), total.alias("total"), F.round(F.try_divide(hit * 100.0, total), 4).alias("percent"))


def path_aliases(nodes: DataFrame) -> DataFrame:
    """(folder, alias): letters for the folders of files, most used first; after Z come AA, AB, ..."""
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    ranked = nodes.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).where("folder <> ''")
    r = F.row_number().over(Window.orderBy(F.desc("n"), "folder")) - 1  # one row a folder
    letter = lambda c: F.chr(F.lit(65) + c)
    return ranked.withColumn("r", r).select("folder", F.when(F.col("r") < 26, letter(F.col("r"))).otherwise(F.concat(letter(F.floor(F.col("r") / 26) - 1), letter(F.col("r") % 26))).alias("alias"))


def neighbour_jaccard(edges: DataFrame, pairs: DataFrame, callers: bool = False) -> DataFrame:
    """a, b, j of the sets of callees, or callers (1 if both are empty), and verdict SAFE (1), REVIEW (0.5 and more) or DIFFERENT."""
    own, other = ("dst", "src") if callers else ("src", "dst")
    sets = edges.groupBy(F.col(own).alias("k")).agg(F.collect_set(other).alias("c"))
    none = F.array().cast("array<long>")
    j = pairs.join(sets.select(F.col("k").alias("a"), F.col("c").alias("ca")), "a", "left").join(sets.select(F.col("k").alias("b"), F.col("c").alias("cb")), "b", "left")
    ca, cb = F.coalesce(F.col("ca").cast("array<long>"), none), F.coalesce(F.col("cb").cast("array<long>"), none)
    union = F.size(F.array_union(ca, cb))
    out = j.select("a", "b", F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(ca, cb)) / union), 6).alias("j"))
    return out.withColumn("verdict", F.when(F.col("j") >= 1, "SAFE").when(F.col("j") >= 0.5, "REVIEW").otherwise("DIFFERENT"))


def merge_safety(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, callee_j, caller_j, prod, test (within two calls of either, but not of itself) and verdict of pairs(a, b)."""
    p = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    up = edges.select(F.col("dst").cast("long").alias("at"), F.col("src").cast("long").alias("by")).distinct()
    one = p.select("a", "b", F.explode(F.array("a", "b")).alias("seed")).join(up, F.col("seed") == F.col("at")).select("a", "b", "seed", F.col("by").alias("idx"))
    two = one.join(up, F.col("idx") == F.col("at")).select("a", "b", "seed", F.col("by").alias("idx"))
    reached = one.unionByName(two).where("idx <> seed").select("a", "b", "idx").distinct().join(nodes.select(F.col("idx").cast("long").alias("idx"), "is_test"), "idx")
    counts = reached.groupBy("a", "b").agg(F.count_if(~F.col("is_test")).alias("prod"), F.count_if("is_test").alias("test"))
    down, above = neighbour_jaccard(edges, p), neighbour_jaccard(edges, p, callers=True)
    out = down.withColumnRenamed("j", "callee_j").join(above.select("a", "b", F.col("j").alias("caller_j")), ["a", "b"]).join(counts, ["a", "b"], "left")
    return out.select("a", "b", "callee_j", "caller_j", F.coalesce("prod", F.lit(0)).alias("prod"), F.coalesce("test", F.lit(0)).alias("test"), "verdict")


SOURCE_ENDS = (".rs", ".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".c", ".cpp", ".cc", ".h", ".hpp", ".java", ".kt", ".cs", ".rb", ".swift")


def symbols(nodes: DataFrame, name: str | None = None, kind: str | None = None, tests: bool = False, limit: int | None = None) -> DataFrame:
    """The nodes whose name contains `name` in any case, or whose file ends in it if it looks like a path; by file and idx."""
    out = nodes
    if name is not None and (name.endswith(SOURCE_ENDS) or "/" in name):
        out = out.where(F.col("file").endswith(name) | F.col("file").endswith(name.replace("\\", "/")))
    elif name is not None:
        out = out.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if kind is not None:
        out = out.where(F.lower("kind") == kind.lower())
    if not tests:
        out = out.where(~(F.col("is_test") | T.is_test_path(F.col("file"))))
    out = out.orderBy("file", "idx")
    return out if limit is None else out.limit(limit)


def callees_at(calls: DataFrame, file: str, line: int) -> DataFrame:
    """callee of the call edges (readers.read_edges) at a place; paths are compared with forward slashes and without a leading ./"""
    plain = F.regexp_replace(F.replace("caller_file", F.lit("\\"), F.lit("/")), r"^\./", "")
    return calls.where((plain == file.replace("\\", "/").removeprefix("./")) & (F.col("line") == line)).select("callee").distinct()


def callees_of(calls: DataFrame, caller: str) -> DataFrame:
    return calls.where(F.col("caller") == caller).select("callee", "callee_file", "callee_start_line", "line")


def callers_in(calls: DataFrame, crate: str) -> DataFrame:
    """Distinct callers of a crate of calls with a crate column."""
    return calls.where(F.col("crate") == crate).select("caller").distinct()


def merge_chunks(existing: DataFrame, new: DataFrame, live: DataFrame, file: str = "file") -> DataFrame:
    """New chunks, and the existing ones of files that are still live(file) and have none new; state is new or kept."""
    kept = existing.join(new.select(file).distinct(), file, "left_anti").join(live.select(file).distinct(), file, "left_semi")
    return new.withColumn("state", F.lit("new")).unionByName(kept.select(*existing.columns).withColumn("state", F.lit("kept")).select(*new.columns, "state"))


def own_files(chunks: DataFrame, file: str = "file") -> DataFrame:
    """Without chunks of packages' caches and toolchains."""
    return chunks.where(~F.col(file).rlike(r"\.cargo|registry|rustup"))


def fingerprints(chunks: DataFrame) -> DataFrame:
    """(crate, fingerprint) over names, files and lines, whatever the order of chunks; combined before the shuffle."""
    h = F.xxhash64("name", "file", F.col("start_line").cast("long"), F.col("end_line").cast("long"))
    return chunks.groupBy(crate_of(F.col("name")).alias("crate")).agg(F.concat_ws("-", F.count("*").cast("string"), F.hex(F.bit_xor(h)), F.sum(F.shiftright(h, 32)).cast("string")).alias("fingerprint"))


def stale_crates(before: DataFrame, now: DataFrame) -> DataFrame:
    """The crates of `now` whose fingerprint `before` lacks: those whose edges are to be made again."""
    return now.join(before, ["crate", "fingerprint"], "left_anti").select("crate")


def called_by(nodes: DataFrame) -> DataFrame:
    """(idx, called_by): who names a symbol in its calls, matched on bare names."""
    calls = nodes.select("name", F.explode("calls").alias("c")).select(F.lower(short_name(F.col("c"))).alias("k"), F.col("name").alias("caller"))
    own = nodes.select("idx", F.lower(short_name(F.col("name"))).alias("k"), F.col("name"))
    return own.join(calls, "k").where("caller <> name").groupBy("idx").agg(F.sort_array(F.collect_set("caller")).alias("called_by"))


def prefer_production(chunks: DataFrame, *ties: str) -> DataFrame:
    """One row per (file, name), production before test, then the earliest line, then by `ties`."""
    w = Window.partitionBy("file", "name").orderBy("is_test", "start_line", "end_line", *ties)
    return chunks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "cpp": "cpp"}


def symbol_tags(nodes: DataFrame) -> Column:
    """kind:, lang:, vis:, role: and caller: tags of symbols with kind, file, signature, is_test and called_by."""
    extension = F.lower(F.substring_index("file", ".", -1))
    language = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension), F.lit("other"))
    visible = F.when(F.coalesce(F.col("signature"), F.lit("")).rlike(r"^(pub|export)\b"), "pub").otherwise("private")
    base = F.array(F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("lang:"), language), F.concat(F.lit("vis:"), visible), F.when(F.col("is_test"), "role:test").otherwise("role:prod"))
    return F.concat(base, F.transform(F.coalesce("called_by", F.array().cast("array<string>")), lambda c: F.concat(F.lit("caller:"), c)))


NOISE = ("unwrap", "expect", "clone", "to_string", "into", "iter", "collect", "map", "push", "len", "format", "println", "print", "append", "len", "Ok", "Err", "Some")


def unresolved_calls(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(idx, callee) of calls of the seeds that no symbol answers to; everyday library calls are left out."""
    calls = nodes.join(seeds.select("idx"), "idx", "left_semi").select("idx", F.explode("calls").alias("callee")).distinct()
    bare = F.lower(short_name(F.col("callee")))
    known = nodes.select(F.lower(short_name(F.col("name"))).alias("k")).distinct()
    return calls.where(~short_name(F.col("callee")).isin(*NOISE) & ~F.col("callee").rlike(r"^(std|core|alloc)::")).withColumn("k", bare).join(known, "k", "left_anti").select("idx", "callee")


def refresh_edges(edges: DataFrame, path: str) -> None:
    """Edges of some crates (column crate) replace those crates' partitions and leave the others alone."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crate").parquet(path)
