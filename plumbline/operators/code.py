"""Views of code structure: declarations (id, name, kind, file, line, offset) and
relations (from, to, type, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.walk import cut


def declaration_ids(decls: DataFrame) -> DataFrame:
    """Declarations with ids; equal names of one file are told apart by a number in
    order of place, the first has none."""
    n = F.row_number().over(Window.partitionBy("file", "name").orderBy("line", "offset")) - 1
    base = F.concat(F.lit("symbol:"), "file", F.lit("#"), "name")
    return decls.withColumn("ordinal", n).withColumn("id", F.when(F.col("ordinal") == 0, base).otherwise(F.concat(base, F.lit("~"), F.col("ordinal").cast("string"))))


def label(node_id: Column) -> Column:
    """A short name: of a symbol the owner's last part and the method, of a column the
    table and column, of others the key."""
    kind, key = F.substring_index(node_id, ":", 1), F.regexp_replace(node_id, "^[^:]*:", "")
    owner = F.regexp_extract(key, r"([^./#]+)#", 1)
    return F.when((kind == "symbol") & key.contains("#"), F.concat(owner, F.lit("."), F.substring_index(key, "#", -1))).when(kind == "column", F.concat_ws(".", F.element_at(F.split(key, r"\."), -2), F.element_at(F.split(key, r"\."), -1))).otherwise(key)


def matches(decls: DataFrame, query: str) -> DataFrame:
    """Declarations whose name or file holds the query, whatever the case."""
    q = query.lower()
    return decls.where(F.lower("name").contains(q) | F.lower("file").contains(q))


def outline(decls: DataFrame, file: str) -> DataFrame:
    return decls.where(F.col("file") == file).orderBy("line", "offset", "id")


def ranked(decls: DataFrame, query: str) -> DataFrame:
    """Matches with a score: an equal name 100, a name that holds the query 20, a file 5."""
    q = query.lower()
    score = F.when(F.lower("name") == q, 100).otherwise(0) + F.when(F.lower("name").contains(q), 20).otherwise(0) + F.when(F.lower("file").contains(q), 5).otherwise(0)
    return matches(decls, query).withColumn("score", score)


def filled(rows: DataFrame, order: list[Column], budget: int, limit: int = 20) -> DataFrame:
    """The first of ``limit`` rows whose JSON fits the budget of bytes together. The
    ``limit`` rows are taken first, so the running sum is one small window."""
    few = rows.orderBy(*order).limit(limit)
    size = F.octet_length(F.to_json(F.struct(*rows.columns))) + 1
    return few.withColumn("_upto", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_upto") <= budget).drop("_upto")


def snippets(files: DataFrame, wanted: DataFrame, most_bytes: int = 4096) -> DataFrame:
    """Lines ``first`` to ``last`` of files (file, content) as they were when hashed:
    where the content's sha256 isn't the wanted one there is no text but ``changed``."""
    j = wanted.join(files, "file", "left")
    same = F.sha2(F.col("content"), 256) == F.col("sha256")
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n")
    state = F.when(F.col("content").isNull(), "missing").when(same, "current").otherwise("changed")
    return j.select("file", "first", "last", state.alias("state"), F.when(same, F.left(text, F.lit(most_bytes))).alias("text"))


def architecture(relations: DataFrame, module_of: DataFrame, examples: int = 3) -> tuple[DataFrame, DataFrame]:
    """Dependencies of modules (id, module): relations of each type, by grade, with the
    first examples; and relations whose other end no module holds."""
    m = module_of.select("id", "module").distinct()
    j = relations.join(m.select(F.col("id").alias("from"), F.col("module").alias("from_module")), "from", "left").join(m.select(F.col("id").alias("to"), F.col("module").alias("to_module")), "to", "left")
    whole = j.where("from_module is not null and to_module is not null and from_module <> to_module")
    n = whole.groupBy("from_module", "to_module", "type", "rank").agg(F.count("*").alias("n"), F.min("from").alias("x"))
    grades = n.groupBy("from_module", "to_module", "type").agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("string"), "n")))).alias("grades"))
    pair = F.concat("from", F.lit(" -> "), "to")
    w = Window.partitionBy("from_module", "to_module", "type").orderBy("pair")
    shown = whole.withColumn("pair", pair).select("from_module", "to_module", "type", "pair").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples)
    shown = shown.groupBy("from_module", "to_module", "type").agg(F.sort_array(F.collect_list("pair")).alias("examples"))
    return grades.join(shown, ["from_module", "to_module", "type"]), j.where("from_module is null or to_module is null").select("from", "to", "type")


def traced(relations: DataFrame, start: str, depth: int, direction: str = "outbound") -> DataFrame:
    """(direction, from, to, type, hops): relations met from a declaration, each once
    with its fewest hops; ``both`` walks either way apart."""
    if not 1 <= depth <= 8:
        raise ValueError("depth must be 1 to 8")
    if direction == "both":
        return traced(relations, start, depth, "outbound").unionByName(traced(relations, start, depth, "inbound"))
    a, b = ("from", "to") if direction == "outbound" else ("to", "from")
    r = cut(relations.select("from", "to", "type").distinct())
    front, out = relations.sparkSession.createDataFrame([(start,)], "at string"), None
    seen = front
    for k in range(1, depth + 1):
        step = cut(r.join(front, F.col(a) == F.col("at"), "left_semi").withColumn("hops", F.lit(k)))
        out = step if out is None else out.unionByName(step)
        front = cut(step.select(F.col(b).alias("at")).distinct().join(seen, "at", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return out.groupBy("from", "to", "type").agg(F.min("hops").cast("int").alias("hops")).withColumn("direction", F.lit(direction))


def applied_rules(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule, gave, edges, nodes, types): what each rule gave, by evidence of edges
    (rule, type) and marks of nodes (id, rules array)."""
    e = edges.where("rule is not null").groupBy("rule").agg(F.count("*").alias("edges"), F.sort_array(F.collect_set("type")).alias("types"))
    n = nodes.select("id", F.explode(F.array_distinct("rules")).alias("rule")).groupBy("rule").agg(F.count("*").alias("nodes"))
    j = e.join(n, "rule", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select("rule", (zero("edges") + zero("nodes")).alias("gave"), zero("edges").alias("edges"), zero("nodes").alias("nodes"), F.array_join(F.coalesce("types", F.array()), ",").alias("types"))


def listed_rules(rules: DataFrame, applied: DataFrame, kind: str | None = None, here: bool = False, query: str | None = None) -> DataFrame:
    """Rules (rule, kind, summary) with what they gave here, most first."""
    r = rules.join(applied.select("rule", "gave"), "rule", "left").withColumn("gave", F.coalesce("gave", F.lit(0)))
    if kind:
        r = r.where(F.col("kind") == kind)
    if here:
        r = r.where("gave > 0")
    if query:
        r = r.where(F.lower(F.concat_ws(" ", "rule", "summary")).contains(query.lower()))
    return r.orderBy(F.desc("gave"), "rule")


def bounded(lists: dict[str, list], budget: int, limit: int) -> tuple[dict[str, list], dict[str, int]]:
    """Rows of small lists taken in turn until their JSON fills the budget, and how
    many of each were left out; the last are taken back while it doesn't fit."""
    import json

    out: dict[str, list] = {k: [] for k in lists}
    size = lambda: len(json.dumps(out, separators=(",", ":"), ensure_ascii=False).encode())
    shut = set()
    for i in range(limit):
        for k, rows in lists.items():
            if k in shut or i >= len(rows):
                continue
            out[k].append(rows[i])
            if size() > budget:
                out[k].pop()
                shut.add(k)
    return out, {k: len(rows) - len(out[k]) for k, rows in lists.items()}
