"""Rules that turn facts of the language lanes into graded edges. Each lane has its
own rule for facts that meet in one edge: weakest, strongest or first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.names import normal_route
from plumbline.operators.federate import routes_for
from plumbline.operators.walk import cut, multi_walk, union_all
from plumbline.plans.vocab import RANKS


def _edge(df: DataFrame, src: Column, dst: Column, kind: Column | str, rank: Column | int, **more: Column) -> DataFrame:
    k, r = (x if isinstance(x, Column) else F.lit(x) for x in (kind, rank))
    return df.select(src.alias("src"), dst.alias("dst"), k.alias("type"), r.cast("int").alias("rank"), *[c.alias(n) for n, c in more.items()])


def _id(kind: str, *cols: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), *[F.col(c).cast("string") for c in cols])


def route_handlers(routes: DataFrame) -> DataFrame:
    """HANDLES of (method, path, handler, rank): sure unless the route's rule says less."""
    r = routes.withColumn("e", F.concat_ws(" ", F.upper("method"), normal_route(F.col("path"))))
    return _edge(r, _id("endpoint", "e"), _id("symbol", "handler"), "HANDLES", F.coalesce("rank", F.lit(RANKS["EXACT"])))


def http_calls(calls: DataFrame, routes: DataFrame, unsure: str = "unsure") -> DataFrame:
    """CALLS_HTTP of (caller, method, path, ``unsure``) to the served route (endpoint,
    method, path): a sound set, a guess where the prefix, alias or verb is one. A call
    that no route serves leaves the pack: an outbound endpoint, unresolved."""
    c = calls.select(F.monotonically_increasing_id().alias("call_id"), F.lit("here").alias("project"), "caller", "method", normal_route(F.col("path")).alias("path"), F.col(unsure).alias("unsure"))
    c = cut(c)
    s = routes.select(F.lit("there").alias("project"), "method", normal_route(F.col("path")).alias("path"), "endpoint")
    j = c.join(routes_for(c.select("call_id", "project", "method", "path"), s).select("call_id", "endpoint", "rank"), "call_id", "left")
    outside = F.concat(F.lit("endpoint:"), F.coalesce(F.upper("method"), F.lit("ANY")), F.lit(" "), F.col("path"))
    rank = F.when(F.col("endpoint").isNull(), RANKS["UNRESOLVED"]).when(F.coalesce("unsure", F.lit(False)), RANKS["HEURISTIC"]).otherwise(F.col("rank"))
    return _edge(j, F.col("caller"), F.coalesce("endpoint", outside), "CALLS_HTTP", rank, outbound=F.col("endpoint").isNull())


def shifted(calls: DataFrame, routes: DataFrame, most: int = 8) -> DataFrame:
    """For calls (call_id, method, path) under an unread prefix: the route (endpoint,
    method, path) that fits once the fewest leading segments are dropped."""
    parts = F.filter(F.split(normal_route(F.col("path")), "/"), lambda s: s != "")
    drop = F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most)))).otherwise(F.array().cast("array<int>")))
    c = calls.select("call_id", "method", parts.alias("parts"), drop.alias("k"))
    c = c.select(F.struct("call_id", "k").alias("call_id"), F.lit("here").alias("project"), "method", F.concat(F.lit("/"), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), "/")).alias("path"))
    s = routes.select(F.lit("there").alias("project"), "method", normal_route(F.col("path")).alias("path"), "endpoint")
    got = routes_for(c, s).select("call_id.call_id", "call_id.k", "endpoint")
    return got.groupBy("call_id").agg(F.min(F.struct("k", "endpoint")).alias("b")).select("call_id", F.col("b.k").alias("dropped"), "b.endpoint")


def renders(facts: DataFrame) -> DataFrame:
    """RENDERS of (screen, component, how): declared is sure, imported a sound set, a
    registry's as its ``rank`` says."""
    rank = F.when(F.col("how") == "declared", RANKS["EXACT"]).when(F.col("how") == "imported", RANKS["SOUND_SET"]).otherwise(F.coalesce("rank", F.lit(RANKS["HEURISTIC"])))
    return _edge(facts, _id("screen", "screen"), _id("symbol", "component"), "RENDERS", rank)


def view_returns(facts: DataFrame) -> DataFrame:
    """RENDERS_PAGE of (handler, view): sure, and no flow."""
    return _edge(facts, _id("symbol", "handler"), F.concat(F.lit("screen:view:"), F.col("view")), "RENDERS_PAGE", RANKS["EXACT"]).distinct()


def recorded(pairs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls seen in a recording (src, dst, count): known edges with ``observed_count``
    added, and CALLS_HTTP edges that only the recording knows."""
    p = pairs.groupBy("src", "dst").agg(F.sum("count").alias("observed_count"))
    marked = edges.join(p, ["src", "dst"], "left").withColumn("observed", F.col("observed_count").isNotNull())
    new = p.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return marked, _edge(new, F.col("src"), F.col("dst"), "CALLS_HTTP", RANKS["RUNTIME_ONLY"], observed_count=F.col("observed_count"))


def traced(observed: DataFrame, edges: DataFrame, implementors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks of a trace (caller, callee, count) on edges: the edge itself, or that to
    an interface method which the callee implements (implementors: method, interface);
    and MAY_CALL edges, RUNTIME_ONLY, for hops that no edge explains."""
    o = observed.groupBy("caller", "callee").agg(F.sum("count").alias("n"))
    e = edges.select("src", "dst").distinct()
    direct = o.join(e, (F.col("caller") == F.col("src")) & (F.col("callee") == F.col("dst"))).select("caller", "callee", "src", "dst", "n", F.lit(True).alias("direct"))
    rest = o.join(direct.select("caller", "callee"), ["caller", "callee"], "left_anti")
    through = rest.join(implementors.select(F.col("method").alias("callee"), "interface").distinct(), "callee").join(e, (F.col("caller") == F.col("src")) & (F.col("interface") == F.col("dst"))).select("caller", "callee", "src", "dst", "n", F.lit(False).alias("direct"))
    marks = direct.unionByName(through)
    by_edge = marks.groupBy("src", "dst").agg(F.sum("n").alias("observed_count"), F.bool_or("direct").alias("direct"))
    new = rest.join(through.select("caller", "callee").distinct(), ["caller", "callee"], "left_anti")
    return by_edge, _edge(new, F.col("caller"), F.col("callee"), "MAY_CALL", RANKS["RUNTIME_ONLY"], observed_count=F.col("n"))


def transactional(symbols: DataFrame, marks: DataFrame) -> DataFrame:
    """Symbols (id, owner) with ``transactional``: marked themselves or by their owner
    (marks: target), the own mark's scope before the owner's."""
    m = marks.groupBy("target").agg(F.min("scope").alias("scope"))
    own = symbols.join(m.select(F.col("target").alias("id"), F.col("scope").alias("a"), F.lit(True).alias("ia")), "id", "left")
    both = own.join(m.select(F.col("target").alias("owner"), F.col("scope").alias("b"), F.lit(True).alias("ib")), "owner", "left")
    return both.select("id", "owner", F.coalesce("ia", "ib", F.lit(False)).alias("transactional"), F.when(F.col("ia"), F.col("a")).otherwise(F.col("b")).alias("tx_scope"))


# --- object-relational lanes ---------------------------------------------------------------------
def entity_tables(rows: DataFrame) -> DataFrame:
    """One EXECUTES of each (stmt, table): write before delete before read, and of
    equal accesses the weakest grade."""
    order = F.when(F.col("access") == "write", 3).when(F.col("access") == "delete", 2).otherwise(1)
    r = rows.groupBy("stmt", "table", "access", order.alias("o")).agg(F.min("rank").alias("rank"))
    return r.groupBy("stmt", "table").agg(F.max(F.struct("o", "access", "rank")).alias("b")).select("stmt", "table", "b.access", F.col("b.rank").cast("int").alias("rank"))


def first_columns(rows: DataFrame) -> DataFrame:
    """READS and WRITES of (stmt, type, column, seq): of several the first."""
    return rows.groupBy("stmt", "type", "column").agg(F.min_by("rank", "seq").cast("int").alias("rank"))


def entity_joins(rows: DataFrame) -> DataFrame:
    """JOINS of (a, b, seq): sorted pairs, none with itself, of several the first."""
    r = rows.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "rank", "seq")
    return r.groupBy("src", "dst").agg(F.min_by("rank", "seq").cast("int").alias("rank"))


def naming_rank(names: Column) -> Column:
    """Grade of a derived name from its spellings under all strategies (an array)."""
    return F.when(F.size(F.array_distinct(names)) == 1, RANKS["EXACT"]).otherwise(RANKS["HEURISTIC"])


def weakest_columns(rows: DataFrame) -> DataFrame:
    """(stmt, type, column): the weakest grade, and all roles in order."""
    return rows.groupBy("stmt", "type", "column").agg(F.min("rank").cast("int").alias("rank"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def claimed_tables(rows: DataFrame) -> DataFrame:
    """(stmt, table): the weaker of the table's and the claim's grades, the accesses of
    all fragments joined."""
    return rows.groupBy("stmt", "table").agg(F.min(F.least("rank", "claim")).cast("int").alias("rank"), F.array_join(F.sort_array(F.collect_set("access")), ",").alias("access"))


def strongest_access(rows: DataFrame, key: tuple[str, ...] = ("stmt", "table", "access")) -> DataFrame:
    """One row of each key with its strongest grade."""
    return rows.groupBy(*key).agg(F.max("rank").cast("int").alias("rank"))


def without_clashes(builtin: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Built-in statements (id) whose id no other one has, and the number dropped."""
    taken = existing.select("id").distinct()
    return builtin.join(taken, "id", "left_anti"), builtin.join(taken, "id", "left_semi").agg(F.count("*").alias("dropped"))


# --- dispatch ------------------------------------------------------------------------------------
def subtypes(extends: DataFrame) -> DataFrame:
    """(type, descendant, hops) by extends and implements (child, parent)."""
    e = extends.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(4).alias("rank"))
    starts = e.select(F.col("src").alias("source"), F.col("src").alias("node")).distinct()
    return multi_walk(e, starts, "strict", types=None).where("source <> node").select(F.col("source").alias("type"), F.col("node").alias("descendant"), "hops")


def dispatched(calls: DataFrame, methods: DataFrame, extends: DataFrame) -> DataFrame:
    """All calls (caller, owner, name, rule) that follow from ``calls`` (caller, owner,
    name): the declared method, and through dispatch the one of every subtype that
    declares it or else inherits it from its nearest ancestor. The closure of the
    types is taken first, so one pass finds every call.

    What a (owner, name) leads to is found before calls are joined. A subtype with
    one parent that inherits a method answers as its parent does, so it adds nothing
    to the methods declared below the owner and the owner's own answer.

    ``methods``: (owner, name); ``extends``: (child, parent)."""
    m = cut(methods.select("owner", "name").distinct())
    sub = cut(subtypes(extends))
    # the method a type answers with: its own, else that of the nearest type above it
    own = m.select("owner", "name", F.col("owner").alias("at"), F.lit(0).alias("hops"))
    inherited = sub.select(F.col("descendant").alias("owner"), F.col("type").alias("at"), "hops").join(m.withColumnRenamed("owner", "at"), "at")
    answers = own.unionByName(inherited.select("owner", "name", "at", "hops")).groupBy("owner", "name").agg(F.min(F.struct("hops", "at")).alias("b")).select("owner", "name", F.col("b.at").alias("at"))
    answers = cut(answers)
    direct = answers.select("owner", "name", "at", F.when(F.col("at") == F.col("owner"), 0).otherwise(1).alias("rule"))
    below = sub.select(F.col("type").alias("owner"), "descendant")
    declared = below.join(m.select(F.col("owner").alias("descendant"), "name"), "descendant").select("owner", "name", F.col("descendant").alias("at"), F.lit(2).alias("rule"))
    several = extends.where("child <> parent").groupBy(F.col("child").alias("descendant")).agg(F.countDistinct("parent").alias("n")).where("n > 1").select("descendant")
    other = answers.select(F.col("owner").alias("descendant"), "name", "at").where("descendant <> at").join(several, "descendant", "left_semi")
    through = below.join(other, "descendant").select("owner", "name", "at", F.lit(2).alias("rule"))
    leads = union_all([direct, declared, through]).groupBy("owner", "name", "at").agg(F.min("rule").alias("rule"))
    names = F.when(F.col("rule") == 0, "receiver").when(F.col("rule") == 1, "inherited").otherwise("dispatch")
    got = calls.select("caller", "owner", "name").distinct().join(leads, ["owner", "name"]).groupBy("caller", F.col("at").alias("owner"), "name").agg(F.min("rule").alias("rule"))
    return got.select("caller", "owner", "name", names.alias("rule"))


def candidates(edges: DataFrame, call: str = "call_id") -> DataFrame:
    """Edges with the number of targets that their call could have."""
    return edges.withColumn("candidates", F.count("*").over(Window.partitionBy(call)))
