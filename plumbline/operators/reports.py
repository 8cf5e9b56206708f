"""Grouped answers over reach sets: census, coupling, relation map, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.walk import cut, multi_walk
from plumbline.plans.vocab import GRADES, RANKS, floor_of

SHARED_AT = 3


def endpoint_walk(call_flow: DataFrame, endpoints: DataFrame, mode: str) -> DataFrame:
    """(endpoint, node, rank, hops) of every endpoint at once."""
    starts = endpoints.select(F.col("endpoint").alias("source"), F.col("endpoint").alias("node"))
    return multi_walk(call_flow, starts, mode).withColumnRenamed("source", "endpoint")


def reached_statements(walk: DataFrame) -> DataFrame:
    return walk.where(F.col("node").startswith("statement:")).select("endpoint", F.col("node").alias("stmt"), "rank", "hops")


def _uses(executes: DataFrame, mode: str, *more: Column) -> DataFrame:
    """Admitted EXECUTES as one row for each (stmt, table): its best ``edge_rank``.
    Kept together by statement, as the join with statements needs them."""
    e = executes.where(F.col("rank") >= floor_of(mode)).withColumnsRenamed({"src": "stmt", "dst": "table"}).repartition("stmt")
    return e.groupBy("stmt", "table").agg(F.max("rank").alias("edge_rank"), *more)


def touches(statements: DataFrame, executes: DataFrame, mode: str) -> DataFrame:
    """Endpoint and table: accesses joined by '+', statements, and the best grade
    over all ways (each the weaker of the statement's and the edge's).

    ``statements``: one row for each (endpoint, stmt). Accesses are a few words, so
    sets of them are bits; only where they are more than 60 are they collected."""
    words = sorted(r[0] for r in executes.where("access is not null").select("access").distinct().limit(61).collect())
    if len(words) <= 60:
        bit = F.coalesce(*[F.when(F.col("access") == w, F.lit(1 << i).cast("long")) for i, w in enumerate(words)], F.lit(0).cast("long"))
        e = _uses(executes, mode, F.bit_or(bit).alias("bits"))
        named = F.concat_ws("+", *[F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, w) for i, w in enumerate(words)])
        rows = statements.join(e, "stmt").repartition("endpoint", "table").groupBy("endpoint", "table").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("statements"), F.max(F.least("rank", "edge_rank")).cast("int").alias("rank"))
        return rows.select("endpoint", "table", named.alias("access"), "statements", "rank")
    e = _uses(executes, mode, F.collect_set("access").alias("words"))
    return (
        statements.join(e, "stmt").groupBy("endpoint", "table")
        .agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))), "+").alias("access"), F.count("*").alias("statements"), F.max(F.least("rank", "edge_rank")).cast("int").alias("rank"))
    )


def weakest_tables(statements: DataFrame, executes: DataFrame, mode: str) -> DataFrame:
    """Endpoint and table with the weakest grade over all the endpoint's statements."""
    e = executes.where(F.col("rank") >= floor_of(mode)).select(F.col("src").alias("stmt"), F.col("dst").alias("table"), F.col("rank").alias("edge_rank"))
    return statements.join(e, "stmt").groupBy("endpoint", "table").agg(F.min(F.least("rank", "edge_rank")).cast("int").alias("rank"))


def sides(access_edges: DataFrame, axis: str) -> DataFrame:
    """(stmt, item, side): an unknown access counts on both sides."""
    if axis == "column":
        side = F.array(F.when(F.col("type") == "WRITES", "w").otherwise("r"))
    elif axis == "table":
        side = F.when(F.col("access").isin("write", "delete"), F.array(F.lit("w"))).when(F.col("access") == "read", F.array(F.lit("r"))).otherwise(F.array(F.lit("w"), F.lit("r")))
    else:
        raise ValueError("axis must be column or table")
    return access_edges.select(F.col("src").alias("stmt"), F.col("dst").alias("item"), F.explode(side).alias("side")).distinct()


def coupling(statements: DataFrame, groups: DataFrame, access_edges: DataFrame, axis: str, mode: str) -> DataFrame:
    """Writer group and reader group that share items: number of items, and how
    many are shared only through statements that SHARED_AT or more groups reach.

    Items are aggregated to one row for each group and side first, so the join
    on items is as large as items x groups², not as the statements."""
    sg = cut(statements.join(groups.select("endpoint", "api_group"), "endpoint").select("stmt", "api_group").distinct())
    shared = sg.groupBy("stmt").agg((F.count("*") >= SHARED_AT).alias("shared"))
    items = (
        sides(access_edges.where(F.col("rank") >= floor_of(mode)), axis).join(sg.join(shared, "stmt"), "stmt")
        .groupBy("item", "api_group", "side").agg(F.min("shared").alias("all_shared"))
    )
    w = items.where("side = 'w'").select("item", F.col("api_group").alias("writer"), F.col("all_shared").alias("w_shared"))
    r = items.where("side = 'r'").select("item", F.col("api_group").alias("reader"), F.col("all_shared").alias("r_shared"))
    return (
        w.join(r, "item").where("writer <> reader").groupBy("writer", "reader")
        .agg(F.count("*").alias("items"), F.count_if(F.col("w_shared") | F.col("r_shared")).alias("via_shared"), F.min("item").alias("first_item"))
    )


def item_sides(statements: DataFrame, groups: DataFrame, access_edges: DataFrame, axis: str, mode: str) -> DataFrame:
    """How many items are written and read by different groups, by one group
    alone, only written, or only read."""
    sg = statements.join(groups.select("endpoint", "api_group"), "endpoint").select("stmt", "api_group").distinct()
    per = sides(access_edges.where(F.col("rank") >= floor_of(mode)), axis).join(sg, "stmt").groupBy("item").agg(
        F.collect_set(F.when(F.col("side") == "w", F.col("api_group"))).alias("w"), F.collect_set(F.when(F.col("side") == "r", F.col("api_group"))).alias("r")
    )
    nw, nr = F.size("w"), F.size("r")
    kind = F.when(nr == 0, "write_only").when(nw == 0, "read_only").when((nw == 1) & (nr == 1) & (F.col("w") == F.col("r")), "self_only").otherwise("coupled")
    return per.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("items"))


def edge_census(edges: DataFrame) -> DataFrame:
    """Edges by type and grade, and by grade over all types (type null)."""
    rows = edges.groupingSets([["type", "rank"], ["rank"]], "type", "rank").agg(F.count("*").alias("edges"))
    return rows.select("type", F.col("rank").cast("int").alias("rank"), "edges")


def cumulative_census(edges: DataFrame) -> DataFrame:
    """For each edge type and grade: the edges of that grade or a better one."""
    n = edges.groupBy("type", "rank").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return n.select("type", F.col("rank").cast("int").alias("rank"), F.sum("n").over(w).alias("edges"))


def node_census(edges: DataFrame) -> DataFrame:
    """Distinct nodes by kind."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.groupBy(F.substring_index("id", ":", 1).alias("kind")).agg(F.count("*").alias("nodes"))


def reach_census(statements: DataFrame, executes: DataFrame, column_access: DataFrame, implements: DataFrame, mode: str) -> DataFrame:
    """One row: distinct reached statements, tables and columns, statements that
    nothing reaches, and endpoints that reach a statement."""
    least = floor_of(mode)
    statements = cut(statements.select("endpoint", "stmt"))
    st = cut(statements.select("stmt").distinct())
    hit = lambda edges: edges.where(F.col("rank") >= least).join(st, F.col("src") == F.col("stmt"), "left_semi").select("dst").distinct()
    tables = hit(executes).agg(F.count("dst").alias("tables"))
    cols = hit(column_access).agg(F.count("dst").alias("columns"))
    missed = implements.select(F.col("dst").alias("stmt")).join(st, "stmt", "left_anti").distinct().agg(F.count("*").alias("unreached"))
    ends = statements.select("endpoint").distinct().agg(F.count("endpoint").alias("endpoints")).crossJoin(st.agg(F.count("stmt").alias("statements")))
    return ends.crossJoin(tables).crossJoin(cols).crossJoin(missed)  # one row each


def hubs(touched: DataFrame, limit: int = 25) -> DataFrame:
    """Tables by the endpoints that touch them."""
    n = touched.groupBy("table").agg(F.count("*").alias("endpoints"), F.sum("statements").alias("statements"))
    return n.orderBy(F.desc("endpoints"), F.desc("statements"), "table").limit(limit)


def route_grades(handles: DataFrame) -> DataFrame:
    """The best HANDLES grade of each endpoint, counted by grade."""
    best = handles.groupBy("src").agg(F.max("rank").alias("rank"), F.countDistinct("dst").alias("handlers"))
    return best.groupBy(F.col("rank").cast("int").alias("rank")).agg(F.count("*").alias("endpoints"), F.count_if(F.col("handlers") >= 2).alias("multi_handler"))


def table_usage(executes: DataFrame) -> DataFrame:
    """Statements of each table, in all and by access."""
    by = {a: F.countDistinct(F.when(F.col("access") == a, F.col("src"))).alias(f"{a}s") for a in ("read", "write", "delete")}
    return executes.groupBy(F.col("dst").alias("table")).agg(F.countDistinct("src").alias("statements"), *by.values())


def column_usage(column_access: DataFrame) -> DataFrame:
    """Distinct reading and writing statements of each column."""
    n = lambda k: F.countDistinct(F.when(F.col("type") == k, F.col("src")))
    return column_access.groupBy(F.col("dst").alias("column")).agg(n("READS").alias("reads"), n("WRITES").alias("writes"))


def undirected(joins: DataFrame) -> DataFrame:
    """Join links with the lower end first: best grade, largest witness."""
    return joins.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("rank").cast("int").alias("rank"), F.max("count").alias("witness"))


def degrees(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def table_facts(joins: DataFrame, declares: DataFrame) -> DataFrame:
    """Every declared table with its number of columns and of join partners."""
    cols = declares.groupBy(F.col("src").alias("table")).agg(F.countDistinct("dst").alias("columns"))
    deg = degrees(undirected(joins)).withColumnRenamed("node", "table")
    return cols.join(deg, "table", "left").select("table", "columns", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def summary(weak: DataFrame, groups: DataFrame, family_of: DataFrame, limit: int = 10) -> DataFrame:
    """Route groups against table families: distinct tables, distinct routes and
    the weakest grade; families beyond the ``limit`` largest fold into (others)."""
    rows = weak.join(groups.select("endpoint", "api_group"), "endpoint").join(family_of, "table")
    size = rows.groupBy("family").agg(F.countDistinct("table", "endpoint").alias("n"))
    top = size.orderBy(F.desc("n"), "family").limit(limit).select("family", F.lit(True).alias("top"))
    folded = rows.join(F.broadcast(top), "family", "left").withColumn("family", F.when(F.col("top"), F.col("family")).otherwise("(others)"))  # `limit` rows
    return folded.groupBy("api_group", "family").agg(F.countDistinct("table").alias("tables"), F.countDistinct("endpoint").alias("routes"), F.min("rank").cast("int").alias("rank"))


def transactions(call_flow: DataFrame, starts: DataFrame, executes: DataFrame, mode: str) -> DataFrame:
    """What each transactional symbol can touch: statements, tables read and
    written. ``starts``: (symbol)."""
    walk = multi_walk(call_flow, starts.select(F.col("symbol").alias("source"), F.col("symbol").alias("node")), mode)
    said = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    e = _uses(executes, mode, said(F.col("access") == "read").alias("read"), said(F.col("access") != "read").alias("written"))
    once = (F.col("table") == F.min("table").over(Window.partitionBy("stmt"))).cast("int")  # so that a statement of several tables counts once
    rows = walk.join(e.select(F.col("stmt").alias("node"), "table", "read", "written", once.alias("once")), "node").select(F.col("source").alias("symbol"), "table", "read", "written", "once")
    per = rows.repartition("symbol").groupBy("symbol", "table").agg(F.max("read").alias("read"), F.max("written").alias("written"), F.sum("once").alias("once"))
    n = lambda c: F.sum(c).cast("long")
    return per.groupBy("symbol").agg(n("once").alias("statements"), F.count("*").alias("tables"), n("read").alias("read_tables"), n("written").alias("written_tables"))


def browse_tables(touched: DataFrame, usage: DataFrame, screens: DataFrame) -> DataFrame:
    """Every used table with the endpoints and screens above it."""
    s = touched.join(screens, "endpoint").groupBy("table").agg(F.countDistinct("screen").alias("screens"))
    e = touched.groupBy("table").agg(F.countDistinct("endpoint").alias("endpoints"))
    return usage.join(e, "table", "left").join(s, "table", "left").na.fill(0, ["endpoints", "screens"])


def relation_map(touched: DataFrame, groups: DataFrame, screens: DataFrame, joins: DataFrame) -> DataFrame:
    """All links of the map: members of groups, calls of screens, touched tables
    and joins of tables, each with its best grade and a weight."""
    link = lambda df, kind, a, b, rank, n: df.select(F.lit(kind).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"), rank.cast("int").alias("rank"), n.cast("long").alias("weight"))
    member = link(groups.withColumn("g", F.concat(F.lit("group:"), "api_group")), "member", "g", "endpoint", F.lit(4), F.lit(1))
    calls = link(screens, "calls", "screen", "endpoint", F.lit(RANKS["SOUND_SET"]), F.lit(1))
    touch = link(touched, "touches", "endpoint", "table", F.col("rank"), F.col("statements"))
    join = link(undirected(joins), "joins", "a", "b", F.col("rank"), F.col("witness"))
    return member.unionByName(calls).unionByName(touch).unionByName(join)


def tables_lane(statements: DataFrame, executes: DataFrame, mode: str) -> DataFrame:
    """Each endpoint's tables with fewest hops, best grade and the statement that
    gives it (best grade, then fewest hops, then id). ``statements``: one row for each
    (endpoint, stmt)."""
    rows = statements.join(_uses(executes, mode), "stmt").withColumn("g", F.least("rank", "edge_rank"))
    first = F.min(F.struct((-F.col("g")).alias("g"), F.col("hops").alias("h"), F.col("stmt")))
    return rows.repartition("endpoint", "table").groupBy("endpoint", "table").agg(F.min(F.col("hops") + 1).alias("hops"), first.alias("b"), F.count("*").alias("statements")).select(
        "endpoint", "table", "hops", (-F.col("b.g")).cast("int").alias("rank"), F.col("b.stmt").alias("via"), "statements"
    )


def layers(walk: DataFrame) -> DataFrame:
    """Nodes at each distance, by grade."""
    return walk.groupBy("hops").agg(*[F.count_if(F.col("rank") == r).alias(g.lower()) for r, g in sorted(GRADES.items()) if r >= 2])


def erd_shape(joins: DataFrame, declares: DataFrame, keys: DataFrame) -> DataFrame:
    """Relations of tables, the first of each pair, with both ends' numbers of columns
    and a cardinality: 1 where the end's key (table, pk) is one, N where it isn't."""
    n = declares.groupBy("src").agg(F.countDistinct("dst").alias("n"))
    card = F.when(F.col("pk"), "1").when(~F.col("pk"), "N").otherwise("?")
    k = keys.groupBy("table").agg(F.bool_or("pk").alias("pk")).withColumn("c", card)
    j = joins.select("src", "dst").distinct()
    for end in ("src", "dst"):
        j = j.join(n.select(F.col("src").alias(end), F.col("n").alias(f"{end}_columns")), end, "left").join(k.select(F.col("table").alias(end), F.col("c").alias(f"{end}_c")), end, "left")
    c = F.concat(F.coalesce("src_c", F.lit("?")), F.lit(":"), F.coalesce("dst_c", F.lit("?")))
    return j.select("src", "dst", "src_columns", "dst_columns", c.alias("cardinality"))


def tables_of_columns(columns: DataFrame, declares: DataFrame) -> DataFrame:
    """(column, table): the declaring table, else the one that the name says."""
    d = declares.groupBy(F.col("dst").alias("column")).agg(F.min("src").alias("t"))
    said = F.concat(F.lit("table:"), F.regexp_extract("column", r"^column:(.*)\.[^.]*$", 1))
    return columns.join(d, "column", "left").select("column", F.coalesce("t", said).alias("table"))


def frontend_callers(calls_http: DataFrame) -> DataFrame:
    """Distinct resolved callers of each route."""
    return calls_http.where("rank > 0").groupBy(F.col("dst").alias("endpoint")).agg(F.countDistinct("src").alias("callers"))


def folded_others(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest of (name, n), and one row for all others."""
    top = counts.orderBy(F.desc("n"), "name").limit(k).select("name", F.lit(True).alias("top"))
    j = counts.join(F.broadcast(top), "name", "left")  # k rows
    return j.groupBy(F.when(F.col("top"), F.col("name")).otherwise("(others)").alias("name")).agg(F.sum("n").alias("n"), F.count("*").alias("members"))


def _common(a: Column, b: Column) -> Column:
    """The leading elements that two arrays share."""
    size = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size), lambda x, y: x == y), False)
    return F.slice(a, 1, F.when(first > 0, first - 1).otherwise(size).cast("int"))


def descended(items: DataFrame, wide: int, separator: str = "/", lopsided: float = 0.8) -> DataFrame:
    """(key, grp) of items (key, tokens): down the tree of tokens while the largest
    branch holds ``lopsided`` of what is left and doesn't fan out over ``wide``
    branches; the rest of each level are groups. A level costs one row at the driver."""
    pool, prefix, out = items.select("key", "tokens"), [], None
    more = lambda rows: rows if out is None else out.unionByName(rows)
    for level in range(1000):
        here = F.get("tokens", F.lit(level))
        out = more(pool.where(here.isNull()).select("key", F.lit(separator.join(prefix) or "(root)").alias("grp")))
        n, kinds = pool.agg(F.count("*"), F.countDistinct(here)).first()
        if not kinds:
            break
        top = pool.where(here.isNotNull()).groupBy(here.alias("t")).agg(F.count("*").alias("n"), F.countDistinct(F.get("tokens", F.lit(level + 1))).alias("below")).orderBy(F.desc("n"), "t").first()
        down = top["n"] / n >= lopsided and top["below"] > 0 and (top["below"] <= wide or kinds == 1)
        rest = pool.where(here.isNotNull() & (here != top["t"]) if down else here.isNotNull()).withColumn("t", here)
        if down:
            names = rest.groupBy("t").agg(F.min("tokens").alias("a"), F.max("tokens").alias("b")).select("t", F.array_join(_common(F.col("a"), F.col("b")), separator).alias("grp"))
            out = more(rest.join(names, "t").select("key", "grp"))
        else:
            out = more(rest.select("key", F.col("t").alias("grp")))
            break
        prefix.append(top["t"])
        pool = pool.where(here == top["t"])
    return out
