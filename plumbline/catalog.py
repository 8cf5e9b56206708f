"""Registered queries of the graph engine over the star tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators import compare, reports, traces
from plumbline.operators.answers import top_per_key
from plumbline.operators.walk import communities, components, cut, multi_walk, reach, union_all, upstream, without_generated_interior
from plumbline.sources.readers import html_facts
from plumbline.sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --- SQL of the same graph ---------------------------------------------------------------------
GRAPH = """
ord as (select o_orderkey, o_custkey, o_orderdate, o_orderpriority, case o_orderstatus when 'F' then 4 when 'O' then 3 else 2 end r from orders),
handles as (select o_custkey c, o_orderkey s, r from ord where o_orderkey % 3 = 0),
calls as (select * from (select o_orderkey a, lead(o_orderkey) over w b, least(lead(r) over w, 3) r from ord window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where b is not null),
stmts as (select distinct l_orderkey o, l_linenumber n from lineitem),
ex as (select l_orderkey o, l_linenumber n, l_suppkey t, case l_returnflag when 'A' then 'write' when 'R' then 'delete' else 'read' end access, case when l_discount > 0.08 then 3 else 4 end r from lineitem),
cols as (select l_orderkey o, l_linenumber n, l_suppkey t, l_partkey p, case l_returnflag when 'N' then 'READS' else 'WRITES' end k from lineitem),
floors as (select unnest([4, 3, 2]) g),
walk as (
  select c, g, s, 1 h from handles, floors where handles.r >= g
  union select walk.c, walk.g, calls.b, walk.h + 1 from walk join calls on walk.s = calls.a where calls.r >= walk.g),
syms as (select c, s, max(g) g, arg_min(h, (-g, h)) h from (select c, s, g, min(h) h from walk where g >= {floor} group by all) group by c, s),
st as (select c, o, n, g, h + 1 h from syms join stmts on s = o),
joined as (select a.l_suppkey x, b.l_suppkey y, count(*) n from (select distinct l_orderkey, l_suppkey from lineitem) a join (select distinct l_orderkey, l_suppkey from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by all),
touch as (select c, t, string_agg(distinct access, '+' order by access) access, count(distinct (o, n)) statements, max(least(g, r)) r from st join ex using (o, n) where r >= {floor} group by all)
"""


def graph_sql(body: str, mode: str = "conservative") -> str:
    floor = {"strict": 4, "conservative": 3, "heuristic": 2}[mode]
    return "with recursive " + GRAPH.replace("{floor}", str(floor)) + body.replace("{floor}", str(floor))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _walked(s: Star, mode: str) -> DataFrame:
    return reports.reached_statements(reports.endpoint_walk(s.call_flow(), s.endpoints(), mode))


# --- reach and aggregates over it ----------------------------------------------------------------
@query("touches", graph_sql("select 'endpoint:' || c endpoint, 'table:' || t \"table\", access, statements, r rank from touch"))
def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    return reports.touches(_walked(s, "conservative"), s.executes(), "conservative")


for _mode in ("strict", "conservative", "heuristic"):

    @query(
        f"reach_census_{_mode}",
        graph_sql(
            """select (select count(distinct c) from st) endpoints, (select count(*) from (select distinct o, n from st)) statements,
            (select count(distinct t) from ex semi join st using (o, n) where r >= {floor}) tables,
            (select count(*) from (select distinct t, p from cols semi join st using (o, n))) columns,
            (select count(*) from stmts anti join st using (o, n)) unreached""",
            _mode,
        ),
    )
    def _census(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        s = Star(spark, sf_dir)
        return reports.reach_census(_walked(s, mode), s.executes(), s.column_access(), s.implements(), mode)


_COUPLE = """,
sg as (select distinct o, n, c_mktsegment g from st join customer on c = c_custkey),
sh as (select o, n, count(*) >= 3 shared from sg group by all),
sided as ({side}),
it as (select item, g, side, min(shared) shared from (select distinct * from sided) join sg using (o, n) join sh using (o, n) group by all)
select w.g writer, r.g reader, count(*) items, count(*) filter (w.shared or r.shared) via_shared, min(w.item) first_item
from it w join it r on w.item = r.item and w.side = 'w' and r.side = 'r' and w.g <> r.g group by all"""
_BY_COLUMN = "select o, n, 'column:' || t || '.' || p item, case k when 'WRITES' then 'w' else 'r' end side from cols"
_BY_TABLE = "select o, n, 'table:' || t item, case when access = 'read' then 'r' else 'w' end side from ex where r >= {floor}"


@query("coupling_column", graph_sql(_COUPLE.replace("{side}", _BY_COLUMN)))
def coupling_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    return reports.coupling(_walked(s, "conservative"), s.endpoints(), s.column_access(), "column", "conservative")


@query("coupling_table", graph_sql(_COUPLE.replace("{side}", _BY_TABLE)))
def _coupling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    return reports.coupling(_walked(s, "conservative"), s.endpoints(), s.executes(), "table", "conservative")


@query(
    "coupling_item_kinds",
    graph_sql(
        """, sg as (select distinct o, n, c_mktsegment g from st join customer on c = c_custkey),
    per as (select t, p, list_sort(list(distinct g) filter (k = 'WRITES')) w, list_sort(list(distinct g) filter (k = 'READS')) r from cols join sg using (o, n) group by all)
    select case when r is null then 'write_only' when w is null then 'read_only' when len(w) = 1 and len(r) = 1 and w = r then 'self_only' else 'coupled' end kind, count(*) items from per group by all"""
    ),
)
def _item_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    return reports.item_sides(_walked(s, "conservative"), s.endpoints(), s.column_access(), "column", "conservative")


@query("hubs", graph_sql("select 'table:' || t \"table\", count(*) endpoints, sum(statements)::bigint statements from touch group by all order by 2 desc, 3 desc, 1 limit 25"))
def _hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hubs(_touches(spark, sf_dir))


@query("tables_lane", graph_sql("select 'endpoint:' || c endpoint, 'table:' || t \"table\", min(h + 1) hops, max(least(g, r)) rank, arg_min('statement:' || o || '-' || n, (-least(g, r), h, 'statement:' || o || '-' || n)) via, count(distinct (o, n)) statements from st join ex using (o, n) where r >= {floor} group by all"))
def _lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    return reports.tables_lane(_walked(s, "conservative"), s.executes(), "conservative")


@query("walk_layers", graph_sql(", nodes as (select c, 's' k, s a, 0 b, g, h from syms union all select c, 't', o, n, g, h from st) select h hops, count(*) filter (g = 2) heuristic, count(*) filter (g = 3) sound_set, count(*) filter (g = 4) exact from nodes group by all", "heuristic"))
def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    return reports.layers(reports.endpoint_walk(s.call_flow(), s.endpoints(), "heuristic"))


@query(
    "summary",
    graph_sql(
        """, weak as (select c, t, min(least(g, r)) r from st join ex using (o, n) where r >= {floor} group by all),
    fam as (select s_suppkey t, 'nation' || s_nationkey f from supplier),
    top as (select f from weak join fam using (t) group by f order by count(*) desc, f limit 10)
    select c_mktsegment api_group, case when f in (select f from top) then f else '(others)' end family, count(distinct t) tables, count(distinct c) routes, min(r) rank
    from weak join fam using (t) join customer on c = c_custkey group by all"""
    ),
)
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    weak = reports.weakest_tables(_walked(s, "conservative"), s.executes(), "conservative")
    fam = s.table("supplier").select(Star.id("table", "s_suppkey").alias("table"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("family"))
    return reports.summary(weak, s.endpoints(), fam)


@query(
    "transactions",
    graph_sql(
        """, tx as (select o_orderkey a from ord where o_orderpriority = '1-URGENT'),
    tw as (select a, 4 g, a s from tx union all select a, 3, a from tx), deep as (select * from tw), 
    reached as (select a, s from (with recursive r as (select a, a s from tx union select r.a, b from r join calls on r.s = calls.a where calls.r >= 3) select * from r))
    select 'symbol:' || a symbol, count(distinct (o, n)) statements, count(distinct t) tables, count(distinct t) filter (access = 'read') read_tables, count(distinct t) filter (access <> 'read') written_tables
    from reached join ex on s = o where r >= {floor} group by all"""
    ),
)
def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    starts = s.orders().where("o_orderpriority = '1-URGENT'").select(Star.id("symbol", "o_orderkey").alias("symbol"))
    return reports.transactions(s.may_call().unionByName(s.implements()), starts, s.executes(), "conservative")


@query("browse_tables", graph_sql(", u as (select t, count(distinct (o, n)) statements, count(distinct (o, n)) filter (access = 'read') reads, count(distinct (o, n)) filter (access = 'write') writes, count(distinct (o, n)) filter (access = 'delete') deletes from ex group by all) select 'table:' || t \"table\", any_value(u.statements) statements, any_value(reads) reads, any_value(writes) writes, any_value(deletes) deletes, count(distinct c) endpoints, count(distinct c_nationkey) screens from u left join touch using (t) left join customer on c = c_custkey group by t"))
def _browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    screens = s.calls_http().select(F.col("dst").alias("endpoint"), F.col("src").alias("screen"))
    return reports.browse_tables(_touches(spark, sf_dir), reports.table_usage(s.executes()), screens)


@query(
    "relation_map",
    graph_sql(
        """select 'member' kind, 'group:' || c_mktsegment source, 'endpoint:' || c_custkey target, 4 rank, 1::bigint weight from customer
    union all select 'calls', 'screen:' || c_nationkey, 'endpoint:' || c_custkey, 3, 1 from customer
    union all select 'touches', 'endpoint:' || c, 'table:' || t, r, statements from touch
    union all select 'joins', least('table:' || x, 'table:' || y), greatest('table:' || x, 'table:' || y), 4, n from joined"""
    ),
)
def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    screens = s.calls_http().select(F.col("dst").alias("endpoint"), F.col("src").alias("screen"))
    return reports.relation_map(_touches(spark, sf_dir), s.endpoints(), screens, s.joins())


@query(
    "endpoint_impact",
    graph_sql(
        """, up as (select c, max(least(g, r)) rank, min(h) + 1 hops from (select c, g, h, r from st join ex using (o, n) where t = 1 and r >= {floor}) group by c)
    select 'endpoint:' || c endpoint, rank from up"""
    ),
)
def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that reach table 1, walked backwards from it."""
    s = Star(spark, sf_dir)
    edges = union_all([s.call_flow(), s.executes().select("src", "dst", "type", "rank")])
    up = reach(edges, "table:1", "conservative", backward=True)
    return up.where(F.col("node").startswith("endpoint:")).select(F.col("node").alias("endpoint"), "rank")


@query("screen_impact", graph_sql("select 'screen:' || c_nationkey screen, count(distinct t) tables, max(least(touch.r, 3)) rank from touch join customer on c = c_custkey group by all"))
def _screen_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables below every screen, through the endpoints that it calls."""
    s = Star(spark, sf_dir)
    t = _touches(spark, sf_dir).join(s.calls_http().select(F.col("dst").alias("endpoint"), F.col("src").alias("screen"), F.col("rank").alias("call_rank")), "endpoint")
    return t.groupBy("screen").agg(F.countDistinct("table").alias("tables"), F.max(F.least("rank", "call_rank")).cast("int").alias("rank"))


# --- censuses without a walk ---------------------------------------------------------------------
_EDGES = """, e as (
select 'HANDLES' type, r rank from handles union all select 'MAY_CALL', r from calls union all select 'IMPLEMENTS_STMT', 4 from stmts
union all select 'EXECUTES', r from ex union all select k, 4 from cols union all select 'DECLARES', 4 from (select distinct l_suppkey, l_partkey from lineitem)
union all select 'CALLS_HTTP', 3 from customer union all select 'JOINS', 4 from joined)"""


@query("edge_census", graph_sql(_EDGES + " select type, rank, count(*) edges from e group by grouping sets ((type, rank), (rank))"))
def _edge_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.edge_census(Star(spark, sf_dir).edges())


@query("edge_census_cumulative", graph_sql(_EDGES + " select type, rank, sum(count(*)) over (partition by type order by rank desc)::bigint edges from e group by type, rank"))
def _cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cumulative_census(Star(spark, sf_dir).edges())


@query("node_census", graph_sql(" select 'screen' kind, count(distinct c_nationkey) nodes from customer union all select 'endpoint', count(*) from customer union all select 'symbol', count(*) from (select l_orderkey from lineitem union select s from handles union select a from calls union select b from calls) union all select 'statement', count(*) from stmts union all select 'table', count(distinct l_suppkey) from lineitem union all select 'column', count(*) from (select distinct l_suppkey, l_partkey from lineitem)"))
def _node_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.node_census(Star(spark, sf_dir).edges())


@query("route_grades", graph_sql(" select r rank, count(*) endpoints, count(*) filter (n >= 2) multi_handler from (select c, max(r) r, count(distinct s) n from handles group by c) group by r"))
def _route_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.route_grades(Star(spark, sf_dir).handles())


@query("table_usage", graph_sql(" select 'table:' || t \"table\", count(distinct (o, n)) statements, count(distinct (o, n)) filter (access = 'read') reads, count(distinct (o, n)) filter (access = 'write') writes, count(distinct (o, n)) filter (access = 'delete') deletes from ex group by t"))
def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_usage(Star(spark, sf_dir).executes())


@query("column_usage", graph_sql(" select 'column:' || t || '.' || p \"column\", count(distinct (o, n)) filter (k = 'READS') reads, count(distinct (o, n)) filter (k = 'WRITES') writes from cols group by t, p"))
def _column_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.column_usage(Star(spark, sf_dir).column_access())


@query("column_impact", graph_sql(" select distinct 'column:' || t || '.' || p \"column\", 'statement:' || o || '-' || n statement, k access from cols where t = 1"))
def _column_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that read or write the columns of table 1, each column apart."""
    hit = Star(spark, sf_dir).column_access().where(F.col("dst").startswith("column:1."))
    return hit.select(F.col("dst").alias("column"), F.col("src").alias("statement"), F.col("type").alias("access")).distinct()


@query("table_facts", graph_sql(", d as (select t, count(distinct p) columns from cols group by t), g as (select v, count(*) degree from (select x v from joined union all select y from joined) group by v) select 'table:' || t \"table\", columns, coalesce(degree, 0)::bigint degree from d left join g on t = v"))
def _table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    return reports.table_facts(s.joins(), s.declares())


@query("erd_two_hops", graph_sql(", one as (select y v from joined where x = 1 union select x from joined where y = 1), two as (select y v from joined join one on x = v union select x from joined join one on y = v union select v from one) select 'table:' || v node, case when v in (select v from one) then 1 else 2 end hops from two where v <> 1"))
def _erd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables within two joins of table 1, in either direction."""
    j = Star(spark, sf_dir).joins()
    both = j.select("src", "dst", "rank").unionByName(j.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rank"))
    return reach(both, "table:1", "strict", 2, types=None).where("node <> 'table:1'").select("node", "hops")


@query("call_components", graph_sql(", r as (select o_custkey, min('symbol:' || o_orderkey) component from ord group by o_custkey having count(*) > 1) select 'symbol:' || o_orderkey node, component from ord join r using (o_custkey)"))
def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of the call edges: the orders of each customer."""
    return components(Star(spark, sf_dir).may_call())


@query("table_communities")
def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(Star(spark, sf_dir).joins())


# --- comparison, federation, scoring --------------------------------------------------------------
def _packs(s: Star) -> tuple[DataFrame, DataFrame]:
    e = s.executes().select("src", "dst", "type", "rank")
    key = F.regexp_extract("src", r":(\d+)-", 1).try_cast("long")
    line = F.substring_index("src", "-", -1)
    head = e.where(key % 17 != 0).withColumn("rank", F.when(line == "1", 2).otherwise(F.col("rank")))
    return e, head


_DIFF = """, base as (select o, n, t, list_sort(list(r)) l from ex group by all), head as (select o, n, t, list_sort(list(case when n = 1 then 2 else r end)) l from ex where o % 17 <> 0 group by all),
d as (select coalesce(base.o, head.o) o, coalesce(base.n, head.n) n, coalesce(base.t, head.t) t, case when base.l is null then 'added' when head.l is null then 'removed' when base.l <> head.l then 'changed' end status from base full join head on base.o = head.o and base.n = head.n and base.t = head.t)"""


@query("pack_diff", graph_sql(_DIFF + " select 'statement:' || o || '-' || n src, 'table:' || t dst, 'EXECUTES' type, status from d where status is not null"))
def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_edges(*_packs(Star(spark, sf_dir)))


@query(
    "pack_diff_upstream",
    graph_sql(
        _DIFF + """, hit as (select distinct o from d where status is not null),
    rev as (select o s from hit union select a from calls join (select * from hit) on b = o),
    allup as (with recursive u as (select o s from hit union select a from u join calls on calls.b = u.s) select s from u)
    select 'symbol:' || s node from allup union select 'endpoint:' || c from handles join allup using (s)"""
    ),
)
def _diff_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and endpoints above a changed statement."""
    s = Star(spark, sf_dir)
    changed = _diff(spark, sf_dir).select(F.col("src").alias("node")).distinct()
    return upstream(s.call_flow(), changed)


@query(
    "federation",
    """with e as (select c_custkey, r_name project, case when c_custkey % 2 = 0 then 'GET' else 'ANY' end sm, case when c_custkey % 3 = 0 then 'POST' else 'GET' end cm, '/' || lower(c_mktsegment) || '/' || (c_custkey % 41) path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    j as (select c.c_custkey call_id, s.project server, 'endpoint:' || s.c_custkey endpoint, case when c.cm = s.sm then 3 when s.sm = 'ANY' then 2 end rank from e c join e s on c.path = s.path and c.project <> s.project where c.c_custkey % 5 = 0 and s.c_custkey % 5 <> 0 and (c.cm = s.sm or s.sm = 'ANY')),
    b as (select *, rank() over (partition by call_id order by rank desc) place from j)
    select call_id, server, endpoint, case when count(*) over (partition by call_id) > 1 then 2 else rank end rank, count(*) over (partition by call_id) answers from b where place = 1""",
)
def _federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one project that another project serves, by path and verb."""
    s = Star(spark, sf_dir)
    k = F.col("c_custkey")
    c = s.table("customer").join(s.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = names.normal_route(F.concat(F.lit("//"), F.lower("c_mktsegment"), F.lit("/"), (k % 41).cast("string"), F.lit("/")))
    e = c.select(k, F.col("r_name").alias("project"), path.alias("path"))
    calls = e.where(k % 5 == 0).select(k.alias("call_id"), "project", F.when(k % 3 == 0, "POST").otherwise("GET").alias("method"), "path")
    serves = e.where(k % 5 != 0).select("project", F.when(k % 2 == 0, "GET").otherwise("ANY").alias("method"), "path", Star.id("endpoint", "c_custkey").alias("endpoint"))
    return compare.best_server(calls, serves)


@query("golden_score", "with p as (select l_returnflag relation, count(*) n, count(*) filter (l_discount <= 0.05) hits from lineitem group by 1) select relation, n, hits, round((hits / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) bound, n >= 30 as enough from p")
def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Star(spark, sf_dir).table("lineitem").groupBy(F.col("l_returnflag").alias("relation")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") <= 0.05).alias("hits"))
    return p.withColumn("bound", F.round(compare.wilson_lower(F.col("hits"), F.col("n").cast("double")), 6)).withColumn("enough", F.col("n") >= 30)


@query("drop_gate", graph_sql(_EDGES + """, a as (select type metric, count(*) v from e group by 1), h as (select 'EXECUTES' metric, count(*) v from ex where o % 17 <> 0 union all select 'HANDLES', count(*) from handles where s % 2 = 0 union all select 'NEW', 1)
select metric, a.v "before", h.v "after", round((a.v - coalesce(h.v, 0)) / a.v, 4) relative_drop, case when a.v is null then 'NEW_METRIC' when h.v is null then 'LOST_METRIC' when (a.v - h.v) / a.v > 0.25 then 'SEVERE_DROP' when (a.v - h.v) / a.v > 0.05 then 'DROP' else 'OK' end finding from a full join h using (metric)"""))
def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Star(spark, sf_dir)
    base = s.edges().groupBy(F.col("type").alias("metric")).agg(F.count("*").alias("value"))
    ex = _packs(s)[1].agg(F.lit("EXECUTES").alias("metric"), F.count("*").alias("value"))
    ha = s.handles().where(F.regexp_extract("dst", r"(\d+)", 1).cast("long") % 2 == 0).agg(F.lit("HANDLES").alias("metric"), F.count("*").alias("value"))
    new = spark.createDataFrame([("NEW", 1)], "metric string, value long")
    return compare.gate(base, union_all([ex, ha, new]))


@query("seeded_sample", "select 'endpoint:' || c_custkey endpoint, sha256('s1:endpoint:' || c_custkey) draw, ('0x' || sha256('endpoint:' || c_custkey)[1:2])::int < 51 held_out from customer order by 2 limit 200")
def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Star(spark, sf_dir).table("customer").select(Star.id("endpoint", "c_custkey").alias("endpoint"))
    return compare.seeded_order(e, "endpoint", "s1").orderBy("draw").limit(200)


# --- traces, names, pages -------------------------------------------------------------------------
@query("trace_sessions", "with l as (select *, epoch_us(ts) - epoch_us(lag(ts) over w) > 1800000000 gap from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(case when gap is null or gap then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) session from l) select user_id, count(distinct session) sessions, count(*) events from s group by 1")
def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = traces.sessions(Star(spark, sf_dir).table("events"))
    return s.groupBy("user_id").agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("events"))


@query("trace_observations", "with l as (select *, epoch_us(ts) - epoch_us(lag(ts) over w) gap from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(case when gap is null or gap > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) session from l), p as (select lag(event_type) over w caller, event_type callee, epoch_us(ts) - epoch_us(lag(ts) over w) d from s window w as (partition by user_id, session order by ts, event_id)) select caller, callee, count(*) observed, bool_or(d <= 60000000) direct from p where caller is not null group by 1, 2")
def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.observations(Star(spark, sf_dir).table("events")).select("caller", "callee", "observed", "direct")


@query("html_facts", r"""with f as (select page_id, 'link' kind, unnest(regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1, 'is')) target from pages
union all select page_id, 'form', unnest(regexp_extract_all(html, '<form\b[^>]*?\baction\s*=\s*["'']([^"'']*)["'']', 1, 'is')) from pages
union all select page_id, 'script', unnest(regexp_extract_all(html, '<script\b[^>]*?\bsrc\s*=\s*["'']([^"'']*)["'']', 1, 'is')) from pages
union all select page_id, 'image', unnest(regexp_extract_all(html, '<img\b[^>]*?\bsrc\s*=\s*["'']([^"'']*)["'']', 1, 'is')) from pages) select * from f""")
def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_facts(Star(spark, sf_dir).table("pages"))


@query("page_routes", r"select page_id, case when length(p) > 1 then regexp_replace(p, '/$', '') else p end route from (select page_id, case when q like '/%' then q else '/' || q end p from (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/{2,}', '/', 'g') q from pages where url is not null))")
def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Star(spark, sf_dir).table("pages").where("url is not null")
    return p.select("page_id", names.normal_route(F.regexp_replace("url", "^[a-z]+://[^/]+", "")).alias("route"))


@query("name_words", "select word, count(*) parts from (select p_partkey, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')) word from part) group by word")
def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Star(spark, sf_dir).table("part").select(F.explode(names.words_of(F.col("p_name"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("parts"))


@query("search", "select 'part:' || p_partkey id, count(*) over () total from part where contains(lower(p_name || ' ' || p_type), 'bolt') order by p_partkey limit 25")
def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Star(spark, sf_dir).table("part").where(F.lower(F.concat_ws(" ", "p_name", "p_type")).contains("bolt"))
    total = p.agg(F.count("*").alias("total"))
    page = p.orderBy("p_partkey").limit(25).select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return page.crossJoin(F.broadcast(total))  # one row


@query("suggest_names", "select typed, name, d from (select typed, n_name name, levenshtein(lower(typed), lower(n_name)) d, row_number() over (partition by typed order by levenshtein(lower(typed), lower(n_name)), n_name) r from nation, (select unnest(['NATION_1', 'nation_23', 'NTION_7', 'zzz']) typed)  where levenshtein(lower(typed), lower(n_name)) <= 3 and levenshtein(lower(typed), lower(n_name)) < length(typed)) where r <= 3")
def _suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest names of each typed one, by edit distance 3 at most."""
    from pyspark.sql import Window

    typed = spark.createDataFrame([("NATION_1",), ("nation_23",), ("NTION_7",), ("zzz",)], "typed string")
    n = Star(spark, sf_dir).table("nation").select(F.col("n_name").alias("name"))
    d = n.join(F.broadcast(typed), F.levenshtein(F.lower("typed"), F.lower("name"), 3) >= 0).withColumn("d", F.levenshtein(F.lower("typed"), F.lower("name")).cast("long"))
    w = Window.partitionBy("typed").orderBy("d", "name")
    return d.where(F.col("d") < F.length("typed")).withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("call_depths", graph_sql("select 'endpoint:' || c endpoint, count(*) symbols, max(h) deepest, max(g) best from syms group by c", "heuristic"))
def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols below every endpoint, graded, with the farthest one."""
    s = Star(spark, sf_dir)
    starts = s.endpoints().select(F.col("endpoint").alias("source"), F.col("endpoint").alias("node"))
    w = multi_walk(s.handles().unionByName(s.may_call()), starts, "heuristic")
    return w.groupBy(F.col("source").alias("endpoint")).agg(F.count("*").alias("symbols"), F.max("hops").alias("deepest"), F.max("rank").alias("best"))


# --- more of the same graph -----------------------------------------------------------------------
@query(
    "reach_without_generated",
    "with recursive " + GRAPH.replace("{floor}", "3").replace("calls.r >= walk.g)", "calls.r >= walk.g and not (calls.a % 10 = 0 and calls.b % 10 = 0))") + "select 'endpoint:' || c endpoint, count(*) symbols, max(h) deepest from syms group by c",
)
def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols below every endpoint when calls between two generated ones (orders
    divisible by ten) are not walked."""
    s = Star(spark, sf_dir)
    made = s.orders().where("o_orderkey % 10 = 0").select(Star.id("symbol", "o_orderkey").alias("id"))
    e = without_generated_interior(s.handles().unionByName(s.may_call()), made)
    w = multi_walk(e, s.endpoints().select(F.col("endpoint").alias("source"), F.col("endpoint").alias("node")), "conservative")
    return w.groupBy(F.col("source").alias("endpoint")).agg(F.count("*").alias("symbols"), F.max("hops").cast("long").alias("deepest"))


@query("unreached_tables", graph_sql("select 'table:' || t \"table\", count(*) statements from (select distinct t, o, n from ex) anti join (select distinct t from touch) using (t) group by t", "strict"))
def _unreached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that no endpoint reaches with certainty, with the statements on them."""
    s = Star(spark, sf_dir)
    seen = reports.touches(_walked(s, "strict"), s.executes(), "strict").select("table").distinct()
    return reports.table_usage(s.executes()).join(seen, "table", "left_anti").select("table", "statements")


@query(
    "pack_ratios",
    graph_sql(
        """, q as (select 'endpoints_handled' metric, (select count(distinct c) from handles) a, (select count(*) from customer) b
    union all select 'endpoints_reaching', (select count(distinct c) from st), (select count(*) from customer)
    union all select 'calls_exact', (select count(*) filter (r = 4) from calls), (select count(*) from calls)
    union all select 'statements_reached', (select count(*) from (select distinct o, n from st)), (select count(*) from stmts)
    union all select 'nothing', 0, 0) select metric, a hits, b total, case when b <> 0 then round(a / b, 4) end ratio from q"""
    ),
)
def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that describe a pack; one without a population is unknown."""
    s = Star(spark, sf_dir)
    st = cut(_walked(s, "conservative").select("endpoint", "stmt"))
    row = lambda name, df: df.select(F.lit(name).alias("metric"), "hits", "total")
    endpoints, stmts = s.endpoints().agg(F.count("*").alias("total")), s.implements().agg(F.countDistinct("dst").alias("total"))
    pairs = {
        "endpoints_handled": s.handles().agg(F.countDistinct("src").alias("hits")).crossJoin(endpoints),
        "endpoints_reaching": st.agg(F.countDistinct("endpoint").alias("hits")).crossJoin(endpoints),
        "calls_exact": s.may_call().agg(F.count_if(F.col("rank") == 4).alias("hits"), F.count("*").alias("total")),
        "statements_reached": st.agg(F.countDistinct("stmt").alias("hits")).crossJoin(stmts),
        "nothing": spark.sql("select 0L hits, 0L total"),
    }  # one row each
    return union_all([row(k, v) for k, v in pairs.items()]).withColumn("ratio", compare.ratio(F.col("hits"), F.col("total")))


@query("architecture", graph_sql("select a.o_orderpriority from_module, b.o_orderpriority to_module, count(*) calls, count(*) filter (calls.r = 2) heuristic, count(*) filter (calls.r = 3) sound_set, min('symbol:' || calls.a) example from calls join ord a on calls.a = a.o_orderkey join ord b on calls.b = b.o_orderkey group by 1, 2"))
def _architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of modules (priorities of orders) with a histogram of grades."""
    s = Star(spark, sf_dir)
    mod = s.orders().select(Star.id("symbol", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("module"))
    e = s.may_call().join(mod.select(F.col("id").alias("src"), F.col("module").alias("from_module")), "src").join(mod.select(F.col("id").alias("dst"), F.col("module").alias("to_module")), "dst")
    return e.groupBy("from_module", "to_module").agg(F.count("*").alias("calls"), F.count_if(F.col("rank") == 2).alias("heuristic"), F.count_if(F.col("rank") == 3).alias("sound_set"), F.min("src").alias("example"))


@query("pack_diff_nodes", graph_sql(", b as (select distinct o, n from ex), h as (select distinct o, n from ex where o % 17 <> 0), bt as (select distinct t from ex), ht as (select distinct t from ex where o % 17 <> 0) select 'statement:' || o || '-' || n id, 'removed' status from b anti join h using (o, n) union all select 'table:' || t, 'removed' from bt anti join ht using (t)"))
def _diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_nodes(*_packs(Star(spark, sf_dir)))


@query(
    "top_tables_per_group",
    graph_sql(
        """, g as (select c_mktsegment api_group, t, count(distinct c) endpoints from touch join customer on c = c_custkey group by all)
    select api_group, 'table:' || t "table", endpoints, place, total from (select *, row_number() over (partition by api_group order by endpoints desc, 'table:' || t) place, count(*) over (partition by api_group) total from g) where place <= 3"""
    ),
)
def _top_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most used tables of every group, with the group's number of tables."""
    t = _touches(spark, sf_dir).join(Star(spark, sf_dir).endpoints(), "endpoint").groupBy("api_group", "table").agg(F.countDistinct("endpoint").alias("endpoints"))
    return top_per_key(t, ["api_group"], [F.desc("endpoints"), F.col("table")], 3)


@query("route_templates", "with e as (select lower(c_mktsegment) s, lower(n_name) n, c_custkey k from customer join nation on c_nationkey = n_nationkey) select template, count(*) routes from (select case s when 'building' then '/building/{nation}/{id}' when 'machinery' then '/machinery/**' end template from e union all select '/*/nation_1/{id}' from e where n = 'nation_1') where template is not null group by 1")
def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the endpoints that each template matches."""
    t = spark.createDataFrame([("/building/{nation}/{id}",), ("/machinery/**",), ("/*/nation_1/{id}",), ("/building/{id}",)], "template string")
    e = Star(spark, sf_dir).endpoints().join(F.broadcast(t), names.route_matches(F.col("template"), F.col("path")))  # four templates
    return e.groupBy("template").agg(F.count("*").alias("routes"))


@query("text_search", "select conv_id, turn, count(*) over () total from conversations where contains(lower(text), 'the ') and role = 'user' order by conv_id, turn limit 25")
def _text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Star(spark, sf_dir).table("conversations").where(F.lower("text").contains("the ") & (F.col("role") == "user"))
    return c.orderBy("conv_id", "turn").limit(25).select("conv_id", "turn").crossJoin(F.broadcast(c.agg(F.count("*").alias("total"))))  # one row


@query("recorded_pairs", "with p as (select user_id, event_type callee, lag(event_type) over (partition by user_id order by ts, event_id) caller, cast(json_extract(props, '$.k') as bigint) k from events) select caller, callee, count(*) observed, min(k) least, max(k) most, count(distinct user_id) users from p where caller is not null group by 1, 2")
def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of each user: how often, by how many, and the range of a
    property."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = Star(spark, sf_dir).table("events").select("user_id", F.col("event_type").alias("callee"), F.lag("event_type").over(w).alias("caller"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return p.where("caller is not null").groupBy("caller", "callee").agg(F.count("*").alias("observed"), F.min("k").alias("least"), F.max("k").alias("most"), F.countDistinct("user_id").alias("users"))
