"""What joins and shuffles move, counted in the plans that ran, on small but lopsided input."""

from __future__ import annotations

import random

import duckdb
import pandas as pd

from plumbline import catalog, tools  # noqa: F401
from plumbline.operators import compare, emit, federate, reports, walk


def counted(df, metric, kinds=""):
    """The largest value of a metric in the plan that gave ``df``'s rows, and the rows."""
    rows, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
            continue
        if kinds in name and p.metrics().contains(metric):
            most = max(most, p.metrics().apply(metric).value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most, rows


def calls_and_routes(spark, n):
    calls = spark.range(n).selectExpr("id call_id", "'a' project", "if(id % 2 = 0, 'get', 'POST') method", "'/x/y' path", "if(id % 3 = 0, 's', null) service")
    serves = spark.range(n).selectExpr("if(id % 3 = 0, 'b', 'c') project", "if(id % 5 = 0, 'GET', null) method", "if(id % 4 = 0, '/x/{id}', '/x/y') path", "concat('e', lpad(id, 5, '0')) endpoint")
    return calls, serves


def test_calls_of_one_path_are_matched_as_a_kind(spark):
    calls, serves = calls_and_routes(spark, 1000)
    most, rows = counted(federate.routes_for(calls, serves), "numOutputRows", "Join")
    assert most <= 4000
    assert {(r["call_id"] % 2, r["server"], r["endpoint"], r["rank"], r["exact"]) for r in rows} == {
        (0, "b", "e00015", 3, True), (0, "c", "e00005", 3, True), (1, "b", "e00003", 2, True), (1, "c", "e00001", 2, True),
    }
    assert len(rows) == 2000


def test_crossings_start_from_what_the_last_one_reached(spark):
    reach = spark.createDataFrame([("e1", "e1", 4), ("e2", "e2", 4), ("e2", "e3", 3), ("e3", "e3", 4), ("e4", "e4", 4)], "source string, endpoint string, rank int")
    calls = spark.createDataFrame([("e1", 1, 4), ("e3", 3, 4)], "endpoint string, call_id int, rank int")
    servers = spark.createDataFrame([(1, "e2", 3), (3, "e4", 2)], "call_id int, endpoint string, rank int")
    got = federate.crossed(reach, calls, servers, 3)
    assert {tuple(r) for r in got.collect()} == {("e1", "e2", 3, 1), ("e1", "e3", 3, 1), ("e1", "e4", 2, 2), ("e2", "e4", 2, 1), ("e3", "e4", 2, 1)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # every crossing was written, none is done again


def test_equally_good_servers_are_not_shuffled_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(compare, "KIND", 100, raising=False)
    calls, serves = calls_and_routes(spark, 600)
    calls = calls.withColumn("method", calls["method"].substr(1, 3)).unionByName(spark.sql("select 9999L call_id, 'a' project, cast(null as string) method, '/x/y' path, cast(null as string) service"))
    serves = serves.fillna("ANY", ["method"])
    most, rows = counted(compare.best_server(calls, serves), "shuffleRecordsWritten")
    assert most <= 20_000
    any_routes = sum(1 for i in range(600) if i % 4 and i % 5)
    assert len(rows) == 601 * any_routes and all(r["rank"] == 2 and r["answers"] == any_routes for r in rows)


def test_trace_added_equals_its_sql_beyond_a_million_orders(spark, tmp_path):
    keys = [*range(999_980, 1_000_060), *range(2_000_000, 2_000_040), *range(40)]
    o = pd.DataFrame({"o_orderkey": keys, "o_custkey": [k % 3 for k in keys], "o_orderstatus": "F", "o_totalprice": 1.0, "o_orderdate": pd.Timestamp("2020-01-01"), "o_orderpriority": "5-LOW"})
    spark.createDataFrame(o).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.sql(f"create view orders as from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    for t, cols in {"lineitem": "0 l_orderkey, 0 l_linenumber, 0 l_suppkey, 0 l_partkey, 'N' l_returnflag, 0.0 l_discount", "customer": "0 c_custkey, '' c_mktsegment"}.items():
        c.sql(f"create table {t} as select {cols} limit 0")
    want = {tuple(r) for r in c.sql(catalog.ORACLE["trace_added"]).fetchall()}
    got = {tuple(r) for r in catalog.QUERIES["trace_added"](spark, str(tmp_path)).collect()}
    assert got == want and any(int(r[1].split(":")[1]) < 2_000_000 for r in want)


def test_a_graph_too_large_for_arrays_is_not_sent_to_the_driver(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + j) % 40}", 4 - j) for i in range(40) for j in range(2)], "src string, dst string, rank int")
    starts = spark.createDataFrame([("n1", "n1"), ("n2", "n2")], "source string, node string")
    want = {tuple(r) for r in walk.multi_walk(edges, starts, "strict", types=None).collect()}
    monkeypatch.setattr(type(edges), "toArrow", lambda self: 1 / 0)
    assert {tuple(r) for r in walk.multi_walk(edges, starts, "strict", types=None, small=10).collect()} == want


def test_labels_in_arrays_equal_joined_ones(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(f"t{3 * rng.randrange(10) + i % 3}", f"t{3 * rng.randrange(10) + i % 3}") for i in range(60)], "src string, dst string")
    arrays, joined = ({tuple(r) for r in walk.communities(edges, small=k).collect()} for k in (walk.SMALL, 0))
    assert arrays == joined and len({label for _, label in joined}) > 1


def test_a_subtype_of_two_parents_answers_as_the_nearer_one(spark):
    methods = spark.createDataFrame([("A", "m"), ("B", "m"), ("C", "k")], "owner string, name string")
    extends = spark.createDataFrame([("D", "B"), ("D", "X"), ("B", "A"), ("X", "C")], "child string, parent string")
    calls = spark.createDataFrame([("x", "X", "m"), ("a", "A", "m"), ("d", "D", "k"), ("d", "D", "m")], "caller string, owner string, name string")
    got = emit.dispatched(calls, methods, extends)
    assert {tuple(r) for r in got.collect()} == {("x", "B", "m", "dispatch"), ("a", "A", "m", "receiver"), ("a", "B", "m", "dispatch"), ("d", "C", "k", "inherited"), ("d", "B", "m", "inherited")}


def test_a_statement_of_several_tables_and_accesses_counts_once(spark):
    flow = spark.createDataFrame([("symbol:a", "statement:1", "IMPLEMENTS_STMT", 4)], "src string, dst string, type string, rank int")
    uses = spark.createDataFrame([("statement:1", t, "EXECUTES", r, a) for t, r, a in (("t1", 3, "read"), ("t1", 4, "write"), ("t2", 4, "read"), ("t3", 2, "read"))], "src string, dst string, type string, rank int, access string")
    got = reports.transactions(flow, spark.createDataFrame([("symbol:a",)], "symbol string"), uses, "conservative")
    assert [tuple(r) for r in got.collect()] == [("symbol:a", 1, 2, 2, 1)]
    at = spark.createDataFrame([("e", "statement:1", 4, 2)], "endpoint string, stmt string, rank int, hops int")
    assert {tuple(r) for r in reports.touches(at, uses, "conservative").collect()} == {("e", "t1", "read+write", 1, 4), ("e", "t2", "read", 1, 4)}
