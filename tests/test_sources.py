"""Readers, vocabulary, names, answers, packs and the streaming fold."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators import answers, compare, traces
from plumbline.plans import vocab
from plumbline.sources import ddl, lineage, mapper, pack, readers
from plumbline.streaming import traces as stream


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_facts_with_calls_and_stubs(spark, tmp_path):
    p = lines(tmp_path / "f.jsonl", [
        {"fact": "node", "id": "symbol:a"},
        {"fact": "edge", "from": "symbol:a", "to": "table:t", "type": "EXECUTES", "grade": "EXACT"},
        {"fact": "call", "from": "symbol:a", "to": "symbol:b", "evidence": {"binding": "static", "candidateCount": 1}},
        {"fact": "call", "from": "symbol:a", "to": "symbol:c", "evidence": {"reflection": True, "candidateCount": 1}},
    ])
    nodes, edges = readers.facts(spark, p)
    assert {(r["id"], r["stub"]) for r in nodes.collect()} == {("symbol:a", False), ("symbol:b", True), ("symbol:c", True), ("table:t", True)}
    assert {(r["dst"], r["type"], r["rank"]) for r in edges.collect()} == {("table:t", "EXECUTES", 4), ("symbol:b", "CALLS", 4), ("symbol:c", "MAY_CALL", 2)}


def test_unknown_facts_and_types_fail(spark, tmp_path):
    for k, row in enumerate(({"fact": "edge", "from": "a", "to": "b", "type": "NO", "grade": "EXACT"}, {"fact": "edge", "from": "a", "to": "b", "type": "CALLS", "grade": "SURE"}, {"fact": "other"})):
        with pytest.raises(Exception, match="unknown"):
            readers.facts(spark, lines(tmp_path / f"{k}.jsonl", [row]))[1].collect()


def test_envelopes_are_held_to_their_hash(spark, tmp_path):
    good = {"version": 1, "kind": "k", "payload": "x", "sha256": hashlib.sha256(b"x").hexdigest()}
    ok, bad = readers.envelopes(spark, lines(tmp_path / "e.jsonl", [good, good | {"payload": "y"}, good | {"version": 2}]))
    assert ok.count() == 1 and sorted(r["wrong"] for r in bad.collect()) == ["hash", "version"]


def test_recordings(spark, tmp_path):
    span = {"traceId": "t", "spanId": "s", "parentSpanId": "", "name": "n", "startTimeUnixNano": "1700000000000000000", "attributes": [{"key": "db.statement", "value": {"stringValue": "select 1"}}]}
    (tmp_path / "o.txt").write_text("log: " + json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"spans": [span]}]}]}) + "\n")
    r = readers.otlp_spans(spark, str(tmp_path / "o.txt")).first()
    assert (r["service"], r["sql"], r["parent_span_id"], r["start_ts"].year) == ("shop", "select 1", None, 2023)
    entry = {"pageref": "p", "startedDateTime": "2024-01-01T00:00:00Z", "request": {"method": "GET", "url": "http://h/a/b?x=1"}, "response": {"status": 200}}
    (tmp_path / "h.json").write_text(json.dumps({"log": {"entries": [entry, entry | {"request": {"method": "GET", "url": "http://h/x.css"}}]}}))
    assert [r["path"] for r in readers.har_entries(spark, str(tmp_path / "h.json")).collect()] == ["/a/b"]
    (tmp_path / "o.json").write_text(json.dumps({"paths": {"/a": {"get": {"operationId": "listA"}, "parameters": []}}}))
    assert [tuple(r) for r in readers.openapi_routes(spark, str(tmp_path / "o.json")).collect()] == [("GET", "/a", "listA")]
    (tmp_path / "p.env").write_text('# no\nexport A="1"\nB = x=y\nA=2\n')
    assert {(r["key"], r["value"]) for r in readers.properties(spark, str(tmp_path / "p.env")).collect()} == {("A", "2"), ("B", "x=y")}


def test_changed_files(spark):
    raw = spark.createDataFrame([("x", "M\0a.sql\0R087\0old.sql\0new.sql\0A\0b/c.sql\0"), ("y", "D\0a.sql\0")], "list string, raw string")
    got = {tuple(r) for r in readers.name_status(raw).collect()}
    assert got == {("x", 0, "M", "a.sql", None), ("x", 1, "R", "new.sql", "old.sql"), ("x", 2, "A", "b/c.sql", None), ("y", 0, "D", "a.sql", None)}


def test_names(spark):
    r = one(
        spark, fold=names.fold(F.lit("ÄbC")), words=names.words_of(F.lit("orderLine_items")), snake=names.snake(F.lit("orderLineId")), route=names.normal_route(F.lit("//a//b/?q=1")),
        yes=names.route_matches(F.lit("/a/{id}/b"), F.lit("/a/7/b")), no=names.route_matches(F.lit("/a/{id}"), F.lit("/a/7/b")), rest=names.route_matches(F.lit("/a/**"), F.lit("/a/7/b")),
        tables=names.tables_in_sql(F.lit("SELECT * FROM b JOIN A ON 1=1 UPDATE c")), jdbc=names.jdbc_parts(F.lit("jdbc:mysql://h:3306/shop?x=1")), hidden=names.redacted(F.lit("jdbc:x://u:secret@h/d?password=p")),
    )
    assert r["fold"] == "Äbc" and r["words"] == ["order", "line", "items"] and r["snake"] == "order_line_id" and r["route"] == "/a/b"
    assert r["yes"] and not r["no"] and r["rest"] and r["tables"] == ["a", "b", "c"]
    assert tuple(r["jdbc"]) == ("mysql", "h", 3306, "shop") and "secret" not in r["hidden"] and "=p" not in r["hidden"]


def test_vocabulary(spark):
    r = one(spark, a=vocab.rank_of(F.lit("EXACT")), b=vocab.grade_of(F.lit(3)), c=vocab.reconciled(F.lit(4), F.lit(2), F.lit(True)), d=vocab.reconciled(F.lit(4), F.lit(2), F.lit(False)))
    assert tuple(r) == (4, "SOUND_SET", 2, 3)
    with pytest.raises(ValueError):
        vocab.floor_of("any")


def test_pages_and_budgets(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    a = answers.page(df, [F.desc("n")], limit=3, offset=6)
    assert [r["n"] for r in a.rows.collect()] == [3, 2, 1] and (a.total, a.shown, a.next_offset, a.truncated) == (10, 3, 9, True)
    for bad in ({"limit": 0}, {"limit": 5000}, {"offset": -1}):
        with pytest.raises(ValueError):
            answers.page(df, [F.col("n")], **bad)
    assert answers.byte_budget(df, [F.col("n")], 30).count() == 3
    words, rows = answers.coded(spark.createDataFrame([("b",), ("a",), ("b",)], "w string"), "w")
    assert {tuple(r) for r in words.collect()} == {("a", 0), ("b", 1)} and rows.count() == 3
    top = answers.top_per_key(df.withColumn("k", F.col("n") % 2), ["k"], [F.desc("n")], 1)
    assert {(r["n"], r["total"]) for r in top.collect()} == {(9, 5), (8, 5)}


def test_pack_round_trip_and_digest(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "CALLS", 4), ("a", "c", "READS", 3)], "src string, dst string, type string, rank int")
    nodes = spark.createDataFrame([("a", "symbol"), ("b", "symbol")], "id string, kind string")
    d = pack.write_pack(nodes, edges, str(tmp_path / "p"))
    own, back = pack.read_pack(spark, str(tmp_path / "p"))
    assert back.count() == 2 and pack.digest(nodes, edges.orderBy("dst")) == d and pack.digest(nodes, edges.limit(1)) != d
    assert pack.digest(nodes.where("id = 'a'"), edges) != d  # a swapped node table is seen
    assert pack.digest(nodes, edges.withColumn("rank", F.lit(None).cast("int"))) != d
    pack.write_pack(nodes.limit(1), edges, str(tmp_path / "p"))
    assert pack.read_pack(spark, str(tmp_path / "p"))[0].count() == 1 and pack.read_pack(spark, str(tmp_path / "p"), back=1)[0].count() == 2
    data = pack.history(spark, str(tmp_path / "p")).first()["data"]
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{data}/nodes")
    with pytest.raises(ValueError):
        pack.read_pack(spark, str(tmp_path / "p"))


def test_span_ancestors_and_first_key(spark):
    spans = spark.createDataFrame([("a", None, "M"), ("b", "a", None), ("c", "b", None), ("x", "y", None), ("y", "x", None)], "span_id string, parent_span_id string, method string")
    assert {tuple(r) for r in traces.nearest_ancestor(spans, "method", 6).collect()} == {("b", "a", 1), ("c", "a", 2)}
    m = one(spark, m=traces.first_wins(F.array(F.lit("k"), F.lit("k"), F.lit("j")), F.array(F.lit(1), F.lit(2), F.lit(3))))["m"]
    assert m == {"k": 1, "j": 3}


def test_ancestors_over_64_parents_up_and_cycles(spark):
    rows = [("s0", None, "m")] + [(f"s{i}", f"s{i - 1}", None) for i in range(1, 101)] + [("x", "y", None), ("y", "x", None), ("z", "gone", None)]
    got = traces.nearest_ancestor(spark.createDataFrame(rows, "span_id string, parent_span_id string, method string"), "method")
    assert {tuple(r) for r in got.collect()} == {(f"s{i}", "s0", i) for i in range(1, 101)}


def test_scores(spark):
    r = one(spark, w=compare.wilson_lower(F.lit(30.0), F.lit(30.0)), n=compare.wilson_lower(F.lit(0.0), F.lit(0.0)), q=compare.ratio(F.lit(1), F.lit(3)), u=compare.ratio(F.lit(1), F.lit(0)))
    assert abs(r["w"] - 0.8865) < 1e-3 and r["n"] is None and r["q"] == 0.3333 and r["u"] is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 7}", f"2024-01-01 0{i % 3}:00:00", "a", "bc"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "span_id string, ts string, caller string, callee string").select("span_id", F.to_timestamp("ts").alias("ts"), "caller", "callee").dropDuplicates(["span_id"])
    df.write.parquet(str(tmp_path / "in"))
    q = stream.run_available(stream.observed_pairs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "pairs", str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r["hour"]["start"].hour, r["callee"], r["observed"]) for r in spark.table("pairs").collect()}
    want = {(r["h"], r["callee"], r["n"]) for r in df.groupBy(F.hour("ts").alias("h"), "callee").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_ddl_changes_owners_and_diagnostics(spark):
    script = """create table s1.t (a int primary key, b varchar(10) not null); # a note
    create table s2.t (a int); create table u like s1.t;
    alter table s1.t change b z bigint; alter table s1.t alter column a set default 5; alter table s2.t rename to v;
    alter table gone add x int; create table w as select * from s1.t; alter table u frobnicate x;"""
    f = spark.createDataFrame([("s", "1.sql", script)], "schema string, path string, text string")
    got = {(r["owner"], r["table"], r["column"], r["type"], r["nullable"], r["pk"]) for r in ddl.catalog(f).collect()}
    assert got == {("s1", "t", "a", "int", False, True), ("s1", "t", "z", "bigint", True, False), ("s2", "v", "a", "int", True, False), ("", "u", "a", "int", False, True), ("", "u", "b", "varchar(10)", False, False)}
    notes = ddl.diagnostics(f)
    assert [r["code"] for r in notes.orderBy("code").collect()] == ["action_not_read", "not_read", "table_not_in_catalog"]
    assert ddl.diagnostic_stats(notes).count() == 3


def test_properties_continue_and_split_at_space(spark):
    text = "# c\n a.b = one \\\n   two\nkey value\nexport X=\"q\"\na\\:b: z\nkey=last\n"
    f = spark.createDataFrame([("f", text)], "file string, text string")
    assert {(r["key"], r["value"]) for r in readers.property_lines(f).collect()} == {("a.b", "one two"), ("key", "last"), ("X", "q"), ("a:b", "z")}


def test_lineage_scopes():
    c = {"a": {"x", "k"}, "b": {"p", "q", "k"}, "d": {"z"}}
    read = lambda q: (lambda f: ({(t, n, w) for t, n, w in f["columns"]}, set(f["unresolved"])))(lineage.read_statement(q, c))
    assert read("INSERT INTO a(x) SELECT p FROM b") == ({("a", "x", "write"), ("b", "p", "read")}, set())
    assert read("select p from b where k in (select k from a where x > 1)") == ({("b", "p", "read"), ("b", "k", "read"), ("a", "k", "read"), ("a", "x", "read")}, set())
    assert read("select nope from b") == (set(), {("column_unknown_in_table", "b.nope")})
    assert read("update a set x = (select max(q) from b where b.k = a.k) where k = 3")[0] == {("a", "x", "write"), ("a", "k", "read"), ("b", "k", "read"), ("b", "q", "read")}
    assert read("delete from a where k in (select z from d where x = z)")[0] == {("a", "k", "read"), ("d", "z", "read"), ("a", "x", "read")}


def test_mapper_fragments_of_other_files(spark):
    shared = '<mapper namespace="s"><sql id="cols">a, b</sql></mapper>'
    own = '<sqlMap namespace="m"><select id="q">select <include refid="s.cols"/> from t <dynamic prepend="where"><isNotNull prepend="and">x = #x#</isNotNull></dynamic><iterate prepend="and id in" open="(" close=")" conjunction=",">#ids[]#</iterate> <include refid="gone"/></select></sqlMap>'
    f = spark.createDataFrame([("1.xml", shared), ("2.xml", own)], "path string, text string")
    got = [r for r in mapper.mapper_statements(f).collect() if r["id"]]
    assert len(got) == 1 and got[0]["sql"] == "select a, b from t where x = ? and id in (?)" and got[0]["problem"] == "include_not_found: m.gone"
