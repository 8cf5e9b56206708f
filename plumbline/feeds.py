"""Registered queries of the readers: files made from the star tables are read back,
and their SQL says what the tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators.walk import reliable
from plumbline.sources import configs, ddl, lineage, mapper, pack, readers
from plumbline.sources.star import Star
from plumbline.streaming import traces as stream


def _put(df: DataFrame, text: Column) -> str:
    """Lines of text written below the shared folder."""
    folder = f"{reliable(df.sparkSession)}/feed-{uuid.uuid4().hex}"
    df.select(text.alias("value")).write.text(folder)
    return folder


def _num(c: str) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).cast("long")


def _fill(text: str, **cols: str) -> Column:
    """A text with <name> replaced by columns."""
    out = F.lit(text)
    for k, c in cols.items():
        out = F.replace(out, F.lit(f"<{k}>"), F.col(c).cast("string"))
    return out


@query("change_lists", "with o as (select o_custkey c, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) - 1 q from orders) select 'l' || c list, q seq, case k % 3 when 0 then 'R' when 1 then 'M' else 'D' end status, case when k % 3 = 0 then 'new' || k else 'f' || k end path, case when k % 3 = 0 then 'f' || k end old_path from o")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = Star(spark, sf_dir).table("orders")
    f = F.concat(F.lit("f"), k.cast("string"))
    one = F.when(k % 3 == 0, F.concat(F.lit("R090\0"), f, F.lit("\0new"), k.cast("string"), F.lit("\0"))).when(k % 3 == 1, F.concat(F.lit("M\0"), f, F.lit("\0"))).otherwise(F.concat(F.lit("D\0"), f, F.lit("\0")))
    raw = o.groupBy(F.concat(F.lit("l"), F.col("o_custkey").cast("string")).alias("list")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), one.alias("t")))), lambda x: x["t"]), "").alias("raw"))
    return readers.name_status(raw)


@query("property_files", "select 'r' || n_regionkey file, 'n.' || n_nationkey as key, n_name || ' of ' || n_regionkey as value from nation union all select 'r' || n_regionkey, 'last', max('v' || lpad(n_nationkey::varchar, 3, '0')) from nation group by n_regionkey")
def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Star(spark, sf_dir).table("nation").withColumn("pad", F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    text = _fill("# note\n! note\n  n.<k>  : <n> \\\n     of <r>\nlast v<p>\n", k="n_nationkey", n="n_name", r="n_regionkey", p="pad")
    f = n.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return readers.property_lines(f)


_DDL = "create table if not exists s<r>.t<k> (id bigint primary key, `Name` varchar(<v>) not null comment '<n>', old int, gone date);\nalter table s<r>.t<k> drop column gone, change old size_<k> bigint, add column more decimal(10, 2); # end\nalter table s<r>.t<k> alter column more set default 0; drop table nowhere; alter table missing<k> add x int; create table copy<k> as select 1;\n"


def _scripts(s: Star) -> DataFrame:
    n = s.table("nation").withColumn("v", F.col("n_nationkey") + 10)
    return n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("schema"), F.concat(F.lit("f"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit(".sql")).alias("path"), _fill(_DDL, r="n_regionkey", k="n_nationkey", v="v", n="n_name").alias("text"))


@query("ddl_catalog", """with n as (select 'r' || n_regionkey sch, 's' || n_regionkey ow, 't' || n_nationkey tb, n_nationkey k, n_name nm from nation)
    select sch "schema", ow "owner", tb "table", c.a "column", c.t type, c.n nullable, c.p pk, c.o ordinal, c.m "comment" from n, lateral (values ('id', 'bigint', false, true, 1, null), ('Name', 'varchar(' || (k + 10) || ')', false, false, 2, nm), ('size_' || k, 'bigint', true, false, 3, null), ('more', 'decimal(10,2)', true, false, 4, null)) c(a, t, n, p, o, m)""")
def _ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.catalog(_scripts(Star(spark, sf_dir)))


@query("ddl_diagnostics", "select code, count(*) count from nation, (values ('not_read'), ('table_not_in_catalog')) v(code) group by code")
def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.diagnostic_stats(ddl.diagnostics(_scripts(Star(spark, sf_dir)))).select("code", "count")


@query("sql_lineage", "with s as (select 'q' || p_partkey id, p_partkey k from part) select id, c.t \"table\", c.c \"column\", c.a access from s, lateral (values ('a', 'x', 'write', 0), ('b', 'p', 'read', 0), ('b', 'k', 'read', 0), ('b', 'p', 'read', 1), ('b', 'k', 'read', 1), ('a', 'k', 'read', 1), ('a', 'x', 'read', 1), ('a', 'x', 'write', 2), ('a', 'k', 'read', 2), ('b', 'k', 'read', 2), ('b', 'q', 'read', 2)) c(t, c, a, m) where k % 3 = c.m")
def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of an INSERT from a SELECT, of an IN query and of a correlated one."""
    k = F.col("p_partkey")
    sql = F.when(k % 3 == 0, "INSERT INTO a(x) SELECT p FROM b WHERE k > 3").when(k % 3 == 1, "select p from b where k in (select k from a where x = 'from d')").otherwise("update a set x = (select max(q) from b where b.k = a.k)")
    st = Star(spark, sf_dir).table("part").select(F.concat(F.lit("q"), k.cast("string")).alias("id"), sql.alias("sql"))
    cat = spark.createDataFrame([("a", "x"), ("a", "k"), ("b", "p"), ("b", "q"), ("b", "k"), ("d", "z")], "table string, column string")
    return lineage.lineage(st, cat).select("id", F.explode("columns").alias("c")).select("id", "c.table", "c.column", "c.access")


@query("mapper_statements", "select 'm' || n_nationkey namespace, 'find' id, 'select' type, 'select a, b' || n_regionkey || ' from t' || n_nationkey || ' where x = ? and id in (?)' \"sql\", n_nationkey % 2 = 0 has_string_subst from (select * from nation where n_nationkey % 2 = 1) union all select 'm' || n_nationkey, 'find', 'select', 'select a, b' || n_regionkey || ' from __subst__ where x = ? and id in (?)', true from nation where n_nationkey % 2 = 0")
def _mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose columns are a fragment of another file."""
    s = Star(spark, sf_dir)
    n = s.table("nation").withColumn("t", F.when(F.col("n_nationkey") % 2 == 0, "${tab}").otherwise(F.concat(F.lit("t"), F.col("n_nationkey").cast("string"))))
    body = '<mapper namespace="m<k>"><select id="find">select <include refid="s<r>.cols"/> from <t> <where>and x = #{x} and id in <foreach collection="l" item="i" open="(" close=")">#{i}</foreach></where></select></mapper>'
    own = n.select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("path"), _fill(body, k="n_nationkey", r="n_regionkey", t="t").alias("text"))
    shared = s.table("region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("path"), _fill('<mapper namespace="s<r>"><sql id="cols">a, b<r></sql></mapper>', r="r_regionkey").alias("text"))
    st = mapper.mapper_statements(own.unionByName(shared)).where("problem is null")
    return st.select("namespace", "id", "type", F.regexp_replace(F.regexp_replace("sql", r"\( +", "("), r" +\)", ")").alias("sql"), "has_string_subst")


@query("otlp_spans", "select 't' || user_id trace_id, 's' || event_id span_id, case when event_id % 3 = 0 then null else 'p' || event_id end parent_span_id, event_type name, 'svc' service, epoch_us(ts) // 1000 ms from events")
def _otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Star(spark, sf_dir).table("events").withColumn("nanos", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")).withColumn("up", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("event_id").cast("string"))))
    text = '12:00 INFO {"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc"}}]},"scopeSpans":[{"spans":[{"traceId":"t<u>","spanId":"s<e>","parentSpanId":"<p>","name":"<n>","startTimeUnixNano":"<t>","attributes":[]}]}]}]}'
    got = readers.otlp_spans(spark, _put(e, _fill(text, u="user_id", e="event_id", p="up", n="event_type", t="nanos")))
    return got.select("trace_id", "span_id", "parent_span_id", "name", "service", F.unix_millis("start_ts").alias("ms"))


@query("har_entries", "select 'p' || user_id page, 'GET' \"method\", '/' || event_type path, 200 status, count(*) n from events where event_id % 4 <> 0 group by all")
def _har(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded requests without assets."""
    e = Star(spark, sf_dir).table("events").withColumn("ext", F.when(F.col("event_id") % 4 == 0, ".CSS").otherwise(""))
    text = '{"log":{"entries":[{"pageref":"p<u>","startedDateTime":"2024-01-01T00:00:00Z","request":{"method":"GET","url":"http://h/<n><x>?q=<e>"},"response":{"status":200}}]}}'
    got = readers.har_documents(e.select(_fill(text, u="user_id", n="event_type", x="ext", e="event_id").alias("text")))
    return got.groupBy("page", "method", "path", "status").agg(F.count("*").alias("n"))


@query("openapi_drift", "select m.a \"method\", '/n/' || n_nationkey || '/{id}' path, case when n_nationkey % 3 = 0 and n_nationkey % 4 = 0 then 'only_in_code' when n_nationkey % 4 = 0 or m.a = 'POST' then 'only_in_document' when n_nationkey % 3 = 0 then 'both' else 'only_in_document' end status from nation, (values ('GET'), ('POST')) m(a) where not (n_nationkey % 4 = 0 and n_nationkey % 3 <> 0) and not (n_nationkey % 4 = 0 and m.a = 'POST')")
def _openapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against served routes."""
    n = Star(spark, sf_dir).table("nation")
    doc = n.where("n_nationkey % 4 <> 0")
    text = '{"openapi":"3.0.0","paths":{"/n/<k>/{id}":{"get":{"operationId":"g<k>"},"post":{"operationId":"p<k>"}}}}'
    folder = _put(doc.repartition(4), _fill(text, k="n_nationkey"))
    said = configs.openapi_documents(spark.read.text(folder).select(F.col("value").alias("text")))
    served = n.where("n_nationkey % 3 = 0").select(F.lit("GET").alias("method"), _fill("/n/<k>/{id}", k="n_nationkey").alias("path"))
    return configs.route_drift(said, served)


@query("yaml_leaves", "select 'f' || n_nationkey file, v.k as key, case v.k when 'server.port' then (8000 + n_nationkey)::varchar when 'spring.application.name' then n_name when 'routes[0].id' then 'a' when 'routes[1].id' then 'b' || n_regionkey else 'x: y' end as value from nation, (values ('server.port'), ('spring.application.name'), ('routes[0].id'), ('routes[1].id'), ('quoted')) v(k)")
def _yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Star(spark, sf_dir).table("nation").withColumn("port", F.col("n_nationkey") + 8000)
    text = "# top\nserver:\n  port: <p>  # note\nspring:\n  application:\n    name: <n>\nroutes:\n  - id: a\n  - id: b<r>\nquoted: \"x: y\"\n"
    return configs.yaml_leaves(n.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file"), _fill(text, p="port", n="n_name", r="n_regionkey").alias("text")))


@query("prisma_catalog", "select 'M' || n_nationkey model, 't' || n_nationkey \"table\", c.f field, c.c \"column\", c.t type, c.n nullable, c.p pk from nation, (values ('id', 'id', 'Int', false, true), ('fullName', 'full_name', 'String', true, false)) c(f, c, t, n, p)")
def _prisma(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "// note\nmodel M<k> {\n  id Int @id\n  fullName String? @map(\"full_name\")\n  others Other[]\n  @@map(\"t<k>\")\n}\nenum E { A B }\n"
    n = Star(spark, sf_dir).table("nation")
    return configs.prisma_columns(n.select(_fill(text, k="n_nationkey").alias("text")))


@query("normal_types", "select distinct case p_size % 4 when 0 then 'int' when 1 then 'bigint unsigned' when 2 then 'varchar(' || p_size || ')' else 'timestamp' end type from part")
def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    raw = F.when(z % 4 == 0, F.concat(F.lit("INT("), z.cast("string"), F.lit(")"))).when(z % 4 == 1, "BIGINT(20) UNSIGNED").when(z % 4 == 2, F.concat(F.lit("character varying("), z.cast("string"), F.lit(")"))).otherwise("TIMESTAMP(6) WITHOUT TIME ZONE")
    return Star(spark, sf_dir).table("part").select(configs.normal_type(raw).alias("type")).distinct()


@query("kept_paths", "select count(*) n, count(*) filter (p_partkey % 5 = 3) tests from part where p_partkey % 5 not in (0, 1)")
def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 5 == 0, "web/node_modules/x/").when(k % 5 == 1, "target/gen/").when(k % 5 == 3, "src/test/java/").otherwise("src/main/"), k.cast("string"), F.lit(".java"))
    p = Star(spark, sf_dir).table("part").select(path.alias("path")).where(~configs.vendored(F.col("path")))
    return p.agg(F.count("*").alias("n"), F.count_if(configs.is_test(F.col("path"))).alias("tests"))


@query("pack_round_trip", "select (select count(*) from nation) nodes, (select count(*) from customer) edges, true same_digest, true swap_seen")
def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack is written, read and verified; another node table has another digest."""
    s = Star(spark, sf_dir)
    nodes = s.table("nation").select(Star.id("screen", "n_nationkey").alias("id"), F.lit("screen").alias("kind"), "n_name")
    folder = f"{reliable(spark)}/pack-{uuid.uuid4().hex}"
    said = pack.write_pack(nodes, s.calls_http(), folder)
    n, e = pack.read_pack(spark, folder)
    other = pack.digest(n.withColumn("n_name", F.lower("n_name")), e)
    return spark.createDataFrame([(n.count(), e.count(), pack.digest(n, e) == said, other != said)], "nodes long, edges long, same_digest boolean, swap_seen boolean")


@query("trace_stream", "select event_type callee, date_trunc('hour', ts) \"hour\", count(*) observed from events group by 1, 2")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace fold as a stream over files in which every span comes twice."""
    e = Star(spark, sf_dir).table("events").select(F.col("event_id").cast("string").alias("span_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("x").alias("caller"), F.col("event_type").alias("callee"))
    folder, name = f"{reliable(spark)}/stream-{uuid.uuid4().hex}", f"t{uuid.uuid4().hex}"
    e.unionByName(e).write.parquet(f"{folder}/in")
    pairs = stream.observed_pairs(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "100000 hours")
    stream.run_available(pairs, name, f"{folder}/state").awaitTermination()
    return spark.table(name).select("callee", F.col("hour.start").cast("timestamp_ntz").alias("hour"), "observed")
