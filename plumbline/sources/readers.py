"""Readers of fact streams and recordings: JSON lines, envelopes, OTLP, HAR,
OpenAPI, properties, HTML. All are DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.vocab import checked_type, classified, rank_of

FACT = "fact string, id string, `from` string, `to` string, type string, grade string, evidence struct<callKind string, binding string, candidateCount int, reflection boolean, parseFailed boolean, conditional boolean>"


def facts(spark: SparkSession, path: str, ceiling: str = "RESOLVED_SOURCE") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, stub) and edges (src, dst, type, rank) of a JSON-lines fact
    stream. Edges of calls are graded by their evidence; an end without a node
    record becomes a stub; unknown types, grades and shapes fail."""
    f = spark.read.schema(FACT).json(path)
    odd = F.raise_error(F.concat(F.lit("unknown fact: "), F.coalesce(F.col("fact"), F.lit("null"))))
    f = f.withColumn("fact", F.when(F.col("fact").isin("node", "edge", "call"), F.col("fact")).otherwise(odd))
    edge = f.where("fact = 'edge'").select(F.col("from").alias("src"), F.col("to").alias("dst"), checked_type(F.col("type")).alias("type"), rank_of(F.col("grade")).alias("rank"))
    call = f.where("fact = 'call'").select(F.col("from").alias("src"), F.col("to").alias("dst"), classified(ceiling=ceiling).alias("rank"))
    call = call.select("src", "dst", F.when(F.col("rank") == 4, "CALLS").otherwise("MAY_CALL").alias("type"), "rank")
    edges = edge.unionByName(call)
    known = f.where("fact = 'node'").select("id").distinct().withColumn("stub", F.lit(False))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    nodes = known.unionByName(ends.join(known, "id", "left_anti").withColumn("stub", F.lit(True)))
    return nodes.select("id", F.substring_index("id", ":", 1).alias("kind"), "stub"), edges


def envelopes(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Payloads of (version, kind, sha256, payload) lines that are whole, and the
    lines that aren't with what is wrong with them."""
    e = spark.read.schema("version int, kind string, sha256 string, payload string").json(path)
    wrong = (
        F.when(F.col("version").isNull() | (F.col("version") != version), "version")
        .when(F.col("kind").isNull(), "kind")
        .when(F.col("payload").isNull() | (F.sha2("payload", 256) != F.coalesce("sha256", F.lit(""))), "hash")
    )
    e = e.withColumn("wrong", wrong)
    return e.where("wrong is null").select("kind", "payload"), e.where("wrong is not null")


def otlp_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of OTLP JSON lines: ids, name, service and start."""
    value = "struct<stringValue string, intValue string, boolValue boolean>"
    attrs = f"array<struct<key string, value {value}>>"
    span = f"struct<traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, attributes {attrs}>"
    schema = f"resourceSpans array<struct<resource struct<attributes {attrs}>, scopeSpans array<struct<spans array<{span}>>>>>"
    # a line may have text before its JSON
    line = spark.read.text(path).select(F.from_json(F.regexp_extract("value", r"(\{.*\})", 1), schema).alias("d"))
    r = line.select(F.explode("d.resourceSpans").alias("r"))
    s = r.select(_attribute("r.resource.attributes", "service.name").alias("service"), F.explode("r.scopeSpans").alias("s")).select("service", F.explode("s.spans").alias("x"))
    start = F.timestamp_micros((F.col("x.startTimeUnixNano").cast("decimal(20,0)") / 1000).cast("long"))
    return s.select(F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("x.name").alias("name"), "service", start.alias("start_ts"), _attribute("x.attributes", "db.statement").alias("sql"))


def _attribute(array: str, key: str) -> Column:
    """The first attribute of that key, as text."""
    hit = F.get(F.filter(F.col(array), lambda a: a["key"] == key), 0)
    return F.coalesce(hit["value"]["stringValue"], hit["value"]["intValue"], hit["value"]["boolValue"].cast("string"))


def har_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of HAR files, one document each."""
    return har_documents(spark.read.option("wholetext", True).text(path).select(F.col("value").alias("text")))


def har_documents(docs: DataFrame) -> DataFrame:
    """Entries of HAR documents (text): page, method, path, status and time; assets are
    left out."""
    request, response = "struct<method string, url string>", "struct<status int, redirectURL string, content struct<mimeType string>>"
    schema = f"log struct<entries array<struct<pageref string, startedDateTime string, request {request}, response {response}>>>"
    e = docs.select(F.explode(F.from_json("text", schema)["log"]["entries"]).alias("e"))
    url = F.regexp_replace("e.request.url", "^[a-z]+://[^/]+", "")
    rows = e.select(F.col("e.pageref").alias("page"), F.col("e.request.method").alias("method"), F.regexp_replace(url, "[?#].*$", "").alias("path"), F.col("e.response.status").alias("status"), F.to_timestamp("e.startedDateTime").alias("at"))
    return rows.where(~F.lower("path").rlike(r"\.(css|js|png|jpe?g|gif|svg|ico|woff2?|map)$"))


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of .properties and .env files, the last of equal keys."""
    return property_lines(spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def property_lines(files: DataFrame) -> DataFrame:
    """``properties`` of (file, text). A line that ends in an odd number of backslashes
    goes on; a key ends at =, : or white space; \\ keeps what follows."""
    text = F.regexp_replace(F.col("text"), r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t\f]*", "$1")
    line = files.select("file", F.posexplode(F.split(text, r"\r?\n")).alias("n", "raw")).select("file", "n", F.regexp_replace("raw", r"^[ \t\f]+", "").alias("l")).where("l <> '' and not l rlike '^[#!]'")
    key, rest = r"^(?:export\s+)?((?:\\.|[^=:\s\\])+)", r"^(?:export\s+)?(?:\\.|[^=:\s\\])+[ \t\f]*[=:]?[ \t\f]*(.*)$"
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    value = F.regexp_replace(F.regexp_extract("l", rest, 1), '^"(.*)"$', "$1")
    rows = line.select("file", "n", plain(F.regexp_extract("l", key, 1)).alias("key"), plain(value).alias("value")).where("key <> ''")
    return rows.groupBy("file", "key").agg(F.max_by("value", "n").alias("value"))


def openapi_routes(spark: SparkSession, path: str) -> DataFrame:
    """(method, path, operation_id) of OpenAPI JSON documents."""
    text = spark.read.option("wholetext", True).text(path)
    paths = text.select(F.from_json(F.get_json_object("value", "$.paths"), "map<string, map<string, string>>").alias("p"))
    ops = paths.select(F.explode("p").alias("path", "ops")).select("path", F.explode("ops").alias("method", "op"))
    ops = ops.where(F.col("method").isin("get", "put", "post", "delete", "patch", "head", "options", "trace"))
    return ops.select(F.upper("method").alias("method"), "path", F.get_json_object("op", "$.operationId").alias("operation_id"))


def html_facts(pages: DataFrame) -> DataFrame:
    """(page_id, kind, target) of links, forms and scripts in ``html``."""
    kinds = {"link": r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", "form": r"(?is)<form\b[^>]*?\baction\s*=\s*[\"']([^\"']*)[\"']", "script": r"(?is)<script\b[^>]*?\bsrc\s*=\s*[\"']([^\"']*)[\"']", "image": r"(?is)<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']*)[\"']"}

    def found_as(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(pattern), 1), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))

    found = F.concat(*[found_as(k, p) for k, p in kinds.items()])
    return pages.where("html is not null").select("page_id", F.explode(found).alias("f")).select("page_id", "f.kind", "f.target")


def name_status(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(list, seq, status, path, old_path) of NUL-separated change lists (list, raw):
    a status and a path in turn, of renames and copies (R or C and a number) both."""

    def step(state: Column, part: Column) -> Column:
        two = state["status"].rlike("^[RC]")
        row = F.struct(state["status"].alias("status"), part.alias("path"), state["old"].alias("old_path"))
        none = F.lit(None).cast("string")
        fresh = F.struct(state["rows"].alias("rows"), part.alias("status"), none.alias("old"))
        first = F.struct(state["rows"].alias("rows"), state["status"].alias("status"), part.alias("old"))
        last = F.struct(F.concat(state["rows"], F.array(row)).alias("rows"), none.alias("status"), none.alias("old"))
        return F.when(state["status"].isNull(), fresh).when(two & state["old"].isNull(), first).otherwise(last)

    parts = F.filter(F.split(column, "\u0000"), lambda x: x != "")
    empty = F.expr("named_struct('rows', cast(array() as array<struct<status string, path string, old_path string>>), 'status', cast(null as string), 'old', cast(null as string))")
    if "list" not in raw.columns:  # each row is a list of its own, not told apart
        raw = raw.withColumn("list", F.lit(None).cast("string"))
    rows = raw.select("list", F.posexplode(F.aggregate(parts, empty, step)["rows"]).alias("seq", "r"))
    return rows.select("list", "seq", F.left("r.status", F.lit(1)).alias("status"), "r.path", "r.old_path")
