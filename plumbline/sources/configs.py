"""Configuration and schema texts: OpenAPI, YAML leaves, Prisma models, database
types, paths that aren't the project's own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERBS = ("get", "put", "post", "delete", "patch", "head", "options", "trace")


def openapi_documents(docs: DataFrame) -> DataFrame:
    """(method, path, operation_id) of OpenAPI JSON texts (text); the first server's
    path, or the base path of version 2, stands before each."""
    server = F.regexp_replace(F.coalesce(F.get_json_object("text", "$.servers[0].url"), F.get_json_object("text", "$.basePath"), F.lit("")), r"^[a-z]+://[^/]+", "")
    paths = docs.select(F.regexp_replace(server, "/$", "").alias("base"), F.explode(F.from_json(F.get_json_object("text", "$.paths"), "map<string, map<string, string>>")).alias("path", "ops"))
    ops = paths.select(F.concat("base", "path").alias("path"), F.explode("ops").alias("m", "op")).where(F.lower("m").isin(*VERBS))
    return ops.select(F.upper("m").alias("method"), "path", F.get_json_object("op", "$.operationId").alias("operation_id"))


def route_drift(declared: DataFrame, served: DataFrame) -> DataFrame:
    """(method, path, status): in both, only in the document, or only in code. Names
    of holes don't matter."""
    key = F.regexp_replace("path", r"\{[^}]*\}", "{}").alias("key")
    d = declared.select("method", key, "path").groupBy("method", "key").agg(F.min("path").alias("a"))
    s = served.select("method", key, "path").groupBy("method", "key").agg(F.min("path").alias("b"))
    status = F.when(F.col("b").isNull(), "only_in_document").when(F.col("a").isNull(), "only_in_code").otherwise("both")
    return d.join(s, ["method", "key"], "full_outer").select("method", F.coalesce("b", "a").alias("path"), status.alias("status"))


def read_yaml(text: str) -> Iterator[tuple[str, str]]:
    """Leaves (key with dots and places, value) of the part of YAML that configuration
    uses: maps and lists by indent, plain and quoted values, comments, documents."""
    stack: list[tuple[int, str]] = []
    count: dict[str, int] = {}
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip() if "'" not in raw and '"' not in raw else raw.rstrip()
        if line.strip() in ("---", "..."):
            stack.clear()
            count.clear()
            continue
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack and stack[-1][0] >= indent + (body.startswith("- ") or body == "-") * 0 and not (stack[-1][0] == indent and body.startswith("-") and not stack[-1][1].endswith("]")):
            stack.pop()
        while body.startswith("- ") or body == "-":
            parent = stack[-1][1] if stack else ""
            n = count.get(parent, 0)
            count[parent] = n + 1
            stack.append((indent, f"{parent}[{n}]"))
            rest = body[1:].lstrip()
            indent += len(body) - len(rest)
            body = rest
        if not body:
            continue
        m = re.match(r"""("[^"]*"|'[^']*'|[^\s:#'"\[{][^:#]*?)\s*:(?:\s+(.*))?$""", body)
        parent = stack[-1][1] if stack else ""
        if not m:
            yield parent, _scalar(body)
            continue
        key = _scalar(m[1])
        full = f"{parent}.{key}" if parent else key
        if m[2]:
            yield full, _scalar(m[2])
        else:
            stack.append((indent, full))


def _scalar(text: str) -> str:
    t = text.strip()
    if m := re.match(r'"((?:[^"\\]|\\.)*)"', t):
        return m[1].replace('\\"', '"')
    if m := re.match(r"'((?:[^']|'')*)'", t):
        return m[1].replace("''", "'")
    return re.sub(r"\s+#.*$", "", t)


def yaml_leaves(files: DataFrame) -> DataFrame:
    """(file, key, value) of YAML files (file, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, k, v) for f, t in zip(pdf["file"], pdf["text"]) for k, v in read_yaml(t or "")]
            yield pd.DataFrame(rows, columns=["file", "key", "value"])

    return files.select("file", "text").mapInPandas(run, "file string, key string, value string")


def resolved(leaves: DataFrame, rounds: int = 8) -> DataFrame:
    """Values (file, key, value) with ${name:default} filled in from the same file, at
    most ``rounds`` deep; what stays open keeps its text."""
    hole = r"\$\{([^}:]+)(?::([^}]*))?\}"
    known = leaves.groupBy("file").agg(F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias("m"))
    j = leaves.groupBy("file", "key").agg(F.max("value").alias("value")).join(known, "file")
    for _ in range(rounds):
        name, default = F.regexp_extract("value", hole, 1), F.regexp_extract("value", hole, 2)
        whole = F.regexp_extract("value", hole, 0)
        fill = F.coalesce(F.try_element_at("m", name), F.when(whole.contains(":"), default), whole)
        j = j.withColumn("value", F.when(whole != "", F.replace("value", whole, fill)).otherwise(F.col("value")))
    return j.drop("m")


def prisma_columns(schemas: DataFrame) -> DataFrame:
    """(model, table, field, column, type, nullable, pk) of Prisma schemas (text):
    relations to other models aren't columns, @map and @@map give the names."""
    model = F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^\s*(model\s+\w+\s*\{.*?^\s*\})"), 1)).alias("m")
    models = schemas.select(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:model)\s+(\w+)"), 1).alias("all"), model)
    head = models.select("all", F.regexp_extract("m", r"model\s+(\w+)", 1).alias("model"), F.regexp_extract("m", r"@@map\(\"([^\"]*)\"\)", 1).alias("mapped"), F.explode(F.split("m", "\n")).alias("line"))
    part = lambda i: F.regexp_extract("line", r"^\s*([A-Za-z]\w*)\s+([A-Za-z]\w*)(\[\])?(\?)?(.*)$", i)
    f = head.where(~F.col("line").rlike(r"^\s*(model\b|//|@@|\})")).where(part(1) != "")
    f = f.where((part(3) == "") & ~F.array_contains("all", part(2)))
    name = F.regexp_extract(part(5), r"(?<!@)@map\(\"([^\"]*)\"\)", 1)
    return f.select("model", F.coalesce(F.nullif("mapped", F.lit("")), "model").alias("table"), part(1).alias("field"), F.coalesce(F.nullif(name, F.lit("")), part(1)).alias("column"), part(2).alias("type"), (part(4) == "?").alias("nullable"), part(5).rlike(r"@id\b").alias("pk"))


def normal_type(raw: Column) -> Column:
    """A database type in one spelling: no display width of integers, short names of
    PostgreSQL's long ones, no time-zone words or fractions."""
    t = F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " ")
    t = F.regexp_replace(t, r"^((?:tiny|small|medium|big)?int(?:eger)?) ?\(\d+\)", "$1")
    for a, b in ((r"^integer\b", "int"), (r"^character varying", "varchar"), (r"^varchar2", "varchar"), (r"^character\b", "char"), (r"^double precision", "double"), (r"^(timestamp|time)(\(\d+\))?( without time zone)?$", "$1"), (r"^(timestamp|time)(\(\d+\))? with time zone$", "$1tz"), (r"^number\b", "decimal"), (r"\( ", "("), (r" \(", "(")):
        t = F.regexp_replace(t, a, b)
    return t


def vendored(path: Column) -> Column:
    """Whether a path lies in a folder of dependencies or of built files."""
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"(^|/)(node_modules|bower_components|vendor|target|build|dist|out|\.git|\.gradle|\.idea)/")


def is_test(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"(^|/)(test|tests|__tests__|spec)/|[._-](test|spec)\.\w+$|Tests?\.java$")


def glob(pattern: str) -> str:
    """A regular expression of a glob: ** any folders, * within one, ? one character."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"
