"""SQL statements of mapper XML files, with dynamic tags written out flat."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENTS = "namespace string, id string, type string, sql string, file string, has_string_subst boolean, problem string"
KINDS = ("select", "insert", "update", "delete", "procedure", "statement")


def _flat(e: ET.Element, parts: dict[str, ET.Element], space: str, seen: tuple[str, ...] = (), missing: list[str] | None = None) -> str:
    """The text of an element with all branches of its dynamic tags."""
    out = [e.text or ""]
    for c in e:
        tag = c.tag.lower()
        if tag == "include":
            ref = c.get("refid", "")
            full = ref if "." in ref else f"{space}.{ref}"
            if full in parts and full not in seen:
                out.append(_flat(parts[full], parts, full.rpartition(".")[0], (*seen, full), missing))
            elif full not in parts and missing is not None:
                missing.append(full)
        elif tag == "selectkey" or tag == "bind":
            pass
        else:
            inner = _flat(c, parts, space, seen, missing)
            if tag == "where":
                inner = " where " + re.sub(r"^\s*(and|or)\b", "", inner, flags=re.I) if inner.strip() else ""
            elif tag == "set":
                inner = " set " + re.sub(r",\s*$", "", inner)
            elif tag == "trim":
                body = inner.strip()
                for word in (c.get("prefixOverrides") or "").split("|"):
                    if word.strip() and body.lower().startswith(word.strip().lower()):
                        body = body[len(word.strip()) :]
                for word in (c.get("suffixOverrides") or "").split("|"):
                    if word.strip() and body.lower().endswith(word.strip().lower()):
                        body = body[: -len(word.strip())]
                inner = f" {c.get('prefix') or ''} {body} {c.get('suffix') or ''} "
            elif tag in ("foreach", "iterate"):
                inner = f"{c.get('open') or ''}{inner}{c.get('close') or ''}"
            if (word := c.get("prepend")) and inner.strip():
                # of a dynamic part the first inner word falls away
                inner = f" {word} " + (re.sub(r"^\s*(and|or|,)(?=\W)", "", inner, flags=re.I) if tag == "dynamic" else inner)
            out.append(inner)
        out.append(c.tail or "")
    return " ".join(out)


def read_mapper(text: str, file: str, shared: dict[str, ET.Element] | None = None) -> Iterator[tuple]:
    """Rows of one file; one that can't be parsed is a row with its problem."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?>", "", text, flags=re.S)
    try:
        root = ET.fromstring(text.encode("utf-8"))
    except ET.ParseError as x:
        yield "", None, None, None, file, None, f"parse_failed: {x}"
        return
    if root.tag not in ("mapper", "sqlMap"):
        return
    space = root.get("namespace", "")
    parts = dict(shared or {}) | {f"{space}.{e.get('id')}": e for e in root.iter("sql")}
    for e in root:
        if e.tag.lower() in KINDS:
            missing: list[str] = []
            raw = _flat(e, parts, space, (), missing)
            subst = bool(re.search(r"\$\{[^}]*\}|\$[A-Za-z_][\w.]*\$", raw))
            sql = re.sub(r"#\{[^}]*\}|#[A-Za-z_][\w.:\[\]]*#", "?", raw)
            sql = re.sub(r"\$\{[^}]*\}|\$[A-Za-z_][\w.]*\$", "__subst__", sql)
            yield space, e.get("id"), e.tag.lower(), re.sub(r"\s+", " ", sql).strip(), file, subst, f"include_not_found: {missing[0]}" if missing else None


def fragments(text: str) -> list[tuple[str, str]]:
    """Names and XML of the fragments that a file offers to others."""
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?>", "", text, flags=re.S).encode("utf-8"))
    except ET.ParseError:
        return []
    space = root.get("namespace", "")
    return [(f"{space}.{e.get('id')}", ET.tostring(e, encoding="unicode")) for e in root.iter("sql")]


def mapper_statements(files: DataFrame, most_fragments: int = 200_000) -> DataFrame:
    """Statements of mapper files (path, text), file by file. The fragments of all
    files, which are parts of source code, go to every task; over ``most_fragments``
    are an error."""
    names = F.udf(fragments, "array<struct<name string, xml string>>")
    found = files.where(F.col("text").contains("<sql")).select(F.explode(names("text")).alias("f")).select("f.*").limit(most_fragments + 1).collect()
    if len(found) > most_fragments:
        raise ValueError(f"there are over {most_fragments} fragments")
    shared = files.sparkSession.sparkContext.broadcast({r["name"]: r["xml"] for r in sorted(found)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = {k: ET.fromstring(v) for k, v in shared.value.items()}
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) for r in read_mapper(t or "", p, parts)]
            yield pd.DataFrame(rows, columns=["namespace", "id", "type", "sql", "file", "has_string_subst", "problem"])

    return files.select("path", "text").mapInPandas(run, STATEMENTS)


def read_mappers(spark: SparkSession, path: str) -> DataFrame:
    return mapper_statements(spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def bind_statements(symbols: DataFrame, statements: DataFrame) -> DataFrame:
    """IMPLEMENTS_STMT edges: symbol owner#method to the statement owner.method."""
    s = statements.where("id is not null").select(F.concat_ws(".", F.nullif("namespace", F.lit("")), "id").alias("key")).distinct()
    m = symbols.select(F.col("id").alias("src"), F.replace(F.regexp_replace("id", "^symbol:", ""), F.lit("#"), F.lit(".")).alias("key"))
    return m.join(s, "key").select("src", F.concat(F.lit("statement:"), "key").alias("dst"), F.lit("IMPLEMENTS_STMT").alias("type"), F.lit(4).alias("rank"))
