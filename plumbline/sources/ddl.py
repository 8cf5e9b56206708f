"""A catalog of tables and columns folded from DDL scripts in file order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "schema string, owner string, table string, column string, type string, nullable boolean, pk boolean, ordinal int, comment string"
_NAME = r'(?:[`"\[]?[\w$#]+[`"\]]?\s*\.\s*)*[`"\[]?[\w$#]+[`"\]]?'
_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|#[^\n]*|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|[\w$#]+|\S", re.S)


def statements(text: str) -> Iterator[str]:
    """Statements of a script without comments; quotes keep their semicolons."""
    out: list[str] = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.startswith(("--", "/*", "#")):
            continue
        if t == ";":
            if out:
                yield " ".join(out)
            out = []
        else:
            out.append(t)
    if out:
        yield " ".join(out)


def bare(name: str) -> str:
    """The last part of a dotted name, without quotes; unquoted names are folded."""
    last = re.split(r"\s*\.\s*", name.strip())[-1]
    quoted = last[:1] in '`"['
    return last.strip('`"[]') if quoted else last.lower()


def owner_of(name: str) -> str:
    """The part of a dotted name before its last, folded alike; empty without one."""
    parts = re.split(r"\s*\.\s*", name.strip())
    return bare(parts[-2]) if len(parts) > 1 else ""


def full(name: str) -> str:
    """Owner and name with a dot between, or the name alone."""
    return ".".join(x for x in (owner_of(name), bare(name)) if x)


def split_list(body: str) -> list[str]:
    """Parts between commas that stand outside brackets."""
    parts, depth, now = [], 0, []
    for t in body.split(" "):
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            parts.append(" ".join(now))
            now = []
        else:
            now.append(t)
    return [p for p in [*parts, " ".join(now)] if p]


def _literal(text: str) -> str:
    return text[1:-1].replace("''", "'")


class Catalog:
    """Tables in order of their making, changed by one statement after another."""

    def __init__(self) -> None:
        self.tables: dict[str, dict[str, dict]] = {}
        self.unread: list[tuple[str, str]] = []

    def apply(self, sql: str) -> None:
        s = sql.strip()
        if m := re.match(rf"create (?:global |local )?(?:temporary |temp |unlogged )?table (if not exists )?({_NAME}) \( (.*) \)(.*)$", s, re.I | re.S):
            name = full(m[2])
            if not (m[1] and name in self.tables):
                self.tables[name] = {}
                for part in split_list(m[3]):
                    if like := re.match(rf"like ({_NAME})", part, re.I):
                        self._like(name, full(like[1]), sql)
                    else:
                        self._item(name, part)
        elif m := re.match(rf"create (?:temporary |temp )?table (if not exists )?({_NAME}) like ({_NAME})$", s, re.I):
            if not (m[1] and full(m[2]) in self.tables):
                self.tables[full(m[2])] = {}
                self._like(full(m[2]), full(m[3]), sql)
        elif m := re.match(r"drop table (?:if exists )?(.*)$", s, re.I):
            for n in split_list(m[1]):
                self.tables.pop(full(re.match(_NAME, n)[0]) if re.match(_NAME, n) else n, None)  # a word after a name says how, not what
        elif m := re.match(rf"alter table (?:if exists )?(?:only )?({_NAME}) (.*)$", s, re.I | re.S):
            name = full(m[1])
            if name not in self.tables:
                self.note("table_not_in_catalog", sql)
            for act in split_list(m[2]):
                name = self._alter(name, act)
        elif m := re.match(rf"rename table ({_NAME}) to ({_NAME})$", s, re.I):
            self._rename(full(m[1]), full(m[2]))
        elif m := re.match(rf"comment on column ({_NAME}) is ('.*')$", s, re.I | re.S):
            path = re.split(r"\s*\.\s*", m[1])
            if len(path) > 1 and (c := self.tables.get(full(".".join(path[:-1])), {}).get(bare(path[-1]))):
                c["comment"] = _literal(m[2])
        elif re.match(r"(create|alter|drop|rename)\b", s, re.I) and not re.match(r"(create|drop|alter) (unique )?(index|sequence|view|or|schema|database|trigger|function|procedure|type|user|role)\b", s, re.I):
            self.note("not_read", sql)

    def note(self, code: str, sql: str) -> None:
        self.unread.append((code, sql.strip()[:80]))

    def _like(self, table: str, other: str, sql: str) -> None:
        if other in self.tables:
            self.tables[table] |= {k: dict(v) for k, v in self.tables[other].items()}
        else:
            self.note("table_not_in_catalog", sql)

    def _item(self, table: str, part: str) -> None:
        cols = self.tables[table]
        if m := re.match(rf"(?:constraint {_NAME} )?primary key (?:clustered |nonclustered )?\( (.*?) \)", part, re.I):
            for n in split_list(m[1]):
                if c := cols.get(bare(n.split(" ")[0])):
                    c["pk"], c["nullable"] = True, False
        elif not re.match(r"(constraint|foreign key|unique|key|index|check|fulltext|exclude|like)\b", part, re.I):
            if m := re.match(rf"({_NAME}) ([\w]+(?: varying| precision| unsigned)?(?: \( [^)]* \))?)(.*)$", part, re.I | re.S):
                rest = m[3]
                comment = re.search(r"\bcomment ('(?:[^']|'')*')", rest, re.I)
                pk = bool(re.search(r"\bprimary key\b", rest, re.I))
                cols[bare(m[1])] = {"type": re.sub(r"\s+", "", m[2].lower()) if "(" in m[2] else m[2].lower(), "nullable": not pk and not re.search(r"\bnot null\b", rest, re.I), "pk": pk, "comment": _literal(comment[1]) if comment else None}

    def _alter(self, table: str, act: str) -> str:
        cols = self.tables.get(table)
        if cols is None:
            return table
        if m := re.match(rf"rename to ({_NAME})$", act, re.I):
            new = ".".join(x for x in (owner_of(m[1]) or table.rpartition(".")[0], bare(m[1])) if x)
            self._rename(table, new)
            return new
        if m := re.match(rf"rename (?:column )?({_NAME}) to ({_NAME})$", act, re.I):
            a, b = bare(m[1]), bare(m[2])
            self.tables[table] = {b if k == a else k: v for k, v in cols.items()}
        elif m := re.match(rf"drop (?:column )?(?:if exists )?({_NAME})(?: \w+)?$", act, re.I):
            cols.pop(bare(m[1]), None)
        elif m := re.match(r"add (?:column )?(?:if not exists )?(.*)$", act, re.I | re.S):
            body = m[1]
            if body.startswith("( ") and body.endswith(" )"):
                for part in split_list(body[2:-2]):
                    self._item(table, part)
            else:
                self._item(table, body)
        elif m := re.match(rf"change (?:column )?({_NAME}) ({_NAME} .*)$", act, re.I | re.S):
            old = bare(m[1])
            if old in cols:
                made: dict[str, dict] = {}
                self.tables["\0"] = made
                self._item("\0", m[2])
                del self.tables["\0"]
                for k, v in made.items():
                    v["pk"] = v["pk"] or cols[old]["pk"]
                    self.tables[table] = {k if x == old else x: v if x == old else y for x, y in cols.items()}
        elif m := re.match(rf"(?:modify|alter) (?:column )?({_NAME}) (.*)$", act, re.I | re.S):
            c, rest = cols.get(bare(m[1])), m[2]
            if c is not None and re.match(r"set not null", rest, re.I):
                c["nullable"] = False
            elif c is not None and re.match(r"drop not null", rest, re.I):
                c["nullable"] = True
            elif re.match(r"(set|drop) ", rest, re.I) and not re.match(r"set data type ", rest, re.I):
                pass  # a default, a statistic: nothing that the catalog holds
            elif c is not None and (t := re.match(r"(?:set data )?(?:type )?([\w]+(?: \( [^)]* \))?)", rest, re.I)):
                c["type"] = re.sub(r"\s+", "", t[1].lower())
                if not re.match(r"(set data )?type ", rest, re.I) and act[:6].lower() == "modify":
                    c["nullable"] = not re.search(r"\bnot null\b", rest, re.I) and not c["pk"]
        else:
            self.note("action_not_read", f"alter table {table} {act}")
        return table

    def _rename(self, old: str, new: str) -> None:
        self.tables = {new if k == old else k: v for k, v in self.tables.items()}

    def rows(self) -> Iterator[tuple]:
        for table, cols in self.tables.items():
            for i, (name, c) in enumerate(cols.items(), 1):
                yield *table.rpartition(".")[::2], name, c["type"], c["nullable"], c["pk"], i, c["comment"]


def folded(scripts: DataFrame) -> DataFrame:
    """Columns and diagnostics of every schema from scripts (schema, path, text),
    folded in order of the path; a diagnostic has a ``code`` and no column. Statements
    change what those before made, so a schema is one task: its scripts, not its data."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        c, notes = Catalog(), []
        for path, text in pdf.sort_values("path")[["path", "text"]].fillna("").itertuples(index=False):
            for s in statements(text):
                c.apply(s)
            notes += [(path, *n) for n in c.unread]
            c.unread.clear()
        out = pd.DataFrame(list(c.rows()), columns=["owner", "table", "column", "type", "nullable", "pk", "ordinal", "comment"])
        out = pd.concat([out, pd.DataFrame(notes, columns=["path", "code", "detail"])], ignore_index=True).astype(object)
        out = out.where(out.notna(), None)
        out.insert(0, "schema", pdf["schema"].iloc[0])
        return out

    return scripts.groupBy("schema").applyInPandas(fold, f"{CATALOG}, path string, code string, detail string")


def catalog(scripts: DataFrame) -> DataFrame:
    """The columns that ``folded`` gives."""
    return folded(scripts).where("code is null").drop("path", "code", "detail")


def diagnostics(scripts: DataFrame) -> DataFrame:
    """(schema, path, code, detail) of statements that weren't read or applied."""
    return folded(scripts).where("code is not null").select("schema", "path", "code", "detail")


def diagnostic_stats(rows: DataFrame, examples: int = 5) -> DataFrame:
    """Each code's number, and its first examples in order."""
    return rows.groupBy("code").agg(F.count("*").alias("count"), F.slice(F.sort_array(F.collect_set("detail")), 1, examples).alias("examples"))


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    files = spark.read.option("wholetext", True).text(path).select(F.lit(schema).alias("schema"), F.input_file_name().alias("path"), F.col("value").alias("text"))
    return catalog(files)


def catalog_edges(columns: DataFrame) -> DataFrame:
    """DECLARES edges of a catalog."""
    return columns.select(F.concat(F.lit("table:"), "table").alias("src"), F.concat(F.lit("column:"), "table", F.lit("."), "column").alias("dst"), F.lit("DECLARES").alias("type"), F.lit(4).alias("rank"))
