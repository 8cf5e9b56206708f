"""Names, routes and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(name: Column, rule: str = "lower") -> Column:
    """Identifier case: only A to Z are folded, whatever the locale."""
    if rule == "exact":
        return name
    return F.translate(name, _UPPER, _LOWER) if rule == "lower" else F.translate(name, _LOWER, _UPPER)


def kind_of(node_id: Column) -> Column:
    return F.substring_index(node_id, ":", 1)


def key_of(node_id: Column) -> Column:
    return F.expr("substr({0}, instr({0}, ':') + 1)".format(node_id)) if isinstance(node_id, str) else F.regexp_replace(node_id, "^[^:]*:", "")


def words_of(name: Column) -> Column:
    """Lower-case words of a camel, snake or kebab case name."""
    split = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(split), "[^a-z0-9]+"), lambda w: w != "")


def snake(name: Column) -> Column:
    """camelCase to snake_case: an underscore before each capital between small letters."""
    return F.lower(F.regexp_replace(name, r"(?<=\p{Ll})(\p{Lu})(?=\p{Ll})", "_$1"))


def normal_route(path: Column) -> Column:
    """A route without query, doubled slashes or a slash at its end."""
    p = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "/{2,}", "/")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def route_matches(template: Column, path: Column) -> Column:
    """Whether a template's segments ({x} or * for one, ** for the rest) match."""
    t, p = F.split(template, "/"), F.split(path, "/")
    rest = F.element_at(t, -1) == "**"
    same = F.forall(
        F.zip_with(t, p, lambda a, b: a.isNull() | (a == "**") | (b.isNotNull() & ((a == b) | (a == "*") | a.rlike(r"^\{.*\}$")))), lambda x: x
    )
    return same & F.when(rest, F.size(p) >= F.size(t) - 1).otherwise(F.size(p) == F.size(t))


def names_a_route(template: Column) -> Column:
    """Whether some segment is more than a hole."""
    return F.exists(F.split(template, "/"), lambda s: F.replace(s, F.lit("{*}"), F.lit("")) != "")


def tables_in_sql(sql: Column) -> Column:
    """Sorted distinct names after from, join, into and update in raw SQL text."""
    found = F.regexp_extract_all(F.lower(sql), F.lit(r"\b(?:from|join|into|update)\s+([a-z_][a-z0-9_.$]*)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.isin("dual", "select"))))


def jdbc_parts(url: Column) -> Column:
    """Struct of dialect, host, port and database of a JDBC URL."""
    g = lambda p, i: F.nullif(F.regexp_extract(url, p, i), F.lit(""))
    head = r"^jdbc:([a-z]+)(?::[a-z]+)*:(?://)?"
    return F.struct(
        g(head, 1).alias("dialect"),
        g(r"//([^:/;?]+)", 1).alias("host"),
        g(r"//[^:/;?]+:(\d+)", 1).cast("int").alias("port"),
        F.coalesce(g(r"//[^/]+/([^?;]+)", 1), g(r"(?i)databaseName=([^;]+)", 1)).alias("database"),
    )


def redacted(url: Column) -> Column:
    """A URL without its user's password."""
    return F.regexp_replace(F.regexp_replace(url, r"(?i)(password|pwd)=[^&;]*", "$1=***"), r"//([^:/@]+):[^@/]+@", "//$1:***@")
