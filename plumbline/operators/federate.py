"""Calls that leave a project and the routes of other projects that serve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.names import route_matches
from plumbline.operators.walk import cut, union_all


def _verb(method: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(method), F.lit("")), F.lit("ANY"))


def method_rank(route: Column, call: Column) -> Column:
    """A sound set where both name the same verb, a guess where one names none (ANY,
    empty or null), null where they can't meet."""
    r, c = _verb(route), _verb(call)
    return F.when((r == c) & (r != "ANY"), 3).when((r == "ANY") | (c == "ANY"), 2)


def _hole(segment: Column) -> Column:
    return (segment == "*") | segment.rlike(r"^\{.*\}$")


def _keys(path: Column, template: bool) -> Column:
    """Join keys of a path: number of segments and the first one. A template has one
    key, with * where its first segment is a hole; a call has all that could fit."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    n, first = F.size(parts).cast("string"), F.coalesce(F.get(parts, 0), F.lit(""))
    if not template:
        return F.array_distinct(F.array(*[F.concat_ws(":", k, f) for k in (n, F.lit("**")) for f in (first, F.lit("*"))]))
    rest = F.element_at(parts, -1) == "**"
    head = F.when(_hole(first) | (first == "**"), F.lit("*")).otherwise(first)
    return F.concat_ws(":", F.when(rest, F.lit("**")).otherwise(n), head)


def routes_for(calls: DataFrame, serves: DataFrame) -> DataFrame:
    """For each call (call_id, project, method, path) the best route of every other
    project (server, endpoint, route, rank, exact): the same path before a template,
    the same verb before any, then the route's path and id in order.

    Calls of one project, verb and path have the same answers, and of a project's
    routes of one verb and path only the first can be one; so unlike kinds are
    matched, each once, and calls take the answers of their kind. Paths are joined
    on the path, or on segments that must agree, never on all pairs."""
    c = calls.select("call_id", "project", _verb(F.col("method")).alias("verb"), "path")
    s = serves.groupBy(F.col("project").alias("server"), _verb(F.col("method")).alias("served"), F.col("path").alias("route")).agg(F.min(F.struct("endpoint"))["endpoint"].alias("endpoint"))
    kinds = c.select("project", "verb", "path").distinct()
    paths, routes = kinds.select("path").distinct(), s.select("route").distinct()
    exact = paths.join(routes, F.col("path") == F.col("route")).withColumn("exact", F.lit(True))
    holes = routes.where(F.exists(F.split("route", "/"), lambda x: _hole(x) | (x == "**"))).withColumn("key", _keys(F.col("route"), True))
    keyed = paths.withColumn("key", F.explode(_keys(F.col("path"), False)))
    fits = keyed.join(holes, "key").where((F.col("path") != F.col("route")) & route_matches(F.col("route"), F.col("path"))).drop("key").withColumn("exact", F.lit(False))
    both = kinds.join(exact.unionByName(fits), "path").join(s, "route").where(F.col("project") != F.col("server"))
    both = both.withColumn("rank", method_rank(F.col("served"), F.col("verb"))).where("rank is not null")
    best = F.min_by(F.struct("endpoint", "route", "rank", "exact"), F.struct(~F.col("exact"), -F.col("rank"), F.col("route"), F.col("endpoint")))
    answers = both.groupBy("project", "verb", "path", "server").agg(best.alias("b")).select("project", "verb", "path", "server", "b.*")
    return c.join(answers, ["project", "verb", "path"]).select("call_id", "server", "endpoint", "route", "rank", "exact")


def servers_of(calls: DataFrame, serves: DataFrame, services: DataFrame) -> DataFrame:
    """Which projects answer each call: one candidate keeps its grade; of several the
    one that answers to the call's ``service`` alone, else all of them as guesses.
    ``services``: (project, service); a project answers to its own name too."""
    cand = routes_for(calls.select("call_id", "project", "method", "path"), serves)
    names = services.select("project", "service").unionByName(serves.select("project", F.col("project").alias("service"))).distinct()
    asked = calls.where("service is not null").select("call_id", "service")
    named = asked.join(names, "service").select("call_id", F.col("project").alias("server"), F.lit(True).alias("named")).distinct()
    rows = cand.join(named, ["call_id", "server"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    w = Window.partitionBy("call_id")  # no more rows than projects
    rows = rows.withColumn("candidates", F.count("*").over(w)).withColumn("n_named", F.count_if("named").over(w))
    one = F.col("candidates") == 1
    chosen = rows.where(one | (F.col("n_named") != 1) | F.col("named"))
    sure = one | (F.col("n_named") == 1)
    return chosen.select("call_id", "server", "endpoint", F.when(sure, F.col("rank")).otherwise(2).cast("int").alias("rank"), "candidates", (~sure).alias("ambiguous"))


def census(calls: DataFrame, servers: DataFrame) -> DataFrame:
    """Calls of each project: all, answered, ambiguous and unmatched ones."""
    got = servers.groupBy("call_id").agg(F.bool_or("ambiguous").alias("ambiguous"))
    rows = calls.select("call_id", "project").join(got, "call_id", "left")
    return rows.groupBy("project").agg(
        F.count("*").alias("calls"), F.count("ambiguous").alias("answered"), F.count_if("ambiguous").alias("ambiguous"), F.count_if(F.col("ambiguous").isNull()).alias("unmatched")
    )


def crossed(reach: DataFrame, calls: DataFrame, servers: DataFrame, crossings: int = 3) -> DataFrame:
    """(source, endpoint, rank, crossings): endpoints of other projects that each
    source gets to through calls, with the best grade and the fewest crossings at it.
    ``reach``: (source, endpoint, rank) of what each endpoint reaches within its own
    project, itself included; ``calls``: (endpoint, call_id, rank) made there."""
    if not 0 <= crossings <= 8:
        raise ValueError("crossings must be 0 to 8")
    hop = calls.select("endpoint", "call_id", F.col("rank").alias("call_rank")).join(servers.select("call_id", F.col("endpoint").alias("next"), F.col("rank").alias("server_rank")), "call_id")
    hop = cut(hop.groupBy("endpoint", "next").agg(F.max(F.least("call_rank", "server_rank")).alias("hop_rank")))
    inside = reach.select(F.col("source").alias("next"), F.col("endpoint").alias("inner"), F.col("rank").alias("inner_rank"))
    front, steps = reach.select("source", "endpoint", "rank"), []
    for k in range(1, crossings + 1):
        step = front.join(hop, "endpoint").join(inside, "next").where(F.col("inner") != F.col("source"))
        front = cut(step.groupBy("source", F.col("inner").alias("endpoint")).agg(F.max(F.least("rank", "hop_rank", "inner_rank")).cast("int").alias("rank")))
        steps.append(front.withColumn("crossings", F.lit(k)))
    if not steps:
        return reach.where("false").select("source", "endpoint", F.col("rank").cast("int").alias("rank"), F.lit(0).alias("crossings"))
    best = F.max(F.struct("rank", (-F.col("crossings")).alias("c")))
    return union_all(steps).groupBy("source", "endpoint").agg(best.alias("b")).select("source", "endpoint", "b.rank", (-F.col("b.c")).alias("crossings"))
