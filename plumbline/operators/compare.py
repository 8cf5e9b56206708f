"""Comparison of two snapshots, of routes between projects, and of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_edges(base: DataFrame, head: DataFrame) -> DataFrame:
    """Edges (src, dst, type) that were added, removed or regraded. Multi-edges
    are compared as sorted lists of ranks."""
    key = ["src", "dst", "type"]
    b = base.groupBy(*key).agg(F.sort_array(F.collect_list("rank")).alias("b"))
    h = head.groupBy(*key).agg(F.sort_array(F.collect_list("rank")).alias("h"))
    j = b.join(h, key, "full_outer")
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("b") != F.col("h"), "changed")
    return j.withColumn("status", status).where("status is not null").select(*key, "status")


def diff_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Nodes (id) of edges that are only in one snapshot."""
    ids = lambda e: e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    b, h = ids(base), ids(head)
    added = h.join(b, "id", "left_anti").withColumn("status", F.lit("added"))
    return added.unionByName(b.join(h, "id", "left_anti").withColumn("status", F.lit("removed")))


def routes_index(endpoints: DataFrame, handles: DataFrame, calls: DataFrame) -> DataFrame:
    """(endpoint, role): served where something handles it, else called where
    something calls it over HTTP."""
    served = endpoints.join(handles.select(F.col("src").alias("endpoint")).distinct(), "endpoint", "left_semi").withColumn("role", F.lit("serves"))
    rest = endpoints.join(handles.select(F.col("src").alias("endpoint")).distinct(), "endpoint", "left_anti")
    called = rest.join(calls.select(F.col("dst").alias("endpoint")).distinct(), "endpoint", "left_semi").withColumn("role", F.lit("calls"))
    return served.unionByName(called)


#: Calls of one kind up to which its pairs with routes are put together by one task.
KIND = 10_000


def best_server(calls: DataFrame, serves: DataFrame) -> DataFrame:
    """For each call (call_id, project, method, path) the server in another
    project: same path; the same verb is a sound set, any other heuristic; where
    several projects answer equally well all are kept as heuristic.

    The best grade and the number of answers are found for kinds of calls (project,
    verb, path) against kinds of routes. Calls and routes then meet in one join, and
    the pairs, which are the answer, aren't shuffled; those of a kind with many calls
    are put together by several tasks."""
    kind, of = ["path", "project", "method"], ["path", "server", "server_method"]
    s = serves.select(F.col("project").alias("server"), F.col("method").alias("server_method"), "path", "endpoint")
    k, r = calls.groupBy(*kind).agg(F.count("*").alias("calls")), s.groupBy(*of).agg(F.count("*").alias("routes"))
    j = k.join(r, "path").where(F.col("project") != F.col("server"))
    j = j.withColumn("rank", F.when(F.col("method") == F.col("server_method"), 3).when(F.col("server_method") == "ANY", 2).otherwise(0)).where("rank > 0")
    w = Window.partitionBy(*kind)  # no more rows than projects times verbs
    best = j.withColumn("top", F.max("rank").over(w)).where("rank = top").withColumn("answers", F.sum("routes").over(w))
    parts = best.withColumn("parts", F.ceil(F.max("calls").over(Window.partitionBy(*of)) / KIND).cast("int"))
    parts = parts.select(*kind, "server", F.col("server_method"), "answers", "rank", "parts")
    named = parts.withColumn("verb", F.coalesce("method", F.lit(""))).withColumn("nil", F.col("method").isNull()).drop("method")
    c = calls.select("call_id", "path", "project", F.coalesce("method", F.lit("")).alias("verb"), F.col("method").isNull().alias("nil"))
    c = c.join(named, ["path", "project", "verb", "nil"]).withColumn("part", F.pmod(F.xxhash64("call_id"), F.col("parts")).cast("int"))
    spread = s.join(parts.select(*of, "parts").distinct(), of).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = c.drop("parts").join(spread.drop("parts"), [*of, "part"])
    return pairs.select("call_id", "server", "endpoint", F.when(F.col("answers") > 1, 2).otherwise(F.col("rank")).cast("int").alias("rank"), "answers")


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of hits among n (null where n is 0)."""
    p = hits / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (p + z * z / (2 * n) - spread) / (1 + z * z / n))


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places; unknown (null) where b is 0."""
    return F.when(b != 0, F.round(a / b, 4))


def gate(base: DataFrame, head: DataFrame, allowed: float = 0.05, severe: float = 0.25) -> DataFrame:
    """Metrics (metric, value) of two runs: relative drop and finding."""
    j = base.select("metric", F.col("value").alias("before")).join(head.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    drop = F.when((F.col("before") > 0), (F.col("before") - F.coalesce("after", F.lit(0))) / F.col("before"))
    finding = (
        F.when(F.col("before").isNull(), "NEW_METRIC").when(F.col("after").isNull(), "LOST_METRIC")
        .when(drop > severe, "SEVERE_DROP").when(drop > allowed, "DROP").otherwise("OK")
    )
    return j.select("metric", "before", "after", F.round(drop, 4).alias("relative_drop"), finding.alias("finding"))


def seeded_order(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows with a position by sha256 of seed and key, and whether the key is held
    out (first byte of its own hash under 51 of 256)."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256)
    held = F.conv(F.substring(F.sha2(F.col(key), 256), 1, 2), 16, 10).cast("int") < 51
    return df.withColumn("draw", order).withColumn("held_out", held)
