"""Folding of execution traces into observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.walk import cut

GAP_SECONDS = 1800


def sessions(events: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Events with a session number for each user: a new one after ``gap`` seconds."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) > gap * 1_000_000, F.lit(True))
    return events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def observations(events: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Caller and callee by neighbouring events of a session: count, first and last
    time, and whether all came at once."""
    s = sessions(events, gap)
    w = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    pairs = s.withColumn("caller", F.lag("event_type").over(w)).withColumn("before", F.lag("ts").over(w)).where("caller is not null")
    direct = (F.unix_micros("ts") - F.unix_micros("before")) <= 60_000_000
    return pairs.groupBy("caller", F.col("event_type").alias("callee")).agg(F.count("*").alias("observed"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.bool_or(direct).alias("direct"))


def nearest_ancestor(spans: DataFrame, facet: str, most_depth: int | None = None) -> DataFrame:
    """(span_id, ancestor, depth): the nearest span above that has the facet, at
    most ``most_depth`` parents up if that is given. Each round doubles the reach
    of all open chases; what is open beyond the number of spans is a cycle."""
    s = cut(spans.select("span_id", "parent_span_id", F.col(facet).isNotNull().alias("has")).dropDuplicates(["span_id"]))
    has = s.select(F.col("span_id").alias("at"), F.col("has").alias("found"))
    jump = cut(s.select("span_id", F.col("parent_span_id").alias("at"), F.lit(1).alias("depth")).join(has, "at").select("span_id", "at", "depth", "found"))
    far, n = 1, s.count()
    while far <= n and not jump.where("not found").isEmpty():
        more = jump.select(F.col("span_id").alias("at"), F.col("at").alias("up"), F.col("depth").alias("more"), F.col("found").alias("up_found"))
        on = jump.where("not found").join(more, "at").select("span_id", F.col("up").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("up_found").alias("found"))
        jump = cut(jump.where("found").unionByName(on))
        far *= 2
    out = jump.where("found").select("span_id", F.col("at").alias("ancestor"), "depth")
    return out if most_depth is None else out.where(F.col("depth") <= most_depth)


def first_wins(keys: Column, values: Column) -> Column:
    """A map from arrays of keys and values in which the first of equal keys stays."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    distinct = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(distinct)
