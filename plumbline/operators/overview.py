"""The overview of a pack: censuses, and gaps with a class and a remedy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.walk import cut, union_all
from plumbline.plans.vocab import FLOW_TYPES, floor_of

#: Class of each kind of gap: an input is missing, something wasn't resolved, the
#: question looked away, the walk didn't get there, or it is a fact to know.
GAP_CLASS = {
    "input": ("no-catalog", "not-shipped", "http-calls-leaving-pack", "catalog-rules-assumed"),
    "unresolved": ("catalog-tables-unread", "catalog-read-in-part", "unresolved-calls", "external-symbols", "screen-components-unresolved", "screens-from-server", "jpa-statements-unresolved", "mp-columns-runtime-only"),
    "query": ("mode-floor", "depth-cap", "node-cap", "generated-walk-skip"),
    "unreached": ("endpoints-without-statement", "statements-not-reached", "tables-not-reached", "openapi-drift"),
    "info": ("multi-handler-routes", "duplicate-types", "generated-code", "screens-seen-at-run-time", "runtime-evidence", "contract-links"),
}
REMEDY = {
    "input": "give the missing input and analyse again", "unresolved": "read the diagnostics of what wasn't resolved", "query": "ask with a lower mode or a greater depth",
    "unreached": "look at what leads there", "info": "nothing to mend",
}


def gaps(counts: DataFrame, always: tuple[str, ...] = ("unresolved-calls",)) -> DataFrame:
    """(kind, class, count, remedy) of counts (kind, count) over 0, and of those that
    are told even when they are 0. A kind that no class names is info."""
    cls = F.lit("info")
    for name, kinds in GAP_CLASS.items():
        cls = F.when(F.col("kind").isin(*kinds), name).otherwise(cls)
    remedy = F.lit(None).cast("string")
    for name, text in REMEDY.items():
        remedy = F.when(F.col("class") == name, text).otherwise(remedy)
    return counts.where((F.col("count") > 0) | F.col("kind").isin(*always)).withColumn("class", cls).withColumn("remedy", remedy).select("kind", "class", "count", "remedy")


def merged_nodes(facts: DataFrame) -> DataFrame:
    """One node for each id from facts (id, seq, lane, attrs map): of each attribute
    the last that is given, and the lanes in order where there are several."""
    one = facts.select("id", "seq", F.explode("attrs").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    attrs = one.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    lanes = facts.groupBy("id").agg(F.sort_array(F.collect_set("lane")).alias("lanes"))
    return lanes.join(attrs, "id", "left").select("id", F.when(F.size("lanes") > 1, F.col("lanes")).alias("lanes"), "attrs")


def screens(edges: DataFrame) -> DataFrame:
    """One row: screens that call or render something, with calls, with components,
    and those that a recording alone knows."""
    of = edges.where(F.col("src").startswith("screen:")).groupBy("src").agg(
        F.bool_or(F.col("type") == "CALLS_HTTP").alias("calls"), F.bool_or(F.col("type") == "RENDERS").alias("renders"), F.max("rank").alias("best")
    )
    return of.agg(F.count("*").alias("screens"), F.count_if("calls").alias("calling"), F.count_if("renders").alias("rendering"), F.count_if(F.col("best") <= 1).alias("seen_at_run_time"))


def duplicate_types(types: DataFrame) -> DataFrame:
    """Types (name, file) that several files declare, with the number of files."""
    return types.groupBy("name").agg(F.countDistinct("file").alias("files")).where("files > 1")


def pack_counts(edges: DataFrame, endpoints: DataFrame, reached: DataFrame, generated: DataFrame, mode: str) -> DataFrame:
    """(kind, count) of the gaps that the graph itself shows. ``endpoints``: (endpoint),
    ``reached``: (endpoint, stmt), ``generated``: (id)."""
    row = lambda kind, df: df.agg(F.count("*").alias("count")).select(F.lit(kind).alias("kind"), "count")
    e = edges.select("src", "dst", "type", "rank")
    handles = e.where("type = 'HANDLES'")
    reached = cut(reached.select("endpoint", "stmt"))
    st = cut(reached.select("stmt").distinct())
    served = handles.select(F.col("src").alias("endpoint")).distinct()
    outbound = e.where("type = 'CALLS_HTTP'").select(F.col("dst").alias("endpoint")).distinct().join(served, "endpoint", "left_anti")
    stmts = e.where("type = 'IMPLEMENTS_STMT'").select(F.col("dst").alias("stmt")).distinct()
    sql = e.where(F.col("type") == "EXECUTES")
    tables = sql.select(F.col("dst").alias("table")).distinct()
    seen = sql.where(F.col("rank") >= floor_of(mode)).join(st, F.col("src") == F.col("stmt"), "left_semi").select(F.col("dst").alias("table")).distinct()
    made = generated.select("id").distinct()
    inner = e.where(F.col("type").isin(*FLOW_TYPES)).join(made.withColumnRenamed("id", "src"), "src", "left_semi").join(made.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return union_all([
        row("no-catalog", tables.join(e.where("type = 'DECLARES'").select(F.col("src").alias("table")).distinct(), "table", "left_anti")),
        row("unresolved-calls", e.where("type in ('CALLS', 'MAY_CALL') and rank = 0")),
        row("http-calls-leaving-pack", outbound),
        row("multi-handler-routes", handles.groupBy("src").agg(F.countDistinct("dst").alias("n")).where("n >= 2")),
        row("endpoints-without-statement", endpoints.select("endpoint").distinct().join(reached.select("endpoint").distinct(), "endpoint", "left_anti")),
        row("statements-not-reached", stmts.join(st, "stmt", "left_anti")),
        row("tables-not-reached", tables.join(seen, "table", "left_anti")),
        row("generated-code", made),
        row("generated-walk-skip", inner.where(F.col("rank") >= floor_of(mode))),
        row("mode-floor", e.where(F.col("type").isin(*FLOW_TYPES) & (F.col("rank") < floor_of(mode)))),
    ])
