"""A walk's start, its paths, what cut it short, and what lies above a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.walk import cut, multi_walk, up_edges
from plumbline.plans.vocab import FLOW_TYPES, floor_of


def handler_starts(endpoints: DataFrame, handles: DataFrame, mode: str) -> DataFrame:
    """(source, node): every admitted handler of an endpoint, or the endpoint itself
    where it has none."""
    h = handles.where(F.col("rank") >= floor_of(mode)).select(F.col("src").alias("endpoint"), F.col("dst").alias("node")).distinct()
    return endpoints.select("endpoint").join(h, "endpoint", "left").select(F.col("endpoint").alias("source"), F.coalesce("node", "endpoint").alias("node"))


def above(edges: DataFrame, targets: DataFrame, mode: str) -> DataFrame:
    """(target, node, rank, hops) of endpoints and screens above each target (target).

    HANDLES isn't walked upwards but into endpoints that something calls over HTTP;
    endpoints of reached handlers are derived at the end, grade and hops each best
    by itself, and so are the screens that call these."""
    starts = targets.select(F.col("target").alias("source"), F.col("target").alias("node")).distinct()
    walk = multi_walk(up_edges(edges), starts, mode, backward=True).withColumnRenamed("source", "target")
    own = starts.select(F.col("source").alias("target"), "node", F.lit(4).alias("rank"), F.lit(0).alias("hops"))
    at = cut(walk.unionByName(own))
    least = floor_of(mode)
    step = lambda kind: edges.where((F.col("type") == kind) & (F.col("rank") >= least)).select(F.col("src").alias("up"), F.col("dst").alias("node"), F.col("rank").alias("edge_rank"))
    up = lambda rows, kind: rows.join(step(kind), "node").groupBy("target", F.col("up").alias("node")).agg(F.max(F.least("rank", "edge_rank")).cast("int").alias("rank"), F.min(F.col("hops") + 1).cast("int").alias("hops"))
    routes = up(at, "HANDLES")
    screens = up(routes, "CALLS_HTTP")
    kinds = at.where(F.col("node").startswith("endpoint:") | F.col("node").startswith("screen:")).where(F.col("node") != F.col("target"))
    rows = kinds.select("target", "node", "rank", "hops").unionByName(routes).unionByName(screens)
    return rows.groupBy("target", "node").agg(F.max("rank").cast("int").alias("rank"), F.min("hops").cast("int").alias("hops"))


def paths(edges: DataFrame, start: str, mode: str = "conservative", types: tuple[str, ...] = FLOW_TYPES, most_hops: int | None = None) -> DataFrame:
    """(node, rank, hops, path) from one start: the nodes of one winning path, that of
    best grade, then fewest hops, then smallest ids from the end backwards.

    Parents are chosen by one join of each node's record with its neighbours' at one
    floor, and paths are put together by pointer doubling."""
    spark, least = edges.sparkSession, floor_of(mode)
    e = edges.where(F.col("type").isin(*types) & (F.col("rank") >= least)).groupBy("src", "dst").agg(F.max("rank").alias("edge_rank"))
    one = spark.createDataFrame([(start, start)], "source string, node string")
    floors = []
    for g in range(4, least - 1, -1):
        w = multi_walk(e.where(F.col("edge_rank") >= g).withColumn("rank", F.lit(4)), one, "strict", most_hops, None).select("node", "hops").where(F.col("node") != start)
        floors.append(w.withColumn("floor", F.lit(g)))
    at = floors[0]
    for f in floors[1:]:
        at = at.unionByName(f)
    at = cut(at.unionByName(spark.createDataFrame([(start, 0, g) for g in range(4, least - 1, -1)], "node string, hops int, floor int")))
    before = at.select(F.col("node").alias("src"), (F.col("hops") + 1).alias("hops"), "floor")
    parent = at.join(e.withColumnRenamed("dst", "node"), "node").where(F.col("edge_rank") >= F.col("floor")).join(before, ["src", "hops", "floor"])
    parent = cut(parent.groupBy("node", "floor", "hops").agg(F.min("src").alias("up")))
    # each step doubles what is known of a path: (node, floor, up, nodes between)
    chain = parent.select("node", "floor", "hops", "up", F.array("node").alias("path"))
    while not chain.where(F.col("up") != start).isEmpty():
        more = chain.select(F.col("node").alias("up"), "floor", F.col("up").alias("up2"), F.col("path").alias("head"))
        on = chain.where(F.col("up") != start).join(more, ["up", "floor"]).select("node", "floor", "hops", F.col("up2").alias("up"), F.concat("head", "path").alias("path"))
        chain = cut(chain.where(F.col("up") == start).unionByName(on))
    best = F.max_by(F.struct("floor", "hops", "path"), "floor")
    out = chain.groupBy("node").agg(best.alias("b"))
    return out.select("node", F.col("b.floor").alias("rank"), F.col("b.hops").alias("hops"), F.concat(F.array(F.lit(start)), "b.path").alias("path"))


def without_folded(path: Column, folded: Column) -> Column:
    """A path without the nodes between its ends that ``folded`` (an array) holds, as
    mapper interfaces are folded into the statements they name."""
    return F.filter(path, lambda x, i: (i == 0) | (i == F.size(path) - 1) | ~F.array_contains(folded, x))


def cut_census(edges: DataFrame, starts: DataFrame, mode: str, max_hops: int | None = None, generated: DataFrame | None = None) -> DataFrame:
    """What cut each source's walk short: (source, by_mode, generated, depth).

    ``by_mode``: edges of walked types at expanded nodes under the mode's floor;
    ``generated``: admitted ones between two generated nodes (``generated``: id);
    ``depth``: nodes at the last hop with an admitted edge to a node not reached."""
    least = floor_of(mode)
    e = edges.where(F.col("type").isin(*FLOW_TYPES)).select("src", "dst", "rank")
    made = (generated if generated is not None else e.limit(0).select(F.col("src").alias("id"))).select("id").distinct()
    e = e.join(made.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(made.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    e = cut(e.select("src", "dst", "rank", F.coalesce(F.col("a") & F.col("b"), F.lit(False)).alias("inner")))
    walk = cut(multi_walk(e.where("not inner"), starts, mode, max_hops, None).select("source", "node", "hops"))
    begin = starts.select("source", "node").distinct()
    seen = cut(walk.join(begin, ["source", "node"], "left_anti").unionByName(begin.withColumn("hops", F.lit(0))))
    expanded = seen if max_hops is None else seen.where(F.col("hops") < max_hops)
    at = expanded.join(e, F.col("node") == F.col("src"))
    mode_cut = at.groupBy("source").agg(F.count_if(F.col("rank") < least).alias("by_mode"), F.count_if((F.col("rank") >= least) & F.col("inner")).alias("generated"))
    out = begin.select("source").distinct().join(mode_cut, "source", "left")
    if max_hops is None:
        return out.select("source", F.coalesce("by_mode", F.lit(0)).alias("by_mode"), F.coalesce("generated", F.lit(0)).alias("generated"), F.lit(0).cast("long").alias("depth"))
    edge = seen.where(F.col("hops") == max_hops).join(e.where((F.col("rank") >= least) & ~F.col("inner")), F.col("node") == F.col("src")).select("source", "node", "dst")
    open_end = edge.join(seen.select("source", F.col("node").alias("dst")), ["source", "dst"], "left_anti")
    depth = open_end.groupBy("source").agg(F.countDistinct("node").alias("depth"))
    return out.join(depth, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("by_mode", "generated", "depth")])
