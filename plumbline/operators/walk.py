"""Graded reachability.

A path is as certain as its weakest edge, and a node's record is its best grade,
then the fewest hops at that grade. That equals one breadth-first search for
each grade floor: at floor g only edges of rank g or more are walked; a node's
grade is the largest floor that reaches it and its hops are that floor's. All
floors and all sources advance together: the frontier holds (source, floor,
node), each round is one equi-join with the edges and one anti-join with what
was reached before, and is written to the shared checkpoint folder, so lineage
stays short and a lost executor costs no earlier round.

A graph of at most SMALL distinct edges, which is checked first, is instead sent
to all tasks as arrays, and each task searches from its own sources.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.vocab import FLOW_TYPES, floor_of


#: Distinct edges up to which a graph is broadcast (about 50 MB).
SMALL = 1_000_000


def reliable(spark: SparkSession) -> str:
    """The session's checkpoint folder. A cluster must name a shared one; only in
    one process is a local one made."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-checkpoints-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the checkpoint folder and read again."""
    folder = f"{reliable(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def multi_walk(edges: DataFrame, starts: DataFrame, mode: str = "conservative", max_hops: int | None = None, types: tuple[str, ...] | None = FLOW_TYPES, backward: bool = False, small: int = SMALL) -> DataFrame:
    """(source, node, rank, hops) of every node that each source reaches.

    ``starts``: (source, node). A start is in the result only if a cycle enters
    it again. ``types`` None walks all edge types; edges need (src, dst, rank),
    and type unless ``types`` is None. ``max_hops`` None walks until nothing new
    is reached.
    """
    least = floor_of(mode)
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    e = e.where(F.col("rank") >= least)
    e = e.select(F.col("dst" if backward else "src").alias("node"), F.col("src" if backward else "dst").alias("next"), F.col("rank").cast("int").alias("rank"))
    e = cut(e.where("node is not null and next is not null"))
    n = e.count()
    if n <= 4 * small:  # counted before anything is sent to the driver
        best = e.groupBy("node", "next").agg(F.max("rank").alias("rank"))  # parallel edges: the best one
        if n <= small or best.count() <= small:
            return _walk_arrays(best.toArrow(), starts, least, max_hops)
    return _walk_rounds(e, starts, least, max_hops)


def _coded(e: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (node, next, rank) with codes a and b of their ends, ``inner`` where the
    next node has edges of its own, ``lone`` where no other edge leads to it, and
    ``name``s of the codes a. Codes are hashes; should two nodes share one, another
    seed is taken."""
    code = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    names = cut(e.groupBy(code("node").alias("a")).agg(F.min("node").alias("name"), F.max("node").alias("other")))
    rows = e.select(code("node").alias("a"), code("next").alias("b"), "next", "rank").join(names.select(F.col("a").alias("b"), "name"), "b", "left")
    lone = F.count("*").over(Window.partitionBy("b")) == 1
    clash = F.coalesce(F.col("name") != F.col("next"), F.lit(False))
    rows = cut(rows.select("a", "b", F.when(F.col("name").isNull() | clash, F.col("next")).alias("next"), "rank", F.col("name").isNotNull().alias("inner"), lone.alias("lone"), clash.alias("clash")))
    if not names.where("name <> other").isEmpty() or not rows.where("clash").isEmpty():
        return _coded(e, seed + 1)
    return rows.drop("clash"), names.select("a", "name")


def _walk_rounds(e: DataFrame, starts: DataFrame, least: int, max_hops: int | None) -> DataFrame:
    """``multi_walk`` over any number of edges (node, next, rank).

    Rounds go over the edges between nodes that have edges themselves, by codes and
    kept apart by node, so a round shuffles its frontier and no edges. Nodes that
    lead nowhere, mostly the larger part, are joined once to all that was reached.

    A round is cleared of what was reached before once as many rows were added as a
    quarter of all, and at least each time the hops have doubled; rows that come
    again in between lose to the earlier ones at the end."""
    spark = e.sparkSession
    edge, names = _coded(e)
    parts = max(spark.sparkContext.defaultParallelism, edge.where("inner").count() // 500_000)
    inner = edge.where("inner").select("a", "b", "rank").repartition(parts, "a").groupBy("a", "b").agg(F.max("rank").alias("rank")).persist()
    grades = list(range(4, least - 1, -1))
    begin = starts.select("source", F.col("node").alias("name")).distinct().join(names, "name").select("source", "a")
    begin = cut(begin.select("source", F.explode(F.array(*[F.lit(g) for g in grades])).alias("floor"), "a"))
    front, layers, known, added, cleared = begin, [], 0, 0, 1
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        few = layers and n <= 100_000  # a few MB at most
        step = (F.broadcast(front) if few else front.repartition(parts, "a").hint("merge")).join(inner, "a").where(F.col("rank") >= F.col("floor")).select("source", "floor", F.col("b").alias("a")).distinct()
        if layers and (hop >= 2 * cleared or 4 * added >= known):
            step = step.join(union_all(layers).select("source", "floor", "a"), ["source", "floor", "a"], "left_anti")
            added, cleared = 0, hop
        front = cut(step)
        n = front.count()
        if not n:
            break
        layers.append(front.withColumn("hops", F.lit(hop)))
        known, added = known + n, added + n
        k = hop
        while k % 8 == 0:  # eight of one size become one, so a row is written again log8(hops) times
            layers[-8:] = [cut(union_all(layers[-8:]))]
            k //= 8
    inner.unpersist()

    # of every source and node the fewest hops at each floor: h with the starts, k without
    at = union_all([begin.withColumn("hops", F.lit(0)), *layers]).groupBy("source", "a").agg(
        *[F.min(F.when(F.col("floor") == g, F.col("hops"))).alias(f"h{g}") for g in grades], *[F.min(F.when((F.col("floor") == g) & (F.col("hops") > 0), F.col("hops"))).alias(f"k{g}") for g in grades]
    )
    at = cut(at)
    best = F.coalesce(*[F.when(F.col(f"k{g}").isNotNull(), F.struct(F.lit(g).alias("rank"), F.col(f"k{g}").alias("hops"))) for g in grades])
    out = [at.withColumn("r", best).where("r is not null").join(names, "a").select("source", F.col("name").alias("node"), "r.rank", "r.hops")] if layers else []
    ends = edge.where("not inner").select("a", F.col("next").alias("node"), F.col("rank").alias("edge_rank"), "lone")
    hops = lambda g: F.when((F.col("edge_rank") >= g) & (F.lit(True) if max_hops is None else F.col(f"h{g}") < max_hops) & F.col(f"h{g}").isNotNull(), F.struct(F.lit(g).alias("rank"), (F.col(f"h{g}") + 1).alias("hops")))
    for lone in (True, False):  # a node with one way in has one row for each source as it is
        some = ends.where(F.col("lone") == lone)
        if some.isEmpty():
            continue
        rows = at.join(some, "a").withColumn("r", F.coalesce(*[hops(g) for g in grades])).where("r is not null").select("source", "node", "r.rank", "r.hops")
        if not lone:
            most = F.max(F.struct("rank", (-F.col("hops")).alias("h")))
            rows = rows.groupBy("source", "node").agg(most.alias("b")).select("source", "node", F.col("b.rank").alias("rank"), (-F.col("b.h")).alias("hops"))
        out.append(rows)
    return union_all(out) if out else spark.createDataFrame([], "source string, node string, rank int, hops int")


def _walk_arrays(table, starts: DataFrame, least: int, max_hops: int | None) -> DataFrame:
    """``multi_walk`` over edges (node, next, rank) that fit every task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = starts.sparkSession
    ends = pa.chunked_array([*table["node"].chunks, *table["next"].chunks], pa.string()).combine_chunks().dictionary_encode()
    names = ends.dictionary.to_numpy(zero_copy_only=False)
    code = ends.indices.to_numpy()
    src, dst, rank = code[: table.num_rows], code[table.num_rows :], pc.cast(table["rank"], pa.int8()).to_numpy()
    order = np.argsort(src, kind="stable")
    shared = spark.sparkContext.broadcast((names, np.searchsorted(src[order], np.arange(len(names) + 1)), dst[order], rank[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, first, to, rank = shared.value
        index = pd.Index(names)
        for pdf in batches:
            at = index.get_indexer(pdf["node"])
            source, source_names = pd.factorize(pdf["source"])
            best: list[tuple[np.ndarray, int, np.ndarray]] = []
            for floor in range(4, least - 1, -1):
                known = np.zeros(len(source_names) * len(names), bool)
                front = np.unique(source[at >= 0].astype(np.int64) * len(names) + at[at >= 0])
                for hop in count(1) if max_hops is None else range(1, max_hops + 1):
                    node = front % len(names)
                    n = first[node + 1] - first[node]
                    edge = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    key = np.repeat(front - node, n)
                    ok = rank[edge] >= floor
                    front = np.unique(key[ok] + to[edge[ok]])
                    front = front[~known[front]]
                    if not len(front):
                        break
                    known[front] = True
                    best.append((front, floor, np.full(len(front), hop)))
            if best:
                key, floor, hops = np.concatenate([b[0] for b in best]), np.concatenate([np.full(len(b[0]), b[1]) for b in best]), np.concatenate([b[2] for b in best])
                keep = np.sort(np.unique(key, return_index=True)[1])  # the strongest floor comes first
                key = key[keep]
                yield pd.DataFrame({"source": np.asarray(source_names)[key // len(names)], "node": names[key % len(names)], "rank": floor[keep], "hops": hops[keep]})

    # a source's starts come to one batch: they are grouped into one row first
    grouped = starts.select("source", "node").distinct()
    single = grouped.groupBy("source").agg(F.collect_set("node").alias("nodes"))

    some = max(1, 64_000_000 // max(1, len(names)))  # sources searched at once, so that even a dense graph's reach fits

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (b.iloc[a : a + some] for b in batches for a in range(0, len(b), some))
        yield from run(p.explode("nodes", ignore_index=True).rename(columns={"nodes": "node"}) for p in parts)

    return single.mapInPandas(opened, "source string, node string, rank int, hops int")


def reach(edges: DataFrame, start: str, mode: str = "conservative", max_hops: int | None = None, types: tuple[str, ...] | None = FLOW_TYPES, backward: bool = False, small: int = SMALL) -> DataFrame:
    """(node, rank, hops) from one start."""
    one = edges.sparkSession.createDataFrame([(start, start)], "source string, node string")
    return multi_walk(edges, one, mode, max_hops, types, backward, small).drop("source")


def impact(edges: DataFrame, target: str, mode: str = "conservative", limit: int = 25, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """What reaches ``target``: one page in order of grade, kind and id, and the
    total number of rows. Limits out of range are errors, not clamped."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset 0 or more")
    rows = reach(edges, target, mode, backward=True).withColumn("kind", F.substring_index("node", ":", 1))
    page = rows.orderBy(F.desc("rank"), "kind", "node").offset(offset).limit(limit)
    return page, rows.agg(F.count("*").alias("total"))


def up_edges(edges: DataFrame) -> DataFrame:
    """Edges for a walk upwards: HANDLES is only followed into an endpoint that
    something calls over HTTP."""
    called = edges.where(F.col("type") == "CALLS_HTTP").select(F.col("dst").alias("src")).distinct()
    handles = edges.where(F.col("type") == "HANDLES").join(called, "src", "left_semi")
    return edges.where(F.col("type") != "HANDLES").unionByName(handles.select(*edges.columns))


def without_generated_interior(edges: DataFrame, generated: DataFrame) -> DataFrame:
    """Edges but those between two generated nodes (``generated``: id)."""
    g = generated.select("id").distinct()
    a = edges.join(g.select(F.col("id").alias("src"), F.lit(True).alias("_a")), "src", "left")
    both = a.join(g.select(F.col("id").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    return both.where("_a is null or _b is null").select(*edges.columns)


def derived_routes(reached: DataFrame, handles: DataFrame) -> DataFrame:
    """Endpoints above reached handlers: best grade and fewest hops, each by itself."""
    h = handles.select(F.col("src").alias("endpoint"), F.col("dst").alias("node"), F.col("rank").alias("handles_rank"))
    rows = reached.join(h, "node")
    return rows.groupBy("source", "endpoint").agg(F.max(F.least("rank", "handles_rank")).alias("rank"), F.min(F.col("hops") + 1).alias("hops"))


def neighborhood(edges: DataFrame, focus: str, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of a node in either direction, ungraded, and the
    edges with both ends among them."""
    if not 1 <= hops <= 5:
        raise ValueError("hops must be 1 to 5")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("rank", F.lit(4))
    near = reach(both, focus, "strict", hops, types=None).select("node", "hops").where(F.col("node") != focus)
    nodes = near.unionByName(edges.sparkSession.createDataFrame([(focus, 0)], "node string, hops int"))
    ids = nodes.select("node")
    inside = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, inside


def upstream(edges: DataFrame, starts: DataFrame, types: tuple[str, ...] = FLOW_TYPES) -> DataFrame:
    """All nodes from which some start is reached, grades aside (``starts``: node)."""
    e = cut(edges.where(F.col("type").isin(*types)).select("src", "dst", "type", F.lit(4).alias("rank")))
    # shards of starts, so that no task searches for all of them; rounds are spread by
    # node as it is, and there a node is reached once for all starts
    shard = F.pmod(F.xxhash64("node"), F.lit(64)).cast("string") if e.count() <= SMALL else F.lit("all")
    s = starts.select(shard.alias("source"), "node")
    return multi_walk(e, s, "strict", backward=True).select("node").distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest id that is connected, by large-star and
    small-star rounds; ``nodes`` (node) adds nodes without edges."""
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    if nodes is not None:
        alone = nodes.select("node").distinct().join(out, "node", "left_anti")
        out = out.unionByName(alone.withColumn("component", F.col("node")))
    return out


def communities(edges: DataFrame, rounds: int = 12, small: int = SMALL) -> DataFrame:
    """(node, label): each round all nodes take the commonest label around them, the
    smallest one of several, until none changes; two that only swap labels would
    never settle, so ``rounds`` ends that.

    Of up to ``small`` nodes the labels go to all tasks as one array each round, and
    the links stay where they are; of more, labels are joined."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = cut(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    nodes = cut(both.select(F.col("src").alias("node")).distinct())
    if nodes.count() <= small:
        return _labels_in_arrays(both, nodes, rounds)
    labels = nodes.withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        w = Window.partitionBy("src").orderBy(F.desc("n"), "label")
        new = cut(votes.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("src").alias("node"), "label"))
        if new.join(labels, ["node", "label"], "left_anti").isEmpty():
            break
        labels = new
    return labels


def _labels_in_arrays(both: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``communities`` over links in both directions, labels as places in the order of ids."""
    spark = both.sparkSession
    ids = sorted(r[0] for r in nodes.collect())
    if not ids:
        return nodes.withColumn("label", F.col("node"))
    code = spark.createDataFrame(pd.DataFrame({"id": ids, "code": np.arange(len(ids), dtype=np.int32)}), "id string, code int")
    coded = both.join(code.select(F.col("id").alias("src"), F.col("code").alias("s")), "src").join(code.select(F.col("id").alias("dst"), F.col("code").alias("d")), "dst")
    parts = max(spark.sparkContext.defaultParallelism, both.count() // 2_000_000)
    links = coded.select("s", "d").repartition(parts, "s").persist()
    labels = np.arange(len(ids), dtype=np.int32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(labels)

        def vote(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now = shared.value
            keys = [b["s"].to_numpy(np.int64) * len(now) + now[b["d"].to_numpy()] for b in batches]
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                at, label = key // len(now), key % len(now)
                order = np.lexsort((label, -n, at))
                first = order[np.unique(at[order], return_index=True)[1]]
                yield pd.DataFrame({"s": at[first].astype(np.int32), "label": label[first].astype(np.int32)})

        got = links.mapInPandas(vote, "s int, label int").toArrow()
        new = labels.copy()
        new[got["s"].to_numpy()] = got["label"].to_numpy()
        shared.destroy()
        if (new == labels).all():
            break
        labels = new
    links.unpersist()
    return spark.createDataFrame(pd.DataFrame({"node": ids, "label": np.asarray(ids, object)[labels]}), "node string, label string")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
