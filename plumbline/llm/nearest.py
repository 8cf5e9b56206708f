"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by several Gaussian projections, each cut into cells of
one width. A query visits its own bucket and those next to it, over all tables
in the order of estimated success: the smaller the squared distances to the
cell borders that a bucket lies across, the sooner. All rows of a visited bucket
are measured exactly, the tables' candidates are merged and ranked.

Width, number of projections and number of probes are fitted on a bounded
sample so that recall there reaches ``target``; every row is indexed. Equal
vectors are indexed once with their smallest ids, and a bucket of many vectors
or queries is measured in blocks of both. A query that finds fewer rows than it
must return is measured against all rows, in blocks, and so are all queries
where no width and number of probes reach ``target`` on the sample. Ties go to
the smaller id.

Vectors that are null, zero, hold null or non-finite components, or have another
length than most take no part, nor have rows with a null id. Repeated rows count
once. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common

BLOCK, ASKS, PER_TABLE = 4096, 1024, 300


@dataclass
class Index:
    planes: np.ndarray  # tables x dimensions x projections
    shift: np.ndarray  # tables x projections
    odd: np.ndarray  # tables x projections, 64-bit multipliers
    steps: np.ndarray  # perturbation sets by rank of border distance, PER_TABLE x 2 projections
    probes: int = 1

    def cells(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        f = x @ self.planes[t] + self.shift[t]
        low = np.floor(f)
        return low.astype(np.int64).astype(np.uint64), f - low

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table."""
        return np.stack([self._key((self.cells(x, t)[0] * self.odd[t]).sum(axis=1), t) for t in range(len(self.planes))], axis=1)

    @staticmethod
    def _key(h: np.ndarray, t: int) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` buckets of each query with the best estimate."""
        keys, scores = [], []
        for t in range(len(self.planes)):
            low, rest = self.cells(x, t)
            border = np.concatenate([rest, 1 - rest], axis=1) ** 2
            delta = np.concatenate([np.uint64(0) - self.odd[t], self.odd[t]])
            order = np.argsort(border, axis=1, kind="stable")
            scores.append(np.take_along_axis(border, order, 1) @ self.steps.T)
            moved = delta[order]
            base = (low * self.odd[t]).sum(axis=1)
            key = np.stack([base + (moved * s.astype(np.uint64)).sum(axis=1) for s in self.steps], axis=1)
            keys.append(self._key(key.ravel(), t).reshape(key.shape))
        key, score = np.concatenate(keys, axis=1), np.concatenate(scores, axis=1)
        best = np.argsort(score, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(key, best, 1)


def perturbations(m: int, n: int) -> np.ndarray:
    """The first ``n`` perturbation sets of 2m border ranks by expected score
    (Lv and others, 2007); a set never crosses both borders of a projection."""
    rank = np.arange(1, 2 * m + 1)
    far = 2 * m + 1 - rank
    z = np.where(rank <= m, rank * (rank + 1) / (4 * (m + 1) * (m + 2)), 1 - far / (m + 1) + far * (far + 1) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(float(z[0]), (0,))]
    while heap and len(out) < n:
        score, own = heapq.heappop(heap)
        if len({min(j, 2 * m - 1 - j) for j in own}) == len(own):
            out.append(own)
        last = own[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score + float(z[last + 1]), (*own, last + 1)))
            heapq.heappush(heap, (score - float(z[last]) + float(z[last + 1]), (*own[:-1], last + 1)))
    steps = np.zeros((len(out), 2 * m))
    for i, own in enumerate(out):
        steps[i, list(own)] = 1
    return steps


def make_index(dim: int, scale: float, tables: int, m: int, seed: int = 23) -> Index:
    rng = np.random.default_rng([seed, m])
    planes = rng.normal(size=(tables, dim, m)) / (2.0 * scale)
    return Index(planes, rng.random((tables, m)), rng.integers(0, 2**63, (tables, m), dtype=np.uint64) | np.uint64(1), perturbations(m, PER_TABLE))


def fit(sample: np.ndarray, n: int, k: int, tables: int, target: float) -> Index | None:
    """An index for ``n`` rows whose number of probes reaches ``target`` recall
    among the sample; fewer projections where no number does, and no index where
    one projection doesn't. The sample's neighbours are farther away than those
    among all rows, so this errs upwards."""
    rng = np.random.default_rng(29)
    scale = float(np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean()))
    if scale == 0:
        scale = float(np.linalg.norm(sample[0]))
    asked = rng.permutation(len(sample))[:96]
    m = max(2, round(math.log2(max(4, n)) / 2.6))
    true = []
    for q in asked:
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        true.append(np.argsort(d, kind="stable")[: min(k, len(sample) - 1)])
    while True:
        index = make_index(sample.shape[1], scale, tables, m)
        own = index.buckets(sample)
        probed = index.probed(sample[asked], tables * PER_TABLE)
        # the probe at which each true neighbour is first met
        first = np.full((len(asked), max(1, min(k, len(sample) - 1))), probed.shape[1], np.int64)
        for i, near in enumerate(true):
            rank = {b: r for r, b in reversed(list(enumerate(probed[i].tolist())))}
            for j, c in enumerate(near.tolist()):
                first[i, j] = min((rank[b] for b in own[c].tolist() if b in rank), default=probed.shape[1])
        at = int(np.sort(first.ravel())[min(first.size - 1, math.ceil(target * first.size) - 1)])
        if at < probed.shape[1]:
            index.probes = min(probed.shape[1], at + 1 + at // 8)
            return index
        if m == 1:
            return None
        m -= 1


def _blocked(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Rows and queries (bucket, id, low, vec) for ``_measured``: of a large bucket,
    about BLOCK rows meet about ASKS queries at a time, each pair of blocks once."""

    def parts(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy("bucket").count().where(F.col("count") > most).select("bucket", F.ceil(F.col("count") / most).cast("long").alias(name))

    large = parts(rows, BLOCK, "of_rows").join(parts(asks, ASKS, "of_asks"), "bucket", "full_outer")
    one = F.lit(1).cast("long")
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def cut(df: DataFrame, own: str, others: str, is_ask: bool) -> DataFrame:
        df = df.join(large, "bucket", "left").withColumns({n: F.coalesce(n, one) for n in ("of_rows", "of_asks")})
        df = df.withColumn("own", number(own)).withColumn("other", each(others))
        block = (F.col("other") if is_ask else F.col("own")) * F.col("of_asks") + (F.col("own") if is_ask else F.col("other"))
        return df.select("bucket", block.alias("block"), F.lit(is_ask).alias("asks"), "id", "low", "vec")

    return cut(rows, "of_rows", "of_asks", False).unionByName(cut(asks, "of_asks", "of_rows", True))


def _measured(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows (bucket, block, asks, id, low, vec) in order of bucket and block,
    queries first: each query's ``keep`` nearest vectors of the group."""

    def near(group: pd.DataFrame) -> pd.DataFrame | None:
        asks = group["asks"].to_numpy()
        n = int(asks.sum())
        if not n or n == len(group):
            return None
        vec = np.frombuffer(b"".join(map(bytes, group["vec"])), np.float64).reshape(len(group), -1)
        q, v = vec[:n], vec[n:]
        ids, low, who = group["id"].to_numpy()[n:], group["low"].to_numpy()[n:], group["id"].to_numpy()[:n]
        step = max(1, (1 << 21) // v.size)
        out = []
        for a in range(0, n, step):
            d = np.sqrt(((q[a : a + step, None] - v[None]) ** 2).sum(axis=2))
            for i in range(len(d)):
                cut = d[i]
                pick = np.arange(len(cut))
                if len(cut) > keep:
                    pick = np.flatnonzero(cut <= np.partition(cut, keep - 1)[keep - 1])
                pick = pick[np.lexsort((low[pick], cut[pick]))[:keep]]
                out.append(pd.DataFrame({"query_id": who[a + i], "gid": ids[pick], "low": low[pick], "score": cut[pick]}))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held:
                pdf = pd.concat([*held, pdf], ignore_index=True)
            b, k = pdf["bucket"].to_numpy(), pdf["block"].to_numpy()
            edges = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (k[1:] != k[:-1])) + 1).tolist()]
            for x, y in zip(edges, edges[1:]):
                if (got := near(pdf.iloc[x:y])) is not None:
                    yield got
            held = [pdf.iloc[edges[-1] :]]
        if held and (got := near(held[0])) is not None:
            yield got

    rows = rows.repartition(common.width(rows.sparkSession), "bucket", "block").sortWithinPartitions("bucket", "block", F.desc("asks"), "id")
    return rows.mapInPandas(run, "query_id long, gid long, low long, score double")


def _packed(df: DataFrame, id_col: str, low: str, keys: str) -> DataFrame:
    """Rows for ``_measured``: an id, its vector as bytes, its buckets one by one."""
    return df.select(F.explode(keys).alias("bucket"), F.col(id_col).alias("id"), F.col(low).alias("low"), "vec")


def search(vectors: DataFrame, every: int = 100, k: int = 10, tables: int = 8, target: float = 0.95, sample: int = 4096) -> DataFrame:
    """Each query's ``k`` nearest rows found: (query_id, rank, vec_id, score).

    ``sample`` bounds the vectors on which the index is fitted."""
    spark = vectors.sparkSession
    common.ship(spark)
    folder = common.shared_dir(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)  # NaN sorts over infinity
    v = v.where(fine)
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.where(F.size("v") == dims["d"]).dropDuplicates(["vec_id", "v"])
    top = v.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    groups = top.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("gid"), F.element_at("ids", 1).alias("low"), "ids", "v")
    groups = common.written(spark, groups, f"{folder}/groups")
    queries = common.written(spark, v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), f"{folder}/queries")
    n = groups.count()
    unit = (F.pmod(F.xxhash64("gid", F.lit(31)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    seen = [r["v"] for r in groups.where(unit < 1.5 * sample / n).select("v").limit(sample).collect()]
    if not seen:
        seen = [r["v"] for r in groups.select("v").limit(sample).collect()]
    index = fit(np.array(seen, np.float64), n, k, tables, target)

    def hashed(batches: Iterator[pd.DataFrame], asks: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                x = np.stack(part["v"].to_list()).astype(np.float64)
                keys = index.probed(x, index.probes) if asks else index.buckets(x)
                yield pd.DataFrame({"id": part["id"], "low": part["low"], "vec": [r.tobytes() for r in x], "keys": list(keys)})

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(bucket=0, vec=[np.asarray(x, np.float64).tobytes() for x in pdf["v"]])[["bucket", "id", "low", "vec"]]

    need = min(k, max(0, v.select("vec_id").limit(k + 1).count() - 1))
    own = groups.select(F.col("gid").alias("id"), "low", "v")
    found, short = None, queries
    if index is not None:
        kind = "id long, low long, vec binary, keys array<long>"
        rows = _packed(own.mapInPandas(lambda b: hashed(b, False), kind), "id", "low", "keys")
        asks = _packed(queries.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("low"), "v").mapInPandas(lambda b: hashed(b, True), kind), "id", "low", "keys").distinct()
        both = _blocked(common.written(spark, rows, f"{folder}/rows"), common.written(spark, asks, f"{folder}/asks"))
        found = common.written(spark, _ranked(_measured(both, k + 1), groups, k), f"{folder}/found")
        enough = found.groupBy("query_id").count().where(F.col("count") >= need).select(F.col("query_id").alias("vec_id"))
        short = queries.join(enough, "vec_id", "left_anti")
        if not need or not short.head(1):
            return found
    # whoever found too few, or all where no index does, is measured against all rows, in blocks
    kind = "bucket long, id long, low long, vec binary"
    asks = short.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("low"), "v")
    exact = _ranked(_measured(_blocked(own.mapInPandas(as_bytes, kind), asks.mapInPandas(as_bytes, kind)), k + 1), groups, k)
    return exact if found is None else found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(exact)


def _ranked(measured: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Merge the tables' candidates and put equal vectors' ids in their place."""
    one = measured.groupBy("query_id", "gid").agg(F.min("low").alias("low"), F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "low")
    one = one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    ids = one.join(groups.select("gid", "ids"), "gid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ids.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
