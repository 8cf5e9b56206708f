"""Packs: a graph as two Parquet tables with counts and a digest."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(*tables: DataFrame) -> str:
    """Twelve hex digits that stand for the multisets of rows of all tables, in any
    order: two sums of 60-bit pieces of each row's sha256, so no row is gathered. A
    row is its JSON with columns in order of name, so nulls count too."""
    said = []
    for t in tables:
        h = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(t.columns)]), {"ignoreNullFields": "false"}), 256)
        piece = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))  # noqa: B023, E731
        r = t.agg(piece(1).alias("a"), piece(16).alias("b"), F.count("*").alias("n")).first()
        said.append(f"{r['a']}:{r['b']}:{r['n']}:{','.join(sorted(t.columns))}")
    return hashlib.sha256("|".join(said).encode()).hexdigest()[:12]


def write_pack(nodes: DataFrame, edges: DataFrame, folder: str) -> str:
    """Write nodes by kind and edges by type, sorted within files, below a folder of
    its own, then its place, counts and digest: a reader sees the old pack or the new
    one and nothing between. Returns the digest."""
    spark = edges.sparkSession
    own = f"{folder}/data-{uuid.uuid4().hex}"
    nodes.sortWithinPartitions("id").write.partitionBy("kind").parquet(f"{own}/nodes")
    edges.sortWithinPartitions("src", "dst").write.partitionBy("type").parquet(f"{own}/edges")
    n, e = spark.read.parquet(f"{own}/nodes"), spark.read.parquet(f"{own}/edges")
    d = digest(n, e)
    meta = (own, d, n.count(), e.count(), time.time())
    spark.createDataFrame([meta], "data string, digest string, nodes long, edges long, at double").coalesce(1).write.mode("append").json(f"{folder}/meta")
    return d


def history(spark: SparkSession, folder: str) -> DataFrame:
    """All packs of a folder, the latest first."""
    return spark.read.schema("data string, digest string, nodes long, edges long, at double").json(f"{folder}/meta").orderBy(F.desc("at"))


def read_pack(spark: SparkSession, folder: str, verify: bool = True, back: int = 0) -> tuple[DataFrame, DataFrame]:
    """The latest pack, or the one ``back`` packs before it."""
    meta = history(spark, folder).limit(back + 1).collect()
    if len(meta) <= back:
        raise ValueError(f"{folder} holds {len(meta)} packs")
    nodes, edges = (spark.read.parquet(f"{meta[back]['data']}/{t}") for t in ("nodes", "edges"))
    if verify and (found := digest(nodes, edges)) != meta[back]["digest"]:
        raise ValueError(f"the pack's digest is {found}, not {meta[back]['digest']}")
    return nodes, edges
