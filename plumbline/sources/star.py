"""A property graph derived from the star-schema tables.

Customers are endpoints (grouped by market segment), orders are symbols, order
lines are statements, suppliers are tables and (supplier, part) pairs are their
columns; nations are screens and regions are projects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUS_RANK = {"F": 4, "O": 3}


class Star:
    """Lazily read tables of one folder and the edges they stand for.

    All edges have (src, dst, type, rank); ids are ``kind:key`` strings."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def _edge(df: DataFrame, src: Column, dst: Column, kind: str, rank: Column | int, *more: Column) -> DataFrame:
        r = rank if isinstance(rank, Column) else F.lit(rank)
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), r.cast("int").alias("rank"), *more)

    @staticmethod
    def id(kind: str, *cols: str) -> Column:
        parts = [x for c in cols for x in (F.lit("." if kind == "column" else "-"), F.col(c).cast("string"))][1:]
        return F.concat(F.lit(f"{kind}:"), *parts)

    @staticmethod
    def status_rank() -> Column:
        return F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 3).otherwise(2)

    def orders(self) -> DataFrame:
        return self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", self.status_rank().alias("rank"))

    def handles(self) -> DataFrame:
        o = self.orders().where(F.col("o_orderkey") % 3 == 0)
        return self._edge(o, self.id("endpoint", "o_custkey"), self.id("symbol", "o_orderkey"), "HANDLES", F.col("rank"))

    def may_call(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        o = self.orders().select("o_orderkey", F.lead("o_orderkey").over(w).alias("callee"), F.lead("rank").over(w).alias("r")).where("callee is not null")
        return self._edge(o, self.id("symbol", "o_orderkey"), self.id("symbol", "callee"), "MAY_CALL", F.least("r", F.lit(3)))

    def implements(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_linenumber").distinct()
        return self._edge(line, self.id("symbol", "l_orderkey"), self.id("statement", "l_orderkey", "l_linenumber"), "IMPLEMENTS_STMT", 4)

    def executes(self) -> DataFrame:
        access = F.when(F.col("l_returnflag") == "A", "write").when(F.col("l_returnflag") == "R", "delete").otherwise("read")
        rank = F.when(F.col("l_discount") > 0.08, 3).otherwise(4)
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_discount")
        return self._edge(line, self.id("statement", "l_orderkey", "l_linenumber"), self.id("table", "l_suppkey"), "EXECUTES", rank, access.alias("access"))

    def column_access(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
        kind = F.when(F.col("l_returnflag") == "N", "READS").otherwise("WRITES")
        return line.select(self.id("statement", "l_orderkey", "l_linenumber").alias("src"), self.id("column", "l_suppkey", "l_partkey").alias("dst"), kind.alias("type"), F.lit(4).alias("rank"))

    def declares(self) -> DataFrame:
        pair = self.table("lineitem").select("l_suppkey", "l_partkey").distinct()
        return self._edge(pair, self.id("table", "l_suppkey"), self.id("column", "l_suppkey", "l_partkey"), "DECLARES", 4)

    def calls_http(self) -> DataFrame:
        c = self.table("customer").select("c_nationkey", "c_custkey")
        return self._edge(c, self.id("screen", "c_nationkey"), self.id("endpoint", "c_custkey"), "CALLS_HTTP", 3)

    def joins(self) -> DataFrame:
        """Pairs of tables that one order uses: lower key first, number of orders."""
        line = self.table("lineitem").select("l_orderkey", "l_suppkey")
        parts = max(self.spark.sparkContext.defaultParallelism, line.count() // 1_000_000)  # lines make more pairs than there are lines
        one = line.repartition(parts, "l_orderkey").distinct()
        a, b = one.withColumnRenamed("l_suppkey", "a"), one.withColumnRenamed("l_suppkey", "b")
        pairs = a.join(b, "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("count"))
        return self._edge(pairs, self.id("table", "a"), self.id("table", "b"), "JOINS", 4, F.col("count"))

    def call_flow(self) -> DataFrame:
        """Edges from endpoints down to statements."""
        return reduce(DataFrame.unionByName, [self.handles(), self.may_call(), self.implements()])

    def edges(self) -> DataFrame:
        """All edges of the graph, multi-edges kept."""
        cols = ["src", "dst", "type", "rank"]
        parts = [self.handles(), self.may_call(), self.implements(), self.executes(), self.column_access(), self.declares(), self.calls_http(), self.joins()]
        return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])

    def endpoints(self) -> DataFrame:
        """(endpoint, api_group, path)."""
        c = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        path = F.concat(F.lit("/"), F.lower("c_mktsegment"), F.lit("/"), F.lower("n_name"), F.lit("/"), F.col("c_custkey").cast("string"))
        return c.select(self.id("endpoint", "c_custkey").alias("endpoint"), F.col("c_mktsegment").alias("api_group"), path.alias("path"))
