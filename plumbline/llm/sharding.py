"""Sharding by sampled splitters, in DataFrame operations only.

A record's key is the hash of its text, then its id, so equal texts are
neighbours. A sample of keys, drawn with odds in proportion to size, gives
quantile boundaries of many fine ranges; records are range-partitioned by
them. A range that got far more than its share is subdivided by a hash of id and row.
The exact bytes before each range then place every record, and every group of
equal texts, on the line of all bytes, and 16 equal stretches of that line are
the shards. Law ``bytes``: sizes near equal.

A group of equal texts stays in one shard unless it is larger than ``whole``
of a shard's share; then its records are placed one by one.

Texts of any length are one record each. Null texts have size 1 and form one group. Null ids come first in their group.
Repeated rows stay apart. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common


def shard(docs: DataFrame, shards: int = 16, range_rows: int = 100_000, most_ranges: int = 8192, whole: float = 0.1) -> DataFrame:
    """Every record's shard and its slot there (gapless from 0).

    There is a fine range for each ``range_rows`` records, 128 at least and
    ``most_ranges`` at most, and an expected 32 sampled keys for each range;
    what the driver holds is no more than these.
    """
    spark = docs.sparkSession
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(common.text_bytes()).alias("text_crc32"),
        F.coalesce(F.xxhash64(F.col("text")), F.lit(0)).alias("k1"),
        F.monotonically_increasing_id().alias("row"),  # kept by the written table
    )
    keys = common.written(spark, keys, f"{common.shared_dir(spark)}/keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(128, min(most_ranges, n // range_rows))
    sample = 32 * ranges
    if not total:
        return _columns(keys.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")))

    # size-weighted sample: a record is drawn when a hash of it, as a number from 0 to 1, is under size * sample / total
    unit = (F.pmod(F.xxhash64("k1", "doc_id", F.lit(7)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    drawn = sorted(r[0] for r in keys.where(unit < F.col("size") * (sample / total)).select("k1").limit(8 * sample).collect())
    splitters = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    fine = keys.withColumn("range", _range_of(F.col("k1"), splitters))

    # an overfull range is subdivided by id and row, so repeated rows spread too
    per = fine.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 4 * total / ranges).collect()
    parts = {r["range"]: min(4096, int(r["bytes"] * ranges / total) + 1) for r in per}
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("range")), F.lit(1)) if parts else F.lit(1)
    group_w = Window.partitionBy("k1", "text_crc32", "part0")
    sub = fine.withColumn("part0", F.pmod(F.xxhash64("doc_id", "row", F.lit(11)), many.cast("long")))

    # bytes of each text's group, so that it can stay whole
    groups = sub.groupBy("range", "k1", "text_crc32", "part0").agg(F.sum("size").alias("g_bytes"), F.count("*").alias("g_rows"))
    text = groups.groupBy("range", "k1", "text_crc32").agg(F.sum("g_bytes").alias("t_bytes"), F.sum("g_rows").alias("t_rows"))
    ranges_df = text.groupBy("range").agg(F.sum("t_bytes").alias("r_bytes"), F.sum("t_rows").alias("r_rows"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    before = F.broadcast(ranges_df.select("range", F.coalesce(F.sum("r_bytes").over(w), F.lit(0)).alias("r_start")))
    wt = Window.partitionBy("range").orderBy("k1", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    texts = text.join(before, "range").withColumn("t_start", F.col("r_start") + F.coalesce(F.sum("t_bytes").over(wt), F.lit(0)))
    wp = Window.partitionBy("k1", "text_crc32").orderBy("part0").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(texts.select("k1", "text_crc32", "t_start", "t_bytes"), ["k1", "text_crc32"]).select(
        "k1", "text_crc32", "part0", "t_start", "t_bytes", F.coalesce(F.sum("g_bytes").over(wp), F.lit(0)).alias("p_start")
    )
    rows = sub.join(placed, ["k1", "text_crc32", "part0"])
    wr = group_w.orderBy(F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    stays = F.col("t_bytes") <= whole * total / shards
    at = F.when(stays, F.col("t_start") + F.col("t_bytes") / 2).otherwise(F.col("t_start") + F.col("p_start") + F.coalesce(F.sum("size").over(wr), F.lit(0)) + F.col("size") / 2)
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(at * shards / total)).cast("int"))

    # slots: the rows of the shard in earlier (range, part) cells, then the place within the cell
    cell = ["shard", "range", "part0"]
    counts = rows.groupBy(*cell).agg(F.count("*").alias("c_rows"))
    wc = Window.partitionBy("shard").orderBy("range", "part0").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*cell, F.coalesce(F.sum("c_rows").over(wc), F.lit(0)).alias("c_start"))
    ws = Window.partitionBy(*cell).orderBy("k1", "text_crc32", F.col("doc_id").asc_nulls_first())
    out = rows.join(counts, cell).withColumn("slot", F.col("c_start") + F.row_number().over(ws) - 1)
    return _columns(out)


def _range_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters below a key, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    bits = len(splitters).bit_length()
    full = splitters + [2**63 - 1] * (2**bits - 1 - len(splitters))
    array, steps = F.array(*map(F.lit, full)), F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(array, at + step) < key, at + step).otherwise(at))


def range_of(key: int, splitters: list[int]) -> int:
    return bisect_left(splitters, key)


def _columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
