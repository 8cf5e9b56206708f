"""The answer contract: ordered pages with disclosed totals, and budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Answer:
    """Rows of one page, the total before the cut, and where the next page begins."""

    rows: DataFrame
    total: int
    shown: int
    next_offset: int | None
    basis: str = ""

    @property
    def truncated(self) -> bool:
        return self.next_offset is not None


def page(df: DataFrame, order: list[Column], limit: int = 25, offset: int = 0, most: int = 1000, basis: str = "") -> Answer:
    """One page; limits out of range are errors and never clamped."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    if offset < 0:
        raise ValueError("offset must be 0 or more")
    total = df.count()
    shown = max(0, min(limit, total - offset))
    return Answer(df.orderBy(*order).offset(offset).limit(limit), total, shown, offset + shown if offset + shown < total else None, basis)


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with the key's total."""
    w = Window.partitionBy(*key)
    return df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w)).where(F.col("place") <= k)


def byte_budget(df: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The longest prefix whose rows' JSON fits a byte budget. Meant for answers
    that are small already: the running sum is one window."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))) + 1
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_end", F.sum(size).over(w)).where(F.col("_end") <= budget).drop("_end")


def coded(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Dictionary of a column's values, and the rows with codes in their place."""
    words = df.select(column).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)
    return words, df.join(words, column).drop(column)
