"""Quality by importance resampling over hashed n-gram models.

Two bag-of-n-gram models are estimated: one of the target (texts labelled good)
and one of the raw corpus (all texts). An n-gram is a word, a pair of words or
a pair of word shapes, hashed into a bucket of its family. A text's importance
is the mean log ratio of both models over its n-grams, times ``effective``
n-grams, so long texts count no more than short ones. Gumbel noise, made from
the id, is added, and the ``k`` largest sums are a sample without replacement
in proportion to importance.

``k`` is the larger of two numbers. One is the share of good labels of all rows
and three standard errors more, so that noise in the labels costs no good text;
only labels of rows of the input count. The other is the number of rows over the
key that parts good labels from bad ones, so that an input cleaner than its
labels loses no text that scores as good ones do. The k-th key is found by
histograms, so no row is gathered and exactly ``k`` rows are kept; ties go to
the smaller id.

Null texts and texts without words are kept after all others only. Without good
labels every text with words is kept. Repeated rows are ranked one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.wordtok import END, LETTER, NUMBER, char_classes, runs_word, slices, word_hashes

WORDS, PAIRS, SHAPES = 8192, 8192, 128
BUCKETS = WORDS + PAIRS + SHAPES * SHAPES
_lower: np.ndarray | None = None
_upper: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _lower, _upper
    if _lower is None:
        low = np.arange(0x110000, dtype=np.uint32)
        up = np.zeros(0x110000, bool)
        for cp in range(0x110000):
            c = chr(cp)
            x = c.lower()
            if x != c and len(x) == 1:
                low[cp], up[cp] = ord(x), True
        _lower, _upper = low, up
    return _lower, _upper


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the text of each: three for every word."""
    low, upper = _tables()
    joined = "\0".join(texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    cps = low[raw]
    kind = char_classes()[cps]
    kind[stop] = END
    start, end = runs_word(cps, kind)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes(cps, start, end)[0]
    text = np.searchsorted(stop, start)
    n_up = np.concatenate([[0], np.cumsum(upper[raw])])
    ups, size, first = n_up[end] - n_up[start], end - start, upper[raw[start]]
    case = np.where(ups == 0, 0, np.where((ups == size) & (size > 1), 1, np.where(first & (ups == 1), 2, 3)))
    what = kind[start]
    shape = np.where(what == LETTER, case, np.where(what == NUMBER, 4, 16 + (h % np.uint64(96)).astype(np.int64)))
    # a word that is the one before it again
    letters = np.flatnonzero(what == LETTER)
    again = letters[1:][(h[letters[1:]] == h[letters[:-1]]) & (text[letters[1:]] == text[letters[:-1]])]
    shape[again] += 8
    same = np.concatenate([[False], text[1:] == text[:-1]])
    before = np.where(same, np.roll(h, 1), np.uint64(7))
    pair = (before * np.uint64(0x9E3779B97F4A7C15)) ^ h
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    shape_before = np.where(same, np.roll(shape, 1), 15)
    b = np.stack([(h % np.uint64(WORDS)).astype(np.int64), WORDS + ((pair >> np.uint64(33)) % np.uint64(PAIRS)).astype(np.int64), WORDS + PAIRS + shape_before * SHAPES + shape], axis=1)
    return b.ravel(), np.repeat(text, 3)


def count_grams(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all texts, and of those with ``good``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            texts, good = pdf["text"].fillna("").tolist(), pdf["good"].to_numpy(bool)
            for s in slices(texts):
                b, own = grams(texts[s])
                total[0] += np.bincount(b, minlength=BUCKETS)
                total[1] += np.bincount(b[good[s][own]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": at, "raw": total[0, at], "target": total[1, at]})

    return docs.select("text", "good").mapInPandas(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log of target over raw probability of each bucket in its family, smoothed
    by one for each bucket; at most BUCKETS rows come to the driver."""
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    out = np.zeros(BUCKETS)
    if target.sum() > BUCKETS:
        for a, b in ((0, WORDS), (WORDS, WORDS + PAIRS), (WORDS + PAIRS, BUCKETS)):
            out[a:b] = np.log(target[a:b] / target[a:b].sum()) - np.log(raw[a:b] / raw[a:b].sum())
    return out


def weigh(docs: DataFrame, ratio: np.ndarray, effective: float) -> DataFrame:
    """``docs`` with ``log_weight`` (null without words) and ``n_grams`` added."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c not in ("log_weight", "n_grams")]
    base = docs.select(*names)
    schema = T.StructType([*base.schema.fields, T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column("text").cast(pa.string()).to_pylist()]
            weight, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for s in slices(texts):
                b, own = grams(texts[s])
                count[s] = np.bincount(own, minlength=s.stop - s.start)
                weight[s] = np.bincount(own, ratio[b], minlength=s.stop - s.start)
            mean = effective * weight / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean, pa.float64(), mask=count == 0), pa.array(count)], names=[*names, "log_weight", "n_grams"])

    return base.mapInArrow(run, schema)


def labels_of(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """(doc_id, quality) of the labels of rows of ``docs``, written once."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    lab = lab.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    return common.written(docs.sparkSession, lab, f"{folder}/labels")


def model(docs: DataFrame, lab: DataFrame, labelled: int) -> tuple[np.ndarray, float, int]:
    """Log ratios of all buckets, the share of good labels (as ``labels_of`` has them) and
    their number. The target is estimated from at most about ``labelled`` good rows, the
    raw model from all."""
    good, n = lab.agg(F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    ids = lab.where((F.col("quality") == 1) & (unit < min(1.0, labelled / max(1, good)))).select("doc_id").distinct().limit(2 * labelled).withColumn("good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))  # ids: 2 * labelled rows at most
    common.ship(docs.sparkSession)
    return log_ratios(count_grams(rows)), (good / n if n else 1.0), n


def sample_top(scored: DataFrame, k: int, cells: int = 2048, few: int = 5_000) -> DataFrame:
    """``scored`` with ``kept``: whether a row is among the ``k`` largest by
    ``key`` (never null; ties to the smaller doc_id).

    The interval that holds the k-th key is narrowed by histograms of at most
    ``cells`` rows until it holds ``few`` rows or one key; these are ranked."""
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return scored.withColumn("kept", F.lit(False))
    over = 0
    while low < high:
        width = (high - low) / cells
        cell = F.least(F.lit(cells - 1), F.floor((F.col("key") - low) / width)).cast("int")
        own = scored.where(F.col("key").between(low, high)).groupBy(cell.alias("cell"))
        found = own.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("cell")).collect()
        for r in found:
            if over + r["n"] >= k:
                break
            over += r["n"]
        else:
            return scored.withColumn("kept", F.lit(True))  # no more than k rows
        low, high = r["low"], r["high"]
        if r["n"] <= few:
            break
    edge = scored.where(F.col("key").between(low, high))
    w = Window.orderBy(F.desc("key"), F.col("doc_id").asc_nulls_last())
    edge = edge.withColumn("kept", F.row_number().over(w) <= k - over)
    rest = scored.where(~F.col("key").between(low, high))
    return rest.withColumn("kept", F.col("key") > high).unionByName(edge)


def keyed(scored: DataFrame, seed: int = 43) -> DataFrame:
    """``scored`` with ``key``: importance plus standard Gumbel noise made from
    the row; without words it is far below that of all others."""
    h = F.xxhash64("doc_id", F.coalesce("log_weight", F.lit(0.0)), "n_grams", F.lit(seed))
    unit = (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("key", F.coalesce("log_weight", F.lit(-1e6)) - F.log(-F.log(unit)))


def sample_size(n: int, share: float, n_labels: int, errors: float = 3.0) -> int:
    """The share of good labels of ``n`` rows, with as many standard errors more."""
    return min(n, math.ceil(n * (share + errors * math.sqrt(share * (1 - share) / max(1, n_labels)))))


def parting_key(scored: DataFrame, lab: DataFrame, loss: int = 10, cells: int = 16) -> float:
    """The lowest key that best parts good labels from bad ones, where a good row
    below it counts as ``loss`` bad ones above it. Keys are counted in cells of a
    ``cells``-th, so their range and not the rows bounds what the driver holds."""
    rows = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.floor(F.col("key") * cells).alias("cell")).join(lab, "doc_id")
    good = F.col("quality") == 1
    found = rows.groupBy("cell").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")).orderBy("cell").collect()
    if not found:
        return math.inf
    n_good, n_bad = (np.concatenate([[0], np.cumsum([r[c] for r in found])]) for c in ("good", "bad"))
    at = int(np.argmin(loss * n_good + n_bad[-1] - n_bad))
    return (found[at - 1]["cell"] + 1 if at else found[0]["cell"]) / cells


def kept_rows(scored: DataFrame, lab: DataFrame, share: float, n_labels: int) -> DataFrame:
    """``scored`` with ``kept``: the share of good labels, and all that score as good ones do."""
    n, over = scored.agg(F.count("*"), F.count_if(F.col("key") >= parting_key(scored, lab))).first()
    return sample_top(scored, max(over, sample_size(n, share, n_labels)))


def resample(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, effective: float = 64.0) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept) of every row."""
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    lab = labels_of(docs, labels, folder)
    ratio, share, n_labels = model(docs, lab, labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = keyed(weigh(rows, ratio, effective).drop("text"))
    scored = common.written(spark, scored, f"{folder}/scored")
    if not ratio.any():
        return scored.withColumn("kept", F.col("log_weight").isNotNull())
    return kept_rows(scored, lab, share, n_labels).select("doc_id", "n_grams", "log_weight", "key", "kept")


def selected(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, effective: float = 64.0) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only. They are
    written once with their keys, so no join brings the texts back."""
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    lab = labels_of(docs, labels, folder)
    ratio, share, n_labels = model(docs, lab, labelled)
    hidden, restored = common.aside(docs)
    scored = keyed(weigh(hidden, ratio, effective))
    scored = common.written(spark, scored, f"{folder}/scored")
    if not ratio.any():
        return restored(scored.where("log_weight is not null"))
    return restored(kept_rows(scored, lab, share, n_labels).where("kept"))
