"""Near-duplicate documents by banded MinHash with sequential Bayesian checks.

A document's set: its distinct shingles of ``words`` lower-cased words (as 64-bit
hashes of their bytes); with fewer words the whole sequence is one shingle;
without words the set is empty and linked with nothing. Documents of one set
are one class, and only classes are compared. MinHash values in bands find
candidates; their signatures are compared batch by batch, and a pair is pruned
as soon as the posterior odds that its similarity reaches the threshold are
under ``miss``; what survives is verified on the full sets.

Within a bucket every class is first held against the smallest one, so hot
groups cost as many pairs as they have members. Only where a bucket still holds
several components are pairs across them compared, in blocks of bounded size,
the most similar of two components first; a pair is never verified twice, and
the rounds end when no unverified pair across components survives. Of buckets
with the same classes one is enough and kept. Components only merge, so the pairs
across them are found once, and later rounds take what is left of them.

Null texts have no words. Repeated rows are copies. Rows with a null id take no
part: their component is null and they aren't kept. Rows of one id but unequal
texts count as linked; a class whose smallest id has other texts too is a node
of its own above all ids, and linked with that id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.graph import components
from plumbline.llm.wordtok import word_hashes

ROWS, BANDS, BATCH, BLOCK = 5, 30, 30, 4096
N_HASH = ROWS * BANDS
FILTER_BITS = 25
_rng = np.random.default_rng(11)
_A = (_rng.integers(0, 2**31, N_HASH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, N_HASH, dtype=np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (UTF-8)."""
    if not texts:
        return []
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
    start, end = edge[0::2], edge[1::2]
    h = word_hashes(data, start, end[: len(start)])[0]
    upto = np.searchsorted(start, stop)
    n = np.diff(upto, prepend=0)
    out = []
    if len(h) >= words:
        rolled = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            rolled = _mix(rolled + h[k : k + len(rolled)] + np.uint64(k))
    else:
        rolled = np.zeros(0, np.uint64)
    for a, m in zip((upto - n).tolist(), n.tolist()):
        if m >= words:
            out.append(np.unique(rolled[a : a + m - words + 1]))
        elif m:
            x = np.zeros(1, np.uint64)
            for k in range(m):
                x = _mix(x + h[a + k : a + k + 1] + np.uint64(k))
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    """N_HASH smallest values of a set that isn't empty."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    best = np.full(N_HASH, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(best, (x[None, a : a + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=best)
    return best


def set_name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    u = np.uint64
    with np.errstate(over="ignore"):
        a = _mix(s).sum(dtype=u) + u(len(s)) * u(0xC2B2AE3D27D4EB4F)
        b = _mix(s * u(0xD6E8FEB86659FD93) + u(1)).sum(dtype=u)
    return int(a.view(np.int64)), int(b.view(np.int64))


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches among ``n`` signature values at which the posterior
    odds of a similarity of ``threshold`` or more, from an even prior, reach ``miss``."""
    # posterior Beta(m + 1, n - m + 1): P(J >= t) = P(Binomial(n + 1, t) <= m)
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _groups(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    yield at, texts[at:]


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [bytes(x) for x in pdf["raw"]]
            for at, part in _groups(raw):
                sets = shingle_sets(part, words)
                sig = [minhash(s) if len(s) else None for s in sets]
                names = [set_name(s) for s in sets]
                band = np.zeros((len(sets), BANDS), np.uint64)
                full = [i for i, s in enumerate(sig) if s is not None]
                if full:
                    m = np.stack([sig[i] for i in full]).reshape(len(full), BANDS, ROWS)
                    x = np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
                    for k in range(ROWS):
                        x = _mix(x + m[:, :, k])
                    band[full] = x
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].array[at : at + len(part)],
                        "no_id": pdf["no_id"].array[at : at + len(part)],
                        "n_shingles": [len(s) for s in sets],
                        "name1": [a for a, _ in names],
                        "name2": [b for _, b in names],
                        "sig": [None if s is None else (s & np.uint32(0xFFFF)).astype("<u2").tobytes() for s in sig],
                        "bands": [None if s is None else b.view(np.int64) for s, b in zip(sig, band)],
                    }
                )

    cols = common.marked(docs, common.text_bytes().alias("raw"))
    return common.unmarked(cols.mapInPandas(run, "doc_id long, no_id boolean, n_shingles long, name1 long, name2 long, sig binary, bands array<long>"))


def _bounds(threshold: float, miss: float) -> list[tuple[int, int]]:
    return [(n, least_matches(n, threshold, miss)) for n in range(BATCH, N_HASH + 1, BATCH)]


def _named(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, name1, name2, raw) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [bytes(x) for x in pdf["raw"]]
            names = [set_name(s) for _, part in _groups(raw) for s in shingle_sets(part, words)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "name1": [a for a, _ in names], "name2": [b for _, b in names], "raw": raw})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("raw")).mapInPandas(run, "doc_id long, name1 long, name2 long, raw binary")


def _maybe(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id (a long) is in ``ids``, and few others, so that the
    exact join that must follow has less to shuffle: a bitmap of ids' hashes, of 4 MB
    at any size, is sent to every task. Where ids fill it, all rows pass."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)) + 1
    bits = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("_bits"))
    keyed = rows.withColumn("_map", F.bitmap_bucket_number(spot)).withColumn("_at", F.bitmap_bit_position(spot).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0
    return keyed.join(F.broadcast(bits), "_map").where(hit).select(*rows.columns)


def _distinct_buckets(buckets: DataFrame) -> DataFrame:
    """The rows (bucket, doc_id, n, hub) of one bucket of each set of classes; 128
    bits stand for a set."""
    alike = buckets.groupBy("bucket").agg(F.first("n").alias("n"), F.first("hub").alias("hub"), F.bit_xor(F.xxhash64("doc_id")).alias("a"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("b"))
    return buckets.join(alike.groupBy("n", "hub", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def _survive(pairs: DataFrame, sigs: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Pairs (left, right) that no batch of their signatures prunes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = (np.frombuffer(b"".join(map(bytes, pdf[c])), "<u2").reshape(len(pdf), N_HASH) for c in ("l_sig", "r_sig"))
            live, same = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
            for n, least in bounds:
                same[live] += (a[live, n - BATCH : n] == b[live, n - BATCH : n]).sum(axis=1)
                live = live[same[live] >= least]
            yield pdf.iloc[live][["left", "right"]]

    l_sig = sigs.select(F.col("doc_id").alias("left"), F.col("sig").alias("l_sig"))
    r_sig = sigs.select(F.col("doc_id").alias("right"), F.col("sig").alias("r_sig"))
    return pairs.join(l_sig, "left").join(r_sig, "right").mapInPandas(run, "left long, right long")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union.

    A left text is sent once for each block of its right texts, and rows are
    read in order, so a task holds one left set at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, own = None, np.zeros(0, np.uint64)
        for pdf in batches:
            ok = []
            raw = [bytes(x) for x in pdf["raw"]]
            sets = [s for _, part in _groups(raw) for s in shingle_sets(part, words)] if len(raw) else []
            for l, r, s in zip(pdf["left"].tolist(), pdf["right"].tolist(), sets):
                if r == l:
                    left, own = l, s
                elif l == left:
                    small = min(len(own), len(s))
                    if 100 * small >= percent * max(len(own), len(s)):
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            ok.append((l, r))
                else:
                    raise RuntimeError("a left text is missing")
            yield pd.DataFrame(ok, columns=["left", "right"], dtype="int64")

    many = pairs.groupBy("left").agg(F.ceil(F.count("*") / 64).alias("blocks"))
    keyed = pairs.join(many, "left").withColumn("block", F.pmod(F.xxhash64("right"), F.lit(1 << 20)) % F.col("blocks"))
    rights = keyed.select("left", "block", "right")
    lefts = keyed.select("left", "block").distinct().withColumn("right", F.col("left"))
    texts = _maybe(texts, pairs.select(F.explode(F.array("left", "right")).alias("doc_id")))
    rows = lefts.unionByName(rights).join(texts.select(F.col("doc_id").alias("right"), "raw"), "right")
    rows = rows.repartition(common.width(rows.sparkSession), "left", "block").sortWithinPartitions("left", "block", F.col("right") != F.col("left"), "right")
    return rows.select("left", "right", "raw").mapInPandas(run, "left long, right long")


def _across(buckets: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Of the rows (bucket, part, doc_id, component, sig) sorted by bucket and
    part: pairs of different components that survive, with their components and
    the number of equal signature values."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """All whole groups at once: each row against the k-th row after it."""
        sig = np.frombuffer(b"".join(map(bytes, pdf["sig"])), "<u2").reshape(len(pdf), N_HASH)
        node, comp, bucket, part = (pdf[c].to_numpy() for c in ("doc_id", "component", "bucket", "part"))
        first = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        stop = np.append(np.flatnonzero(first)[1:], len(pdf))[np.cumsum(first) - 1]
        row, k, found = np.arange(len(pdf)), 0, []
        while True:
            k += 1
            row = row[row + k < stop[row]]
            if not len(row):
                break
            x = row[comp[row] != comp[row + k]]
            same = np.zeros(len(x), np.int64)
            for n, least in bounds:
                same = same + (sig[x, n - BATCH : n] == sig[x + k, n - BATCH : n]).sum(axis=1)
                go = same >= least
                x, same = x[go], same[go]
            if len(x):
                found.append(np.stack([x, x + k, same]))
        if not found:
            return pd.DataFrame({c: [] for c in ("left", "right", "c1", "c2", "same")}, dtype="int64")
        x, y, same = np.concatenate(found, axis=1)
        out = pd.DataFrame({"left": np.minimum(node[x], node[y]), "right": np.maximum(node[x], node[y]), "c1": np.minimum(comp[x], comp[y]), "c2": np.maximum(comp[x], comp[y]), "same": same})
        return out.drop_duplicates(["left", "right"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held:
                pdf = pd.concat([*held, pdf], ignore_index=True)
            last = int(((pdf["bucket"] != pdf["bucket"].iloc[-1]) | (pdf["part"] != pdf["part"].iloc[-1])).to_numpy().sum())
            if last:
                yield compare(pdf.iloc[:last])
            held = [pdf.iloc[last:]]
        if held:
            yield compare(held[0])

    return buckets.mapInPandas(run, "left long, right long, c1 long, c2 long, same long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6, most_rounds: int = 12) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the smallest doc_id
    that can be reached over links of ``percent`` per cent similarity or more."""
    spark = docs.sparkSession
    common.ship(spark)
    folder = common.shared_dir(spark)
    info = common.written(spark, _signatures(docs, words), f"{folder}/info")
    ids = info.where("doc_id is not null")
    classes = ids.where("n_shingles > 0").groupBy("name1", "name2").agg(F.min("doc_id").alias("node"))
    same = ids.groupBy("doc_id").agg(F.min("name1").alias("a"), F.max("name1").alias("b")).where("a <> b").select("doc_id")  # one id, unequal texts
    same = common.written(spark, same, f"{folder}/same")
    twice = None
    if same.head(1):
        top = ids.agg(F.max("doc_id")).first()[0]
        own = F.lit(top) + F.row_number().over(Window.orderBy("name1", "name2"))
        twice = classes.withColumnRenamed("node", "doc_id").join(same, "doc_id", "left_semi").withColumn("own", own)
        twice = common.written(spark, twice, f"{folder}/twice")
        classes = classes.join(twice.select("name1", "name2", "own"), ["name1", "name2"], "left").select("name1", "name2", F.coalesce("own", "node").alias("node"))
    member = ids.where("n_shingles > 0").select("doc_id", "name1", "name2").distinct().join(classes.select("name1", "name2", "node"), ["name1", "name2"]).select("doc_id", "node")
    member = common.written(spark, member, f"{folder}/member")
    # one row for each class: that of its smallest id
    def of_classes(rows: DataFrame, col: str) -> DataFrame:
        sets = rows.join(member.where("doc_id = node").select("doc_id").distinct(), "doc_id").select("doc_id", col)
        if twice is not None:
            sets = sets.unionByName(ids.join(twice, ["doc_id", "name1", "name2"]).select(F.col("own").alias("doc_id"), col))
        return sets.dropDuplicates(["doc_id"])

    # buckets that hold more than one class
    buckets = of_classes(ids, "bands").select("doc_id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).where("n > 1")
    buckets = buckets.join(shared, "bucket").select("bucket", "doc_id", "n", "hub")
    buckets = common.written(spark, buckets, f"{folder}/shared")
    buckets = common.written(spark, _distinct_buckets(buckets), f"{folder}/buckets")
    there = common.written(spark, buckets.select("doc_id").distinct(), f"{folder}/there")
    sigs = common.written(spark, of_classes(_maybe(ids, there), "sig").join(there, "doc_id", "left_semi"), f"{folder}/sigs")
    raw = _maybe(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), there)
    raw = raw.select("doc_id", common.text_bytes().alias("raw")).join(there, "doc_id", "left_semi")
    if twice is not None:
        unequal = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")).join(same, "doc_id", "left_semi")
        raw = raw.unionByName(_named(unequal, words).join(twice, ["doc_id", "name1", "name2"]).select(F.col("own").alias("doc_id"), "raw").join(there, "doc_id", "left_semi"))
    raw = raw.dropDuplicates(["doc_id"])
    texts = common.written(spark, raw, f"{folder}/texts")

    bounds = _bounds(percent / 100, miss)
    pairs = buckets.where("hub <> doc_id").select(F.col("hub").alias("left"), F.col("doc_id").alias("right")).distinct()
    extra = member.join(same, "doc_id", "left_semi").select(F.col("doc_id").alias("left"), F.col("node").alias("right"))
    tested = links = cross = None
    for k in range(most_rounds):
        live = common.written(spark, _survive(pairs, sigs, bounds) if k == 0 else pairs, f"{folder}/pairs{k}")
        if k and not live.head(1):
            break
        good = common.written(spark, _verify(live, texts, words, percent), f"{folder}/links{k}")
        tested = live if tested is None else tested.unionByName(live)
        links = good.unionByName(extra) if links is None else links.unionByName(good)
        comp = common.written(spark, components(links, f"{folder}/components{k}"), f"{folder}/component{k}")
        if cross is None:  # pairs in buckets that hold several components
            inside = buckets.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
            mixed = inside.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
            inside = inside.join(mixed, "bucket", "left_semi")
            blocks = F.ceil(F.col("n") / BLOCK).cast("long")
            own = F.pmod(F.xxhash64("doc_id"), blocks)
            inside = inside.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            inside = inside.withColumn("part", F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).select("bucket", "part", "doc_id", "component")
            rows = inside.join(sigs, "doc_id").repartition(common.width(spark), "bucket", "part").sortWithinPartitions("bucket", "part", "component", "doc_id")
            cross = _across(rows.select("bucket", "part", "doc_id", "component", "sig"), bounds).select("left", "right", "same").distinct()
            cross = common.written(spark, cross, f"{folder}/cross")
        survivors = cross.join(tested, ["left", "right"], "left_anti")
        for side, c in (("left", "x"), ("right", "y")):
            survivors = survivors.join(comp.select(F.col("node").alias(side), F.col("component").alias(c)), side, "left").withColumn(c, F.coalesce(c, side))
        survivors = survivors.where("x <> y").select("left", "right", "same", F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2"))
        w = Window.partitionBy("c1", "c2").orderBy(F.desc("same"), "left", "right")
        pairs = survivors.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 4 * 64**k).select("left", "right")
    else:
        raise RuntimeError("pairs were left unverified")
    placed = member.join(comp.withColumnRenamed("component", "c"), "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("c", "node")).alias("component_id"))
    out = info.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
