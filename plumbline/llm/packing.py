"""Best-fit packing of documents into token sequences, with a certified bound.

Documents are tokenized and only those longer than a sequence are cut. Pieces
are spread evenly over partitions; each packs by best fit, longest first, and
dual feasible functions bound from below how many sequences its pieces need: a
certificate of the partition's count. What the certificate leaves open is
exchanged: a partition releases its loosest sequences, as many as have room for
the sequences over its bound, with some more to match them, and for the part of
one that rounding hides; room that the bound proves to be lost stays. Released pieces are spread over at most half as
many partitions and packed again, until all sequences together meet the bound of
all pieces, nothing is released, or one partition held the rest. ``certified``
gives all certificates too, ``certificate`` checks any result.

Null texts are empty documents (the end id alone). Texts of any length are
tokenized whole. Pieces of one length go in order of id, those of null ids last. Repeated rows are documents
of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

PIECES = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document with its end id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from plumbline.llm.wordtok import open_tokenizer, slices

        tok = open_tokenizer(tokenizer)
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            key = list(zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist()))
            for part in slices(texts, 1 << 17):  # so that its arrays stay in the cache
                ids, count = tok.batch(texts[part])
                ids = ids.astype("<u4")
                rows, at = [], 0
                for doc, n in zip(key[part], count.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, s in enumerate(range(0, n + 1, capacity)):
                        one = own[s : s + capacity]
                        rows.append((*doc, k, s, len(one), zlib.crc32(one.tobytes())))
                yield pd.DataFrame(rows, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32"])

    common.ship(docs.sparkSession)
    return common.marked(docs, F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def dual_feasible_bound(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins that hold ``lengths``: the best over the plain
    sum and two families of dual feasible functions (Fekete and Schepers)."""
    return bound_of_counts(*np.unique(np.asarray(lengths, np.int64), return_counts=True), capacity)


def bound_of_counts(size: np.ndarray, n: np.ndarray, capacity: int) -> int:
    """``dual_feasible_bound`` of ``n`` lengths of each ``size`` (ascending)."""
    if not len(size):
        return 0
    best = -(-int((size * n).sum()) // capacity)
    # items over capacity - t count whole, items under t not at all
    total, small = int((size * n).sum()), np.cumsum(size * n)
    for t in np.unique(np.minimum(size, capacity - size))[:2048].tolist():
        if 0 < t <= capacity // 2:
            big = size > capacity - t
            below = size < t
            if big.any():
                inside = total - int((size[big] * n[big]).sum()) - (int(small[below][-1]) if below.any() else 0)
                best = max(best, int(n[big].sum()) + max(0, -(-inside // capacity)))
    # rounding to k-ths: x(k+1)/C whole stays x/C, else floor((k+1)x/C)/k
    for k in range(1, 65):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        worth = int((np.where(whole, 0, scaled // capacity) * n).sum()) * capacity + int((np.where(whole, size * k, 0) * n).sum())
        best = max(best, -(-worth // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's spare room. Ties go to the
    earlier piece and, among bins of equal room, to the latest opened."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    some = 0  # bit r: a bin with room r
    for i, x in zip(order.tolist(), np.asarray(lengths)[order].tolist()):
        fits = some >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        at[i], offset[i] = b, capacity - r
        room[b] = r = r - x
        if r:
            if not by_room[r]:
                some |= 1 << r
            by_room[r].append(b)
    return at, offset, np.asarray(room, np.int64)


def releasable(room: np.ndarray, bound: int, total: int, capacity: int, partners: int = 4) -> np.ndarray:
    """Which sequences of a partition an exchange may improve: the loosest ones,
    until they have room for what can be saved. That is the sequences over the
    bound, ``partners`` times, so that pieces of other lengths come along, and less
    than one more, which rounding the bound up to whole sequences may hide. Room
    that the bound proves to be lost isn't counted."""
    freed = np.zeros(len(room), bool)
    can = partners * (len(room) - bound) * capacity + min(bound * capacity - total, capacity - 1)
    if can > 0:
        loose = np.argsort(-room, kind="stable")
        upto = int(np.searchsorted(np.cumsum(room[loose]), can)) + 1
        freed[loose[:upto]] = room[loose[:upto]] > 0
    return freed


def _pack(pieces: DataFrame, parts: int, capacity: int, step: int) -> DataFrame:
    """One round: pieces with their place, and ``loose`` where the sequence would be
    released. A partition's certificate (``bins``, ``bound`` and ``kept_bins``)
    stands in its first row; in the others these are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        pdf = pd.concat(rows, ignore_index=True)
        # equal input, in any order, is packed alike when a task runs again
        pdf = pdf.sort_values(["no_id", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        size = pdf["length"].to_numpy()
        at, offset, room = best_fit_decreasing(size, capacity)
        bound = dual_feasible_bound(size, capacity)
        freed = releasable(room, bound, int(size.sum()), capacity)
        part = TaskContext.get().partitionId()
        pdf["sequence_id"] = (np.int64(step) << 56) + (np.int64(part) << 32) + at
        pdf["offset"], pdf["loose"] = offset, freed[at]
        for name, value in (("bins", len(room)), ("bound", bound), ("kept_bins", int((~freed).sum()))):
            pdf[name] = pd.array([value] + [None] * (len(pdf) - 1), "Int64")
        yield pdf

    return pieces.repartition(parts).mapInPandas(run, f"{PIECES}, sequence_id long, offset long, loose boolean, bins long, bound long, kept_bins long")


def _bound(pieces: DataFrame, capacity: int) -> int:
    """The bound over all pieces; at most ``capacity`` rows come to the driver."""
    rows = sorted(pieces.groupBy("length").count().collect())
    return bound_of_counts(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), capacity)


def certificate(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """The sequences of ``packed`` and how many its pieces need at least."""
    return packed.select("sequence_id").distinct().count(), _bound(packed, capacity)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, part_pieces: int = 60_000) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return certified(docs, tokenizer, end_id, capacity, part_pieces)[0]


def certified(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, part_pieces: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """What ``pack`` gives, and the certificates of all partitions of all rounds:
    (round, part, bins, bound, kept_bins).

    A task packs about ``part_pieces`` pieces. Each round at least halves the
    partitions, so the exchange ends."""
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    left = common.written(spark, token_pieces(docs, tokenizer, end_id, capacity), f"{folder}/pieces")
    bound, full, step = _bound(left, capacity), 0, 0
    parts = max(1, math.ceil(left.count() / part_pieces))
    done = proofs = None
    while True:
        packed = common.written(spark, _pack(left, parts, capacity, step), f"{folder}/round{step}")
        bins, kept_bins, loose = packed.agg(F.coalesce(F.sum("bins"), F.lit(0)), F.coalesce(F.sum("kept_bins"), F.lit(0)), F.count_if("loose")).first()
        last = parts == 1 or not loose or full + bins <= bound  # no packing of all pieces has fewer
        proof = packed.where("bins is not null").select(F.lit(step).alias("round"), F.shiftright(F.col("sequence_id"), 32).bitwiseAND((1 << 24) - 1).cast("int").alias("part"), "bins", "bound", F.col("bins" if last else "kept_bins").alias("kept_bins"))
        kept = common.unmarked((packed if last else packed.where("not loose")).drop("loose", "bins", "bound", "kept_bins"))
        done, proofs = (kept, proof) if done is None else (done.unionByName(kept), proofs.unionByName(proof))
        if last:
            return done, proofs
        left = packed.where("loose").select(*left.columns)
        full, step, parts = full + kept_bins, step + 1, max(1, min(math.ceil(loose / part_pieces), parts // 2))
