"""Token ids in files of adaptively coded blocks.

Ids of documents in ascending doc_id order are cut into blocks. Each block is
coded by itself: its models start empty and its bytes and its ids are
checksummed. Three predictors see the ids so far: order 2 and order 1 each name
the id that last followed the same two ids or the same id, with a confidence;
order 0 is a distribution over ranges of ids, learned as it goes, even within a
range. Shares adapted for every pair of confidences mix the three, and the mixed
interval drives a range coder with 64-bit state and digits of 32 bits. All
probabilities are of 12 bits and all ranges powers of two wide, so coding needs
no division. An encoder knows all ids, so it computes the intervals of whole
blocks at once and only the coder goes from id to id; a decoder runs the models
id by id. Both take all blocks of a segment in step, as rows of arrays, and share
the integer functions of shares and ranges; tests hold one against the other.

A file: the magic, then segments. A segment: counts (documents, ids, blocks,
ids a block), doc_ids and whether they are null, ids of each document, bytes
and both checksums of each block, then the blocks.

Null texts are empty documents (the end id alone). Texts of any length are
coded whole, across blocks. Null ids come first. Rows of
one doc_id are ordered by text. Repeated rows are documents of their own; an
empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

MAGIC = b"PLIDS2\n"
BLOCK, LANES = 4096, 2048
TOGETHER = 16  # blocks whose intervals are computed at once, few enough for a processor's cache
SLOTS2, SLOTS1, REBUILD = 1024, 1024, 64
NOBODY = 0xFFFF
U = np.uint64
BITS = 12  # of every probability; a digit is 32 bits, and no id takes more than one


def _ranges() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of ids as wide as a power of two, wider towards large ids: range of
    an id, first id, bits of the width."""
    bits = [4] * 16 + [6] * 12 + [8] * 12 + [10] * 60
    width = 1 << np.array(bits, np.int64)
    return np.repeat(np.arange(len(width), dtype=np.uint8), width), np.cumsum(width) - width, np.array(bits, np.uint64)


RANGE_OF, FIRST, WIDTH_BITS = _ranges()
# constants of the steps, as arrays: these are used with less ado than scalars
_LOW, _BITS, _FIVE, _DIGIT, _SIXTEEN_U, _LOW16 = (np.full(1, c, U) for c in (1 << 32, BITS, 5, 32, 16, 0xFFFF))
_ONE, _TWO, _THREE, _FOUR, _SIXTEEN, _SIGN, _MINUS4 = (np.full(1, c, np.int32) for c in (1, 2, 3, 4, 16, 31, -4))
_MIX1, _MIX2, _SHIFTS = np.full(1, 40503), np.full(1, 30011), np.array([[3], [5]])
_MASKS = np.array([[SLOTS2 - 1], [SLOTS1 - 1]])
_FIRST16, _BITS8 = FIRST.astype(np.uint16), WIDTH_BITS.astype(np.uint8)
N_RANGES = len(FIRST)
#: Stands for the range of an id that order 1 or order 2 names: all of the interval.
NAMED = N_RANGES + 1
_NAMED8 = np.full(1, NAMED, np.uint8)
FIRST, WIDTH_BITS = np.append(FIRST, [0, 0]), np.append(WIDTH_BITS, np.zeros(2, np.uint64))
#: Shares of order 2, and of order 1 among the rest, before anything is seen, by
#: confidence, and between what they stay; the shares seen weigh more from PRIOR ids on.
_BEGIN, _LEAST, _MOST2, _MOST1, PRIOR = np.array([4, 1250, 2250, 3250]), 4, 4032, 3840, 16
_CONTEXT = np.arange(32)
_BEGIN2, _BEGIN1 = _BEGIN[_CONTEXT >> 2 & 3], np.where(_CONTEXT < 16, _BEGIN[_CONTEXT & 3] * 3 // 4 + 1, _LEAST)
_PRIOR2, _PRIOR1 = (PRIOR * _BEGIN2).astype(np.int32), (PRIOR * _BEGIN1).astype(np.int32)


class _Model:
    """The predictors of many blocks, one row each. Rows come in order of length,
    so those that are still going on are the first ``a``."""

    def __init__(self, lanes: int) -> None:
        row = np.arange(lanes, dtype=np.int64)
        # orders 2 and 1 as two rows, their tables one behind the other
        self.base, self.base_w = np.stack([row * SLOTS2, lanes * SLOTS2 + row * SLOTS1]), row * 32
        self.base_c, self.base_n = row * (N_RANGES + 3), row * N_RANGES
        self.table = np.full(lanes * (SLOTS2 + SLOTS1), NOBODY << 2, np.int32)
        self.tries = np.zeros((lanes, 32, 3), np.int32)  # by confidences: coded by order 0, 1, 2
        self.upto = np.tile(np.arange(1, N_RANGES + 1, dtype=np.int32), (lanes, 1))  # four for each id seen, and one
        self.lanes, self.seen, self.outcomes = lanes, [], []
        self.id1, self.mixed2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def rebuild(self, a: int, t: int) -> None:
        """Order 0 and the shares of the orders take in what was seen since they were
        last made; ``t``: ids that each of the first ``a`` rows has seen."""
        if self.seen:
            self.tries += np.bincount(np.concatenate(self.outcomes), minlength=self.tries.size).astype(np.int32).reshape(self.tries.shape)
            self.outcomes.clear()
            new = np.bincount(np.concatenate(self.seen), minlength=self.lanes * N_RANGES).reshape(self.lanes, N_RANGES)
            self.upto += np.cumsum(new * 4, axis=1, dtype=np.int32)
            self.seen.clear()
        cum = np.zeros((a, N_RANGES + 3), np.int64)
        upper = _upper(self.upto[:a], t)
        cum[:, 1 : N_RANGES + 1] = upper
        cum[:, NAMED + 1] = 1 << BITS
        self.upper = np.ascontiguousarray(upper.astype(np.int16).T[:-1])  # what isn't below these is in the last range
        self.cum = cum.ravel().view(U)
        q2, q21 = _shares(self.tries[:a])
        self.shares = (q21.ravel().astype(U) << U(16)) | q2.ravel().astype(U)

    def look(self, a: int) -> None:
        """What is predicted next: ids with confidences, and their shares."""
        slots = np.empty((2, a), np.int64)
        np.multiply(self.id1[:a], _MIX1, out=slots[1])
        np.add(slots[1], self.mixed2[:a], out=slots[0])
        slots >>= _SHIFTS
        slots &= _MASKS
        slots += self.base[:, :a]
        self.slots = slots
        self.e = e = self.table.take(slots)
        sure = e & _THREE
        at = sure[0] << _TWO
        at |= sure[1]
        at |= ((e[0] ^ e[1]) - _FOUR >> _SIGN) & _SIXTEEN
        self.sure, self.at = sure, self.base_w[:a] + at
        shares = self.shares.take(self.at)
        self.q = np.empty((2, a), U)
        np.bitwise_and(shares, _LOW16, out=self.q[0])
        np.right_shift(shares, _SIXTEEN_U, out=self.q[1])

    def learn(self, a: int, ids: np.ndarray, named: np.ndarray, ranges: np.ndarray, coded: np.ndarray) -> None:
        """``named``: the ids as tables hold them; ``coded``: the order that coded
        each row."""
        at = self.at * 3
        at += coded
        self.outcomes.append(at)
        self.seen.append(self.base_n[:a] + ranges)
        fresh = named | _ONE
        # how much surer than at first, three at most
        surer = np.minimum(self.sure, _TWO, out=self.sure)
        surer &= (self.e ^ fresh) - _FOUR >> _SIGN
        surer += fresh
        self.table[self.slots] = surer
        np.multiply(self.id1[:a], _MIX2, out=self.mixed2[:a])
        self.id1[:a] = ids


def _shares(tries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of the intervals of order 2 and of order 1, by confidences, from
    how many ids each order coded (orders 0, 1, 2 in the last axis)."""
    none, one, two = np.moveaxis(tries, -1, 0)
    none = none + one
    none += np.int32(PRIOR)
    q1 = np.clip(((one << BITS) + _PRIOR1) // none, _LEAST, _MOST1)
    none += two
    q2 = np.clip(((two << BITS) + _PRIOR2) // none, _LEAST, _MOST2)
    q1 *= np.int32((1 << BITS) - 8) - q2
    q1 >>= BITS
    q1 += q2
    q1 += 1
    return q2, q1


def _upper(upto: np.ndarray, t: int | np.ndarray) -> np.ndarray:
    """Upper end of each range's interval once ``t`` ids are seen; every range keeps
    a share of at least one."""
    upper = upto * np.int32((1 << BITS) - N_RANGES)
    upper //= np.int32(4) * np.int32(t) + np.int32(N_RANGES)
    upper += np.arange(1, N_RANGES + 1, dtype=np.int32)
    return upper


def _seen_before(keys: np.ndarray, steps: int, size: int) -> np.ndarray:
    """How often each of ``size`` keys came before each step; ``keys`` have ``size``
    for every step before theirs added."""
    seen = np.bincount(keys.ravel(), minlength=steps * size).reshape(steps, size)
    upto = np.zeros((steps, size), np.int32)
    seen = seen.astype(np.int32)
    for i in range(1, steps):
        np.add(upto[i - 1], seen[i - 1], out=upto[i])
    return upto


def _entries(slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What a table of ``_Model`` holds at its slot before it learns each id: of the
    ids that used one slot in turn, the last, and how often it came running."""
    order = np.argsort(slots, axis=1, kind="stable")
    order += np.arange(len(slots))[:, None] * slots.shape[1]
    order = order.ravel()
    slot, x = slots.ravel().take(order), ids.ravel().take(order)
    used = np.zeros(len(x), bool)
    np.equal(slot[1:], slot[:-1], out=used[1:])
    used[:: slots.shape[1]] = False
    again = np.zeros(len(x) + 2, np.int8)  # two before the first, which looks back on none
    again[2:] = used
    again[3:] &= (x[1:] == x[:-1]).view(np.int8)
    times = again[1:-2] & again[2:-1]
    times += again[2:-1]
    times += np.int8(1)
    x <<= 2
    e = np.full(len(x), NOBODY << 2, np.int32)
    e[1:] = np.where(used[1:], x[:-1] | times, np.int32(NOBODY << 2))
    out = np.empty(len(x), np.int32)
    out[order] = e
    return out.reshape(slots.shape)


def _intervals(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """What ``_Model`` predicts for every id of some blocks (a row each), as an
    encoder knows all ids beforehand: begin and width of the order's interval, of
    the range's in it, bits of the range's width and the place in the range."""
    lanes, n = rows.shape
    steps = n // REBUILD
    x = rows.astype(np.int32)
    before = np.zeros((lanes, n + 2), np.int32)
    before[:, 2:] = x
    m = before[:, 1:-1].astype(np.uint32) * np.uint32(40503)
    e1 = _entries((m >> np.uint32(5)).astype(np.uint16) & np.uint16(SLOTS1 - 1), x)
    m += before[:, :-2].astype(np.uint32) * np.uint32(30011)
    e2 = _entries((m >> np.uint32(3)).astype(np.uint16) & np.uint16(SLOTS2 - 1), x)
    named = x << 2
    is2, is1 = (e2 ^ named) < 4, (e1 ^ named) < 4
    hit = is2 | is1
    at = (e2 & 3) << 2
    at |= e1 & 3
    at += ((e2 ^ e1) < 4).view(np.int8) << np.int8(4)
    # a row for each step and block
    place = np.repeat(np.arange(steps) * lanes + np.arange(lanes)[:, None], REBUILD, axis=1)
    at = place * 32 + at
    outcomes = at * 3
    outcomes += hit.view(np.int8) + is2.view(np.int8)
    q2, q21 = (q.astype(np.uint16).ravel().take(at) for q in _shares(_seen_before(outcomes, steps, lanes * 96).reshape(-1, 32, 3)))
    # numbers are chosen by bits, without jumps
    mask2, mask = (np.negative(m, dtype=np.int16).view(np.uint16) for m in (is2, hit))
    begin = (q21 ^ (q21 ^ q2) & mask) & ~mask2
    whole = np.uint16(1 << BITS)
    part = whole ^ (whole ^ q21) & mask
    part ^= (part ^ q2) & mask2
    part -= begin
    b = RANGE_OF.take(rows)
    upto = _seen_before(place * N_RANGES + b, steps, lanes * N_RANGES).reshape(steps, lanes, N_RANGES)
    upto *= 4
    np.cumsum(upto, axis=2, out=upto)
    upto += np.arange(1, N_RANGES + 1, dtype=np.int32)
    cum = np.zeros((steps, lanes, N_RANGES + 1), np.uint16)
    cum[:, :, 1:] = _upper(upto, np.arange(0, n, REBUILD)[:, None, None])
    at = place * (N_RANGES + 1) + b
    first = cum.ravel().take(at)
    at += 1
    width = cum.ravel().take(at)
    width -= first
    width ^= (width ^ whole) & mask
    off, bits = rows - _FIRST16.take(b), _BITS8.take(b)
    np.invert(mask, out=mask)
    for m in (first, off):
        m &= mask
    bits &= mask.astype(np.uint8)
    return begin, part, first, width, bits, off


def encode_blocks(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each block's bytes; ``sizes`` of consecutive blocks must not grow."""
    if len(sizes) > LANES:
        n = int(sizes[:LANES].sum())
        return encode_blocks(ids[:n], sizes[:LANES]) + encode_blocks(ids[n:], sizes[LANES:])
    lanes, longest = len(sizes), int(sizes[0])
    start = np.cumsum(sizes) - sizes
    # the intervals of whole steps of REBUILD ids; what lies behind a block's end isn't coded
    n = -(-max(longest, 1) // REBUILD) * REBUILD
    rows = np.zeros((min(lanes, TOGETHER), n), np.uint16)
    model = [np.empty((n // REBUILD, lanes, REBUILD), kind) for kind in (*[np.uint16] * 4, np.uint8, np.uint16)]
    for i in range(0, lanes, TOGETHER):
        some = rows[: lanes - i]
        some[:] = 0
        for row, s, k in zip(some, start[i:].tolist(), sizes[i:].tolist()):
            row[:k] = ids[s : s + k]
        for all_, made in zip(model, _intervals(some)):
            all_[:, i : i + len(some)] = made.reshape(len(some), -1, REBUILD).swapaxes(0, 1)
    low, span = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    # a digit before the first, at most one for each id, and two after the last
    out, pos = np.zeros((lanes, longest + 4), np.uint32), np.ones(lanes, np.int64)
    flat, row = out.ravel(), np.arange(lanes) * out.shape[1]
    pos += row
    for t in range(longest):
        a = lanes if t < sizes[-1] else int(np.searchsorted(-sizes, -t, "left"))
        if t % REBUILD == 0:
            turned = [np.ascontiguousarray(m[t // REBUILD].T) for m in model]
        begin, part, first, width, bits, off = (m[t % REBUILD, :a].astype(U) for m in turned)
        r = span[:a]
        r >>= _BITS
        begin *= r
        r *= part
        r >>= _BITS
        first *= r
        begin += first
        r *= width
        r >>= bits
        off *= r
        begin += off
        lo = low[:a]
        lo += begin
        over = np.flatnonzero(lo < begin)
        if len(over):
            over = pos[over] - 1
            while len(over):  # a carry goes on where a digit was full
                flat[over] += np.uint32(1)
                over = over[flat[over] == 0] - 1
        # every row's digit is written, and stays where it is full
        flat[pos[:a]] = lo >> _DIGIT
        full = r < _LOW
        bits = full.astype(U) << _FIVE
        r <<= bits
        lo <<= bits
        pos[:a] += full
    for _ in range(2):
        flat[pos] = low >> U(32)
        low <<= U(32)
        pos += 1
    pos -= row
    return [out[i, 1:n].astype(">u4").tobytes() for i, n in enumerate(pos.tolist())]


def decode_blocks(blocks: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of all blocks, one after another."""
    lanes, longest = len(sizes), int(sizes[0])
    data = np.zeros((lanes, max(map(len, blocks)) // 4 + 4), np.uint32)
    for i, b in enumerate(blocks):
        data[i, : len(b) // 4] = np.frombuffer(b, ">u4")
    model = _Model(lanes)
    span, pos = np.full(lanes, (1 << 64) - 1, U), np.full(lanes, 2, np.int64)
    ahead = data[:, 0].astype(U) << U(32) | data[:, 1]  # the code less the low end
    flat = data.ravel()
    pos += np.arange(lanes) * data.shape[1]
    rows, turned = np.zeros((lanes, longest), np.uint16), np.zeros((REBUILD, lanes), np.uint16)
    whole, smaller = np.full(1, 1 << BITS, U), np.empty((N_RANGES - 1, lanes), bool)
    for t in range(longest):
        a = lanes if t < sizes[-1] else int(np.searchsorted(-sizes, -t, "left"))
        if t % REBUILD == 0:
            model.rebuild(a, t)
        model.look(a)
        behind, r = ahead[:a], span[:a] >> _BITS
        # the rows that order 2 coded, and order 2 or 1: numbers are chosen by bits, without jumps
        by = behind < r * model.q
        masks = np.negative(by, dtype=np.int64).view(U)
        mask2, mask = masks
        q2, q21 = model.q
        begin, part = q21 ^ q2, whole ^ q21
        begin &= mask
        part &= mask
        begin ^= q21
        part ^= whole
        part ^= (part ^ q2) & mask2
        begin &= ~mask2
        part -= begin
        begin *= r
        behind -= begin
        r *= part
        r >>= _BITS
        want = (behind // r).astype(np.int16)
        below = np.less_equal(model.upper[:, :a], want, out=smaller[:, :a]).view(np.uint8)
        own = np.add.reduce(below, axis=0, dtype=np.uint8)
        own ^= (own ^ _NAMED8) & mask.astype(np.uint8)
        own = own.astype(np.int64)
        c = model.base_c[:a] + own
        first = model.cum.take(c)
        c += 1
        width = model.cum.take(c)
        width -= first
        first *= r
        behind -= first
        r *= width
        r >>= WIDTH_BITS.take(own)
        off = behind // r
        off &= ~mask
        named = (FIRST.take(own) + off.view(np.int64)).astype(np.int32) << _TWO
        e2, e1 = model.e
        small2, small = masks.astype(np.int32)
        e = e1 ^ e2
        e &= small2
        e ^= e1
        e ^= named
        e &= small
        named ^= e
        named &= _MINUS4
        x = (named >> _TWO).astype(np.int64)
        b = RANGE_OF.take(x)
        off *= r
        behind -= off
        span[:a] = r
        turned[t % REBUILD, :a] = x
        if t % REBUILD == REBUILD - 1 or t == longest - 1:
            rows[:, t - t % REBUILD : t + 1] = turned[: t % REBUILD + 1].T
        full = r < _LOW
        digit = flat.take(pos[:a]).astype(U)
        digit &= np.negative(full, dtype=np.int64).view(U)
        bits = full.astype(U) << _FIVE
        np.left_shift(r, bits, out=span[:a])
        behind <<= bits
        behind |= digit
        pos[:a] += full
        model.learn(a, x, named, b, by.view(np.uint8).sum(axis=0, dtype=np.int64))
    return np.concatenate([rows[i, :n] for i, n in enumerate(sizes.tolist())])


def _block_sizes(n: int) -> np.ndarray:
    """Blocks of nearly equal size, at most BLOCK, none larger than the one before."""
    k = max(1, -(-n // BLOCK))
    return np.full(k, n // k) + (np.arange(k) < n % k)


def write_segment(f, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
    sizes = _block_sizes(len(ids))
    blocks = encode_blocks(ids, sizes)
    start = np.cumsum(sizes) - sizes
    f.write(struct.pack("<4q", len(doc_ids), len(ids), len(blocks), int(sizes[0])))
    f.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    f.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    f.write(np.asarray(counts, "<i8").tobytes())
    f.write(np.array([len(b) for b in blocks], "<u4").tobytes())
    f.write(np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes())
    f.write(np.array([zlib.crc32(ids[s : s + n].astype("<u2").tobytes()) for s, n in zip(start.tolist(), sizes.tolist())], "<u4").tobytes())
    f.writelines(blocks)


class _Segment(NamedTuple):
    path: str
    doc_ids: list[int | None]
    counts: np.ndarray
    sizes: np.ndarray
    blocks: list[bytes]
    id_crcs: np.ndarray


def _segments(path: str) -> Iterator[_Segment]:
    """Each segment with its blocks as they are stored; raises where the checksum of
    a block's bytes is wrong."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} isn't a file of token ids")
        while head := f.read(32):
            docs, n, k, _ = struct.unpack("<4q", head)
            take = lambda kind, m: np.frombuffer(f.read(np.dtype(kind).itemsize * m), kind)
            doc, null, counts, size, crc, id_crc = take("<i8", docs), take("u1", docs), take("<i8", docs), take("<u4", k), take("<u4", k), take("<u4", k)
            blocks = [f.read(int(s)) for s in size]
            if bad := [i for i, b in enumerate(blocks) if zlib.crc32(b) != crc[i]]:
                raise ValueError(f"{path}: wrong checksum in blocks {bad[:5]}")
            yield _Segment(path, [None if z else d for d, z in zip(doc.tolist(), null.tolist())], counts, _block_sizes(n), blocks, id_crc)


def _decoded(segments: list[_Segment]) -> Iterator[np.ndarray]:
    """All ids of each segment, decoded in step; raises where the checksum of a
    block's ids is wrong."""
    sizes = np.concatenate([s.sizes for s in segments])
    order = np.argsort(-sizes, kind="stable")
    blocks = [b for s in segments for b in s.blocks]
    ids = decode_blocks([blocks[i] for i in order.tolist()], sizes[order])
    start = np.empty(len(sizes), np.int64)
    start[order] = np.cumsum(sizes[order]) - sizes[order]
    at = 0
    for s in segments:
        rows = [ids[i : i + n] for i, n in zip(start[at : at + len(s.sizes)].tolist(), s.sizes.tolist())]
        at += len(rows)
        if bad := [i for i, r in enumerate(rows) if zlib.crc32(r.astype("<u2").tobytes()) != s.id_crcs[i]]:
            raise ValueError(f"{s.path}: wrong checksum in blocks {bad[:5]}")
        yield np.concatenate(rows)


def read_segments(path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids of each document, all ids) of each segment; raises where a
    checksum is wrong."""
    for s in _segments(path):
        for ids in _decoded([s]):
            yield s.doc_ids, s.counts, ids


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, most_ids: int = BLOCK * LANES) -> DataFrame:
    """Encode every text and write the files; (part, path, n_docs, n_tokens) of each."""
    where = common.local_path(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from plumbline.llm.wordtok import open_tokenizer, slices

        tok = open_tokenizer(tokenizer, merged=True)
        part = TaskContext.get().partitionId()
        Path(where).mkdir(parents=True, exist_ok=True)
        path = f"{where}/part-{part:06d}.ids"
        unfinished = f"{path}.{TaskContext.get().taskAttemptId()}"
        n_docs = n_ids = waiting = 0
        keys: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        with open(unfinished, "wb") as f:
            f.write(MAGIC)

            def flush() -> None:
                nonlocal waiting
                if keys:
                    write_segment(f, keys, np.concatenate(counts), np.concatenate(ids))
                keys.clear()
                counts.clear()
                ids.clear()
                waiting = 0

            for pdf in batches:
                texts = pdf["text"].fillna("").tolist()
                for s in slices(texts, 1 << 19):  # so that many new words are merged at once
                    got, n = tok.batch(texts[s])
                    got = np.insert(got, np.cumsum(n), np.uint16(end_id))
                    keys += [None if z else d for d, z in zip(pdf["doc_id"].iloc[s].tolist(), pdf["no_id"].iloc[s].tolist())]
                    counts.append(n + 1)
                    ids.append(got)
                    waiting += len(got)
                    n_docs, n_ids = n_docs + len(n), n_ids + len(got)
                    if waiting >= most_ids:
                        flush()
            flush()
        if n_docs:
            os.replace(unfinished, path)  # a task that runs again writes the same file
            yield pd.DataFrame({"part": [part], "path": [path], "n_docs": [n_docs], "n_tokens": [n_ids]})
        else:
            os.remove(unfinished)

    common.ship(docs.sparkSession)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cols = cols.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return common.marked(cols, "text").mapInPandas(run, "part int, path string, n_docs long, n_tokens long")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from (path, start)."""

    def read(waiting: list[tuple[_Segment, int]]) -> Iterator[pd.DataFrame]:
        for (s, at), ids in zip(waiting, _decoded([s for s, _ in waiting])):
            ids = ids.astype("<u4")
            edge = np.concatenate([[0], np.cumsum(s.counts)])
            out = pd.DataFrame({"doc_id": np.array([d or 0 for d in s.doc_ids], np.int64), "no_id": [d is None for d in s.doc_ids], "start": at + edge[:-1], "n_tokens": s.counts})
            out["ids_crc32"] = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[_Segment, int]] = []
        lanes = 0
        for pdf in batches:
            for path, at in zip(pdf["path"].tolist(), pdf["start"].tolist()):
                for s in _segments(path):
                    if waiting and lanes + len(s.blocks) > 2 * LANES:
                        yield from read(waiting)
                        waiting, lanes = [], 0
                    waiting.append((s, at))
                    lanes += len(s.blocks)
                    at += int(s.counts.sum())
        if waiting:
            yield from read(waiting)

    return common.unmarked(files.mapInPandas(run, "doc_id long, no_id boolean, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files below the shared folder and read every document back."""
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    made = write_files(docs, tokenizer, f"{folder}/ids", end_id).collect()  # a row for each partition
    files, at = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        files.append((r["path"], at))
        at += r["n_tokens"]
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # two files a task, which are decoded in step, but no fewer tasks than run at once
    tasks = max(min(len(files), spark.sparkContext.defaultParallelism), -(-len(files) // 2))
    return read_files(spark.createDataFrame(files, "path string, start long").repartitionByRange(tasks, "start"))
