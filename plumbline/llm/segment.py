"""N-best segmentation of texts into the pieces of a SentencePiece model.

The lattice of a text has an edge for every piece that stands in it; a character
that is no piece is an edge of its bytes with the score of the worst piece less
``UNKNOWN``. A path's score is the sum of its pieces' scores in the model file.
Where no piece holds the two characters around a place side by side, no edge
crosses it, and the lattice is cut there. In each part a forward Viterbi pass finds the best score up to every
place; a backward A* search from the end, with these scores as its exact
heuristic, yields the best paths in order. As the heuristic is exact, an open
path's estimate is the score of its best completion, so only as many open paths
as are still wanted need be held. All new parts are searched in step.

A text's N best paths combine its parts' lists: each but the best takes
alternatives from among the N - 1 with the least loss. Among equal scores the
order is fixed by the search, alike in every run. Known parts are kept in a
bounded table.

Decoding joins the pieces, with bytes put together, and turns word marks into
spaces. Null texts are empty ones: one path without pieces. Texts with fewer
than N paths give fewer rows. Repeated rows give repeated rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.wordtok import HashTable, slices, word_hashes

UNKNOWN = 10.0


class Pieces:
    """The model's pieces as a trie over characters with suffix links."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in range(n)])
        self.score = np.append(score, score[normal].min() - UNKNOWN)  # the last: a character without a piece
        self.unknown = n
        self.length = np.array([len(t) for t in self.text] + [1], np.int64)
        child: dict[int, int] = {}
        piece, depth, up = [-1], [0], [(0, 0)]
        for i in normal:
            node = 0
            for c in map(ord, self.text[i]):
                key = node << 21 | c
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                    depth.append(depth[node] + 1)
                    up.append((node, c))
                node = child[key]
            piece[node] = i
        fail = [0] * len(piece)
        ends: list[list[int]] = [[] for _ in piece]
        for node in sorted(range(1, len(piece)), key=depth.__getitem__):
            parent, c = up[node]
            while parent:
                parent = fail[parent]
                if (parent << 21 | c) in child:
                    fail[node] = child[parent << 21 | c]
                    break
            ends[node] = ([piece[node]] if piece[node] >= 0 else []) + ends[fail[node]]
        # a place whose character alone is no piece has the unknown edge as well
        ends = [e if e and len(self.text[e[-1]]) == 1 else [*e, n] for e in ends]
        self.width = max(map(len, ends))
        self.n_ends = np.array([len(e) for e in ends], np.int64)
        self.ends = np.array([e + [-1] * (self.width - len(e)) for e in ends], np.int32)
        self.fail = np.array(fail, np.int64)
        # which pairs of characters stand side by side in some piece
        chars = sorted({c for i in normal for c in self.text[i]})
        self.char_no = np.zeros(0x110000, np.uint16)
        self.char_no[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for i in normal:
            no = self.char_no[[ord(c) for c in self.text[i]]]
            self.beside[no[:-1], no[1:]] = True
        # all pieces' characters, one after another
        self.chars_at = np.concatenate([[0], np.cumsum(self.length)])
        self.chars = np.frombuffer("".join([*self.text, "\0"]).encode("utf-32-le"), np.uint32)
        self.key = np.array(sorted(child), np.int64)
        self.to = np.array([child[k] for k in self.key.tolist()], np.int64)

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The longest suffix in the trie after one more character."""
        node, out = node.copy(), np.zeros(len(node), np.int64)
        live = np.arange(len(node))
        while len(live):
            key = node[live] << 21 | c[live]
            p = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[p] == key
            out[live[hit]] = self.to[p[hit]]
            live = live[~hit]
            live = live[node[live] > 0]
            node[live] = self.fail[node[live]]
        return out

    def ids_of(self, edges: list[int], text: str) -> list[int]:
        """Ids of a path's edges over ``text``: unknown characters as bytes."""
        out, at = [], 0
        for e in edges:
            if e == self.unknown:
                out += [self.byte_id[b] for b in text[at].encode("utf-8", "surrogatepass")]
            else:
                out.append(e)
            at += int(self.length[e])
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text with word marks that ids stand for."""
        data = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode("utf-8") for i in ids)
        return data.decode("utf-8", "surrogatepass")


def search(pieces: Pieces, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` best paths of each text (none of them empty): scores (-inf: no
    more paths), sizes and offsets by text and rank, and all ids."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(size, kind="stable")
    score = np.full((len(texts), n), -np.inf)
    count, at = np.zeros((len(texts), n), np.int32), np.zeros((len(texts), n), np.int64)
    ids, n_ids, a = [], 0, 0
    while a < len(order):  # texts of like length together
        b = a + 1
        while b < len(order) and size[order[b]] <= max(8, size[order[a]] * 5 // 4) and (b - a) * size[order[b]] < 200_000:
            b += 1
        pick = order[a:b]
        got = _search(pieces, [texts[i] for i in pick.tolist()], size[pick], n)
        text, rank = pick[got[0]], got[1]
        score[text, rank], count[text, rank] = got[2], got[3]
        at[text, rank] = n_ids + np.cumsum(got[3]) - got[3]
        ids.append(got[4])
        n_ids += len(got[4])
        a = b
    return score, count, at, np.concatenate([np.zeros(0, np.int64), *ids])


def _search(pieces: Pieces, texts: list[str], length: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Row, rank, score and size of each path, in this order, and all ids."""
    s, longest = len(texts), int(length.max())
    rows = np.arange(s)
    chars = np.zeros((s, longest), np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars[np.arange(longest)[None] < length[:, None]] = flat
    nodes = np.zeros((longest + 1, s), np.int64)
    best = np.full((longest + 1, s), -np.inf)
    best[0] = 0
    for p in range(longest):  # forward Viterbi
        nodes[p + 1] = pieces.step(nodes[p], chars[:, p])
        edges = pieces.ends[nodes[p + 1], : int(pieces.n_ends[nodes[p + 1]].max())]
        start = p + 1 - pieces.length[edges]
        value = np.where((edges >= 0) & (start >= 0), best[np.maximum(start, 0), rows[:, None]] + pieces.score[edges], -np.inf)
        best[p + 1] = value.max(axis=1)
    # backward A*: each row's n best open paths, the best first
    est = np.full((s, n), -np.inf)
    behind, place = np.zeros((s, n)), np.zeros((s, n), np.int64)
    parent, edge = np.full((s, n), -1, np.int64), np.full((s, n), -1, np.int64)
    est[:, 0], place[:, 0] = best[length, rows], length
    log_parent, log_edge = [], []
    got = np.zeros(s, np.int64)
    ends: list[tuple[np.ndarray, ...]] = []
    live, popped = rows, 0
    while len(live):
        e, c, at, up, by = (x[live] for x in (est, behind, place, parent, edge))
        here = at[:, 0]
        log_parent.append(up[:, 0])
        log_edge.append(by[:, 0])
        number = popped + np.arange(len(live))
        popped += len(live)
        done = here == 0
        ends.append((live[done], got[live[done]], e[done, 0], number[done]))
        got[live[done]] += 1
        node = nodes[here, live]
        new = pieces.ends[node, : max(1, int(pieces.n_ends[node].max()))]
        start = here[:, None] - pieces.length[new]
        ok = (new >= 0) & (start >= 0) & ~done[:, None]
        cost = c[:, :1] + pieces.score[new]
        reach = np.where(ok, cost + best[np.maximum(start, 0), live[:, None]], -np.inf)
        # the other open paths and the new ones; as each estimate is met, n of them are enough
        full = np.concatenate([e[:, 1:], reach], axis=1)
        if full.shape[1] < n:
            full = np.concatenate([full, np.full((len(live), n - full.shape[1]), -np.inf)], axis=1)
        rank = np.argsort(-full, axis=1, kind="stable")[:, :n]
        old = rank < n - 1
        r_old, r_new = np.minimum(rank + 1, n - 1), np.clip(rank - (n - 1), 0, new.shape[1] - 1)
        k = np.arange(len(live))[:, None]
        est[live] = full[k, rank]
        behind[live] = np.where(old, c[k, r_old], cost[k, r_new])
        place[live] = np.where(old, at[k, r_old], start[k, r_new])
        parent[live] = np.where(old, up[k, r_old], number[:, None])
        edge[live] = np.where(old, by[k, r_old], new[k, r_new])
        live = live[(got[live] < n) & (est[live, 0] > -np.inf)]
    row, rank, score, last = (np.concatenate(x) for x in zip(*ends))
    all_parent, all_edge = np.concatenate(log_parent), np.concatenate(log_edge)
    # all paths from the front to the end, in step
    path = np.full((len(row), longest), -1, np.int64)
    size, at, going = np.zeros(len(row), np.int64), last.copy(), np.arange(len(row))
    while True:
        by = all_edge[at[going]]
        going, by = going[by >= 0], by[by >= 0]
        if not len(going):
            break
        path[going, size[going]] = by
        size[going] += 1
        at[going] = all_parent[at[going]]
    odd = np.flatnonzero((path == pieces.unknown).any(axis=1))
    if not len(odd):
        return row, rank, score, size, path[path >= 0]
    ids = np.split(path[path >= 0], np.cumsum(size)[:-1])
    for i in odd.tolist():
        ids[i] = np.array(pieces.ids_of(ids[i].tolist(), texts[row[i]]), np.int64)
        size[i] = len(ids[i])
    return row, rank, score, size, np.concatenate(ids)


class Segmenter:
    """N best segmentations of whole texts, with a bounded table of parts."""

    def __init__(self, path: str, n: int, most_parts: int = 800_000) -> None:
        self.pieces, self.n, self.most = Pieces(path), n, most_parts
        self.known = HashTable()
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        n, cap = self.n, 1 << 14
        self.count = 0
        self.score = np.full((cap, n), -np.inf)
        self.at, self.size = np.zeros((cap, n), np.int64), np.zeros((cap, n), np.int32)
        self.exact = np.ones(cap, bool)
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint16), 0

    def _learn(self, parts: list[str], a: np.ndarray, b: np.ndarray) -> None:
        score, size, at, flat = search(self.pieces, parts, self.n)
        need = self.count + len(parts)
        while need > len(self.score):
            for name, fill in (("score", -np.inf), ("at", 0), ("size", 0), ("exact", True)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full_like(old, fill)]))
        own = slice(self.count, need)
        self.score[own], self.size[own], self.at[own] = score, size, at + self.n_ids
        self.exact[own] = self._decodes(parts, size, at, flat)
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)
        self.known.add(a, b, np.arange(self.count, need, dtype=np.int32))
        self.count = need

    def _decodes(self, parts: list[str], size: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether all paths of each part decode to it."""
        p = self.pieces
        plain = ~np.isin(ids, p.byte_id)
        own = np.where(plain, p.length[ids], 0)
        upto = np.concatenate([[0], np.cumsum(own)])
        chars = p.chars[np.repeat(p.chars_at[ids] - upto[:-1], own) + np.arange(upto[-1])]
        odd = np.concatenate([[0], np.cumsum(~plain)])
        out = np.ones(len(parts), bool)
        want = np.fromiter(map(len, parts), np.int64, len(parts))
        text = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(want) - want
        for k in range(self.n):
            has = size[:, k] > 0
            a, b = at[:, k], at[:, k] + size[:, k]
            fast = np.flatnonzero(has & (odd[b] == odd[a]))
            same = upto[b[fast]] - upto[a[fast]] == want[fast]
            out[fast[~same]] = False
            fast = fast[same]
            step = np.arange(int(want[fast].sum())) - np.repeat(np.cumsum(want[fast]) - want[fast], want[fast])
            equal = chars[np.repeat(upto[a[fast]], want[fast]) + step] == text[np.repeat(first[fast], want[fast]) + step]
            out[np.repeat(fast, want[fast])[~equal]] = False
            for i in np.flatnonzero(has & (odd[b] > odd[a])).tolist():
                out[i] &= p.decoded(ids[a[i] : b[i]].tolist()) == parts[i]
        return out

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all parts, and where each text's parts end."""
        joined = "\0".join(texts) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        no = self.pieces.char_no[cps]
        cut = np.concatenate([[True], ~self.pieces.beside[no[:-1], no[1:]]])
        cut[stop] = True
        cut[np.minimum(stop + 1, len(cps) - 1)] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(cps))
        keep = np.ones(len(start), bool)
        keep[np.searchsorted(start, stop)] = False
        start, end = start[keep], end[keep]
        a, b = word_hashes(cps, start, end)
        at = self.known.find(a, b)
        while len(new := np.flatnonzero(at < 0)):
            _, first = np.unique(a[new], return_index=True)
            own = new[first]
            if self.count and self.count + len(own) > self.most:
                self._reset()
                at[:] = -1
                continue
            self._learn([joined[s:e] for s, e in zip(start[own].tolist(), end[own].tolist())], a[own], b[own])
            at[new] = self.known.find(a[new], b[new])
        return at, np.searchsorted(start, stop)

    def _ids(self, part: np.ndarray, choice: np.ndarray) -> np.ndarray:
        size = self.size[part, choice].astype(np.int64)
        total = np.cumsum(size)
        where = np.repeat(self.at[part, choice] - (total - size), size)
        where += np.arange(len(where))
        return self.ids[where]

    def best(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray, bool]]]:
        """For each text its N best (score, ids, whether they decode to it)."""
        normal = [self.pieces.sp.normalize(t) if t else "" for t in texts]
        part, upto = self.parts(normal)
        first = self._ids(part, np.zeros(len(part), np.int64))
        edges = np.concatenate([[0], np.cumsum(self.size[part, 0].astype(np.int64))])
        total = np.concatenate([[0.0], np.cumsum(self.score[part, 0])])
        loss = self.score[part, 0][:, None] - self.score[part, 1:]
        fine = np.concatenate([[0], np.cumsum(~self.exact[part])])
        a = 0
        for b in upto.tolist():
            ids = first[edges[a] : edges[b]]
            score, exact = float(total[b] - total[a]), bool(fine[a] == fine[b])
            own = loss[a:b].ravel()
            least = np.flatnonzero(own < np.inf)
            if len(least) > self.n - 1:
                least = least[np.argsort(own[least], kind="stable")[: self.n - 1]] if len(least) < 64 else self._least(own)
            swaps = [(float(own[x]), a + int(x) // (self.n - 1), 1 + int(x) % (self.n - 1)) for x in least.tolist()]
            choices = [()] + [c for k in range(1, self.n) for c in itertools.combinations(swaps, k) if len({p for _, p, _ in c}) == k]
            choices.sort(key=lambda c: (sum(x for x, _, _ in c), len(c)))
            paths = []
            for c in choices[: self.n]:
                bits, at = [], a
                for _, p, k in sorted(c, key=lambda x: x[1]):
                    bits += [first[edges[at] : edges[p]], self._ids(part[p : p + 1], np.array([k]))]
                    at = p + 1
                full = np.concatenate([*bits, first[edges[at] : edges[b]]]) if bits else ids
                paths.append((score - sum(x for x, _, _ in c), full, exact))
            yield paths
            a = b

    def _least(self, own: np.ndarray) -> np.ndarray:
        edge = np.partition(own, self.n - 2)[self.n - 2]
        at = np.flatnonzero(own <= edge)
        return at[np.argsort(own[at], kind="stable")[: self.n - 1]]


_open: dict[tuple[str, int], Segmenter] = {}


def n_best(docs: DataFrame, model: str, n: int = 4, keep_ids: bool = False) -> DataFrame:
    """One row for each text and path: its rank from 1, score, number of ids,
    their crc32, whether they decode to the text; with ``keep_ids`` the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = _open.get((model, n)) or _open.setdefault((model, n), Segmenter(model, n))
        for pdf in batches:
            texts, key = pdf["text"].fillna("").tolist(), list(zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist()))
            for s in slices(texts, 1 << 20):
                rows = []
                for doc, paths in zip(key[s], seg.best(texts[s])):
                    for k, (score, ids, exact) in enumerate(paths, 1):
                        rows.append((*doc, k, score, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), exact, *([ids.astype(np.int32)] if keep_ids else [])))
                out = pd.DataFrame(rows, columns=["doc_id", "no_id", "rank", "score", "n_tokens", "ids_crc32", "round_trip", *(["ids"] if keep_ids else [])])
                yield out

    common.ship(docs.sparkSession)
    cols = common.marked(docs, F.col("text").cast("string").alias("text"))
    return common.unmarked(cols.mapInPandas(run, "doc_id long, no_id boolean, rank int, score double, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if keep_ids else "")))
