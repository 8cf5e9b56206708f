"""Token counts by deterministic transducers compiled from a tokenizer file.

Two transducers stand in series. The first reads classes of code points and
marks where pre-tokens begin. It has six states, so the maps that stretches of
text make of its states form a small monoid: every chunk of a text is reduced
to one element of it, all chunks at once; a parallel prefix scan composes them;
and from each chunk's first state, then known, all chunks are read again.

The second reads a pre-token's bytes, the last one marked. A state holds, for
the open ends of the input that could still become tokens, the last token
before each and how many fewer tokens stood there; an entry of a transition is
the tokens that it adds (or takes back). A pair of neighbouring tokens is
possible just if byte-pair encoding of their joined text gives that pair, and
the last token of every prefix is the only one that is possible after the one
before it; so the states are exact. There are too many to list beforehand:
states and transitions are made when the input first reaches them, many at
once. Counts of known pre-tokens are kept in a bounded table.

Null texts count as empty. Special strings in a text count as one token.
Repeated rows give repeated rows; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.wordtok import _BYTE_CHARS, LETTER, NUMBER, SPACE, HashTable, WordTokenizer, char_classes, slices, word_hashes

# --- first transducer: pre-tokens -------------------------------------------------------------
SP, L, STMD, RV, E, LL, N, AP, O = range(9)
START, WORD, MARKS, APOS, APOS_RV, APOS_L = range(6)
CHUNK = 256


def _pre_rules() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state; whether a pre-token begins at the character read; whether one
    begins at the character before it."""
    to, begins, late = (np.zeros((6, 9), np.uint8) for _ in range(3))
    fresh = {SP: (START, 0), N: (START, 1), AP: (APOS, 1), O: (MARKS, 1)} | {c: (WORD, 1) for c in (L, STMD, RV, E, LL)}
    for state in range(6):
        for c in range(9):
            nxt, b = fresh[c]
            if state in (WORD, APOS_RV, APOS_L) and nxt == WORD:
                b = 0  # goes on with the letters
            if state in (MARKS, APOS) and c in (AP, O):
                nxt, b = MARKS, 0
            if state == APOS and c in (STMD, RV, LL):
                nxt, b = {STMD: START, RV: APOS_RV, LL: APOS_L}[c], 0
            if (state, c) in ((APOS_RV, E), (APOS_L, LL)):
                nxt, b = START, 0
            elif state in (APOS_RV, APOS_L):
                late[state, c] = 1
            to[state, c], begins[state, c] = nxt, b
    return to, begins, late


class PreTokens:
    """The pre-token transducer with the monoid of its state maps."""

    def __init__(self) -> None:
        self.to, self.begins, self.late = _pre_rules()
        maps = [tuple(range(6))]
        index = {maps[0]: 0}
        by_class: list[list[int]] = []
        for m in maps:  # grows while it is read
            row = []
            for c in range(9):
                t = tuple(int(self.to[s, c]) for s in m)
                if t not in index:
                    index[t] = len(maps)
                    maps.append(t)
                row.append(index[t])
            by_class.append(row)
        self.maps = np.array(maps, np.uint8)
        self.after = np.array(by_class, np.uint16)
        self.times = np.array([[index[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint16)
        cls = np.full(0x110000, O, np.uint8)
        kind = char_classes()
        cls[kind == LETTER], cls[kind == NUMBER], cls[kind == SPACE] = L, N, SP
        for c, chars in ((STMD, "stmd"), (RV, "rv"), (E, "e"), (LL, "l"), (AP, "'")):
            cls[[ord(x) for x in chars]] = c
        self.cls = cls

    def states(self, cls: np.ndarray) -> np.ndarray:
        """The state before each character."""
        n = len(cls)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, SP, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        flat, m = self.after.ravel(), np.zeros(chunks, np.uint16)
        for row in grid:
            m = flat[m * np.uint16(9) + row]
        # inclusive scan by doubling: after step k each entry composes 2^k chunks
        step = 1
        while step < chunks:
            m = np.concatenate([m[:step], self.times[m[:-step], m[step:]]])
            step *= 2
        state = np.concatenate([[np.uint8(START)], self.maps[m[:-1], START]])
        out, to = np.empty_like(grid), self.to.ravel()
        for k, row in enumerate(grid):
            out[k] = state
            state = to[state * np.uint8(9) + row]
        return out.T.ravel()[:n]

    def cut(self, cps: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each pre-token; ``stop``: one place after each text."""
        cls = self.cls[cps]
        cls[stop] = SP
        state = self.states(cls)
        at = state.astype(np.int64) * 9 + cls
        begin = self.begins.ravel()[at].astype(bool)
        late = np.flatnonzero(self.late.ravel()[at])
        begin[late - 1] = True
        edge = np.flatnonzero(begin | (cls == SP))
        first = begin[edge]
        return edge[first], np.append(edge[1:], len(cps))[first]


# --- second transducer: byte pairs ------------------------------------------------------------
NONE, BEGIN = -2, -1


class BytePairs:
    """Counts byte-pair tokens of words, all words in step, by a transducer whose
    states are made on demand."""

    def __init__(self, merges: list, most_states: int = 1_500_000) -> None:
        back = {c: b for b, c in _BYTE_CHARS.items()}

        def symbols(token: str) -> tuple[int, ...]:
            end = token.endswith("</w>") and len(token) > 4
            s = [back[c] for c in (token[:-4] if end else token)]
            if end:
                s[-1] += 256
            return tuple(s)

        ids = {(s,): s for s in range(512)}
        text = {s: (s,) for s in range(512)}
        left, right, pair = list(range(512)), list(range(512)), {}
        for m in merges:
            a, b = (ids[symbols(x)] for x in (m if isinstance(m, list) else m.split(" ")))
            joined = text[a] + text[b]
            t = ids.get(joined)
            if t is None:
                t = ids[joined] = len(left)
                text[t] = joined
                left.append(a)
                right.append(b)
            pair[a << 20 | b] = t
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.size = np.array([len(text[t]) for t in range(len(left))], np.int64)
        keys = np.array(sorted(pair), np.int64)
        self.pair_key, self.pair_to = keys, np.array([pair[k] for k in keys.tolist()], np.int64)
        # trie of all tokens, with links to the longest proper suffix that is in it
        child: dict[int, int] = {}
        token, depth, up = [NONE], [0], [(0, 0)]
        for s, t in ids.items():
            node = 0
            for x in s:
                key = node << 9 | x
                if key not in child:
                    child[key] = len(token)
                    token.append(NONE)
                    depth.append(depth[node] + 1)
                    up.append((node, x))
                node = child[key]
            token[node] = t
        self.child_key = np.array(sorted(child), np.int64)
        self.child_to = np.array([child[k] for k in self.child_key.tolist()], np.int64)
        order = sorted(range(1, len(token)), key=depth.__getitem__)
        fail, alive, tail = [0] * len(token), [1] * len(token), [0] * len(token)
        for node in order:
            parent, x = up[node]
            f = fail[parent]
            while parent:
                to = child.get(f << 9 | x)
                if to is not None:
                    fail[node] = to
                    break
                if not f:
                    break
                f = fail[f]
            alive[node] = alive[fail[node]] | 1 << depth[node]
            tail[node] = node if token[node] != NONE else tail[fail[node]]
        self.token, self.depth, self.fail, self.tail = (np.array(x, np.int64) for x in (token, depth, fail, tail))
        self.width = max(depth) + 1
        self.alive = np.array([[a >> k & 1 for k in range(self.width)] for a in alive], bool)
        rng = np.random.default_rng(5)
        self.mix = rng.integers(1, 2**63, (2, 2 * self.width + 1), dtype=np.uint64) | np.uint64(1)
        self.most = most_states
        self.reset()

    def reset(self) -> None:
        self.states, self.moves = HashTable(), HashTable()
        cap = 1 << 12
        self.node, self.last, self.less = np.zeros(cap, np.int32), np.full((cap, self.width), NONE, np.int32), np.zeros((cap, self.width), np.int8)
        self.goto, self.adds = np.zeros(cap, np.int32), np.zeros(cap, np.int8)
        self.n_states = self.n_moves = 0
        last = np.full((1, self.width), NONE, np.int32)
        last[0, 0] = BEGIN
        self._state(np.zeros(1, np.int64), last, np.zeros((1, self.width), np.int8))

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether byte-pair encoding leaves tokens a, b side by side."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40, np.int64)
        while len(live):
            key = a << 20 | b
            p = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            bad = (self.pair_key[p] == key) & (self.pair_to[p] < limit)
            out[live[bad]] = False
            # undo the later of the two merges; a single symbol can't be undone, then undo the other
            ra, lb = self.right[a], self.left[b]
            first = np.where(a > b, True, False)
            stuck = np.where(first, ra == a, lb == b)
            use_a = first ^ stuck
            over = np.where(use_a, ra == a, lb == b)
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, ra, a), np.where(use_a, b, lb)
            go = ~bad & ~over
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return out

    def _grow(self, names: tuple[str, ...], need: int) -> None:
        for name in names:
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros((max(need, 2 * len(old)), *old.shape[1:]), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _state(self, node: np.ndarray, last: np.ndarray, less: np.ndarray) -> np.ndarray:
        """Numbers of the states with this content, made where they are new."""
        keys = []
        for mix in self.mix:
            h = node.astype(np.uint64) * mix[-1]
            for k in range(self.width):
                x = (last[:, k].astype(np.int64) + 3).astype(np.uint64) * mix[k]
                x ^= x >> np.uint64(31)
                h += x * mix[self.width + k] + less[:, k].astype(np.int64).astype(np.uint64) * (mix[self.width + k] ^ mix[k])
            h ^= h >> np.uint64(32)
            h *= mix[0]
            keys.append(h ^ (h >> np.uint64(29)))
        at = self.states.find(*keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, first = np.unique(keys[0][new], return_index=True)
            own = new[first]
            n = self.n_states
            self._grow(("node", "last", "less"), n + len(own))
            s = slice(n, n + len(own))
            self.node[s], self.last[s], self.less[s] = node[own], last[own], less[own]
            self.states.add(keys[0][own], keys[1][own], np.arange(n, n + len(own), dtype=np.int32))
            self.n_states += len(own)
            at[new] = self.states.find(keys[0][new], keys[1][new])
            if (at < 0).any():
                raise RuntimeError("two states have one hash")
        return at

    def _child(self, node: np.ndarray, sym: np.ndarray) -> np.ndarray:
        key = node << 9 | sym
        p = np.minimum(np.searchsorted(self.child_key, key), len(self.child_key) - 1)
        return np.where(self.child_key[p] == key, self.child_to[p], -1)

    def _make(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and tokens added, of transitions that weren't there yet."""
        node = self.node[state].astype(np.int64)
        to = self._child(node, sym)
        while len(miss := np.flatnonzero(to < 0)):
            node[miss] = self.fail[node[miss]]
            to[miss] = self._child(node[miss], sym[miss])
        last, less = self.last[state], self.less[state]
        end, adds = np.full(len(state), NONE, np.int64), np.zeros(len(state), np.int64)
        live, cand = np.arange(len(state)), self.tail[to]
        while len(live):
            t = self.token[cand]
            k = self.size[t] - 1
            before = last[live, k].astype(np.int64)
            ok = before == BEGIN
            some = np.flatnonzero(before >= 0)
            ok[some] = self.possible(before[some], t[some])
            hit = live[ok]
            end[hit], adds[hit] = t[ok], 1 - less[hit, k[ok]]
            live, cand = live[~ok], self.tail[self.fail[cand[~ok]]]
        new_last, new_less = np.empty_like(last), np.empty_like(less)
        new_last[:, 1:], new_less[:, 1:] = last[:, :-1], less[:, :-1] + adds[:, None].astype(np.int8)
        new_last[:, 0], new_less[:, 0] = end, 0
        dead = ~self.alive[to]
        new_last[dead], new_less[dead] = NONE, 0
        final = sym >= 256
        nxt = np.zeros(len(state), np.int32)
        go = np.flatnonzero(~final)
        nxt[go] = self._state(to[go], new_last[go], new_less[go])
        return nxt, adds.astype(np.int8)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each word (none of them empty)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        state, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for p in range(int(size[0]) if len(words) else 0):
            live = len(size) - int(np.searchsorted(size[::-1], p, "right"))
            sym = data[start[:live] + p].astype(np.int64)
            sym[size[:live] == p + 1] += 256
            key = state[:live].astype(np.int64) << 9 | sym
            a = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            a ^= a >> np.uint64(32)
            b = key.astype(np.uint64)
            at = self.moves.find(a, b)
            new = np.flatnonzero(at < 0)
            if len(new):
                fresh, first = np.unique(key[new], return_index=True)
                own = new[first]
                nxt, adds = self._make(state[own], sym[own])
                n = self.n_moves
                self._grow(("goto", "adds"), n + len(own))
                self.goto[n : n + len(own)], self.adds[n : n + len(own)] = nxt, adds
                self.moves.add(a[own], b[own], np.arange(n, n + len(own), dtype=np.int32))
                self.n_moves += len(own)
                at[new] = self.moves.find(a[new], b[new])
            state[:live] = self.goto[at]
            total[:live] += self.adds[at]
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


class TokenCounter:
    """Tokens of whole texts, without making the ids."""

    def __init__(self, path: str, most_words: int = 2_000_000) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("made for byte pairs with word ends")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.pre, self.pairs = PreTokens(), BytePairs(spec["model"]["merges"])
        self.known, self.most = HashTable(), most_words

    normalized = WordTokenizer.normalized
    words = True

    def counts(self, texts: list[str]) -> np.ndarray:
        owner, parts, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for k, part in enumerate(self.special.split(t) if "<|" in t else [t]):
                owner.append(i)
                parts.append(self.normalized(part))
                extra[i] += k > 0
        if not parts:
            return extra
        joined = "\0".join(parts) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        start, end = self.pre.cut(cps, stop)
        a, b = word_hashes(cps, start, end)
        n = self.known.find(a, b)
        while len(new := np.flatnonzero(n < 0)):
            _, first = np.unique(a[new], return_index=True)
            own = new[first]
            if self.known.n + len(own) > self.most:
                self.known.clear()
                n[:] = -1
                continue
            if self.pairs.n_states > self.pairs.most:
                self.pairs.reset()
            got = self.pairs.count([joined[s:e].encode("utf-8", "surrogatepass") for s, e in zip(start[own].tolist(), end[own].tolist())])
            self.known.add(a[own], b[own], got.astype(np.int32))
            n[new] = self.known.find(a[new], b[new])
        total = np.concatenate([[0], np.cumsum(n)])
        each = np.diff(total[np.searchsorted(start, stop)], prepend=0)
        np.add.at(extra, np.asarray(owner), each)
        return extra


_open: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text, and whether they pass ``limit``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _open.get(tokenizer) or _open.setdefault(tokenizer, TokenCounter(tokenizer))
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            n = np.concatenate([np.zeros(0, np.int64), *(counter.counts(texts[s]) for s in slices(texts, 1 << 20))])
            yield pdf[["doc_id", "no_id", "n_bytes"]].assign(n_tokens=n, over_limit=n > limit)

    common.ship(docs.sparkSession)
    cols = common.marked(docs, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return common.unmarked(cols.mapInPandas(run, "doc_id long, no_id boolean, n_bytes long, n_tokens long, over_limit boolean"))
