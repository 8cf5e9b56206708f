"""Exact, batched tokenization with the tokenizers library.

A byte-pair tokenizer encodes each pre-token by itself. So a batch of texts is
cut into pre-tokens with array operations on code points, every distinct
pre-token is encoded once by the library, and its ids are looked up for all
other places; where asked, short pre-tokens are merged many at a time in arrays
instead, by the tokenizer's own merges. Texts for which this doesn't hold (they contain an added token's
string) go through the library whole. Tests compare with the library.

The table of known pre-tokens is bounded: it is emptied when it is full.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, NUMBER, OTHER, END = 0, 1, 2, 3, 4
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    global _classes
    if _classes is None:
        kind = np.full(0x110000, OTHER, np.uint8)
        first = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
        kind[first == ord("L")], kind[first == ord("N")] = LETTER, NUMBER
        kind[_WHITE] = SPACE
        _classes = kind
    return _classes


_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BASE = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_power: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    global _power
    if not _power or len(_power[0][0]) < n:
        made = []
        for base in _BASE:
            inverse = pow(base, -1, 1 << 64)
            pair = []
            for b in (base, inverse):
                p = np.full(max(n, 1 << 18), np.uint64(b))
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            made.append((pair[0], pair[1]))
        _power = made
    return _power


def word_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run ``cps[start:end]`` (from prefix sums; with
    both, a clash among a billion runs has odds under 1e-19)."""
    n = len(cps)
    out = []
    for (up, down), mult in zip(_powers(n), _MULT):
        h = cps.astype(np.uint64) + np.uint64(1)
        h *= mult
        h ^= h >> np.uint64(29)
        h *= mult
        h *= up[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h, out=total[1:])
        x = (total[end] - total[start]) * down[start]
        x ^= (end - start).astype(np.uint64) * mult
        x ^= x >> np.uint64(32)
        x *= mult
        x ^= x >> np.uint64(29)
        out.append(x)
    return out[0], out[1]


class HashTable:
    """Open addressing over 128-bit keys with array operations."""

    def __init__(self, bits: int = 16) -> None:
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.mask, self.n = np.uint64((1 << bits) - 1), 0
        self.k1, self.k2 = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it isn't known."""
        slot = (a & self.mask).astype(np.int64)
        got = self.value[slot]
        left = np.flatnonzero((got >= 0) & ((self.k1[slot] != a) | (self.k2[slot] != b)))
        slot = slot[left]
        mask = int(self.mask)
        while len(left):
            slot = (slot + 1) & mask
            v = self.value[slot]
            got[left] = v
            more = (v >= 0) & ((self.k1[slot] != a[left]) | (self.k2[slot] != b[left]))
            left, slot = left[more], slot[more]
        return got

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        """Insert distinct keys that aren't known yet."""
        while (self.n + len(a)) * 2 > len(self.value):
            was = self.value >= 0
            old = self.k1[was], self.k2[was], self.value[was]
            self.clear(len(self.value).bit_length())
            self._put(*old)
        self._put(a, b, value)

    def _put(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        self.n += len(a)
        mask = int(self.mask)
        slot = (a & self.mask).astype(np.int64)
        left = np.arange(len(a))
        while len(left):
            s = slot[left]
            free = self.value[s] < 0
            took = left[free]
            self.value[s[free]] = value[took]
            won = np.zeros(len(left), bool)
            won[free] = self.value[s[free]] == value[took]
            w = left[won]
            self.k1[slot[w]], self.k2[slot[w]] = a[w], b[w]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask


def runs_byte(cps: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the byte-level pattern (contractions, runs of letters,
    numbers or others, each with one space before it, and white space) in code
    points whose documents are each closed by one code point of kind END."""
    n = len(cps)
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    white = kind == SPACE
    nxt = np.append(kind[1:], np.uint8(END))
    # the last of a run of white space before anything else but the end stands apart, and a plain space joins what follows
    last = white & (nxt != SPACE) & (nxt != END)
    at = np.flatnonzero(last)
    cut[at] = True
    cut[at[cps[at] == 32] + 1] = False
    _contractions(cps, kind, cut, spaced=True)
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)
    keep = kind[start] != END
    return start[keep], end[keep]


def runs_word(cps: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the lower-case word pattern: contractions, runs of letters,
    single numbers, runs of others; white space falls away."""
    n = len(cps)
    cut = np.ones(n + 1, bool)
    cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    _contractions(cps, kind, cut, spaced=False)
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)
    keep = (kind[start] != END) & (kind[start] != SPACE)
    return start[keep], end[keep]


def _contractions(cps: np.ndarray, kind: np.ndarray, cut: np.ndarray, spaced: bool) -> None:
    """'s 't 'm 'd 're 've 'll where a pre-token begins at the apostrophe."""
    at = np.flatnonzero(cps == 39)
    at = at[cut[at] & cut[at + 1]]
    if spaced:
        at = at[(at == 0) | (cps[np.maximum(at, 1) - 1] != 32)]
    if not len(at):
        return
    pad = np.concatenate([cps, np.zeros(3, cps.dtype)])
    a, b = pad[at + 1], pad[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for hit, size in ((one, 2), (two & ~one, 3)):
        p = at[hit]
        cut[p + 1] = False
        cut[p + size] = True


def _byte_chars() -> dict[int, str]:
    """The characters by which a byte-level vocabulary shows the bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


class Merges:
    """Byte-pair merges of many short words at a time. Each round merges
    one pair in every word, that of the lowest rank and leftmost of these, as
    the library does."""

    LONGEST = 30
    _NEVER = np.int32(1 << 25)

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = [_BYTE_CHARS[b] for b in range(256)]
        #: One more than the id of a byte inside a word and at its end; 0 where there is none.
        self.inner = np.array([vocab.get(c, -1) + 1 for c in shown], np.int32)
        self.final = np.array([vocab.get(c + suffix, -1) + 1 for c in shown], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[x] + 1) << 17 | (vocab[y] + 1) for x, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] + 1 for x, y in pairs], np.int32)
        bits = (4 * len(key)).bit_length()
        self.mask, self.shift = (1 << bits) - 1, np.int64(64 - bits)
        self.key, self.rank = np.zeros(1 << bits, np.int64), np.full(1 << bits, self._NEVER, np.int32)
        where, left = self._slot(key), np.arange(len(key))
        while len(left):  # linear probing; of keys that want one slot the first gets it
            s = where[left]
            free = np.flatnonzero(self.key[s] == 0)
            _, first = np.unique(s[free], return_index=True)
            won = free[first]
            self.key[s[won]], self.rank[s[won]] = key[left[won]], left[won]
            left = np.delete(left, won)
            where[left] = np.where(self.key[where[left]] == 0, where[left], (where[left] + 1) & self.mask)

    @classmethod
    def of(cls, model: dict) -> Merges | None:
        """None for a model with rules that aren't followed here."""
        odd = ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        return None if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in odd) else cls(model)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.view(np.uint64) * _MULT[0]
        return (h >> self.shift.astype(np.uint64)).astype(np.int64)

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NEVER where it isn't merged; 0 is no id."""
        key = x.astype(np.int64)
        key <<= 17
        key |= y
        at = self._slot(key)
        held = self.key.take(at)
        out = np.where(held == key, self.rank.take(at), self._NEVER)
        left = np.flatnonzero((held != key) & (held != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held, want = self.key[at], key[left]
            hit = held == want
            out[left[hit]] = self.rank[at[hit]]
            more = ~hit & (held != 0)
            left, at = left[more], at[more]
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words ``data[start : start + size]`` (UTF-8 of 1 to LONGEST
        bytes), one after another, and how many each has; 0 of a word with a byte
        that the vocabulary lacks."""
        n, longest = len(start), int(size.max())
        place = np.arange(longest + 1, dtype=np.int32)[:, None]
        # a row for each place in the words, and one behind the last
        inside = place < size.astype(np.int32)
        chars = data.take(np.minimum(start + place, len(data) - 1))
        sym = np.where(inside, self.inner[chars], 0)
        last = (size - 1) * n + np.arange(n)
        sym.ravel()[last] = self.final[chars.ravel()[last]]
        sym[:, (inside & (sym == 0)).any(axis=0)] = 0
        after, before = np.repeat(place + 1, n, axis=1), np.repeat(place - 1, n, axis=1)
        # the rank of the pair that begins at a place, and the place: the least is merged next
        pair = np.full(sym.shape, self._NEVER << 5, np.int32)
        both = sym[1:] > 0
        pair[:-1][both] = self.ranks(sym[:-1][both], sym[1:][both]) << 5
        pair |= place
        flat, next_, prior, best = sym.ravel(), after.ravel(), before.ravel(), pair.ravel()
        while True:
            least = pair.min(axis=0)
            word = np.flatnonzero(least < self._NEVER << 5)
            if not len(word):
                break
            least = least[word]
            left = least & 31
            at = left * n + word
            gone = next_[at] * n + word
            right = next_[gone]
            beyond = right * n + word
            new = self.made[least >> 5]
            flat[at], flat[gone], best[gone] = new, 0, self._NEVER << 5
            next_[at], prior[beyond] = right, left
            best[at] = self.ranks(new, flat[beyond]) << 5 | left
            ahead = prior[at]
            has = np.flatnonzero(ahead >= 0)
            ahead, word = ahead[has], word[has]
            at = ahead * n + word
            best[at] = self.ranks(flat[at], new[has]) << 5 | ahead
        words = np.ascontiguousarray(sym.T)
        there = words > 0
        return (words[there] - 1).astype(np.uint16), there.sum(axis=1)


class WordTokenizer:
    """``batch(texts)`` gives the ids of all texts, one after another, and the
    number of ids of each, as the library's ``encode`` would give them."""

    def __init__(self, path: str, most_words: int = 1_500_000, merged: bool = False) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = spec["model"].get("end_of_word_suffix") == "</w>"
        self.most = most_words
        self.known = HashTable()
        self.merges = Merges.of(spec["model"]) if merged else None
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.offset = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint16)
        self.n_words = self.n_ids = 0

    def normalized(self, text: str) -> str:
        if self.words:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
        return text

    def _encoded(self, joined: str, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens, one after another, and how many each has."""
        size, parts, groups = np.zeros(len(start), np.int32), [np.zeros(0, np.uint16)], []
        if self.merges is not None:
            data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
            first, length = start, end - start
            if len(data) > len(cps):
                at = np.zeros(len(cps) + 1, np.int64)
                width = np.ones(len(cps), np.uint8)
                for least in (0x80, 0x800, 0x10000):
                    width += cps >= least
                np.cumsum(width, out=at[1:])
                first, length = at[start], at[end] - at[start]
            for part in (np.flatnonzero(length <= 9), np.flatnonzero((length > 9) & (length <= Merges.LONGEST))):
                if len(part):
                    got, size[part] = self.merges.encode(data, first[part], length[part])
                    parts.append(got)
                    groups.append(part[size[part] > 0])
        rest = np.flatnonzero(size == 0)
        if len(rest):
            tokenize, shown = self.library.model.tokenize, _BYTE_CHARS
            words = [joined[s:e] for s, e in zip(start[rest].tolist(), end[rest].tolist())]
            seen = [w.replace(" ", "\u0120") if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(shown) for w in words]
            got = [[t.id for t in tokenize(w)] for w in seen]
            size[rest] = np.fromiter(map(len, got), np.int32, len(got))
            parts.append(np.fromiter((x for ids in got for x in ids), np.uint16, int(size[rest].sum())))
        if not groups:
            return parts[-1], size
        # by groups so far: back to the words' order
        order, ids = np.concatenate([*groups, rest]), np.concatenate(parts)
        n = size[order]
        at = np.zeros(len(start), np.int64)
        at[order] = np.cumsum(n) - n
        where = np.repeat(at - (np.cumsum(size) - size), size)
        where += np.arange(len(ids))
        return ids[where], size

    def _learn(self, joined: str, cps: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        flat, size = self._encoded(joined, cps, start, end)
        for name, need in (("offset", self.n_words + len(size)), ("size", self.n_words + len(size)), ("ids", self.n_ids + len(flat))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        w = slice(self.n_words, self.n_words + len(size))
        self.offset[w] = self.n_ids + np.cumsum(size) - size
        self.size[w] = size
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.known.add(a, b, np.arange(self.n_words, self.n_words + len(size), dtype=np.int32))
        self.n_words += len(size)
        self.n_ids += len(flat)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        ids, count = self._plain(plain)
        if odd:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in odd:
                parts[i] = np.asarray(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint16)
                count[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, count

    def segments(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The joined normal text, start and end of each pre-token in it, and
        where each document ends in the list of pre-tokens."""
        normal = [self.normalized(t) for t in texts]
        joined = "\0".join(normal) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, normal), np.int64, len(normal))
        stop = np.cumsum(length + 1) - 1
        kind = char_classes()[cps]
        kind[stop] = END
        start, end = (runs_word if self.words else runs_byte)(cps, kind)
        return joined, cps, start, end, np.searchsorted(start, stop)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        joined, cps, start, end, upto = self.segments(texts)
        a, b = word_hashes(cps, start, end)
        at = self.known.find(a, b)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, first = np.unique(a[new], return_index=True)
            if self.n_words + len(first) > self.most:
                self._reset()
                new = np.arange(len(a))
                _, first = np.unique(a, return_index=True)
            first = new[first]
            self._learn(joined, cps, start[first], end[first], a[first], b[first])
            at[new] = self.known.find(a[new], b[new])
            left = np.flatnonzero(at < 0)  # equal first, other second hash
            for i in left.tolist():
                if self.known.find(a[i : i + 1], b[i : i + 1])[0] < 0:
                    self._learn(joined, cps, start[i : i + 1], end[i : i + 1], a[i : i + 1], b[i : i + 1])
            at[left] = self.known.find(a[left], b[left])
        size = self.size[at]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        where = np.repeat(self.offset[at] - total[:-1], size)
        where += np.arange(total[-1])
        count = np.diff(total[upto], prepend=0)
        return self.ids[where], count


_open: dict[tuple[str, bool], WordTokenizer] = {}


def open_tokenizer(path: str, merged: bool = False) -> WordTokenizer:
    """One per Python worker and file; it stays for the worker's next tasks."""
    if (path, merged) not in _open:
        _open[path, merged] = WordTokenizer(path, merged=merged)
    return _open[path, merged]


def slices(texts: list[str], most_chars: int = 1 << 18) -> list[slice]:
    """Cut a list of texts so that each part holds few characters, or one text."""
    out, i, n = [], 0, 0
    for j, t in enumerate(texts):
        if n and n + len(t) > most_chars:
            out.append(slice(i, j))
            i, n = j, 0
        n += len(t) + 1
    if len(texts) > i:
        out.append(slice(i, len(texts)))
    return out
