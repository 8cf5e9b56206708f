"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed
length; each filter's largest value over the window goes to a softmax layer.
Training (Adam on windows of a bounded sample of labelled texts) runs on the
driver. For a prediction a whole text is cut into windows; their log
probabilities are averaged by length.

``lang_pred`` is the language of the largest mean, ``score`` its share of
exp(mean). A text that is null or has no letter is ``und`` with score 0; so is
every text when nothing labelled could be learned from. Null ids are no
training rows. Over 500 languages are an error (``most_langs``). Repeated rows give repeated rows; an empty table gives none;
other columns are ignored. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 6
#: Bound of the training sample: documents a language, and windows a document.
TRAIN_DOCS, TRAIN_WINDOWS = 1500, 4


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray  # 257 x DIM; row 256, for places after the end, stays 0
    conv: np.ndarray  # (max width * DIM) x (len(WIDTHS) * FILTERS), zero where a filter is narrower
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of neighbouring bytes adds to every filter, as its first
        and second and as its third and fourth place: the convolution in two look-ups."""
        if not hasattr(self, "_tables"):
            part = [self.embed @ self.conv[k * DIM : (k + 1) * DIM] for k in range(max(WIDTHS))]
            self._tables = tuple((part[k][:, None] + part[k + 1][None]).reshape(257 * 257, -1) for k in (0, 2))
        return self._tables

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of each filter over each window of byte codes."""
        n, span = len(windows), max(WIDTHS)
        first, second = self.tables()
        codes = np.concatenate([windows, np.full((n, span - 1), 256, windows.dtype)], axis=1).astype(np.int32)
        pair = codes[:, :-1] * 257 + codes[:, 1:]
        y = first.take(pair[:, :WINDOW], axis=0)
        y += second.take(pair[:, 2:], axis=0)
        return np.maximum(y.max(axis=1) + self.bias, 0)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(data: bytes) -> np.ndarray:
    """A text's bytes in rows of WINDOW, the last one closed with code 256."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.full(rows * WINDOW, 256, np.uint16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, WINDOW)


def train(windows: np.ndarray, label: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 3, steps: int = 900) -> ByteNet:
    """Fit by Adam on cross entropy, with at least ``steps`` steps; the same input
    gives the same network."""
    epochs = max(epochs, -(-steps * batch // max(1, len(windows))))
    rng = np.random.default_rng(seed)
    span, wide = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.zeros((span * DIM, wide), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    p = {
        "embed": rng.normal(0, 0.5, (257, DIM)), "conv": rng.normal(0, 0.3, (span * DIM, wide)) * mask, "bias": np.zeros(wide),
        "out": rng.normal(0, 0.2, (wide, len(langs))), "out_bias": np.zeros(len(langs)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][256] = 0
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            w, y = windows[pick], label[pick]
            n = len(pick)
            codes = np.concatenate([w, np.full((n, span - 1), 256, w.dtype)], axis=1)
            x = p["embed"][codes]
            cols = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), span * DIM, axis=1)[:, ::DIM])
            resp = (cols.reshape(n * WINDOW, -1) @ p["conv"]).reshape(n, WINDOW, wide)
            best = resp.argmax(axis=1)
            top = np.take_along_axis(resp, best[:, None], 1)[:, 0] + p["bias"]
            h = np.maximum(top, 0)
            z = h @ p["out"] + p["out_bias"]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(n), y] -= 1
            d /= n
            g = {"out": h.T @ d, "out_bias": d.sum(0)}
            dh = (d @ p["out"].T) * (top > 0)
            g["bias"] = dh.sum(0)
            # only the place of the largest response passes a gradient on
            patch = cols[np.arange(n)[:, None], best]  # n x wide x span*DIM
            g["conv"] = np.einsum("nf,nfk->kf", dh, patch) * mask
            back = dh[:, :, None] * p["conv"].T[None]
            ge = np.zeros_like(p["embed"])
            where = codes[np.arange(n)[:, None, None], best[:, :, None] + np.arange(span)]
            np.add.at(ge, where.ravel(), back.reshape(-1, DIM))
            ge[256] = 0
            g["embed"] = ge
            t += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return ByteNet(langs, **p)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, most_langs: int = 500) -> ByteNet | None:
    """A network from at most about ``train_docs`` documents of each language, and
    TRAIN_WINDOWS windows of each at places spread over its whole text. All languages
    are learned; over ``most_langs`` of them, more than a driver can train, are an error."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").count().limit(most_langs + 1).collect()
    if len(sizes) > most_langs:
        raise ValueError(f"there are over {most_langs} languages; give fit() a larger most_langs or documents of fewer languages")
    sizes.sort(key=lambda r: (-r["count"], r["lang"]))
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["count"]))]), F.col("lang"))
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    length = F.char_length("text")
    cuts = [F.substring("text", (1 + F.greatest(F.lit(0), length - WINDOW) * (k / max(1, TRAIN_WINDOWS - 1))).cast("int"), F.lit(WINDOW)) for k in range(TRAIN_WINDOWS)]
    got = rows.where(unit < share).select("doc_id", "lang", F.array_distinct(F.array(*cuts)).alias("cuts")).limit(2 * train_docs * len(sizes)).collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["cuts"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return None
    pairs = [(w, langs.index(r["lang"])) for r in got for c in r["cuts"] for w in windows_of(c.encode("utf-8", "replace")[:WINDOW])]
    return train(np.stack([w for w, _ in pairs]), np.array([y for _, y in pairs]), langs)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(net: ByteNet | None, texts: list[str | None], most_windows: int = 32) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if t and _has_letter(t)]
    if net is None or not some:
        return lang, score
    total = np.zeros((len(texts), len(net.langs)))
    weight = np.zeros(len(texts))
    rows, owner = [], []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if rows:
            w, own = np.concatenate(rows), np.concatenate(owner)
            for a in range(0, len(w), most_windows):
                part = w[a : a + most_windows]
                size = (part != 256).sum(axis=1)
                np.add.at(total, own[a : a + most_windows], net.log_probs(part) * size[:, None])
                np.add.at(weight, own[a : a + most_windows], size)
        rows.clear()
        owner.clear()
        waiting = 0

    for i in some:
        w = windows_of(texts[i].encode("utf-8", "surrogatepass"))
        rows.append(w)
        owner.append(np.full(len(w), i))
        waiting += len(w)
        if waiting >= 8 * most_windows:
            flush()
    flush()
    mean = total[some] / weight[some, None]
    best = mean.argmax(axis=1)
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    score[some] = p.max(axis=1) / p.sum(axis=1)
    for i, b in zip(some, best.tolist()):
        lang[i] = net.langs[b]
    return lang, score


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` added (columns of
    these names are replaced)."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*names)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lang, score = predict(net, b.column("text").cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    common.ship(docs.sparkSession)
    return base.mapInArrow(run, schema)


def language(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, then predict every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return identify(rows, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
