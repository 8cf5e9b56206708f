"""Media columns: texts as 8-bit audio, and fingerprints of spectral peaks.

A text's UTF-8 bytes, closed by zero bytes up to a positive multiple of 64, are
the unsigned 8-bit samples of a mono WAV file. The samples are read back from
that file by the wave module; a short-time Fourier transform gives their power
by time and frequency; cells that are the largest of their neighbourhood and
over their frame's mean are peaks; each peak is paired with the next few. A
pair is one long: frame of the first peak << 32, then both frequencies and the
frames between them. The array of a text's pairs, in time order, is its
fingerprint.

Null texts are empty ones (64 zero bytes, no peaks). Equal texts have equal
values: every frame is transformed by itself. Long texts are transformed in
runs of frames that overlap by the neighbourhood, so memory is bounded by the
text itself. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

FRAME, HOP, REACH_T, REACH_F, FAN_OUT, FAR, RATE = 512, 256, 4, 12, 3, 63, 8000
_WINDOW = np.hanning(FRAME).astype(np.float32)
COLUMNS = "doc_id long, no_id boolean, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_peaks long, fingerprint array<long>"


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getsampwidth() != 1 or r.getnchannels() != 1:
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def n_frames(samples: int) -> int:
    return max(1, -(-(samples - FRAME) // HOP) + 1)


def power(samples: np.ndarray, first: int, stop: int) -> np.ndarray:
    """Power of the frames ``first`` to ``stop`` of one text, without frequency 0."""
    part = samples[first * HOP : (stop - 1) * HOP + FRAME].astype(np.float32) - 128
    need = (stop - first - 1) * HOP + FRAME
    if len(part) < need:
        part = np.concatenate([part, np.zeros(need - len(part), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW
    z = np.fft.rfft(frames, axis=1)[:, 1:]
    return z.real * z.real + z.imag * z.imag


def largest(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Moving maximum over 2 * reach + 1 cells along an axis, edges cut off."""
    width, n = 2 * reach + 1, x.shape[axis]
    shape = list(x.shape)
    shape[axis] = n + 2 * reach
    y = np.zeros(shape, x.dtype)
    cut = lambda a, b: tuple(slice(a, b) if d == axis else slice(None) for d in range(x.ndim))
    y[cut(reach, reach + n)] = x
    have = 1
    while have < width:
        step = min(have, width - have)
        m = y.shape[axis]
        y = np.maximum(y[cut(0, m - step)], y[cut(step, m)])
        have += step
    return y


def peaks(spectrum: np.ndarray) -> np.ndarray:
    """Cells (time, frequency) that are largest around and over their frame's mean."""
    top = largest(largest(spectrum, REACH_F, 1), REACH_T, 0)
    return (spectrum >= top) & (spectrum > spectrum.mean(axis=1, keepdims=True))


def pairs(t: np.ndarray, f: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of peaks of the same text, and each one's text."""
    given = np.zeros(len(t), np.int64)
    codes, owner = [], []
    for k in range(1, min(2 * FAN_OUT, len(t) - 1) + 1):
        dt = t[k:] - t[:-k]
        ok = np.flatnonzero((text[k:] == text[:-k]) & (dt >= 1) & (dt <= FAR) & (given[:-k] < FAN_OUT))
        given[ok] += 1
        codes.append((t[ok] << 32) | (f[ok] << 15) | (f[ok + k] << 6) | dt[ok])
        owner.append(text[ok])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, own = np.concatenate(codes), np.concatenate(owner)
    order = np.lexsort((code, own))
    return code[order], own[order]


def fingerprints(payloads: list[bytes], most_frames: int = 6000) -> tuple[list[np.ndarray], np.ndarray]:
    """Each payload's pair codes and number of peaks; many short payloads are
    filtered together, apart by empty frames, and long ones in runs."""
    t_all, f_all, own_all = [], [], []
    blocks: list[tuple[int, int, int, np.ndarray, int]] = []  # text, first frame, frames of lead, power, frames that count
    height = 0

    def flush() -> None:
        nonlocal blocks, height
        if not blocks:
            return
        gap = np.zeros((REACH_T, FRAME // 2), np.float32)
        whole = np.concatenate([x for b in blocks for x in (b[3], gap)])
        t, f = np.nonzero(peaks(whole))
        at = np.cumsum([0] + [len(b[3]) + REACH_T for b in blocks])
        which = np.searchsorted(at, t, "right") - 1
        first, lead, count, own = (np.array(x) for x in zip(*((b[1], b[2], b[4], b[0]) for b in blocks)))
        local = t - at[which]
        ok = (local >= lead[which]) & (local < lead[which] + count[which])
        t_all.append((local - lead[which] + first[which])[ok])
        f_all.append(f[ok])
        own_all.append(own[which[ok]])
        blocks, height = [], 0

    for i, data in enumerate(payloads):
        samples = np.frombuffer(data, np.uint8)
        n = n_frames(len(samples))
        for a in range(0, n, most_frames):
            b = min(n, a + most_frames)
            lo, hi = max(0, a - REACH_T), min(n, b + REACH_T)
            blocks.append((i, a, a - lo, power(samples, lo, hi), b - a))
            height += hi - lo + REACH_T
            if height >= most_frames:
                flush()
    flush()
    if not t_all:
        return [], np.zeros(0, np.int64)
    t, f, own = (np.concatenate(x).astype(np.int64) for x in (t_all, f_all, own_all))
    code, whose = pairs(t, f, own)
    upto = np.searchsorted(whose, np.arange(len(payloads) + 1))
    return [code[a:b] for a, b in zip(upto[:-1], upto[1:])], np.bincount(own, minlength=len(payloads))


def media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per document: facts of the payload read back and of the stored
    file, the fingerprint and its digest; with ``keep_media`` the file itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                raw = [b"" if x is None else bytes(x) for x in part["raw"]]
                files = [to_wav(padded(x)) for x in raw]
                back = [from_wav(x) for x in files]
                codes, n_peaks = fingerprints(back)
                out = part[["doc_id", "no_id"]].reset_index(drop=True)
                out["n_bytes"] = [len(x) for x in raw]
                out["payload_bytes"] = [len(x) for x in back]
                out["payload_sha256"] = [hashlib.sha256(x).hexdigest() for x in back]
                out["tail_crc32"] = [zlib.crc32(x[-64:]) for x in back]
                out["media_bytes"] = [len(x) for x in files]
                out["media_sha256"] = [hashlib.sha256(x).hexdigest() for x in files]
                out["feature"] = [f"{len(c)}:{zlib.crc32(c.astype('<i8').tobytes()):08x}" for c in codes]
                out["n_peaks"] = n_peaks
                out["fingerprint"] = codes
                if keep_media:
                    out["media"] = files
                yield out

    common.ship(docs.sparkSession)
    return common.unmarked(common.marked(docs, common.text_bytes().alias("raw")).mapInPandas(run, COLUMNS + (", media binary" if keep_media else "")))
