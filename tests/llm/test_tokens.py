"""Tokenizers, transducers, id files, pieces and packing against the libraries
and brute force, with nulls, empty and long texts, repeated rows and extra columns."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from plumbline.llm import idfile, langid, media, neardup, packing, segment, sharding, transducer, wordtok  # noqa: E402

ODD = [
    "", " ", "  ", "it's  don't 'tis we've they'll ''s 'RE x's't  \n\n 's \n's a\n", "ΣΑΣ Σ İstanbul é ﬁ ½ ²3 12", " x  y　", "a\0b", "'", "x'", "x're", "x'r", "x'l l",
    "a<|endoftext|> b <|startoftext|>", "漢字 ひらがな 👩‍👩‍👧 ü", "\x1c\x1d a\x85b", "O'Reilly'll'd've", "word " * 3000, "x" * 5000, "ab́c",
]
BYTE, WORD, PIECE = pt.path("byte_bpe_50k.json"), pt.path("word_bpe_49k.json"), pt.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, i % 2) for i, t in enumerate(ODD)] + [(100, None, 0), (3, ODD[3], 1), (None, "no id", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_tables_equal_the_library(path):
    tok, want = wordtok.WordTokenizer(path, most_words=40), library(path)  # small, so the table is emptied now and then
    for group in ([t] for t in ODD):
        ids, n = tok.batch(group)
        assert ids.tolist() == want(group[0]) and n.tolist() == [len(ids)]
    ids, n = tok.batch(ODD)
    assert ids.tolist() == [i for t in ODD for i in want(t)] and n.tolist() == [len(want(t)) for t in ODD]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_merged_words_equal_the_library(path):
    rng, want = np.random.default_rng(3), library(path)
    letters = list("aabcdeinorst'.,-0129 ") + list("äßéñ漢👩") + [" the", "ing", "\n"]
    texts = ODD + ["".join(rng.choice(letters, size=rng.integers(1, 60))) for _ in range(400)] + ["a" * n for n in range(70)] + ["é" * n + " \t" * n for n in range(20)]
    tok = wordtok.WordTokenizer(path, most_words=500, merged=True)
    for group in (texts, *([t] for t in texts)):
        ids, n = tok.batch(group)
        assert ids.tolist() == [i for t in group for i in want(t)] and n.tolist() == [len(want(t)) for t in group]


def test_op4_encodes_short_words_without_the_library():
    want = library(BYTE)
    tok = wordtok.open_tokenizer(BYTE, merged=True)
    known, tok.library = tok.library, None  # any call would raise
    try:
        text = "Unheard-of wörds: " + " ".join(f"q{i}zéx" for i in range(3000))
        assert tok.batch([text])[0].tolist() == want(text)
    finally:
        tok.library = known


def test_transducer_counts_equal_the_library(spark, odd_docs, none, sf_dir):
    want = library(WORD)
    got = transducer.token_counts(odd_docs, WORD).toPandas()
    texts = ODD + ["", ODD[3], "no id"]
    assert got["n_tokens"].tolist() == [len(want(t)) for t in texts]
    assert got["n_bytes"].tolist() == [len(t.encode()) for t in texts] and got["over_limit"].tolist() == [len(want(t)) > 2048 for t in texts]
    assert transducer.token_counts(none, WORD).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert transducer.TokenCounter(WORD).counts(docs["text"].tolist()).tolist() == [len(want(t)) for t in docs["text"]]


def test_chunk_maps_compose_to_a_plain_run():
    pre = transducer.PreTokens()
    rng = np.random.default_rng(1)
    cls = rng.integers(0, 9, 5 * transducer.CHUNK + 17).astype(np.uint8)
    state, want = 0, []
    for c in cls:
        want.append(state)
        state = int(pre.to[state, c])
    assert pre.states(cls).tolist() == want


def test_blocks_are_encoded_without_stepping_through_the_model(monkeypatch):
    k = np.arange(20011)
    ids = np.where(k % 7 == 0, 65535 - k % 5, k * k % 977 * (1 + k // 3000)).astype(np.uint16)
    sizes = idfile._block_sizes(len(ids))
    ragged = np.array([300, 300, 65, 64, 63, 1])
    with monkeypatch.context() as m:
        m.setattr(idfile, "_Model", None)  # any use would raise
        blocks, odd = idfile.encode_blocks(ids, sizes), idfile.encode_blocks(ids[: ragged.sum()], ragged)
        m.setattr(idfile, "LANES", 2)  # many blocks are encoded in groups
        assert idfile.encode_blocks(ids, sizes) == blocks
    assert zlib.crc32(b"".join(blocks)) == 979628838  # as the step by step encoder wrote them
    assert (idfile.decode_blocks(blocks, sizes) == ids).all()
    assert (idfile.decode_blocks(odd, ragged) == ids[: ragged.sum()]).all()


def test_blocks_round_trip_and_checksums(tmp_path):
    rng = np.random.default_rng(0)
    for ids in (np.zeros(9000, np.uint16), rng.integers(0, 65535, 5001).astype(np.uint16), np.array([2], np.uint16), np.tile(np.arange(50, dtype=np.uint16), 200)):
        sizes = idfile._block_sizes(len(ids))
        blocks = idfile.encode_blocks(ids, sizes)
        assert (idfile.decode_blocks(blocks, sizes) == ids).all()
        # each block stands alone
        assert (idfile.decode_blocks(blocks[-1:], sizes[-1:]) == ids[-sizes[-1] :]).all()
    p = tmp_path / "x.ids"
    with open(p, "wb") as f:
        f.write(idfile.MAGIC)
        idfile.write_segment(f, [None, 7], np.array([3, 4]), np.arange(7, dtype=np.uint16))
    assert [x.tolist() if hasattr(x, "tolist") else x for x in next(idfile.read_segments(str(p)))] == [[None, 7], [3, 4], list(range(7))]
    data = bytearray(p.read_bytes())
    data[-3] ^= 1
    p.write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        list(idfile.read_segments(str(p)))


def test_segments_of_several_files_are_decoded_in_step(tmp_path):
    segments, want = [], []
    for i, n in enumerate((9000, 1, 4097, 300)):
        ids = (np.arange(n) * (i + 3) % 701).astype(np.uint16)
        with open(tmp_path / f"{i}.ids", "wb") as f:
            f.write(idfile.MAGIC)
            idfile.write_segment(f, [i], np.array([n]), ids)
        segments += idfile._segments(str(tmp_path / f"{i}.ids"))
        want.append(ids.tolist())
    assert [x.tolist() for x in idfile._decoded(segments)] == want


def test_repeated_ids_are_coded_small():
    ids = np.tile(np.arange(64, dtype=np.uint16), 64)
    assert len(idfile.encode_blocks(ids, np.array([len(ids)]))[0]) < len(ids) // 4


def test_id_files_hold_every_document_in_order(odd_docs, none):
    want = library(BYTE)
    got = idfile.round_trip(odd_docs, BYTE).toPandas().sort_values("start")
    order = sorted(zip([*range(len(ODD)), 100, 3, None], [*ODD, "", ODD[3], "no id"]), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc, text), r in zip(order, got.itertuples(index=False), strict=True):
        ids = np.array([*want(text), 2], "<u4")
        assert (doc is None and np.isnan(r.doc_id)) or doc == r.doc_id
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert idfile.round_trip(none, BYTE).count() == 0


def brute_paths(pieces, text, n):
    index = {t: i for i, t in enumerate(pieces.text) if not (pieces.sp.is_byte(i) or pieces.sp.is_unknown(i) or pieces.sp.is_control(i))}

    def paths(i):
        if i == len(text):
            yield 0.0
        for j in range(i + 1, min(len(text), i + 16) + 1):
            if text[i:j] in index:
                yield from (pieces.score[index[text[i:j]]] + x for x in paths(j))
        if i < len(text) and text[i] not in index:
            yield from (pieces.score[pieces.unknown] + x for x in paths(i + 1))

    return sorted(paths(0), reverse=True)[:n]


def test_n_best_equals_all_paths_and_decodes(odd_docs, none):
    seg = segment.Segmenter(PIECE, 4, most_parts=50)
    texts = ["hello world", "th wh\tit\x00e", "", "a", "ñllaes  x", "漢字かな ok", "▁▁x", "éàü\n"]
    for t, paths in zip(texts, seg.best(texts)):
        norm = seg.pieces.sp.normalize(t) if t else ""
        assert np.allclose([s for s, _, _ in paths], brute_paths(seg.pieces, norm, 4))
        assert len({tuple(i.tolist()) for _, i, _ in paths}) == len(paths)
        assert all(ok and seg.pieces.decoded(i.tolist()) == norm for _, i, ok in paths)
    got = segment.n_best(odd_docs, PIECE, keep_ids=True).toPandas()
    assert got["round_trip"].all() and (got[got["rank"] == 1].groupby("doc_id").size().drop(3) == 1).all()
    assert segment.n_best(none, PIECE).count() == 0


def fewest_bins(lengths, capacity):
    """By trying every assignment."""
    for k in range(1, len(lengths) + 1):
        for a in itertools.product(range(k), repeat=len(lengths)):
            if all(sum(x for x, b in zip(lengths, a) if b == i) <= capacity for i in range(k)):
                return k
    return 0


def test_dual_feasible_bounds_never_pass_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = rng.integers(1, 13, rng.integers(1, 7))
        best = fewest_bins(x.tolist(), 12)
        at, offset, room = packing.best_fit_decreasing(x, 12)
        assert packing.dual_feasible_bound(x, 12) <= best <= len(room)
        assert all(x[at == b].sum() + room[b] == 12 for b in range(len(room)))
    assert packing.dual_feasible_bound(np.array([7, 7, 7]), 12) == 3  # the plain sum says 2


def test_packing_stops_at_the_bound(spark):
    docs = spark.createDataFrame([(i, "word " * 300) for i in range(10)], "doc_id long, text string")  # no two fit together
    got = packing.pack(docs, WORD, capacity=512, part_pieces=5)
    assert packing.certificate(got, 512) == (10, 10)
    assert got.where("sequence_id >= 1L << 56").count() == 0  # nothing is left to exchange


def test_certificates_decide_what_is_exchanged(spark):
    room = np.array([5, 5, 5, 5])  # four pieces of 7 in sequences of 12
    assert packing.dual_feasible_bound(np.full(4, 7), 12) == 4
    assert packing.releasable(room, 4, 28, 12).sum() == 3  # certified: what rounding may hide, under one sequence
    assert packing.releasable(room, 3, 28, 12).sum() == 4  # by the plain sum one could be saved: all go
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 200, 3000))], "doc_id long, text string")
    got, proofs = packing.certified(docs, WORD, capacity=256, part_pieces=200)
    p = proofs.toPandas()
    assert (p["bins"] >= p["bound"]).all() and p["round"].max() > 0 and not p[["round", "part"]].duplicated().any()
    bins, bound = packing.certificate(got, 256)
    assert p["kept_bins"].sum() == bins <= bound + p["round"].eq(0).sum()


def test_packing_places_every_token_once(odd_docs, none):
    want = library(WORD)
    got = packing.pack(odd_docs, WORD, capacity=512, part_pieces=5).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 512
    for doc, text in [*enumerate(ODD), (100, "")]:
        ids = np.array([*want(text), 1], "<u4")
        copies = 2 if doc == 3 else 1
        own = got[got["doc_id"] == doc]
        pieces = [(k, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
        assert sorted(map(tuple, own[["piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(pieces * copies)
    total = got["length"].sum()
    assert got["sequence_id"].nunique() <= -(-total // 512) + 1
    assert packing.pack(none, WORD).count() == 0


def test_large_ids_stay_exact_beside_null_ids(spark):
    big = [(1 << 60) + 1, (1 << 60) + 3]
    docs = spark.createDataFrame([(big[0], "one text"), (None, "no id"), (big[1], "another text")], "doc_id long, text string").coalesce(1)
    runs = {
        "media": media.media(docs), "files": idfile.round_trip(docs, BYTE), "near": neardup.near_duplicates(docs), "pieces": segment.n_best(docs, PIECE),
        "packing": packing.pack(docs, WORD), "counts": transducer.token_counts(docs, WORD), "language": langid.language(docs.withColumn("lang", F.lit("en"))), "shards": sharding.shard(docs),
    }
    for name, df in runs.items():
        assert {r["doc_id"] for r in df.select("doc_id").distinct().collect()} == {*big, None}, name
