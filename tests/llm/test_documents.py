"""Media, shards, neighbours, quality, near-duplicates, language and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from plumbline.llm import graph, importance, langid, media, nearest, neardup, sharding  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(0, "", "en"), (1, None, None), (2, "a b c d", "en"), (3, "a b c d", "en"), (3, "a b c d", "en"), (4, "12 34", "en"), (5, "long text " * 5000, "de"), (None, "a b c d", "de")]
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, key int, Score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_media_is_lossless_and_alike_for_equal_texts(odd, none):
    got = media.media(odd, keep_media=True).toPandas()
    for r, text in zip(got.itertuples(), [t or "" for t in [x["text"] for x in odd.collect()]]):
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert media.from_wav(r.media) == payload and r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert list(r.fingerprint) == sorted(r.fingerprint)
    assert got["feature"][2] == got["feature"][3] == got["feature"][4] == got["feature"][7]
    assert media.media(none).count() == 0


def test_fingerprints_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    data = [rng.integers(0, 256, 64 * k, dtype=np.uint8).tobytes() for k in (1, 40, 700, 3)]
    together, _ = media.fingerprints(data)
    for d, codes in zip(data, together):
        alone, n = media.fingerprints([d], most_frames=37)  # in runs of few frames
        assert alone[0].tolist() == codes.tolist()
    assert sum(map(len, together)) > 20


def test_peaks_are_the_largest_around():
    x = np.random.default_rng(2).random((30, 60)).astype(np.float32)
    got = media.peaks(x)
    for t, f in itertools.product(range(30), range(60)):
        near = x[max(0, t - media.REACH_T) : t + media.REACH_T + 1, max(0, f - media.REACH_F) : f + media.REACH_F + 1]
        assert got[t, f] == (x[t, f] == near.max() and x[t, f] > x[t].mean())


def test_shards_are_even_gapless_and_keep_groups(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(i, "the same text " * 3) for i in range(3000, 5000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == 5000 and len(size) == 16 and size.max() <= 1.1 * size.mean() and size.min() >= 0.9 * size.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    text = dict(rows)
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples(index=False))
    small = got[got.groupby("text_crc32")["size"].transform("sum") <= 0.1 * size.mean()]
    assert len(small) > 2000 and (small.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert sharding.shard(odd).count() == 8 and sharding.shard(none).count() == 0


def test_neighbours_reach_recall_and_are_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, x[100].tolist()) for i in range(30)]  # copies of a query
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None, *[1.0] * 15]), (5004, [1.0]), (100, x[100].tolist()), (None, x[0].tolist())]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    ids = np.array([*range(1200), *range(2000, 2030)])
    v = np.concatenate([x, np.repeat(x[100:101], 30, 0)]).astype(np.float64)
    hit = n = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own["score"], [d[ids == i][0] for i in own["vec_id"]], rtol=1e-12)
        assert sorted(zip(own["score"], own["vec_id"])) == list(zip(own["score"], own["vec_id"]))
        hit, n = hit + len(set(want) & set(own["vec_id"])), n + 10
    assert hit / n >= 0.9
    assert got[got["query_id"] == 100]["vec_id"].tolist() == list(range(2000, 2010))


@pytest.mark.parametrize("index", [True, False])
def test_hot_buckets_and_no_index_are_measured_in_blocks(spark, monkeypatch, index):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "ASKS", 3)
    if not index:
        monkeypatch.setattr(nearest, "fit", lambda *a: None)
    x = np.random.default_rng(9).normal(size=(400, 3))
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, id int, v string")
    got = nearest.search(df, every=20, target=1.0).toPandas()
    hits = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & set(got[got["query_id"] == q]["vec_id"]))
    assert len(got) == 200 and hits >= (180 if index else 200)


def test_few_vectors_are_all_found(spark):
    t = "vec_id long, embedding array<float>"
    got = nearest.search(spark.createDataFrame([(0, [1.0, 0.0]), (7, [-90.0, 3.0]), (9, [0.0, 500.0])], t)).toPandas()
    assert got.sort_values("rank")["vec_id"].tolist() == [7, 9]
    assert nearest.search(spark.createDataFrame([], t)).count() == 0
    assert nearest.search(spark.createDataFrame([(0, [1.0])], t)).count() == 0


def components_by_pairs(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "ONE\ttwo"), (4, "one"), (5, "ÄB c d"), (6, "äb c d")]
    base = [rng.choices(words, k=rng.randint(5, 120)) for _ in range(25)]
    for i in range(10, 190):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=85).toPandas()
    want = components_by_pairs(docs, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.itertuples())


def test_near_duplicates_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).toPandas()
    own = {None if np.isnan(r.doc_id) else int(r.doc_id): r for r in got.itertuples()}
    assert len(got) == 8 and own[3].component_id == 2 and not own[3].kept and own[2].kept and own[0].kept and not own[None].kept
    assert neardup.near_duplicates(none).count() == 0


def test_near_copies_of_both_texts_of_one_id(spark):
    rng = random.Random(9)
    a, b, c = ([f"{k}{rng.randrange(500)}" for _ in range(80)] for k in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, ""), (2, near(a)), (3, near(b)), (4, " ".join(b)), (5, " ".join(c)), (6, near(c))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]


def test_near_duplicates_shuffle_no_text_without_a_partner(spark):
    rng = random.Random(12)
    hexes = lambda n: " ".join(f"{rng.randrange(1 << 32):08x}" for _ in range(n))
    docs = [(i, hexes(3000)) for i in range(120)]
    near = [hexes(200) for _ in range(3)]
    docs += [(1000 + i, f"{near[i % 3]} {i}") for i in range(12)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wrote = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
        began = wrote()
        got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=85).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved = wrote() - began
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i if i < 1000 else 1000 + (i - 1000) % 3 for i, _ in docs}
    assert moved < sum(len(t) for _, t in docs) / 2


def test_bitmap_keeps_all_ids_and_little_else(spark):
    ids = [-(2**63), -5, 0, 7, 2**62 + 1, *range(10_000, 12_000)]
    rows = spark.createDataFrame([(i, str(i)) for i in [*ids, *range(20_000, 40_000), 7]], "doc_id long, text string")
    got = neardup._maybe(rows, spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] in set(ids)) == sorted([*ids, 7]) and all(r["text"] == str(r["doc_id"]) for r in got)
    assert len(got) < len(ids) + 50
    assert neardup._maybe(rows, rows.where("false").select("doc_id")).count() == 0


def test_buckets_of_the_same_classes_are_held_once(spark):
    rows = [(b, d) for b, of in {1: (1, 2), 2: (1, 2), 3: (1, 2, 3), 4: (4, 5), 5: (1, 3), 6: (1, 2, 3)}.items() for d in of]
    many = spark.createDataFrame(rows, "bucket long, doc_id long")
    many = many.join(many.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")), "bucket").select("bucket", "doc_id", "n", "hub")
    got = neardup._distinct_buckets(many).collect()
    assert sorted((r["bucket"], r["doc_id"]) for r in got) == [(1, 1), (1, 2), (3, 1), (3, 2), (3, 3), (4, 4), (4, 5), (5, 1), (5, 3)]


def test_prune_bounds_follow_the_posterior():
    for n in (30, 150):
        m = neardup.least_matches(n, 0.8, 1e-6)
        draws = np.random.default_rng(0).beta(m, n - m + 2, 200_000)  # one match fewer
        assert 0 < m < 0.8 * n and (draws >= 0.8).mean() < 1e-4


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    from plumbline.llm import common

    got = graph.components(spark.createDataFrame(links, "left long, right long"), common.shared_dir(spark)).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(201)} | {(1000 + i, 1000) for i in range(300)}


def test_language_is_learned_from_other_rows(spark, odd, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.language(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    assert got["held_out"].tolist() == held and got["score"].between(0, 1).all()
    assert (got["lang_pred"] == got["lang"])[got["held_out"]].mean() > 0.9
    o = langid.language(odd).toPandas()
    assert o["lang_pred"].tolist()[:2] == ["und", "und"] and o["lang_pred"][5] == "und"
    assert langid.language(none).count() == 0
    assert langid.language(odd.withColumn("lang", F.lit(None).cast("string"))).toPandas()["lang_pred"].eq("und").all()


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(3 * i, "some text", f"l{i % 4}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 3 languages"):
        langid.fit(docs, most_langs=3)


def test_convolution_by_tables_equals_the_direct_sum():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint16)
    w[3, 50:] = 256
    net = langid.train(w, rng.integers(0, 2, 40), ["a", "b"], epochs=1, steps=1)
    got = net.pooled(w)
    for i in (0, 3, 17):
        x = net.embed[np.concatenate([w[i], [256, 256, 256]])]
        direct = np.stack([np.concatenate(x[t : t + 4]) @ net.conv for t in range(langid.WINDOW)]).max(0)
        assert np.allclose(got[i], np.maximum(direct + net.bias, 0), atol=1e-4)


def test_resampling_keeps_exactly_k_by_brute_force(spark, odd, none, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = importance.resample(docs, labels).toPandas()
    lab = labels.toPandas()
    k = importance.sample_size(len(got), (lab["quality"] == 1).mean(), len(lab))
    want = set(got.sort_values(["key", "doc_id"], ascending=[False, True])["doc_id"][:k])
    assert set(got[got["kept"]]["doc_id"]) == want
    good = set(lab[lab["quality"] == 1]["doc_id"])
    assert good <= want
    assert importance.resample(odd, labels).count() == 8 and importance.resample(none, labels).count() == 0
    scored = spark.createDataFrame([(i, float(i % 3)) for i in range(50)] + [(None, 1.0)], "doc_id long, key double")
    for k in (0, 1, 17, 40, 51, 60):
        top = importance.sample_top(scored, k, cells=2, few=3).toPandas()
        assert len(top) == 51 and top["kept"].sum() == min(k, 51) and top[top["kept"]]["key"].sum() == sum(sorted(top["key"])[::-1][:k])


def test_resampling_keeps_an_input_that_is_cleaner_than_its_labels(spark):
    rng = random.Random(8)
    clean, junk = [f"w{i}" for i in range(200)], [f"J{i}#" for i in range(200)]
    text = lambda words: " ".join(rng.choices(words, k=60))
    # labelled rows are half junk, the unlabelled hot source is clean
    rows = [(i, text(clean if i % 2 else junk)) for i in range(400)] + [(1000 + i, text(clean)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    want = {i for i, _ in rows if i >= 1000 or i % 2}
    got = importance.resample(docs, labels).where("kept")
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == want
    assert {r["doc_id"] for r in importance.selected(docs, labels).select("doc_id").collect()} == want
    # labels of rows that an earlier stage took away have no say
    assert importance.selected(docs.where("doc_id % 2 = 1 or doc_id >= 1000"), labels).count() == len(want)


def test_weights_by_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("a bb Ccc 12 , ddd EEE f".split(), k=rng.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(40)], "doc_id long, quality int")
    raw, target = (np.ones(importance.BUCKETS) for _ in range(2))
    for i, t in enumerate(texts):
        for b in importance.grams([t])[0].tolist():
            raw[b] += 1
            target[b] += i < 30
    ratio = np.zeros(importance.BUCKETS)
    for a, b in ((0, importance.WORDS), (importance.WORDS, importance.WORDS + importance.PAIRS), (importance.WORDS + importance.PAIRS, importance.BUCKETS)):
        ratio[a:b] = np.log(target[a:b] / target[a:b].sum() / (raw[a:b] / raw[a:b].sum()))
    got = {r["doc_id"]: r for r in importance.resample(docs, labels, effective=8.0).collect()}
    for i, t in enumerate(texts):
        b = importance.grams([t])[0]
        assert got[i]["n_grams"] == len(b) and abs(got[i]["log_weight"] - 8 * ratio[b].mean()) < 1e-9
    # the noise is standard Gumbel: mean 0.577, variance 1.645
    many = importance.keyed(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("log_weight"), F.lit(1).alias("n_grams"))).toPandas()["key"]
    assert abs(many.mean() - 0.5772) < 0.04 and abs(many.var() - 1.6449) < 0.1


def test_pairs_by_brute_force():
    rng = np.random.default_rng(12)
    cells = sorted({(int(w), int(a), int(b)) for w, a, b in zip(rng.integers(0, 3, 200), rng.integers(0, 90, 200), rng.integers(0, 256, 200))})
    own, t, f = (np.array(x) for x in zip(*cells))
    want = []
    for i in range(len(cells)):
        given = 0
        for j in range(i + 1, min(len(cells), i + 2 * media.FAN_OUT + 1)):
            dt = t[j] - t[i]
            if own[i] == own[j] and 1 <= dt <= media.FAR and given < media.FAN_OUT:
                given += 1
                want.append((own[i], (t[i] << 32) | (f[i] << 15) | (f[j] << 6) | dt))
    code, whose = media.pairs(t, f, own)
    assert list(zip(whose.tolist(), code.tolist())) == sorted((int(a), int(b)) for a, b in want)


def test_log_ratios_and_grams():
    b, own = importance.grams(["The cat, the CAT", "", "x x"])
    assert len(b) == 3 * 7 and set(own.tolist()) == {0, 2} and b.max() < importance.BUCKETS


def test_pipeline_stages(spark, odd, none, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(60).withColumns({c: F.lit(1) for c in ("key", "Score", "kept", "sequence_id", "offset", "component_id", "no_id")})
    strange = odd.withColumns({"source": F.lit("s"), "n_chars": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES:
        for given in (extra, strange, none):
            out = stage(spark, given, sf_dir)
            n = out.count()
            if name == "packing":
                assert (n >= given.count()) and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            else:
                assert out.columns == given.columns and n <= given.count() and (n or given is none)
                if given is extra:
                    assert out.where("key = 1 and Score = 1 and kept = 1").count() == n
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, odd, sf_dir).select("doc_id").collect()}
    assert not left & {0, 1, 4}
    run = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert run.groupby("sequence_id")["length"].sum().max() <= 4096 and run["doc_id"].nunique() < docs.count()


def test_near_duplicates_keep_unlike_texts_of_one_id(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n o"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)
