"""The learned operators on held-out rows, neighbours against brute force, and the pipeline on a small folder."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import neighbours, quality, toxicity
from lodestone.llm.labelled import labelled_sample


def corpus(n, seed=0):
    r = random.Random(seed)
    clean = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    bad = ["grumble", "vilething", "lowxyz", "lowabc", "lowqrs", "lowtuv"]
    rows = []
    for d in range(n):
        words = [r.choice(clean) for _ in range(r.randrange(20, 160))]
        toxic, good = int(d % 4 == 0), int(d % 5 != 0)
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(bad)
        text = " ".join(words)
        rows.append((d, text if good else text.replace(" ", "&&& "), good, toxic))
    return rows


def test_toxicity_learns_spelling():
    rows = corpus(500)
    net = toxicity.fit([r[1] for r in rows[:400]], [r[3] for r in rows[:400]])
    scores = toxicity.Scorer(net).scores([r[1] for r in rows[400:]])
    truth = np.array([r[3] for r in rows[400:]])
    assert ((scores >= 0.5) == truth).mean() > 0.95
    unseen = toxicity.Scorer(net).scores(["mare sola nite " * 12 + "lowzzz lowkkk " + "sola mare " * 10])
    assert unseen[0] > np.median(scores[truth == 0])
    assert np.array_equal(toxicity.Scorer(net).scores(["", "!!!"]), [net.empty, net.empty])


def test_gradients():
    """Backpropagation through the gates and the attention against differences."""
    net, r = toxicity.Network(1), np.random.default_rng(0)
    x = r.standard_normal((5, toxicity.SIZE)).astype(np.float32)
    net.known_words[:] = net.known_grams[:] = True
    index, mask = toxicity.windows(np.array([0, 1, 2, 3, 4, 1]), np.array([0, 4]), np.array([4, 2]))
    target = np.array([1.0, 0.0])
    loss = lambda: float(np.sum(np.logaddexp(0, z := net.forward(net.gates(x), index, mask).astype(np.float64)) - target * z))
    logit, cache = net.forward(net.gates(x), index, mask, keep=True)
    g, d_x = net.backward((toxicity.sigmoid(logit) - target).astype(np.float32), index, mask, x, cache)
    for name in ("Wf", "Ub", "Bf", "A", "O"):
        p, at = net.p[name], tuple(0 for _ in net.p[name].shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(np.asarray(g[name])[at]), abs=2e-3)
    for at in ((0, 0), (1, 3), (4, 5)):
        old = x[at]
        x[at] = old + 1e-2
        up = loss()
        x[at] = old - 1e-2
        down = loss()
        x[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(d_x[at]), abs=2e-3)


def test_windows_cover():
    for n in (1, 31, 32, 33, 56, 57, 200):
        text, first, size = toxicity.window_table(np.array([3, 0, n, 1]))
        own = [(a - 3, b) for t, a, b in zip(text.tolist(), first.tolist(), size.tolist()) if t == 2]
        assert all(0 < b <= toxicity.LENGTH for _, b in own) and text.tolist().count(0) == text.tolist().count(3) == 1 and 1 not in text
        assert sorted({w for a, b in own for w in range(a, a + b)}) == list(range(n))
        assert all(c[0] < a + b for (a, b), c in zip(own, own[1:]))
    for n in (0, 1, 512, 513, 897, 5000):
        covered = {b for s in quality.chunk_starts(n) for b in range(s, min(n, s + quality.CHUNK))}
        assert covered == set(range(n))


def test_texts_score_alike_in_any_company():
    """A text's features do not hang on the texts that are scored with it, nor on what the scorer remembers; a long text's come from all its windows."""
    rows = corpus(200)
    net = toxicity.fit([r[1] for r in rows], [r[3] for r in rows])
    words = [f"w{i % 97}" for i in range(toxicity.PIECE + 500)]
    words[toxicity.PIECE - 3] = "lowxyz"
    texts = [rows[1][1], "", " ".join(words), rows[4][1], "!!!"] + [r[1] for r in rows[5:80]]
    together = toxicity.Scorer(net).features(texts)
    alone = np.concatenate([toxicity.Scorer(net).features([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-3) or np.allclose(together[np.isfinite(alone)], alone[np.isfinite(alone)], atol=1e-3)
    assert np.array_equal(np.isfinite(together), np.isfinite(alone)) and not np.isfinite(together[[1, 4]]).any()
    s = toxicity.Scorer(net)
    ids = s.ids(words)
    one = [float(net.forward(s.gates, *toxicity.windows(ids, np.array([a]), np.array([min(32, len(words) - a)])))[0]) for a in range(0, len(words) - 32 + 24, 24)]
    assert together[2, 0] == pytest.approx(max(one), abs=1e-3)
    old, toxicity.CACHE_WORDS = toxicity.CACHE_WORDS, 20
    try:
        assert np.allclose(toxicity.Scorer(net).features(texts[3:4] * 3), alone[[3, 3, 3]], atol=1e-3)
    finally:
        toxicity.CACHE_WORDS = old


def test_gram_rows_of_words_alone():
    """A word has the same n-grams whatever words stand beside it, as many as its length gives."""
    words = ["a", "of", "word", "überaus", "pneumonoultramicroscopic", "日本"]
    rows, cuts = toxicity.gram_rows(words)
    for k, w in enumerate(words):
        own, n = toxicity.gram_rows([w])
        assert sorted(rows[cuts[k] : cuts[k + 1]].tolist()) == sorted(own.tolist())
        assert n[1] == sum(max(0, len(w) + 2 - size + 1) for size in (3, 4, 5)) >= 1
    assert len(set(toxicity.gram_rows(["abcdefghij"])[0].tolist())) == 10 + 9 + 8


def test_toxic_texts_are_told_by_few_words_of_many():
    """Held-out texts with two toxic words among clean ones, from labels of whole texts only; no words' odds are given."""
    r = random.Random(11)
    clean = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    bad = ["zwack", "quorb", "drixel", "vompal"]
    rows = []
    for d in range(900):
        words = [r.choice(clean) for _ in range(r.randrange(30, 300))]
        if d % 3 == 0:
            for _ in range(max(2, len(words) // 40)):
                words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "s", "er"])
        rows.append((" ".join(words), int(d % 3 == 0)))
    net = toxicity.fit([t for t, _ in rows[:600]], [y for _, y in rows[:600]])
    predicted = toxicity.Scorer(net).scores([t for t, _ in rows[600:]]) >= toxicity.THRESHOLD
    truth = np.array([y for _, y in rows[600:]]) == 1
    assert predicted[truth].mean() >= 0.9 and predicted[~truth].mean() <= 0.03


def test_quality():
    rows = corpus(300)
    net = quality.fit([r[1] for r in rows[:240]], [r[2] for r in rows[:240]], steps=200)
    scores = net.scores([r[1] for r in rows[240:]])
    assert ((scores >= 0.5) == np.array([r[2] for r in rows[240:]])).mean() > 0.95
    long = rows[1][1] * 400
    data = np.frombuffer(long.encode(), np.uint8)
    blocks = net.chunk_logits(data)
    old, quality.BLOCK = quality.BLOCK, 2048
    try:
        assert np.allclose(net.chunk_logits(data), blocks, atol=1e-5)
    finally:
        quality.BLOCK = old


def edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "퟿ \U0001f600"), (None, "x y"), (4, "same"), (4, "same"), (5, "lowxyz " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(9))


@pytest.mark.parametrize("fit, score", [(toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)])
def test_edges(spark, fit, score):
    for labels in ([], [(1, 0, 1), (4, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None), (7, 5, 5)]):
        net = fit(edge_rows(spark), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = [r["score"] for r in score(edge_rows(spark), net).collect()]
        assert len(got) == 7 and all(0 <= x <= 1 for x in got)
        assert score(edge_rows(spark).where("false"), net).count() == 0


def test_held_out_labels_stay_out(spark):
    import zlib

    docs = spark.createDataFrame([(d, f"text {d}") for d in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, d % 2) for d in range(60)], "doc_id long, quality int, toxic int")
    texts, known, share = labelled_sample(docs, labels, "toxic", 3, 1)
    used = {int(t.split()[1]) for t in texts}
    assert used == {d for d in range(60) if zlib.crc32(str(d).encode()) % 3 != 1} and 0 < share < 1 and len(known) == len(texts)
    assert len(labelled_sample(docs, labels, "toxic", 3, 1, per_class=4)[0]) == 8


def brute_nearest(rows, every, k):
    fine = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in fine:
        if q % every == 0:
            ranked = sorted((-round(float(np.dot(np.float64(x), np.float64(v))), 9), i) for i, v in fine if i != q)[:k]
            out += [(q, n, i) for n, (_, i) in enumerate(ranked, 1)]
    return sorted(out)


def test_neighbours(spark):
    r = np.random.default_rng(2)
    vectors = r.integers(-4, 5, (400, 4)).astype(float)
    vectors[100:180] = vectors[40]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1020, [0.0] * 4), (1040, [float("nan")] * 4), (1060, [None, 1.0, 1.0, 1.0]), (1080, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("shard", F.lit(2))
    got = neighbours.nearest(df, factor=1.0, shard=64, block=8)
    assert sorted((x["query_id"], x["rank"], x["vec_id"]) for x in got.collect()) == brute_nearest(rows, 20, 20)
    few = neighbours.nearest(df.where("vec_id < 10 or vec_id = 20"), factor=1.0).collect()
    assert len([x for x in few if x["query_id"] == 20]) == len([1 for i, v in rows if i is not None and i < 10 and any(v)])
    assert neighbours.nearest(df.where("false")).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    found = {}
    for r in neighbours.nearest(df, shard=512, block=64).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q in ids[ids % 20 == 0].tolist():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s, kind="stable")[:20]].tolist()) & found[q])
        total += 20
    assert hit / total >= 0.9


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    rows = [(d, t, "en", "s", len(t)) for d, t, _, _ in corpus(160, 5)]
    item = " ".join(f"benchword{i}" for i in range(30))
    rows += [(1000, "intro " + item + " outro", "en", "s", 10), (1001, rows[1][1] + " more", "en", "s", 10), (1002, rows[1][1], "en", "s", 10), (1003, " ".join(r.choice(["sola", "mare", "tino", "luma"]) for _ in range(80)) + " write to me@example.com now", "en", "s", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, g, t) for d, _, g, t in corpus(160, 5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {x["doc_id"] for x in docs.collect()}
    toxic = {d for d, _, _, t in corpus(160, 5) if t}
    clean = {x[0] for x in rows} - toxic
    assert len(kept["toxicity"] & toxic) <= 3 and len(clean - kept["toxicity"]) <= 3
    assert 1002 not in kept["near_duplicates"] and 1 in kept["near_duplicates"]
    assert 1000 in kept["near_duplicates"] and 1000 not in kept["decontamination"]
    masked = spark.read.parquet(str(tmp_path / "pii")).where("doc_id = 1003").first()
    assert masked["text"].endswith("write to [EMAIL] now") and masked["n_chars"] == len(masked["text"])
    assert kept["packing"] == kept["pii"]
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["packing"]


def test_the_middle_of_a_long_word_is_read():
    from lodestone.llm import toxicity

    long = "a_" * 40 + "poisonous" + "_b" * 40
    pieces = toxicity.words_of(f"one {long} two")
    assert pieces[0] == "one" and pieces[-1] == "two" and all(len(p) <= 48 for p in pieces)
    assert any("poisonous" in p for p in pieces)
    assert set(long[i : i + 5] for i in range(len(long) - 4)) <= {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}
    assert toxicity.words_of("a" * 48) == ["a" * 48]
