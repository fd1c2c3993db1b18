"""Splitting, embedding and builds that go on where they stopped."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import building, chunking, embedding


def test_stretches_fit_and_rebuild_their_text():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a", "bb ", "c\n", "d\n\n", "  ", "é", "\n\n\n", "word word "]) for _ in range(r.randrange(0, 60)))
        starts = chunking.word_starts(text)
        size = r.randrange(1, 9)
        got = chunking.spans(text, starts, size)
        assert [a for a, _ in got] == sorted(a for a, _ in got)
        for a, b in got:
            assert len(re.findall(r"\S+", text[a:b])) <= size and text[a:b] == text[a:b].strip() != ""
        assert re.sub(r"\s", "", "".join(text[a:b] for a, b in got)) == re.sub(r"\s", "", text)
        for (_, b), (a, _) in zip(got, got[1:]):
            assert a >= b and text[b:a].strip() == ""


def test_paragraphs_stay_whole_where_they_fit():
    text = "one two\n\nthree four five\n\nsix"
    split = lambda size, overlap=0: [text[a:b] for a, b in chunking.spans(text, chunking.word_starts(text), size, overlap)]
    assert split(5) == ["one two\n\nthree four five", "six"]
    assert split(4) == ["one two", "three four five\n\nsix"]
    assert split(2) == ["one two", "three four", "five", "six"]
    assert split(0) == [text] and split(100) == [text]
    assert split(4, 3) == ["one two", "three four five\n\nsix"] or split(4, 3)[-1].endswith("six")
    with pytest.raises(ValueError):
        split(2, 2)


def test_overlap_repeats_whole_pieces():
    text = " ".join("abcdefghij")
    got = [text[a:b] for a, b in chunking.spans(text, chunking.word_starts(text), 4, 2)]
    assert got == ["a b c d", "c d e f", "e f g h", "g h i j"]


def test_chunked_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b\n\nc d", "z"), (4, "w" * 30_000, "z")], "id long, body string, text string")
    got = {r["id"]: [(c["number"], c["start"], c["tokens"], c["text"]) for c in r["chunks"]] for r in chunking.chunked(df, "body", 2).collect()}
    assert got == {1: [], 2: [], 3: [(0, 0, 2, "a b"), (1, 5, 2, "c d")], 4: [(0, 0, 1, "w" * 30_000)]}


def test_embedding_equals_row_by_row_in_full_batches(spark):
    def toy():
        sizes = []

        def model(texts):
            sizes.append(len(texts))
            return [[float(len(x)), float(x.count("a")), float(max(sizes))] for x in texts]

        return model

    rows = [(i, "a" * (i % 5) + "b" * (i % 3) if i % 7 else None) for i in range(100)]
    got = embedding.embed_dense(spark.createDataFrame(rows, "id long, text string").coalesce(1), "text", "toy", toy, size=16).collect()
    for r in got:
        x = r["text"] or ""
        raw = np.array([len(x), x.count("a"), 16.0])
        assert r["embedding"] == pytest.approx((raw / np.linalg.norm(raw)).tolist())
    assert len(got) == 100


def test_token_vectors_are_masked(spark):
    def loader():
        return lambda texts: [([[3.0, 4.0], [1.0, 0.0], [0.0, 0.0]], [1, 0, 1]) if t else (np.zeros((0, 2)), []) for t in texts]

    got = {r["id"]: r["vectors"] for r in embedding.embed_tokens(spark.createDataFrame([(1, "x"), (2, None)], "id long, text string"), "text", "t", loader).collect()}
    assert got == {1: [[0.6, 0.8], [0.0, 0.0]], 2: []}


def test_models_load_once_and_leave_when_unused():
    models, loads = embedding.Models(most_idle=1), []
    loader = lambda name: lambda: loads.append(name) or name
    assert models.acquire("a", loader("a")) == models.acquire("a", loader("a")) == "a"
    models.acquire("b", loader("b"))
    assert loads == ["a", "b"] and models.held() == {"a": 2, "b": 1}
    models.release("b")
    models.release("a")
    assert models.held() == {"a": 1, "b": 0}
    models.release("a")
    assert len(models.held()) == 1


def test_a_worker_loads_a_model_once(spark):
    def loader():
        import os

        return lambda texts: [[float(os.getpid()), float(embedding.WORKER.loads), 0.0] for _ in texts]

    def raw(df):
        return df.select(F.round(F.get("embedding", F.lit(1)) / F.get("embedding", F.lit(0)), 12).alias("share"))

    df = spark.range(64).select("id", F.lit("x").alias("text")).repartition(16)
    first = {r["share"] for r in raw(embedding.embed_dense(df, "text", "once", loader)).collect()}
    assert len(first) <= 8  # one value for each worker, not for each of 16 tasks


def test_a_stopped_build_goes_on(spark, tmp_path):
    rows = spark.range(60).select("id", (F.col("id") * 3).alias("v"), F.floor(F.col("id") / 10).cast("long").alias("chunk"))
    make = lambda part: part.withColumn("w", F.col("v") + 1)
    build = building.ChunkedBuild(spark, str(tmp_path), group=2)

    def stop(chunks):
        if 4 in chunks:
            make(rows.where("chunk = 4").limit(3)).write.mode("append").partitionBy("chunk").parquet(f"{tmp_path}/data")  # half-written
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        build.run(rows, make, before=stop)
    assert sorted(r["chunk"] for r in build.manifest().collect()) == [0, 1, 2, 3]
    assert build.table().count() == 40
    written = {p: p.stat().st_mtime_ns for c in range(4) for p in (tmp_path / "data" / f"chunk={c}").glob("*.parquet")}
    assert build.run(rows, make) == [4, 5]
    assert {p: p.stat().st_mtime_ns for p in written} == written
    assert sorted(map(tuple, build.table().select("id", "v", "w", "chunk").collect())) == [(i, 3 * i, 3 * i + 1, i // 10) for i in range(60)]
    assert build.run(rows, make) == []
    changed = rows.withColumn("v", F.when(F.col("id") == 25, 0).otherwise(F.col("v")))
    assert build.run(changed, make) == [2]
    assert build.table().where("id = 25").first()["w"] == 1
