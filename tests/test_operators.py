import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import context, dense, evaluation, fusion, late, lexical, training
from lodestone.plans import config, retrieval
from lodestone.sources import files, keyvalue
from lodestone.streaming import indexing


@pytest.fixture(scope="module")
def library(spark):
    rows = [
        ("doc-1", "a.pdf", 1, "full_page", None, "The fuel pump relay is behind the panel"),
        ("doc-2", "b.pdf", 2, "table", None, "Torque values of the pump bolts"),
        ("doc-3", "c.pdf", None, None, None, "Catalogue of colours: crème, bleu"),
    ]
    return spark.createDataFrame(rows, "doc_id string, source string, page_number int, crop_label string, label string, content string")


def asked(spark, *texts, labels=None):
    return spark.createDataFrame([(i, t, labels) for i, t in enumerate(texts)], "query_id long, text string, labels array<string>")


def test_search(spark, library):
    index = lexical.build_index(library)
    hits = lexical.fetched(index, lexical.search(index, asked(spark, "fuel pump relay", 'what: "is" - (the) / é?', "zzz"), limit=5)).orderBy("query_id", "rank").collect()
    assert [(h["query_id"], h["doc_id"]) for h in hits][:2] == [(0, "doc-1"), (0, "doc-2")]
    assert hits[0]["crop_label"] == "full_page" and hits[0]["retriever"] == "text_search_engine"
    assert {h["doc_id"] for h in hits if h["query_id"] == 1} == {"doc-1", "doc-2", "doc-3"}  # no keyword: all
    assert not [h for h in hits if h["query_id"] == 2]
    only = lexical.search(index, asked(spark, "pump", labels=["table"]), limit=5).collect()
    assert [h["doc_id"] for h in only] == ["doc-2"]
    assert len(lexical.search(index, asked(spark, "pump", labels=[]), limit=5).collect()) == 2


def test_empty_index(spark, library):
    index = lexical.build_index(library.where("false"))
    assert lexical.search(index, asked(spark, "pump"), limit=5).count() == 0


def test_budget(spark):
    rows = [(0, 1, "a.pdf", 1, None, "A" * 50), (0, 2, "b.pdf", 2, "table", "B" * 50), (0, 3, "c.pdf", 3, None, "C"), (1, 1, None, None, "", " \n"), (1, 2, None, None, "", None)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, source string, page_number int, crop_label string, content string")
    kept = context.bounded_hits(hits, 20, 30).orderBy("number").collect()
    assert [r["content"] for r in kept] == ["A" * 20, "B" * 10]
    text = context.context_text(context.bounded_hits(hits, 20, 30)).first()["context"]
    assert text == "Text source 1: a.pdf page 1\n" + "A" * 20 + "\n\nText source 2: b.pdf page 2 type table\n" + "B" * 10
    assert context.bounded_hits(hits, 20, 0).count() == 0


def test_budget_against_a_loop(spark):
    r = random.Random(0)
    lists = [["".join(r.choice("ab \n") for _ in range(r.randrange(12))) for _ in range(8)] for _ in range(25)]
    rows = [(q, i, "s", i, None, c) for q, cs in enumerate(lists) for i, c in enumerate(cs)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, source string, page_number int, crop_label string, content string")
    got = {}
    for x in context.bounded_hits(hits, 6, 20).orderBy("query_id", "number").collect():
        got.setdefault(x["query_id"], []).append(x["content"])
    for q, cs in enumerate(lists):
        want, used = [], 0
        for c in cs:
            c = c.strip()
            if not c:
                continue
            if used >= 20:
                break
            c = c[: min(6, 20 - used)].strip()
            if c:
                want.append(c)
                used += len(c)
        assert got.get(q, []) == want


def test_knn(spark):
    r = np.random.default_rng(0)
    v = r.standard_normal((60, 5))
    v[7] = v[3]
    v[9] = 0
    vectors = spark.createDataFrame([(i, [float(x) for x in a], "t" if i % 2 else "f") for i, a in enumerate(v)], "id long, embedding array<double>, crop_label string")
    queries = spark.createDataFrame([(0, [float(x) for x in v[3]], None), (1, [float(x) for x in v[10]], ["t"])], "query_id long, vec array<double>, labels array<string>")
    got = dense.knn(vectors, queries, 5, label_col="crop_label").orderBy("query_id", "rank").collect()
    assert [x["id"] for x in got[:2]] == [3, 7]
    assert all(x["id"] % 2 for x in got if x["query_id"] == 1) and len(got) == 10
    everything = dense.knn(vectors, queries.drop("labels"), 1000).where("query_id = 0").count()
    assert everything == 60
    assert dense.knn(vectors.where("false"), queries, 5).count() == 0
    assert dense.knn(vectors, queries.where("false"), 5).count() == 0


def test_many_queries_meet_shards(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.standard_normal((90, 6))
    vectors = spark.createDataFrame([(i, [float(x) for x in a], "t" if i % 2 else "f") for i, a in enumerate(v)], "id long, embedding array<double>, crop_label string")
    queries = vectors.where("id < 30").select(F.col("id").alias("query_id"), F.col("embedding").alias("vec"), F.when(F.col("id") % 3 == 0, F.array(F.lit("t"))).alias("labels"))
    once = sorted(map(tuple, dense.knn(vectors, queries, 7, label_col="crop_label").select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(dense, "BROADCAST_VALUES", 5)
    monkeypatch.setattr(dense, "SHARD", 20)
    monkeypatch.setattr(dense, "BLOCK", 8)
    assert sorted(map(tuple, dense.knn(vectors, queries, 7, label_col="crop_label").select("query_id", "rank", "id").collect())) == once and len(once) == 210


def test_sort_top_k(spark):
    rows = [(0, 0, 0.3, "x"), (0, 1, 0.1, "x"), (0, 2, 0.1, "y"), (0, 3, 0.2, None)]
    lists = spark.createDataFrame(rows, "query_id long, pos int, distance double, content string")
    assert [r["pos"] for r in dense.sort_top_k(lists, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["pos"] for r in dense.sort_top_k(lists, 9, remove_duplicates=True).orderBy("rank").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="not a number"):
        dense.sort_top_k(lists.withColumn("distance", F.lit(None).cast("double")), 3).collect()
    top = dense.take_top_k(spark.createDataFrame([(0, 1, "img-2"), (0, 2, "img-1"), (0, 3, "x")], "query_id long, rank int, id string"), 2)
    assert [r["id"] for r in top.orderBy("position").collect()] == ["img-1", "img-2"]


def test_fusion(spark):
    a = spark.createDataFrame([(0, 1, "x", None), (0, 2, "y", 1)], "query_id long, rank int, id string, page int")
    b = spark.createDataFrame([(0, 1, "x", None), (0, 2, "z", 1)], "query_id long, rank int, id string, page int")
    assert [r["id"] for r in fusion.concat_dedup([a, b], ["id", "page"]).orderBy("position").collect()] == ["x", "y", "z"]
    rrf = fusion.reciprocal_ranks([a, b]).orderBy("rank").collect()
    assert [r["id"] for r in rrf] == ["x", "y", "z"] and rrf[0]["score"] == pytest.approx(1 / 61)
    lists = spark.createDataFrame([(0, 0, 0, "p"), (0, 0, 1, "q"), (0, 1, 0, "r"), (0, 1, 1, "p"), (0, 1, 2, "p")], "query_id long, list_no int, pos int, id string")
    assert [r["id"] for r in fusion.last_wins(lists).orderBy("position").collect()] == ["q", "r", "p", "p"]


def test_late_interaction(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((40, 6, 8))
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    tokens = spark.createDataFrame([(p, t, [float(x) for x in v[p, t]]) for p in range(40) for t in range(6)], "pid long, pos long, v array<double>")
    c = late.train_centroids(tokens, 8)
    assert c.count() == 8
    codes = late.assign(tokens, c)
    m = np.array([x["c"] for x in c.orderBy("cid").collect()])
    for x in codes.collect():
        assert x["code"] == int(np.round(m @ np.array(x["v"]), 12).argmax())
    with_r = late.residuals(codes, c)
    codec = late.buckets(with_r, 2)
    back = late.decompress(late.compress(with_r, codec, 2), c, codec, 2)
    cos = back.alias("b").join(tokens.alias("t"), ["pid", "pos"]).select(F.aggregate(F.zip_with("b.v", "t.v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("cos"))
    assert cos.agg(F.avg("cos")).first()[0] > 0.9
    queries = tokens.where("pid < 3").select(F.col("pid").alias("query_id"), F.col("pos").alias("qpos"), F.col("v").alias("q"))
    best = late.search(queries, tokens, c, codes, late.inverted_lists(codes), 3).where("rank = 1").collect()
    assert sorted((x["query_id"], x["pid"]) for x in best) == [(0, 0), (1, 1), (2, 2)]
    pooled = late.pool_tokens(tokens, 2)
    assert pooled.groupBy("pid").count().where("count <> 3").count() == 0


def test_assignment_by_cells_equals_that_by_broadcast(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = np.concatenate([r.standard_normal((300, 5)), np.zeros((2, 5)), np.repeat(r.standard_normal((1, 5)), 400, 0)])
    tokens = spark.createDataFrame([(i // 3, i % 3, x.tolist(), "e") for i, x in enumerate(v)], "pid long, pos long, v array<double>, code_name string").repartition(3)
    c = late.train_centroids(tokens, 50, 1)
    whole = sorted((x["pid"], x["pos"], x["code"]) for x in late.assign(tokens, c).collect())
    step = {x["cid"]: x for x in late.centroids.step(tokens, c).collect()}
    near = sorted(map(tuple, late.centroids.nearest(tokens.where("pid < 9").select(F.col("pid").alias("query_id"), F.col("pos").alias("qpos"), F.col("v").alias("q")), c, 3).select("query_id", "qpos", "cid", "rn").collect()))
    monkeypatch.setattr(late.centroids, "BLOCK_VALUES", 60)
    monkeypatch.setattr(late.centroids, "BLOCK_VECTORS", 100)
    assert sorted((x["pid"], x["pos"], x["code"]) for x in late.assign(tokens, c).collect()) == whole
    for x in late.centroids.step(tokens, c).collect():
        assert x["n"] == step[x["cid"]]["n"] and x["c"] == pytest.approx(step[x["cid"]]["c"], abs=1e-9)
    assert sorted(map(tuple, late.centroids.nearest(tokens.where("pid < 9").select(F.col("pid").alias("query_id"), F.col("pos").alias("qpos"), F.col("v").alias("q")), c, 3).select("query_id", "qpos", "cid", "rn").collect())) == near
    assert late.assign(tokens, c.where("false")).count() == 0 and late.assign(tokens.where("false"), c).count() == 0


def test_plan():
    p = late.plan(1000, 150)
    assert p.chunks == 1 and p.centroids == 2 ** math.floor(math.log2(16 * math.sqrt(150_000)))
    assert late.settings(10).ndocs == 256 and late.settings(100).ncells == 2 and late.settings(2000).ndocs == 8000
    assert late.settings(10, ncells=7).ncells == 7


def test_rouge(spark):
    pairs = spark.createDataFrame([(0, "the cat sat", "the cat ran"), (1, "", "x"), (2, None, None), (3, "a b c d", "a c d b")], "id long, reference string, answer string")
    one = {r["id"]: r["rouge"] for r in evaluation.rouge_n(pairs, 1).collect()}
    assert one[0] == pytest.approx(2 / 3) and one[1] == 0 and one[2] == 0 and one[3] == 1
    lcs = {r["id"]: r["rouge"] for r in evaluation.rouge_l(pairs).collect()}
    assert lcs[3] == pytest.approx(0.75) and lcs[0] == pytest.approx(2 / 3) and lcs[2] == 0


def test_precision(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c", "c"]), ([], ["a"]), (["a"], ["b"])], "w array<string>, f array<string>")
    got = [tuple(r)[2:] for r in evaluation.precision_recall(rows, "w", "f").collect()]
    assert got == [(0.5, 0.5, 0.5), (None, None, None), (0.0, 0.0, 0.0)]


def test_unknown_language(spark):
    with pytest.raises(Exception, match="unknown language"):
        evaluation.language_counts(spark.createDataFrame([("xx",)], "lang string")).collect()


def test_negatives_repeat(spark):
    g = spark.createDataFrame([(1, ["p", "q"], ["n"])], "query_id long, positives array<string>, negatives array<string>")
    assert training.sampled_passages(g, 0, 3).first()["negatives"] == ["n", "n"]


def test_files(spark, tmp_path):
    for name, body in (("a.txt", b"x"), ("sub/b.PDF", b"%PDF"), ("ignore.tmp", b""), ("bad.md", b"\xff")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    listed = files.list_files(spark, [str(tmp_path)], content=True)
    assert {r["ext"] for r in files.of_types(files.without(listed, [r"\.tmp$"]), ["txt", "pdf"]).collect()} == {"txt", "pdf"}
    assert files.without(listed, [r"\.tmp$"]).count() == 3
    loaded = {r["source"].rsplit("/", 1)[1]: r for r in files.loaded_text(listed).collect()}
    assert loaded["a.txt"]["content"] == "x" and loaded["bad.md"]["error"] == "not UTF-8" and "no loader" in loaded["b.PDF"]["error"]
    assert files.rendered(listed.where("ext = 'pdf'"), lambda content, dpi: [content, content]).count() == 2


def test_key_value(spark, tmp_path):
    store = keyvalue.KeyValueStore(spark, str(tmp_path / "kv"))
    store.put(spark.createDataFrame([("k", b"1"), ("l", b"2")], "key string, bytes binary"), 1)
    store.put(spark.createDataFrame([("k", b"3")], "key string, bytes binary"), 2)
    asked_for = spark.createDataFrame([("k",)], "key string")
    assert bytes(store.get(asked_for).first()["bytes"]) == b"3" and store.keys().count() == 2
    with pytest.raises(Exception, match="no such key"):
        store.get(spark.createDataFrame([("nope",)], "key string")).collect()


def test_settings():
    base = config.Retrieval.of(top_k=9)
    assert config.merged(base, config.Retrieval.of(retrieval_mode="hybrid")).top_k == 9
    assert config.merged(None, None) is None and config.merged(None, config.Retrieval.of(top_k=2)).top_k == 2
    with pytest.raises(config.ServiceError):
        config.Retrieval.of(retrieval_mode="guess")
    assert config.status_of(config.ServiceError(config.Code.INPUT_BAD, "")) == (400, 1004) and config.status_of(ValueError()) == (500, None)


def test_services(spark, library, tmp_path):
    services = retrieval.Services(spark, str(tmp_path))
    services.create("s", settings=config.Retrieval.of(retrieval_mode="text_search_retrieval"))
    with pytest.raises(config.ServiceError):
        services.create("s")
    with pytest.raises(config.ServiceError):
        services.create("t", library="other")
    services.index("s", library.where("source = 'a.pdf'"))
    assert services.count("s") == 1 and services.status("s") == "finished"
    services.index("s", library, override=config.Retrieval.of(update_index=True))
    assert services.count("s") == 3
    with pytest.raises(config.ServiceError):
        services.index("s", library, override=config.Retrieval.of(reindex=True))
    answer = services.predict("s", asked(spark, "fuel pump relay"))
    assert answer.embedding is None and answer.text.where("rank = 1").first()["doc_id"] == "doc-1"
    assert answer.context.first()["context"].startswith("Text source 1: a.pdf page 1 type full_page")
    assert services.status("never") == "finished" and services.mode("s") == "text_search_retrieval"
    again = retrieval.Services(spark, str(tmp_path))  # a later session knows the mode from the index
    again.create("s")
    assert again.predict("s", asked(spark, "fuel pump relay")).text is not None
    services.delete("s")
    assert services.info() == []


def test_incremental_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "source string, content string").schema
    index = indexing.IncrementalIndex(spark, str(tmp_path / "index"), schema)
    folder = str(tmp_path / "in")
    for batch in ([("a", "1"), ("b", "2")], [("b", "again"), ("c", "3")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        index.start(indexing.incoming(spark, folder, schema), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, index.table().collect())) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_pair_statistics_of_more_than_2000_vectors(spark, monkeypatch):
    """All pairs, over several blocks."""
    monkeypatch.setattr(dense, "PAIR_BLOCK", 700)
    v = np.random.default_rng(3).standard_normal((2101, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = (1 - u @ u.T)[np.triu_indices(len(u), 1)]
    got = dense.pair_statistics(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")).first()
    assert got["pairs"] == len(d) == 2101 * 2100 // 2
    assert list(got)[1:] == pytest.approx([d.mean(), np.median(d), d.std(), d.min(), d.max()], abs=1e-9)
    assert dense.pair_statistics(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")).first()["pairs"] == 0


def test_li_search_finds_what_brute_force_finds(spark):
    """Recall at 10 of the registered query, on a table where its cuts would show."""
    from lodestone.plans import registry

    sf = "/root/testdata/sf0.1"
    rows = registry.tokens_of(spark, sf).orderBy("pid", "pos").collect()
    v = {}
    for r in rows:
        v.setdefault(r["pid"], []).append(r["v"])
    v = {p: np.array(x) for p, x in v.items()}
    want = set()
    for q in (p for p in v if p % 50 == 0):
        score = {p: np.maximum((v[q] @ x.T).max(1), 0).sum() for p, x in v.items()}
        want |= {(q, p) for p in sorted(score, key=lambda p: (-round(score[p], 9), p))[:10]}
    got = {(r["query_id"], r["pid"]) for r in registry.li_search(spark, sf).collect()}
    assert len(got & want) / len(want) >= 0.99


def test_kmeans_select_goes_to_ten_clusters(spark):
    from lodestone.plans import registry

    assert sorted(r["k"] for r in registry.an_kmeans_select(spark, "/root/testdata/sf0.001").collect()) == list(range(2, 11))


def test_updates_add_the_vectors_of_fresh_sources(spark, tmp_path):
    from lodestone.plans import config, retrieval

    services = retrieval.Services(spark, str(tmp_path))
    services.create("v")
    rows = [("d1", "a.pdf", 1, None, None, "fuel pump"), ("d2", "b.pdf", 1, None, None, "relay box")]
    library = spark.createDataFrame(rows, "doc_id string, source string, page_number int, crop_label string, label string, content string")
    vectors = spark.createDataFrame([("d1", "a.pdf", [1.0, 0.0]), ("d2", "b.pdf", [0.0, 1.0])], "id string, source string, embedding array<double>")
    services.index("v", library.where("source = 'a.pdf'"), vectors.where("source = 'a.pdf'"))
    services.index("v", library, vectors, override=config.Retrieval.of(update_index=True))
    assert services.count("v") == 2
    assert sorted(r["id"] for r in spark.read.parquet(services.path("v") + "/vectors").collect()) == ["d1", "d2"]
    services.create("w")
    services.index("w", library)
    assert not services.exists("w", "vectors")
    questions = spark.createDataFrame([(1, "fuel pump", [1.0, 0.0])], "query_id long, text string, vec array<double>")
    services.predict("w", questions)


def test_collections_number_their_lines(spark, tmp_path):
    from lodestone.sources import files

    (tmp_path / "good.tsv").write_text("0\tfirst passage\tTitle\n1\tsecond passage\n")
    (tmp_path / "bad.tsv").write_text("5\tfirst passage\n9\tsecond passage\n")
    got = {r["pid"]: r["passage"] for r in files.tsv_collection(spark, str(tmp_path / "good.tsv")).collect()}
    assert got == {0: "Title | first passage", 1: "second passage"}
    with pytest.raises(ValueError):
        files.tsv_collection(spark, str(tmp_path / "bad.tsv"))
