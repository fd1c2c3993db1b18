"""What the third round's findings named."""

import tracemalloc

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import building, centroids, dense, late
from lodestone.plans.registry import ORACLES, QUERIES


def rows_of(spark, folder, name):
    """A query's rows and its SQL's, over the tables of a folder."""
    con = duckdb.connect()
    for path in folder.iterdir():
        con.sql(f"create view {path.stem} as select * from '{path}/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in got.columns]
    return sorted(map(tuple, got.collect())), sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_migrated_keys_of_a_source_with_over_9999_pages(spark, tmp_path):
    spark.range(10_050).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("text"), F.lit("en").alias("lang")).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = rows_of(spark, tmp_path, "kv_migrate")
    assert got == want and len(got) == 10_050


def test_nearest_holds_a_tile_of_distances():
    r = np.random.default_rng(7)
    v, q = dense._unit(r.normal(size=(10_000, 16))), dense._unit(r.normal(size=(1500, 16)))
    v[5000:5040] = v[:40]  # ties
    own = [None if i % 7 == 0 else "ab"[i % 2] for i in range(len(v))]
    labels = [set() if i % 2 else {"a"} for i in range(len(q))]
    labels[4] = {"none"}
    tracemalloc.start()
    a, b, d = dense._nearest(q, labels, v, own, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # all distances at once are 120 MB, and were copied
    whole = np.maximum(1 - q @ v.T, 0)
    fits = np.array([[not allowed or x in allowed for x in own] for allowed in labels])
    whole[~fits] = np.inf
    last = np.partition(whole, 4, axis=1)[:, 4]
    x, y = np.nonzero((whole <= last[:, None] + 1e-13) & np.isfinite(whole))
    assert set(zip(x.tolist(), y.tolist())) <= set(zip(a.tolist(), b.tolist())) and len(a) <= len(x) + 10
    # batch by batch with the limits of those before, the best are the same
    limits, seen = np.full(len(q), np.inf), []
    for i in range(0, len(v), 3000):
        a, b, d = dense._nearest(q, labels, v[i : i + 3000], own[i : i + 3000], 5, limits)
        seen += zip(a.tolist(), (b + i).tolist())
    assert set(zip(x.tolist(), y.tolist())) <= set(seen)


def test_centroids_are_compared_in_tiles():
    r = np.random.default_rng(8)
    v, c = r.normal(size=(5000, 8)), r.normal(size=(3000, 8))
    c[2000:2100] = c[:100]  # ties go to the first
    tracemalloc.start()
    score, best = centroids.best_of(v, c)
    row, at, s = centroids.largest_of(v, c, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # all products at once are 120 MB, and were copied
    whole = np.round(v @ c.T, 12)
    assert (best == whole.argmax(1)).all() and (score == whole.max(1)).all()
    assert (at.reshape(-1, 4) == np.argsort(-whole, axis=1, kind="stable")[:, :4]).all() and (row.reshape(-1, 4)[:, 0] == np.arange(5000)).all()


def test_pairs_of_tokens_make_no_rows(spark, monkeypatch):
    r = np.random.default_rng(9)
    row = lambda i, j: (i, j, r.normal(size=4).tolist())
    tokens = spark.createDataFrame([row(p, j) for p in range(40) for j in range(1 + p % 3)], "pid long, pos long, v array<double>")
    asked = spark.createDataFrame([row(p, j) for p in range(9) for j in range(1 + p % 4)], "query_id long, qpos long, q array<double>")
    found = spark.createDataFrame([(q, p) for q in range(10) for p in range(45) if (q * p) % 5 != 1 or q == 3], "query_id long, pid long")
    v, q = {}, {}
    for x in tokens.collect():
        v.setdefault(x["pid"], []).append(x["v"])
    for x in asked.collect():
        q.setdefault(x["query_id"], []).append((x["qpos"], x["q"]))
    pairs = [(x["query_id"], x["pid"]) for x in found.collect() if x["query_id"] in q and x["pid"] in v]
    best = {(a, b): [(p >= 2, max(float(np.dot(x, y)) for y in v[b]), -min(float(((np.array(x) - y) ** 2).sum()) for y in np.array(v[b]))) for p, x in q[a]] for a, b in pairs}
    top = lambda m: sum(sorted((x for late_, x, _ in m if not late_), reverse=True)[:1]) + sum(sorted((x for late_, x, _ in m if late_), reverse=True)[:1])
    for values in (1 << 22, 24):  # one block of queries, and several
        monkeypatch.setattr(late, "MATCH_VALUES", values)
        monkeypatch.setattr(late, "MATCH_SHARD", 16)
        for got, want in (
            (late.maxsim(asked, found, tokens), lambda m: sum(x for _, x, _ in m)),
            (late.maxsim(asked, found, tokens, floor_at_zero=True), lambda m: sum(max(x, 0) for _, x, _ in m)),
            (late.maxsim(asked, found, tokens, squared=True), lambda m: sum(y for _, _, y in m)),
            (late.flipr(asked, found, tokens, 2, 1, 1), top),
        ):
            scores = {(x["query_id"], x["pid"]): x["score"] for x in got.collect()}
            assert scores.keys() == best.keys()
            assert all(abs(scores[p] - want(m)) < 1e-9 for p, m in best.items())
    assert "Join" not in late.maxsim(asked, found, tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert late.maxsim(asked.where("false"), found, tokens).count() == 0


def test_jobs_of_a_build_do_not_grow_with_its_chunks(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 200).alias("chunk"), "id")
    build, jobs = building.ChunkedBuild(spark, str(tmp_path / "b"), group=4), []
    build.run(rows, lambda part: part, before=jobs.append)
    assert len(jobs) <= building.MOST_JOBS and sorted(c for j in jobs for c in j) == list(range(200))
    assert sorted(r["id"] for r in build.table().collect()) == list(range(600)) and not build.run(rows, lambda part: part)
