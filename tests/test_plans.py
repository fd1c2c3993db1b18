"""The job queue, uploads, and prediction as stages."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical
from lodestone.plans import config, jobs, predict, retrieval


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        self.now += 1
        return self.now


def test_jobs_run_in_order_and_a_failed_one_blocks_nothing(spark, tmp_path):
    queue, done = jobs.JobQueue(spark, str(tmp_path), clock=Clock()), []
    assert queue.status("a") == "finished" and queue.take() is None
    first = queue.submit("a", {"n": 1})
    assert queue.submit("a", {"n": 9}, first) == first
    queue.submit("a", {"n": 2})
    queue.submit("b", {"n": 3})
    assert queue.status("a") == "queued"

    def work(service, payload):
        done.append((service, payload["n"]))
        if payload["n"] == 1:
            raise ValueError("bad file")

    assert queue.drain(work) == 3 and done == [("a", 1), ("a", 2), ("b", 3)]
    assert {(r["job_id"] == first, r["state"], r["error"]) for r in queue.jobs().collect()} == {(True, "error", "ValueError('bad file')"), (False, "finished", None)}
    assert queue.status("a") == queue.status("b") == "finished"


def test_an_expired_lease_is_taken_over(spark, tmp_path):
    clock = Clock()
    lost = jobs.JobQueue(spark, str(tmp_path), lease=100, clock=clock)
    lost.submit("a", {"n": 1})
    lost.submit("a", {"n": 2})
    assert lost.take().payload == {"n": 1}  # and its consumer goes away
    other = jobs.JobQueue(spark, str(tmp_path), lease=100, clock=clock)
    assert other.status("a") == "running" and other.take() is None
    clock.now += 200
    done = []
    assert other.drain(lambda service, payload: done.append(payload["n"])) == 2 and done == [1, 2]


def test_uploads_are_indexed(spark, tmp_path):
    for name, text in (("one.txt", "fuel pump relay\ftorque seal"), ("two.html", "<p>gauge <b>flange</b></p>"), ("bad.xyz", "?")):
        (tmp_path / name).write_text(text)
    services = retrieval.Services(spark, str(tmp_path / "services"))
    services.create("s", settings=config.Retrieval.of(retrieval_mode="text_search_retrieval"))
    services.upload("s", [str(tmp_path / "one.txt"), str(tmp_path / "bad.xyz")])
    assert services.status("s") == "queued" and services.count("s") == 0
    services.upload("s", [str(tmp_path / "two.html")])
    assert services.work() == 2 and services.status("s") == "finished"
    assert services.count("s") == 3
    hit = services.predict("s", spark.createDataFrame([(1, "which flange gauge")], "query_id long, text string")).text.first()
    assert hit["source"].endswith("two.html") and hit["content"] == "gauge flange"
    assert services.work() == 0
    with pytest.raises(config.ServiceError):
        services.upload("none", [])


DOCS = [("d1", "a.pdf", 1, None, None, "fuel pump relay"), ("d2", "b.pdf", 2, "table", None, "torque seal"), ("d3", "c.pdf", 3, None, None, "gauge flange pump")]


def library(spark):
    return spark.createDataFrame(DOCS, "doc_id string, source string, page_number int, crop_label string, label string, content string")


def test_stages_feed_each_other(spark):
    index = lexical.build_index(library(spark))
    questions = spark.createDataFrame([(1, 10, "what of it"), (2, 11, "relay")], "query_id long, session_id long, text string")
    turns = spark.createDataFrame([(10, 0, "user", "torque"), (10, 1, "assistant", "seal")], "session_id long, turn long, role string, text string")
    generators = predict.Generators(
        summarise=lambda q: q.select("query_id", F.concat_ws(" ", F.lit("flange"), F.element_at("history", 1)["text"]).alias("text")),
        hyde=lambda q: q.where("query_id = 2").select("query_id", F.lit("seal").alias("passage")),
        rephrase=lambda q: q.select("query_id", F.lit(0).alias("n"), F.concat(F.lit("again "), "text").alias("text")),
    )
    how = config.Retrieval.of(retrieval_mode="text_search_retrieval")
    out = predict.predict(how, questions, index, None, generators, turns=turns, prompt="make one question")
    assert sorted(map(tuple, out.questions.collect())) == [(1, 0, "flange torque"), (1, 1, "again flange torque"), (2, 0, "seal"), (2, 1, "again relay")]
    hits = {q: [(r["list_no"], r["doc_id"]) for r in sorted(out.text.collect(), key=lambda r: r["position"]) if r["query_id"] == q] for q in (1, 2)}
    assert {d for _, d in hits[1]} == {"d2", "d3"} and {n for n, _ in hits[1]} == {1}  # the later list takes over
    assert hits[2] == [(0, "d2"), (1, "d1")] and out.dense is None
    contexts = {r["query_id"]: r["context"] for r in out.context.collect()}
    assert contexts[2].startswith("Text source 1: b.pdf page 2 type table\ntorque seal") and "Text source 2: a.pdf page 1\nfuel pump relay" in contexts[2]
    answered = predict.predict(how, questions, index, None, predict.Generators(answer=lambda q: q.select("query_id", F.length("context").alias("n"))))
    assert {r["query_id"]: r["n"] for r in answered.collect()}[2] > 0


def test_without_generators_a_question_stays(spark):
    index = lexical.build_index(library(spark))
    questions = spark.createDataFrame([(1, "pump", ["table"]), (2, "pump", None)], "query_id long, text string, labels array<string>")
    how = config.Retrieval.of(retrieval_mode="hybrid")
    vectors = spark.createDataFrame([("v1", [1.0, 0.0], "table"), ("v2", [0.0, 1.0], None)], "id string, embedding array<double>, crop_label string")
    embed = lambda q: q.select("query_id", F.array(F.lit(0.0), F.lit(1.0)).alias("vec"))
    out = predict.predict(how, questions, index, vectors, predict.Generators(embed=embed))
    assert sorted((r["query_id"], r["doc_id"]) for r in out.text.collect()) == [(2, "d1"), (2, "d3")]
    assert sorted((r["query_id"], r["id"]) for r in out.dense.collect()) == [(1, "v1"), (2, "v1"), (2, "v2")]
    assert predict.predict(how, questions, None, None).text is None
