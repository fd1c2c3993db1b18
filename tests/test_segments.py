"""An index that came about by updates answers like one made at once."""

import random

import pytest

from lodestone.operators import lexical
from lodestone.operators.segments import SegmentedIndex

DDL = "doc_id string, source string, page_number int, crop_label string, label string, content string"
WORDS = "pump relay valve motor é42 fuse torque seal gauge flange".split()


def document(r, i):
    return (f"d{i}", r.choice(["a.pdf", "b.pdf", None]), r.choice([1, 2, None]), r.choice([None, "text", "table"]), None, r.choice([None, "", " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 12)))]))


def answers(spark, index, okapi=False):
    questions = spark.createDataFrame([(1, "fuel pump relay", None), (2, "valve", ["text"]), (3, "of the", None), (4, "of the", ["table"]), (5, "torque gauge a.pdf", [])], "query_id long, text string, labels array<string>")
    rows = lexical.search(index, questions, limit=5, okapi=okapi).collect()
    return sorted((x["query_id"], x["rank"], x["doc_id"], round(x["score"], 9)) for x in rows)


def same(spark, index, live):
    fresh = lexical.build_index(spark.createDataFrame(list(live.values()), DDL))
    assert index.count() == len(live)
    assert sorted(r["doc_id"] for r in index.documents().collect()) == sorted(live)
    for okapi in (False, True):
        assert answers(spark, index.index(), okapi) == answers(spark, fresh, okapi)


def test_updates_equal_a_fresh_build(spark, tmp_path):
    r, live = random.Random(5), {}
    index = SegmentedIndex(spark, str(tmp_path))
    assert not index.exists() and index.count() == 0
    index.create(spark.createDataFrame([], DDL))
    assert index.exists() and index.count() == 0 and index.documents().collect() == []
    for step in range(2):
        new = {f"d{i}": document(r, i) for i in r.sample(range(30), 12)}
        index.add(spark.createDataFrame(list(new.values()), DDL))
        live |= new
        gone = r.sample(sorted(live), 3)
        index.delete(spark.createDataFrame([(g,) for g in [*gone, "never"]], "doc_id string"))
        for g in gone:
            del live[g]
    same(spark, index, live)
    assert len(index.state().segments) == 3
    assert index.compact(2) >= 2
    assert len(index.state().segments) < 3
    same(spark, index, live)
    index.vacuum()
    same(spark, index, live)


def test_an_update_writes_its_own_segment_only(spark, tmp_path):
    r = random.Random(6)
    index = SegmentedIndex(spark, str(tmp_path))
    index.create(spark.createDataFrame([document(r, i) for i in range(10)], DDL))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    index.add(spark.createDataFrame([document(r, i) for i in range(10, 15)], DDL))
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert index.count() == 15


def test_what_an_interrupted_update_leaves_is_not_seen(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    index = SegmentedIndex(spark, str(tmp_path))
    live = {f"d{i}": document(r, i) for i in range(8)}
    index.create(spark.createDataFrame(list(live.values()), DDL))
    more = {f"d{i}": document(r, i) for i in range(4, 12)}

    def broken(self, state):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(SegmentedIndex, "_commit", broken)
        with pytest.raises(RuntimeError):
            index.add(spark.createDataFrame(list(more.values()), DDL))
    same(spark, index, live)
    index.add(spark.createDataFrame(list(more.values()), DDL))
    same(spark, index, live | more)


def test_a_batch_is_added_once(spark, tmp_path):
    r = random.Random(8)
    index = SegmentedIndex(spark, str(tmp_path))
    batch = spark.createDataFrame([document(r, 1)], DDL)
    assert index.add(batch, batch=("stream", 0)) and not index.add(batch, batch=("stream", 0))
    assert index.add(spark.createDataFrame([document(r, 2)], DDL), batch=("stream", 1)) and index.count() == 2


def test_postings_are_a_row_for_each_document_and_field(spark, tmp_path):
    r = random.Random(9)
    index = SegmentedIndex(spark, str(tmp_path))
    live = {f"d{i}": document(r, i) for i in range(12)}
    index.create(spark.createDataFrame(list(live.values())[:6], DDL))
    index.add(spark.createDataFrame(list(live.values())[6:], DDL))
    index.delete(spark.createDataFrame([("d1",), ("d7",)], "doc_id string"))
    assert index.compact(2) == 2
    rows = spark.read.parquet(f"{tmp_path}/postings/segment={next(iter(index.state().segments))}").select("doc_id", "field").collect()
    assert sorted(map(tuple, rows)) == sorted((d, f) for d in live if d not in ("d1", "d7") for f in lexical.FIELDS)
    fresh = lexical.build_index(spark.createDataFrame([v for k, v in live.items() if k not in ("d1", "d7")], DDL))
    sums = lambda i: sorted(map(tuple, i.terms.groupBy("term", "field").sum("df").where("`sum(df)` > 0").collect()))
    assert sums(index.index()) == sums(fresh)
