"""How much of a search meets in one task."""

from lodestone.operators import lexical

DDL = "doc_id string, source string, page_number int, crop_label string, label string, content string"


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    docs = [(f"d{i}", "a.pdf", i, None, None, f"pump valve w{i % 7} w{i % 11}") for i in range(300)]
    index = lexical.build_index(spark.createDataFrame(docs, DDL))
    asked = spark.createDataFrame([(q, f"pump w{q}") for q in range(20)], "query_id long, text string")
    wide = [sorted(map(tuple, lexical.search(index, asked, limit=5, okapi=o).select("query_id", "rank", "doc_id").collect())) for o in (False, True)]
    monkeypatch.setattr(lexical, "TASK_PAIRS", 500)
    parts = []
    monkeypatch.setattr(lexical, "parts", lambda *a, real=lexical.parts: parts.append(real(*a)) or parts[-1])
    assert [sorted(map(tuple, lexical.search(index, asked, limit=5, okapi=o).select("query_id", "rank", "doc_id").collect())) for o in (False, True)] == wide
    assert parts == [12, 12] and len(wide[0]) == 100


def test_parts():
    assert lexical.parts(0, 0, 8) == 8 and lexical.parts(lexical.TASK_PAIRS, 9, 8) == 9 and lexical.parts(lexical.TASK_PAIRS, 9, 20) == 20
