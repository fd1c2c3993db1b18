import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import geometry as geo
from lodestone.functions import text as tx
from lodestone.functions import vectors as vx


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "question, want",
    [
        ("Where is the gasket of the TRX-41-B-C pump?", "gasket TRX 41 pump"),
        ("identifiées", "identifi es"),
        ("a I 7 the", ""),
        ("", ""),
    ],
)
def test_keywords(spark, question, want):
    assert one(spark, tx.keywords(F.lit(question))) == want
    assert one(spark, tx.query_text(F.lit(question))) == (want or "*")


def test_strip_takes_all_white_space(spark):
    assert one(spark, tx.strip(F.lit("\n\t a b \r\n"))) == "a b"


def test_uuid5_and_keys(spark):
    for source in ("/data/a.pdf", "é à", ""):
        assert one(spark, tx.uuid5(F.lit(source))) == str(uuid.uuid5(uuid.NAMESPACE_URL, source))
    key = one(spark, tx.part_key(F.lit("/a"), F.lit(3), "crop", F.lit(2)))
    assert key.endswith("_0003_crop_0002")
    assert tuple(one(spark, tx.parsed_key(F.lit(key))))[1:] == (3, "crop", 2)
    assert tuple(one(spark, tx.parsed_key(F.lit(key.replace("_crop_0002", "")))))[1:] == (3, "image", -1)
    assert tuple(one(spark, tx.parsed_key(F.lit(key.replace("_crop_0002", "_overview")))))[1:] == (3, "overview", -1)
    assert one(spark, tx.parsed_key(F.lit("no key"))) is None


@pytest.mark.parametrize(
    "text, want",
    [("<think>a\nb</think> yes<|im_end|>", "yes"), ("all of it</think>\n\nno", "no"), ("plain ", "plain"), ("", "")],
)
def test_strip_thinking(spark, text, want):
    assert one(spark, tx.strip_thinking(F.lit(text))) == want


def test_extract_query(spark):
    q = lambda reply, asked="What is it?": one(spark, tx.extract_query(F.lit(reply), F.lit(asked)))
    assert q('json\n{"query":{"type":"string","content":"What else"}}') == "What else"
    assert q('{"query":{"content":"Whatis it"}}') is None
    assert q("nothing") is None
    assert q('{"query":{"content":""}}') is None


def test_headers(spark):
    n = F.lit(None).cast("string")
    assert one(spark, tx.source_header(F.lit("a"), n, n)) == "document: a"
    assert one(spark, tx.source_header(F.lit("a"), F.lit(2), F.lit("table"))) == "document: a page: 2 type: table"
    assert one(spark, tx.context_header(F.lit(1), n, F.lit(1), F.lit(""))) == "Text source 1: unknown source page 1"


@given(st.lists(st.text("ab c\n", max_size=12), min_size=1, max_size=5), st.integers(1, 5), st.integers(0, 4))
@settings(max_examples=15, deadline=None)
def test_windows_cover_all_words(spark, texts, size, overlap):
    overlap = min(overlap, size - 1)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", tx.token_windows("t", size, overlap).alias("w")).collect()
    for r in rows:
        words = r["t"].split()
        step = size - overlap
        want = [words[a : a + size] for a in range(0, max(len(words) - overlap, 1), step)] if words else []
        assert [w["text"].split() for w in r["w"]] == want
        for w in r["w"]:
            assert r["t"][w["start"] :].startswith(w["text"])


@given(st.lists(st.integers(0, 3), min_size=4, max_size=16).map(lambda x: x[: len(x) // 4 * 4]))
@settings(max_examples=15, deadline=None)
def test_packed_bits_come_back(spark, numbers):
    packed = one(spark, vx.packed_bits(F.array(*map(F.lit, numbers)), 2))
    assert len(packed) == len(numbers) // 2
    assert one(spark, vx.unpacked_bits(F.lit(packed), 2)) == numbers


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vx.norm(a)) == 5
    assert one(spark, vx.normalized(z)) == [0, 0]
    assert one(spark, vx.cosine_distance(a, z)) == 1
    assert one(spark, vx.dot(a, a, 2)) == one(spark, vx.dot(a, a)) == 25
    assert one(spark, vx.last_attended(F.array(*map(F.lit, "abc")), F.array(F.lit(1), F.lit(1), F.lit(0)))) == "b"


def test_geometry(spark):
    strips = one(spark, geo.strips(F.lit(100), 5, 20))
    assert [(s["y0"], s["y1"]) for s in strips] == [(0, 24), (16, 40), (32, 56), (48, 72), (64, 88)]
    assert one(spark, geo.font_scale(F.lit(12.0))) == 2 and one(spark, geo.font_scale(F.lit(24.0))) == 1
    assert one(spark, geo.font_scale(F.lit(48.0))) == pytest.approx(0.6)
    assert one(spark, geo.font_scale(F.lit(0.0))) == 1
    assert tuple(one(spark, geo.fitted(F.lit(1000), F.lit(2000), 500, 500))) == (250, 500)
    assert one(spark, geo.sampled_frames(F.array(*map(F.lit, range(10))), 4)) == [0, 3, 6, 9]
    assert one(spark, geo.sampled_frames(F.array(*map(F.lit, range(3))), 4)) == [0, 1, 2]


def test_html(spark):
    html = "<html><head><title>x</title></head><body><p>One &amp; two</p><script>no()</script><!-- no --><div>three<br>four</div></body></html>"
    assert one(spark, tx.html_text(F.lit(html))) == "One & two\nthree\nfour"
