"""Stems, common subsequences, matching blocks, hexagons, densities, Ward's tree and ragged lookups against their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.stem import stem
from lodestone.operators import analytics, evaluation, late

STEMS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi
sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate
cease ceas controll control roll roll""".split()


def test_stems_of_the_published_examples():
    for word, expected in zip(STEMS[::2], STEMS[1::2]):
        assert stem(word) == expected, word


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def test_common_subsequences():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(0, 90))] for _ in range(2))
        assert evaluation.longest_common(a, b) == table_lcs(a, b)


def blocks(a, b, popular):
    """Characters in matching blocks, straight from the definition."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and b[j + n] not in popular:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    i, j, n = best
    if not n:
        return 0
    k, m = i + n, j + n
    while i and j and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    while k < len(a) and m < len(b) and a[k] == b[m]:
        k, m = k + 1, m + 1
    return k - i + blocks(a[:i], b[:j], popular) + blocks(a[k:], b[m:], popular)


def test_matching_ratio(spark):
    r = random.Random(4)
    pairs = [("".join(r.choice("abcd") for _ in range(r.randrange(0, 25))), "".join(r.choice("abcd") for _ in range(r.randrange(0, 25)))) for _ in range(60)]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(100, None, "x"), (101, "", "")]
    got = {x["id"]: x["ratio"] for x in evaluation.matching_ratio(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(2 * blocks(a, b, set()) / (len(a) + len(b)) if a or b else 1.0)
    assert got[100] is None and got[101] == 1.0
    long = "z" * 150 + "".join(chr(0x4E00 + i) for i in range(100))
    assert evaluation.matching_ratio(spark.createDataFrame([("y" + "z" * 20, long)], "a string, b string"), "a", "b").first()["ratio"] == 0.0


def test_rouge_of_stems(spark):
    pairs = spark.createDataFrame([(1, "the cats were running", "a cat runs"), (2, None, "x")], "id long, reference string, answer string")
    one = {x["id"]: x["rouge"] for x in evaluation.rouge_n(pairs, 1, stemmed=True).collect()}
    long = {x["id"]: x["rouge"] for x in evaluation.rouge_l(pairs, stemmed=True).collect()}
    assert one[1] == pytest.approx(2 * 1 / 7) or one[1] == pytest.approx(2 * 2 / 7)
    assert one[1] == long[1] and one[2] == long[2] == 0.0


def test_points_go_to_the_nearest_hexagon(spark):
    r = random.Random(5)
    points = [(r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(400)]
    cells = analytics.hexagons(spark.createDataFrame(points, "x double, y double"), "x", "y", 0.7).collect()
    middles = {(c["q"], c["r"]): (c["x"], c["y"], c["n"]) for c in cells}
    grid = [(q, s) for q in range(-8, 9) for s in range(-8, 9)]
    counts = {}
    for x, y in points:
        near = min(grid, key=lambda g: (0.7 * math.sqrt(3) * (g[0] + g[1] / 2) - x) ** 2 + (1.05 * g[1] - y) ** 2)
        counts[near] = counts.get(near, 0) + 1
    assert {k: v[2] for k, v in middles.items()} == counts


def test_density_is_that_of_all_points(spark):
    r = random.Random(6)
    points = [((r.randrange(0, 12) + 0.5) * 0.25, (r.randrange(0, 12) + 0.5) * 0.25) for _ in range(60)]
    got = analytics.density(spark.createDataFrame(points, "x double, y double"), "x", "y", 0.25, 0.5, 6).collect()
    for c in r.sample(got, 40):
        x, y = (c["bx"] + 0.5) * 0.25, (c["by"] + 0.5) * 0.25
        exact = sum(math.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * 0.25)) for a, b in points) / (len(points) * 2 * math.pi * 0.25)
        assert c["density"] == pytest.approx(exact, abs=1e-6)
    assert analytics.density(spark.createDataFrame([], "x double, y double"), "x", "y", 1, 1).count() == 0


def test_ward_heights_equal_those_of_looking_at_all_pairs(spark):
    r = np.random.default_rng(7)
    v = r.standard_normal((500, 3))
    means, sizes, heights = {i: v[i] for i in range(80)}, {i: 1 for i in range(80)}, []
    while len(means) > 1:
        keys = sorted(means)
        cost, i, j = min((2 * sizes[i] * sizes[j] / (sizes[i] + sizes[j]) * ((means[i] - means[j]) ** 2).sum(), i, j) for x, i in enumerate(keys) for j in keys[x + 1 :])
        heights.append(math.sqrt(cost))
        means[i] = (means[i] * sizes[i] + means[j] * sizes[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        del means[j]
    merges = analytics.ward_merges(v[:80], np.ones(80))
    assert [m[2] for m in merges] == pytest.approx(heights) and merges[-1][3] == 80
    assert len(analytics.ward_merges(v, np.ones(500))) == 499
    rows = [(i % 9, x.tolist()) for i, x in enumerate(v)]
    tree = analytics.ward(spark.createDataFrame(rows, "c int, v array<double>"), "c", "v").orderBy("step").collect()
    groups = [v[i::9] for i in range(9)]
    assert [t["height"] for t in tree] == pytest.approx([m[2] for m in analytics.ward_merges(np.array([g.mean(0) for g in groups]), np.array([len(g) for g in groups]))])
    assert tree[-1]["size"] == 500


def test_lookups_rebuild_passages(spark):
    r = np.random.default_rng(8)
    rows = [(p, t, r.standard_normal(3).tolist()) for p in range(20) for t in range(1 + p % 7)]
    tokens = spark.createDataFrame(rows, "pid long, pos long, v array<double>").repartition(4)
    table = late.padded(tokens)
    for x in table.collect():
        n = 1 + x["pid"] % 7
        assert x["width"] == 2 ** math.ceil(math.log2(n)) == len(x["vectors"]) == len(x["mask"]) and sum(x["mask"]) == n
    back = late.unpacked_lists(late.packed_lists(tokens, 6), 3)
    assert sorted(map(tuple, back.collect())) == sorted((p, t, v) for p, t, v in rows)
    got = late.looked_up(spark.createDataFrame([(3, "q"), (3, "s"), (99, "q")], "pid long, who string"), table).collect()
    assert sorted((x["who"], x["pos"], x["v"]) for x in got) == sorted((w, t, v) for p, t, v in rows if p == 3 for w in "qs")
