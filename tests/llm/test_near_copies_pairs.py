"""How many pairs of sets a large group of near copies makes, and that the maps of parities rule out no link."""

import random

import numpy as np

from lodestone.llm import simhash


def test_maps_rule_out_no_similar_pair():
    r = np.random.default_rng(4)
    sets, similar, ruled_out = [], [], []
    for n in (0, 1, 3, 50, 400, 3000):
        for share in (0.0, 0.5, 0.7, 0.8, 0.9, 1.0):
            for more in (0, n // 8, 2 * n):
                common = r.integers(-(1 << 62), 1 << 62, int(n * share))
                sets += [np.unique(np.concatenate([common, r.integers(-(1 << 62), 1 << 62, n - len(common) + k)])) for k in (0, more)]
                similar.append(simhash.jaccard(*sets[-2:]) >= 0.8)
    held = simhash.Maps([simhash.parities(s) for s in sets], np.array([len(s) for s in sets]))
    i = np.arange(0, len(sets), 2)
    for a, b in ((i, i + 1), (i + 1, i)):
        ruled_out = ~np.isfinite(held.share(a, b, 0.8))
        assert not (ruled_out & np.array(similar)).any() and ruled_out[~np.array(similar)].mean() > 0.9
    assert (held.apart(i, i) == 0).all()
    apart = [len(np.setxor1d(sets[k], sets[k + 1], assume_unique=True)) for k in i]
    near = [k for k in range(len(i)) if held.count[i[k]] <= 2 * held.count[i[k] + 1] <= 4 * held.count[i[k]]]
    assert (held.apart(i[near], i[near] + 1) <= np.array(apart)[near]).all()


def test_maps_of_crowded_bins_and_without_words():
    crowded = np.arange(0, 1 << 20, 1 << 10)
    held = simhash.Maps([simhash.parities(crowded), simhash.parities(crowded[1:]), simhash.parities(crowded[:0])], np.array([1024, 1023, 0]))
    assert np.isfinite(held.share(np.array([0, 0, 2]), np.array([1, 2, 2]), 0.8)).tolist() == [True, False, True]


def test_other_pairs_are_all_that_differ_in_root():
    """Against brute force, in short and long runs."""
    r = np.random.default_rng(5)
    key = np.repeat(np.arange(60), r.integers(2, 90, 60))
    node, root = np.arange(len(key)), r.integers(0, 4, len(key))
    columns = [key, node, r.integers(0, 3, len(key)), r.integers(90, 110, len(key)), root]
    got = {(min(u, v), max(u, v)) for a, b in simhash.other_pairs(columns, 0.8) for u, v in zip(a.tolist(), b.tolist())}
    ok = lambda i, j: simhash.possible(*(np.array([c[k]]) for k in (i, j) for c in columns[2:4]), 0.8)[0]
    assert got == {(i, j) for j in range(len(key)) for i in range(max(0, j - 90), j) if key[i] == key[j] and root[i] != root[j] and ok(i, j)}


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies that few others are near to are not paired with the whole group; the links are those of brute force."""
    pairs, only_possible = [], simhash.only_possible

    def counted(found, nodes, similarity):
        pairs.append(found.count())
        return only_possible(found, nodes, similarity)

    monkeypatch.setattr(simhash, "only_possible", counted)
    r = random.Random(17)
    base, texts = [f"word{i}" for i in range(140)], []
    for k in range(500):
        words = list(base)
        for i in r.sample(range(140), 1 if k % 2 else 3 + k % 3):
            words[i] = f"edit{r.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if root[i] != root[j] and both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9:
                x, y = sorted((root[i], root[j]))
                root = [x if z == y else z for z in root]
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert kept == set(root)
    assert pairs[-1] < 3000 and sum(pairs) < 15_000  # 15 352 and 28 178 where the rest met the whole group


def test_only_shingles_of_new_prefixes_are_counted_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 10)
    line = " ".join(f"licence{i}" for i in range(40))
    texts = [(k, f"{line} " + " ".join(f"a{k}x{i}" for i in range(12))) for k in range(40)] + [(1000 + k, " ".join(f"b{k}x{i}" for i in range(60))) for k in range(200)]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sets = [(h, simhash.gram_set(simhash.shingle_hashes(t, 5))) for h, t in texts]
    rows = spark.createDataFrame([(h, h, bytearray(simhash.prefix(g, *none, 0.8).tobytes())) for h, g in sets], "node long, h long, keys binary").repartition(4)
    hot = simhash.crowded(rows)
    fresh, again = simhash.reordered(rows, spark.createDataFrame(texts, "h long, text string"), simhash.raised(none, hot), hot[0], 0.8)
    among = simhash.shingle_map(fresh)
    assert len(hot[0]) and again.count() == 240
    whole, part = simhash.crowded(again), simhash.crowded(again, among)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, part))
    assert simhash.mapped(np.concatenate([g for h, g in sets if h >= 1000]), among.value).mean() < 0.01
    assert simhash.mapped(np.frombuffer(b"".join(bytes(r["keys"]) for r in fresh.collect()), np.int64), among.value).all()
