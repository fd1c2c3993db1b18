"""Packing, exact substrings, spans, token counts, PII, decontamination and SimHash against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import decontamination, packing, pii, simhash, spans, suffixes, token_counts
from lodestone.llm.components import components

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = [(1, None), (2, ""), (3, "  \n"), (None, "A text whose id is null. It has two sentences."), (4, "the same"), (4, "the same"), (4, "another text"), (5, "x" * 40_000), (6, "word " * 9_000), (7, "½² İ ﬁ á \x1c\x85 +49 (0) 123 456 78 <|endoftext|>it's")]


def odd(spark):
    """Null and empty texts, null and repeated ids, long texts, and columns whose names clash with the operators' own."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("h", F.lit("h")).withColumn("score", F.lit("s")).withColumn("label", F.lit(3)).withColumn("fp", F.lit(2)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")


def sample(seed, n=80, words=40, docs=None):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(words)]
    base = [" ".join(r.choice(vocabulary) for _ in range(40)) + "." for _ in range(8)]
    out = []
    for d in range(n):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 30)))
        for _ in range(r.randrange(0, 3)):
            b = r.choice(base)
            a = r.randrange(len(b))
            t += b[a : a + r.randrange(30, 150)] + ". "
        out.append((d, t))
    return out


# --- packing


def check_pieces(rows, docs, window=4096):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        got = sorted((p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]) for p in pieces)
        want = sorted(len(x) for x in ids[d])
        assert sum(len(x) for _, x, _ in got) == sum(want)
        assert all(any(x == own[s : s + len(x)] and n == len(own) for own in ids[d]) for s, x, n in got)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += len(p["ids"]) // 4
        assert at == pieces[0]["sequence_tokens"] <= window
    total = sum(p[0]["sequence_tokens"] for p in by_sequence.values())
    return total, sum(packing.padded(p[0]["sequence_tokens"], window) - p[0]["sequence_tokens"] for p in by_sequence.values())


def test_packing_round_trip(spark):
    check_pieces(packing.pack(odd(spark), WORDS).collect(), ODD)
    docs = sample(1, 300)
    total, padding = check_pieces(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), WORDS).collect(), docs)
    assert padding < 0.02 * total
    ordered = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), WORDS, order_by=["doc_id"], window=256).collect()
    check_pieces(ordered, docs, 256)
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_packing_is_optimal():
    """The queue's program against one that tries every start."""
    r = np.random.default_rng(0)
    for _ in range(60):
        steps = r.integers(1, 9, 40)
        position = np.append(0, np.cumsum(steps))
        penalty = np.append(0.0, r.choice([0.0, 1.0, 4.0], 40))
        best = [0.0] + [np.inf] * 40
        for j in range(1, 41):
            for i in range(j):
                n = int(position[j] - position[i])
                if n <= 16:
                    best[j] = min(best[j], best[i] + packing.padded(n, 16) - n + penalty[j])
        cuts = [0, *packing.plan_cuts(position, penalty, 16, True)]
        cost = sum(packing.padded(int(position[b] - position[a]), 16) - int(position[b] - position[a]) + penalty[b] for a, b in zip(cuts, cuts[1:]))
        assert cuts[-1] == 40 and cost == pytest.approx(best[40])


# --- exact substrings


def cut(docs):
    least, out = {}, []
    rows = [(d, (t or "").encode()) for d, t in docs]
    for d, b in rows:
        if d is not None:
            for i in range(len(b) - 49):
                g = b[i : i + 50]
                least[g] = min(least.get(g, d), d)
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - 49):
                if least[b[i : i + 50]] < d:
                    gone[i : i + 50] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, words", [(1, 8), (2, 200)])
def test_substrings(spark, seed, words):
    docs = sample(seed, 70, words) + [(900, "ab " * 60), (901, "ab " * 90), (902, "ab " * 17)]
    got = suffixes.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr) == cut(docs)


def test_substring_edges(spark):
    got = suffixes.substring_dedup(odd(spark)).collect()
    small = [(d, t) for d, t in ODD if not t or len(t) < 1000]
    want = {(r[0], r[1]): r for r in cut(small)}
    for r in got:
        if r["n_bytes"] < 1000:
            assert want[r["doc_id"], r["n_bytes"]][2:4] == (r["n_removed"], r["n_spans"])
    assert len(got) == len(ODD) and suffixes.substring_dedup(empty(spark)).count() == 0


def test_suffix_sort():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[1000:2000] = data[:1000]
    suffix = r.permutation(3900)[:600]
    cuts = np.array([0, 1, 3, 200, 600])
    start, length = np.repeat(cuts[:-1], np.diff(cuts)), np.repeat(np.diff(cuts), np.diff(cuts))
    got = suffixes.SuffixSorter(data).sort(suffix, start, length)
    for a, b in zip(cuts, cuts[1:]):
        keys = [data[s : s + 50].tobytes() for s in got[a:b]]
        assert keys == sorted(keys) and sorted(got[a:b]) == sorted(suffix[a:b])


# --- spans of sentences


def brute_spans(docs, run=2, words=20):
    """Runs by their text; rows with equal ids don't cut each other."""
    found = []
    for d, t in docs:
        s = [x.strip(" \t") for x in re.split(r"(?<=[.!?,;:])[ \t]+|\n+", t or "")]
        s = [x for x in s if x]
        norm = [re.sub("[ \t]+", " ", x).lower() for x in s]
        size = [len(x.split(" ")) for x in norm]
        own = []
        for i in range(len(s)):
            ends = [j for j in range(i + run, len(s) + 1) if sum(size[i:j]) >= words]
            if ends or i == 0:
                own.append((i, ends[0] if ends else len(s)))
        found.append((d, s, norm, own))
    least = {}
    for d, _, norm, own in found:
        for i, j in own:
            key = tuple(norm[i:j])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, s, norm, own in found:
        gone, seen = set(), set()
        for i, j in own:
            key = tuple(norm[i:j])
            if key in seen or least[key] < d:
                gone.update(range(i, j))
            seen.add(key)
        out.append((d, [x for i, x in enumerate(s) if i not in gone]))
    return sorted(out)


def test_spans(spark):
    r = random.Random(5)
    pool = [f"Sentence number {i} stands here, {'and more, ' * (i % 3)}as it does." for i in range(12)]
    docs = [(d, "".join(r.choice(pool) + r.choice([" ", "\n", "  ", "\t ", " \n\t"]) for _ in range(r.randrange(0, 9)))) for d in range(60)] + [(60, None), (61, ""), (5, pool[0] * 4), (5, pool[0] * 4)]
    for run, words in ((2, 20), (3, 0), (1, 12)):
        got = spans.sentence_spans(spark.createDataFrame(docs, "doc_id long, text string"), run=run, words=words).select("doc_id", "kept").collect()
        assert sorted(map(tuple, got)) == brute_spans(docs, run, words)
    assert spans.sentence_spans(odd(spark)).count() == len(ODD)
    assert spans.sentence_spans(empty(spark)).count() == 0


def test_spans_of_planted_passages(spark):
    """Passages of over 50 words, cut out of the middle of their sentences, are found; texts that share none stay whole."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() + r.choice([""] * 12 + [".", ","]) for _ in range(n))
    passages = [prose(60) for _ in range(40)]
    docs = [(d, f"{prose(40)} {passages[d % 40]} {prose(40)}") for d in range(80)] + [(100 + d, prose(140)) for d in range(40)]
    got = dict(spans.sentence_spans(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", F.size("removed")).collect())
    assert sum(got[d] > 0 for d in range(40, 80)) >= 38
    assert all(got[d] == 0 for d in [*range(40), *range(100, 140)])


# --- token counts


def greedy(w, initial, inner):
    n = i = 0
    while i < len(w):
        v = initial if i == 0 else inner
        j = next((j for j in range(len(w), i, -1) if w[i:j] in v), None)
        if j is None:
            return 0
        n, i = n + 1, j
    return n


def test_automaton():
    r = random.Random(2)
    piece = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))
    for _ in range(300):
        initial, inner = {piece() for _ in range(r.randrange(9))}, {piece() for _ in range(r.randrange(12))}
        a = token_counts.Automaton(initial, inner)
        for _ in range(30):
            w = "".join(r.choice("abcd" if r.random() < 0.05 else "abc") for _ in range(r.randrange(1, 14)))
            assert a.count(w) == greedy(w, initial, inner)


def test_token_counts(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    initial, inner = {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}, {p for p in pieces if p[0] != "▁"}
    docs = [*sample(3, 20), (100, "Straße naïve 漢字 \U0001f600"), (101, None), (102, " ")]
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(spark.createDataFrame(docs, "doc_id long, text string"), PIECES).collect()}
    for d, t in docs:
        counts = [greedy(w, initial, inner) for w in (t or "").split()]
        assert got[d] == (len(counts), sum(c or 1 for c in counts), counts.count(0))
    assert token_counts.token_counts(odd(spark), PIECES).count() == len(ODD)
    assert token_counts.token_counts(empty(spark), PIECES).count() == 0


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_seeds(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn) or (kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_seeds():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("0123456789..--@@  ++()aZ_,\n") for _ in range(r.randrange(60)))
        assert pii.seeds(t) == brute_seeds(t)
    for _ in range(500):
        t = " ".join(r.choice(["4923437827071911", "+1 (606) 555-7814", "89.189.210.185", "a.b@c.d.e", "x"]) + r.choice(["", ",", ".", "@", "1"]) for _ in range(6))
        assert pii.seeds(t) == brute_seeds(t)


def test_contexts_discover(spark):
    docs = [(i, f"please call us at +1 ({200 + i}) 555-{1000 + i} today") for i in range(12)] + [(50, "please call us at 555-0199-7 today"), (51, "the price is 1234 today"), (52, "call 77")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[50]["spans"]] == [("phone", 18, 28)] and not got[50]["base"]
    assert not got[51]["spans"] and not got[52]["spans"] and len(got[3]["spans"]) == 1
    text = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert text[50] == "please call us at [PHONE] today" and text[51] == docs[13][1]


def test_pii_edges(spark):
    found = pii.find_pii(odd(spark)).collect()
    assert len(found) == len(ODD)
    kept = pii.redact(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) and kept.where("text is null").count() == 1
    assert pii.find_pii(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


# --- decontamination


def align_all(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(item))


def test_alignment():
    r = np.random.default_rng(0)
    for _ in range(40):
        item, passages = r.integers(1, 5, r.integers(1, 12)), r.integers(0, 5, (6, 20))
        got = decontamination.similarity(item, decontamination.align(item, passages)[0])
        assert got.tolist() == [align_all(item.tolist(), p.tolist()) for p in passages]


def test_decontamination(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}x" for i in range(400)]
    item = lambda: [r.choice(vocabulary) for _ in range(r.randrange(14, 40))]
    items = [item() for _ in range(12)]
    docs = []
    for d in range(90):
        words = [r.choice(vocabulary) for _ in range(120)]
        if d % 3 == 0:
            copy = list(items[d % 12])
            for _ in range(len(copy) // 8):
                copy[r.randrange(len(copy))] = "edited"
            at = r.randrange(80)
            words[at:at] = copy if d % 2 else [w for i, w in enumerate(copy) if i % 9]
        docs.append((d, " ".join(words)))
    texts = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.alignments(texts, bench).collect()}
    want = {(d, i) for d, t in docs for i, w in enumerate(items) if align_all(w, t.split()) >= decontamination.THRESHOLD}
    assert got == want and len(want) >= 30
    kept = {x["doc_id"] for x in decontamination.drop_contaminated(texts, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    hot = spark.createDataFrame([(d, "before " + " ".join(items[0]) + " after") for d in range(40)], "doc_id long, text string")
    assert decontamination.contaminated(hot, bench).where("contaminated").count() == 40


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontamination.drop_contaminated(odd(spark), bench).count() == len(ODD)
    assert decontamination.alignments(empty(spark), bench).count() == 0
    assert decontamination.alignments(odd(spark), bench.where("false")).count() == 0
    assert decontamination.contaminated(odd(spark), bench).count() == len({d for d, _ in ODD})


# --- simhash


def plain_fingerprint(t, width=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    grams = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(grams))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_simhash(spark):
    r = random.Random(6)
    docs = []
    for d in range(150):
        words = [r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(0, 60))]
        docs.append((d, " ".join(words)))
        if d % 3 == 0 and words:
            words[r.randrange(len(words))] = "zz"
            docs.append((d + 1000, " ".join(words) + "\n É"))
    docs += [(5000 + i, "") for i in range(5)] + [(6000, None)]
    fps = {d: plain_fingerprint(t) for d, t in docs}
    want = classes([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], fps)
    got = simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {x["doc_id"]: x["fp"] & (1 << 64) - 1 for x in got} == fps
    assert {x["doc_id"]: x["component_id"] for x in got} == want
    assert len(set(want.values())) < len(docs)


@pytest.mark.parametrize("radius", [2, 7])
def test_links_reach_all(spark, radius):
    r = np.random.default_rng(7)
    base = r.integers(-(1 << 63), 1 << 63, 30)
    fps = sorted({int(b) ^ int(sum(1 << int(k) for k in r.choice(63, r.integers(0, 6), replace=False))) for b in base for _ in range(12)})
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius).collect()
    assert classes([tuple(e) for e in edges], fps) == classes([(a, b) for a in fps for b in fps if a < b and simhash.distance(a, b) <= radius], fps)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 100), (200, 201), (-5, 300)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == classes([e for e in edges if e[0] != e[1]], {n for e in edges if e[0] != e[1] for n in e})
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edges(spark):
    got = simhash.simhash_components(odd(spark)).collect()
    assert len(got) == len(ODD)
    kept = simhash.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] == 4) == [(4, "another text"), (4, "the same")]
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 4, 5, 6, 7}
    assert simhash.simhash_components(empty(spark)).count() == 0 and simhash.drop_near_duplicates(empty(spark)).count() == 0
    clashing = odd(spark).withColumns({n: F.lit("mine") for n in ("own_id", "own_h", "node", "root", "least")})
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and {(r["own_id"], r["own_h"], r["node"]) for r in kept.collect()} == {("mine", "mine", "mine")}


def test_digests(spark):
    """The queries' digest columns."""
    docs = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4")], "doc_id long, text string")
    p = packing.piece_digests(packing.pack(docs, WORDS)).first()
    ids = [*Tokenizer.from_file(WORDS).encode("mail a@b.cd or 1.2.3.4", add_special_tokens=False).ids, 2]
    assert p["ids_crc32"] == zlib.crc32(np.array(ids[: p["length"]], "<u4").tobytes())
    base = pii.find_pii(docs).select(pii.digest(F.col("base")).alias("d")).first()["d"]
    assert base == "email:5:11,ip:15:22" and len(hashlib.sha256(base.encode()).hexdigest()) == 64


def test_fingerprint_pairs(spark):
    """Every pair is near, and every node that has a near one before it is in a pair."""
    r = np.random.default_rng(9)
    nodes = []
    for base in r.integers(-(1 << 63), 1 << 63, 12).tolist():
        nodes += [(len(nodes) + k, base ^ int(sum(1 << int(b) for b in r.choice(63, r.integers(0, 4), replace=False)))) for k in range(10)]
    fp = dict(nodes)
    got = [tuple(e) for e in simhash.fingerprint_pairs(spark.createDataFrame(nodes, "node long, fp long"), 3).collect()]
    assert got and all(a < b and simhash.distance(fp[a], fp[b]) <= 3 for a, b in got)
    assert {n for e in got for n in e} >= {b for a in fp for b in fp if a < b and simhash.distance(fp[a], fp[b]) <= 3}


def test_histograms_rule_out_no_similar_pair():
    r = np.random.default_rng(4)
    ruled_out = 0
    for n in (0, 1, 3, 50, 400, 3000):
        for share in (0.0, 0.5, 0.7, 0.8, 0.9, 1.0):
            common = r.integers(-(1 << 62), 1 << 62, int(n * share))
            a, b = (np.unique(np.concatenate([common, r.integers(-(1 << 62), 1 << 62, n - len(common))])) for _ in "ab")
            open_, similar = simhash.may_be_similar(simhash.histogram(a), simhash.histogram(b), 0.8), simhash.jaccard(a, b) >= 0.8
            assert open_ or not similar
            ruled_out += not open_
    assert ruled_out >= 8
    crowded = np.arange(0, 64 * 600, 64)
    assert simhash.may_be_similar(simhash.histogram(np.concatenate([crowded, crowded + 1])), simhash.histogram(crowded), 0.8) in (True, False)
    assert max(simhash.histogram(np.arange(0, 1 << 20, 1 << 10))) == 255


def test_sets_with_one_node_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 5, "c"), (2, 9, "d")], "node long, other long, x string")
    clashes = spark.createDataFrame([(1, 5)], "node long, least_other long")
    got = {r["x"]: r["node"] for r in simhash.told_apart(rows, clashes).collect()}
    assert got["a"] == got["c"] == 1 and got["d"] == 2 and got["b"] not in (1, 2)


def test_near_copies_go(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    docs = []
    for d in range(40):
        words = [r.choice(vocabulary) for _ in range(150)]
        docs.append((d, " ".join(words)))
        for k in range(1, 3):
            edited = list(words)
            edited[r.randrange(150)] = "edited"
            docs.append((1000 * k + d, " ".join(edited)))
        half = words[:75] + [r.choice(vocabulary) for _ in range(75)]
        docs.append((5000 + d, " ".join(half)))
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert set(range(40)) | set(range(5000, 5040)) <= kept
    assert len(kept) <= 80 + 4


def test_near_copies_are_those_of_jaccard_similarity(spark):
    """Every link of 0.8 or more, and no other, against brute force; among them a large group and a passage that many share."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage, docs = [word() for _ in range(60)], []

    def edited(words, n):
        words = list(words)
        for i in r.sample(range(len(words)), n):
            words[i] = word()
        return words

    for _ in range(60):
        base = [word() for _ in range(r.randrange(20, 160))]
        docs += [base, *[edited(base, k) for k in range(1, 5)], base[: int(len(base) * r.uniform(0.75, 0.9))]]
    docs += [passage + [word() for _ in range(12)] for _ in range(60)]
    large = [word() for _ in range(200)]
    docs += [edited(large, r.randrange(0, 5)) for _ in range(80)]
    r.shuffle(docs)
    texts = [" ".join(d) for d in docs]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9 and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if z == y else z for z in root]
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert kept == set(root)


def test_contaminated_rows_without_an_id(spark):
    item = " ".join(f"rare{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"so {item} it is"), (None, "clean"), (5, None), (5, item), (6, "clean words only")], "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("b", F.lit("b"))
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["best_item"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {None: (True, 1, 1), 5: (True, 1, 1), 6: (False, 0, None)}
    assert sorted(r["text"] or "" for r in decontamination.drop_contaminated(docs, bench).collect()) == ["", "clean", "clean words only"]
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == 5 and decontamination.drop_contaminated(docs.limit(0), bench).count() == 0


def test_seeds_are_rare_or_of_the_rarer_half():
    r = random.Random(2)
    items = decontamination.Items([(k, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(3, 30)))) for k in range(50)], 3)
    frequency = np.array([r.randrange(1000) for _ in items.distinct])
    often = frequency[np.searchsorted(items.distinct, items.gram)]
    keep = often <= 100
    for k in range(50):
        own = [i for i in range(len(often)) if items.item[i] == k]
        keep[sorted(own, key=lambda i: often[i])[: (len(own) + 1) // 2]] = True
    got = items.seeds(frequency, 100)
    assert got.item.tolist() == items.item[keep].tolist() and got.at.tolist() == items.at[keep].tolist()


def planted_contexts(n=120, seed=4):
    """Texts in which numbers follow the same few words; a third of the numbers has a form that no base pattern knows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(6))
    phone = lambda: f"+49 {r.randrange(100, 999)} {r.randrange(10**6, 10**7)}"
    hidden = lambda: f"{r.randrange(100, 999)}/{r.randrange(10**6, 10**7)}"
    rows = []
    for d in range(n):
        for lead in ("please call", "phone number"):
            rows.append((len(rows), f"{word()} {word()} {lead} {hidden() if d % 3 == 0 else phone()} today {word()}"))
    return rows + [(10_000 + k, f"{word()} in year {1900 + k} {word()} {word()}") for k in range(50)]


def test_hidden_identifiers_are_found_by_their_contexts(spark):
    """Numbers in no base form are found where known ones stand in the same contexts; other numbers are left alone."""
    rows = planted_contexts()
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hidden = {d for d, t in rows if "/" in t}
    found = {d for d, r in got.items() if len(r["spans"]) > len(r["base"])}
    assert len(found & hidden) >= 0.9 * len(hidden) and not found - hidden
    assert all(t[s["start"] : s["end"]].replace("/", "").isdigit() for d, t in rows if d in found for s in got[d]["spans"])


def test_redact_edges(spark):
    """Ids that are text, null or repeated, null texts and clashing names; what the contexts tell goes too."""
    rows = [(f"{d:05d}", t) for d, t in planted_contexts()] + [(None, None), (None, "mail a@b.cd"), ("00001", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({n: F.lit("mine") for n in ("pii_key", "pii_added", "key", "kind")})
    out = pii.redact(docs)
    assert out.columns == docs.columns and pii.redact(docs.limit(0)).count() == 0
    got = out.collect()
    assert len(got) == len(rows) and {r["pii_key"] for r in got} == {"mine"} and sum(r["text"] is None for r in got) == 1
    assert sum("/" in (r["text"] or "") for r in got) <= 8 and "mail [EMAIL]" in {r["text"] for r in got}
    assert pii.instance_of("x" * 90 + "1") != pii.instance_of("x" * 90 + "2") and "@" in pii.instance_of("y" * 100 + "@")


def test_a_line_of_many_unlike_documents_makes_few_pairs(spark, monkeypatch):
    """The order is mended: no set meets another only because both have the line."""
    monkeypatch.setattr(simhash, "CROWD", 20)
    monkeypatch.setattr(simhash, "common_grams", lambda texts: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    pairs, only_possible = [], simhash.only_possible

    def counted(found, nodes, similarity):
        pairs.append(found.count())
        return only_possible(found, nodes, similarity)

    monkeypatch.setattr(simhash, "only_possible", counted)
    r = random.Random(9)
    line = " ".join(f"licence{i}" for i in range(25))
    rows = [(d, " ".join(f"w{r.randrange(10**6)}" for _ in range(30)) + " " + line) for d in range(600)]
    rows += [(1000 + d, rows[d][1] + " extra") for d in range(10)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(600))
    assert sum(pairs) < 3000  # 360 000 where all that share the line meet


def test_context_words_are_whole_however_long_or_far():
    assert pii.patterns("a" + " " * 5000 + "b" + " " * 5000 + "1234" + "\n" * 5000 + "c", 10_002, 10_006) == ["a b _", "b _ c"]
    long = "x" * 500
    first, second = pii.patterns(f"{long} at 1234 {long}y", 504, 508)
    assert len(first) < 80 and first != pii.patterns(f"{long}x at 1234", 505, 509)[0] and first.endswith(" at _") and second.startswith("at _ ")
    assert pii.patterns("1234", 0, 4) == []
