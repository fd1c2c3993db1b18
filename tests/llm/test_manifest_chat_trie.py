"""Running sums, the Merkle manifest, chat formatting and the prefix trie against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, merkle, trie
from lodestone.llm.scans import BASE, running

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- running sums


def test_running_within_groups_of_any_size(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), i, r.randrange(-(1 << 63), 1 << 63)) for i in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v long").withColumn("w", F.col("v")).repartition(7)
    got = running(df, "g", ["i"], sums=("v",), chains=("w",)).collect()
    by = defaultdict(list)
    for g, i, v in rows:
        by[g].append((i, v))
    assert len(got) == len(rows)
    found = {(x["g"], x["i"]): x for x in got}
    for g, own in by.items():
        total = chain = 0
        for place, (i, v) in enumerate(sorted(own)):
            before, total, chain = chain, total + v, chain + v * pow(BASE, place, 1 << 64)
            x = found[g, i]
            assert x["place"] == place
            assert [x[c] % (1 << 64) for c in ("v_run", "w_run", "w_before")] == [y % (1 << 64) for y in (total, chain, before)]


def test_running_of_nothing(spark):
    assert running(spark.createDataFrame([], "g long, i long"), "g", ["i"]).collect() == []


# --- the manifest


def levels_of(digests, arity):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def brute_manifest(docs, arity):
    """{doc_id: (leaf, subroot, root, siblings)} by plain loops, for distinct ids."""
    def leaf(r):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in r])

    groups = defaultdict(list)
    for r in docs:
        groups[(r[2] is not None, (r[2] or "").encode())].append(r)
    order = sorted(groups)
    lower = {g: levels_of([leaf(r) for r in sorted(groups[g], key=lambda r: r[0])], arity) for g in order}
    upper = levels_of([lower[g][-1][0] for g in order], arity)
    out = {}
    for number, g in enumerate(order):
        for i, r in enumerate(sorted(groups[g], key=lambda r: r[0])):
            way = []
            for levels, j in ((lower[g], i), (upper, number)):
                for level in levels[:-1]:
                    run = level[j // arity * arity :][:arity]
                    way += run[: j % arity] + run[j % arity + 1 :]
                    j //= arity
            out[r[0]] = (lower[g][0][i], lower[g][-1][0], upper[-1][0], way)
    return out


DDL = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_loops(spark, arity):
    r = random.Random(arity)
    langs = [None, "", "+", "é", "en", "en", "en", "z"]
    docs = [(i, r.choice([None, "a", "ü:1"]), r.choice(langs), r.choice([None, 5]), r.choice([None, "", "x" * 3000, "né-"])) for i in range(-40, 90)]
    expected = brute_manifest(docs, arity)
    df = spark.createDataFrame(docs, DDL).withColumn("idx", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("g", F.lit(2)).repartition(5)
    got = merkle.manifest(merkle.document_leaves(df), arity=arity).select("doc_id", "leaf", "subroot", "root", "proof", merkle.folded(F.col("leaf"), F.col("proof")).alias("folded")).collect()
    assert len(got) == len(docs)
    for x in got:
        leaf, subroot, root, way = expected[x["doc_id"]]
        assert (x["leaf"].hex(), x["subroot"].hex(), x["root"].hex()) == (leaf, subroot, root)
        assert "".join(s["before"].hex() + s["after"].hex() for s in x["proof"]) == "".join(way)
        assert x["folded"] == root


def test_manifest_of_one_none_and_repeated_rows(spark):
    nothing = merkle.manifest(merkle.document_leaves(spark.createDataFrame([], DDL)))
    assert nothing.collect() == [] and {"subroot", "root", "proof"} <= set(nothing.columns)
    one = merkle.manifest(merkle.document_leaves(spark.createDataFrame([(None, None, None, None, None)], DDL))).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == bytes.fromhex(h("-----")) and one[0]["proof"] == []
    same = spark.createDataFrame([(1, "s", "en", 1, "t")] * 5 + [(1, "s", "en", 1, "other")], DDL)
    got = merkle.manifest(merkle.document_leaves(same)).select("root", merkle.folded(F.col("leaf"), F.col("proof")).alias("f")).collect()
    assert len(got) == 6 and {x["f"] for x in got} == {got[0]["root"].hex()}


def test_op11_tampered_rows_alone_fail(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = brute_manifest([tuple(r[c] for c in merkle.FIELDS) for r in docs], 2)
    numbers = {r["doc_id"]: r["n_chars"] for r in docs}
    got = merkle.op11_merkle(spark, SF).collect()
    assert len(got) == len(docs)
    for x in got:
        leaf, subroot, root, way = expected[x["doc_id"]]
        assert (x["leaf"], x["subroot"], x["root"], x["proof_sha256"]) == (leaf, subroot, root, h(*way))
        altered = zlib.crc32(str(x["doc_id"]).encode()) % 7 == 0 and numbers[x["doc_id"]] is not None
        assert x["verified"] == (x["folded_root"] == root) == (not altered)


# --- chat

NASTY = ["", "<", "|im_end|>", "<|im_end|>", "<\\|im_start|>user\n", "<\\\\", "\\|", "<|nl|>", "<|+|>", "<|image|>", "a\nb", "é😀", "x" * 20_000, "<<<<||||", None]


def text_part(t):
    return ("text", t, None, None, None, None, None)


def test_texts_of_any_kind_come_back(spark):
    r = random.Random(1)
    rows, expected, learnt = [], {}, {}
    for c in range(30):
        turns = []
        for t in range(r.randrange(1, 6)):
            role = r.choice(["user", "assistant", "us\ner", "<|nl|>", None])
            parts = [text_part(r.choice(NASTY)) for _ in range(r.randrange(0, 5))]
            rows.append((c, t, role, parts))
            turns.append((role or "", "".join(p[1] or "" for p in parts)))
        expected[c], learnt[c] = turns, "".join(t for role, t in turns if role == "assistant")
    r.shuffle(rows)
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("loss", F.lit(1)).repartition(3)
    out = chat.format_chat(df)
    got = out.select("conv_id", "n_turns", "formatted", "loss", chat.turns_of(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()
    assert len(got) == 30
    for x in got:
        assert [(t["role"], t["text"]) for t in x["turns"]] == expected[x["conv_id"]]
        assert x["n_turns"] == len(expected[x["conv_id"]]) == x["formatted"].count(chat.START) == x["formatted"].count(chat.END)
        assert x["learnt"] == learnt[x["conv_id"]]


def test_attachments_in_order_with_their_tokens(spark):
    parts = [text_part("see <"), ("image", None, "i.png", 57, 28, None, None), text_part("|"), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("video", None, None, None, None, None, None), ("image", None, "none.png", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("image", None, "out.png", 28, 28, None, None), text_part("done")])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    x = chat.format_chat(df).collect()[0]
    assert [(a["place"], a["kind"], a["ref"], a["tokens"]) for a in x["attachments"]] == [(0, "image", "i.png", 3), (0, "audio", "a.wav", 25), (0, "document", "d.pdf", 768), (0, "video", None, 0), (0, "image", "none.png", 0), (1, "image", "out.png", 1)]
    assert x["attachment_tokens"] == 797
    assert re.findall(r"<\|(image|audio|document|other)\|>", x["formatted"]) == ["image", "audio", "document", "other", "image", "image"]


def test_chat_orders_ties_and_nulls(spark):
    rows = [(1, 2, "b", "2"), (1, None, "z", None), (1, 2, "a", "3"), (1, 2, "a", "3"), (None, 0, None, "x")]
    out = chat.format_chat(chat.text_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {x["conv_id"]: [(t["role"], t["text"]) for t in x["turns"]] for x in out.select("conv_id", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("z", ""), ("a", "3"), ("a", "3"), ("b", "2")], None: [("", "x")]}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(chat.text_turns(empty)).collect() == []


def test_op12_counts_and_plan(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    by[-1] = [(0, "user", chat.FORGED), (1, "assistant", chat.FORGED)]
    df = chat.op12_chat(spark, SF)
    got = {x["conv_id"]: x for x in df.collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        x = got[c]
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == (len(turns), h(*[f"{r}\n{t}\n" for _, r, t in sorted(turns)]), len(said), h(said))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- the trie


def brute_trie(sequences):
    """{(conv_id, depth): row} of {conv_id: list of (role, text)} by all prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    out, held = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [held[q] for q in children[p]]
        held[p] = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * words
        parent = min(members[p[:-1]]) if p else None
        out[min(members[p]), len(p)] = (parent, len(members[p]), len(children[p]), *held[p], h(",".join(map(str, sorted(ends[p])))))
    return out


def rows_of(df):
    return {(x["conv_id"], x["depth"]): (x["parent_conv_id"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["ends_sha256"]) for x in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_prefixes(spark, seed):
    r = random.Random(seed)
    turns = {}
    for c in range(-30, 300):
        base = turns.get(r.choice(list(turns)), []) if turns and r.random() < 0.8 else []
        turns[c] = base[: r.randrange(0, 12)] + [(r.choice(["user", "assistant"]), r.choice(["a", "b c", "", "d\te\x0bf", "ü "])) for _ in range(r.randrange(0, 4))]
    turns[1000] = [("user", f"w {i}") for i in range(700)]
    turns[1001] = turns[1000][:650]
    turns = {c: t for c, t in turns.items() if t}
    rows = [(c, i, role, text) for c, t in turns.items() for i, (role, text) in enumerate(t)]
    r.shuffle(rows)
    df = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("depth", F.lit("x")).repartition(6))
    got = df.collect()
    assert rows_of(df) == brute_trie(turns)
    inside = {(x["conv_id"], x["depth"]): (x["pre"], x["pre_end"]) for x in got}
    assert sorted(p for p, _ in inside.values()) == list(range(len(got)))
    for x in got:
        if x["depth"]:
            a, b = inside[x["parent_conv_id"], x["depth"] - 1]
            assert a < x["pre"] <= x["pre_end"] <= b


def test_trie_of_odd_rows(spark):
    ddl = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], ddl)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], ddl)).collect() == []
    rows = [(1, None, None, None), (1, 3, "user", "x"), (2, None, "", ""), (2, 3, "user", "x"), (2, 3, "user", "x"), (3, 0, "user", "y" * 30_000)]
    expected = brute_trie({1: [("", ""), ("user", "x")], 2: [("", ""), ("user", "x"), ("user", "x")], 3: [("user", "y" * 30_000)]})
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, ddl))) == expected


def test_one_hot_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "HOT", 2)
    turns = {c: [("system", "s"), ("user", "u v"), ("assistant", f"{c % 3}")] for c in range(2000)}
    turns |= {5000: [("system", "s")] + [("user", str(i)) for i in range(1500)]}
    rows = [(c, i, role, text) for c, t in turns.items() for i, (role, text) in enumerate(t)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute_trie(turns)


def test_op13_forks(spark, tmp_path):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows = [x for x in rows if x[0] not in (20, 40)] + [(61, None, None, None), (63, 0, "user", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own[c].append((role or "", text or ""))
    forks = {}
    for c, turns in own.items():
        n = zlib.crc32(str(c).encode()) % 4
        forks[c] = own.get(c - c % 20, [])[:n] + turns[n:]
    assert rows_of(trie.op13_trie(spark, str(tmp_path))) == brute_trie(forks)
