"""Personal data: seed entities by pattern, and more of them by bootstrapped contextual extraction.

Four kinds have a form that can be told by itself; what matches is a seed. The words around the seeds are lexical
patterns, which other tokens with a digit or an @ fill too. Spark scores the graph of patterns and instances in rounds: a
pattern is as good as the mean score of its instances, an instance that is no seed is as good as its patterns together
make it. Instances that high-confidence patterns agree on become spans of the pattern's kind.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, table, unused

KINDS = ("email", "ip", "card", "phone")
DIGITS = re.compile(r"[0-9]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Distinct seeds that a pattern must have met; rounds; scores from which a pattern and an instance count.
SUPPORT, ROUNDS, CONFIDENT, ACCEPTED = 5, 3, 0.9, 0.8
#: Characters of a token or of a context word above which its hash stands for it.
INSTANCE = 80

PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, each found from its @: the local part is all that may stand before it, as far as no match has it yet."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(end, at + 1))
    return found


def seeds(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end in code points) by kind, then start. Time grows with the text only."""
    out = [("email", a, b) for a, b in emails(text)]
    runs = [m.start() for m in DIGITS.finditer(text)]
    end = 0
    for at in runs:
        if at >= end and (m := ADDRESS.match(text, at)):
            end = m.end()
            if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
                out.append(("ip", at, end))
    end = 0
    for at in runs:
        if at >= end and (m := CARD.match(text, at)):
            end = m.end()
            if end - at >= 16 and 16 <= len(digits := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(digits):
                out.append(("card", at, end))
    if runs and "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def plain(word: str) -> str:
    """A context word in lower case, without punctuation around it, digits made alike; a long one's hash."""
    word = DIGITS.sub("0", word.lower().strip(".,;:!?()[]{}\"'"))
    return word if len(word) <= INSTANCE else xxhash.xxh3_128_hexdigest(word.encode("utf-8", "surrogatepass"))


def words_before(text: str, at: int, n: int) -> list[str]:
    """The last n words before a place, whole ones, however far away; the window grows until it has them."""
    reach = 64
    while True:
        window = text[max(0, at - reach) : at]
        words = window.split()
        if reach >= at or len(words) > n or (len(words) == n and window[0].isspace()):
            return words[-n:]
        reach *= 4


def word_after(text: str, at: int) -> list[str]:
    """The next word from a place on, as a list of at most one."""
    reach = 64
    while True:
        window = text[at : at + reach]
        words = window.split()
        if at + reach >= len(text) or len(words) > 1 or (words and window[-1].isspace()):
            return words[:1]
        reach *= 4


def patterns(text: str, start: int, end: int) -> list[str]:
    """Contexts of a span: the two words before it, and the words on both sides."""
    before, after = list(map(plain, words_before(text, start, 2))), list(map(plain, word_after(text, end)))
    return ([f"{before[0]} {before[1]} _"] if len(before) == 2 else []) + ([f"{before[-1]} _ {after[0]}"] if before and after else [])


def instance_of(token: str) -> str:
    """A token's name in the graph; a long one's is a hash of all of it, with its @ and as many of its digits as are asked for."""
    if len(token) <= INSTANCE:
        return token
    digest = xxhash.xxh3_128_hexdigest(token.encode("utf-8", "surrogatepass")).translate({ord(c): chr(ord("g") + k) for k, c in enumerate("0123456789")})
    return digest + "@" * ("@" in token) + "".join(DIGITS.findall(token))[:4]


def occurrences(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, str, str | None, int, int]]:
    """(pattern, instance, kind or None, start, end) of the seeds and of all other tokens with a digit or an @."""
    out = [(p, instance_of(text[a:b]), kind, a, b) for kind, a, b in found for p in patterns(text, a, b)]
    taken = sorted((a, b) for _, a, b in found)
    k = end = 0
    for at in sorted([*(m.start() for m in DIGITS.finditer(text)), *(m.start() for m in re.finditer("@", text))]):
        if at < end:
            continue
        a = at
        while a > end and not text[a - 1].isspace():
            a -= 1
        b = at + 1
        while b < len(text) and not text[b].isspace():
            b += 1
        end = b
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        core = text[a:b]
        a, b = a + len(core) - len(core.lstrip("([{\"'")), b - len(core) + len(core.rstrip(".,;:!?)]}\"'"))
        if a < b:
            out += [(p, instance_of(text[a:b]), None, a, b) for p in patterns(text, a, b)]
    return out


SPAN = "array<struct<kind:string,start:long,end:long>>"
SEEN = "array<struct<pattern:string,instance:string,kind:string,start:long,end:long>>"


def row_key(id_col: str, text_col: str) -> Column:
    """A key that is the same for the same id and text."""
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text).cast("string"), F.length(text).cast("string"))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and key."""
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(doc_id.alias("doc_id"), text.alias("text"), row_key(id_col, text_col).alias("key"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, seen) of each row: the seeds, and all occurrences with their patterns."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    seen = pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("base", pa.list_(span)), ("seen", pa.list_(seen))])

    def run(parts):
        for part in parts:
            base, occ = [], []
            for value in part.column(1):
                text = value.as_py()
                found = seeds(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                occ.append([{"pattern": p, "instance": i, "kind": k, "start": a, "end": b} for p, i, k, a, b in occurrences(text, found)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(base, schema.field("base").type), pa.array(occ, schema.field("seen").type)], schema=schema)

    return docs.mapInArrow(run, f"doc_id long, key string, base {SPAN}, seen {SEEN}")


def discovered(scanned: DataFrame, *, support: int = SUPPORT, rounds: int = ROUNDS, confident: float = CONFIDENT, accepted: float = ACCEPTED) -> DataFrame:
    """(key, kind, start, end) of the spans that no seed has, by the graph of patterns and instances.

    Only patterns that met `support` distinct seeds of a kind enter the graph; each round aggregates a score for each
    pattern and then for each instance, with partial sums before the shuffle.
    """
    occ = scanned.select("key", F.explode("seen").alias("s")).select("key", "s.*")
    pairs = occ.groupBy("pattern", "instance").agg(F.max("kind").alias("seed"))
    induced = pairs.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern", "kind")
    graph = checkpointed(pairs.join(induced, "pattern").select("pattern", "kind", "instance", F.when(F.col("seed") == F.col("kind"), 1.0).otherwise(0.0).alias("fixed")))
    scored = graph.withColumn("score", F.col("fixed"))
    for _ in range(rounds):
        good = scored.groupBy("pattern", "kind").agg(F.avg("score").alias("confidence"))
        told = graph.join(good, ["pattern", "kind"])
        instance = told.groupBy("kind", "instance").agg(F.max("fixed").alias("f"), (1 - F.exp(F.sum(F.log1p(-F.lit(0.95) * F.col("confidence"))))).alias("told")).select("kind", "instance", F.greatest("f", "told").alias("score"))
        scored = checkpointed(graph.join(instance, ["kind", "instance"]).select("pattern", "kind", "instance", "fixed", "score"))
    good = scored.groupBy("pattern", "kind").agg(F.avg("score").alias("confidence")).where(F.col("confidence") >= confident)
    digits = F.length(F.regexp_replace("instance", "[^0-9]", ""))
    fits = F.when(F.col("kind") == "email", F.col("instance").contains("@")).otherwise(digits >= 4)
    new = scored.where((F.col("fixed") == 0) & (F.col("score") >= accepted) & fits).join(good, ["pattern", "kind"]).select("pattern", "instance", F.col("kind").alias("found"))
    return occ.where("kind is null").join(new, ["pattern", "instance"]).select("key", F.col("found").alias("kind"), "start", "end").distinct()


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def find_pii(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """(doc_id, base, spans) of every row: the seeds, and all spans, each by kind and then by start.

    Null and empty texts have none; rows that repeat an id or a text are reported each for itself; an id may be null; no
    rows give no rows. Only the two columns are read.
    """
    scanned = checkpointed(scan(keyed(df, id_col, text_col)))
    added = discovered(scanned, support=support).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    both = F.concat("base", F.coalesce("added", F.array().cast(SPAN)))
    ordered = F.transform(F.array_sort(F.transform(both, lambda s: F.struct(rank(s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(added, "key", "left").select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(ordered).alias("spans"))


def redact(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """df with every span of its text replaced by its kind in brackets; overlapping spans become one, named after the first.

    The other columns stay as they are, whatever their names, and so do rows without a span. Null texts stay null; ids
    may be null or repeat; no rows give no rows.
    """
    found = discovered(checkpointed(scan(keyed(df, id_col, text_col))), support=support).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    names, text_at = df.columns, df.columns.index(text_col)
    tag, extra = unused(df, "pii_key"), unused(df, "pii_added")
    joined = df.withColumn(tag, row_key(id_col, text_col)).join(found.select(F.col("key").alias(tag), F.col("added").alias(extra)), tag, "left").select(*[f"`{n}`" for n in names], extra)

    def run(parts):
        for part in parts:
            texts = [None if t is None else redacted(t, [(s["kind"], s["start"], s["end"]) for s in e or ()]) for t, e in zip(part.column(text_at).to_pylist(), part.column(len(names)).to_pylist())]
            columns = [part.column(i) if i != text_at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, df.schema)


def redacted(text: str, added: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in sorted([*seeds(text), *added], key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], PLACEHOLDER[kind]]
        end = max(end, b)
    return "".join(out) + text[end:]


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans in every document."""
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base")["kind"], lambda s: s == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
