"""Text functions as column expressions. All of them stay in the JVM; null in gives null out unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a keyword query leaves out, one list for each language.
ENGLISH_STOP_WORDS = """
a an the is are was were be been being
have has had do does did will would could
should may might shall can to of in for
on with at by from as or and but if
we our you your it its this that these
those i what which who how when where why
not no nor so yet either neither
each few more most other some such than
too very just also about into through during
up down out off over under again then once
here there all any both
""".split()

FRENCH_STOP_WORDS = """
le la les un une des du de au aux
ce cet cette ces mon ton son ma ta sa
nos vos leur leurs
je tu il elle on nous vous ils elles
me te se lui eux
en dans sur sous par pour avec sans entre
vers chez selon lors depuis pendant contre
avant apres
et ou mais donc or ni car que qui quoi
dont si comme puisque parce afin lorsque quand
ainsi sinon sauf
est sont etait etaient etre avoir
ai as avons avez ont
sera serait ete fait fais font
ne pas plus tres aussi bien meme alors puis
encore deja jamais toujours souvent parfois
peu tout tous toute toutes trop moins assez
beaucoup plusieurs certain certains certaines
voici voila notamment quant suite soit
nous developpons actuellement nouveau avons retenu
suivante filtre limiteur isole
""".split()

STOP_WORDS = tuple(dict.fromkeys(ENGLISH_STOP_WORDS + FRENCH_STOP_WORDS))

# Fixed value: the name space of URLs (RFC 4122), in which document ids are made.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def clean_text(c: Column | str) -> Column:
    """Quotation marks made plain, dashes and runs of white space made one blank, ends trimmed."""
    quotes = F.regexp_replace(F.regexp_replace(col(c), "[‘’]", "'"), "[“”]", '"')
    return strip(F.regexp_replace(F.regexp_replace(quotes, "[-–]", " "), r"\s+", " "))


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits of any script, in order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def token_count(c: Column | str) -> Column:
    """How many `tokens` a text has."""
    return F.regexp_count(F.lower(col(c)), F.lit(r"[\p{L}\p{N}]+"))


def bound(value: Column, f) -> Column:
    """f of a value that gives an array, where the value is computed once: a lambda over an array of one binds it."""
    return F.flatten(F.transform(F.array(value), f))


def counted(words: Column | str) -> Column:
    """Array of (term, tf): the distinct members of an array of texts and how often each is there, by one sort."""

    def of(w: Column, starts: Column) -> Column:
        return F.transform(starts, lambda s, i: F.struct(F.get(w, s).alias("term"), (F.coalesce(F.get(starts, i + 1), F.size(w)) - s).cast("long").alias("tf")))

    def first(w: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))

    words = col(words)
    some = bound(F.array_sort(words), lambda w: bound(first(w), lambda starts: of(w, starts)))
    return F.when(F.size(words) > 0, some).otherwise(F.array().cast("array<struct<term: string, tf: bigint>>"))


def ascii_tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits, case kept; hyphens part tokens."""
    return F.regexp_extract_all(col(c), F.lit("([A-Za-z0-9]+)"), F.lit(1))


def keyword_tokens(c: Column | str) -> Column:
    """Tokens of more than one character that are no stop words, case kept."""
    return F.filter(ascii_tokens(c), lambda t: (F.length(t) > 1) & ~F.lower(t).isin(*STOP_WORDS))


def keywords(c: Column | str) -> Column:
    """Keyword query of a question; an empty text if nothing is left."""
    return F.array_join(keyword_tokens(c), " ")


def query_text(c: Column | str) -> Column:
    """Keyword query, or * (all documents) if no keyword is left."""
    k = keywords(strip(c))
    return F.when(k == "", "*").otherwise(k)


def bm25_clean(c: Column | str) -> Column:
    """Braces, quotation marks, backslashes, underscores and line ends taken out."""
    return F.translate(col(c), '{}"\n\\_', "")


def highlight(c: Column | str, words: list[str]) -> Column:
    """Each of the words, in any case, inside <mark>; longer words first."""
    if not words:
        return col(c)
    import re

    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(col(c), f"(?i)({pattern})", "<mark>$1</mark>")


def alphabetic_keywords(c: Column | str) -> Column:
    """Lower-case words of letters only that are no English stop words; all words if that leaves none."""
    words = F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: w.rlike(r"^\p{L}+$") & ~F.array_contains(F.array(*map(F.lit, ENGLISH_STOP_WORDS)), w))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def truncated(c: Column | str, n: int) -> Column:
    """At most n characters, with ... after a text that was longer."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def strip_thinking(c: Column | str) -> Column:
    """Without a model's thinking block, or all up to its end mark, and without control tokens; trimmed."""
    closed = F.regexp_replace(col(c), "(?s)<think>.*?</think>", "")
    opened = F.regexp_replace(closed, "(?s)^.*?</think>", "")
    return strip(F.regexp_replace(opened, r"<\|[^|]*\|>", ""))


def mask_data_urls(c: Column | str) -> Column:
    """JSON text whose image data URLs are cut down to their start."""
    return F.regexp_replace(col(c), r'"data:image/[^"]*"', '"data:image/..."')


def extract_query(reply: Column | str, question: Column | str) -> Column:
    """The query in a model's JSON reply; null if there is none, or it differs from the question in blanks and ? only."""
    body = F.translate(F.regexp_replace(col(reply), "json", ""), "\n", "")
    found = F.get_json_object(body, "$.query.content")
    plain = lambda x: F.translate(x, " ?", "")
    return F.when((found != "") & (plain(found) != plain(col(question))), found)


def source_header(source: Column | str, page: Column | str, label: Column | str) -> Column:
    """document: S page: P type: T; parts that are null are left out."""
    return F.concat_ws(" ", F.concat(F.lit("document: "), col(source)), F.concat(F.lit("page: "), col(page).cast("string")), F.concat(F.lit("type: "), col(label)))


def context_header(number: Column | str, source: Column | str, page: Column | str, label: Column | str) -> Column:
    """Text source N: S page P type T; a null source is unknown, an empty label counts as none."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("Text source "), col(number).cast("string"), F.lit(": "), F.coalesce(col(source), F.lit("unknown source"))),
        F.concat(F.lit("page "), col(page).cast("string")),
        F.concat(F.lit("type "), F.nullif(col(label), F.lit(""))),
    )


def data_url(c: Column | str) -> Column:
    """PNG bytes as a data URL."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(col(c)), r"\s", ""))


def basename(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def stem(c: Column | str) -> Column:
    """Base name without its last extension; a name that only starts with a dot keeps it."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column | str) -> Column:
    """Lower-cased extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(c), r".\.([^.]+)$", 1))


def uuid5(c: Column | str) -> Column:
    """Name-based UUID (version 5) of a URL or path."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(col(c), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def part_key(source: Column | str, image: Column | str, kind: str = "", number: Column | str | None = None) -> Column:
    """Key of a part: document id, image number from 0 in four digits, and, for crops and chunks, their number."""
    base = F.concat(uuid5(source), F.format_string("_%04d", col(image)))
    if not kind:
        return base
    return F.concat(base, F.lit(f"_{kind}")) if number is None else F.concat(base, F.format_string(f"_{kind}_%04d", col(number)))


KEY = r"^([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})_(\d+)(?:_([a-z]+)(?:_(\d+))?)?$"


def parsed_key(c: Column | str) -> Column:
    """Struct (uuid, page, kind, number) of a key; no kind is image, no number -1; null if it is no key."""
    part = lambda i: F.regexp_extract(col(c), KEY, i)
    number = F.nullif(part(4), F.lit(""))
    return F.when(col(c).rlike(KEY), F.struct(part(1).alias("uuid"), part(2).cast("int").alias("page"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("image")).alias("kind"), F.coalesce(number.cast("int"), F.lit(-1)).alias("number")))


def filled(template: Column | str, **values: Column | str) -> Column:
    """Template with {name} replaced by the value of each name, in turn."""
    out = col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col(value), F.lit("")))
    return out


def html_text(c: Column | str) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags go, block ends become line ends, common entities their characters."""
    out = F.regexp_replace(col(c), r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol|table)\s*>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n"))


def token_windows(c: Column | str, size: int, overlap: int = 0) -> Column:
    """Array of (number, start, text): windows of at most `size` white-space tokens, `overlap` shared; the whole text if size is 0 or less.

    start is the character, from 0, at which the window begins in the text.
    """
    text = col(c)
    if size <= 0:
        return F.array(F.struct(F.lit(0).alias("number"), F.lit(0).alias("start"), text.alias("text")))
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    pieces = F.regexp_extract_all(text, F.lit(r"(\s*\S+)"), F.lit(1))

    def starts(p: Column) -> Column:
        n = F.size(p)
        return F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))

    def before(p: Column) -> Column:
        """Characters before each window, added up over windows rather than over tokens."""
        lengths = F.transform(starts(p), lambda s: F.length(F.array_join(F.slice(p, s + 1, step), "")))
        return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def window(p: Column, at: Column, s: Column, i: Column) -> Column:
        raw = F.array_join(F.slice(p, s + 1, size), "")
        bare = F.regexp_replace(raw, r"^\s+", "")
        return F.struct(i.alias("number"), (F.get(at, i) + F.length(raw) - F.length(bare)).alias("start"), bare.alias("text"))

    return bound(pieces, lambda p: bound(before(p), lambda at: F.transform(starts(p), lambda s, i: window(p, at, s, i))))
