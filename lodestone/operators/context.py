"""From hits to a prompt: the character budget, the blocks of context, the template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import context_header, filled, strip

PER_DOCUMENT, TOTAL = 4000, 16000


def budgeted(hits: Column, per_document: int = PER_DOCUMENT, total: int = TOTAL) -> Column:
    """Fold over an array of structs in rank order, each with `content`: blank ones go, the others are cut to what they and
    the whole may have and trimmed again, until nothing is left of the whole."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(state: Column, hit: Column) -> Column:
        whole = strip(F.coalesce(hit["content"], F.lit("")))
        rest = F.lit(total) - state["used"]
        cut = strip(F.substr(whole, F.lit(1), F.least(F.lit(per_document), F.greatest(rest, F.lit(0)))))
        takes = (whole != "") & (rest > 0) & (cut != "")
        return F.struct(
            F.when(takes, state["used"] + F.length(cut)).otherwise(state["used"]).alias("used"),
            F.when(takes, F.concat(state["out"], F.array(cut))).otherwise(state["out"]).alias("out"),
            F.when(takes, F.concat(state["at"], F.array(state["i"]))).otherwise(state["at"]).alias("at"),
            (state["i"] + 1).alias("i"),
        )

    folded = F.aggregate(hits, start, step)
    return F.zip_with(folded["out"], folded["at"], lambda text, at: F.struct(text.alias("content"), F.get(hits, at).alias("hit")))


def bounded_hits(hits: DataFrame, per_document: int = PER_DOCUMENT, total: int = TOTAL) -> DataFrame:
    """Hits(query_id, rank, source, page_number, crop_label, content) within the budget, as (query_id, number, source, page_number, crop_label, content).

    Lists are short (a question's top hits), so that one row per question holds its list.
    """
    grouped = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "page_number", "crop_label", "content"))).alias("hits"))
    kept = grouped.select("query_id", F.posexplode(budgeted(F.col("hits"), per_document, total)).alias("i", "b"))
    return kept.select("query_id", (F.col("i") + 1).alias("number"), "b.hit.source", "b.hit.page_number", "b.hit.crop_label", F.col("b.content").alias("content"))


def context_text(bounded: DataFrame) -> DataFrame:
    """(query_id, context): a header and the content of each, parted by blank lines."""
    block = F.concat(context_header("number", "source", "page_number", "crop_label"), F.lit("\n"), F.col("content"))
    rows = bounded.select("query_id", "number", block.alias("block"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda s: s["block"]), "\n\n").alias("context"))


def source_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, context) in the plainer form: Source i: S, the content, and a blank line after each."""
    block = F.concat(F.lit("Source "), F.col("rank").cast("string"), F.lit(": "), F.col("source"), F.lit("\n"), F.col("content"), F.lit("\n\n"))
    rows = hits.select("query_id", "rank", block.alias("block"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "").alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """(query_id, prompt): the template with the question and its context."""
    return questions.join(contexts, "query_id", "left").select("query_id", filled(F.lit(template), question="text", context="context").alias("prompt"))
