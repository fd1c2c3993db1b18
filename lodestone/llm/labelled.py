"""A bounded sample of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a fit takes at most, those with the lowest hash of their id.
PER_CLASS = 2000


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int = PER_CLASS) -> tuple[list[str], list[int], float]:
    """Texts and labels, and the share of ones among all such rows, of at most per_class rows of each class whose fold isn't held out.

    docs: doc_id, text. Rows without a label or an id, or with a label other than 0 and 1, take no part; an id with
    several labels counts as 1 if one of them is. At most 2 * per_class ids are broadcast, and as many texts collected.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit(7))
    ids = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    rows = docs.join(F.broadcast(ids[0].union(ids[1])), "doc_id").select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    share = known.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("share")).first()["share"]
    return [r["text"] for r in rows], [r["label"] for r in rows], share
