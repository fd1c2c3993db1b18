"""Page geometry as column expressions: boxes, strips and sizes; pixels are out of scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import col

CROP_LABELS = ("text", "figure", "table", "full_page")


def strips(height: Column | str, n: int = 10, overlap: int = 20) -> Column:
    """n horizontal strips as array of (number, y0, y1); overlap is a share of a strip's height in percent."""
    h = col(height)
    tall = F.floor(h / n).cast("int")
    over = F.floor(tall * overlap / 100).cast("int")

    def one(i: Column) -> Column:
        y = F.greatest(F.lit(0), i * tall - i * over)
        return F.struct(i.alias("number"), y.alias("y0"), F.least(h.cast("int"), y + tall + over).alias("y1"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def font_scale(average: Column | str, least: int = 24) -> Column:
    """Factor that makes words of an average height readable: enlarged below, shrunk a little less than it could be if far above."""
    ratio = F.lit(float(least)) / F.nullif(col(average).cast("double"), F.lit(0.0))
    return F.when(ratio > 1, ratio).when(ratio < 0.9, ratio + 0.1).otherwise(F.lit(1.0))


def scaled(width: Column | str, height: Column | str, factor: Column | str) -> Column:
    return F.struct((col(width) * col(factor)).cast("int").alias("width"), (col(height) * col(factor)).cast("int").alias("height"))


def fitted(width: Column | str, height: Column | str, max_width: int, max_height: int) -> Column:
    """(width, height) shrunk with its ratio to the largest width and then to the largest height, halves to even."""
    w, h = col(width).cast("double"), col(height).cast("double")
    h1 = F.when(w > max_width, F.bround(h * max_width / w, 0)).otherwise(h)
    w1 = F.least(w, F.lit(float(max_width)))
    w2 = F.when(h1 > max_height, F.bround(w1 / h1 * max_height, 0)).otherwise(w1)
    return F.struct(w2.cast("int").alias("width"), F.least(h1, F.lit(float(max_height))).cast("int").alias("height"))


def padded_to_ratio(width: Column | str, height: Column | str, target_width: int, target_height: int) -> Column:
    """(height, top) of a page padded with white to a ratio; top is the padding above."""
    new = (col(width) / (F.lit(target_width) / F.lit(target_height))).cast("int")
    same = col(width) / col(height) == F.lit(target_width) / F.lit(target_height)
    tall = F.when(same, col(height).cast("int")).otherwise(new)
    return F.struct(tall.alias("height"), F.floor((tall - col(height)) / 2).cast("int").alias("top"))


def large_enough(width: Column | str, height: Column | str, least_width: int = -1, least_height: int = -1) -> Column:
    """Strictly larger both ways; -1 keeps all."""
    return (col(width) > least_width) & (col(height) > least_height)


def scaled_box(box: dict[str, Column | str], page_width: Column | str, page_height: Column | str, model_width: int = 768, model_height: int = 1024) -> Column:
    """Box of the detector's page in the pixels of the real page, truncated before and after the scaling."""
    x, y = col(page_width) / F.lit(model_width), col(page_height) / F.lit(model_height)
    to = lambda name, ratio: (col(box[name]).cast("int") * ratio).cast("int").alias(name)
    return F.struct(to("x1", x), to("y1", y), to("x2", x), to("y2", y))


def box_is_sound(box: Column | str, page_width: Column | str, page_height: Column | str) -> Column:
    """Inside the page, with an area of 10 at least."""
    b = col(box)
    return (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= col(page_width)) & (b["y2"] <= col(page_height)) & ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) >= 10)


def sampled_frames(frames: Column | str, most: int) -> Column:
    """All frames, or `most` of them evenly spread from the first to the last."""
    a = col(frames)
    n = F.size(a)
    if most == 1:
        return F.when(n <= 1, a).otherwise(F.slice(a, 1, 1))
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * ((n - 1) / F.lit(float(most - 1)))).cast("int"))
    return F.when(n <= most, a).otherwise(F.transform(places, lambda p: F.get(a, p)))
