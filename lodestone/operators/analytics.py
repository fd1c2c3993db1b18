"""Reports over results and embeddings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_distribution(ranked: DataFrame) -> DataFrame:
    """Per query and source: first rank, hits, and the distance of the first hit."""
    return ranked.groupBy("query_id", "source").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n"), F.min_by("distance", "rank").alias("best_distance"))


def expected_hits(ranked: DataFrame, source: str) -> DataFrame:
    """Hits of one source with their distance from the first hit, absolute and in percent; null where that is at 0."""
    top = F.first("distance").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    gap = F.col("distance") - F.col("top")
    return ranked.withColumn("top", top).where(F.col("source") == source).select("query_id", "rank", "distance", gap.alias("gap"), F.when(F.col("top") != 0, 100 * gap / F.col("top")).alias("gap_percent"))


def query_variants(ranked: DataFrame, source: str, base: str) -> DataFrame:
    """Per variant(variant, rank, source, distance): nearest source, rank and distance of the expected one, and its gain in ranks over `base`."""
    per = ranked.groupBy("variant").agg(F.min_by("source", "rank").alias("top_source"), F.min(F.when(F.col("source") == source, F.col("rank"))).alias("expected_rank"), F.min_by("distance", F.when(F.col("source") == source, F.col("rank"))).alias("expected_distance"))
    reference = per.where(F.col("variant") == base).select(F.col("expected_rank").alias("base_rank"))
    return per.join(F.broadcast(reference)).withColumn("gained", F.col("base_rank") - F.col("expected_rank")).drop("base_rank")


def rank_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two lists(query_id, rank, source, distance) side by side by rank, with whether the source differs."""
    a = first.select("query_id", "rank", F.col("source").alias("first_source"), F.col("distance").alias("first_distance"))
    b = second.select("query_id", "rank", F.col("source").alias("second_source"), F.col("distance").alias("second_distance"))
    return a.join(b, ["query_id", "rank"], "full_outer").withColumn("changed", ~F.col("first_source").eqNullSafe(F.col("second_source")))


def _vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull()).select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(id, projection), and the share of the variance of each component."""
    model = PCA(k=k, inputCol="features", outputCol="p").fit(_vectors(vectors))
    return model.transform(_vectors(vectors)).select("id", vector_to_array("p").alias("projection")), [float(x) for x in model.explainedVariance]


def components_for(vectors: DataFrame, size: int, share: float = 0.95) -> DataFrame:
    """(component, variance, cumulated, needed): how many components explain a share of the variance."""
    _, variance = pca(vectors, size)
    rows = vectors.sparkSession.createDataFrame(list(enumerate(variance, 1)), "component int, variance double")
    total = rows.withColumn("cumulated", F.sum("variance").over(Window.orderBy("component")))
    return total.withColumn("needed", F.min(F.when(F.col("cumulated") >= share - 1e-12, F.col("component"))).over(Window.partitionBy()))


def cluster_choices(vectors: DataFrame, most: int = 10, seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette) for 2 to `most` clusters, fewer than there are vectors."""
    data = _vectors(vectors).cache()
    rows = []
    for k in range(2, min(most, data.count() - 1) + 1):
        model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(data)))))
    data.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def clustered(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    data = _vectors(vectors)
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def cluster_profile(rows: DataFrame, value: str, top: int = 3) -> DataFrame:
    """(cluster, rank, value, n): the commonest values in each cluster, ties to the smaller value."""
    counts = rows.groupBy("cluster", value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("cluster", "rank", F.col(value).alias("value"), "n")


def binned(points: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Points per square of a plane."""
    return points.groupBy(F.floor(F.col(x) / width).cast("long").alias("bx"), F.floor(F.col(y) / width).cast("long").alias("by")).agg(F.count("*").alias("n"))


def hexagons(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """(q, r, n, x, y): points per hexagon of a plane, by axial coordinates, with the hexagon's middle.

    size: from the middle to a corner; corners point up. A point goes to the hexagon whose middle is nearest, found by
    rounding the three cube coordinates and mending the one that rounding moved most.
    """
    q0 = (F.col(x) * math.sqrt(3) / 3 - F.col(y) / 3) / size
    r0 = F.col(y) * 2 / 3 / size
    cube = points.select(q0.alias("q0"), r0.alias("r0")).select("q0", "r0", F.floor(F.col("q0") + 0.5).alias("q"), F.floor(F.col("r0") + 0.5).alias("r"), F.floor(-F.col("q0") - F.col("r0") + 0.5).alias("s"))
    dq, dr, ds = F.abs(F.col("q") - F.col("q0")), F.abs(F.col("r") - F.col("r0")), F.abs(F.col("s") + F.col("q0") + F.col("r0"))
    q = F.when((dq > dr) & (dq > ds), -F.col("r") - F.col("s")).otherwise(F.col("q"))
    r = F.when(((dq > dr) & (dq > ds)) | (dr <= ds), F.col("r")).otherwise(-F.col("q") - F.col("s"))
    counts = cube.groupBy(q.cast("long").alias("q"), r.cast("long").alias("r")).agg(F.count("*").alias("n"))
    return counts.select("q", "r", "n", (size * math.sqrt(3) * (F.col("q") + F.col("r") / 2)).alias("x"), (size * 1.5 * F.col("r")).alias("y"))


def density(points: DataFrame, x: str, y: str, width: float, bandwidth: float, reach: float = 4.0) -> DataFrame:
    """(bx, by, density): a Gaussian kernel density at the middles of squares, where it reaches; points count at their square's middle.

    The kernel is a product, so that one pass spreads counts along x and another along y; it is cut at `reach` bandwidths.
    """
    steps = math.ceil(reach * bandwidth / width)
    weights = [math.exp(-0.5 * (k * width / bandwidth) ** 2) / (bandwidth * math.sqrt(2 * math.pi)) for k in range(-steps, steps + 1)]
    kernel = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-steps, steps + 1), weights)])).alias("e")
    total = points.count()
    cells = binned(points, x, y, width).select("bx", "by", (F.col("n") / F.lit(float(max(total, 1)))).alias("v"))
    along_x = cells.select("bx", "by", "v", kernel).groupBy((F.col("bx") + F.col("e.k")).alias("bx"), "by").agg(F.sum(F.col("v") * F.col("e.w")).alias("v"))
    return along_x.select("bx", "by", "v", kernel).groupBy("bx", (F.col("by") + F.col("e.k")).alias("by")).agg(F.sum(F.col("v") * F.col("e.w")).alias("density"))


def ward_merges(means: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(first, second, height, size) of Ward's merges of clusters, by height; new ones are numbered on.

    Follows nearest neighbours until two are each other's, which are merged; so no table of all distances is kept.
    """
    means, sizes = [np.asarray(m, np.float64) for m in means], [float(s) for s in sizes]
    alive, chain, found = set(range(len(means))), [], []

    def cost(i: int, j: int) -> float:
        d = means[i] - means[j]
        return math.sqrt(2 * sizes[i] * sizes[j] / (sizes[i] + sizes[j]) * float(d @ d))

    while len(alive) > 1:
        if not chain:
            chain.append(min(alive))
        at, before = chain[-1], chain[-2] if len(chain) > 1 else None
        rest = np.array(sorted(alive - {at}))
        m, s = np.array([means[k] for k in rest]), np.array([sizes[k] for k in rest])
        costs = 2 * s * sizes[at] / (s + sizes[at]) * ((m - means[at]) ** 2).sum(1)
        best = int(rest[costs.argmin()])
        if before is not None and cost(at, before) <= cost(at, best):
            chain, height, total = chain[:-2], cost(at, before), sizes[at] + sizes[before]
            found.append((at, before, height, total))
            means.append((means[at] * sizes[at] + means[before] * sizes[before]) / total)
            sizes.append(total)
            alive -= {at, before}
            alive.add(len(means) - 1)
        else:
            chain.append(best)
    # in order of height clusters get the numbers that they would have had
    n, number, out = len(means) - len(found), {}, []
    for k in sorted(range(len(found)), key=lambda k: (found[k][2], k)):
        a, b, height, total = found[k]
        number[n + k] = n + len(out)
        first, second = sorted((number.get(a, a), number.get(b, b)))
        out.append((first, second, height, int(total)))
    return out


def ward(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(step, first, second, height, size): the tree that Ward's linkage makes of the clusters of points(cluster, vector, ...).

    Spark sums up each cluster; the tree is made of a mean and a size for each, so that what reaches the driver is as
    large as the number of clusters. Clusters are numbered in their order, merged ones on from there.
    """
    dim = points.select(F.size(vector).alias("n")).first()
    means = points.groupBy(cluster).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dim["n"] if dim else 0)]).alias("m"))
    rows = means.orderBy(cluster).collect()
    merges = ward_merges(np.array([r["m"] for r in rows]), np.array([r["n"] for r in rows])) if rows else []
    return points.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(merges)], "step int, first int, second int, height double, size long")


def distinct_sources(rows: DataFrame) -> DataFrame:
    return rows.select(F.substring_index("source", "/", -1).alias("name")).distinct()


def page_labels(parts: DataFrame) -> DataFrame:
    """Parts(source, page_number, label, pos) with their number within page and label; a missing page is 0."""
    page = F.coalesce("page_number", F.lit(0))
    number = F.row_number().over(Window.partitionBy("source", page, "label").orderBy("pos"))
    return parts.select("source", page.alias("page"), "label", "pos", number.alias("number"))


def word_statistics(boxes: DataFrame) -> DataFrame:
    """Least, mean and largest height of the word boxes of each page; 0 where it has none."""
    h = F.col("y2") - F.col("y1")
    return boxes.groupBy("page").agg(F.coalesce(F.min(h), F.lit(0)).alias("least"), F.coalesce(F.avg(h), F.lit(0.0)).alias("mean"), F.coalesce(F.max(h), F.lit(0)).alias("most"))


def stitched(images: DataFrame, by: str) -> DataFrame:
    """Size of the images of each group stacked vertically."""
    return images.groupBy(by).agg(F.sum("height").alias("height"), F.max("width").alias("width"))
