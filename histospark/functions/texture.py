"""Statistics of co-occurrence matrices given as rows (i, j, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooccurrence(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows (i, j, c) from rows of pairs (i, j)."""
    return pairs.groupBy(*(keys or []), "i", "j").agg(F.count(F.lit(1)).alias("c"))


def texture_features(matrix: DataFrame, keys: list[str] | None = None, k: int = 1) -> DataFrame:
    """Per ``keys``: inertia, energy, entropy (sum of p log2 p, without a minus), homogeneity, maximum_probability, mx, my,
    cluster_shade and cluster_prominence (powers 3 and 4 of k + j - mx - my, with k constant).

    Powers of j are summed as integers, so one aggregation is enough for all of it.
    """
    keys = keys or []
    i, j, c = (F.col(n).cast("long") for n in "ijc")
    sums = {
        "n": F.sum(c), "d2": F.sum((i - j) * (i - j) * c), "cc": F.sum(c * c), "top": F.max(c), "si": F.sum(i * c),
        "hom": F.sum(c / (1 + (i - j) * (i - j))), "clogc": F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)),
        **{f"j{e}": F.sum(c * F.pow(j, F.lit(e)).cast("long")) for e in (1, 2, 3, 4)},
    }
    s = matrix.groupBy(*keys).agg(*[v.alias(n) for n, v in sums.items()])
    n = F.col("n").cast("double")
    mx, my = F.col("si") / n, F.col("j1") / n
    a = F.lit(float(k)) - mx - my
    e1, e2, e3, e4 = (F.col(f"j{e}") / n for e in (1, 2, 3, 4))
    return s.select(
        *keys,
        (F.col("d2") / n).alias("inertia"),
        (F.col("cc") / (n * n)).alias("energy"),
        (F.col("clogc") / n - F.log2(n)).alias("entropy"),
        (F.col("hom") / n).alias("homogeneity"),
        (F.col("top") / n).alias("maximum_probability"),
        mx.alias("mx"),
        my.alias("my"),
        (e3 + 3 * a * e2 + 3 * a * a * e1 + a * a * a).alias("cluster_shade"),
        (e4 + 4 * a * e3 + 6 * a * a * e2 + 4 * a * a * a * e1 + a * a * a * a).alias("cluster_prominence"),
    )
