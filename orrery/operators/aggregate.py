"""One vector a source: aggregators of the embeddings of a source's publications.

Each takes publications (id, source_id, pos, embedding) and gives (source_id, embedding). Sums, order statistics and rankings are
DataFrame plans; iterative linear algebra runs in Python, a source at a time, in single precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import modes as M
from orrery.functions import vectors as V
from orrery.operators import distributed
from orrery.sources import sinks

KEY = ["source_id"]
DEFAULT_MODES = "mean,sum,max,median,cosmean,rm1pc,softmax,geom,medoid,tmean@0.8,winsor@0.1,kmeans@4,pcfuse@2,svdshrink@0.1,huber@0.2,attn2@10,subtrim@3,0.8"


def unit_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", V.unit(F.col("embedding")))


def _renormalised(df: DataFrame) -> DataFrame:
    return df.select(*KEY, V.unit(F.col("embedding")).alias("embedding"))


def mean(df: DataFrame) -> DataFrame:
    return V.aggregate(df, KEY, F.avg)


def total(df: DataFrame) -> DataFrame:
    return V.aggregate(df, KEY, F.sum)


def maximum(df: DataFrame) -> DataFrame:
    return V.aggregate(df, KEY, F.max)


def median(df: DataFrame) -> DataFrame:
    return V.aggregate(df, KEY, lambda x: F.percentile(x, F.lit(0.5)))


def cosmean(df: DataFrame) -> DataFrame:
    return _renormalised(V.aggregate(unit_rows(df), KEY, F.sum))


def _alone(df: DataFrame) -> DataFrame:
    """Each source's number of rows, beside its unit rows. Counted apart: a window over whole sources would hold them together."""
    counts = df.groupBy(*KEY).agg(F.count("*").alias("n"))
    return unit_rows(df).join(counts, "source_id")


def _weighted(df: DataFrame, weight: str) -> DataFrame:
    """Sum of weight * embedding over the sum of weights, by source; where the weights sum to nothing, the plain mean."""
    rows = V.elements(df, KEY, carry=[weight])
    w = F.col(weight)
    x = F.when(F.sum(w) > 0, F.sum(w * F.col("x")) / F.sum(w)).otherwise(F.avg("x"))
    return V.gather(rows.groupBy(*KEY, "i").agg(x.alias("x")), KEY)


def _softmax_weights(df: DataFrame, score: str, tau: float) -> DataFrame:
    peak = df.groupBy(*KEY).agg(F.max(tau * F.col(score)).alias("_peak"))
    return df.join(peak, "source_id").withColumn("_w", F.exp(tau * F.col(score) - F.col("_peak")))


def softmax(df: DataFrame, tau: float = 10.0) -> DataFrame:
    """Weights by likeness to the direction of all publications together."""
    unit = unit_rows(df)
    everyone = V.aggregate(unit.withColumn("_all", F.lit(0)), ["_all"], F.sum, out="g").select(V.unit(F.col("g")).alias("g"))
    scored = unit.crossJoin(F.broadcast(everyone)).withColumn("_s", V.dot(F.col("embedding"), F.col("g"))).drop("g")  # one row
    return _renormalised(_weighted(_softmax_weights(scored, "_s", tau), "_w"))


def _centres(df: DataFrame) -> DataFrame:
    return _renormalised(V.aggregate(df, KEY, F.avg)).withColumnRenamed("embedding", "centre")


def attention(df: DataFrame, tau: float = 10.0) -> DataFrame:
    """Weights by likeness to the source's own centre."""
    unit = unit_rows(df)
    scored = unit.join(_centres(unit), "source_id").withColumn("_s", V.dot(F.col("embedding"), F.col("centre"))).drop("centre")
    return _renormalised(_weighted(_softmax_weights(scored, "_s", tau), "_w"))


def medoid(df: DataFrame, with_id: bool = False) -> DataFrame:
    """The publication whose mean likeness to all of its source is largest; of equals the first.

    The mean of dot products is the dot product with the mean, so no pairs are made.
    """
    unit = unit_rows(df)
    means = V.aggregate(unit, KEY, F.avg, out="m")
    scored = unit.join(means, "source_id").withColumn("_s", F.round(V.dot(F.col("embedding"), F.col("m")), 12))
    best = scored.groupBy(*KEY).agg(F.max_by(F.struct("id", "embedding"), F.struct("_s", -F.col("pos"))).alias("_b"))
    return best.select(*KEY, *([F.col("_b.id").alias("id")] if with_id else []), F.col("_b.embedding").alias("embedding"))


def trimmed_mean(df: DataFrame, p: float = 0.8) -> DataFrame:
    """Mean of the ceil(p n) publications nearest to the source's centre."""
    p = M.clamp(p, 0.05, 1.0)
    rows = _alone(df)
    scored = rows.join(_centres(rows), "source_id").withColumn("_s", V.dot(F.col("embedding"), F.col("centre"))).drop("centre")
    near = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("_s").desc(), "pos"))).where(F.col("_r") <= F.ceil(F.lit(p) * F.col("n")))
    return _renormalised(V.aggregate(near, KEY, F.avg))


def winsorised(df: DataFrame, a: float = 0.1) -> DataFrame:
    """Mean after clipping each element to its quantiles a and 1 - a; fewer than five publications are left unclipped."""
    a = M.clamp(a, 0.0, 0.49)
    rows = _alone(df)
    if a > 0:
        # both quantiles come from one pass; gathered to two vectors a source, so that the rows are joined whole
        cuts = V.elements(rows, KEY).groupBy(*KEY, "i").agg(F.percentile("x", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
        packed = cuts.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("_c")).select(*KEY, F.transform("_c", lambda c: c["q"][0]).alias("_low"), F.transform("_c", lambda c: c["q"][1]).alias("_high"))
        clipped = F.zip_with(F.zip_with("embedding", "_low", lambda x, y: F.greatest(x, y)), "_high", lambda x, y: F.least(x, y))
        rows = rows.join(packed, "source_id").withColumn("embedding", F.when(F.col("n") < 5, F.col("embedding")).otherwise(clipped)).drop("_low", "_high")
    return _renormalised(V.aggregate(rows, KEY, F.avg))


def without_first_component(df: DataFrame) -> DataFrame:
    """cosmean less its part along the first (uncentred) principal direction of all sources' cosmeans."""
    c = sinks.stored(cosmean(df), "cosmean")  # one vector a source; read twice

    def gram(batches):
        import pandas as pd

        total = None
        for b in batches:
            x = np.stack(b["embedding"])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    # dimension x dimension numbers, whatever the number of sources
    parts = V.aggregate(c.mapInPandas(gram, "i int, row array<double>").withColumnRenamed("i", "k"), ["k"], F.sum, vector="row", out="row").orderBy("k").collect()
    if not parts:
        return c
    _, v = np.linalg.eigh(np.array([r["row"] for r in parts]))
    first = F.lit([float(x) for x in v[:, -1]])
    along = V.dot(F.col("embedding"), first)
    rest = F.get(F.transform(F.array(along), lambda s: F.zip_with("embedding", first, lambda x, y: x - s * y)), F.lit(0))
    return c.select(*KEY, V.unit(rest).alias("embedding"))


# --- grouped: numerics on one source's matrix -------------------------------------------------------------------------


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n < V.TINY, 1.0, n)


def by_size(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], apart: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """Sources that fit a task by the kernel, larger ones by rounds over all rows."""
    large = distributed.large_sources(df, distributed.MAX_ROWS if limit is None else limit)
    if not large:
        return grouped(df, kernel)
    ids = F.broadcast(df.sparkSession.createDataFrame([(s,) for s in large], "source_id bigint"))  # at most rows / limit
    return grouped(df.join(ids, "source_id", "left_anti"), kernel).unionByName(apart(df.join(ids, "source_id", "left_semi")).select("source_id", "embedding"))


def grouped(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel(unit rows in input order) for each source; a source of one publication is that publication."""

    def run(pdf):
        import pandas as pd

        x = _unit(np.stack(pdf.sort_values("pos")["embedding"]).astype(np.float64))
        out = x[0] if len(x) == 1 else kernel(x)
        return pd.DataFrame({"source_id": [pdf["source_id"].iloc[0]], "embedding": [np.asarray(out, float)]})

    return df.select(*KEY, "pos", V.doubles(F.col("embedding")).alias("embedding")).groupBy(*KEY).applyInPandas(run, "source_id bigint, embedding array<double>")


def geometric_median(x: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Weiszfeld's iteration from the centre."""
    y = _unit(x.mean(0))
    for _ in range(rounds):
        w = 1 / (np.linalg.norm(x - y, axis=1) + 1e-9)
        new = w @ x / w.sum()
        moved, y = np.linalg.norm(new - y), new
        if moved < tolerance:
            break
    return _unit(y)


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Centres of length 1 and labels."""
    centres = start
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        labels = (x @ centres.T).argmax(1)
        new = np.stack([_unit(x[labels == j].mean(0)) if (labels == j).any() else x[rng.integers(len(x))] for j in range(k)])
        done, centres = np.allclose(new, centres, atol=1e-5), new
        if done:
            break
    return centres, labels


def largest_cluster(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    if k <= 1:
        return x[0]
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres, labels = spherical_kmeans(x, k, rng, x[rng.choice(len(x), k, replace=False)])
    return centres[np.bincount(labels, minlength=k).argmax()]


def principal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, singular values and right singular vectors of the centred rows; each vector's largest element is positive."""
    mu = x.mean(0)
    _, s, v = np.linalg.svd(x - mu, full_matrices=False)
    return mu, s, v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def fused_components(x: np.ndarray, n: int) -> np.ndarray:
    _, s, v = principal(x)
    return _unit(s[:n] @ v[:n])


def shrunk_components(x: np.ndarray, alpha: float) -> np.ndarray:
    _, s, v = principal(x)
    s = np.maximum(s - alpha, 0)
    return _unit(s @ v) if s.any() else v[0]


def huber_centre(x: np.ndarray, delta: float, rounds: int = 20, tolerance: float = 1e-6) -> np.ndarray:
    """Iteratively reweighted mean on cosine distance."""
    y = _unit(x.mean(0))
    for _ in range(rounds):
        d = 1 - x @ y
        w = np.where(d <= delta, 1.0, delta / (d + 1e-9))
        new = _unit(w @ x / w.sum())
        moved, y = np.linalg.norm(new - y), new
        if moved < tolerance:
            break
    return y


def subspace_trimmed(x: np.ndarray, k: int, p: float) -> np.ndarray:
    """Mean, in the space of the first k components, of the ceil(p n) rows nearest to the centre; taken back and normalised."""
    mu, _, v = principal(x)
    z = (x - mu) @ v[:k].T
    near = np.argsort(np.linalg.norm(z, axis=1), kind="stable")[: int(np.ceil(p * len(x)))]
    return _unit(z[near].mean(0) @ v[:k] + mu)


def _parameter(p, i, default):
    return p[i] if len(p) > i else default


#: name: (publications, parameters, seed, tau) -> (source_id, embedding)
AGGREGATORS: dict[str, Callable[[DataFrame, tuple, int, float], DataFrame]] = {
    "mean": lambda d, p, seed, tau: mean(d),
    "sum": lambda d, p, seed, tau: total(d),
    "max": lambda d, p, seed, tau: maximum(d),
    "median": lambda d, p, seed, tau: median(d),
    "cosmean": lambda d, p, seed, tau: cosmean(d),
    "rm1pc": lambda d, p, seed, tau: without_first_component(d),
    "softmax": lambda d, p, seed, tau: softmax(d, tau),
    "geom": lambda d, p, seed, tau: by_size(d, geometric_median, distributed.geometric_median),
    "medoid": lambda d, p, seed, tau: medoid(d),
    "tmean": lambda d, p, seed, tau: trimmed_mean(d, _parameter(p, 0, 0.8)),
    "winsor": lambda d, p, seed, tau: winsorised(d, _parameter(p, 0, 0.1)),
    "kmeans": lambda d, p, seed, tau: by_size(d, lambda x: largest_cluster(x, M.whole(_parameter(p, 0, 4), 2), seed), lambda large: distributed.largest_cluster(large, M.whole(_parameter(p, 0, 4), 2), seed)),
    "pcfuse": lambda d, p, seed, tau: by_size(d, lambda x: fused_components(x, M.whole(_parameter(p, 0, 2), 1)), lambda large: distributed.fused_components(large, M.whole(_parameter(p, 0, 2), 1))),
    "svdshrink": lambda d, p, seed, tau: by_size(d, lambda x: shrunk_components(x, _parameter(p, 0, 0.1)), lambda large: distributed.shrunk_components(large, _parameter(p, 0, 0.1))),
    "huber": lambda d, p, seed, tau: by_size(d, lambda x: huber_centre(x, _parameter(p, 0, 0.2)), lambda large: distributed.huber_centre(large, _parameter(p, 0, 0.2))),
    "attn2": lambda d, p, seed, tau: attention(d, _parameter(p, 0, 10.0)),
    "subtrim": lambda d, p, seed, tau: by_size(d, lambda x: subspace_trimmed(x, M.whole(_parameter(p, 0, 3), 1), M.clamp(_parameter(p, 1, 0.8), 0.05, 1.0)), lambda large: distributed.subspace_trimmed(large, M.whole(_parameter(p, 0, 3), 1), M.clamp(_parameter(p, 1, 0.8), 0.05, 1.0))),
}


def aggregate_sources(df: DataFrame, modes: str = DEFAULT_MODES, seed: int = 42, tau: float = 10.0) -> DataFrame:
    """source_id, ids (in input order), embedding, mode: one row for each source and mode. Unknown modes are an error."""
    ids = df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_i")).select(*KEY, F.col("_i.id").alias("ids"))
    out = None
    for name, parameters in M.parse_modes(modes):
        if name not in AGGREGATORS:
            raise ValueError(f"unknown mode {name!r}; known: {', '.join(AGGREGATORS)}")
        one = AGGREGATORS[name](df, parameters, seed, tau).select(*KEY, "embedding").withColumn("mode", F.lit(M.label((name, parameters))))
        out = one if out is None else out.unionByName(one)
    return out.join(ids, "source_id").select("source_id", "ids", "embedding", "mode")
