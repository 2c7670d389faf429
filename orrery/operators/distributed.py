"""Iterative aggregators for sources too large for one task: every round is an aggregation over all rows of all such sources.

There are at most (all bytes / MAX_BYTES) or (all rows / MAX_ROWS) such sources, so their centres, or their Gram matrices, fit the driver.
Draws are by hashes of positions: the same whatever the partitions, but others than those of the form for small sources.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import vectors as V

#: Rows of a source that one task takes, at most; beyond them a source goes this way.
MAX_ROWS = 200_000
#: Bytes of its vectors, at most.
MAX_BYTES = 128 << 20
SCHEMA = "source_id bigint, embedding array<double>"


def large_sources(df: DataFrame, limit: int) -> list[int]:
    sizes = df.groupBy("source_id").agg(F.count("*").alias("n"), (8 * F.sum(F.size("embedding"))).alias("bytes"))
    return [r["source_id"] for r in sizes.where((F.col("n") > limit) | (F.col("bytes") > MAX_BYTES)).select("source_id").collect()]


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v if n < V.TINY else v / n


def _frame(df: DataFrame, vectors: dict[int, np.ndarray], name: str = "embedding") -> DataFrame:
    return df.sparkSession.createDataFrame([(s, [float(x) for x in v]) for s, v in vectors.items()], f"source_id bigint, {name} array<double>")


def _sums(rows: DataFrame, weight: Column) -> dict[int, np.ndarray]:
    """Weighted mean of each source's vectors."""
    e = V.elements(rows.withColumn("_w", weight), ["source_id"], carry=["_w"])
    means = V.gather(e.groupBy("source_id", "i").agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("x")), ["source_id"])
    return {r["source_id"]: np.array(r["embedding"]) for r in means.collect()}


def reweighted(df: DataFrame, weight, rounds: int, tolerance: float, unit_each_round: bool) -> DataFrame:
    """Means with weights weight(vector, centre), again and again until no centre moves by the tolerance."""
    rows = df.select("source_id", V.unit(F.col("embedding")).alias("embedding"))
    centres = {s: _unit(v) for s, v in _sums(rows, F.lit(1.0)).items()}
    moving = set(centres)
    for _ in range(rounds):
        if not moving:
            break
        known = _frame(df, {s: centres[s] for s in moving}, "centre")
        now = _sums(rows.join(F.broadcast(known), "source_id"), weight(F.col("embedding"), F.col("centre")))
        for s, v in now.items():
            v = _unit(v) if unit_each_round else v
            if np.linalg.norm(v - centres[s]) < tolerance:
                moving.discard(s)
            centres[s] = v
    return _frame(df, {s: _unit(v) for s, v in centres.items()})


def geometric_median(df: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    distance = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    return reweighted(df, lambda x, y: 1 / (distance(x, y) + 1e-9), rounds, tolerance, False)


def huber_centre(df: DataFrame, delta: float, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    def weight(x, y):
        d = 1 - V.dot(x, y)
        return F.when(d <= delta, 1.0).otherwise(delta / (d + 1e-9))

    return reweighted(df, weight, rounds, tolerance, True)


def moments(df: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each source: n, mean, singular values and right singular vectors of the centred unit rows (largest element positive)."""

    def partial(batches):
        import pandas as pd

        sums: dict = {}
        for pdf in batches:
            for s, rows in pdf.groupby("source_id"):
                x = np.stack(rows["embedding"])
                part = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                sums[s] = part if s not in sums else sums[s] + part
        if sums:
            yield pd.DataFrame({"source_id": list(sums), "embedding": list(sums.values())})

    rows = df.select("source_id", V.unit(F.col("embedding")).alias("embedding"))
    out = {}
    for r in V.aggregate(rows.mapInPandas(partial, SCHEMA), ["source_id"], F.sum).collect():
        a = np.array(r["embedding"])
        n = a[0]
        d = int((-1 + np.sqrt(1 + 4 * (len(a) - 1))) / 2 + 0.5)
        mu = a[1 : d + 1] / n
        values, vectors = np.linalg.eigh(a[d + 1 :].reshape(d, d) - n * np.outer(mu, mu))
        s, v = np.sqrt(np.maximum(values[::-1], 0)), vectors.T[::-1]
        out[r["source_id"]] = int(n), mu, s, v * np.sign(v[np.arange(d), np.abs(v).argmax(1)])[:, None]
    return out


def fused_components(df: DataFrame, n: int) -> DataFrame:
    return _frame(df, {i: _unit(s[:n] @ v[:n]) for i, (_, _, s, v) in moments(df).items()})


def shrunk_components(df: DataFrame, alpha: float) -> DataFrame:
    def one(s, v):
        kept = np.maximum(s - alpha, 0)
        return _unit(kept @ v) if kept.any() else v[0]

    return _frame(df, {i: one(s, v) for i, (_, _, s, v) in moments(df).items()})


def subspace_trimmed(df: DataFrame, k: int, p: float) -> DataFrame:
    """Only (source, distance, position) is ranked; the vectors of the rows that stay are averaged."""
    known = moments(df)
    spaces = df.sparkSession.createDataFrame([(i, n, mu.tolist(), v[:k].tolist()) for i, (n, mu, _, v) in known.items()], "source_id bigint, n bigint, mu array<double>, axes array<array<double>>")
    rows = df.select("source_id", "pos", V.unit(F.col("embedding")).alias("embedding")).join(F.broadcast(spaces), "source_id")
    centred = F.zip_with("embedding", "mu", lambda x, m: x - m)
    z2 = F.aggregate(F.transform("axes", lambda a: V.dot(a, F.col("_c"))), F.lit(0.0), lambda s, x: s + x * x)
    placed = rows.withColumn("_c", centred).withColumn("_z", z2)
    near = placed.select("source_id", "pos", "n", "_z").withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy("_z", "pos"))).where(F.col("_r") <= F.ceil(F.lit(p) * F.col("n")))
    means = _sums(placed.join(near.select("source_id", "pos"), ["source_id", "pos"], "left_semi"), F.lit(1.0))
    return _frame(df, {i: _unit((m - known[i][1]) @ known[i][3][:k].T @ known[i][3][:k] + known[i][1]) for i, m in means.items()})


# --- clustering ---------------------------------------------------------------------------------------------------------


def unit_rows(df: DataFrame) -> DataFrame:
    return df.select("source_id", "id", "pos", V.unit(F.col("embedding")).alias("embedding"))


def _chance(seed: int, step: int) -> Column:
    """A number above 0 and below 1 for each row."""
    return (F.pmod(F.xxhash64("pos", F.lit(seed), F.lit(step)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _with_centres(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Rows with near: their largest dot product with a centre of their source, and label: the number of that centre."""
    known = rows.sparkSession.createDataFrame([(s, c.tolist()) for s, c in centres.items()], "source_id bigint, centres array<array<double>>")
    dots = rows.join(F.broadcast(known), "source_id").withColumn("_d", F.transform("centres", lambda c: V.dot(c, F.col("embedding")))).drop("centres")
    return dots.withColumns({"near": F.array_max("_d"), "label": (F.array_position("_d", F.array_max("_d")) - 1).cast("int")}).drop("_d")


def _one_each(rows: DataFrame, order: Column) -> dict[int, tuple[int, np.ndarray]]:
    """id and vector of the row that comes first in each source."""
    first = rows.groupBy("source_id").agg(F.min_by(F.struct("id", "embedding"), order).alias("x"))
    return {r["source_id"]: (r["x"]["id"], np.array(r["x"]["embedding"])) for r in first.collect()}


def drawn(rows: DataFrame, weight: Column, seed: int, step: int) -> dict[int, tuple[int, np.ndarray]]:
    """A row of each source, drawn in proportion to the weight (evenly where all weights are 0): the smallest of exponential waiting times."""
    u = _chance(seed, step)
    wait = F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))
    return _one_each(rows, F.struct(wait, u, F.col("pos")))


def _stacked(chosen: dict[int, list[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    return {s: np.stack([v for _, v in c]) for s, c in chosen.items()}


def seeded(rows: DataFrame, k: int, seed: int) -> dict[int, np.ndarray]:
    """k-means++: each next centre in proportion to the square of the cosine distance to the ones before."""
    chosen = {s: [x] for s, x in drawn(rows, F.lit(1.0), seed, 0).items()}
    for step in range(1, k):
        d = F.greatest(1 - F.col("near"), F.lit(0.0))
        for s, x in drawn(_with_centres(rows, _stacked(chosen)), d * d, seed, step).items():
            chosen[s].append(x)
    return _stacked(chosen)


def furthest(rows: DataFrame, k: int, seed: int) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Ids and vectors: one at random, then always the row that is least near to the ones before (the first of equals)."""
    chosen = {s: [x] for s, x in drawn(rows, F.lit(1.0), seed, 0).items()}
    for _ in range(1, k):
        for s, x in _one_each(_with_centres(rows, _stacked(chosen)), F.struct("near", "pos")).items():
            chosen[s].append(x)
    return chosen


def assigned(rows: DataFrame, centres: dict[int, np.ndarray], tau: float | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each source and centre the number of its rows and their sum; with tau, rows belong to all centres by a softmax."""
    known = rows.sparkSession.sparkContext.broadcast(centres)

    def partial(batches):
        import pandas as pd

        sums: dict = {}
        for pdf in batches:
            for s, part in pdf.groupby("source_id"):
                x, c = np.stack(part["embedding"]), known.value[s]
                d = x @ c.T
                if tau is None:
                    p = np.eye(len(c))[d.argmax(1)]
                else:
                    p = np.exp(tau * (d - d.max(1, keepdims=True)))
                    p /= p.sum(1, keepdims=True)
                one = np.concatenate([p.sum(0), (p.T @ x).ravel()])
                sums[s] = one if s not in sums else sums[s] + one
        if sums:
            yield pd.DataFrame({"source_id": list(sums), "embedding": list(sums.values())})

    mine = rows.where(F.col("source_id").isin(list(centres))).select("source_id", "embedding")
    out = {}
    for r in V.aggregate(mine.mapInPandas(partial, SCHEMA), ["source_id"], F.sum).collect():
        k = len(centres[r["source_id"]])
        a = np.array(r["embedding"])
        out[r["source_id"]] = a[:k], a[k:].reshape(k, -1)
    return out


def lloyd(rows: DataFrame, centres: dict[int, np.ndarray], seed: int, rounds: int = 30, tau: float | None = None) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Centres after rounds of assigning and averaging, each source until its centres stand still, and the numbers of rows in the last assignment."""
    centres, counts, moving = dict(centres), {}, set(centres)
    for step in range(rounds):
        if not moving:
            break
        got = assigned(rows, {s: centres[s] for s in moving}, tau)
        spare = drawn(rows, F.lit(1.0), seed, 1000 + step) if any((n == 0).any() for n, _ in got.values()) else {}
        for s, (n, total) in got.items():
            new = np.stack([_unit(total[j] / n[j]) if n[j] else spare[s][1] for j in range(len(n))])
            counts[s] = n
            if np.allclose(new, centres[s], atol=1e-5):
                moving.discard(s)
            centres[s] = new
    return centres, counts


def largest_cluster(df: DataFrame, k: int, seed: int) -> DataFrame:
    rows = unit_rows(df)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy(_chance(seed, 0), "pos"))).where(F.col("_r") <= k).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("_r", "embedding"))).alias("x"))
    centres, counts = lloyd(rows, {r["source_id"]: np.array([x["embedding"] for x in r["x"]]) for r in first.collect()}, seed)
    return _frame(df, {s: c[counts[s].argmax()] for s, c in centres.items()})


def medoids(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, list[tuple[int, np.ndarray, int]]]:
    """id and vector of the row nearest to each centre among its own, and how many those are."""
    best = _with_centres(rows, centres).groupBy("source_id", "label").agg(F.max_by(F.struct("id", "embedding"), F.struct("near", -F.col("pos"))).alias("x"), F.count("*").alias("n"))
    out: dict = {}
    for r in best.orderBy("source_id", "label").collect():
        out.setdefault(r["source_id"], []).append((r["x"]["id"], np.array(r["x"]["embedding"]), r["n"]))
    return out
