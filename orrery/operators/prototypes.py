"""Several vectors a source: prototypes of its publications, with weights where the method has them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import modes as M
from orrery.functions import vectors as V
from orrery.operators import distributed as D
from orrery.operators.aggregate import _parameter, _unit, principal, spherical_kmeans, unit_rows

DEFAULT_MODES = "kmeans@4,fps@4,pca@3,cmedoids@4,softk@4,10,10,byyear@5"
MODEL = "source_id bigint, ids array<bigint>, method string, embeddings array<array<double>>, weights array<double>, cluster_sizes array<int>, proto_ids array<bigint>, year_keys array<int>, year_counts array<int>"


#: Rounds of k-means before the soft ones.
WARM_ROUNDS = 10


def seeded_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre in proportion to the square of the cosine distance to the ones before."""
    chosen = [int(rng.integers(len(x)))]
    for _ in range(k - 1):
        d2 = np.square(np.clip(1 - (x @ x[chosen].T).max(1), 0, None))
        chosen.append(int(rng.choice(len(x), p=d2 / d2.sum())) if d2.sum() > 0 else int(rng.integers(len(x))))
    return x[chosen]


def clusters(x: np.ndarray, k: int, seed: int, rounds: int = 30):
    """Centres, and the labels that belong to them."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centres, _ = spherical_kmeans(x, k, rng, seeded_centres(x, k, rng), rounds)
    return centres, (x @ centres.T).argmax(1)


def kmeans(x, ids, seed, k=4):
    centres, labels = clusters(x, M.whole(k, 1), seed)
    sizes = np.bincount(labels, minlength=len(centres))
    return {"embeddings": centres, "weights": sizes / len(x), "cluster_sizes": sizes}


def cluster_medoids(x, ids, seed, k=4):
    centres, labels = clusters(x, M.whole(k, 1), seed)
    chosen = []
    for j, c in enumerate(centres):
        inside = np.flatnonzero(labels == j)
        if len(inside):
            chosen.append(inside[(x[inside] @ c).argmax()])
    return {"embeddings": x[chosen], "proto_ids": ids[chosen], "cluster_sizes": np.bincount(labels, minlength=len(centres))}


def furthest_points(x, ids, seed, k=4):
    chosen = [int(np.random.default_rng(seed).integers(len(x)))]
    near = 1 - x @ x[chosen[0]]
    for _ in range(min(M.whole(k, 1), len(x)) - 1):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, 1 - x @ x[chosen[-1]])
    return {"embeddings": x[chosen], "proto_ids": ids[chosen]}


def soft_kmeans(x, ids, seed, k=4, tau=10.0, rounds=10):
    centres, _ = clusters(x, M.whole(k, 1), seed, WARM_ROUNDS)
    p = np.full((len(x), len(centres)), 1 / len(centres))
    for _ in range(M.whole(rounds, 1)):
        s = tau * (x @ centres.T)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        before, centres = centres, _unit(p.T @ x)
        if np.allclose(before, centres, atol=1e-5):
            break
    return {"embeddings": centres, "weights": p.mean(0)}


def components(x, ids, seed, r=3):
    if len(x) < 2:
        return {"embeddings": x[:0], "weights": []}
    _, s, v = principal(x)
    r = min(M.whole(r, 1), len(s))
    return {"embeddings": v[:r], "weights": s[:r]}


def large_sources_model(df: DataFrame, name: str, parameters, label: str, seed: int) -> DataFrame:
    """The model rows of sources too large for a task: the same methods in rounds over all rows."""
    rows, k = D.unit_rows(df), M.whole(_parameter(parameters, 0, 3 if name == "pca" else 4), 1)
    out: dict[int, dict] = {}
    if name == "kmeans":
        centres, _ = D.lloyd(rows, D.seeded(rows, k, seed), seed)
        for s, (n, _) in D.assigned(rows, centres).items():
            out[s] = {"embeddings": centres[s], "weights": n / n.sum(), "cluster_sizes": n}
    elif name == "cmedoids":
        centres, _ = D.lloyd(rows, D.seeded(rows, k, seed), seed)
        found = D.medoids(rows, centres)
        sizes = {s: n for s, (n, _) in D.assigned(rows, centres).items()}
        for s, best in found.items():
            out[s] = {"embeddings": [v for _, v, _ in best], "proto_ids": [i for i, *_ in best], "cluster_sizes": sizes[s]}
    elif name == "fps":
        for s, chosen in D.furthest(rows, k, seed).items():
            out[s] = {"embeddings": [v for _, v in chosen], "proto_ids": [i for i, _ in chosen]}
    elif name == "softk":
        start, _ = D.lloyd(rows, D.seeded(rows, k, seed), seed, WARM_ROUNDS)
        centres, parts = D.lloyd(rows, start, seed, M.whole(_parameter(parameters, 2, 10), 1), _parameter(parameters, 1, 10.0))
        for s, c in centres.items():
            out[s] = {"embeddings": c, "weights": parts[s] / parts[s].sum()}
    else:
        for s, (_, _, values, axes) in D.moments(df).items():
            out[s] = {"embeddings": axes[:k], "weights": values[:k]}
    kinds = {"weights": float, "cluster_sizes": int, "proto_ids": int}
    packed = [(s, label, [[float(x) for x in e] for e in o["embeddings"]], *([kind(x) for x in o[n]] if n in o else None for n, kind in kinds.items())) for s, o in out.items()]
    model = df.sparkSession.createDataFrame(packed, "source_id bigint, method string, embeddings array<array<double>>, weights array<double>, cluster_sizes array<int>, proto_ids array<bigint>")
    none = F.lit(None).cast("array<int>")
    return model.join(_ids(df), "source_id").withColumns({"year_keys": none, "year_counts": none}).select(*(c.split(" ")[0] for c in MODEL.split(", ")))


KERNELS: dict[str, Callable] = {"kmeans": kmeans, "cmedoids": cluster_medoids, "fps": furthest_points, "softk": soft_kmeans, "pca": components}


def by_year(df: DataFrame, least: float = 5) -> DataFrame:
    """source_id, embeddings, year_keys, year_counts: a mean direction for each year of a source with so many publications. No year: empty arrays."""
    rows = unit_rows(df.where(F.col("date_year").isNotNull())).withColumn("date_year", F.col("date_year").cast("int"))
    counts = rows.groupBy("source_id", "date_year").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= M.whole(least, 1))
    keys = ["source_id", "date_year"]
    means = V.aggregate(rows, keys, F.avg).join(counts, keys).select(*keys, "n", V.unit(F.col("embedding")).alias("embedding"))
    packed = means.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("date_year", "n", "embedding"))).alias("_y"))
    everyone = df.select("source_id").distinct().join(packed, "source_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return everyone.select("source_id", empty(F.col("_y.embedding"), "array<array<double>>").alias("embeddings"), empty(F.col("_y.date_year"), "array<int>").alias("year_keys"), empty(F.col("_y.n"), "array<int>").alias("year_counts"))


def _ids(df: DataFrame) -> DataFrame:
    return df.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_i")).select("source_id", F.col("_i.id").alias("ids"))


def _grouped(df: DataFrame, kernel, parameters, label: str, seed: int) -> DataFrame:
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        x, ids = _unit(np.stack(pdf["embedding"]).astype(np.float64)), pdf["id"].to_numpy()
        out = kernel(x, ids, seed, *parameters)
        row = {n: None for n in ("weights", "cluster_sizes", "proto_ids", "year_keys", "year_counts")}
        row |= {n: list(map(float if n == "weights" else int, v)) for n, v in out.items() if n != "embeddings"}
        return pd.DataFrame([{"source_id": pdf["source_id"].iloc[0], "ids": ids, "method": label, "embeddings": [list(map(float, e)) for e in out["embeddings"]], **row}])

    return df.select("source_id", "id", "pos", V.doubles(F.col("embedding")).alias("embedding")).groupBy("source_id").applyInPandas(run, MODEL)


def aggregate_prototypes(df: DataFrame, modes: str = DEFAULT_MODES, seed: int = 42) -> DataFrame:
    """One row for each source and mode. Each source starts from the same seed, so results don't depend on the order of sources."""
    out = None
    for name, parameters in M.parse_modes(modes):
        label = M.label((name, parameters))
        if name == "byyear":
            one = by_year(df, _parameter(parameters, 0, 5)).join(_ids(df), "source_id")
            nothing = {"weights": "array<double>", "cluster_sizes": "array<int>", "proto_ids": "array<bigint>"}
            one = one.withColumns({"method": F.lit(label), **{n: F.lit(None).cast(k) for n, k in nothing.items()}})
        elif name in KERNELS:
            large = D.large_sources(df, D.MAX_ROWS)
            ids = F.broadcast(df.sparkSession.createDataFrame([(s,) for s in large], "source_id bigint"))
            one = _grouped(df.join(ids, "source_id", "left_anti") if large else df, KERNELS[name], parameters, label, seed)
            if large:
                one = one.unionByName(large_sources_model(df.join(ids, "source_id", "left_semi"), name, parameters, label, seed))
        else:
            raise ValueError(f"unknown mode {name!r}; known: {', '.join([*KERNELS, 'byyear'])}")
        one = one.select(*(c.split(" ")[0] for c in MODEL.split(", ")))
        out = one if out is None else out.unionByName(one)
    return out


def rows_of(model: DataFrame) -> DataFrame:
    """source_id, proto, embedding, prior of a model's prototypes; weights that don't fit the number of prototypes count as 1."""
    fit = F.size("weights") == F.size("embeddings")
    return model.select("source_id", F.posexplode("embeddings").alias("proto", "embedding"), F.when(fit, F.col("weights")).alias("_w")).select("source_id", "proto", "embedding", F.coalesce(F.get("_w", F.col("proto")), F.lit(1.0)).alias("prior"))
