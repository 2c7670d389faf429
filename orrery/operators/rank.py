"""Exact cosine ranking: publications by publications, sources by publications, sources through their prototypes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import vectors as V
from orrery.functions import years as Y
from orrery.functions.modes import pool_label
from orrery.sources import jsonl, sinks

#: Bytes of the queries of one pass, with the best of each so far, in a task; more queries go in several passes over the index.
BLOCK_BYTES = 64 << 20
#: Bytes of scores, ids and the best so far that a task holds at once while it works through a batch.
TILE_BYTES = 32 << 20
#: Pairs up to which the relational form is chosen.
SQL_PAIRS = 2_000_000


def top(df: DataFrame, keys: list[str], k: int, item: str) -> DataFrame:
    """The k best of each key with their rank, by score and then item. Spark keeps only k rows a key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(item).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prepare_queries(queries: DataFrame, drop_tiny: bool = True) -> DataFrame:
    """qid, bucket and unit vector of the queries that have an id, a year and a vector; null-length ones go if drop_tiny."""
    rows = queries.where(F.col("id").isNotNull() & F.col("date_year").isNotNull() & V.is_valid(F.col("embedding")))
    if drop_tiny:
        rows = rows.where(V.norm(F.col("embedding")) >= V.FLOOR)
    return rows.select(F.col("id").alias("qid"), Y.bucket(F.col("date_year")).alias("bucket"), V.unit(F.col("embedding")).alias("q"))


def _relational(queries: DataFrame, index: DataFrame, k: int, item: str) -> DataFrame:
    pairs = queries.join(index, "bucket").select("qid", "bucket", item, V.dot(F.col("q"), F.col("v")).alias("score"))
    return top(pairs, ["qid"], k, item)


def _in_blocks(queries: DataFrame, index: DataFrame, k: int, item: str, score, width) -> DataFrame:
    """The index (bucket, item, ..) stays where it is: each of its partitions scores a broadcast block of queries as matrix products and gives its own best k.

    score(q, rows): scores of the rows of a batch for each query; width(rows): how many numbers it needs for one query. The driver holds one
    block at a time; with several passes the best of each are written before the next is sent out.
    """
    spark = queries.sparkSession
    kind = index.schema[item].dataType.simpleString()
    schema = f"qid bigint, bucket int, {item} {kind}, score double"
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    if not size["n"]:
        return top(spark.createDataFrame([], schema), ["qid"], k, item)
    passes = math.ceil(size["n"] * (8 * size["d"] + 16 * k) / BLOCK_BYTES)
    out = None
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)
        rows = part.orderBy("qid").collect()  # one block, at most about BLOCK_BYTES
        if not rows:
            continue
        by_bucket = {}
        for r in rows:
            by_bucket.setdefault(r["bucket"], []).append(r)
        packed = spark.sparkContext.broadcast({b: (np.array([r["qid"] for r in rs]), np.array([r["q"] for r in rs])) for b, rs in by_bucket.items()})

        def run(batches, packed=packed):
            import pandas as pd

            best: dict = {}
            for pdf in batches:
                for b, rows in pdf.groupby("bucket"):
                    if b not in packed.value:
                        continue
                    _, q = packed.value[b]
                    new, parts = rows[item].to_numpy(), []
                    old = best.get(b)
                    step = max(1, TILE_BYTES // (8 * width(rows) + 16 * (k + len(rows))))
                    for lo in range(0, len(q), step):
                        s = score(q[lo : lo + step], rows)
                        ids = np.broadcast_to(new, s.shape)
                        if old is not None:
                            s, ids = np.hstack([old[0][lo : lo + step], s]), np.hstack([old[1][lo : lo + step], ids])
                        if s.shape[1] > k:
                            order = np.lexsort((ids, -s))[:, :k]
                            s, ids = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)
                        parts.append((s, ids))
                    best[b] = tuple(np.vstack(x) for x in zip(*parts))
            for b, (s, ids) in best.items():
                qid, step = packed.value[b][0], max(1, TILE_BYTES // (40 * s.shape[1]))
                for lo in range(0, len(qid), step):
                    yield pd.DataFrame({"qid": np.repeat(qid[lo : lo + step], s.shape[1]), "bucket": b, item: ids[lo : lo + step].ravel(), "score": s[lo : lo + step].ravel()})

        one = index.mapInPandas(run, schema)
        if passes > 1:
            one = sinks.stored(top(one, ["qid"], k, item).drop("rank"), "topk")
            packed.destroy()
        out = one if out is None else out.unionByName(one)
    return top(out, ["qid"], k, item)


def _block(queries: DataFrame, index: DataFrame, k: int, item: str) -> DataFrame:
    return _in_blocks(queries, index.select("bucket", item, "v"), k, item, lambda q, rows: q @ np.stack(rows["v"]).T, len)


def expect_index(index: DataFrame) -> DataFrame:
    """The index; an error where it has no vector at all."""
    if index.where(V.is_valid(F.col("embedding"))).isEmpty():
        raise ValueError("the index holds no vectors")
    return index


def _method(queries: DataFrame, index: DataFrame) -> str:
    pairs = queries.groupBy("bucket").count().withColumnRenamed("count", "m").join(index.groupBy("bucket").count(), "bucket").agg(F.sum(F.col("m") * F.col("count"))).first()[0]
    return "block" if (pairs or 0) > SQL_PAIRS else "sql"


def knn(queries: DataFrame, index: DataFrame, k: int, item: str, method: str = "auto") -> DataFrame:
    """qid, bucket, item, score, rank. queries: qid, bucket, q; index: bucket, item, v; vectors of length 1."""
    if method == "auto":
        method = _method(queries, index)
    if method not in ("sql", "block"):
        raise ValueError(f"method {method!r}: not auto, sql or block")
    return (_block if method == "block" else _relational)(queries, index, k, item)


def knn_by_bucket(queries: DataFrame, index: DataFrame, k: int = 1000, method: str = "auto") -> DataFrame:
    """qid, bucket, id, score, rank: publications (id, date_year, embedding) nearest to each query, out of the window of its bucket."""
    rows = Y.assign_buckets(index.where(V.is_valid(F.col("embedding")))).select("bucket", "id", V.unit_floored(F.col("embedding")).alias("v"))
    return knn(prepare_queries(queries), rows, k, "id", method)


def candidates(model: DataFrame, year_sources: DataFrame) -> DataFrame:
    """Model rows of the sources that each bucket allows."""
    return model.join(year_sources, "source_id")


def rank_sources(queries: DataFrame, model: DataFrame, year_sources: DataFrame, k: int = 50, method: str = "auto") -> DataFrame:
    """qid, bucket, source_id, score, rank, from one vector a source. Of rows that repeat a source the last (by pos, if there) counts."""
    if "pos" in model.columns:
        model = model.groupBy("source_id").agg(F.max_by("embedding", "pos").alias("embedding"))
    rows = candidates(model, year_sources).select("bucket", "source_id", V.unit(F.col("embedding")).alias("v"))
    return knn(prepare_queries(queries, drop_tiny=False), rows, k, "source_id", method)


POOLS = ("max", "mean", "softmax", "topm")


def _pooled(pool: str, tau: float, m: int, use_priors: bool, scored: DataFrame) -> DataFrame:
    keys = ["qid", "bucket", "source_id"]
    s = F.col("s")
    if pool == "max":
        return scored.groupBy(*keys).agg(F.max(s).alias("score"))
    if pool == "mean":
        return scored.groupBy(*keys).agg(F.avg(s).alias("score"))
    if pool == "topm":
        best = F.slice(F.sort_array(F.collect_list(s), asc=False), 1, m)
        return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, (F.aggregate("_b", F.lit(0.0), lambda a, x: a + x) / F.size("_b")).alias("score"))
    if pool == "softmax":
        p = F.col("prior") if use_priors else F.lit(1.0)
        peak = F.max(s).over(Window.partitionBy(*keys))
        e = p * F.exp(F.lit(tau) * (s - F.col("_peak")))
        weighed = scored.withColumn("_peak", peak).withColumn("_e", e)
        return weighed.groupBy(*keys).agg((F.sum(F.col("_e") * s) / F.greatest(F.sum("_e"), F.lit(1e-9))).alias("score"))
    raise ValueError(f"unknown pool {pool!r}: not max, mean, softmax or topm")


def _pool_kernel(pool: str, tau: float, m: int, use_priors: bool):
    """Scores of sources from packed prototypes (p: structs of v and prior), for a block of queries."""

    def score(q, rows):
        sizes = np.array([len(p) for p in rows["p"]])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = [x for p in rows["p"] for x in p]
        s, prior = q @ np.array([x["v"] for x in flat], float).T, np.array([x["prior"] for x in flat], float)
        out = np.empty((len(q), len(sizes)))
        for n in np.unique(sizes):  # sources of as many prototypes at once
            which = np.flatnonzero(sizes == n)
            at = starts[which][:, None] + np.arange(n)
            x = s[:, at]
            if pool == "max":
                out[:, which] = x.max(2)
            elif pool == "mean":
                out[:, which] = x.mean(2)
            elif pool == "topm":
                out[:, which] = -np.sort(-x, axis=2)[:, :, :m].mean(2)
            else:
                e = np.exp(tau * (x - x.max(2, keepdims=True))) * (prior[at] if use_priors else 1.0)
                out[:, which] = (e * x).sum(2) / np.maximum(e.sum(2), 1e-9)
        return out

    return score


def rank_prototypes(queries: DataFrame, prototypes: DataFrame, year_sources: DataFrame, k: int = 50, pool: str = "softmax", tau: float = 10.0, m: int = 3, use_priors: bool = False, method: str = "auto") -> DataFrame:
    """qid, bucket, source_id, score, rank, pool. prototypes: source_id, embedding, prior.

    block: a source's few prototypes are packed into one row, and each partition scores and pools them for a block of queries; sql: all pairs by a join.
    """
    if pool not in POOLS:
        raise ValueError(f"unknown pool {pool!r}: not {', '.join(POOLS)}")
    prepared = prepare_queries(queries, drop_tiny=False)
    unit = prototypes.select("source_id", "prior", V.unit(F.col("embedding")).alias("v"))
    if method == "auto":
        method = _method(prepared, candidates(unit.select("source_id"), year_sources))
    if method == "block":
        packed = candidates(unit.groupBy("source_id").agg(F.collect_list(F.struct("v", "prior")).alias("p")), year_sources).select("bucket", "source_id", "p")
        ranked = _in_blocks(prepared, packed, k, "source_id", _pool_kernel(pool, tau, m, use_priors), lambda rows: 4 * sum(map(len, rows["p"])))
    elif method == "sql":
        scored = prepared.join(candidates(unit, year_sources), "bucket").select("qid", "bucket", "source_id", "prior", V.dot(F.col("q"), F.col("v")).alias("s"))
        ranked = top(_pooled(pool, tau, m, use_priors, scored), ["qid"], k, "source_id")
    else:
        raise ValueError(f"method {method!r}: not auto, sql or block")
    return ranked.withColumn("pool", F.lit(pool_label(pool, tau, m)))


def rank_models(spark, folder: str, prefix: str, queries: DataFrame, year_sources: DataFrame, k: int = 50, pool: str = "softmax", exclude: str | None = "0.8", method: str = "auto", **pooling) -> DataFrame:
    """Runs of all queries for every model file of a folder, labelled by its name without the prefix; files that hold no model are passed over."""
    from orrery.functions.texts import model_label
    from orrery.operators import prototypes

    out = None
    for path in jsonl.find_models(spark, folder, prefix, exclude):
        kind = jsonl.model_kind(spark, path)
        if kind == "single":
            ranked = rank_sources(queries, jsonl.read(spark, path, jsonl.SINGLE_MODEL, ("source_id", "embedding")), year_sources, k, method)
        elif kind == "multi":
            model = jsonl.read(spark, path, jsonl.MULTI_MODEL, ("source_id", "embeddings"))
            ranked = rank_prototypes(queries, prototypes.rows_of(model), year_sources, k, pool, method=method, **pooling)
        else:
            continue
        stem = path.rsplit("/", 1)[-1].removesuffix(".jsonl")
        one = with_empty(as_runs(ranked, stem), queries, stem).withColumn("model", model_label(F.lit(stem), prefix))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no model files in {folder}")
    return out


def as_runs(ranked: DataFrame, model: str, item: str = "source_id") -> DataFrame:
    """One row a query: model, query_id, year_bucket, top (rank, source_id, score), best first."""
    entry = F.struct("rank", F.col(item).alias("source_id"), "score")
    return ranked.groupBy("qid", "bucket").agg(F.array_sort(F.collect_list(entry)).alias("top")).select(F.lit(model).alias("model"), F.col("qid").alias("query_id"), F.col("bucket").alias("year_bucket"), "top")


def with_empty(runs: DataFrame, queries: DataFrame, model: str) -> DataFrame:
    """Runs, and an empty one for each query without any candidate."""
    rows = prepare_queries(queries, drop_tiny=False).select(F.col("qid").alias("query_id"), F.col("bucket").alias("year_bucket"))
    joined = rows.join(runs.drop("model", "year_bucket"), "query_id", "left")
    return joined.select(F.lit(model).alias("model"), "query_id", "year_bucket", F.coalesce("top", F.array().cast(runs.schema["top"].dataType)).alias("top"))


def as_results(ranked: DataFrame, item: str = "id") -> DataFrame:
    """id, results: ranked items of each query."""
    packed = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("x")))).alias("_r"))
    return packed.select(F.col("qid").alias("id"), F.col("_r.x").alias("results"))


def expect_dimension(df: DataFrame, dim: int | None = None, vector: str = "embedding", order: str = "pos") -> DataFrame:
    """Rows whose vectors have the given number of elements, or as many as the first valid one."""
    if dim is None:
        first = df.where(V.is_valid(F.col(vector))).agg(F.min_by(F.size(vector), F.col(order)).alias("d")).first()
        dim = first["d"] if first else None
    return df.where(V.is_valid(F.col(vector)) & (F.size(vector) == F.lit(dim)))


