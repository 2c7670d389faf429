"""Small cases: edge values of the operators, and independent versions of the iterative ones."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import modes, texts, vectors, years
from orrery.operators import aggregate, enrich, evaluate, fuse, prototypes, rank, splits
from orrery.sources import jdbc, jsonl, sinks
from orrery.streaming import metrics as streaming

PUB = "id bigint, source_id bigint, date_year int, pos bigint, embedding array<double>"


def pubs(spark, rows):
    return spark.createDataFrame([(i, s, y, i, [float(x) for x in e]) for i, s, y, e in rows], PUB)


def random_pubs(spark, n=60, d=5, sources=3, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return pubs(spark, [(i, i % sources, 2019 + i % 5, x[i]) for i in range(n)]), x


def vector(df, source, column="embedding"):
    return np.array(df.where(F.col("source_id") == source).first()[column])


def test_parse_modes():
    assert modes.parse_modes("mean, subtrim@3,0.8,kmeans@4,mean") == [("mean", ()), ("subtrim", (3.0, 0.8)), ("kmeans", (4.0,))]
    assert modes.label(("softk", (4.0, 10.0, 10.0))) == "softk@4,10,10"
    assert modes.whole(2.5, 1) == 2 and modes.whole(0, 2) == 2 and modes.clamp(2, 0.05, 1) == 1
    with pytest.raises(ValueError):
        modes.parse_modes("3,mean")


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        aggregate.aggregate_sources(pubs(spark, [(1, 1, 2020, [1, 0])]), "mean,nonsense")


def test_unit_of_zero_vector(spark):
    df = pubs(spark, [(1, 1, 2020, [0, 0]), (2, 2, 2020, [3, 4])])
    got = {r["id"]: r["u"] for r in df.select("id", vectors.unit(F.col("embedding")).alias("u")).collect()}
    assert got == {1: [0.0, 0.0], 2: [0.6, 0.8]}


@pytest.mark.parametrize("mode", sorted(aggregate.AGGREGATORS))
def test_single_row_source_is_its_publication(spark, mode):
    df = pubs(spark, [(1, 1, 2020, [3, 4]), (2, 2, 2020, [4, 3]), (3, 2, 2020, [4, 3])])
    got = vector(aggregate.AGGREGATORS[mode](df, (), 42, 10.0), 1)
    raw = mode in ("mean", "sum", "max", "median")
    if mode != "rm1pc":
        assert np.allclose(got, [3, 4] if raw else [0.6, 0.8])


def test_identical_rows_and_antipodes(spark):
    df = pubs(spark, [*[(i, 1, 2020, [3, 4]) for i in range(6)], (10, 2, 2020, [1, 0]), (11, 2, 2020, [-1, 0])])
    for mode in aggregate.AGGREGATORS:
        rows = aggregate.AGGREGATORS[mode](df, (), 42, 10.0).collect()
        assert len(rows) == 2 and all(np.isfinite(r["embedding"]).all() for r in rows), mode


def test_twins_of_iterative_modes(spark):
    df, x = random_pubs(spark)
    u = x[0::3] / np.linalg.norm(x[0::3], axis=1, keepdims=True)
    one = lambda v: v / np.linalg.norm(v)

    y = one(u.mean(0))
    for _ in range(500):
        w = 1 / (np.linalg.norm(u - y, axis=1) + 1e-9)
        y = (w[:, None] * u).sum(0) / w.sum()
    assert np.allclose(vector(aggregate.AGGREGATORS["geom"](df, (), 42, 10.0), 0), one(y), atol=1e-4)

    _, s, v = np.linalg.svd(u - u.mean(0))
    got = vector(aggregate.AGGREGATORS["svdshrink"](df, (0.1,), 42, 10.0), 0)
    assert np.isclose(np.linalg.norm(got), 1)
    assert np.allclose(np.abs(v @ got) / np.abs(v @ got).max(), np.maximum(s - 0.1, 0) / (s[0] - 0.1), atol=1e-6)

    c = np.stack([one((x[i::3] / np.linalg.norm(x[i::3], axis=1, keepdims=True)).sum(0)) for i in range(3)])
    _, _, vc = np.linalg.svd(c)
    want = np.stack([one(r - (r @ vc[0]) * vc[0]) for r in c])
    got = aggregate.AGGREGATORS["rm1pc"](df, (), 42, 10.0)
    assert np.allclose([vector(got, i) for i in range(3)], want)


@pytest.mark.parametrize("mode", ["geom", "huber", "pcfuse", "svdshrink", "subtrim"])
def test_large_sources_get_the_same_vectors(spark, monkeypatch, mode):
    df, _ = random_pubs(spark, 90)
    small = aggregate.AGGREGATORS[mode](df, (), 42, 10.0).orderBy("source_id").collect()
    monkeypatch.setattr("orrery.operators.distributed.MAX_ROWS", 29)
    large = aggregate.AGGREGATORS[mode](df.unionByName(pubs(spark, [(999, 9, 2020, [1, 2, 3, 4, 5])])), (), 42, 10.0).orderBy("source_id").collect()
    assert [r["source_id"] for r in large] == [0, 1, 2, 9]
    assert np.allclose([r["embedding"] for r in small], [r["embedding"] for r in large[:3]], atol=1e-5)


def clustered(spark, sources=2, per=40):
    """Four tight bundles a source, so that every start ends in the same clusters."""
    r, rows = np.random.default_rng(3), []
    for s in range(sources):
        for j in range(4):
            for _ in range(per // 4 + j):
                e = r.normal(scale=0.01, size=6)
                e[j] += 1
                rows.append((len(rows), s, 2020, e))
    return pubs(spark, rows)


@pytest.mark.parametrize("name", ["kmeans@4", "cmedoids@4", "fps@4", "softk@4,30,10", "pca@3"])
def test_large_sources_get_the_same_prototypes(spark, monkeypatch, name):
    df = clustered(spark)
    small = prototypes.aggregate_prototypes(df, name).orderBy("source_id").collect()
    monkeypatch.setattr("orrery.operators.distributed.MAX_ROWS", 39)
    large = prototypes.aggregate_prototypes(df, name).orderBy("source_id").collect()
    assert len(large) == 2 and [r["ids"] for r in large] == [r["ids"] for r in small] and [r["method"] for r in large] == [r["method"] for r in small]
    for a, b in zip(small, large):
        x, y = np.array(a["embeddings"]), np.array(b["embeddings"])
        if name.startswith("fps"):  # another start: the bundles are met all the same
            assert sorted(x.argmax(1)) == sorted(y.argmax(1)) == [0, 1, 2, 3]
            continue
        order = lambda e: np.abs(e).argmax(1).argsort()
        i, j = (range(3), range(3)) if name.startswith("pca") else (order(x), order(y))
        assert np.allclose(x[i], y[j], atol=1e-6)
        if a["weights"]:
            assert np.allclose(np.array(a["weights"])[i], np.array(b["weights"])[j], atol=1e-6)
        if a["cluster_sizes"]:
            assert [a["cluster_sizes"][k] for k in i] == [b["cluster_sizes"][k] for k in j] and sum(b["cluster_sizes"]) == len(b["ids"])
        if a["proto_ids"]:
            assert [a["proto_ids"][k] for k in i] == [b["proto_ids"][k] for k in j]


def test_largest_cluster_of_large_sources(spark, monkeypatch):
    df = clustered(spark, 3)
    monkeypatch.setattr("orrery.operators.distributed.MAX_ROWS", 39)
    for r in aggregate.AGGREGATORS["kmeans"](df, (8.0,), 42, 10.0).collect():
        assert np.isclose(np.linalg.norm(r["embedding"]), 1) and max(r["embedding"]) > 0.99


def test_queries_in_several_passes_and_tiles(spark, monkeypatch):
    df, _ = random_pubs(spark, 80)
    want = rank.knn_by_bucket(df, df, 7, "sql").orderBy("qid", "rank").collect()
    monkeypatch.setattr(rank, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(rank, "TILE_BYTES", 500)
    got = rank.knn_by_bucket(df, df, 7, "block").orderBy("qid", "rank").collect()
    assert [(r["qid"], r["rank"], r["id"]) for r in got] == [(r["qid"], r["rank"], r["id"]) for r in want]
    allowed = years.allowed_sources(df)
    p = df.selectExpr("source_id", "embedding", "id / 100 as prior")
    for pool in rank.POOLS:
        a, b = (rank.rank_prototypes(df, p, allowed, 2, pool, use_priors=True, method=m).orderBy("qid", "rank").collect() for m in ("sql", "block"))
        assert [(r["qid"], r["source_id"], round(r["score"], 9)) for r in a] == [(r["qid"], r["source_id"], round(r["score"], 9)) for r in b], pool
    with pytest.raises(ValueError):
        rank.rank_prototypes(df, p, allowed, pool="nonsense")


def test_empty_index_and_no_years_are_errors(spark):
    df = pubs(spark, [(1, 1, 1990, [1.0])])
    with pytest.raises(ValueError):
        rank.expect_index(df.where("false"))
    with pytest.raises(ValueError):
        years.expect_sources(years.allowed_sources(df))
    assert rank.expect_index(df).count() == 1


def test_all_models_of_a_folder(spark, tmp_path):
    df, _ = random_pubs(spark, 60)
    one = aggregate.aggregate_sources(df, "cosmean").select("source_id", "ids", "embedding")
    many = prototypes.aggregate_prototypes(df, "byyear@2")
    for name, model in (("base_cosmean", one), ("base_byyear", many), ("other_skip0.8", one)):
        (tmp_path / f"{name}.jsonl").write_text("".join(r + "\n" for r in model.toJSON().collect()))
    (tmp_path / "notes.jsonl").write_text('{"x": 1}\n')
    runs = rank.rank_models(spark, str(tmp_path), "base", df, years.allowed_sources(df), 2)
    assert {r["model"]: r["n"] for r in runs.groupBy("model").agg(F.count("*").alias("n")).collect()} == {"cosmean": 60, "byyear": 60}
    with pytest.raises(ValueError):
        rank.rank_models(spark, str(tmp_path / "nothing"), "base", df, years.allowed_sources(df))


def test_evaluation_of_a_tree(spark, tmp_path):
    for task, version, name, rows in (("journal", "v1", "m", [(1, [5]), (2, [6, 5])]), ("journal", "v2", "m", [(1, [9])]), ("conference", "v1", "sub/x", [(3, [7])])):
        path = tmp_path / task / f"{version}_results" / f"{name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(json.dumps({"id": i, "results": r}) + "\n" for i, r in rows))
    truth = lambda rows: spark.createDataFrame(rows, "id bigint, truth bigint")
    got = {r["model"]: (r["HR@1"], r["HR@3"], r["N_evaluated"]) for r in evaluate.evaluate_tree(spark, str(tmp_path), {"journal": truth([(1, 5), (2, 5)]), "conference": truth([(3, 7)])}).collect()}
    assert got == {"journal/v1/m": (1, 2, 2), "journal/v2/m": (0, 0, 1), "conference/v1/x": (1, 1, 1)}
    with pytest.raises(ValueError):
        evaluate.evaluate_tree(spark, str(tmp_path), {"journal": truth([(1, 5)])})


def test_counters_and_resolution(spark, tmp_path):
    types = spark.createDataFrame([("Journal",), ("Conference & Proceedings",), ("Book",), (None,)], "source_type string")
    assert splits.routing_counts(types).first().asDict() == {"read": 4, "journal": 1, "conference": 1, "skipped": 2}
    counts = {r["bucket"]: r["written"] for r in splits.year_counts(spark.createDataFrame([(2019,), (2023,), (1999,), (None,)], "date_year int")).collect()}
    assert counts == {2019: 1, 2020: 1, 2021: 1, 2022: 1, 2023: 1 + 0, None: 4}
    (tmp_path / "texts_all.jsonl.gz").write_bytes(b"")
    (tmp_path / "other.jsonl").write_text("")
    found = lambda name: jsonl.resolve(spark, name, (str(tmp_path),)).rsplit("/", 1)[-1]
    assert found("texts") == "texts_all.jsonl.gz" and found(f"{tmp_path}/other") == "other.jsonl" and found("nowhere/oth") == "other.jsonl"
    with pytest.raises(FileNotFoundError):
        found("missing")


def test_draw_keys_of_large_ids(spark):
    ids = [0, 1, 42, 3_470_000_000, 4_000_000_000, 2**62, 2**63 - 1, -5, -(2**63)]
    got = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", splits.draw_key(F.col("id"), 42).alias("k")).collect()
    assert all(r["k"] == (r["id"] * 2654435761 + 42) % 2**32 for r in got)


def test_medoid_takes_the_first_of_equals(spark):
    df = pubs(spark, [(5, 1, 2020, [1, 0]), (6, 1, 2020, [1, 0]), (7, 1, 2020, [0, 1])])
    assert aggregate.medoid(df, with_id=True).first()["id"] == 5


def test_prototypes(spark):
    df, _ = random_pubs(spark)
    for name in prototypes.KERNELS:
        a = prototypes.aggregate_prototypes(df, f"{name}@4").orderBy("source_id").collect()
        b = prototypes.aggregate_prototypes(df.repartition(7), f"{name}@4").orderBy("source_id").collect()
        assert a == b, name  # whatever the partitions
        for r in a:
            e = np.array(r["embeddings"])
            assert np.allclose(np.linalg.norm(e, axis=1), 1) and len(e) <= 4
            if name in ("kmeans", "softk"):
                assert np.isclose(sum(r["weights"]), 1)
    few = prototypes.aggregate_prototypes(df, "byyear@50").collect()
    assert len(few) == 3 and all(r["embeddings"] == [] for r in few)


def test_priors_that_do_not_fit(spark):
    m = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]], [0.2, 0.3, 0.5]), (2, [[1.0, 0.0]], [0.0]), (3, [], None)], "source_id bigint, embeddings array<array<double>>, weights array<double>")
    assert sorted((r["source_id"], r["prior"]) for r in prototypes.rows_of(m).collect()) == [(1, 1.0), (1, 1.0), (2, 0.0)]


def test_year_windows(spark):
    df = spark.createDataFrame([(y,) for y in range(2017, 2026)], "date_year int")
    got = {}
    for r in years.assign_buckets(df).collect():
        got.setdefault(r["date_year"], set()).add(r["bucket"])
    assert got == {2019: {2019, 2020, 2021, 2022}, 2020: {2020, 2021, 2022, 2023}, 2021: {2021, 2022, 2023}, 2022: {2022, 2023}, 2023: {2023}}


def test_rank_forms_agree(spark):
    df, _ = random_pubs(spark, 200)
    q, index = df.where("id % 10 = 0"), df.where("id % 10 <> 0")
    rows = lambda m: [(r["qid"], r["rank"], r["id"]) for r in rank.knn_by_bucket(q, index, 7, m).orderBy("qid", "rank").collect()]
    assert rows("sql") == rows("block")
    assert {r for _, r, _ in rows("sql")} == set(range(1, 8))
    with pytest.raises(ValueError):
        rank.knn_by_bucket(q, index, 7, "other")


def test_pools_are_ordered_and_single_equals_multi(spark):
    df, _ = random_pubs(spark, 100)
    allowed = years.allowed_sources(df)
    m = prototypes.rows_of(prototypes.aggregate_prototypes(df, "kmeans@5"))
    s = {p: {(r["qid"], r["source_id"]): r["score"] for r in rank.rank_prototypes(df, m, allowed, pool=p).collect()} for p in ("max", "mean", "topm", "softmax")}
    for k in s["max"]:
        assert s["max"][k] + 1e-9 >= s["topm"][k] >= s["mean"][k] - 1e-9
        assert s["max"][k] + 1e-9 >= s["softmax"][k] >= s["mean"][k] - 1e-9
    c = aggregate.cosmean(df)
    one = rank.rank_sources(df, c, allowed, method="sql").select("qid", "rank", "source_id")
    many = rank.rank_prototypes(df, c.withColumn("prior", F.lit(1.0)), allowed, pool="mean").select("qid", "rank", "source_id")
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_queries_without_candidates(spark):
    df, _ = random_pubs(spark, 30)
    ranked = rank.rank_sources(df, aggregate.cosmean(df), years.allowed_sources(df.where("date_year = 2023")))
    runs = rank.as_runs(ranked, "m")
    every = rank.with_empty(runs, df, "m")
    assert runs.count() == 6 and every.count() == 30 and every.where("size(top) = 0").count() == 24


def test_holdout_sizes(spark):
    sizes = {1: 0, 4: 0, 5: 1, 10: 1, 11: 1, 14: 1, 15: 2, 24: 2, 25: 3}
    df = spark.createDataFrame([(1000 * n + i, n) for n in sizes for i in range(n)], "id bigint, source_id bigint")
    held = {r["source_id"]: r["count"] for r in splits.holdout_ids(df).groupBy("source_id").count().collect()}
    assert held == {n: k for n, k in sizes.items() if k}
    assert sorted(splits.holdout_ids(df).collect()) == sorted(splits.holdout_ids(df.repartition(9)).collect())
    test, train = splits.split_by_ids(df.union(spark.createDataFrame([(None, 5)], df.schema)), splits.holdout_ids(df))
    assert test.count() == sum(sizes.values()) and train.where("id is null").count() == 1


def test_slice_from_id(spark):
    values = ['{"id": 1}', '{"id": 2, "x"', '{"id":3}', "junk"]
    lines = spark.createDataFrame(list(enumerate(values)), "pos bigint, value string")
    assert splits.slice_from_id(lines, 2).count() == 3  # a broken line that holds the id
    assert splits.slice_from_id(lines, 3, skip_first=True).count() == 1
    with pytest.raises(LookupError):
        splits.slice_from_id(lines, 9)


def test_dirty_json_lines(spark, tmp_path):
    good = ['{"id":"12","source_id":1,"embedding":[1.0,"2.5"]}', '{"id":3.7,"source_id":" 2 ","embedding":[1,2]}', '{"id":true,"source_id":1,"date_year":"2020","embedding":[1,2]}']
    bad = ['{"id":"3.7","source_id":1,"embedding":[1,2]}', '{"id":null,"source_id":1,"embedding":[1,2]}', "{broken", "[1,2]"]
    passed = ['{"id":5,"source_id":1,"embedding":null}', '{"id":6,"source_id":1,"embedding":[1,null]}', '{"id":7,"source_id":1,"embedding":[1,2,3]}', "", "  "]
    (tmp_path / "x.jsonl").write_text("\n".join(good + bad + passed))
    rows = jsonl.publications(spark, str(tmp_path / "x.jsonl")).orderBy("id").collect()
    assert [(r["id"], r["source_id"], r["date_year"], r["embedding"]) for r in rows] == [(1, 1, 2020, [1.0, 2.0]), (3, 2, None, [1.0, 2.0]), (12, 1, None, [1.0, 2.5])]
    from pyspark.sql import Observation

    seen = Observation()
    jsonl.read(spark, str(tmp_path / "x.jsonl"), jsonl.METADATA, ("id",), observation=seen).collect()
    assert seen.get == {"read": 10, "bad": 4}
    with pytest.raises(Exception, match="bad line"):
        jsonl.read(spark, str(tmp_path / "x.jsonl"), jsonl.METADATA, ("id",), mode="strict").collect()


def test_json_array_and_models(spark, tmp_path):
    (tmp_path / "ids.json").write_text('[3, "17", 3, "x", null]')
    assert sorted(r["id"] for r in jsonl.json_array(spark, str(tmp_path / "ids.json")).collect()) == [3, 17]
    (tmp_path / "no.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a JSON array"):
        jsonl.json_array(spark, str(tmp_path / "no.json")).collect()
    for name, line in (("j_mean.jsonl", {"source_id": 1, "embedding": [1]}), ("a.jsonl", {"source_id": 1, "embeddings": [[1]]}), ("j_0.8.jsonl", {})):
        (tmp_path / name).write_text(json.dumps(line))
    assert [p.rsplit("/", 1)[-1] for p in jsonl.find_models(spark, str(tmp_path), "j")] == ["j_mean.jsonl", "a.jsonl"]
    assert [jsonl.model_kind(spark, str(tmp_path / n)) for n in ("j_mean.jsonl", "a.jsonl", "j_0.8.jsonl")] == ["single", "multi", None]


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([('{"date_year": 2020, "k": 1}',), ('{"date_year": 2030}',), ("no year",)], "value string")
    sinks.year_lines(lines, str(tmp_path / "years"))
    back = spark.read.text(str(tmp_path / "years"))
    assert sorted(r["bucket"] for r in back.collect()) == [2020, 2021, 2022, 2023]
    sinks.json_array(spark.createDataFrame([(3,), (1,)], "id bigint"), str(tmp_path / "ids"))
    assert spark.read.text(str(tmp_path / "ids")).first()["value"] == "[1,3]"
    sinks.partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "x int, mode string"), str(tmp_path / "m"), "mode")
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    sinks.metrics_sheet(spark.createDataFrame([("m", 0.5)], "model string, v double"), str(tmp_path / "sheet"))


def test_source_kinds(spark):
    given = ["Journal", " JOURNAL ", "Conference & Proceedings", "conference  proceedings", "conference&proceedings", "Book Series", None]
    df = spark.createDataFrame([(i, 1, 2020, t) for i, t in enumerate(given)], "id int, publication_source_id int, date_year int, source_type string")
    assert sorted((r["id"], r["kind"]) for r in jdbc.by_kind(df).collect()) == [(0, "journal"), (1, "journal"), (2, "conference"), (3, "conference")]


def test_runs_to_results(spark):
    top = "array<struct<rank:int,source_id:bigint,score:double>>"
    df = spark.createDataFrame([(1, [(1, 7, 0.9), (2, 8, 0.8), (3, 7, 0.7)]), (2, None), (3, [(1, None, 0.9)])], f"query_id bigint, top {top}")
    assert sorted((r["id"], r["results"]) for r in enrich.runs_to_id_results(df).collect()) == [(1, [7, 8]), (2, [])]


def test_attach_texts(spark):
    results = spark.createDataFrame([(1, [2, 9, None, 3]), (4, None)], "id bigint, results array<bigint>")
    known = spark.createDataFrame([(1, 0, "one"), (2, 0, "old"), (2, 1, "two"), (3, 0, " none ")], "id bigint, pos int, explanation string")
    got = {r["query_id"]: (r["explanation"], [tuple(x) for x in r["results"]]) for r in enrich.attach_texts(results, known, "none").collect()}
    assert got == {"1": ("one", [(2, "two"), (9, ""), (3, "")]), "4": ("", [])}


def test_text_fallback(spark):
    df = spark.createDataFrame([("  ", "n"), (None, " "), ("\t", "n")], "a string, n string")
    assert [r[0] for r in df.select(texts.text_or_title(F.col("a"), F.col("n"))).collect()] == ["n", None, "\t"]


def predictions(spark):
    lists = {1: [9], 2: [0, 0, 0, 0, 9], 3: [0] * 5 + [9], 4: [0] * 9 + [9], 5: [0] * 10 + [9], 6: [0], 7: [], 99: [9]}
    rows = [("m", i, r) for i, r in lists.items()] + [("m", 1, [9]), ("none", 99, [1])]
    return spark.createDataFrame(rows, "model string, id bigint, results array<bigint>")


def test_metrics(spark):
    truth = spark.createDataFrame([(i, 9) for i in range(1, 8)], "id bigint, truth bigint")
    got = {r["model"]: r.asDict() for r in evaluate.evaluate(predictions(spark), truth).collect()}
    m = got["m"]
    assert m["N_evaluated"] == 8 and m["HR@1"] == 2 and m["HR@5"] == 3 and m["HR@10"] == 5 and m["HR@20"] == 6
    assert np.isclose(m["MRR@5"], (2 + 1 / 5) / 8) and np.isclose(m["MRR@10"], (2 + 1 / 5 + 1 / 6 + 1 / 10) / 8)
    assert got["none"]["N_evaluated"] == 0 and got["none"]["MRR@5"] == 0.0


def test_metrics_of_a_stream(spark, tmp_path):
    truth = spark.createDataFrame([(i, 9) for i in range(1, 8)], "id bigint, truth bigint")
    static = predictions(spark)
    static.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).json(str(tmp_path / "in"))
    q = streaming.start(streaming.running_metrics(stream, truth), "running", str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    row = spark.table("running").where("model = 'm'").first()
    assert row["N_evaluated"] == 8 and row["HR@10"] == 5


def test_fusion(spark):
    results = spark.createDataFrame([(1, [10, 11, 12])], "id bigint, results array<bigint>")
    truth = spark.createDataFrame([(10, 1), (11, 2), (12, 2)], "id bigint, truth bigint")
    ranked = fuse.ranked_sources(results, truth)
    score = lambda n: {r["source_id"]: r["score"] for r in fuse.fuse(ranked, n).collect()}
    assert score("borda") == {1: 3.0, 2: 3.0} and score("firsthit") == {1: -1.0, 2: -2.0}
    assert np.isclose(score("rrf")[2], 1 / 62 + 1 / 63, atol=1e-9) and np.isclose(score("noisyor")[2], 1 - (2 / 3) * (3 / 4), atol=1e-9)
    with pytest.raises(ValueError):
        fuse.fuse(ranked, "other")
