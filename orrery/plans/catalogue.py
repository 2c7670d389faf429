"""Named queries over the test tables, one for each operator, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import texts as T
from orrery.functions import vectors as V
from orrery.functions import years as Y
from orrery.operators import aggregate as A
from orrery.operators import enrich, evaluate, fuse, prototypes, rank, splits
from orrery.plans import fixtures as X
from orrery.sources import jsonl, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def _six(c) -> F.Column:
    """Rounded to six places; never a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _out(df: DataFrame, keys=("source_id",)) -> DataFrame:
    return V.elements(df, list(keys)).select(*keys, F.col("i").cast("long").alias("i"), _six(F.col("x")).alias("x"))


# --- one vector a source -----------------------------------------------------------------------------------------------

_CENTRE = f"""{X.UNIT}, avgs as (select source_id, i, avg(x) x from ux group by all), centre as (select source_id, i, x / sqrt(sum(x * x) over (partition by source_id)) x from avgs),
own as (select ux.id, ux.source_id, ux.pos, sum(ux.x * c.x) s from ux join centre c using (source_id, i) group by all)"""
_WEIGHTED = """w as (select id, source_id, exp(10 * s - max(10 * s) over (partition by source_id)) w from {scores}),
m as (select source_id, i, sum(w * x) / sum(w) x from ux join w using (id, source_id) group by all)"""

_SINGLE = {
    "mean": f"with {X.RAW} select source_id, i, round(avg(x), 6) + 0.0 x from rawx group by all",
    "sum": f"with {X.RAW} select source_id, i, round(sum(x), 6) + 0.0 x from rawx group by all",
    "max": f"with {X.RAW} select source_id, i, round(max(x), 6) + 0.0 x from rawx group by all",
    "median": f"with {X.RAW} select source_id, i, round(median(x), 6) + 0.0 x from rawx group by all",
    "cosmean": f"with {X.UNIT}, m as (select source_id, i, sum(x) x from ux group by all) {X.renormalised('m')}",
    "softmax": f"""with {X.UNIT}, g0 as (select i, sum(x) x from ux group by i), g as (select i, x / sqrt(sum(x * x) over ()) x from g0),
scores as (select id, source_id, sum(ux.x * g.x) s from ux join g using (i) group by all), {_WEIGHTED.format(scores='scores')} {X.renormalised('m')}""",
    "attn2": f"with {_CENTRE}, {_WEIGHTED.format(scores='own')} {X.renormalised('m')}",
    "tmean": f"""with {_CENTRE}, near as (select id from (select id, row_number() over (partition by source_id order by s desc, pos) r, count(*) over (partition by source_id) n from own) where r <= ceil(0.8::double * n)),
m as (select source_id, i, avg(x) x from ux semi join near using (id) group by all) {X.renormalised('m')}""",
    "winsor": f"""with {X.UNIT}, q as (select source_id, i, quantile_cont(x, 0.1) lo, quantile_cont(x, 0.9) hi, count(*) n from ux group by all),
m as (select source_id, i, avg(case when n < 5 then x else greatest(lo, least(hi, x)) end) x from ux join q using (source_id, i) group by all) {X.renormalised('m')}""",
    "medoid": None, "rm1pc": None, "geom": None, "kmeans": None, "pcfuse": None, "svdshrink": None, "huber": None, "subtrim": None,
}


def _single(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _out(A.AGGREGATORS[name](X.publications(spark, sf_dir), (), 42, 10.0))

    return run


for _name, _sql in _SINGLE.items():
    if _name != "medoid":
        query(_sql, f"src_{_name}")(_single(_name))


@query(f"""with {X.UNIT}, avgs as (select source_id, i, avg(x) x from ux group by all), s as (select ux.id, ux.source_id, ux.pos, sum(ux.x * a.x) s from ux join avgs a using (source_id, i) group by all)
select source_id, id from (select source_id, id, row_number() over (partition by source_id order by round(s, 12) desc, pos) r from s) where r = 1""")
def src_medoid(spark, sf_dir):
    return A.medoid(X.publications(spark, sf_dir), with_id=True).select("source_id", "id")


@query()
def src_all_modes(spark, sf_dir):
    """The model of every default mode, with the ids behind it."""
    return A.aggregate_sources(X.publications(spark, sf_dir)).select("mode", "source_id", F.size("ids").alias("n"), F.posexplode("embedding").alias("i", "x")).select("mode", "source_id", "n", "i", _six(F.col("x")).alias("x"))


# --- prototypes ---------------------------------------------------------------------------------------------------------

def _byyear(least: int) -> str:
    return f"{X.UNIT}, many as (select source_id, y, count(*) n from units group by all having count(*) >= {least}), pa as (select source_id, y, i, avg(x) x from ux group by all), protos as (select source_id, y, n, i, x / sqrt(sum(x * x) over (partition by source_id, y)) x from pa join many using (source_id, y))"


@query(f"with {_byyear(5)} select source_id, y as year, n, i, round(x, 6) + 0.0 x from protos")
def proto_byyear(spark, sf_dir):
    m = prototypes.by_year(X.publications(spark, sf_dir), 5)
    z = m.select("source_id", F.explode(F.arrays_zip("embeddings", "year_keys", "year_counts")).alias("z"))
    rows = z.select("source_id", F.col("z.year_keys").alias("year"), F.col("z.year_counts").cast("long").alias("n"), F.col("z.embeddings").alias("embedding"))
    return _out(rows, ("source_id", "year", "n"))


def _prototype(name: str):
    def run(spark, sf_dir):
        model = prototypes.aggregate_prototypes(X.publications(spark, sf_dir), name)
        rows = prototypes.rows_of(model)
        return V.elements(rows, ["source_id", "proto"], carry=["prior"]).select("source_id", "proto", _six(F.col("prior")).alias("prior"), "i", _six(F.col("x")).alias("x"))

    return run


for _name in prototypes.KERNELS:
    query(name=f"proto_{_name}")(_prototype(_name))


# cases with one exact answer, whatever the draws

_MEDOID = f"""{X.UNIT}, avgs as (select source_id, i, avg(x) x from ux group by all), s as (select ux.id, ux.source_id, ux.pos, sum(ux.x * a.x) s from ux join avgs a using (source_id, i) group by all),
best as (select source_id, id, n from (select source_id, id, row_number() over (partition by source_id order by round(s, 12) desc, pos) r, count(*) over (partition by source_id) n from s) where r = 1)"""


def _one_prototype(name: str):
    def run(spark, sf_dir):
        model = prototypes.aggregate_prototypes(X.publications(spark, sf_dir), f"{name}@1")
        return _out(prototypes.rows_of(model))

    return run


for _name in ("kmeans", "softk"):
    query(_SINGLE["cosmean"], f"proto_{_name}_of_one")(_one_prototype(_name))


@query(f"with {_MEDOID} select source_id, id as proto_id, n as size from best")
def proto_cmedoids_of_one(spark, sf_dir):
    m = prototypes.aggregate_prototypes(X.publications(spark, sf_dir), "cmedoids@1")
    return m.select("source_id", F.col("proto_ids")[0].alias("proto_id"), F.col("cluster_sizes")[0].cast("long").alias("size"))


@query("select label::bigint source_id, vec_id::bigint as proto_id from embeddings")
def proto_fps_of_all(spark, sf_dir):
    """As many points as there are: every one is chosen, once."""
    m = prototypes.aggregate_prototypes(X.publications(spark, sf_dir), "fps@1000000")
    return m.select("source_id", F.explode("proto_ids").alias("proto_id"))


@query("select source_id, k as proto, 1.0::double as norm, true as falling from (select distinct label::bigint source_id from embeddings), (select unnest([0, 1, 2])::int k)")
def proto_pca_axes(spark, sf_dir):
    """Axes of length 1, in falling order of their singular values."""
    m = prototypes.aggregate_prototypes(X.publications(spark, sf_dir), "pca@3")
    rows = m.select("source_id", F.posexplode("embeddings").alias("proto", "embedding"), "weights")
    falling = F.forall(F.sequence(F.lit(1), F.size("weights") - 1), lambda i: F.get("weights", i) <= F.get("weights", i - 1))
    return rows.select("source_id", "proto", _six(V.norm(F.col("embedding"))).alias("norm"), falling.alias("falling"))


_UNIT_MODES = ("cosmean", "rm1pc", "softmax", "geom", "tmean", "winsor", "kmeans", "pcfuse", "svdshrink", "huber", "attn2", "subtrim")


@query(f"select mode, source_id, n, dim, case when mode in {_UNIT_MODES} then 1.0::double end as norm from (select label::bigint source_id, count(*) n, max(len(embedding)) dim from embeddings group by all), (select unnest({sorted(A.AGGREGATORS)}) as mode)")
def src_all_modes_shape(spark, sf_dir):
    """Every mode's model: all sources, their ids, and length 1 where vectors are normalised."""
    model = A.aggregate_sources(X.publications(spark, sf_dir)).withColumn("mode", F.regexp_extract("mode", "^[a-z0-9]+", 0))
    norm = F.when(F.col("mode").isin(*_UNIT_MODES), _six(V.norm(F.col("embedding"))))
    return model.select("mode", "source_id", F.size("ids").cast("long").alias("n"), F.size("embedding").cast("long").alias("dim"), norm.alias("norm"))


@query("select distinct label::bigint source_id, 0.0::double as moved from embeddings")
def src_huber_stands_still(spark, sf_dir):
    """One more round from the centre of each source: it doesn't move."""
    rows = A.unit_rows(X.publications(spark, sf_dir))
    centres = A.AGGREGATORS["huber"](rows, (0.2,), 42, 10.0).select("source_id", F.col("embedding").alias("centre"))
    d = 1 - V.dot(F.col("embedding"), F.col("centre"))
    weighed = rows.join(centres, "source_id").withColumn("w", F.when(d <= 0.2, 1.0).otherwise(0.2 / (d + 1e-9)))
    again = V.gather(V.elements(weighed, ["source_id"], carry=["w"]).groupBy("source_id", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x")), ["source_id"])
    moved = F.zip_with(V.unit(F.col("embedding")), "centre", lambda a, b: a - b)
    return again.join(centres, "source_id").select("source_id", (F.round(V.norm(moved), 3) + F.lit(0.0)).alias("moved"))


# --- years ------------------------------------------------------------------------------------------------------------------

_WINDOWS = X.BUCKETED.format(rows="meta")


@query(f"with {X.META}, {_WINDOWS} select bucket, count(*) n from windows group by bucket")
def year_split_counts(spark, sf_dir):
    return Y.assign_buckets(X.metadata(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"with {X.PUBS}, {X.BUCKETED.format(rows='pubs')} select bucket, id from windows")
def year_split_rows(spark, sf_dir):
    return Y.assign_buckets(X.publications(spark, sf_dir)).select("bucket", "id")


@query(f"with {X.META}, {_WINDOWS} select distinct bucket, source_id from windows")
def year_sources(spark, sf_dir):
    return Y.allowed_sources(X.metadata(spark, sf_dir))


@query(f"with {X.META} select id, greatest(2019, least(2023, y)) bucket from meta")
def bucket_clamp(spark, sf_dir):
    return X.metadata(spark, sf_dir).select("id", Y.bucket(F.col("date_year")).alias("bucket"))


@query("select vec_id::bigint id, case when vec_id % 4 = 3 then null else 2017 + vec_id % 9 end as year from embeddings")
def year_of_text(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    year = (2017 + F.col("vec_id") % 9).cast("string")
    line = F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit('{"date_year":'), year, F.lit("}"))).when(F.col("vec_id") % 4 == 1, F.concat(F.lit('{"date_year" : "'), year, F.lit('"}'))).when(F.col("vec_id") % 4 == 2, F.concat(F.lit('{"date_year": '), year, F.lit("1}"))).otherwise(F.lit('{"year": 2020}'))
    return e.select(F.col("vec_id").alias("id"), Y.year_of_text(line).cast("long").alias("year"))


# --- ranking --------------------------------------------------------------------------------------------------------------------


def _index_sql(rows: str) -> str:
    return f"""{X.PUBS}, train as (select * from units), q as (select id qid, greatest(2019, least(2023, y)) bucket, u from units where id % 20 = 0), {X.BUCKETED.format(rows=rows)}"""


_KNN = _index_sql("train") + ", scored as (select q.qid, w.id, list_inner_product(q.u, w.u) score from q join windows w using (bucket)), knn as (select *, row_number() over (partition by qid order by score desc, id) r from scored)"


@query(f"with {_KNN} select qid, r as rank, id, round(score, 6) + 0.0 score from knn where r <= 10")
def pub_topk(spark, sf_dir):
    return _knn(spark, sf_dir, 10).select("qid", F.col("rank").cast("long").alias("rank"), "id", _six(F.col("score")).alias("score"))


@query(ORACLES["pub_topk"])
def pub_topk_block(spark, sf_dir):
    return _knn(spark, sf_dir, 10, "block").select("qid", F.col("rank").cast("long").alias("rank"), "id", _six(F.col("score")).alias("score"))


def _knn(spark, sf_dir, k, method="auto"):
    return rank.knn_by_bucket(X.queries(spark, sf_dir), X.publications(spark, sf_dir), k, method)


_RANKED = (
    _index_sql("train")
    + """, tx as (select source_id, unnest(u) x, generate_subscripts(u, 1) - 1 i from train), ts as (select source_id, i, sum(x) x from tx group by all), tn as (select source_id, i, x / sqrt(sum(x * x) over (partition by source_id)) x from ts),
model as (select source_id, list(x order by i) v from tn group by source_id), allowed as (select distinct bucket, source_id from windows),
ranked as (select qid, source_id, score, row_number() over (partition by qid order by score desc, source_id) r from (select q.qid, m.source_id, list_inner_product(q.u, m.v) score from q join allowed using (bucket) join model m using (source_id)))"""
)


def _rank_single(spark, sf_dir):
    rows = X.publications(spark, sf_dir)
    return rank.rank_sources(X.queries(spark, sf_dir), A.cosmean(rows), Y.allowed_sources(rows), 50, "sql")


@query(f"with {_RANKED} select qid, r as rank, source_id, round(score, 6) + 0.0 score from ranked where r <= 50")
def src_rank_single(spark, sf_dir):
    return _rank_single(spark, sf_dir).select("qid", F.col("rank").cast("long").alias("rank"), "source_id", _six(F.col("score")).alias("score"))


def _metrics_sql(ranks: str) -> str:
    mrr = ", ".join(f'round(avg(case when rank between 1 and {n} then 1.0::double / rank else 0 end), 6) as "MRR@{n}"' for n in (5, 10))
    hr = ", ".join(f'count(*) filter (rank between 1 and {k}) as "HR@{k}", round(avg(case when rank between 1 and {k} then 1.0::double else 0 end), 6) as "HR@{k}_%"' for k in evaluate.KS)
    return f"select 'cosmean' as model, {mrr}, {hr}, count(*) as \"N_evaluated\" from ({ranks})"


@query(f"with {_RANKED} {_metrics_sql('select p.id, coalesce(max(case when k.source_id = p.source_id then k.r end), 0) as rank from pubs p join ranked k on k.qid = p.id where k.r <= 20 group by p.id')}")
def eval_metrics(spark, sf_dir):
    """Publications ranked against sources, scored against their own source."""
    runs = rank.as_runs(_rank_single(spark, sf_dir), "cosmean")
    results = enrich.runs_to_id_results(runs).withColumn("model", F.lit("cosmean"))
    out = evaluate.evaluate(results, evaluate.truth_of(X.publications(spark, sf_dir)))
    return out.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in out.dtypes])


_PROTOS = (
    _byyear(3)
    + f""", train as (select * from units), q as (select id qid, greatest(2019, least(2023, y)) bucket, u from units where id % 20 = 0), {X.BUCKETED.format(rows='train')}, allowed as (select distinct bucket, source_id from windows),
model as (select source_id, y, any_value(n) n, list(x order by i) v from protos group by source_id, y), scored as (select q.qid, m.source_id, 1.0::double p, list_inner_product(q.u, m.v) s from q join allowed using (bucket) join model m using (source_id))"""
)
_POOLS = {
    "max": "select qid, source_id, max(s) score from scored group by all",
    "mean": "select qid, source_id, avg(s) score from scored group by all",
    "topm": "select qid, source_id, avg(s) score from (select *, row_number() over (partition by qid, source_id order by s desc) t from scored) where t <= 3 group by all",
    "softmax": "select qid, source_id, sum(e * s) / greatest(sum(e), 1e-9) score from (select *, p * exp(10 * (s - max(s) over (partition by qid, source_id))) e from scored) group by all",
}
_POOLS["softmax_priors"] = _POOLS["softmax"]


def _pooled(name: str, method: str):
    def run(spark, sf_dir):
        rows = X.publications(spark, sf_dir)
        model = prototypes.by_year(rows, 3).withColumn("weights", F.when(F.lit(name == "softmax_priors"), F.transform("year_counts", lambda n: n / 10.0)).otherwise(F.lit(None)))
        ranked = rank.rank_prototypes(X.queries(spark, sf_dir), prototypes.rows_of(model), Y.allowed_sources(rows), 50, name.split("_")[0], use_priors=name == "softmax_priors", method=method)
        return ranked.select("qid", F.col("rank").cast("long").alias("rank"), "source_id", _six(F.col("score")).alias("score"))

    return run


for _name, _sql in _POOLS.items():
    _source = _PROTOS.replace("1.0::double p", "n / 10.0::double p") if _name == "softmax_priors" else _PROTOS
    _sql = f"with {_source} select qid, row_number() over (partition by qid order by score desc, source_id) as rank, source_id, round(score, 6) + 0.0 score from ({_sql}) qualify rank <= 50"
    query(_sql, f"src_rank_pool_{_name}")(_pooled(_name, "sql"))
    query(_sql, f"src_rank_pool_{_name}_block")(_pooled(_name, "block"))


# --- hold-out and splits -----------------------------------------------------------------------------------------------------------


@query(f"with {X.META} select source_id, count(distinct id) n, array_to_string(list_sort(list(distinct id)), ',') ids from meta group by source_id")
def source_lists(spark, sf_dir):
    return splits.source_id_lists(X.metadata(spark, sf_dir)).select("source_id", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"with {X.META}, l as (select source_id, count(distinct id) n from meta group by source_id) select count(*) sources, count(*) filter (n >= 5) with_5, count(*) filter (n >= 10) with_10, sum(n)::bigint items from l")
def source_list_stats(spark, sf_dir):
    return splits.list_counts(splits.source_id_lists(X.metadata(spark, sf_dir)))


_SIZE = "case when n < 5 then 0 when n <= 10 then 1 else (n + 5) // 10 end"


@query(f"with {X.META} select source_id, n, {_SIZE} take from (select source_id, count(*) n from meta group by source_id)")
def holdout_sizes(spark, sf_dir):
    return X.metadata(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n")).withColumn("take", splits.holdout_size(F.col("n")))


_HELD = f"{X.META}, held as (select source_id, id from (select *, count(*) over (partition by source_id) n, row_number() over (partition by source_id order by (id * 2654435761 + 42) % 4294967296, id) r from meta) where r <= {_SIZE})"


@query(f"with {_HELD} select source_id, id from held")
def holdout_ids(spark, sf_dir):
    return splits.holdout_ids(X.metadata(spark, sf_dir))


def _split(spark, sf_dir):
    rows = X.metadata(spark, sf_dir)
    return splits.split_by_ids(rows, splits.holdout_ids(rows))


@query(f"with {_HELD} select id, source_id, y as date_year from meta semi join held using (id)")
def split_test(spark, sf_dir):
    return _split(spark, sf_dir)[0]


@query(f"with {_HELD} select id, source_id, y as date_year from meta anti join held using (id)")
def split_train(spark, sf_dir):
    return _split(spark, sf_dir)[1]


@query(f"with {_HELD} select (select count(*) from meta semi join held using (id)) moved, (select count(*) from meta anti join held using (id)) kept")
def split_dry_run(spark, sf_dir):
    rows = X.metadata(spark, sf_dir)
    return splits.split_counts(rows, splits.holdout_ids(rows))


@query("select o_orderkey::bigint pos, '{\"id\":' || o_orderkey || '}' as value from orders where o_orderkey >= 100")
def slice_from_id(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return splits.slice_from_id(o.select(F.col("o_orderkey").cast("long").alias("pos"), F.format_string('{"id":%d}', "o_orderkey").alias("value")), 100).select("pos", "value")


# --- runs, texts, evaluation ---------------------------------------------------------------------------------------------------------


@query(f"with {_RANKED} select qid as id, string_agg(source_id, ',' order by r) results from ranked where r <= 50 group by qid")
def run_to_ids(spark, sf_dir):
    return enrich.runs_to_id_results(rank.as_runs(_rank_single(spark, sf_dir), "cosmean")).select("id", F.array_join(F.col("results").cast("array<string>"), ",").alias("results"))


@query(f"with {_KNN} select qid as id from knn where r <= 3 union select id from knn where r <= 3")
def unique_ids(spark, sf_dir):
    return enrich.unique_ids(rank.as_results(_knn(spark, sf_dir, 3)))


_FALLBACK = "select id, coalesce(nullif(trim(abstract, ' '), ''), nullif(trim(name, ' '), '')) explanation from pubtexts"


@query(f"with {X.TEXTS} select * from ({_FALLBACK}) where explanation is not null")
def texts_fallback(spark, sf_dir):
    rows = X.texts(spark, sf_dir)
    return enrich.fetch_texts(rows.select("id"), rows)


@query(f"""with {_KNN}, {X.TEXTS}, t as ({_FALLBACK}), r as (select qid, 0 as place, qid as id from knn where r = 1 union all select qid, r, id from knn where r <= 3)
select qid::varchar query_id, place, r.id, coalesce(explanation, '') explanation from r left join t on t.id = r.id""")
def top_with_text(spark, sf_dir):
    results = rank.as_results(_knn(spark, sf_dir, 3))
    texts = enrich.fetch_texts(enrich.unique_ids(results), X.texts(spark, sf_dir))
    rich = enrich.attach_texts(results, texts)
    own = F.struct(F.col("query_id").cast("long").alias("id"), F.col("explanation"))
    return rich.select("query_id", F.posexplode(F.concat(F.array(own), "results")).alias("place", "r")).select("query_id", F.col("place").cast("long").alias("place"), "r.id", "r.explanation")


_TYPES = ("Journal", " JOURNAL ", "Conference & Proceedings", "conference  proceedings", "conference&proceedings", "Book Series", None)
_KINDS = ("journal", "journal", "conference", "conference", None, None, None)


@query("select n_nationkey::bigint id, case n_nationkey % 7 " + " ".join(f"when {i} then {'null' if k is None else repr(k)}" for i, k in enumerate(_KINDS)) + " end as kind from nation")
def kind_normalize(spark, sf_dir):
    types = F.lit(None).cast("string")
    for i, t in enumerate(_TYPES):
        types = F.when(F.col("n_nationkey") % 7 == i, F.lit(t)).otherwise(types)
    return X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), T.source_kind(types).alias("kind"))


@query("select doc_id id, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then '' else text end as explanation from documents")
def placeholder_cleanup(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("\t no text\n")).when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("id"), T.without_placeholder(raw, "no text").alias("explanation"))


@query("select vec_id::bigint id, label::bigint source_id, (2017 + vec_id % 9)::int date_year, len(embedding) dim from embeddings where vec_id % 5 <> 4")
def jsonl_publications(spark, sf_dir):
    """Publications through JSON lines: ids as numbers, texts and fractions, and every fifth line broken."""
    p = X.publications(spark, sf_dir)
    id_ = F.when(F.col("id") % 5 == 1, F.format_string('"%d"', "id")).when(F.col("id") % 5 == 2, F.format_string("%d.5", "id")).when(F.col("id") % 5 == 3, F.format_string('" %d "', "id")).otherwise(F.col("id").cast("string"))
    line = F.concat(F.lit('{"id":'), id_, F.lit(',"source_id":'), F.col("source_id"), F.lit(',"date_year":'), F.col("date_year"), F.lit(',"embedding":['), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]}"))
    lines = p.select(F.when(F.col("id") % 5 == 4, F.lit('{"id": broken')).otherwise(line).alias("value"), "pos")
    rows = jsonl.parse(lines, jsonl.PUBLICATIONS, ("id", "source_id"))
    return rows.select("id", "source_id", "date_year", F.size("embedding").cast("long").alias("dim"))


# --- files: written to the shared folder, and read back -----------------------------------------------------------------------------------


def _written(spark, write, name: str) -> str:
    path = sinks.fresh_path(spark, name)
    write(path)
    return path


@query("select vec_id::bigint id, label::bigint source_id, (2017 + vec_id % 9)::int date_year, len(embedding) dim from embeddings")
def file_publications(spark, sf_dir):
    path = _written(spark, lambda p: sinks.json_lines(X.publications(spark, sf_dir).drop("pos"), p), "publications")
    return jsonl.publications(spark, path).select("id", "source_id", "date_year", F.size("embedding").cast("long").alias("dim"))


@query("select vec_id::bigint id, label::bigint source_id, (2017 + vec_id % 9)::int date_year from embeddings where vec_id % 7 <> 3")
def file_publications_gzip(spark, sf_dir):
    """Compressed lines in one folder a source, every seventh cut off."""
    rows = X.publications(spark, sf_dir).drop("pos", "embedding")
    line = F.to_json(F.struct("*"))
    cut = rows.select("source_id", F.when(F.col("id") % 7 == 3, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    path = _written(spark, lambda p: cut.withColumnRenamed("source_id", "of").write.partitionBy("of").option("compression", "gzip").text(p), "gzip")
    return jsonl.read(spark, path, jsonl.METADATA, ("id", "source_id"), recursive=True).select("id", "source_id", "date_year")


@query("select o_orderkey::bigint id from orders where o_orderkey % 3 = 0")
def file_json_array(spark, sf_dir):
    ids = X.metadata(spark, sf_dir).where("id % 3 = 0").select("id")
    return jsonl.json_array(spark, _written(spark, lambda p: sinks.json_array(ids, p), "ids"))


@query(f"with {X.META}, {_WINDOWS} select bucket, id, source_id from windows")
def file_year_lines(spark, sf_dir):
    """Raw lines into the folder of each bucket, and read from there."""
    lines = X.metadata(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    path = _written(spark, lambda p: sinks.year_lines(lines, p), "years")
    rows = spark.read.text(path).select("bucket", "value", F.lit(0).alias("pos"))
    parsed = jsonl.parse(rows.select(F.concat(F.lit('{"bucket":'), "bucket", F.lit(","), F.substring("value", 2, 1 << 20)).alias("value")), (*jsonl.METADATA, ("bucket", "$.bucket", "int")), ("id", "source_id"))
    return parsed.select("bucket", "id", "source_id")


@query(f"with {X.META} select y as date_year, count(*) n, sum(id)::bigint ids from meta group by all")
def file_partitioned(spark, sf_dir):
    path = _written(spark, lambda p: sinks.partitioned(X.metadata(spark, sf_dir), p, "date_year", "parquet"), "partitioned")
    return spark.read.parquet(path).groupBy("date_year").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"with {_RANKED} select 'cosmean' as model, qid as query_id, count(*) filter (r <= 50) as n, string_agg(source_id, ',' order by r) filter (r <= 50) as sources from ranked group by qid")
def file_models_ranked(spark, sf_dir):
    """A model file is found in its folder, told by its lines, and ranked."""
    rows = X.publications(spark, sf_dir)
    model = A.cosmean(rows).withColumn("ids", F.array().cast("array<bigint>"))
    folder = sinks.fresh_path(spark, "models")
    sinks.json_lines(model, f"{folder}/base_cosmean.jsonl")
    runs = rank.rank_models(spark, folder, "base", X.queries(spark, sf_dir), Y.expect_sources(Y.allowed_sources(rows)))
    return runs.select("model", "query_id", F.size("top").cast("long").alias("n"), F.array_join(F.col("top.source_id").cast("array<string>"), ",").alias("sources"))


@query(f"with {_RANKED} {_metrics_sql('select p.id, coalesce(max(case when k.source_id = p.source_id then k.r end), 0) as rank from pubs p join ranked k on k.qid = p.id where k.r <= 20 group by p.id').replace(chr(39) + 'cosmean' + chr(39), chr(39) + 'journal/v1/cosmean' + chr(39))}")
def file_tree_evaluated(spark, sf_dir):
    """Predictions in a tree of tasks and versions, evaluated against the truth of their task."""
    folder = sinks.fresh_path(spark, "tree")
    sinks.json_lines(enrich.runs_to_id_results(rank.as_runs(_rank_single(spark, sf_dir), "cosmean")), f"{folder}/journal/v1_results/part")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    lines = spark.read.text(f"{folder}/journal/v1_results/part").coalesce(1)
    lines.write.text(f"{folder}/one")
    written = next(str(x.getPath()) for x in fs.globStatus(part(f"{folder}/one/part-*")))
    fs.rename(part(written), part(f"{folder}/journal/v1_results/cosmean.jsonl"))
    fs.delete(part(f"{folder}/journal/v1_results/part"), True)
    out = evaluate.evaluate_tree(spark, folder, {"journal": evaluate.truth_of(X.publications(spark, sf_dir))})
    return out.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in out.dtypes])


@query(f"with {X.META} select b.bucket, coalesce(n, 0) as written from (select unnest([2019, 2020, 2021, 2022, 2023])::int bucket) b left join (select bucket, count(*) n from (select w.bucket from windows w) group by bucket) using (bucket) union all select null, count(*) from meta".replace("from windows w", f"from ({X.BUCKETED.format(rows='meta').split('windows as (')[1][:-1].replace('join buckets b', 'join (select unnest([2019, 2020, 2021, 2022, 2023]) bucket) b')}) w"))
def count_years(spark, sf_dir):
    return splits.year_counts(X.metadata(spark, sf_dir))


@query("select count(*) as read, count(*) filter (n_nationkey % 7 in (0, 1)) as journal, count(*) filter (n_nationkey % 7 in (2, 3)) as conference, count(*) filter (n_nationkey % 7 > 3) as skipped from nation")
def count_routing(spark, sf_dir):
    types = F.lit(None).cast("string")
    for i, t in enumerate(_TYPES):
        types = F.when(F.col("n_nationkey") % 7 == i, F.lit(t)).otherwise(types)
    return splits.routing_counts(X.table(spark, sf_dir, "nation").select(types.alias("source_type")))


# --- fusion ------------------------------------------------------------------------------------------------------------------------------

_HITS = _KNN + ", hits as (select k.qid, p.source_id, k.r, count(*) over (partition by k.qid) n from knn k join pubs p on p.id = k.id where k.r <= 50)"
_FUSED = {
    "rrf": "sum(1.0::double / (60 + r))",
    "rrf_minrank": "1.0::double / (60 + min(r))",
    "dcg": "sum(1.0::double / log2(r + 1))",
    "borda": "sum(n - r + 1)::double",
    "noisyor": "1 - exp(sum(ln(1 - 1.0::double / (r + 1))))",
    "firsthit": "-min(r)::double",
    "slice": "ln(1 + count(*) filter (r <= 10)) + 0.5::double * ln(1 + count(*) filter (r > 10 and r <= 50)) + case when min(r) <= 3 then 0.1::double else 0 end",
}


def _ranked_sources(spark, sf_dir):
    truth = evaluate.truth_of(X.publications(spark, sf_dir))
    return fuse.ranked_sources(rank.as_results(_knn(spark, sf_dir, 50)), truth)


def _fused(name: str):
    def run(spark, sf_dir):
        return fuse.fuse(_ranked_sources(spark, sf_dir), name, 20).select("qid", F.col("rank").cast("long").alias("rank"), "source_id", _six(F.col("score")).alias("score"))

    return run


for _name, _sql in _FUSED.items():
    query(f"with {_HITS}, f as (select qid, source_id, round({_sql}, 9) score from hits group by all) select qid, row_number() over (partition by qid order by score desc, source_id) as rank, source_id, round(score, 6) + 0.0 score from f qualify rank <= 20", f"fuse_{_name}")(_fused(_name))


@query(f"""with {_HITS}, f as (select qid, source_id, round(sum(1.0::double / (60 + r)), 9) score from hits group by all), o as (select *, row_number() over (partition by qid order by score desc, source_id) r from f)
select qid, row_number() over (partition by qid order by (source_id * 7 + qid) % 6 desc, r, source_id) as new_rank, source_id from o where r <= 20""")
def rerank_rescore(spark, sf_dir):
    ranked = fuse.fuse(_ranked_sources(spark, sf_dir), "rrf", 20)
    scores = ranked.select("qid", "source_id", ((F.col("source_id") * 7 + F.col("qid")) % 6).alias("new_score"))
    return fuse.rescore(ranked, scores).select("qid", F.col("new_rank").cast("long").alias("new_rank"), "source_id")
