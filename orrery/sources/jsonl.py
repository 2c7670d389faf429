"""Tolerant readers of JSON lines: values are coerced field by field, and bad lines skipped, counted or fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orrery.functions import vectors as V

MODES = ("skip", "strict")

#: Fields of the known relations, as (name, JSON path, type).
PUBLICATIONS = (("id", "$.id", "bigint"), ("source_id", "$.source_id", "bigint"), ("date_year", "$.date_year", "int"), ("embedding", "$.embedding", "array<double>"))
QUERIES = (("id", "$.id", "bigint"), ("date_year", "$.date_year", "int"), ("embedding", "$.embedding", "array<double>"))
METADATA = PUBLICATIONS[:3]
SINGLE_MODEL = (("source_id", "$.source_id", "bigint"), ("ids", "$.ids", "array<bigint>"), ("embedding", "$.embedding", "array<double>"))
MULTI_MODEL = (
    ("source_id", "$.source_id", "bigint"), ("ids", "$.ids", "array<bigint>"), ("method", "$.method", "string"), ("embeddings", "$.embeddings", "array<array<double>>"), ("weights", "$.weights", "array<double>"),
    ("cluster_sizes", "$.cluster_sizes", "array<int>"), ("proto_ids", "$.proto_ids", "array<bigint>"), ("year_keys", "$.year_keys", "array<int>"), ("year_counts", "$.year_counts", "array<int>"),
)
RESULTS = (("id", "$.id", "bigint"), ("results", "$.results", "array<bigint>"))
TEXTS = (("id", "$.id", "bigint"), ("explanation", "$.explanation", "string"))
RUNS = (("model", "$.model", "string"), ("query_id", "$.query_id", "bigint"), ("year_bucket", "$.year_bucket", "int"), ("top", "$.top", "array<struct<rank:int,source_id:bigint,score:double>>"))


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """value, file, pos: raw lines (gzip by suffix), their file, and a number that grows with the line within each file."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"))


def _field(parsed: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(parsed, path, kind)


def parse(raw: DataFrame, fields, required: tuple[str, ...] = (), mode: str = "skip", observation: Observation | None = None) -> DataFrame:
    """Fields of the lines of `raw` (value, file, pos). Blank lines are nothing; lines that aren't JSON objects, or lack a required field, are bad.

    strict: a bad line is an error. skip: it is left out, and counted in the observation (read, bad) if there is one.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: not one of {MODES}")
    carried = [c for c in ("file", "pos") if c in raw.columns]
    rows = raw.where(F.trim(F.col("value")) != "").withColumn("_v", F.try_parse_json("value"))
    rows = rows.select("value", *carried, F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)).alias("_ok"), *[_field(F.col("_v"), path, kind).alias(name) for name, path, kind in fields])
    good = F.col("_ok")
    for name in required:
        good = good & F.col(name).isNotNull()
    if observation is not None:
        rows = rows.observe(observation, F.count("*").alias("read"), F.count_if(~good).alias("bad"))
    if mode == "strict":
        rows = rows.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.substring("value", 1, 200)))))
    else:
        rows = rows.where(good)
    return rows.select(*carried, *[name for name, *_ in fields])


def read(spark: SparkSession, path, fields, required=(), mode: str = "skip", observation: Observation | None = None, **where) -> DataFrame:
    return parse(lines(spark, path, **where), fields, required, mode, observation)


def publications(spark: SparkSession, path, dim: int | None = None, **kw) -> DataFrame:
    """id, source_id, date_year, embedding, pos. Lines without an embedding are passed over, not bad; vectors of another length are dropped."""
    rows = read(spark, path, PUBLICATIONS, ("id", "source_id"), **kw).where(V.is_valid(F.col("embedding")))
    if dim is None:
        first = rows.agg(F.min_by(F.size("embedding"), F.struct("file", "pos")).alias("d")).first()
        dim = first["d"]
    return rows.where(F.size("embedding") == F.lit(dim))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """id: distinct integers of a file that holds one JSON array. Another JSON value is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("_v"))
    ids = F.try_variant_get("_v", "$", "array<bigint>")
    checked = whole.select(F.when(F.schema_of_variant("_v").startswith("ARRAY"), F.coalesce(ids, F.array().cast("array<bigint>"))).otherwise(F.raise_error(F.lit("not a JSON array")).cast("array<bigint>")).alias("_a"))
    return checked.select(F.explode("_a").alias("id")).where("id is not null").distinct()


def model_kind(spark: SparkSession, path: str) -> str | None:
    """single, multi, or None, by the first ten lines."""
    v = F.try_parse_json("value")
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    seen = spark.read.text(path).limit(10).agg(F.bool_or(has("$.embeddings")).alias("multi"), F.bool_or(has("$.embedding")).alias("single")).first()
    return "multi" if seen["multi"] else "single" if seen["single"] else None


def find_models(spark: SparkSession, folder: str, prefix: str, exclude: str | None = "0.8") -> list[str]:
    """Paths of the model files in a folder: those that start with the prefix first, then by name; without names that hold `exclude`."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.jsonl")
    found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path)
    paths = [str(s.getPath()) for s in found]
    name = lambda p: p.rsplit("/", 1)[-1]
    return sorted((p for p in paths if not exclude or exclude not in name(p)), key=lambda p: (not name(p).startswith(prefix), name(p)))


def resolve(spark: SparkSession, name: str, folders: tuple[str, ...] = (".",)) -> str:
    """The file that a name stands for: itself, with .jsonl or .jsonl.gz behind it, or the first in one of the folders whose name begins like it. None is an error."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def first(pattern: str) -> str | None:
        path = Path(pattern)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return min((str(s.getPath()) for s in found if s.isFile()), default=None)

    base = name.rsplit("/", 1)[-1]
    patterns = [name + end for end in ("", ".jsonl", ".jsonl.gz")] + [f"{folder}/{base}*{end}" for folder in folders for end in (".jsonl", ".jsonl.gz")]
    for pattern in patterns:
        if path := first(pattern):
            return path
    raise FileNotFoundError(f"no file for {name!r}: tried {', '.join(patterns)}")
