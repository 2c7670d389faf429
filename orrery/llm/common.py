"""What the operators share: table access, shared storage for cut lineage, and shipping code to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import orrery
from orrery.sources.sinks import fresh_path, shared_dir

#: Folders that materialise() has written in the scope at hand, if there is one.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, hint: str = "part", narrow: bool = False) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so that a lost executor costs no recomputation.

    narrow: rows of a few numbers, that need no more files than twice the cores of the cluster.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = fresh_path(spark, hint)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        ours = f"{shared_dir(df.sparkSession).removeprefix('file:').rstrip('/')}/orrery/".replace("//", "/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if ours in folder.replace("//", "/"):
                _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """A scope at whose end all that was materialised inside is deleted, but for names added to the set it gives (the hints of materialise())."""
    token, kept = _MADE.set([]), set()
    try:
        yield kept
    finally:
        made = _MADE.get() or []
        _MADE.reset(token)
        for path in made:
            if path.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in kept:
                _delete(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than the cluster has cores, dealt out among all: a file may be no more than one task's work, however long its texts take."""
    files, cores = len(df._jdf.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < files < cores else df


#: Bits of the filter on ids: 2048 bitmaps of 4 kB, 8 MB in all, whatever the number of ids.
FILTER_BITS = 1 << 26
BITMAP_BITS = 32_768


def _marked(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """row (a struct of all columns of df) and maybe: false for rows whose keys can't be among those of `ids`.

    A broadcast bitmap of hashes of fixed size; the more ids, the more it lets through.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    hashed = ids.select(slot.alias("h"))
    maps = hashed.groupBy(F.floor(F.col("h") / BITMAP_BITS).cast("int").alias("m")).agg(F.bitmap_construct_agg((F.col("h") % BITMAP_BITS)).alias("bits"))
    rows = df.select(F.struct(*df.columns).alias("row"), slot.alias("slot")).withColumn("m", F.floor(F.col("slot") / BITMAP_BITS).cast("int")).join(F.broadcast(maps), "m", "left")
    at = (F.col("slot") % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, cast((slot % 32768) % 8 as int)) & 1")
    return rows.withColumn("byte", byte).select("row", F.coalesce(bit == 1, F.lit(False)).alias("maybe"))


def maybe_among(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys may be among those of `ids`: all that are, and few others."""
    return _marked(df, ids, keys).where("maybe").select("row.*")


def with_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of df whose id is among `ids`. Most others are dropped before the shuffle."""
    return maybe_among(df, ids, [id_col]).join(ids.select(id_col).distinct(), id_col, "left_semi").select(*df.columns)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of df whose id isn't among `ids`; rows without id stay. Only rows that the filter can't tell are shuffled."""
    marked = _marked(df, ids.where(F.col(id_col).isNotNull()), [id_col])
    clear = marked.where("not maybe").select("row.*")
    return clear.unionByName(marked.where("maybe").select("row.*").join(ids.select(id_col).distinct(), id_col, "left_anti").select(*df.columns))


#: Bytes of one Arrow batch to Python, where the session sets none; few texts are so long that one alone has more.
BATCH_BYTES = 8 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Give the memory that a task's batches and caches took back to the system: workers live on after their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: its functions are pickled by reference."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    if getattr(sc, "_orrery_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(orrery.__file__))
    target = os.path.join(tempfile.mkdtemp(), "orrery_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("orrery", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._orrery_shipped = True


#: Characters of text that output rows gather in a worker.
CHUNK_CHARS = 4 << 20


def map_rows(df: DataFrame, make, schema: str, chunk: int = 1000) -> DataFrame:
    """Rows of df through Python, in Arrow batches: make() is called once a task and gives f(*values) -> iterable of output tuples.

    Values are read from a batch one row at a time, and output leaves in chunks bounded in rows and characters, so that memory follows one batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        f, out, held = make(), [], 0

        def flush():
            cols = list(zip(*out)) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for i in range(b.num_rows):
                new = f(*[c[i].as_py() for c in b.columns])
                out.extend(new)
                held += sum(len(v) for row in new for v in row if v.__class__ is str)
                if len(out) >= chunk or held > CHUNK_CHARS:
                    yield flush()
                    out.clear()
                    held = 0
        if out:
            yield flush()
        del f
        release()

    return df.mapInArrow(run, schema)
