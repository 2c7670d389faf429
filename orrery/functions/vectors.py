"""Column expressions on dense vectors (arrays of numbers), all in double precision, and element-wise aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this norm a single vector stays as it is.
TINY = 1e-12
#: Norms of index rows count as this at least; queries below it are dropped.
FLOOR = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(u), doubles(v), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def _scaled(v: Column, by: Column) -> Column:
    # the divisor is bound once a row, not once an element
    return F.get(F.transform(F.array(by), lambda n: F.transform(doubles(v), lambda x: x / n)), F.lit(0))


def unit(v: Column) -> Column:
    """Length 1; a vector shorter than TINY stays."""
    return _scaled(v, F.get(F.transform(F.array(norm(v)), lambda n: F.when(n < TINY, F.lit(1.0)).otherwise(n)), F.lit(0)))


def unit_floored(v: Column) -> Column:
    """Divided by its norm, or by FLOOR if that is larger."""
    return _scaled(v, F.greatest(norm(v), F.lit(FLOOR)))


def is_valid(v: Column) -> Column:
    """A vector without missing elements."""
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())


def elements(df: DataFrame, keys: list[str], vector: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """One row an element: the keys, carried columns, i (from 0) and x."""
    return df.select(*keys, *(carry or []), F.posexplode(doubles(F.col(vector))).alias("i", "x"))


def gather(rows: DataFrame, keys: list[str], value: str = "x", out: str = "embedding") -> DataFrame:
    """The reverse of elements(): one vector a key."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("x")))).alias("_p"))
    return packed.select(*keys, F.col("_p.x").alias(out))


def aggregate(df: DataFrame, keys: list[str], how, vector: str = "embedding", out: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """Element-wise aggregation: how(x) is an aggregate of the element column. Partial sums are made before the shuffle."""
    return gather(elements(df, keys, vector, carry).groupBy(*keys, "i").agg(how(F.col("x")).alias("x")), keys, out=out)
