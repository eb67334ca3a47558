"""Missing values: NaN and NULL are one thing, and sums say what they do with none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value(c: str | Column) -> Column:
    """The column as double with NaN as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def sum0(c: Column) -> Column:
    """Sum in which a group without values is 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def sum0_over(c: Column, w) -> Column:
    """sum0 over a window."""
    return F.coalesce(F.sum(c).over(w), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return a / F.nullif(b, F.lit(0.0))


def without_nan(df: DataFrame) -> DataFrame:
    """All float columns with NaN as NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(value(c).alias(c) if c in floats else F.col(c) for c in df.columns))


def require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, NULLs alike."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reject_duplicates(df: DataFrame, keys: list[str], what: str) -> None:
    """Raise where keys repeat. Hashes of the keys are counted first, so that eight bytes a row are shuffled; only rows whose hash repeats are compared by the keys themselves."""
    hashed = df.select(*keys, F.xxhash64(*keys).alias("_hash"))
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    if again.isEmpty():
        return
    if some := duplicates(hashed.join(again, "_hash", "left_semi"), keys).limit(5).collect():
        raise ValueError(f"{what}: more than one row for {keys}, such as {[tuple(r) for r in some]}")
