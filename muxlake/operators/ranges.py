"""Order-dependent columns over long streams, without a task that holds a source or a PID.

Rows fall into ranges of byte offsets, and the rows of a key and range become one sorted array. Of each array a total or last value meets those of the
other ranges in a second, small window; what it finds is joined back on the partitioning that the arrays already have. Both sides read the same
exchange of arrays, so the rows are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a stream whose packets of one PID are ordered in one window.
RANGE_BYTES = 32 << 20


#: Rows of a table that one task makes streams of and reads them again: what it sorts takes some hundred bytes a row, several times over.
SHARE = 50_000


def shares(df: DataFrame, rows: int = SHARE) -> int:
    """Partitions for df: as many as give each so many rows, or all cores some. It counts the rows."""
    n = df.count()
    return max(1, min(n // 1000, max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows))))


def range_of(offset: str = "byte_offset", size: int | None = None) -> Column:
    return F.floor(F.col(offset) / F.lit(size or RANGE_BYTES)).cast("long")


def in_ranges(df: DataFrame, keys: Sequence[str], offset: str = "byte_offset", tie: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """(keys, _range, _rows): the rows of each key and range as an array of structs in the order of offset and tie."""
    first = [offset, *(t for t in tie if t != offset)]
    rest = [c for c in df.columns if c not in first and c not in keys]
    row = F.struct(*first, *rest)
    return df.groupBy(*keys, range_of(offset, size).alias("_range")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))


def _back(columns: Sequence[str], keys: Sequence[str]) -> list[Column]:
    return [F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in columns]


def with_previous(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], offset: str = "byte_offset", tie: Sequence[str] = (), name: str = "before", size: int | None = None
) -> DataFrame:
    """df with a struct of the columns as they are in the row before, under the keys and in the order of offset; null in the first row."""
    ranges = in_ranges(df, keys, offset, tie, size)
    values = lambda row: F.struct(*((F.col(c) if c in keys else row[c]).alias(c) for c in columns))
    last = ranges.select(*keys, "_range", values(F.element_at("_rows", -1)).alias("_last"))
    carried = last.select(*keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carried"))
    every = _meet(ranges, carried, keys)
    pairs = F.transform("_rows", lambda r, k: F.struct(r.alias("r"), F.get("_rows", k - 1).alias("was"), k.alias("k")))
    rows = every.select(*keys, "_carried", F.explode(pairs).alias("_p")).select(*keys, "_carried", F.col("_p.r").alias("_r"), F.col("_p.was").alias("_was"), F.col("_p.k").alias("_k"))
    before = F.when(F.col("_k") > 0, values(F.col("_was"))).otherwise(F.col("_carried"))
    return rows.select(*_back(df.columns, keys), before.alias(name))


def with_number(df: DataFrame, keys: Sequence[str], offset: str = "byte_offset", tie: Sequence[str] = (), name: str = "number", size: int | None = None) -> DataFrame:
    """df with the rows' numbers from 0 under the keys, in the order of offset."""
    ranges = in_ranges(df, keys, offset, tie, size)
    counts = ranges.select(*keys, "_range", F.size("_rows").cast("long").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carried"))
    rows = _meet(ranges, carried, keys).select(*keys, "_carried", F.posexplode("_rows").alias("_k", "_r"))
    return rows.select(*_back(df.columns, keys), (F.col("_carried") + F.col("_k")).alias(name))


def _meet(ranges: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each range with what is carried into it; keys may be null."""
    names = [*keys, "_range"]
    other = carried.select(*(F.col(k).alias(f"_c{i}") for i, k in enumerate(names)), "_carried")
    same = [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(names)]
    return ranges.join(other, same).select(*names, "_rows", "_carried")
