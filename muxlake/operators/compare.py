"""Differences of tables, and samples of a corpus of sections or descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType
from pyspark.sql.window import Window


def paths(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """A row (key, path, value) for each field, values as text; binary fields are left out by not naming them."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields)))
    return df.select(*key, pairs.alias("p")).select(*key, "p.*")


def differences(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, path, before, after) of the fields that are not the same on both sides, nulls being equal to nulls."""
    a = paths(before, key, fields).withColumnRenamed("value", "before")
    b = paths(after, key, fields).withColumnRenamed("value", "after")
    return a.join(b, [*key, "path"], "full_outer").where("NOT (before <=> after)")


def _leaves(value, kind, path):
    """An array of (path, value) of everything inside a value; elements of arrays are told by their places."""
    if isinstance(kind, StructType):
        parts = [_leaves(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
        return F.concat(*parts) if parts else F.array().cast(_PAIRS)
    if isinstance(kind, ArrayType):
        each = F.transform(value, lambda x, k: _leaves(x, kind.elementType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(each), F.array().cast(_PAIRS))
    text = F.base64(value) if isinstance(kind, BinaryType) else value.cast("string")
    return F.array(F.struct(path.alias("path"), text.alias("value")))


_PAIRS = "array<struct<path:string,value:string>>"


def deep_paths(df: DataFrame, key: list[str]) -> DataFrame:
    """A row (key, path, value) for every leaf of all other columns, structs and arrays taken apart; binary values in base64."""
    fields = [f for f in df.schema.fields if f.name not in key]
    pairs = F.concat(*(_leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in fields))
    return df.select(*key, F.explode(pairs).alias("p")).select(*key, "p.*")


def deep_differences(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, before, after) of every leaf that is not the same on both sides."""
    a, b = (deep_paths(df, key).withColumnRenamed("value", name) for df, name in ((before, "before"), (after, "after")))
    return a.join(b, [*key, "path"], "full_outer").where("NOT (before <=> after)")


def distinct_by_crc(df: DataFrame, group: str, data: str) -> DataFrame:
    """One row of each content in a group, by the reflected CRC-32 of the data."""
    return df.withColumn("crc", F.crc32(data)).dropDuplicates([group, "crc"])


# The names of the sizes that are picked.
SIZES = ("S", "M1", "M2", "L")


def pick_sizes(df: DataFrame, group: str, size: str, tie: str) -> DataFrame:
    """Of each group in the order of size, the entries at 0, n/3, 2n/3 and n - 1, named S, M1, M2 and L; one entry takes the first name."""
    order = Window.partitionBy(group).orderBy(size, tie)
    ranked = df.withColumns({"nth": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(group))})
    n = F.col("n")
    marks = (F.lit(0), F.floor(n / 3), F.floor(2 * n / 3), n - 1)
    name = F.lit(None).cast("string")
    for label, mark in reversed(list(zip(SIZES, marks))):
        name = F.when(F.col("nth") == mark, label).otherwise(name)
    return ranked.withColumn("sample", name).where("sample IS NOT NULL").drop("nth", "n")


def corpus_stats(df: DataFrame, group: str, data: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("available"), F.countDistinct(F.crc32(data)).alias("n_unique"))


def top_groups(df: DataFrame, group: str, entry: str, size: str, k: int) -> DataFrame:
    """The k largest groups, by number and then name, with the largest entry of each."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.max_by(entry, size).alias("largest")).orderBy(F.desc("n"), group).limit(k)


def history(sections: DataFrame, key: list[str], most: int = 255) -> DataFrame:
    """The newest versions of each stream of tables: consecutive repetitions count once, and the report keeps so many."""
    order = Window.partitionBy(*key).orderBy("first_offset")
    fresh = sections.withColumn("was", F.lag("crc32").over(order)).where("NOT (was <=> crc32)").drop("was")
    back = fresh.withColumn("age", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("first_offset")))).where(F.col("age") <= most)
    return back.withColumns({"version_index": F.row_number().over(order), "is_active": F.col("age") == 1}).drop("age")
