"""Registered queries on tables like the driver's larger ones: keys that repeat, that pass the width of a field, and shares of tasks."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from muxlake.operators import packets, ranges, sections
from muxlake.plans import mux
from muxlake.plans.queries import _numbered


def against_sql(spark, folder, name, tables):
    """The query's rows and its SQL's over tables of Arrow."""
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect())), sorted(connection.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())


def same_seq(spark):
    """Sections of two PIDs, 400 of which share a seq, some of them equal."""
    rows = spark.range(0, 3000, 1, 1).select(F.lit("s").alias("source"), (F.col("id") % 2 + 32).cast("int").alias("pid"), (F.col("id") % 7).alias("seq"), F.col("id"))
    body = F.unhex(F.lpad(F.hex(F.col("id") % 500), 8, "0"))
    return rows.select("id", "source", "pid", "seq", mux.section(0x80, 1, F.when(F.col("id") % 3 == 0, F.repeat(F.hex(body), 60).cast("binary")).otherwise(body)).alias("section"))


def test_packets_do_not_depend_on_the_order_of_rows(spark):
    """the steps of a query read them anew, and each has to see the same packets."""
    made = same_seq(spark)
    up, down = ([tuple(r) for r in mux.section_packets(made.orderBy(by).drop("id").coalesce(1)).orderBy("byte_offset").collect()] for by in (F.asc("id"), F.desc("id")))
    assert len(up) > 3000 and up == down


def test_sections_of_the_same_seq_are_continuous(spark):
    """offsets and counters are of one order."""
    made = same_seq(spark).drop("id")
    found = sections.reassemble(packets.decode(mux.section_packets(made)))
    count = lambda df: sorted(map(tuple, df.groupBy("pid", F.hex("section")).count().collect()))
    assert count(found.where("crc_ok")) == count(made)


@pytest.mark.parametrize("first", [47_700, 10**9])
def test_splice_signals_behind_the_last_time_stamp(spark, tmp_path, first):
    """times of more than 33 bits."""
    keys = list(range(first, first + 60))
    found, expected = against_sql(spark, tmp_path, "splice_signals", {"customer": pa.table({"c_custkey": keys, "c_name": [f"Customer {k}" for k in keys]})})
    assert found == expected


def test_spans_give_the_same_packets(spark):
    """a source muxed in spans has the packets it has when it is muxed whole, and no partition holds it."""
    made = same_seq(spark).withColumn("seq", F.col("id") % 900).drop("id")
    whole = sorted(map(tuple, mux.section_packets(made).collect()))
    spanned = mux.section_packets(made.withColumn("span", F.floor(F.col("seq") / 50)), span="span", partitions=8)
    assert sorted(map(tuple, spanned.collect())) == whole
    sizes = [r["count"] for r in spanned.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < len(whole) * 0.6


def test_a_task_has_a_share_of_the_rows(spark, tmp_path):
    """F3 to F12: rows are dealt out by their number, whatever Spark coalesces and however few pieces a file has."""
    spark.range(0, 120_000, 1, 1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert ranges.shares(rows, 10_000) == 12 and ranges.shares(rows.limit(0)) == 1
    made = _numbered(rows, F.lit(20), F.encode(F.col("id").cast("string"), "UTF-8"), "id", F.col("id").cast("string"))
    n = ranges.shares(rows)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == n > 1 and max(sizes) < 120_000 / n * 1.2


def test_parts_are_dealt_out(spark, tmp_path):
    """descriptors of a file of one piece are made in several tasks."""
    spark.range(0, 20_000, 1, 1).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    found = __spark_entry__.queries()["upids"](spark, str(tmp_path))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and sum(sizes) == 60_000 and max(sizes) < 40_000
