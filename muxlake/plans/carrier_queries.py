"""Queries of T2-MI carriers: orders become packets in four PLPs, whose frames are cut without regard to packets, and come out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.functions.bits import be, fill, join, once, part
from muxlake.functions.checks import crc8_dvb, with_crc
from muxlake.operators import analyzer, packets, t2mi
from muxlake.operators.ranges import shares
from muxlake.plans import mux
from muxlake.plans.queries import RANGE, _read, query

#: Orders of 64 keys share a block; a source has every seventh block; a frame has 500 bytes of its block.
KEYS, SOURCES, FRAME = 64, 7, 500
_UNIT = 188
#: Values of seq, of which a source has every 28th, that are muxed at once.
SPAN = 1 << 18


def _t2mi(kind: int, plp, body):
    head = once(body, lambda x: join(be(kind, 1), be(plp, 1), be(0x3002, 2), be(F.length(x) * 8, 2), x))
    return with_crc(head)


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carriers' packets: of each block and PLP its frames in high-efficiency mode, a count of deleted null packets behind each packet, and a time stamp."""
    o, key = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    unit = join(be(256 + key % 4, 2), be(0x10 + F.floor(key / 4) % 16, 1), be(key, 8), be(F.col("o_custkey"), 4), fill(172), be(key % 3, 1))
    rows = o.select(key, F.floor(key / KEYS).alias("block"), (key % 4).cast("int").alias("plp"), unit.alias("unit"))
    n = shares(o)
    blocks = rows.repartition(n, "block", "plp").groupBy("block", "plp").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "unit"))).alias("units"))
    stream = F.aggregate("units", F.lit(b""), lambda a, u: F.concat(a, u["unit"]))
    whole = blocks.select("block", "plp", stream.alias("stream")).withColumn("n", F.ceil(F.length("stream") / FRAME).cast("int"))
    cut = whole.select("block", "plp", F.explode(F.sequence(F.lit(0), "n")).alias("k"), "n", part(F.col("stream"), F.col("k") * FRAME, FRAME).alias("data"))
    begin = F.pmod(-F.col("k") * FRAME, F.lit(_UNIT))
    head = join(be(0xF4, 1), be(0, 3), be(F.length("data") * 8, 2), be(0, 1), be(F.when(begin < F.length("data"), begin * 8).otherwise(t2mi.NO_START), 2))
    frame = once(head, lambda h: join(be(7, 1), be(F.col("plp"), 1), be(0x80, 1), h, be(crc8_dvb(h).bitwiseXOR(1), 1), F.col("data")))
    # The row behind the last frame is the time stamp.
    section = F.when(F.col("k") < F.col("n"), _t2mi(0, F.col("plp"), frame)).otherwise(_t2mi(0x20, F.col("plp"), fill(11)))
    made = cut.select((F.col("block") % SOURCES).cast("string").alias("source"), F.lit(4096).alias("pid"), ((F.col("block") * 4 + F.col("plp")) * 32 + F.col("k")).alias("seq"), section.alias("section"))
    return packets.decode(mux.section_packets(made.withColumn("span", F.floor(F.col("seq") / SPAN)), "source", "span", n))


def _t2mi_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t2mi.carrier_packets(carriers(spark, sf_dir), range_bytes=RANGE, partitions=shares(_read(spark, sf_dir, "orders")))
    return found.where("crc_ok")


@query("""WITH o AS (SELECT CAST(o_orderkey // 64 % 7 AS VARCHAR) AS source, CAST(o_orderkey % 4 AS INTEGER) AS plp_id, o_orderkey, o_custkey, 1 + o_orderkey % 3 AS n FROM orders)
SELECT source, plp_id, CAST(256 + plp_id AS INTEGER) AS pid, CAST((sum(n) OVER (PARTITION BY source, plp_id ORDER BY o_orderkey) - 1) * 188 AS BIGINT) AS byte_offset,
       CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey FROM o""")
def plp_packets(spark, sf_dir):
    """The packets in each PLP, deleted null packets put back and told apart by their PID."""
    frames = t2mi.baseband_frames(_t2mi_packets(spark, sf_dir))
    inner = packets.decode(t2mi.plp_sources(t2mi.inner_packets(frames))).where("pid <> 8191")
    number = lambda at, n: F.conv(F.hex(F.substring("payload", at, n)), 16, 10).cast("long")
    name = F.split("source", "/")
    return inner.select(name[0].alias("source"), name[2].cast("int").alias("plp_id"), "pid", "byte_offset", number(1, 8).alias("o_orderkey"), number(9, 4).alias("o_custkey"))


@query("""WITH b AS (SELECT o_orderkey // 64 AS block, o_orderkey % 4 AS plp, (count(*) * 188 + 499) // 500 AS n FROM orders GROUP BY 1, 2)
SELECT CAST(0 AS INTEGER) AS packet_type, CAST(sum(n) AS BIGINT) AS count FROM b UNION ALL SELECT 32, count(*) FROM b""")
def carrier_packet_types(spark, sf_dir):
    """How many T2-MI packets of each type the carriers have."""
    return analyzer.packet_types(_t2mi_packets(spark, sf_dir))


@query("""WITH b AS (SELECT o_orderkey // 64 AS block, o_orderkey % 4 AS plp, count(*) * 188 AS n FROM orders GROUP BY 1, 2),
f AS (SELECT block, plp, n, unnest(range(0, (n + 499) // 500)) AS k FROM b),
d AS (SELECT block % 7 AS source, plp, least(n - k * 500, 500) AS size, (188 - k * 500 % 188) % 188 AS begin FROM f)
SELECT CAST(source AS VARCHAR) AS source, CAST(plp AS INTEGER) AS plp_id, count(*) AS n_frames, CAST(sum(size * 8) AS BIGINT) AS n_bits,
       count(*) FILTER (WHERE begin < size) AS n_starts, CAST(sum(begin * 8) FILTER (WHERE begin < size) AS BIGINT) AS sum_starts FROM d GROUP BY 1, 2""")
def baseband_frames(spark, sf_dir):
    """Frames, their lengths and where packets begin in them, for each PLP."""
    frames = t2mi.usable(t2mi.baseband_frames(_t2mi_packets(spark, sf_dir))).where("mode = 1 AND null_deleted AND single_input")
    begins = F.col("syncd") != t2mi.NO_START
    return frames.groupBy("source", "plp_id").agg(
        F.count("*").alias("n_frames"), F.sum(F.col("dfl").cast("long")).alias("n_bits"), F.count_if(begins).alias("n_starts"), F.sum(F.when(begins, F.col("syncd")).cast("long")).alias("sum_starts"),
    )
