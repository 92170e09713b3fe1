"""Queries over the driver tables: rows are muxed into packets or sections, decoded by the operators, and checked by SQL over the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.functions import values
from muxlake.functions.bits import be, join
from muxlake.operators import analyzer, catalog, compare, packets, sections, tables
from muxlake.operators import descriptors as desc
from muxlake.operators.ranges import shares
from muxlake.plans import mux

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet an event: 64 PIDs, the clock of its time in the adaptation field, every 97th lost, every 89th damaged."""
    e = _read(spark, sf_dir, "events")
    pid = (F.col("user_id") % 64 + 256).cast("int")
    n = F.row_number().over(Window.partitionBy("pid").orderBy("event_id")) - 1
    rows = e.select("event_id", pid.alias("pid"), (_micros("ts") * 27 % (300 << 33)).alias("pcr")).withColumn("cc", n % 16)
    kept = rows.where("event_id % 97 <> 0")
    field = join(be(0x10, 1), mux.pcr_field(F.col("pcr")))
    payload = F.rpad(F.lit("").cast("binary"), 100, F.lit(b"\x2a"))
    damaged = (F.col("event_id") % 89 == 0).cast("int")
    raw = mux.packet(F.col("pid"), F.col("cc"), payload, 0, field, damaged)
    return kept.select(F.lit("events").alias("source"), (F.col("event_id") * 188).alias("byte_offset"), raw.alias("raw"))


_EVENT_ROWS = """
WITH numbered AS (
  SELECT event_id, ts, CAST(256 + user_id % 64 AS INTEGER) AS pid,
         (row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) - 1) % 16 AS cc,
         (epoch_us(ts) * 27) % 2576980377600 AS pcr
  FROM events),
e AS (SELECT * FROM numbered WHERE event_id % 97 <> 0 AND event_id % 89 <> 0),
c AS (SELECT *, lag(cc) OVER (PARTITION BY pid ORDER BY event_id) AS was FROM e)
"""


@query(_EVENT_ROWS + """
SELECT pid, count(*) AS n_packets, count(*) * 188 AS n_bytes,
       CAST(sum(CASE WHEN was IS NOT NULL AND (cc - was + 16) % 16 <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS cc_errors
FROM c GROUP BY pid""")
def pid_stats(spark, sf_dir):
    return analyzer.pid_stats(packets.decode(event_packets(spark, sf_dir))).select("pid", "n_packets", "n_bytes", "cc_errors")


@query(_EVENT_ROWS + "SELECT pid, event_id * 188 AS byte_offset FROM c WHERE was IS NOT NULL AND (cc - was + 16) % 16 <> 1")
def cc_errors(spark, sf_dir):
    return analyzer.continuity(packets.decode(event_packets(spark, sf_dir))).where("is_error").select("pid", "byte_offset")


@query(_EVENT_ROWS + """
SELECT event_id * 188 AS byte_offset, pid, pcr AS tick, coalesce((pcr - lag(pcr) OVER (PARTITION BY pid ORDER BY event_id) + 4398046511104) % 4398046511104, -1) AS delta FROM e""")
def pcr_steps(spark, sf_dir):
    return analyzer.clock_steps(packets.decode(event_packets(spark, sf_dir))).select("byte_offset", "pid", "tick", F.coalesce("delta", F.lit(-1)).alias("delta"))


@query("SELECT DISTINCT CAST(256 + user_id % 64 AS INTEGER) AS pid FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0")
def pid_list(spark, sf_dir):
    return analyzer.pid_list(packets.decode(event_packets(spark, sf_dir))).select("pid")


_WINDOW = _EVENT_ROWS + """
, t AS (SELECT event_id, pid, pcr FROM e),
ref AS (SELECT pid FROM t ORDER BY event_id LIMIT 1),
ticks AS (SELECT event_id, pcr, row_number() OVER (ORDER BY event_id) AS slot FROM t WHERE pid = (SELECT pid FROM ref)),
ordered AS (SELECT t.event_id, (SELECT min(k.slot) FROM ticks k WHERE k.event_id >= t.event_id) AS slot, t.pid FROM t),
sums AS (SELECT slot, count(*) * 188 AS n FROM ordered WHERE slot IS NOT NULL GROUP BY slot),
run AS (SELECT slot, event_id, pcr, cum FROM (SELECT k.slot, k.event_id, k.pcr, sum(s.n) OVER (ORDER BY k.slot) AS cum FROM ticks k JOIN sums s USING (slot)))
"""


@query(None)
def bitrate_windows(spark, sf_dir):
    """Windows of a day on the clock of the first PID."""
    options = analyzer.RateOptions(window_sec=86400.0)
    return analyzer.bitrate(packets.decode(event_packets(spark, sf_dir)), options).select("byte_offset", "n_bytes", "ticks", "seconds", "bps")


@query(None)
def bitrate_per_pid(spark, sf_dir):
    options = analyzer.RateOptions(window_sec=86400.0)
    return analyzer.bitrate(packets.decode(event_packets(spark, sf_dir)), options, per_pid=True).select("pid", "byte_offset", "n_bytes", "ticks", "bps")


ORACLE_SQL["bitrate_windows"] = _WINDOW.replace("WITH numbered", "WITH RECURSIVE numbered") + """
, w AS (
  SELECT slot, event_id, pcr, cum, CAST(NULL AS BIGINT) AS n_bytes, CAST(NULL AS BIGINT) AS ticks, CAST(0 AS HUGEINT) AS base FROM run WHERE slot = 1
  UNION ALL
  SELECT r.slot, r.event_id, r.pcr, r.cum, CAST(r.cum - w.base AS BIGINT), (r.pcr - w.pcr + 4398046511104) % 4398046511104, r.cum
  FROM w, LATERAL (SELECT * FROM run r2 WHERE r2.slot > w.slot AND (r2.pcr - w.pcr + 4398046511104) % 4398046511104 >= 2332800000000 ORDER BY r2.slot LIMIT 1) r)
SELECT event_id * 188 AS byte_offset, n_bytes, ticks, ticks / 27000000.0::DOUBLE AS seconds, n_bytes * 8.0::DOUBLE * 27000000.0::DOUBLE / ticks AS bps FROM w WHERE n_bytes IS NOT NULL"""


@query("""
WITH e AS (SELECT event_id * 188 AS byte_offset, (row_number() OVER (ORDER BY event_id) - 1) // 250 AS w FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0)
SELECT w AS "window", max(byte_offset) AS byte_offset, CAST(47000 AS BIGINT) AS n_bytes, CAST(27000000 AS BIGINT) AS ticks FROM e GROUP BY w HAVING count(*) = 250""")
def bitrate_assumed(spark, sf_dir):
    """Windows of one second at 376 kbit/s."""
    out = analyzer.assumed_bitrate(packets.decode(event_packets(spark, sf_dir)), 376_000.0)
    return out.select("window", "byte_offset", "n_bytes", "ticks")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, min(ts) AS first_seen, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1""")
def sums_by_hour(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return analyzer.sum_by_time(e, "ts", "cents", "1 hour")


def _pes_packets(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", (_micros("ts") * 90 / 1000).cast("long").alias("t"))
    ticks = F.col("t") % (1 << 33)
    late = (F.col("t") + 7200) % (1 << 33)
    both = join(be(0x000001E0, 4), be(0, 2), be(0x84C00A, 3), mux.pts_field(3, late), mux.pts_field(1, ticks))
    only = join(be(0x000001C0, 4), be(0, 2), be(0x848005, 3), mux.pts_field(2, late))
    payload = F.when(F.col("event_id") % 3 == 0, both).otherwise(only)
    raw = mux.packet((F.col("user_id") % 16 + 64).cast("int"), F.col("event_id") % 16, payload, 1)
    return e.select(F.lit("pes").alias("source"), (F.col("event_id") * 188).alias("byte_offset"), raw.alias("raw"))


@query("""
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) * 90 / 1000.0) AS BIGINT) AS t FROM events)
SELECT event_id * 188 AS byte_offset, CAST(64 + user_id % 16 AS INTEGER) AS pid, CASE WHEN event_id % 3 = 0 THEN 224 ELSE 192 END AS stream_id, (t + 7200) % 8589934592 AS pts,
       CASE WHEN event_id % 3 = 0 THEN t % 8589934592 ELSE -1 END AS dts FROM e""")
def pes_time_stamps(spark, sf_dir):
    d = packets.decode(_pes_packets(spark, sf_dir))
    h = F.col("pes_header")
    return d.select("byte_offset", "pid", h["stream_id"].cast("int").alias("stream_id"), "pts", F.coalesce("dts", F.lit(-1)).alias("dts"))


#: Sections of a source that the queries mux at once, about.
SPAN = 10_000
#: Bytes of a source whose packets the queries put in order at once.
RANGE = 1 << 20


def _decoded(made: DataFrame) -> DataFrame:
    """Sections out of the packets of sections(source, pid, seq, section), and perhaps span."""
    span, n = "span" if "span" in made.columns else None, shares(made)
    return sections.reassemble(packets.decode(mux.section_packets(made, "source", span, n)), range_bytes=RANGE, partitions=n)


def _numbered(df: DataFrame, pid, section, seq: str, source=None, span: int | None = None) -> DataFrame:
    """Sections for the muxer; unless told otherwise, a source has 2,000 values of seq. Sources that grow with the table are muxed in spans of so many values of seq.

    Rows are dealt out before their bytes are made, so that the work does not follow the pieces of the table's file.
    """
    src = source if source is not None else F.concat(F.lit("driver "), F.floor(F.col(seq) / 2000).cast("string"))
    spread = df.withColumn("_source", src).repartition(shares(df), *(["_source"] if span is None else df.columns))
    spans = [] if span is None else [F.floor(F.col(seq) / span).alias("span")]
    return spread.select(F.col("_source").alias("source"), pid.cast("int").alias("pid"), F.col(seq).cast("long").alias("seq"), section.alias("section"), *spans)


@query("SELECT c_custkey, length(repeat(c_name, CAST(1 + c_custkey % 60 AS INTEGER))) AS n_bytes, md5(repeat(c_name, CAST(1 + c_custkey % 60 AS INTEGER))) AS digest FROM customer")
def sections_roundtrip(spark, sf_dir):
    """Sections of one to six packets on four PIDs."""
    c = _read(spark, sf_dir, "customer")
    body = F.encode(F.expr("repeat(c_name, cast(1 + c_custkey % 60 as int))"), "UTF-8")
    s = mux.section(0x80, 7, join(be(F.col("c_custkey"), 4), body))
    out = _decoded(_numbered(c, F.col("c_custkey") % 4 + 500, s, "c_custkey")).where("crc_ok AND table_id = 128")
    data = F.substring("section", F.lit(13), F.length("section") - 16)
    return out.select(F.conv(F.hex(F.substring("section", 9, 4)), 16, 10).cast("long").alias("c_custkey"), F.length(data).cast("long").alias("n_bytes"), F.md5(data).alias("digest"))


@query("SELECT CAST(p_partkey // 100 AS INTEGER) AS ts_id, CAST(p_partkey % 60000 AS INTEGER) AS program_number, CAST(32 + p_partkey % 8000 AS INTEGER) AS program_pid FROM part")
def pat_programs(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 100).alias("ts"))
    record = join(be(F.col("p_partkey") % 60000, 2), be(F.col("p_partkey") % 8000 + 32 + 0xE000, 2))
    body = F.array_sort(F.collect_list(F.struct("p_partkey", record.alias("r"))))
    grouped = p.groupBy("ts").agg(body.alias("r"))
    section = mux.section(0, F.col("ts"), F.aggregate("r", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["r"])))
    return tables.entries(tables.pat(_decoded(_numbered(grouped, F.lit(0), section, "ts"))), "PAT").select("ts_id", "program_number", "program_pid")


def _program_sections(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    ca = mux.descriptor(0x09, join(be(0x0500, 2), be(key % 1000 + 4000 + 0xE000, 2)))
    es = lambda k: join(be(F.lit(2) + k, 1), be((key * 4 + k) % 8000 + 100 + 0xE000, 2), mux.loop(mux.descriptor(0x52, be(k, 1))))
    body = F.aggregate(F.sequence(F.lit(0), F.col("p_size") % 4), F.unhex(F.lit("")), lambda a, k: F.concat(a, es(k)))
    section = mux.section(2, key % 60000, join(be(key % 8000 + 0xE000, 2), mux.loop(ca), body), F.col("p_size") % 32)
    return _decoded(_numbered(p, key % 50 + 1000, section, "p_partkey"))


@query("""
SELECT CAST(p_partkey % 60000 AS INTEGER) AS program_number, CAST(p_partkey % 8000 AS INTEGER) AS pcr_pid, CAST(p_size % 32 AS INTEGER) AS version, CAST(k AS INTEGER) AS position,
       CAST(2 + k AS INTEGER) AS stream_type, CAST(100 + (p_partkey * 4 + k) % 8000 AS INTEGER) AS es_pid
FROM part, LATERAL (SELECT unnest(range(0, p_size % 4 + 1)) AS k) x""")
def pmt_streams(spark, sf_dir):
    rows = tables.entries(tables.pmt(_program_sections(spark, sf_dir)), "PMT")
    return rows.select("program_number", "pcr_pid", "version", "position", "stream_type", "es_pid")


@query("SELECT CAST(p_partkey % 60000 AS INTEGER) AS program_number, CAST(1280 AS BIGINT) AS ca_system_id, CAST(4000 + p_partkey % 1000 AS BIGINT) AS ca_pid FROM part")
def pmt_access(spark, sf_dir):
    """Conditional access descriptors of programmes."""
    loops = tables.pmt(_program_sections(spark, sf_dir)).select("program_number", "descriptors")
    return desc.typed(desc.split(loops, "descriptors"), "dvb", 0x09).select("program_number", "ca_system_id", "ca_pid")


def _service_sections(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier")
    d = mux.descriptor(0x48, join(be(1, 1), mux.text(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))), mux.text(F.col("s_name"))))
    entry = join(be(F.col("s_suppkey") % 65536, 2), be(0xFC + F.col("s_suppkey") % 4, 1), mux.loop(d, 0x8000))
    return _decoded(_numbered(s, F.lit(0x11), mux.section(0x42, F.col("s_nationkey"), join(be(1, 2), be(0xFF, 1), entry)), "s_suppkey"))


@query("""SELECT CAST(s_suppkey % 65536 AS INTEGER) AS service_id, CAST(s_nationkey AS INTEGER) AS ts_id, (s_suppkey % 4) // 2 = 1 AS eit_schedule, CAST(4 AS INTEGER) AS running_status,
  CAST(1 AS INTEGER) AS service_type, 'nation ' || s_nationkey AS provider, s_name AS service_name FROM supplier""")
def sdt_services(spark, sf_dir):
    rows = tables.entries(tables.sdt(_service_sections(spark, sf_dir)), "SDT").select("service_id", "ts_id", "eit_schedule", "running_status", "entry_descriptors")
    return desc.services(desc.split(rows, "entry_descriptors")).select("service_id", "ts_id", "eit_schedule", "running_status", "service_type", "provider", "service_name")


def _network_sections(spark, sf_dir, table_id: int, name_tag: int, pid: int):
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lcn = mux.descriptor(0x83, join(be(F.col("n_nationkey") + 700, 2), be(0xFC00 + F.col("n_nationkey") + 1, 2)))
    entry = join(be(F.col("n_nationkey") + 10, 2), be(F.col("n_regionkey") + 200, 2), mux.loop(lcn))
    grouped = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))).alias("e"))
    streams = F.aggregate("e", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["e"]))
    name = mux.descriptor(name_tag, F.encode("r_name", "UTF-8"))
    section = mux.section(table_id, F.col("r_regionkey") + 30, join(mux.loop(name), mux.loop(streams)), 3)
    return _decoded(_numbered(grouped, F.lit(pid), section, "r_regionkey"))


_NETWORK_SQL = """SELECT CAST(n_regionkey + 30 AS INTEGER) AS {name}, CAST(n_nationkey + 10 AS INTEGER) AS ts_id, CAST(n_regionkey + 200 AS INTEGER) AS original_network_id,
  CAST(n_nationkey + 700 AS BIGINT) AS service_id, TRUE AS visible, CAST(n_nationkey + 1 AS BIGINT) AS lcn FROM nation"""


@query(_NETWORK_SQL.format(name="network_id"))
def nit_channels(spark, sf_dir):
    rows = tables.entries(tables.nit(_network_sections(spark, sf_dir, 0x40, 0x40, 0x10)), "NIT").select("network_id", "ts_id", "original_network_id", "entry_descriptors")
    return desc.typed(desc.split(rows, "entry_descriptors"), "dvb", 0x83).select("network_id", "ts_id", "original_network_id", "service_id", "visible", "lcn")


@query(_NETWORK_SQL.format(name="bouquet_id"))
def bat_channels(spark, sf_dir):
    rows = tables.entries(tables.bat(_network_sections(spark, sf_dir, 0x4A, 0x47, 0x11)), "BAT").select("bouquet_id", "ts_id", "original_network_id", "entry_descriptors")
    return desc.typed(desc.split(rows, "entry_descriptors"), "dvb", 0x83).select("bouquet_id", "ts_id", "original_network_id", "service_id", "visible", "lcn")


@query("SELECT CAST(r_regionkey + 30 AS INTEGER) AS network_id, r_name AS network_name, CAST(3 AS INTEGER) AS version FROM region")
def nit_names(spark, sf_dir):
    loops = tables.nit(_network_sections(spark, sf_dir, 0x40, 0x40, 0x10)).select("network_id", "version", "descriptors")
    return desc.typed(desc.split(loops, "descriptors"), "dvb", 0x40).select("network_id", "network_name", "version")


def _mjd(seconds):
    """Five bytes: a modified Julian date and a BCD time."""
    day, rest = F.floor(seconds / 86400) + 40587, seconds % 86400
    return join(be(day, 2), _bcd(rest))


def _bcd(seconds):
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.unhex(F.concat(two(seconds / 3600), two(seconds % 3600 / 60), two(seconds % 60)))


def _event_sections(spark, sf_dir, copies: int = 1):
    o = _read(spark, sf_dir, "orders").withColumns({"start": F.floor(_micros("o_orderdate") / 1_000_000), "dur": (F.col("o_totalprice") % 80000).cast("long")})
    name = mux.descriptor(0x4D, join(F.encode(F.lit("eng"), "UTF-8"), mux.text(F.col("o_orderpriority")), mux.text(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")))))
    event = join(be(F.col("o_orderkey") % 65536, 2), _mjd(F.col("start")), _bcd(F.col("dur")), mux.loop(name, 0x8000))
    body = join(be(F.col("o_custkey") % 100, 2), be(2, 2), be(0, 1), be(0x50, 1), event)
    section = mux.section(0x50, F.col("o_custkey") % 65536, body, F.col("o_orderkey") % 32)
    rows = o.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("seq", F.col("o_orderkey") * copies + F.col("copy"))
    return _decoded(_numbered(rows, F.lit(0x12), section, "seq", F.concat(F.lit("orders "), (F.col("o_orderkey") % 64).cast("string")), SPAN * 64 * copies))


@query("""SELECT CAST(o_custkey % 65536 AS INTEGER) AS service_id, CAST(o_orderkey % 65536 AS INTEGER) AS event_id, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS start_sec,
  CAST(floor(o_totalprice % 80000) AS BIGINT) AS duration_sec, 'eng' AS language, o_orderpriority AS event_name, 'customer ' || o_custkey AS text FROM orders""")
def eit_events(spark, sf_dir):
    rows = tables.entries(tables.eit(_event_sections(spark, sf_dir)), "EIT").select("service_id", "event_id", "start_sec", "duration_sec", "entry_descriptors")
    return desc.short_events(desc.split(rows, "entry_descriptors")).select("service_id", "event_id", "start_sec", "duration_sec", "language", "event_name", "text")


@query("SELECT count(DISTINCT o_orderkey) AS n_fresh, count(*) * 3 AS n_sections FROM orders")
def repeated_sections(spark, sf_dir):
    """Sections that are sent three times in a row are reported once."""
    all_of_them = _event_sections(spark, sf_dir, 3)
    fresh = sections.changed(all_of_them).agg(F.count("*").alias("n_fresh"))
    return fresh.crossJoin(all_of_them.agg(F.count("*").alias("n_sections")))


@query("""SELECT o_orderkey AS place, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS utc_sec FROM orders""")
def tdt_times(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    section = join(be(0x70, 1), be(0x7005, 2), _mjd(F.floor(_micros("o_orderdate") / 1_000_000)))
    out = tables.tdt(_decoded(_numbered(o, F.lit(0x14), section, "o_orderkey", F.col("o_orderkey").cast("string"))))
    return out.select(F.col("source").cast("long").alias("place"), "utc_sec")


@query("""SELECT l_orderkey * 8 + l_linenumber AS event_id, l_returnflag = 'R' AS out_of_network, CAST(l_quantity * 90000 AS BIGINT) AS splice_pts,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey * 90 AS BIGINT) ELSE -1 END AS break_duration, CAST(l_suppkey % 65536 AS INTEGER) AS unique_program_id, CAST(l_linenumber AS INTEGER) AS avail FROM lineitem""")
def splice_inserts(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    timed, pts = F.col("l_linestatus") == "O", (F.col("l_quantity") * 90000).cast("long")
    flags = F.when(F.col("l_returnflag") == "R", 0x80).otherwise(0) + 0x4F + F.when(timed, 0x20).otherwise(0)
    long_time = lambda top, x: be(x + (top << 32), 5)
    pause = F.when(timed, long_time(0x7E, F.col("l_partkey") * 90)).otherwise(F.unhex(F.lit("")))
    command = join(be(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 4), be(0x7F, 1), be(flags, 1), long_time(0xFE, pts), pause, be(F.col("l_suppkey") % 65536, 2), be(F.col("l_linenumber"), 1), be(9, 1))
    head = join(be(0, 1), be(0, 5), be(0, 1), be((0xFFF << 12) + F.length(command), 3), be(5, 1))
    body = join(head, command, be(0, 2))
    section = mux.with_crc(join(be(0xFC, 1), be(F.length(body) + 4 + 0x3000, 2), body))
    rows = li.withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    out = tables.splice(_decoded(_numbered(rows, F.lit(0x300), section, "seq", F.concat(F.lit("cues "), (F.col("l_orderkey") % 64).cast("string")), SPAN * 128)))
    return out.select("event_id", "out_of_network", "splice_pts", F.coalesce("break_duration", F.lit(-1)).alias("break_duration"), "unique_program_id", "avail")


@query("""SELECT CAST(n_regionkey AS INTEGER) AS region_id, CAST(n_nationkey AS INTEGER) AS zone_id, n_nationkey % 3 = 0 AS state FROM nation""")
def warning_zones(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    zone = join(be(F.col("n_nationkey"), 2), be(0xFE + (F.col("n_nationkey") % 3 == 0).cast("int"), 1), mux.loop(F.unhex(F.lit(""))))
    section = mux.section(0x93, F.col("n_regionkey"), join(mux.loop(F.unhex(F.lit(""))), mux.loop(zone)))
    return tables.entries(tables.ews(_decoded(_numbered(n, F.lit(0x400), section, "n_nationkey"))), "EWS").select("region_id", "zone_id", "state")


@query("""SELECT CAST(c_nationkey AS INTEGER) AS group_id, CAST(c_custkey % 65536 AS INTEGER) AS device_id, CAST(c_custkey % 4 AS INTEGER) AS type, CAST(c_custkey % 32 AS INTEGER) AS id, c_acctbal > 0 AS state FROM customer""")
def warning_devices(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    flags = (F.col("c_custkey") % 4) * 64 + (F.col("c_custkey") % 32) * 2 + (F.col("c_acctbal") > 0).cast("int")
    device = join(be(F.col("c_custkey") % 65536, 2), be(flags, 1), mux.loop(F.unhex(F.lit(""))))
    section = mux.section(0x94, F.col("c_nationkey"), join(mux.loop(F.unhex(F.lit(""))), mux.loop(device)))
    return tables.entries(tables.eews(_decoded(_numbered(c, F.lit(0x401), section, "c_custkey"))), "EEWS").select("group_id", "device_id", "type", "id", "state")


@query("""SELECT CAST(c_custkey % 32768 AS INTEGER) AS application_type, CAST(c_nationkey AS BIGINT) AS organisation_id, CAST(c_custkey % 65536 AS INTEGER) AS application_id, CAST(1 + c_custkey % 7 AS INTEGER) AS control_code FROM customer""")
def ait_applications(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    app = join(be(F.col("c_nationkey"), 4), be(key % 65536, 2), be(key % 7 + 1, 1), mux.loop(F.unhex(F.lit(""))))
    section = mux.section(0x74, key % 32768, join(mux.loop(F.unhex(F.lit(""))), mux.loop(app)))
    out = tables.entries(tables.ait(_decoded(_numbered(c, F.lit(0x402), section, "c_custkey"))), "AIT")
    return out.select("application_type", "organisation_id", "application_id", "control_code")


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR) AS c FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, CAST(o_custkey + CASE WHEN o_orderkey % 25 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS c
      FROM orders WHERE o_orderkey % 50 <> 7),
pa AS (SELECT o_orderkey, 'o_orderstatus' AS path, o_orderstatus AS v FROM a UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM a UNION ALL SELECT o_orderkey, 'o_custkey', c FROM a),
pb AS (SELECT o_orderkey, 'o_orderstatus' AS path, o_orderstatus AS v FROM b UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM b UNION ALL SELECT o_orderkey, 'o_custkey', c FROM b)
SELECT o_orderkey, path, pa.v AS before, pb.v AS after FROM pa FULL JOIN pb USING (o_orderkey, path) WHERE pa.v IS DISTINCT FROM pb.v""")
def table_differences(spark, sf_dir):
    a = _read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))
    b = a.where("o_orderkey % 50 <> 7").withColumns({"o_orderstatus": status, "o_custkey": F.col("o_custkey") + (F.col("o_orderkey") % 25 == 0).cast("int")})
    return compare.differences(a, b, ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("""
WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS nth, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, p_brand, CASE WHEN nth = 0 THEN 'S' WHEN nth = n // 3 THEN 'M1' WHEN nth = 2 * n // 3 THEN 'M2' WHEN nth = n - 1 THEN 'L' END AS sample
FROM r WHERE nth IN (0, n // 3, 2 * n // 3, n - 1)""")
def size_samples(spark, sf_dir):
    return compare.pick_sizes(_read(spark, sf_dir, "part"), "p_brand", "p_size", "p_partkey").select("p_partkey", "p_brand", "sample")


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5""")
def largest_groups(spark, sf_dir):
    return compare.top_groups(_read(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_size", 5).select("p_brand", "n")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM orders),
f AS (SELECT * FROM o WHERE was IS NULL OR was <> o_orderstatus)
SELECT o_custkey, o_orderkey AS first_offset, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version_index,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS is_active FROM f""")
def version_history(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("first_offset"), F.crc32("o_orderstatus").alias("crc32"))
    return compare.history(o, ["o_custkey"]).select("o_custkey", "first_offset", "version_index", "is_active")


@query("""SELECT p_partkey, CASE WHEN p_partkey > 0 AND p_partkey % 188 = 0 AND p_partkey % 204 <> 0 THEN 188 WHEN p_partkey > 0 AND p_partkey % 204 = 0 AND p_partkey % 188 <> 0 THEN 204 ELSE 0 END AS packet_size FROM part""")
def datagram_sizes(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", F.coalesce(values.datagram_packet_size(F.col("p_partkey")), F.lit(0)).alias("packet_size"))


def register_catalogue() -> None:
    """The catalogue needs several tables at once, so it has its own small multiplex: programmes, their tables and some of their streams."""
    held: list[DataFrame] = []

    def made(spark, sf_dir):
        n = _read(spark, sf_dir, "nation")
        key = F.col("n_nationkey")
        pat_entry = join(be(key + 1, 2), be(key + 1000 + 0xE000, 2))
        pats = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", pat_entry.alias("r")))).alias("r"))
        pat = mux.section(0, 1, F.aggregate("r", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["r"])))
        pat_rows = pats.select(F.lit("net").alias("source"), F.lit(0).alias("pid"), F.lit(0).cast("long").alias("seq"), pat.alias("section"))
        es = lambda k: join(be(F.lit(27) + k, 1), be(key * 2 + k + 2000 + 0xE000, 2), mux.loop(F.unhex(F.lit(""))))
        pmt = mux.section(2, key + 1, join(be(key * 2 + 2000 + 0xE000, 2), mux.loop(F.unhex(F.lit(""))), es(0), es(1)))
        pmt_rows = n.select(F.lit("net").alias("source"), (key + 1000).cast("int").alias("pid"), (key + 1).cast("long").alias("seq"), pmt.alias("section"))
        tables_packets = mux.section_packets(pat_rows.union(pmt_rows))
        media = n.where("n_nationkey % 3 <> 0").select(F.lit("net").alias("source"), (F.lit(10_000_000) + key * 188).cast("long").alias("byte_offset"), mux.packet((key * 2 + 2001).cast("int"), F.lit(0), be(1, 4)).alias("raw"))
        every = packets.decode(tables_packets.union(media)).cache()
        found = sections.reassemble(every).cache()
        for old in held:  # a call's caches go with the next call
            old.unpersist()
        held[:] = every, found
        return every, tables.pat(found), tables.pmt(found)

    @query("""
WITH n AS (SELECT CAST(n_nationkey AS INTEGER) AS k FROM nation)
SELECT 0 AS pid, 'PAT' AS role, TRUE AS observed UNION ALL SELECT 1000 + k, 'PMT', TRUE FROM n
UNION ALL SELECT 2000 + 2 * k, 'ES', FALSE FROM n UNION ALL SELECT 2001 + 2 * k, 'ES', k % 3 <> 0 FROM n""")
    def pid_roles(spark, sf_dir):
        every, pat, pmt = made(spark, sf_dir)
        return catalog.roles(pat, pmt, every).select("pid", "role", "observed")

    @query("SELECT CAST(2000 + 2 * n_nationkey AS INTEGER) AS pid FROM nation UNION SELECT CAST(2001 + 2 * n_nationkey AS INTEGER) FROM nation WHERE n_nationkey % 3 = 0")
    def missing_pids(spark, sf_dir):
        every, pat, pmt = made(spark, sf_dir)
        return catalog.missing(catalog.roles(pat, pmt, every)).select("pid")

    @query("SELECT CAST(1000 + n_nationkey AS INTEGER) AS pid, count(*) AS n FROM nation GROUP BY 1")
    def programme_packets(spark, sf_dir):
        """Packets on the PIDs that the programme list announces."""
        every, pat, _ = made(spark, sf_dir)
        return catalog.of_pids(every, catalog.pmt_pids(pat)).groupBy("pid").agg(F.count("*").alias("n"))


register_catalogue()
