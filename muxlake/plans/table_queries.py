"""More registered queries: access tables, time offsets, megaframe packets, cues of all commands and versions of slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.functions.bits import be, fill, join, once, part, uint
from muxlake.functions.checks import with_crc
from muxlake.operators import descriptors as desc
from muxlake.operators import packets, tables
from muxlake.plans import mux
from muxlake.plans.queries import SPAN, _decoded, _micros, _mjd, _numbered, _read, query


def _joined(items: str):
    """The bytes of a sorted list of structs whose second field is `bytes`."""
    return F.aggregate(items, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["bytes"]))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS source, CAST(n_nationkey + 1 AS BIGINT) AS ca_system_id, CAST(n_nationkey + 1000 AS BIGINT) AS ca_pid FROM nation")
def cat_access(spark, sf_dir):
    """Conditional access tables, one for each region."""
    key = F.col("n_nationkey")
    one = mux.descriptor(0x09, join(be(key + 1, 2), be(key + 1000 + 0xE000, 2)))
    grouped = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(key, one.alias("bytes")))).alias("d"))
    made = _numbered(grouped, F.lit(1), mux.section(1, 0xFFFF, _joined("d")), "n_regionkey", F.col("n_regionkey").cast("string"))
    loops = tables.cat(_decoded(made)).select("source", "descriptors")
    return desc.typed(desc.split(loops, "descriptors"), "dvb", 0x09).select("source", "ca_system_id", "ca_pid")


@query("""SELECT o_orderkey AS place, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS utc_sec, 'RUS' AS country, CAST(o_orderkey % 60 AS BIGINT) AS region_id, o_orderkey % 2 = 1 AS negative,
  CAST(o_orderkey % 13 * 60 + o_orderkey % 4 * 15 AS BIGINT) AS offset_min, CAST(epoch_us(o_orderdate) // 1000000 + 86400 AS BIGINT) AS change_sec, CAST(o_orderkey % 11 * 60 AS BIGINT) AS next_offset_min FROM orders""")
def tot_offsets(spark, sf_dir):
    """Time offset tables with the offset of a region."""
    o = _read(spark, sf_dir, "orders")
    key, sec = F.col("o_orderkey"), F.floor(_micros("o_orderdate") / 1_000_000)
    clock = lambda hours, minutes: F.unhex(F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lpad(minutes.cast("string"), 2, "0")))
    offset = join(F.encode(F.lit("RUS"), "UTF-8"), be(key % 60 * 4 + 2 + key % 2, 1), clock(key % 13, key % 4 * 15), _mjd(sec + 86400), clock(key % 11, F.lit(0)))
    body = join(_mjd(sec), mux.loop(mux.descriptor(0x58, offset)))
    section = with_crc(once(body, lambda x: join(be(0x73, 1), be(F.length(x) + 4 + 0x7000, 2), x)))
    found = tables.tot(_decoded(_numbered(o, F.lit(0x14), section, "o_orderkey", key.cast("string"))))
    rows = desc.typed(desc.split(found.select("source", "utc_sec", "descriptors"), "descriptors"), "dvb", 0x58)
    whole = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(F.col("source").cast("long").alias("place"), whole("utc_sec"), "country", whole("region_id"), "negative", whole("offset_min"), whole("change_sec"), whole("next_offset_min"))


@query("""SELECT CAST(s_suppkey % 65536 AS INTEGER) AS pointer, s_suppkey % 2 = 1 AS periodic, CAST(s_suppkey * 100 AS BIGINT) AS sync_timestamp, CAST(s_nationkey + 9000000 AS BIGINT) AS max_delay,
  CAST(s_suppkey % 3 AS INTEGER) AS constellation, CAST(s_suppkey % 5 AS INTEGER) AS code_rate, CAST(s_suppkey % 4 AS INTEGER) AS guard_interval, s_suppkey % 2 = 0 AS ts_priority,
  s_suppkey % 7 <> 0 AS crc_ok, CAST(t AS INTEGER) AS position, CAST(s_nationkey + t AS INTEGER) AS tx_id, CAST(2 AS INTEGER) AS n_functions, CAST(s_suppkey % 1000 AS INTEGER) AS cell_id, t = 1 AS wait_for_enable
FROM supplier, (VALUES (0), (1)) v(t)""")
def mip_functions(spark, sf_dir):
    """Megaframe packets of two transmitters each; every seventh is damaged."""
    s = _read(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    function = lambda t: join(be(nation + t, 2), be(9, 1), be(0, 1), be(2, 1), be(77, 2), be(4, 1), be(3, 1), be(key % 1000, 2), be(t * 0x80 + 0x7F, 1))
    head = join(be(0x47, 1), be(0x4015, 2), be(key % 16 + 16, 1))
    tps = be(key % 3 * (1 << 30) + key % 5 * (1 << 24) + key % 4 * (1 << 22) + (key % 2 == 0).cast("int") * (1 << 17), 4)
    body = join(be(key % 65536, 2), be(key % 2 * 0x8000, 2), be(key * 100, 3), be(nation + 9000000, 3), tps, be(24, 1), function(0), function(1))
    sound = with_crc(once(body, lambda x: join(head, be(0, 1), be(F.length(x) + 4, 1), x)))
    tail = F.when(key % 7 == 0, be(0, 4)).otherwise(part(sound, F.length(sound) - 4, 4))
    raw = join(part(sound, 0, F.length(sound) - 4), tail, fill(F.lit(188) - F.length(sound)))
    made = s.select(F.lit("mip").alias("source"), (key * 188).cast("long").alias("byte_offset"), raw.alias("raw"))
    found = tables.mip(packets.decode(made.groupBy("source", "byte_offset").agg(F.first("raw").alias("raw"))))  # so that filters don't repeat the muxer's expressions
    rows = found.select("*", F.posexplode("transmitters").alias("position", "t"))
    cell = F.filter("t.functions", lambda f: f["tag"] == 4)[0]
    return rows.select(
        "pointer", "periodic", "sync_timestamp", "max_delay", "constellation", "code_rate", "guard_interval", "ts_priority", "crc_ok", "position",
        "t.tx_id", F.size("t.functions").alias("n_functions"), cell["cell_id"].alias("cell_id"), cell["wait_for_enable"].alias("wait_for_enable"),
    )


def _cues(df: DataFrame, key: str, kind, command, descriptors=None) -> DataFrame:
    """Cues of a command and a loop of descriptors each, whose adjustment of time stamps is the row's key."""
    head = lambda x: join(be(0, 1), be(F.col(key), 5), be(0, 1), be(F.length(x) + (0xFFF << 12), 3), be(kind, 1))
    loop = be(0, 2) if descriptors is None else mux.loop(descriptors, 0)
    body = once(command, lambda x: join(head(x), x, loop))
    section = with_crc(once(body, lambda x: join(be(0xFC, 1), be(F.length(x) + 4 + 0x3000, 2), x)))
    return tables.splice(_decoded(_numbered(df, F.lit(0x300), section, key, F.concat(F.lit("cues "), (F.col(key) % 16).cast("string")), SPAN * 16)))


@query("""SELECT c_custkey AS place, CAST(CASE c_custkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 255 ELSE 7 END AS INTEGER) AS command_type,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey * 90000 + 4294967296 AS BIGINT) ELSE -1 END AS splice_pts, CASE WHEN c_custkey % 3 = 1 THEN CAST(1129661769 AS BIGINT) ELSE -1 END AS private_identifier,
  CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE '' END AS private_text FROM customer""")
def splice_signals(spark, sf_dir):
    """Time signals with and without a time, private commands and reserved bandwidth.

    A time stamp has 33 bits and begins anew after them; a time descriptor beside it tells the second, and so how often it did.
    """
    key, turn = F.col("c_custkey"), 1 << 33
    ticks = key * 90000 + (1 << 32)
    signal = F.when(key % 2 == 0, be(ticks % turn + (0xFE << 32), 5)).otherwise(be(0x7F, 1))
    time = F.when(key % 6 == 0, mux.descriptor(0x03, join(be(0x43554549, 4), be(F.floor(ticks / 90000), 6), be(0, 4), be(0, 2)))).otherwise(F.unhex(F.lit("")))
    private = join(be(0x43554549, 4), F.encode("c_name", "UTF-8"))
    kind = F.when(key % 3 == 0, 6).when(key % 3 == 1, 255).otherwise(7)
    command = F.when(key % 3 == 0, signal).when(key % 3 == 1, private).otherwise(F.unhex(F.lit("")))
    out = _cues(_read(spark, sf_dir, "customer"), "c_custkey", kind, command, time)
    second = uint(F.col("descriptors"), 6, 6)  # behind the only descriptor's tag, length and identifier
    pts = F.col("splice_pts") + F.floor((second * 90000 - F.col("splice_pts") + turn // 2) / turn) * turn
    told = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    return out.select(
        F.col("pts_adjustment").alias("place"), "command_type", told(pts).alias("splice_pts"), told("private_identifier").alias("private_identifier"),
        F.coalesce(F.decode("private_bytes", "UTF-8"), F.lit("")).alias("private_text"),
    )


@query("""SELECT c_custkey AS place, CAST(k AS INTEGER) AS position, CAST(c_custkey * 4 + k AS BIGINT) AS event_id, k = 2 AS cancelled,
  CASE k WHEN 0 THEN CAST(c_custkey + 1000 AS BIGINT) WHEN 1 THEN CAST(c_custkey + 3003 AS BIGINT) ELSE -1 END AS utc_sum,
  CASE WHEN k = 0 THEN CAST(c_custkey * 90 AS BIGINT) ELSE -1 END AS break_duration, CAST(CASE k WHEN 2 THEN -1 ELSE c_nationkey END AS INTEGER) AS unique_program_id
FROM customer, (VALUES (0), (1), (2)) v(k)""")
def splice_schedules(spark, sf_dir):
    """Schedules of three events: a programme with a break, two components, and one that is cancelled."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    told = join(be(nation, 2), be(1, 1), be(2, 1))
    program = join(be(key * 4, 4), be(0x7F, 1), be(0xFF, 1), be(key + 1000, 4), be(key * 90 + (0xFE << 32), 5), told)
    components = join(be(key * 4 + 1, 4), be(0x7F, 1), be(0x9F, 1), be(2, 1), be(5, 1), be(key + 1001, 4), be(6, 1), be(2002, 4), told)
    command = join(be(3, 1), program, components, be(key * 4 + 2, 4), be(0xFF, 1))
    out = _cues(_read(spark, sf_dir, "customer"), "c_custkey", 4, command).select(F.col("pts_adjustment").alias("place"), F.posexplode("schedule").alias("position", "e"))
    parts = F.aggregate("e.components", F.lit(0).cast("long"), lambda a, c: a + c["utc_splice_time"])
    or_less = lambda c, name, kind: F.coalesce(c, F.lit(-1)).cast(kind).alias(name)
    return out.select(
        "place", "position", "e.event_id", "e.cancelled", or_less(F.coalesce("e.utc_splice_time", parts), "utc_sum", "long"),
        or_less(F.col("e.break_duration"), "break_duration", "long"), or_less(F.col("e.unique_program_id"), "unique_program_id", "int"),
    )


#: What names a slot of each kind.
_IDS = {"NIT": "network_id", "BAT": "bouquet_id", "SDT": "ts_id", "EIT": "service_id"}


@query("""SELECT kind, CAST(n_nationkey AS INTEGER) AS id, CAST(k % 2 AS INTEGER) AS version, count(*) AS n
FROM nation, (VALUES ('NIT'), ('BAT'), ('SDT'), ('EIT')) t(kind), LATERAL (SELECT unnest(range(0, n_nationkey % 4 + 2)) AS k) x GROUP BY kind, n_nationkey, k % 2""")
def slot_versions(spark, sf_dir):
    """Tables that go back and forth between two versions, each sent twice: every change counts, a repetition does not."""
    none = be(0xF000, 2)
    slotted = {
        "NIT": (0x40, 0x10, join(none, none)), "BAT": (0x4A, 0x11, join(none, none)),
        "SDT": (0x42, 0x11, join(be(1, 2), be(0xFF, 1))), "EIT": (0x50, 0x12, join(be(1, 2), be(2, 2), be(0, 1), be(0x50, 1))),
    }
    key = F.col("n_nationkey")
    sent = _read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), (key % 4 * 2 + 3).cast("int"))).alias("k"))
    sent = sent.withColumns({"seq": key * 100 + F.col("k"), "v": F.floor(F.col("k") / 2) % 2})
    out = []
    for kind, (table_id, pid, body) in slotted.items():
        made = _numbered(sent, F.lit(pid), mux.section(table_id, key, body, F.col("v")), "seq", F.lit(kind))
        out.append(tables.versions(_decoded(made), kind).groupBy(F.lit(kind).alias("kind"), F.col(_IDS[kind]).alias("id"), "version").agg(F.count("*").alias("n")))
    return reduce(DataFrame.union, out)
