"""More registered queries: rates of PIDs, names, datagrams, numbers and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.functions import names
from muxlake.functions.bits import be, join
from muxlake.operators import analyzer, compare, packets
from muxlake.plans import mux
from muxlake.plans.queries import _EVENT_ROWS, ORACLE_SQL, _read, event_packets, query


ORACLE_SQL["bitrate_per_pid"] = _EVENT_ROWS.replace("WITH numbered", "WITH RECURSIVE numbered") + """
, ref AS (SELECT pid FROM e ORDER BY event_id LIMIT 1),
ticks AS (SELECT event_id, pcr, row_number() OVER (ORDER BY event_id) AS slot FROM e WHERE pid = (SELECT pid FROM ref)),
placed AS (SELECT e.pid, (SELECT min(k.slot) FROM ticks k WHERE k.event_id >= e.event_id) AS slot FROM e),
sums AS (SELECT pid, slot, count(*) * 188 AS n FROM placed WHERE slot IS NOT NULL GROUP BY pid, slot),
first AS (SELECT pid, min(slot) AS slot FROM sums GROUP BY pid),
grid AS (SELECT f.pid, k.slot, k.event_id, k.pcr, sum(coalesce(s.n, 0)) OVER (PARTITION BY f.pid ORDER BY k.slot) AS cum
         FROM first f JOIN ticks k ON k.slot >= f.slot LEFT JOIN sums s ON s.pid = f.pid AND s.slot = k.slot),
w AS (
  SELECT g.pid, g.slot, g.event_id, g.pcr, CAST(NULL AS BIGINT) AS n_bytes, CAST(NULL AS BIGINT) AS ticks, CAST(0 AS HUGEINT) AS base FROM grid g JOIN first f ON f.pid = g.pid AND f.slot = g.slot
  UNION ALL
  SELECT r.pid, r.slot, r.event_id, r.pcr, CAST(r.cum - w.base AS BIGINT), (r.pcr - w.pcr + 4398046511104) % 4398046511104, r.cum
  FROM w, LATERAL (SELECT * FROM grid g WHERE g.pid = w.pid AND g.slot > w.slot AND g.cum > w.base AND (g.pcr - w.pcr + 4398046511104) % 4398046511104 >= 2332800000000 ORDER BY g.slot LIMIT 1) r)
SELECT pid, event_id * 188 AS byte_offset, n_bytes, ticks, n_bytes * 8.0::DOUBLE * 27000000.0::DOUBLE / ticks AS bps FROM w WHERE n_bytes IS NOT NULL"""


# Values and series.
_TABLES = {
    "stream type": names.STREAM_TYPES, "service type": names.SERVICE_TYPES, "audio type": names.AUDIO_TYPES, "running status": names.RUNNING_STATUS, "teletext": names.TELETEXT_TYPES,
    "genre": names.GENRES, "linkage": names.LINKAGE_TYPES, "control": names.AIT_CONTROL, "splice command": names.SPLICE_COMMANDS, "segmentation": names.SEGMENTATION_TYPES, "upid": names.UPID_TYPES,
    "constellation": names.CONSTELLATIONS, "code rate": names.CODE_RATES, "guard": names.GUARD_INTERVALS, "mode": names.TRANSMISSION_MODES, "hierarchy": names.HIERARCHIES,
    "provider": names.CAS_PROVIDERS, "cas service": names.CAS_SERVICES, "update": names.UPDATE_TYPES, "cue": names.CUE_TYPES, "alignment": names.ALIGNMENTS, "carousel": names.CAROUSEL_FORMATS,
    "mip function": names.MIP_FUNCTIONS, "inner fec": names.INNER_FECS, "outer fec": names.OUTER_FECS, "cable": names.CABLE_MODULATIONS, "polarization": names.POLARIZATIONS,
}
_NAME_SQL = ", ".join("('{}', {}, '{}')".format(kind, code, text.replace("'", "''")) for kind, table in _TABLES.items() for code, text in table.items())


@query(f"""WITH names(kind, code, text) AS (VALUES {_NAME_SQL})
SELECT kinds.kind, p_size AS code, count(*) AS n, coalesce(max(names.text), 'unknown') AS name FROM part CROSS JOIN (SELECT DISTINCT kind FROM names) kinds LEFT JOIN names ON names.kind = kinds.kind AND names.code = p_size
GROUP BY kinds.kind, p_size""")
def code_names(spark, sf_dir):
    """The names of codes, taken from sizes of parts."""
    sizes = _read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("code")).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), names.name_of(F.col("code"), table).alias("name")) for kind, table in _TABLES.items())))
    return sizes.select("code", "n", pairs.alias("p")).select("p.kind", "code", "n", "p.name")


@query("""SELECT CAST(p_partkey % 5 AS VARCHAR) AS source, count(*) * 7 AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1""")
def datagram_packets(spark, sf_dir):
    """Packets of datagrams of 188 and 204 bytes; others are no packets."""
    p = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    whole = join(be(0x47, 1), mux.fill(187, 0x11))
    seven = lambda x: F.unhex(F.repeat(F.hex(x), 7))
    datagram = F.when(key % 3 == 1, seven(whole)).when(key % 3 == 2, seven(join(whole, mux.fill(16, 0)))).otherwise(mux.fill(100))
    rows = packets.from_datagrams(p.select((key % 5).cast("string").alias("source"), key.alias("arrival"), datagram.alias("datagram")))
    return packets.in_sync(rows).groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT CAST(256 + user_id % 64 AS INTEGER) AS pid, event_id * 188 AS byte_offset, CAST(round(value * 100) AS BIGINT) AS bps FROM events WHERE user_id % 64 < 9)
SELECT byte_offset // 1880 AS byte_offset, CAST(sum(bps) AS BIGINT) AS bps FROM e GROUP BY 1""")
def sums_by_offset(spark, sf_dir):
    """Values of chosen PIDs added up at equal offsets."""
    e = _read(spark, sf_dir, "events")
    rows = e.select(F.lit("e").alias("source"), (F.col("user_id") % 64 + 256).cast("int").alias("pid"), F.floor(F.col("event_id") / 10).alias("byte_offset"), F.round(F.col("value") * 100).cast("long").alias("bps"))
    return analyzer.sum_by_offset(rows, list(range(256, 265))).select("byte_offset", "bps")


@query(_EVENT_ROWS + "SELECT CAST(event_id * 188 AS BIGINT) AS byte_offset, row_number() OVER (ORDER BY event_id) - 1 AS packet_number FROM numbered WHERE event_id % 97 <> 0")
def packet_numbers(spark, sf_dir):
    return packets.numbered(event_packets(spark, sf_dir).select("source", "byte_offset")).select("byte_offset", "packet_number")


@query("""WITH k AS (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS was FROM events WHERE event_id % 97 <> 0)
SELECT event_id * 188 AS byte_offset, (event_id - was - 1) * 188 AS n_skipped, 'SYNC_LOSS' AS code FROM k WHERE event_id - was <> 1""")
def sync_gaps(spark, sf_dir):
    """Where bytes without packets were passed over."""
    return packets.sync_losses(event_packets(spark, sf_dir)).select("byte_offset", "n_skipped", "code")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 50 <> 7)
SELECT a.o_orderkey, 'ids[0].customer' AS path, CAST(a.o_custkey AS VARCHAR) AS before, CAST(b.o_custkey AS VARCHAR) AS after FROM a LEFT JOIN b USING (o_orderkey) WHERE a.o_custkey IS DISTINCT FROM b.o_custkey
UNION ALL SELECT a.o_orderkey, 'state.status', a.o_orderstatus, b.o_orderstatus FROM a LEFT JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def nested_differences(spark, sf_dir):
    """Differences inside structs and arrays."""
    shaped = lambda df: df.select("o_orderkey", F.array(F.struct(F.col("o_custkey").alias("customer"))).alias("ids"), F.struct(F.col("o_orderstatus").alias("status")).alias("state"))
    a = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    b = a.where("o_orderkey % 50 <> 7").withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") % 10 == 0).cast("int"))
    return compare.deep_differences(shaped(a), shaped(b), ["o_orderkey"])


@query("SELECT p_brand AS g, count(*) AS available, count(DISTINCT p_type) AS n_unique FROM part GROUP BY p_brand")
def corpus_counts(spark, sf_dir):
    """Entries and distinct contents of each group of a corpus."""
    p = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.encode("p_type", "UTF-8").alias("data"))
    return compare.corpus_stats(p, "g", "data")
