"""Transport packets: from bytes to rows, and from rows to header, adaptation field, PES header and payload.

Every column is a built-in expression over the packet's bytes, so a scan decodes what a query asks for and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.functions.bits import bits, flag, once, part, uint
from muxlake.functions.values import datagram_packet_size
from muxlake.operators.ranges import with_number, with_previous

SYNC, NULL_PID = 0x47, 0x1FFF
#: Stream ids whose PES packets have no optional header (fixed values).
PLAIN_STREAMS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)


def packetize(df: DataFrame, column: str, packet_size: int = 188, key: str = "source") -> DataFrame:
    """A row (key, byte_offset, raw) for each whole packet of a binary column; a rest is left out."""
    if packet_size < 188:
        raise ValueError("a packet has 188 bytes at least")
    n = F.floor(F.length(column) / packet_size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    rows = df.select(key, column, at.alias("k"))
    offset = F.col("k").cast("long") * packet_size
    return rows.select(key, offset.alias("byte_offset"), part(F.col(column), offset.cast("int"), 188).alias("raw"))


def in_sync(packets: DataFrame) -> DataFrame:
    """Packets that begin with the sync byte and are whole."""
    return packets.where((uint(F.col("raw"), 0) == SYNC) & (F.length("raw") >= 188))


def lost_sync(packets: DataFrame) -> DataFrame:
    """An error row for each packet that does not."""
    bad = packets.where((F.length("raw") < 188) | F.coalesce(uint(F.col("raw"), 0) != SYNC, F.lit(True)))
    return bad.select("source", F.lit(None).cast("int").alias("pid"), "byte_offset", F.lit("WARNING").alias("severity"), F.lit("SYNC_LOSS").alias("code"))


def sync_losses(packets: DataFrame, packet_size: int = 188) -> DataFrame:
    """An error row for each gap between packets of a source that is not a packet long, with the bytes that were passed over."""
    rows = with_previous(packets.select("source", "byte_offset"), ["source"], ["byte_offset"])
    skipped = F.col("byte_offset") - F.col("before.byte_offset") - packet_size
    lost = rows.select("source", F.lit(None).cast("int").alias("pid"), "byte_offset", F.lit("WARNING").alias("severity"), F.lit("SYNC_LOSS").alias("code"), skipped.alias("n_skipped"))
    return lost.where("n_skipped <> 0")


def numbered(packets: DataFrame) -> DataFrame:
    """Packets with packet_number, which counts them from 0 in each source."""
    return with_number(packets, ["source"], name="packet_number")


def from_datagrams(datagrams: DataFrame, column: str = "datagram", range_size: int = 100_000) -> DataFrame:
    """(source, byte_offset, raw) of datagrams(source, arrival, column): the packets of those whose length is a multiple of 188 or of 204 bytes.

    Offsets count the bytes of accepted datagrams of a source in the order of arrival, a number. Datagrams are put in order in ranges of so many arrivals; bytes
    of the ranges before are added up apart, so no task holds a source.
    """
    size, n_bytes = datagram_packet_size(F.length(column)), F.length(column).cast("long")
    own = F.floor(F.col("arrival") / range_size).cast("long")
    whole = datagrams.where(size.isNotNull()).select("source", "arrival", own.alias("range"), column, size.alias("size"))
    totals = whole.groupBy("source", "range").agg(F.sum(n_bytes).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(F.col("source").alias("of"), F.col("range").alias("place"), F.coalesce(earlier, F.lit(0)).alias("carried"))
    within = F.sum(n_bytes).over(Window.partitionBy("source", "range").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    placed = whole.withColumn("at", F.coalesce(within, F.lit(0))).join(carried, F.col("source").eqNullSafe(F.col("of")) & F.col("range").eqNullSafe(F.col("place")))
    rows = placed.select("source", (F.col("at") + F.col("carried")).alias("at"), "size", column, F.explode(F.sequence(F.lit(0), (F.length(column) / F.col("size")).cast("int") - 1)).alias("k"))
    start = F.col("k") * F.col("size")
    return rows.select("source", (F.col("at") + start).cast("long").alias("byte_offset"), part(F.col(column), start, 188).alias("raw"))


def _has(raw: Column, k: int) -> Column:
    """A flag of the adaptation field, if it has flags at all."""
    return (uint(raw, 4) > 0) & flag(raw, 5, k)


def clock(raw: Column, at=6) -> Column:
    """33 bits of 90 kHz and nine of 27 MHz."""
    return bits(raw, at, 0, 33) * 300 + bits(raw, at, 39, 9)


def adaptation_field(raw: Column) -> Column:
    """The adaptation field as a struct; what its flags leave out is null."""
    has = lambda k: _has(raw, k)
    opcr_at = F.lit(6) + F.when(has(3), 6).otherwise(0)
    splice_at = opcr_at + F.when(has(4), 6).otherwise(0)
    countdown = uint(raw, splice_at)

    def behind_splice(private_at: Column) -> Column:
        private_size = F.when(has(6), uint(raw, private_at)).otherwise(0)

        def behind_private(extension_at: Column) -> Column:
            extended = lambda k: has(7) & flag(raw, extension_at + 1, k)
            rate_at = extension_at + 2 + F.when(extended(0), 2).otherwise(0)
            return once(rate_at + F.when(extended(1), 3).otherwise(0), lambda seamless_at: F.struct(
                uint(raw, 4).cast("short").alias("length"),
                has(0).alias("discontinuity"), has(1).alias("random_access"), has(2).alias("priority"),
                F.when(has(3), clock(raw)).alias("pcr"), F.when(has(4), clock(raw, opcr_at)).alias("opcr"),
                F.when(has(5), F.when(countdown > 127, countdown - 256).otherwise(countdown)).cast("short").alias("splice_countdown"),
                F.when(has(6), part(raw, private_at + 1, private_size)).alias("private_data"),
                F.when(extended(0), bits(raw, extension_at + 2, 1, 15)).cast("int").alias("ltw_offset"),
                F.when(extended(1), bits(raw, rate_at, 2, 22)).cast("int").alias("piecewise_rate"),
                F.when(extended(2), bits(raw, seamless_at, 0, 4)).cast("short").alias("splice_type"),
                F.when(extended(2), time_stamp(raw, seamless_at)).alias("dts_next_au"),
            ))

        return once(private_at + F.when(has(6), private_size + 1).otherwise(0), behind_private)

    return once(splice_at + F.when(has(5), 1).otherwise(0), behind_splice)


def time_stamp(data: Column, at) -> Column:
    """33 bits in three parts, each with a marker bit behind it."""
    return bits(data, at, 4, 3) * (1 << 30) + bits(data, at, 8, 15) * (1 << 15) + bits(data, at, 24, 15)


def pes_header(payload: Column) -> Column:
    """The PES header at a payload's start as a struct, or null where there is none."""
    stream = uint(payload, 3)
    optional = ~stream.isin(*PLAIN_STREAMS)
    has = lambda k: optional & flag(payload, 7, k)
    pts = F.when(has(0), time_stamp(payload, 9))
    dts = F.when(has(0) & has(1), time_stamp(payload, 14))
    escr_at = F.lit(9) + F.when(has(0), 5).otherwise(0) + F.when(has(0) & has(1), 5).otherwise(0)
    rate_at = escr_at + F.when(has(2), 6).otherwise(0)
    header = once(rate_at, lambda rate_at: F.struct(
        stream.cast("short").alias("stream_id"), uint(payload, 4, 2).cast("int").alias("packet_length"),
        F.when(optional, bits(payload, 6, 2, 2)).cast("short").alias("scrambling"),
        F.when(optional, flag(payload, 6, 4)).alias("priority"), F.when(optional, flag(payload, 6, 5)).alias("data_alignment"),
        F.when(optional, bits(payload, 7, 0, 2)).cast("short").alias("pts_dts_flags"),
        F.when(optional, uint(payload, 8)).cast("short").alias("header_length"),
        pts.alias("pts"), dts.alias("dts"), F.when(has(3), bits(payload, rate_at, 1, 22)).cast("int").alias("es_rate"),
        F.when(optional, 9 + uint(payload, 8)).otherwise(6).cast("int").alias("data_at"),
    ))
    return F.when((uint(payload, 0, 3) == 1) & (F.length(payload) > 6), header)


def decode(packets: DataFrame) -> DataFrame:
    """packets(source, byte_offset, raw) with their fields; damaged and null packets have no more than a PID.

    What most operators ask of the adaptation and PES fields (discontinuity, pcr, pts, dts) has columns of its own.
    """
    head = in_sync(packets).withColumn("head", uint(F.col("raw"), 0, 4))
    at = lambda shift, mask: F.shiftright("head", shift).bitwiseAND(mask)
    whole = (at(23, 1) == 0) & (at(8, 0x1FFF) != NULL_PID)
    field = whole & (at(5, 1) == 1)
    start = F.lit(4) + F.when(at(5, 1) == 1, uint(F.col("raw"), 4) + 1).otherwise(0)
    payload = F.when(whole & (at(4, 1) == 1) & (start < 187), F.substring("raw", start.cast("int") + 1, 188 - start.cast("int")))
    fields = head.select(
        "source", "byte_offset", at(8, 0x1FFF).cast("int").alias("pid"), (at(23, 1) == 1).alias("tei"), (at(22, 1) == 1).alias("pusi"),
        (at(21, 1) == 1).alias("priority"), at(6, 3).cast("short").alias("scrambling"), at(4, 3).cast("short").alias("afc"),
        at(0, 15).cast("short").alias("cc"), (at(4, 1) == 1).alias("has_payload"), (at(5, 1) == 1).alias("has_af"),
        (field & F.coalesce(_has(F.col("raw"), 0), F.lit(False))).alias("discontinuity"), F.when(field & _has(F.col("raw"), 3), clock(F.col("raw"))).alias("pcr"),
        F.when(field, adaptation_field(F.col("raw"))).alias("adaptation_field"), payload.alias("payload"),
    )
    data = F.col("payload")
    timed = F.col("pusi") & (uint(data, 0, 3) == 1) & ~uint(data, 3).isin(*PLAIN_STREAMS) & flag(data, 7, 0)
    return fields.withColumns({
        "pts": F.when(timed, time_stamp(data, 9)), "dts": F.when(timed & flag(data, 7, 1), time_stamp(data, 14)),
        "pes_header": F.when(F.col("pusi"), pes_header(data)),
    })


# PIDs of the tables that have their own.
ROUTES = {0x00: "PAT", 0x01: "CAT", 0x10: "NIT", 0x11: "SDT/BAT", 0x12: "EIT", 0x13: "RST", 0x14: "TDT/TOT", 0x15: "MIP", 0x1E: "DIT", 0x1F: "SIT"}


def route(pid: Column) -> Column:
    """The tables of a PID, null for all that are found through other tables."""
    out = F.lit(None).cast("string")
    for number, name in ROUTES.items():
        out = F.when(pid == number, name).otherwise(out)
    return out
