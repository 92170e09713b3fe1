"""T2-MI carriers: packets out of a PID's payloads, baseband frames, and the transport streams inside each PLP."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.functions.bits import bits, flag, part, uint
from muxlake.functions.checks import crc8_dvb
from muxlake.operators.ranges import range_of
from muxlake.operators.sections import crc_matches, runs, units


UNITS = "source string, pid int, first_offset bigint, place int, packet binary, crc_ok boolean"
#: Payload bytes that a packet has at most.
MAX_PAYLOAD = 8192


def cut_packets(data: bytes) -> Iterator[bytes]:
    """The whole T2-MI packets at the start of a run's bytes: six bytes, so many bits filled up to bytes, and four of CRC."""
    at = 0
    while at + 10 <= len(data):
        n = -(-int.from_bytes(data[at + 4 : at + 6], "big") // 8)
        if n > MAX_PAYLOAD or at + 10 + n > len(data):
            return
        yield data[at : at + 10 + n]
        at += 10 + n


def may_begin(data: bytes) -> bool:
    """Whether bytes without a whole packet may be the beginning of one."""
    return len(data) < 6 or -(-int.from_bytes(data[4:6], "big") // 8) <= MAX_PAYLOAD


def of_packets(units_: DataFrame) -> DataFrame:
    """The fields of T2-MI packets (source, pid, first_offset, place, packet, crc_ok)."""
    p, body = F.col("packet"), F.length("packet") - 4
    kind = uint(p, 0).cast("int")
    of_frame = lambda x: F.when(kind == 0, x)
    return units_.select(
        "source", "pid", "first_offset", "place", kind.alias("packet_type"), uint(p, 1).cast("int").alias("packet_count"),
        bits(p, 2, 0, 4).cast("int").alias("superframe"), bits(p, 2, 13, 3).cast("int").alias("stream_id"),
        of_frame(uint(p, 7)).cast("int").alias("plp_id"), of_frame(uint(p, 6)).cast("int").alias("frame_index"), of_frame(flag(p, 8, 0)).alias("interleave_start"),
        part(p, 6, body - 6).alias("payload"), "crc_ok",
    )


def carrier_packets(packets: DataFrame, range_bytes: int | None = None, partitions: int | None = None) -> DataFrame:
    """t2mi(source, pid, first_offset, place, packet_type, packet_count, superframe, stream_id, plp_id, frame_index, interleave_start, payload, crc_ok).

    Runs of packets are cut at the starts that pointers tell, as sections are; a run's bytes hold whole T2-MI packets.
    """
    useful = packets.where("NOT tei AND payload IS NOT NULL").withColumn("discontinuity", F.lit(False))
    return of_packets(units(runs(useful, skip_pes=False, range_bytes=range_bytes, partitions=partitions), cut_packets, UNITS, lambda every: [pa.array(map(crc_matches, every), pa.bool_())]))


def baseband_frames(t2mi: DataFrame) -> DataFrame:
    """The baseband frames of type 0 packets: header fields, mode by the header's CRC-8, and the data field."""
    b = F.substring("payload", F.lit(4), F.length("payload"))
    rows = t2mi.where("packet_type = 0").select("source", "pid", "first_offset", "place", "plp_id", b.alias("bb")).where(F.length("bb") >= 10)
    h = F.col("bb")
    return rows.select(
        "source", "pid", "first_offset", "place", "plp_id", bits(h, 0, 0, 2).cast("int").alias("ts_gs"), flag(h, 0, 2).alias("single_input"), flag(h, 0, 4).alias("issy"), flag(h, 0, 5).alias("null_deleted"),
        uint(h, 2, 2).cast("int").alias("upl"), uint(h, 4, 2).cast("int").alias("dfl"), uint(h, 6).cast("int").alias("sync"), uint(h, 7, 2).cast("int").alias("syncd"),
        crc8_dvb(F.substring("bb", 1, 9)).bitwiseXOR(uint(h, 9).cast("int")).alias("mode"), part(h, 10, F.floor(uint(h, 4, 2) / 8)).alias("data"),
    )


#: What stands for a null packet that was taken out before transmission.
NULL_PACKET = b"\x47\x1f\xff\x10" + b"\xff" * 184
NO_START = 0xFFFF
#: More bytes than a packet in a frame can have.
LIMIT = 8193
_KEY = ("source", "pid", "plp_id")
CUT = "source string, pid int, plp_id int, number bigint, nulls int, raw binary"
_EDGES = "source string, pid int, plp_id int, range bigint, head binary, tail binary, size int, deleted boolean, n bigint"


class Stripper:
    """The packets of a PLP, frame by frame: the packet that is open, its size and kind, and how many there were.

    A packet is whole if what comes before the next start completes it exactly. head: what came before the first start, which ends a packet of an earlier range.
    """

    def __init__(self, rest: bytes = b"", size: int = 0, mode: int = 0, deleted: bool = False, n: int = 0):
        self.rest, self.size, self.mode, self.deleted, self.n, self.head = rest, size, mode, deleted, n, b""

    def state(self) -> tuple:
        return self.rest, self.size, self.mode, self.deleted, self.n

    def _take(self, unit: bytes) -> tuple[int, int, bytes]:
        """(number, null packets in front, packet): a synchronous byte is left out or replaced by a checksum; the times and the count behind a packet go."""
        number, nulls = self.n, unit[-1] if self.deleted else 0
        self.n += nulls + 1
        return number, nulls, b"\x47" + (unit[:187] if self.mode else unit[1:188])

    def close(self, more: bytes = b"") -> list[tuple[int, int, bytes]]:
        """The open packet, if these bytes complete it."""
        unit, self.rest = self.rest + more if self.rest else b"", b""
        return [self._take(unit)] if unit and len(unit) == self.size else []

    def push(self, data: bytes, syncd: int, upl: int, mode: int, deleted: bool) -> list[tuple[int, int, bytes]]:
        begin = len(data) if syncd == NO_START else syncd // 8
        if not self.size:
            self.head = (self.head + data[:begin])[:LIMIT]
        elif self.rest:
            self.rest = (self.rest + data[:begin])[:LIMIT]
        if syncd == NO_START:
            return []
        out = self.close()
        self.size, self.mode, self.deleted = 187 + deleted if mode else upl // 8, mode, deleted
        end = begin + (len(data) - begin) // self.size * self.size
        out += [self._take(data[at : at + self.size]) for at in range(begin, end, self.size)]
        self.rest = data[end:]
        return out


def usable(frames: DataFrame) -> DataFrame:
    """Frames of transport streams in whole bytes, that start inside the frame if at all; in normal mode with room for what their flags tell."""
    room = F.lit(188) + F.col("null_deleted").cast("int") + F.when(F.col("issy"), 2).otherwise(0)
    starts = (F.col("syncd") == NO_START) | ((F.col("syncd") % 8 == 0) & (F.col("syncd") < F.col("dfl")))
    return frames.where("ts_gs = 3 AND dfl % 8 = 0").where(starts).where((F.col("mode") == 1) | ((F.col("mode") == 0) & (F.col("upl") % 8 == 0) & (F.col("upl") >= room * 8)))


def _pushed(stripper: Stripper, frames: pa.Table) -> list[tuple[int, int, bytes]]:
    rows = frames.sort_by([("first_offset", "ascending"), ("place", "ascending")])
    values = zip(*(rows.column(c).to_pylist() for c in ("data", "syncd", "upl", "mode", "null_deleted")))
    return [x for value in values for x in stripper.push(*value)]


def _fields(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _edges(frames: pa.Table) -> pa.Table:
    """What a range's frames leave to others: bytes before their first start, bytes of the packet they leave open, and the packets they hold."""
    stripper = Stripper()
    _pushed(stripper, frames)
    key = [frames.column(c)[0].as_py() for c in (*_KEY, "range")]
    values = [*key, stripper.head, stripper.rest, stripper.size, stripper.deleted, stripper.n]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, _fields(_EDGES))], schema=_fields(_EDGES))


def _cut(frames: pa.Table, carried: pa.Table) -> pa.Table:
    """The packets that begin in a range's frames, numbered from what came before, the last one completed by later ranges."""
    stripper = Stripper(n=carried.column("base")[0].as_py())
    found = _pushed(stripper, frames) + stripper.close(carried.column("after")[0].as_py())
    key = [[frames.column(c)[0].as_py()] * len(found) for c in _KEY]
    columns = [*key, *([x[k] for x in found] for k in range(3))]
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _fields(CUT))], schema=_fields(CUT))


def with_nulls(cut: DataFrame) -> DataFrame:
    """Packets under offsets of their own, the null packets in front of each put back."""
    rows = cut.select(*_KEY, "number", "nulls", "raw", F.explode(F.sequence(F.lit(0), F.col("nulls"))).alias("k"))
    return rows.select(*_KEY, ((F.col("number") + F.col("k")) * 188).alias("byte_offset"), F.when(F.col("k") < F.col("nulls"), F.lit(NULL_PACKET)).otherwise(F.col("raw")).alias("raw"))


def inner_packets(frames: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """The packets of the transport stream in each PLP, with offsets of their own, in the schema of packets.

    A frame tells where its first whole packet begins; what stands before completes the packet that the frame before left open. Frames are put in order in
    ranges of the carrier, so no task holds a PLP: what comes before a range's first start goes to the last range that began a packet, and numbers
    follow from sums over ranges. Frames of the wrong kind (`usable`) are left out; a packet that they tore is none.
    """
    ranged = usable(frames).select(*_KEY, range_of("first_offset", range_bytes).alias("range"), "first_offset", "place", "data", "syncd", "upl", "mode", "null_deleted")
    edges = ranged.groupBy(*_KEY, "range").applyInArrow(_edges, _EDGES)
    along = Window.partitionBy(*_KEY).orderBy("range")
    opened = F.col("size") > 0
    told = edges.withColumn("run", F.sum(opened.cast("int")).over(along)).withColumn("head_of", F.col("run") - opened.cast("int"))
    heads = told.groupBy(*_KEY, F.col("head_of").alias("run")).agg(F.sort_array(F.collect_list(F.struct("range", "head"))).alias("heads"))
    joined = F.aggregate("heads", F.lit(b""), lambda a, x: F.when(F.length(a) < LIMIT, F.concat(a, x["head"])).otherwise(a))
    after = heads.select(*(F.col(c).alias(f"h_{c}") for c in (*_KEY, "run")), joined.alias("joined"))
    met = told.join(after, [opened, *(F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in (*_KEY, "run"))], "left").select(*told.columns, F.coalesce("joined", F.lit(b"")).alias("after"))
    whole = (F.length("tail") > 0) & (F.length("tail") + F.length("after") == F.col("size"))
    more = F.when(whole, F.when(F.col("deleted"), uint(F.concat("tail", "after"), F.col("size") - 1)).otherwise(0) + 1).otherwise(0)
    before = F.coalesce(F.sum(F.col("n") + more).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    carried = met.select(*_KEY, "range", "after", before.alias("base"))
    return with_nulls(ranged.groupBy(*_KEY, "range").cogroup(carried.groupBy(*_KEY, "range")).applyInArrow(_cut, CUT))


def plp_sources(inner: DataFrame) -> DataFrame:
    """Inner packets under a source of their own for each PLP, so that every operator of packets takes them."""
    return inner.select(F.concat_ws("/", "source", "pid", "plp_id").alias("source"), "byte_offset", "raw")
