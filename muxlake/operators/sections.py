"""PSI and SI sections out of packets, by windows and grouping.

The payload of a packet that starts a section falls in two at its pointer: what stands before ends the previous run of packets, the
rest starts a new run. A run takes the packets up to the next start while their continuity holds; its bytes, end to end, are
whole sections and at last stuffing or a torn one. Packets are ordered inside ranges of byte offsets, so no task holds a PID; of each
PID and range only the run that is still open and the packets before the first start go to a second step, which puts them together over the border.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.functions.bits import part, uint
from muxlake.functions.checks import crc32_mpeg2
from muxlake.operators.ranges import range_of, with_previous

MAX_LENGTH = 4093
#: Tables without a CRC.
NO_CRC = (0x70,)
#: Bytes with their bits in reverse.
_FLIP = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))
SECTIONS = "source string, pid int, first_offset bigint, place int, section binary, table_id int, crc32 bigint, crc_ok boolean"


def _empty() -> Column:
    return F.unhex(F.lit(""))


def _jump(before: Column, cc: Column) -> Column:
    """A counter that does not follow the one before it; null if there is none."""
    return F.pmod(cc - before, F.lit(16)) != 1


def _until_cut(parts: Column) -> Column:
    """The data of parts end to end, up to and with the first one that is cut."""
    zero = F.struct(_empty().alias("data"), F.lit(True).alias("open"))
    more = lambda s, x: F.struct(F.concat(s["data"], x["data"]).alias("data"), (~x["cut"]).alias("open"))
    return F.aggregate(parts, zero, lambda s, x: F.when(s["open"], more(s, x)).otherwise(s), lambda s: s["data"])


def runs(packets: DataFrame, skip_pes: bool = True, range_bytes: int | None = None, partitions: int | None = None) -> DataFrame:
    """(source, pid, first_offset, data): the bytes from each start of a unit to where the next one begins or continuity ends.

    packets have source, pid, byte_offset, cc, pusi, payload and discontinuity, and a payload each. skip_pes: payloads that start as PES packets do are no
    sections, and their runs are left out before they are collected. partitions: how many the ranges are dealt to, where Spark's number would be too small.
    """
    rows = packets.select("source", "pid", "byte_offset", "cc", "pusi", "payload", "discontinuity", range_of("byte_offset", range_bytes).alias("range"))
    rows = rows if partitions is None else rows.repartition(partitions, "source", "pid", "range")
    order = Window.partitionBy("source", "pid", "range").orderBy("byte_offset")
    until = lambda k: order.rowsBetween(Window.unboundedPreceding, k)
    pes = (uint(F.col("payload"), 0, 3) == 1) if skip_pes else F.lit(False)
    start = F.when(F.col("pusi"), F.struct(F.col("byte_offset").alias("at"), F.coalesce(pes, F.lit(False)).alias("pes")))
    marked = rows.withColumn("start", start).withColumns({
        "was": F.lag("cc").over(order), "run": F.last("start", ignorenulls=True).over(until(0)), "run_before": F.last("start", ignorenulls=True).over(until(-1)),
        "final": F.max("start.at").over(until(Window.unboundedFollowing)),
    })
    payload, size = F.col("payload"), F.length("payload")
    pointer = uint(payload, 0).cast("int")
    broken = F.col("discontinuity") | F.coalesce(_jump(F.col("was"), F.col("cc")), F.lit(False))
    piece = lambda run, data, cut: F.struct(run["at"].alias("run"), run["pes"].alias("pes"), data.alias("data"), cut.alias("broken"))
    own = F.col("run")
    head = piece(own, F.when(own["pes"], _empty()).otherwise(part(payload, pointer + 1, size)), F.lit(False))
    pieces = F.when(F.col("pusi"), F.array(piece(F.col("run_before"), part(payload, 1, pointer), broken), head)).otherwise(F.array(piece(own, payload, broken)))
    dealt = marked.select("source", "pid", "range", "byte_offset", "cc", "final", F.explode(pieces).alias("p")).select("source", "pid", "range", "byte_offset", "cc", "final", "p.*")
    dealt = dealt.where("run IS NULL OR NOT pes OR run = byte_offset")
    grouped = dealt.groupBy("source", "pid", "range", "run", "final").agg(
        F.sort_array(F.collect_list(F.struct("byte_offset", "broken", "data"))).alias("parts"), F.min_by("cc", "byte_offset").alias("first_cc"),
        F.max_by("cc", "byte_offset").alias("last_cc"), F.max("pes").alias("pes"),
    )
    first_break = F.array_position(F.transform("parts", lambda x: x["broken"]), True)
    good = F.when(first_break > 0, F.slice("parts", F.lit(1), (first_break - 1).cast("int"))).otherwise(F.col("parts"))
    joined = F.aggregate(good, _empty(), lambda a, x: F.concat(a, x["data"]))
    parts = grouped.select("source", "pid", "range", "run", "final", "pes", "first_cc", "last_cc", joined.alias("data"), (first_break > 0).alias("cut"))
    closed = parts.where("run < final AND NOT pes").select("source", "pid", F.col("run").alias("first_offset"), "data")
    # What is left open at the end of a range, and what a range has before its first start.
    open_ = parts.where("run IS NULL OR run = final")
    along = Window.partitionBy("source", "pid").orderBy("range", F.col("run").asc_nulls_first())
    begun = F.last(F.when(F.col("run").isNotNull(), F.struct("run", "pes")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    tied = open_.select("*", begun.alias("begun"), F.lag("last_cc").over(along).alias("was")).where("begun IS NOT NULL AND NOT begun.pes")
    torn = F.col("run").isNull() & F.coalesce(_jump(F.col("was"), F.col("first_cc")), F.lit(True))
    each = F.struct("range", F.when(torn, _empty()).otherwise(F.col("data")).alias("data"), (F.col("cut") | torn).alias("cut"))
    over = tied.groupBy("source", "pid", F.col("begun.run").alias("first_offset")).agg(F.sort_array(F.collect_list(each)).alias("parts"))
    return closed.unionByName(over.select("source", "pid", "first_offset", _until_cut(F.col("parts")).alias("data")))


def crc_matches(unit: bytes) -> bool:
    """Whether the last four bytes are the CRC-32/MPEG-2 of the others: zlib's CRC of flipped bytes, complemented and flipped."""
    return zlib.crc32(unit[:-4].translate(_FLIP)) ^ 0xFFFFFFFF == int.from_bytes(unit[-4:].translate(_FLIP), "little")


def cut_sections(data: bytes) -> Iterator[bytes]:
    """The whole sections at the start of a run's bytes; stuffing, an impossible length or a torn section ends them."""
    at = 0
    while at + 3 <= len(data) and data[at] != 0xFF:
        n = (data[at + 1] & 0x0F) << 8 | data[at + 2]
        if not 0 < n <= MAX_LENGTH or at + 3 + n > len(data):
            return
        yield data[at : at + 3 + n]
        at += 3 + n


def units(found: DataFrame, cut: Callable[[bytes], Iterator[bytes]], schema: str, fields: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """A row for each unit of each run: source, pid, first_offset, place, the unit, and fields of all units of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [list(cut(x)) for x in batch.column("data").to_pylist()]
            parent = pa.array([k for k, own in enumerate(every) for _ in own], pa.int32())
            flat = [x for own in every for x in own]
            place = pa.array([j for own in every for j in range(len(own))], pa.int32())
            kept = [batch.column(c).take(parent) for c in ("source", "pid", "first_offset")]
            columns = [*kept, place, pa.array(flat, pa.binary()), *fields(flat)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return found.mapInArrow(run, schema)


def _section_fields(every: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([x[0] for x in every], pa.int32()),
        pa.array([int.from_bytes(x[-4:], "big") if len(x) >= 4 else None for x in every], pa.int64()),
        pa.array([x[0] in NO_CRC or crc_matches(x) for x in every], pa.bool_()),
    ]


def reassemble(packets: DataFrame, pids: DataFrame | None = None, range_bytes: int | None = None, partitions: int | None = None) -> DataFrame:
    """sections(source, pid, first_offset, place, section, table_id, crc32, crc_ok) of decoded packets.

    Damaged, scrambled and null packets and those without payload are left out. A jump or repetition of the continuity counter drops the
    section at hand, and so does a discontinuity flag; packets before a PID's first start are ignored. pids (source, pid): where the
    sections are, so that the packets of pictures and sound are not even sorted; without it only PES packets are told apart.
    """
    useful = packets.where("NOT tei AND has_payload AND scrambling = 0 AND pid <> 8191 AND payload IS NOT NULL")
    if pids is not None:
        useful = useful.join(pids.select("source", "pid").distinct(), ["source", "pid"], "left_semi")
    return units(runs(useful, range_bytes=range_bytes, partitions=partitions), cut_sections, SECTIONS, _section_fields)


def checked(sections: DataFrame) -> DataFrame:
    """Sections with table_id, crc32 (their last four bytes) and crc_ok, which is true where the table has no CRC."""
    raw = F.col("section")
    table = uint(raw, 0).cast("int")
    stored = uint(raw, F.length("section") - 4, 4)
    body = F.substring("section", F.lit(1), F.length("section") - 4)
    ok = table.isin(*NO_CRC) | F.coalesce(stored == crc32_mpeg2(body), F.lit(False))
    return sections.withColumns({"table_id": table, "crc32": stored, "crc_ok": ok})


def bad_sections(sections: DataFrame) -> DataFrame:
    """An error row for each section whose CRC is wrong or that is too short for its header and CRC."""
    short = F.length("section") < F.when(F.col("table_id").isin(*NO_CRC), 3 + 5).otherwise(3 + 4)
    bad = sections.where(~F.col("crc_ok") | short)
    code = F.when(~F.col("crc_ok"), "CRC_FAILED").otherwise("SECTION_TOO_SHORT")
    return bad.select("source", "pid", F.col("first_offset").alias("byte_offset"), F.lit("ERROR").alias("severity"), code.alias("code"))


# The table ids that belong to a PID's or a kind's sections.
TABLE_IDS = {
    "PAT": (0x00, 0x00), "CAT": (0x01, 0x01), "PMT": (0x02, 0x02), "NIT": (0x40, 0x41), "SDT": (0x42, 0x46), "BAT": (0x4A, 0x4A),
    "EIT": (0x4E, 0x6F), "TDT": (0x70, 0x70), "TOT": (0x73, 0x73), "AIT": (0x74, 0x74), "EWS": (0x93, 0x93), "EEWS": (0x94, 0x95), "SCTE35": (0xFC, 0xFC),
}


def of_kind(sections: DataFrame, kind: str) -> DataFrame:
    """The sound sections of one kind of table."""
    low, high = TABLE_IDS[kind]
    wanted = F.col("table_id").between(low, high)
    if kind == "SDT":
        wanted = F.col("table_id").isin(low, high)
    return sections.where(wanted & F.col("crc_ok"))


def changed(sections: DataFrame) -> DataFrame:
    """Sound sections whose CRC is not that of the sound section before on their PID: what a decoder reports once (tables with one slot)."""
    return with_previous(sections.where("crc_ok"), ["source", "pid"], ["crc32"], "first_offset", ["place"]).where("NOT (before.crc32 <=> crc32)").drop("before")


#: The columns of a decoded table that name its slot, for tables with many on a PID.
SLOTS = {
    "NIT": ["network_id", "section_number", "last_section_number"], "BAT": ["bouquet_id", "section_number", "last_section_number"],
    "SDT": ["original_network_id", "ts_id", "section_number", "last_section_number"], "EIT": ["table_id", "service_id", "section_number", "last_section_number"],
}


def versioned(tables: DataFrame, key: list[str]) -> DataFrame:
    """Tables whose version is not the one that their slot holds: a slot takes every other version, so A, B, A are three.

    For tables with many slots: the key names the slot, besides source and pid. What a slot holds is what it was last sent, since the same version is
    not taken again; a content belongs to one slot, as its bytes name it. A window holds one slot of a PID.
    """
    order = Window.partitionBy("source", "pid", *key).orderBy("first_offset", "place")
    return tables.withColumn("was", F.lag("version").over(order)).where("was IS NULL OR was <> version").drop("was")
