"""Decoders of tables: one projection of a section's bytes each; loops become arrays of structs, and `entries` rows of them.

Bytes that end too early give nulls and shorter arrays, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions import names
from muxlake.functions.bits import be, bits, flag, join, part, uint, walk
from muxlake.functions.checks import crc32_mpeg2
from muxlake.functions.names import name_of
from muxlake.functions.values import bcd_seconds, mjd_seconds
from muxlake.operators.ranges import with_previous
from muxlake.operators.sections import SLOTS, of_kind, versioned

def _s() -> Column:
    return F.col("section")


def _end() -> Column:
    return F.length("section") - 4


def _twelve(at) -> Column:
    return uint(_s(), at, 2).bitwiseAND(0x0FFF).cast("int")


def _header(with_version: bool = True) -> list[Column]:
    out = [F.col(c) for c in ("source", "pid", "first_offset", "place", "table_id", "crc32")] + [_twelve(1).alias("section_length")]
    if with_version:
        out += [bits(_s(), 5, 2, 5).cast("int").alias("version"), flag(_s(), 5, 7).alias("current_next")]
        out += [uint(_s(), 6).cast("int").alias("section_number"), uint(_s(), 7).cast("int").alias("last_section_number")]
    return out


def _loop(start, end, header: int, fields: Callable[[Column], list[Column]]) -> Column:
    """Entries whose last two header bytes are the length of their descriptors."""
    size = lambda pos: header + _twelve(pos + header - 2)
    entry = lambda e: F.struct(*fields(e["pos"]), part(_s(), e["pos"] + header, e["size"] - header).alias("descriptors"))
    return F.transform(walk(_s(), start, end, header, size), entry)


def _id(size: int, at: Column | int, name: str) -> Column:
    return uint(_s(), at, size).cast("int" if size < 4 else "long").alias(name)


def pat(sections: DataFrame) -> DataFrame:
    n = F.floor((F.length("section") - 12) / 4).cast("int")
    record = lambda k: F.struct(_id(2, k * 4 + 8, "program_number"), bits(_s(), k * 4 + 10, 3, 13).cast("int").alias("program_pid"))
    records = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), record))
    return of_kind(sections, "PAT").select(*_header(), _id(2, 3, "ts_id"), F.coalesce(records, F.array()).alias("records"))


def cat(sections: DataFrame) -> DataFrame:
    return of_kind(sections, "CAT").select(*_header(), part(_s(), 8, _end() - 8).alias("descriptors"))


def pmt(sections: DataFrame) -> DataFrame:
    info = _twelve(10)
    es = _loop(info + 12, _end(), 5, lambda p: [_id(1, p, "stream_type"), bits(_s(), p + 1, 3, 13).cast("int").alias("es_pid")])
    return of_kind(sections, "PMT").select(
        *_header(), _id(2, 3, "program_number"), bits(_s(), 8, 3, 13).cast("int").alias("pcr_pid"), part(_s(), 12, info).alias("descriptors"), es.alias("es")
    )


def _network(sections: DataFrame, kind: str, name: str) -> DataFrame:
    size = _twelve(8)
    streams = _loop(size + 12, F.least(_end(), size + 12 + _twelve(size + 10)), 6, lambda p: [_id(2, p, "ts_id"), _id(2, p + 2, "original_network_id")])
    return of_kind(sections, kind).select(*_header(), _id(2, 3, name), part(_s(), 10, size).alias("descriptors"), streams.alias("streams"))


def nit(sections: DataFrame) -> DataFrame:
    return _network(sections, "NIT", "network_id")


def bat(sections: DataFrame) -> DataFrame:
    return _network(sections, "BAT", "bouquet_id")


def sdt(sections: DataFrame) -> DataFrame:
    services = _loop(F.lit(11), _end(), 5, lambda p: [
        _id(2, p, "service_id"), flag(_s(), p + 2, 6).alias("eit_schedule"), flag(_s(), p + 2, 7).alias("eit_present_following"),
        bits(_s(), p + 3, 0, 3).cast("int").alias("running_status"), flag(_s(), p + 3, 3).alias("free_ca")])
    return of_kind(sections, "SDT").select(*_header(), _id(2, 3, "ts_id"), _id(2, 8, "original_network_id"), services.alias("services"))


def eit(sections: DataFrame) -> DataFrame:
    events = _loop(F.lit(14), _end(), 12, lambda p: [
        _id(2, p, "event_id"), mjd_seconds(_s(), p + 2).alias("start_sec"), bcd_seconds(_s(), p + 7).alias("duration_sec"),
        bits(_s(), p + 10, 0, 3).cast("int").alias("running_status"), flag(_s(), p + 10, 3).alias("free_ca")])
    return of_kind(sections, "EIT").select(
        *_header(), _id(2, 3, "service_id"), _id(2, 8, "ts_id"), _id(2, 10, "original_network_id"), _id(1, 12, "segment_last"),
        _id(1, 13, "last_table_id"), events.alias("events"),
    )


def tdt(sections: DataFrame) -> DataFrame:
    return of_kind(sections, "TDT").select(*_header(False), mjd_seconds(_s(), 3).alias("utc_sec"))


def tot(sections: DataFrame) -> DataFrame:
    return of_kind(sections, "TOT").select(*_header(False), mjd_seconds(_s(), 3).alias("utc_sec"), part(_s(), 10, _twelve(8)).alias("descriptors"))


def ait(sections: DataFrame) -> DataFrame:
    common = _twelve(8)
    apps = _loop(common + 12, _end(), 9, lambda p: [_id(4, p, "organisation_id"), _id(2, p + 4, "application_id"), _id(1, p + 6, "control_code")])
    return of_kind(sections, "AIT").select(
        *_header(), flag(_s(), 3, 0).alias("test"), bits(_s(), 3, 1, 15).cast("int").alias("application_type"), part(_s(), 10, common).alias("descriptors"), apps.alias("applications")
    )


def ews(sections: DataFrame) -> DataFrame:
    size = _twelve(8)
    zones = _loop(size + 12, _end(), 5, lambda p: [_id(2, p, "zone_id"), flag(_s(), p + 2, 7).alias("state")])
    return of_kind(sections, "EWS").select(*_header(), _id(2, 3, "region_id"), part(_s(), 10, size).alias("descriptors"), zones.alias("zones"))


def eews(sections: DataFrame) -> DataFrame:
    size = _twelve(8)
    devices = _loop(size + 12, _end(), 5, lambda p: [
        _id(2, p, "device_id"), bits(_s(), p + 2, 0, 2).cast("int").alias("type"), bits(_s(), p + 2, 2, 5).cast("int").alias("id"), flag(_s(), p + 2, 7).alias("state")])
    return of_kind(sections, "EEWS").select(*_header(), _id(2, 3, "group_id"), part(_s(), 10, size).alias("descriptors"), devices.alias("devices"))


def splice(sections: DataFrame) -> DataFrame:
    """SCTE-35 cues: splice_insert, splice_schedule, time_signal, private and empty commands, and the descriptor loop."""
    length, kind, at = _twelve(11), uint(_s(), 13), 14
    encrypted = flag(_s(), 4, 0)
    c = lambda t, x: F.when((kind == t) & ~encrypted, x)
    # splice_insert
    live = (kind == 5) & ~encrypted & ~flag(_s(), at + 4, 0)
    program, timed, immediate = flag(_s(), at + 5, 1), flag(_s(), at + 5, 2), flag(_s(), at + 5, 3)
    given = program & ~immediate & flag(_s(), at + 6, 0)
    n_parts = F.when(~program, uint(_s(), at + 6).cast("int"))
    part_size = lambda pos: F.when(immediate, 1).otherwise(F.when(flag(_s(), pos + 1, 0), 6).otherwise(2))
    parts = F.slice(walk(_s(), at + 7, _end(), 1, part_size), F.lit(1), F.greatest(n_parts, F.lit(0)))
    parts_size = F.aggregate(parts, F.lit(0), lambda a, e: a + e["size"])
    time_size = F.when(program, F.when(immediate, 0).when(given, 5).otherwise(1)).otherwise(parts_size + 1)
    break_at = time_size + at + 6
    rest_at = break_at + F.when(timed, 5).otherwise(0)
    components = F.transform(parts, lambda e: F.struct(_id(1, e["pos"], "component"), F.when(~immediate & flag(_s(), e["pos"] + 1, 0), bits(_s(), e["pos"] + 1, 7, 33)).alias("pts")))
    # time_signal and splice_schedule
    signal = F.when(flag(_s(), at, 0), bits(_s(), at, 7, 33))

    def event_size(pos):
        base = F.when(flag(_s(), pos + 5, 1), 4).otherwise(uint(_s(), pos + 6) * 5 + 1)
        return F.when(flag(_s(), pos + 4, 0), 5).otherwise(6 + base + F.when(flag(_s(), pos + 5, 2), 5).otherwise(0) + 4)

    events = F.slice(walk(_s(), at + 1, _end(), 5, event_size), F.lit(1), F.coalesce(uint(_s(), at).cast("int"), F.lit(0)))

    def event(e):
        p, end = e["pos"], e["pos"] + e["size"]
        told, whole, paused = ~flag(_s(), p + 4, 0), flag(_s(), p + 5, 1), flag(_s(), p + 5, 2)
        pause_at = (end - 9).cast("int")
        n = F.when(told & ~whole, uint(_s(), p + 6).cast("int")).otherwise(0)
        component = lambda k: F.struct(_id(1, p + 7 + k * 5, "component"), uint(_s(), p + 8 + k * 5, 4).alias("utc_splice_time"))
        return F.struct(
            _id(4, p, "event_id"), (~told).alias("cancelled"), F.when(told, flag(_s(), p + 5, 0)).alias("out_of_network"), F.when(told, whole).alias("program"),
            F.when(told & whole, uint(_s(), p + 6, 4)).alias("utc_splice_time"), F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), component)).alias("components"),
            F.when(told & paused, flag(_s(), pause_at, 0)).alias("auto_return"), F.when(told & paused, bits(_s(), pause_at, 7, 33)).alias("break_duration"),
            F.when(told, uint(_s(), end - 4, 2)).cast("int").alias("unique_program_id"), F.when(told, uint(_s(), end - 2)).cast("int").alias("avail"),
            F.when(told, uint(_s(), end - 1)).cast("int").alias("avails_expected"),
        )

    scheduled = F.transform(events, event)
    used = F.when(length != 0x0FFF, length).otherwise(
        F.when(kind == 5, F.when(live, rest_at + 4 - at).otherwise(5)).when(kind == 6, F.when(flag(_s(), at, 0), 5).otherwise(1))
        .when(kind == 4, F.aggregate(events, F.lit(1), lambda a, e: a + e["size"])).otherwise(0)
    )
    loop_at = used + at
    behind = loop_at + 2 + uint(_s(), loop_at, 2)
    private = (kind == 0xFF) & ~encrypted & (length != 0x0FFF)
    return of_kind(sections, "SCTE35").select(
        *_header(False), bits(_s(), 1, 2, 2).cast("int").alias("sap_type"), _id(1, 3, "protocol"), encrypted.alias("encrypted"),
        F.when(encrypted, bits(_s(), 4, 1, 6)).cast("int").alias("encryption_algorithm"), F.when(encrypted, uint(_s(), 9)).cast("int").alias("cw_index"),
        F.when(encrypted, uint(_s(), _end() - 4, 4)).alias("ecrc32"),
        F.when(private, uint(_s(), at, 4)).alias("private_identifier"), F.when(private, part(_s(), at + 4, length - 4)).alias("private_bytes"),
        F.when(~encrypted, part(_s(), behind, F.greatest(_end() - behind, F.lit(0)))).alias("stuffing"), bits(_s(), 4, 7, 33).alias("pts_adjustment"),
        bits(_s(), 10, 0, 12).cast("int").alias("tier"), length.alias("command_length"), kind.cast("int").alias("command_type"),
        c(5, uint(_s(), at, 4)).alias("event_id"), c(5, flag(_s(), at + 4, 0)).alias("cancelled"),
        F.when(live, flag(_s(), at + 5, 0)).alias("out_of_network"), F.when(live, immediate).alias("immediate"),
        F.when(live & given, bits(_s(), at + 6, 7, 33)).when((kind == 6) & ~encrypted, signal).alias("splice_pts"),
        F.when(live & ~program, components).alias("components"),
        F.when(live & timed, flag(_s(), break_at, 0)).alias("auto_return"), F.when(live & timed, bits(_s(), break_at, 7, 33)).alias("break_duration"),
        F.when(live, uint(_s(), rest_at, 2)).cast("int").alias("unique_program_id"), F.when(live, uint(_s(), rest_at + 2)).cast("int").alias("avail"),
        F.when(live, uint(_s(), rest_at + 3)).cast("int").alias("avails_expected"), c(4, scheduled).alias("schedule"),
        F.when(~encrypted, part(_s(), loop_at + 2, uint(_s(), loop_at, 2))).alias("descriptors"),
    )


def mip(packets: DataFrame) -> DataFrame:
    """Megaframe initialisation packets: one in each packet's payload. Its CRC covers the packet's header of four bytes too.

    functions: of each transmitter its functions (tag, data; cell_id and wait_for_enable of tag 4).
    """
    p = F.col("payload")
    n = uint(p, 1)
    loop_at, loop_size = 17, uint(p, 16)
    transmitters = walk(p, loop_at, (loop_size + loop_at).cast("int"), 3, lambda pos: uint(p, pos + 2) + 3)

    def function(f):
        tag, cell = uint(p, f["pos"]).cast("int"), uint(p, f["pos"]) == 4
        return F.struct(
            tag.alias("tag"), part(p, f["pos"] + 2, f["size"] - 2).alias("data"), F.when(cell, uint(p, f["pos"] + 2, 2)).cast("int").alias("cell_id"),
            F.when(cell, flag(p, f["pos"] + 4, 0)).alias("wait_for_enable"),
        )

    own = lambda t: F.transform(walk(p, t["pos"] + 3, t["pos"] + t["size"], 2, lambda pos: uint(p, pos + 1) + 2), function)
    number = lambda c, k: F.shiftleft(F.col(c).cast("int"), k)
    header = join(
        be(0x47, 1), be(number("tei", 15) + number("pusi", 14) + number("priority", 13) + F.col("pid"), 2), be(number("scrambling", 6) + number("afc", 4) + F.col("cc"), 1)
    )
    stored = uint(p, n + 2 - 4, 4)
    return packets.where((F.col("pid") == 0x15) & F.col("payload").isNotNull()).select(
        "source", "byte_offset", uint(p, 0).cast("int").alias("sync_id"), n.cast("int").alias("section_length"), uint(p, 2, 2).cast("int").alias("pointer"),
        flag(p, 4, 0).alias("periodic"), uint(p, 6, 3).alias("sync_timestamp"), uint(p, 9, 3).alias("max_delay"),
        bits(p, 12, 0, 2).cast("int").alias("constellation"), bits(p, 12, 2, 3).cast("int").alias("hierarchy"), bits(p, 12, 5, 3).cast("int").alias("code_rate"),
        bits(p, 13, 0, 2).cast("int").alias("guard_interval"), bits(p, 13, 2, 2).cast("int").alias("transmission_mode"), bits(p, 13, 4, 2).cast("int").alias("bandwidth"),
        flag(p, 13, 6).alias("ts_priority"), bits(p, 13, 7, 2).cast("int").alias("dvbh"),
        F.transform(transmitters, lambda t: F.struct(uint(p, t["pos"], 2).cast("int").alias("tx_id"), own(t).alias("functions"))).alias("transmitters"),
        stored.alias("crc32"), F.coalesce(crc32_mpeg2(join(header, part(p, 0, n - 2))) == stored, F.lit(False)).alias("crc_ok"),
    )


def mip_changes(packets: DataFrame) -> DataFrame:
    """Sound MIPs whose CRC is not that of the one before."""
    return with_previous(mip(packets).where("crc_ok"), ["source"], ["crc32"]).where("NOT (before.crc32 <=> crc32)").drop("before")


def mip_texts(found: DataFrame) -> DataFrame:
    """MIPs with the names of their modulation's codes."""
    text = lambda c, table, other="reserved": name_of(F.col(c), table, other).alias(f"{c}_text")
    dvbh = F.concat_ws(", ", F.when(F.col("dvbh") >= 2, F.lit("time slicing")), F.when(F.col("dvbh") % 2 == 1, F.lit("MPE-FEC"))).alias("dvbh_text")
    priority = F.when(F.col("ts_priority"), F.lit("non-hierarchical or high priority")).otherwise(F.lit("low priority")).alias("ts_priority_text")
    return found.select(
        "*", text("constellation", names.CONSTELLATIONS), text("hierarchy", names.HIERARCHIES), text("code_rate", names.CODE_RATES), text("guard_interval", names.GUARD_INTERVALS),
        text("transmission_mode", names.TRANSMISSION_MODES), text("bandwidth", names.MIP_BANDWIDTHS, "other"), priority, dvbh,
    )


#: Decoder and name of the loop of each kind.
DECODERS: dict[str, tuple[Callable[[DataFrame], DataFrame], str | None]] = {
    "PAT": (pat, "records"), "CAT": (cat, None), "PMT": (pmt, "es"), "NIT": (nit, "streams"), "SDT": (sdt, "services"), "BAT": (bat, "streams"),
    "EIT": (eit, "events"), "TDT": (tdt, None), "TOT": (tot, None), "AIT": (ait, "applications"), "EWS": (ews, "zones"), "EEWS": (eews, "devices"),
    "SCTE35": (splice, None),
}


def decode(sections: DataFrame, kind: str) -> DataFrame:
    return DECODERS[kind][0](sections)


def entries(table: DataFrame, kind: str) -> DataFrame:
    """A row for each entry of a table's loop, with its place; the entry's descriptors come as `entry_descriptors`."""
    loop = DECODERS[kind][1]
    rest = [c for c in table.columns if c != loop]
    rows = table.select(*rest, F.posexplode(loop).alias("position", "e"))
    fields = [f.name for f in table.schema[loop].dataType.elementType.fields]
    return rows.select(*rest, "position", *(F.col(f"e.{f}").alias("entry_descriptors" if f == "descriptors" else f) for f in fields))


def versions(sections: DataFrame, kind: str) -> DataFrame:
    """The decoded tables of a kind with many slots (NIT, BAT, SDT, EIT) that bring their slot another version."""
    return versioned(decode(sections, kind), SLOTS[kind])
