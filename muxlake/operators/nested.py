"""Descriptors whose fields follow each other behind lengths and flags: a reader that walks through a descriptor's data, and a view of each tag.

A view takes the rows of `descriptors.split` that have its tag, and gives them back with the fields; of a loop, a row for each item with its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions.bits import Value, bits, flag, part, sint, uint, walk
from muxlake.functions.names import CAS_PROVIDERS, CAS_SERVICES, UPDATE_TYPES, VBI_SERVICES, name_of
from muxlake.functions.values import dvb_text


class Reader:
    """Reads fields of `data` one behind the other; what its condition leaves out is null and takes no room."""

    def __init__(self, at: Value = 0):
        self.data = F.col("data")
        self.at = at if isinstance(at, Column) else F.lit(at)
        self.out: list[Column] = []

    def _keep(self, name: str, value: Column, has: Column | None) -> Column:
        value = value if has is None else F.when(has, value)
        self.out.append(value.alias(name))
        return value

    def skip(self, size: Value, has: Column | None = None) -> "Reader":
        step = size if isinstance(size, Column) else F.lit(size)
        self.at = (self.at + (step if has is None else F.when(has, step).otherwise(0))).cast("int")
        return self

    def int(self, name: str, size: int, has: Column | None = None, scale: int = 1, kind: str = "long") -> Column:
        value = self._keep(name, (uint(self.data, self.at, size) * scale).cast(kind), has)
        self.skip(size, has)
        return value

    def bits(self, name: str, offset: int, width: int, has: Column | None = None) -> Column:
        """A field of the bytes at hand, which stay."""
        return self._keep(name, bits(self.data, self.at, offset, width).cast("int"), has)

    def flag(self, name: str, offset: int, has: Column | None = None) -> Column:
        return self._keep(name, flag(self.data, self.at, offset), has)

    def bytes(self, name: str, size: Value, has: Column | None = None) -> Column:
        value = self._keep(name, part(self.data, self.at, size), has)
        self.skip(size, has)
        return value

    def counted(self, name: str, has: Column | None = None, text: bool = False) -> Column:
        """Bytes or a text behind a byte with their number."""
        size = uint(self.data, self.at)
        raw = part(self.data, self.at + 1, size)
        value = self._keep(name, dvb_text(raw) if text else raw, has)
        self.skip(size + 1, has)
        return value

    def text(self, name: str, has: Column | None = None) -> Column:
        return self.counted(name, has, True)

    def code(self, name: str, has: Column | None = None) -> Column:
        """Three letters."""
        value = self._keep(name, F.decode(part(self.data, self.at, 3), "ISO-8859-1"), has)
        self.skip(3, has)
        return value

    def rest(self, name: str, has: Column | None = None, text: bool = False) -> Column:
        raw = part(self.data, self.at, F.greatest(F.length(self.data) - self.at, F.lit(0)))
        return self._keep(name, dvb_text(raw) if text else raw, has)

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.select(*rows.columns, *self.out)


class Shape:
    """What a view reads, without rows: the places of its items, None if it has none, and its fields. Views take it in place of rows."""

    columns = ()

    def __init__(self):
        self.spans: Column | None = None
        self.fields: list[Column] = []

    def select(self, *columns: Column | str) -> "Shape":
        self.fields = [c for c in columns if isinstance(c, Column)]
        return self

    def where(self, *_) -> "Shape":
        return self

    def drop(self, *_) -> "Shape":
        return self


def items(rows: DataFrame, start: Value, end: Value, header: int, size: Callable[[Column], Column]) -> DataFrame:
    """A row for each entry of a loop: item, and at, where it begins."""
    spans = walk(F.col("data"), start, end, header, size)
    if isinstance(rows, Shape):
        rows.spans = spans
        return rows
    out = rows.select(*rows.columns, F.posexplode(spans).alias("item", "_e"))
    return out.withColumn("at", F.col("_e.pos")).drop("_e")


def _length() -> Column:
    return F.length("data")


def _byte(at: Value) -> Column:
    return uint(F.col("data"), at)


def _list(at: Column, n: Column, width: int, of: Callable[[Column], Column]) -> Column:
    """An array of n values of so many bytes each."""
    n = F.coalesce(n.cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: of((at + k * width).cast("int")))).otherwise(F.array())


def aac(rows: DataFrame) -> DataFrame:
    """0x7C: what follows the profile is there if the descriptor goes on."""
    r = Reader()
    r.int("profile_and_level", 1)
    more = _length() > 1
    has_type = more & flag(F.col("data"), 1, 0)
    r.flag("aac_type_present", 0, more)
    r.flag("saoc_de", 1, more)
    r.skip(1, more)
    r.int("aac_type", 1, has_type)
    r.rest("additional_info")
    return r.of(rows)


def association_tag(rows: DataFrame) -> DataFrame:
    """0x14: a transaction for use 0, a selector for uses above 1, private data behind."""
    r = Reader()
    r.int("association_tag", 2)
    use = r.int("use", 2)
    size = r.int("selector_length", 1)
    r.int("transaction_id", 4, use == 0)
    r.int("time_out", 4, use == 0)
    r.bytes("selector", size, use > 1)
    r.rest("private_data")
    return r.of(rows)


def avc_timing(rows: DataFrame) -> DataFrame:
    """0x2A: N and K where the clock is not of 90 kHz, and the units of a tick, only with picture and timing information."""
    r = Reader()
    r.flag("hrd_management_valid", 0)
    has = r.flag("picture_and_timing", 7)
    r.skip(1)
    fast = r.flag("flag_90khz", 0, has)
    r.skip(1, has)
    r.int("n", 4, has & ~fast)
    r.int("k", 4, has & ~fast)
    r.int("num_units_in_tick", 4, has)
    for k, name in enumerate(("fixed_frame_rate", "temporal_poc", "picture_to_display_conversion")):
        r.flag(name, k)
    return r.of(rows)


def carousel_identifier(rows: DataFrame) -> DataFrame:
    """0x13: a module's description for the enhanced format, and private data."""
    r = Reader()
    r.int("carousel_id", 4)
    enhanced = r.int("format_id", 1) == 1
    for name, size in (("module_version", 1), ("module_id", 2), ("block_size", 2), ("module_size", 4), ("compression_method", 1), ("original_size", 4), ("time_out", 1)):
        r.int(name, size, enhanced)
    r.counted("object_key", enhanced)
    r.rest("private_data")
    return r.of(rows)


def data_broadcast(rows: DataFrame) -> DataFrame:
    """0x64: id, component, selector, language and text."""
    r = Reader()
    r.int("data_broadcast_id", 2)
    r.int("component_tag", 1)
    r.counted("selector")
    r.code("language")
    r.text("text")
    return r.of(rows)


def image_icon(rows: DataFrame) -> DataFrame:
    """Extension 0x00: the first descriptor of an icon says how it is sent and placed, later ones only go on with its data."""
    r = Reader()
    first = r.bits("descriptor_number", 0, 4) == 0
    r.bits("last_descriptor_number", 4, 4)
    r.skip(1)
    r.bits("icon_id", 5, 3)
    r.skip(1)
    mode = r.bits("transport_mode", 0, 2, first)
    placed = r.flag("positioned", 2, first)
    r.bits("coordinate_system", 3, 3, placed)
    r.bits("horizontal_origin", 8, 12, placed)
    r.bits("vertical_origin", 20, 12, placed)
    r.skip(1, first).skip(3, placed)
    r.text("icon_type", first)
    r.counted("icon_data", ~first | (mode == 0))
    r.text("url", mode == 1)
    return r.of(rows)


def t2_delivery(rows: DataFrame) -> DataFrame:
    """Extension 0x04: PLP, system and, in long descriptors, modulation and cells (cell_id, frequencies, subcells as extension and frequency)."""
    r = Reader()
    r.int("plp_id", 1)
    r.int("t2_system_id", 2)
    more = _length() > 3
    r.bits("siso_miso", 0, 2, more)
    r.bits("bandwidth", 2, 4, more)
    r.bits("guard_interval", 8, 3, more)
    r.bits("transmission_mode", 11, 3, more)
    r.flag("other_frequency", 14, more)
    r.flag("tfs", 15, more)
    data, tfs = F.col("data"), flag(F.col("data"), 4, 7)
    head = lambda p: F.when(tfs, uint(data, p + 2) + 3).otherwise(6).cast("int")
    size = lambda p: head(p) + 1 + uint(data, (p + head(p)).cast("int"))
    spans = F.when(more, walk(data, 5, F.length("data"), 7, size)).otherwise(F.array())
    subcell = lambda p: F.struct(uint(data, p).cast("int").alias("extension"), uint(data, p + 1, 4).alias("frequency"))

    def cell(e: Column) -> Column:
        p = e["pos"]
        sub = (p + head(p)).cast("int")
        frequencies = _list(p + F.when(tfs, 3).otherwise(2), F.when(tfs, F.floor(uint(data, p + 2) / 4)).otherwise(1), 4, lambda q: uint(data, q, 4))
        return F.struct(uint(data, p, 2).cast("int").alias("cell_id"), frequencies.alias("frequencies"), _list(sub + 1, F.floor(uint(data, sub) / 5), 5, subcell).alias("subcells"))

    r.out.append(F.transform(spans, cell).alias("cells"))
    return r.of(rows)


def cells(rows: DataFrame) -> DataFrame:
    """0x6C: the cells of a list with their places in 1/2^15 of a right angle, their extents and subcells."""
    data = F.col("data")
    found = items(rows, 0, _length(), 10, lambda pos: uint(data, pos + 9) + 10)
    at = F.col("at")
    subcell = lambda p: F.struct(
        uint(data, p).cast("int").alias("extension"), sint(data, p + 1, 2).cast("int").alias("latitude"), sint(data, p + 3, 2).cast("int").alias("longitude"),
        bits(data, p + 5, 0, 12).cast("int").alias("extent_latitude"), bits(data, p + 5, 12, 12).cast("int").alias("extent_longitude"),
    )
    return found.select(
        *rows.columns, "item", uint(data, at, 2).cast("int").alias("cell_id"), sint(data, at + 2, 2).cast("int").alias("latitude"), sint(data, at + 4, 2).cast("int").alias("longitude"),
        bits(data, at + 6, 0, 12).cast("int").alias("extent_latitude"), bits(data, at + 6, 12, 12).cast("int").alias("extent_longitude"),
        _list(at + 10, F.floor(uint(data, at + 9) / 8), 8, subcell).alias("subcells"),
    )


def cell_frequencies(rows: DataFrame) -> DataFrame:
    """0x6D: the frequency of each cell in Hz, and its subcells' transposers."""
    data = F.col("data")
    found = items(rows, 0, _length(), 7, lambda pos: uint(data, pos + 6) + 7)
    at = F.col("at")
    subcell = lambda p: F.struct(uint(data, p).cast("int").alias("extension"), (uint(data, p + 1, 4) * 10).alias("frequency"))
    subcells = _list(at + 7, F.floor(uint(data, at + 6) / 5), 5, subcell)
    return found.select(*rows.columns, "item", uint(data, at, 2).cast("int").alias("cell_id"), (uint(data, at + 2, 4) * 10).alias("frequency"), subcells.alias("subcells"))


def vbi_data(rows: DataFrame) -> DataFrame:
    """0x45: a row for each service, with the field parity and offset of its lines."""
    data = F.col("data")
    found = items(rows, 0, _length(), 2, lambda pos: uint(data, pos + 1) + 2)
    service = uint(data, F.col("at")).cast("int")
    line = lambda p: F.struct(flag(data, p, 2).alias("field_parity"), bits(data, p, 3, 5).cast("int").alias("line_offset"))
    lines = F.when(service.isin(1, 2, 4, 5, 6, 7), _list(F.col("at") + 2, uint(data, F.col("at") + 1), 1, line))
    return found.select(*rows.columns, "item", service.alias("data_service_id"), name_of(service, VBI_SERVICES).alias("data_service"), lines.alias("lines"))


def operator_ca(rows: DataFrame) -> DataFrame:
    """0x09 of one operator's systems: provider and service behind the PID; of other systems both are null."""
    r = Reader()
    system = r.int("ca_system_id", 2)
    r.bits("ca_pid", 3, 13)
    r.skip(2)
    own = system.isin(0x2710, 0x4AE0, 0x4AE1)
    r.rest("private_data")
    provider = r.int("provider_id", 1, own & (_length() > 4), kind="int")
    service = r.int("service_id", 1, own & (_length() > 5), kind="int")
    r.out += [F.when(provider.isNotNull(), name_of(provider, CAS_PROVIDERS)).alias("provider"), F.when(service.isNotNull(), name_of(service, CAS_SERVICES)).alias("service")]
    return r.of(rows)


def channel_lists(rows: DataFrame) -> DataFrame:
    """0x87: a row for each list, with its services (service_id, five flags, lcn)."""
    data = F.col("data")
    name_size = lambda p: uint(data, p + 1)
    size = lambda p: (name_size(p) + 6 + uint(data, (p + name_size(p) + 5).cast("int"))).cast("int")
    found = items(rows, 0, _length(), 6, size)
    r = Reader(F.col("at"))
    r.int("list_id", 1, kind="int")
    r.text("list_name")
    r.code("country")
    n = F.floor(uint(data, r.at) / 4)
    flags = ("visible", "for_stb", "for_cam", "for_tv", "flag_4", "flag_5")
    service = lambda p: F.struct(uint(data, p, 2).cast("int").alias("service_id"), *(flag(data, p + 2, k).alias(x) for k, x in enumerate(flags)), bits(data, p + 2, 6, 10).cast("int").alias("lcn"))
    r.out.append(_list(r.at + 1, n, 4, service).alias("services"))
    return r.of(found).drop("at")


def region_names(rows: DataFrame) -> DataFrame:
    """0x88: a row for each language, with the list's name and its translation."""
    data = F.col("data")
    found = items(rows, 0, _length(), 4, lambda p: uint(data, p + 3) + 4)
    r = Reader(F.col("at"))
    r.code("language")
    r.skip(1)
    r.text("list_name")
    r.text("translation")
    return r.of(found).drop("at")


def list_types(rows: DataFrame) -> DataFrame:
    """0xB2: a row for each kind of list, with the receivers it is for."""
    data = F.col("data")
    receivers = lambda p: uint(data, (p + uint(data, p) + 1).cast("int"))
    found = items(rows, 0, _length(), 2, lambda p: (uint(data, p) + receivers(p) + 2).cast("int"))
    r = Reader(F.col("at"))
    r.text("postfix")
    r.out.append(_list(r.at + 1, uint(data, r.at), 1, lambda p: uint(data, p).cast("int")).alias("receiver_ids"))
    return r.of(found).drop("at")


def _updates(r: Reader) -> None:
    r.text("service_version")
    r.flag("service_status", 0)
    kind = r.bits("update_type", 1, 7)
    r.out.append(name_of(kind, UPDATE_TYPES, "incorrect").alias("update"))
    r.skip(1)


def settings_v2(rows: DataFrame) -> DataFrame:
    """0xB0: version, status, kind and time of a receiver's update."""
    r = Reader()
    _updates(r)
    r.int("last_update_sec", 4)
    return r.of(rows)


def settings_v4(rows: DataFrame) -> DataFrame:
    """0xB1: the same with the service that carries it and the receivers it is for."""
    r = Reader()
    _updates(r)
    for name in ("service_id", "original_network_id", "ts_id"):
        r.int(name, 2, kind="int")
    r.int("last_update_sec", 4)
    r.out.append(_list(r.at + 1, _byte(r.at), 1, lambda p: _byte(p).cast("int")).alias("receiver_ids"))
    return r.of(rows)


def time_zones(rows: DataFrame) -> DataFrame:
    """0xB4: a list's name and its time zones' numbers."""
    r = Reader()
    r.text("list_name")
    r.out.append(_list(r.at, F.floor((_length() - r.at) / 2), 2, lambda p: uint(F.col("data"), p, 2).cast("int")).alias("zones"))
    return r.of(rows)


def white_list(rows: DataFrame) -> DataFrame:
    """0xC0: a service and the receivers that may have it."""
    r = Reader()
    r.text("service_name")
    r.out.append(_list(r.at + 1, _byte(r.at), 1, lambda p: _byte(p).cast("int")).alias("receiver_ids"))
    return r.of(rows)


def application(rows: DataFrame) -> DataFrame:
    """AIT 0x00: profiles with versions, visibility, priority and the labels of transport protocols."""
    data = F.col("data")
    profile = lambda p: F.struct(uint(data, p, 2).cast("int").alias("profile"), *(uint(data, p + k).cast("int").alias(n) for k, n in ((2, "major"), (3, "minor"), (4, "micro"))))
    r = Reader(1)
    r.out.append(_list(F.lit(1), F.floor(_byte(0) / 5), 5, profile).alias("profiles"))
    r.skip(_byte(0))
    r.flag("service_bound", 0)
    r.bits("visibility", 1, 2)
    r.skip(1)
    r.int("priority", 1, kind="int")
    r.out.append(_list(r.at, _length() - r.at, 1, lambda p: _byte(p).cast("int")).alias("protocol_labels"))
    return r.of(rows)


def java_parameters(rows: DataFrame) -> DataFrame:
    """AIT 0x03: a row for each parameter."""
    found = items(rows, 0, _length(), 1, lambda p: _byte(p) + 1)
    r = Reader(F.col("at"))
    r.counted("parameter")
    return r.of(found).drop("at")


def java_location(rows: DataFrame) -> DataFrame:
    """AIT 0x04: base directory, extension of the class path and initial class."""
    r = Reader()
    r.text("base_directory")
    r.text("classpath_extension")
    r.rest("initial_class", text=True)
    return r.of(rows)


def splice_audio(rows: DataFrame) -> DataFrame:
    """SCTE-35 0x04: the channels of the audio components."""
    data = F.col("data")
    channel = lambda p: F.struct(
        uint(data, p).cast("int").alias("component_tag"), F.decode(part(data, p + 1, 3), "ISO-8859-1").alias("language"), bits(data, p + 4, 0, 3).cast("int").alias("bit_stream_mode"),
        bits(data, p + 4, 3, 4).cast("int").alias("n_channels"), flag(data, p + 4, 7).alias("full_service"),
    )
    r = Reader()
    r.int("identifier", 4)
    n = r.bits("audio_count", 0, 4)
    r.out.append(_list(F.lit(5), n, 5, channel).alias("channels"))
    return r.of(rows)


def splice_other(rows: DataFrame) -> DataFrame:
    """Any SCTE-35 descriptor: its identifier and private bytes."""
    r = Reader()
    r.int("identifier", 4)
    r.rest("private_bytes")
    return r.of(rows)


#: (family, tag): name and view of the tags that no list of fixed places describes.
VIEWS: dict[tuple[str, int], tuple[str, Callable[[DataFrame], DataFrame]]] = {
    ("dvb", 0x09): ("ca", operator_ca), ("dvb", 0x13): ("carousel_identifier", carousel_identifier), ("dvb", 0x14): ("association_tag", association_tag), ("dvb", 0x2A): ("avc_timing_and_hrd", avc_timing),
    ("dvb", 0x45): ("vbi_data", vbi_data), ("dvb", 0x64): ("data_broadcast", data_broadcast), ("dvb", 0x6C): ("cell_list", cells),
    ("dvb", 0x6D): ("cell_frequency_link", cell_frequencies), ("dvb", 0x7C): ("aac", aac), ("dvb", 0x87): ("logical_channel_v2", channel_lists),
    ("dvb", 0x88): ("multilingual_region_name", region_names), ("dvb", 0xB0): ("settings_v3", settings_v2), ("dvb", 0xB1): ("settings_v4", settings_v4),
    ("dvb", 0xB2): ("channel_list_type", list_types), ("dvb", 0xB4): ("time_zone", time_zones), ("dvb", 0xC0): ("white_list", white_list),
    ("ext", 0x00): ("image_icon", image_icon), ("ext", 0x04): ("t2_delivery", t2_delivery), ("ait", 0x00): ("application", application),
    ("ait", 0x03): ("dvb_j_application", java_parameters), ("ait", 0x04): ("dvb_j_application_location", java_location), ("splice", 0x04): ("audio", splice_audio),
}
