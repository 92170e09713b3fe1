"""Descriptors: a loop's bytes to one row each, and typed views of single tags.

Most tags are lists of bit fields, or loops of such lists with a fixed item size; LAYOUTS states them. Offsets count bits after the length byte
(after the extension's tag for tag 0x7F). A tag without a layout keeps its data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions import names
from muxlake.functions.bits import bits, once, part, uint, walk
from muxlake.functions.names import UPID_TYPES, name_of
from muxlake.functions.values import bcd_minutes, dvb_text, dvb_text_or_utf8, marked_wide_texts, mjd_seconds, unmarked
from muxlake.operators.nested import VIEWS, Shape, items, splice_other


def _data() -> Column:
    return F.col("data")


@dataclass(frozen=True)
class Field:
    """name; first bit; bits; kind: int, flag, bcd, code (letters), mjd, hm (BCD hours and minutes), rest, text or name (to the end; a name may be UTF-8 without a mark)."""

    name: str
    at: int
    width: int = 8
    kind: str = "int"
    scale: int = 1

    def read(self, data: Column, start: Column) -> Column:
        at = start + self.at // 8
        if self.kind == "flag":
            out = bits(data, start, self.at, 1) == 1
        elif self.kind == "bcd":
            digits = F.substring(F.hex(part(data, at, (self.at % 8 + self.width + 7) // 8)), self.at % 8 // 4 + 1, self.width // 4)
            out = F.when(digits.rlike(f"^[0-9]{{{self.width // 4}}}$"), digits.cast("long"))
        elif self.kind == "code":
            out = F.decode(part(data, at, self.width // 8), "ISO-8859-1")
        elif self.kind == "mjd":
            out = mjd_seconds(data, at)
        elif self.kind == "hm":
            out = bcd_minutes(data, at)
        elif self.kind in ("rest", "text", "name"):
            rest = part(data, at, F.greatest(F.length(data) - at, F.lit(0)))
            out = {"rest": lambda x: x, "text": dvb_text, "name": dvb_text_or_utf8}[self.kind](rest)
        else:
            out = bits(data, start, self.at, self.width) * self.scale
        return out.alias(self.name)


def _ints(text: str) -> tuple[Field, ...]:
    """Fields of `name:at:width` words; `name:at!` is a flag."""
    out = []
    for word in text.split():
        name, at, *width = word.split(":")
        out.append(Field(name, int(at[:-1]), 1, "flag") if at.endswith("!") else Field(name, int(at), int(width[0])))
    return tuple(out)


@dataclass(frozen=True)
class Layout:
    """name of the descriptor, its fields, and for loops the bytes of an item."""

    name: str
    fields: tuple[Field, ...]
    item: int = 0


_LANGUAGE = Field("language", 0, 24, "code")
#: (family, tag): layouts. Fixed values of the standards.
LAYOUTS: dict[tuple[str, int], Layout] = {
    ("dvb", 0x02): Layout("video_stream", _ints("multiple_frame_rate:0! frame_rate_code:1:4 mpeg1_only:5! constrained:6! still_picture:7! profile_and_level:8:8 chroma_format:16:2 frame_rate_extension:18!")),
    ("dvb", 0x03): Layout("audio_stream", _ints("free_format:0! id:1! layer:2:2 variable_rate:4!")),
    ("dvb", 0x05): Layout("registration", (*_ints("format_identifier:0:32"), Field("additional_info", 32, 0, "rest"))),
    ("dvb", 0x06): Layout("data_stream_alignment", _ints("alignment_type:0:8")),
    ("dvb", 0x0A): Layout("iso639_language", (_LANGUAGE, *_ints("audio_type:24:8")), 4),
    ("dvb", 0x0C): Layout("multiplex_buffer_utilization", _ints("bound_valid:0! ltw_lower_bound:1:15 ltw_upper_bound:17:15")),
    ("dvb", 0x0E): Layout("maximum_bitrate", _ints("maximum_bitrate:2:22")),
    ("dvb", 0x0F): Layout("private_data_indicator", _ints("private_data_indicator:0:32")),
    ("dvb", 0x11): Layout("std", _ints("leak_valid:7!")),
    ("dvb", 0x28): Layout("avc_video", _ints("profile_idc:0:8 constraint_set0:8! constraint_set1:9! constraint_set2:10! constraint_set3:11! constraint_set4:12! constraint_set5:13! avc_compatible:14:2 level_idc:16:8 still_present:24! picture_24_hour:25! frame_packing_not_present:26!")),
    ("dvb", 0x38): Layout("hevc_video", _ints("profile_space:0:2 tier:2! profile_idc:3:5 profile_compatibility:8:32 progressive:40! interlaced:41! non_packed:42! frame_only:43! copied_44_bits:44:44 level_idc:88:8 temporal_layer_subset:96! still_present:97! picture_24_hour:98! sub_pic_not_present:99! hdr_wcg_idc:102:2 temporal_id_min:104:3 temporal_id_max:112:3")),
    ("dvb", 0x40): Layout("network_name", (Field("network_name", 0, 0, "text"),)),
    ("dvb", 0x41): Layout("service_list", _ints("service_id:0:16 service_type:16:8"), 3),
    ("dvb", 0x43): Layout("satellite_delivery", (Field("frequency", 0, 32, "bcd"), Field("orbital_position", 32, 16, "bcd"), *_ints("west_east:48! polarization:49:2 roll_off:51:2 modulation_system:53! modulation_type:54:2"), Field("symbol_rate", 56, 28, "bcd"), *_ints("fec_inner:84:4"))),
    ("dvb", 0x44): Layout("cable_delivery", (Field("frequency", 0, 32, "bcd"), *_ints("fec_outer:44:4 modulation:48:8"), Field("symbol_rate", 56, 28, "bcd"), *_ints("fec_inner:84:4"))),
    ("dvb", 0x47): Layout("bouquet_name", (Field("bouquet_name", 0, 0, "text"),)),
    ("dvb", 0x4A): Layout("linkage", (*_ints("ts_id:0:16 original_network_id:16:16 service_id:32:16 linkage_type:48:8"), Field("private_data", 56, 0, "rest"))),
    ("dvb", 0x50): Layout("component", (*_ints("stream_content_ext:0:4 stream_content:4:4 component_type:8:8 component_tag:16:8"), Field("language", 24, 24, "code"), Field("text", 48, 0, "text"))),
    ("dvb", 0x52): Layout("stream_identifier", _ints("component_tag:0:8")),
    ("dvb", 0x53): Layout("ca_identifier", _ints("ca_system_id:0:16"), 2),
    ("dvb", 0x54): Layout("content", _ints("nibble1:0:4 nibble2:4:4 user_byte:8:8"), 2),
    ("dvb", 0x55): Layout("parental_rating", (Field("country", 0, 24, "code"), *_ints("rating:24:8")), 4),
    ("dvb", 0x56): Layout("teletext", (_LANGUAGE, *_ints("teletext_type:24:5 magazine:29:3 page:32:8")), 5),
    ("dvb", 0x58): Layout("local_time_offset", (Field("country", 0, 24, "code"), *_ints("region_id:24:6 negative:31!"), Field("offset_min", 32, 16, "hm"), Field("change_sec", 48, 40, "mjd"), Field("next_offset_min", 88, 16, "hm")), 13),
    ("dvb", 0x59): Layout("subtitling", (_LANGUAGE, *_ints("subtitling_type:24:8 composition_page:32:16 ancillary_page:48:16")), 8),
    ("dvb", 0x5A): Layout("terrestrial_delivery", (Field("centre_frequency", 0, 32, "int", 10), *_ints("bandwidth:32:3 priority:35! time_slicing:36! mpe_fec:37! constellation:40:2 hierarchy:42:3 code_rate_hp:45:3 code_rate_lp:48:3 guard_interval:51:2 transmission_mode:53:2 other_frequency:55!"))),
    ("dvb", 0x5F): Layout("private_data_specifier", _ints("private_data_specifier:0:32")),
    ("dvb", 0x60): Layout("service_move", _ints("new_original_network_id:0:16 new_ts_id:16:16 new_service_id:32:16")),
    ("dvb", 0x66): Layout("data_broadcast_id", (*_ints("data_broadcast_id:0:16"), Field("selector", 16, 0, "rest"))),
    ("dvb", 0x6F): Layout("application_signalling", _ints("application_type:1:15 ait_version:19:5"), 3),
    ("dvb", 0x70): Layout("adaptation_field_data", _ints("adaptation_field_data_id:0:8")),
    ("dvb", 0x83): Layout("logical_channel", _ints("service_id:0:16 visible:16! lcn:22:10"), 4),
    ("dvb", 0x86): Layout("gnr", _ints("ts_id:0:16 original_network_id:16:16 service_id:32:16"), 6),
    ("dvb", 0x89): Layout("ews_region", (Field("region_name", 0, 0, "name"),)),
    ("dvb", 0x8A): Layout("cue_identifier", _ints("cue_stream_type:0:8")),
    ("dvb", 0x90): Layout("ews_zone", (Field("zone_name", 0, 0, "name"),)),
    ("ait", 0x02): Layout("transport_protocol", (*_ints("protocol_id:0:16 protocol_label:16:8"), Field("selector", 24, 0, "rest"))),
    ("ait", 0x10): Layout("application_storage", _ints("storage_property:0:8 not_from_broadcast:8! complete_from_cache:9! with_older_version:10! version:17:31 priority:48:8")),
    ("ait", 0x15): Layout("simple_location", (Field("initial_path", 0, 0, "text"),)),
    ("splice", 0x00): Layout("avail", _ints("identifier:0:32 provider_avail_id:32:32")),
    ("splice", 0x01): Layout("dtmf", (*_ints("identifier:0:32 preroll:32:8 dtmf_count:40:3"), Field("dtmf_chars", 48, 0, "text"))),
    ("splice", 0x03): Layout("time", _ints("identifier:0:32 tai_seconds:32:48 tai_ns:80:32 utc_offset:112:16")),
}


#: Tags whose header has a third byte where the second one is LONG_HEADER; the length is in the third.
LONG_TAGS, LONG_HEADER = (0x89, 0x90), 0x15


def header_size(loop: Column, pos: Column, family: str = "dvb") -> Column:
    """Two bytes, or three for the long tags of one operator."""
    if family != "dvb":
        return F.lit(2)
    return F.when(uint(loop, pos).isin(*LONG_TAGS) & (uint(loop, pos + 1) == LONG_HEADER), 3).otherwise(2)


def entry_size(loop: Column, pos: Column, family: str = "dvb") -> Column:
    """The bytes of the descriptor at a place of a loop, header and all."""
    if family != "dvb":
        return uint(loop, pos + 1) + 2
    n = uint(loop, pos, 3)
    long = F.shiftright(n, 16).isin(*LONG_TAGS) & (F.shiftright(n, 8).bitwiseAND(0xFF) == LONG_HEADER)
    return F.when(long, n.bitwiseAND(0xFF) + 3).otherwise(uint(loop, pos + 1) + 2)


def split(df: DataFrame, column: str, family: str = "dvb") -> DataFrame:
    """Every column of df but the loop, and position, family, tag, ext_tag, length, name and data of each of its descriptors."""
    loop, end = F.col(column), F.length(column)
    spans = walk(loop, 0, end, 2, lambda pos: entry_size(loop, pos, family))
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, column, F.posexplode(spans).alias("position", "e"))
    tag, header = uint(loop, F.col("e.pos")).cast("int"), header_size(loop, F.col("e.pos"), family)
    extended = (tag == 0x7F) & F.lit(family == "dvb")
    start = F.col("e.pos") + header + F.when(extended, 1).otherwise(0)
    stop = F.col("e.pos") + F.col("e.size")
    out = rows.select(
        *rest, "position", F.when(extended, "ext").otherwise(family).alias("family"), tag.alias("tag"),
        F.when(extended, uint(loop, F.col("e.pos") + 2)).cast("int").alias("ext_tag"), (F.col("e.size") - header).alias("length"),
        part(loop, start, F.greatest(stop - start, F.lit(0))).alias("data"),
    )
    return out.withColumn("name", name_of_tag())


def name_of_tag() -> Column:
    """The name of a descriptor by its family and tag, null where it is not known."""
    names = {key: layout.name for key, layout in LAYOUTS.items()} | {key: name for key, (name, _) in VIEWS.items()} | _MORE_NAMES
    table = F.create_map(*(F.lit(x) for (family, tag), name in sorted(names.items()) for x in (f"{family} {tag}", name)))
    return F.try_element_at(table, F.concat_ws(" ", "family", F.coalesce("ext_tag", "tag").cast("string")))


def unknown_tags(descriptors: DataFrame) -> DataFrame:
    """A warning for each family and tag that no view knows, with how often it came."""
    found = descriptors.where("name IS NULL").groupBy("family", "tag", "ext_tag").agg(F.count("*").alias("n"))
    return found.select("family", "tag", "ext_tag", F.lit("WARNING").alias("severity"), F.lit("UNKNOWN_DESCRIPTOR").alias("code"), "n")


_MORE_NAMES = {
    ("dvb", 0x48): "service", ("dvb", 0x4D): "short_event", ("dvb", 0x4E): "extended_event", ("dvb", 0x5C): "multilingual_bouquet_name", ("dvb", 0x6A): "ac3",
    ("ait", 0x01): "application_name", ("splice", 0x02): "segmentation",
}


def typed(descriptors: DataFrame, family: str, tag: int) -> DataFrame:
    """The descriptors of one tag with their fields; of a loop, a row for each item with its place."""
    own = descriptors.where((F.col("family") == family) & (F.coalesce("ext_tag", "tag") == tag))
    if (family, tag) in VIEWS:
        return VIEWS[family, tag][1](own)
    if (family, tag) in _FUNCTIONS:
        return _FUNCTIONS[family, tag](own)
    if family == "splice" and (family, tag) not in LAYOUTS:
        return splice_other(own)
    layout = LAYOUTS[family, tag]
    if not layout.item:
        return own.select(*descriptors.columns, *(f.read(_data(), F.lit(0)) for f in layout.fields))
    n = F.floor(F.length("data") / layout.item).cast("int")
    rows = own.select(*descriptors.columns, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("item"))
    return rows.select(*rows.columns, *(f.read(_data(), F.col("item") * layout.item) for f in layout.fields))


def _shape(family: str, tag: int) -> Shape:
    """The items and fields of a tag, read from data, item and at."""
    layout = LAYOUTS.get((family, tag))
    shape = Shape()
    if layout is None or not layout.item:
        return typed(shape, family, tag)
    n = F.floor(F.length("data") / layout.item).cast("int")
    span = lambda k: F.struct((k * layout.item).cast("int").alias("pos"), F.lit(layout.item).alias("size"))
    shape.spans = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), span)
    shape.fields = [f.read(_data(), F.col("at")) for f in layout.fields]
    return shape


def _by_key(branches: list[tuple[int, Column]], other: Column) -> Column:
    key = F.col("_key")
    return reduce(lambda c, b: c.when(key == b[0], b[1]), branches[1:], F.when(key == branches[0][0], branches[0][1])).otherwise(other)


#: What a loop's tags belong to: tables, extensions of tag 0x7F, applications, cues.
FAMILIES = ("dvb", "ext", "ait", "splice")


def decoded(descriptors: DataFrame, families: Sequence[str] = FAMILIES, variant: bool = True) -> DataFrame:
    """All tags in one pass: the rows of `split` with item (null but in loops) and fields, a VARIANT (or JSON) of what `typed` gives for their tag.

    families: those that occur, so that the plan has no others. A loop without items has no row; a tag that no view knows, or of another family, has null fields.
    Columns item, at and those that begin with _ must not be among the rows' own.
    """
    known = {*LAYOUTS, *VIEWS, *_FUNCTIONS}
    keys = sorted((k for k in known if k[0] in families), key=lambda k: (FAMILIES.index(k[0]), k[1]))
    code = lambda family, tag: FAMILIES.index(family) << 8 | tag
    with marked_wide_texts():
        shapes = {code(*key): _shape(*key) for key in keys}
        other = typed(Shape(), "splice", -1)
    family = reduce(lambda c, k: c.when(F.col("family") == FAMILIES[k], k), range(1, len(FAMILIES)), F.when(F.col("family") == FAMILIES[0], 0))
    rows = descriptors.withColumn("_key", F.shiftleft(family, 8).bitwiseOR(F.coalesce("ext_tag", "tag")))
    looped = [(key, shape.spans) for key, shape in shapes.items() if shape.spans is not None]
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.length("data").alias("size")))
    placed = rows.select(*rows.columns, F.posexplode(_by_key(looped, whole) if looped else whole).alias("_item", "_e"))
    placed = placed.select(*rows.columns, F.when(F.col("_key").isin([key for key, _ in looped]), F.col("_item")).alias("item"), F.col("_e.pos").alias("at"))
    json = lambda shape: F.to_json(F.struct(*([F.col("item")] if shape.spans is not None else []), *shape.fields))
    fields = _by_key([(key, json(shape)) for key, shape in shapes.items()], F.when(F.col("family") == "splice", json(other)))
    out = placed.select(*descriptors.columns, "item", fields.alias("_json")).select(*descriptors.columns, "item", unmarked("_json").alias("fields"))
    return out.withColumn("fields", F.parse_json("fields")) if variant else out


def _text(at: Column) -> Column:
    """A text behind its byte of length."""
    return dvb_text(part(_data(), at + 1, uint(_data(), at)))


def services(descriptors: DataFrame) -> DataFrame:
    """0x48: service type, provider and name."""
    own = descriptors.where("family = 'dvb' AND tag = 72")
    name_at = (uint(_data(), 1) + 2).cast("int")
    return own.select(*descriptors.columns, uint(_data(), 0).cast("int").alias("service_type"), _text(F.lit(1)).alias("provider"), _text(name_at).alias("service_name"))


def short_events(descriptors: DataFrame) -> DataFrame:
    """0x4D: language, name and text of an event."""
    own = descriptors.where("family = 'dvb' AND tag = 77")
    text_at = (uint(_data(), 3) + 4).cast("int")
    return own.select(*descriptors.columns, F.decode(part(_data(), 0, 3), "ISO-8859-1").alias("language"), _text(F.lit(3)).alias("event_name"), _text(text_at).alias("text"))


def extended_events(descriptors: DataFrame) -> DataFrame:
    """0x4E: number, language, text, and the items' descriptions and texts as bytes (event_items has them as texts)."""
    own = descriptors.where("family = 'dvb' AND tag = 78")
    size = uint(_data(), 4).cast("int")

    def item_size(pos):
        described = uint(_data(), pos) + 1
        return described + uint(_data(), pos + described.cast("int")) + 1

    raw = lambda pos: part(_data(), pos + 1, uint(_data(), pos))
    items = F.transform(walk(_data(), 5, size + 5, 2, item_size), lambda e: F.struct(raw(e["pos"]).alias("description"), raw((e["pos"] + uint(_data(), e["pos"]) + 1).cast("int")).alias("item")))
    return own.select(
        *descriptors.columns, bits(_data(), 0, 0, 4).cast("int").alias("number"), bits(_data(), 0, 4, 4).cast("int").alias("last_number"),
        F.decode(part(_data(), 1, 3), "ISO-8859-1").alias("language"), items.alias("items"), _text(size + 5).alias("text"),
    )


def event_items(descriptors: DataFrame) -> DataFrame:
    """0x4E: a row for each item, its description and text decoded."""
    found = extended_events(descriptors)
    rows = found.select(*(c for c in found.columns if c != "items"), F.posexplode("items").alias("item", "_i"))
    return rows.withColumns({"description": dvb_text(F.col("_i.description")), "item_text": dvb_text(F.col("_i.item"))}).drop("_i")


def multilingual_names(descriptors: DataFrame, tag: int = 0x5C) -> DataFrame:
    """0x5C and its kin: a row for each language and name."""
    own = descriptors.where((F.col("family") == "dvb") & (F.col("tag") == tag))
    rows = items(own, 0, F.length("data"), 4, lambda pos: uint(_data(), pos + 3) + 4)
    return rows.select(*descriptors.columns, "item", F.decode(part(_data(), F.col("at"), 3), "ISO-8859-1").alias("language"), _text(F.col("at") + 3).alias("text"))


def ac3(descriptors: DataFrame) -> DataFrame:
    """0x6A: four optional bytes, each behind a flag."""
    own = descriptors.where("family = 'dvb' AND tag = 106")
    at, out = F.lit(1), []
    for k, name in enumerate(("component_type", "bsid", "main_id", "asvc")):
        has = bits(_data(), 0, k, 1) == 1
        out.append(F.when(has, uint(_data(), at)).cast("int").alias(name))
        at = at + F.when(has, 1).otherwise(0)
    return own.select(*descriptors.columns, *out, part(_data(), at, F.greatest(F.length("data") - at, F.lit(0))).alias("additional_info"))


def group_key(descriptors: DataFrame) -> DataFrame:
    """Family, tag and extension as one text, the key of a corpus."""
    ext = F.when(F.col("ext_tag").isNotNull(), F.concat(F.lit("_ext"), F.lpad(F.hex("ext_tag"), 2, "0"))).otherwise("")
    return descriptors.withColumn("group", F.concat(F.initcap("family"), F.lit("_"), F.lpad(F.hex("tag"), 2, "0"), ext))


# Types of segments that may have numbers of a sub-segment behind theirs.
SUB_SEGMENTED = (0x34, 0x36, 0x38, 0x3A)
# Types of UPIDs: lists of them, with a format's identifier, letters and digits of an entertainment identifier, numbers, bytes; all others are text.
MID, MPU, EIDR, TI, UPID_BYTES = 0x0D, 0x0C, 0x0A, 0x08, (0x04, 0x05, 0x06, 0x0B)
UUID = 0x10
# What the registrants' numbers of EIDR stand for.
EIDR_KINDS = {5237: "party", 5238: "user", 5239: "service", 5240: "content"}


def segmentations(descriptors: DataFrame) -> DataFrame:
    """SCTE-35 0x02: restrictions, components, duration, UPID, the segment's type and numbers, and a sub-segment's where its type has them; null where it is cancelled."""
    own = descriptors.where("family = 'splice' AND tag = 2")
    live = ~(bits(_data(), 8, 0, 1) == 1)
    program, timed, free = (bits(_data(), 9, k, 1) == 1 for k in range(3))
    n = F.when(live & ~program, uint(_data(), 10)).otherwise(0).cast("int")
    component = lambda k: F.struct(uint(_data(), k * 6 + 11).cast("int").alias("component"), bits(_data(), k * 6 + 12, 7, 33).alias("pts_offset"))
    components = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), component))
    timed_at = F.lit(10) + F.when(program, 0).otherwise(n * 6 + 1)
    rest = once(
        (timed_at + F.when(timed, 5).otherwise(0)).cast("int"),
        lambda at: once((at + 2 + uint(_data(), at + 1)).cast("int"), lambda end: F.struct(
            uint(_data(), at).cast("int").alias("upid_type"), part(_data(), at + 2, uint(_data(), at + 1)).alias("upid"),
            uint(_data(), end).cast("int").alias("type_id"), uint(_data(), end + 1).cast("int").alias("segment"), uint(_data(), end + 2).cast("int").alias("segments"),
            *(F.when(uint(_data(), end).isin(*SUB_SEGMENTED), uint(_data(), end + 3 + k)).cast("int").alias(name) for k, name in enumerate(("sub_segment", "sub_segments"))),
        )),
    )
    allowed = lambda k, w: F.when(live & ~free, bits(_data(), 9, k, w))
    fields = [
        uint(_data(), 0, 4).alias("identifier"), uint(_data(), 4, 4).alias("event_id"), (~live).alias("cancelled"), F.when(live, program).alias("program"),
        F.when(live, timed).alias("has_duration"), F.when(live, free).alias("not_restricted"),
        (allowed(3, 1) == 1).alias("web_allowed"), (allowed(4, 1) == 1).alias("no_regional_blackout"), (allowed(5, 1) == 1).alias("archive_allowed"),
        allowed(6, 2).cast("int").alias("device_restrictions"), components.alias("components"),
        F.when(live & timed, uint(_data(), timed_at.cast("int"), 5)).alias("duration"),
    ]
    if isinstance(own, Shape):
        return own.select(*fields, *(F.when(live, rest)[name].alias(name) for name in ("upid_type", "upid", "type_id", "segment", "segments", "sub_segment", "sub_segments")))
    out = own.select(*descriptors.columns, *fields, F.when(live, rest).alias("r"))
    return out.select(*out.columns[:-1], "r.*")


def _eidr_check(digits: Column) -> Column:
    """The check character of an identifier's hexadecimal digits, by ISO 7064 mod 37, 36."""
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda c: F.instr(F.lit(letters), c).cast("int") - 1
    step = lambda p, c: once((p + value(c)) % 36, lambda s: F.when(s == 0, 36).otherwise(s) * 2 % 37)
    last = F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(36), lambda p, c: step(p, c).cast("int"))
    return F.substring(F.lit(letters), (37 - last) % 36 + 1, F.lit(1))


def _upid(kind: Column, raw: Column) -> Column:
    """A UPID's type, name, format, text and identifier of the format."""
    digits = F.hex(F.substring(raw, 3, 10))
    groups = F.concat_ws("-", *(F.substring(digits, k, 4) for k in (1, 5, 9, 13, 17)))
    eidr = F.when(F.length(raw) == 12, F.concat(F.lit("10."), uint(raw, 0, 2).cast("string"), F.lit("/"), groups, F.lit("-"), _eidr_check(digits)))
    text = F.make_valid_utf8(raw.cast("string"))
    eidr = F.when(F.instr(text, "/") > 1, text).otherwise(eidr)
    high, low = uint(raw, 0, 4), uint(raw, 4, 4)
    number = F.when(F.length(raw) == 8, (high.cast("decimal(20,0)") * (1 << 32) + low).cast("string"))
    h = F.lower(F.hex(raw))
    uuid = F.when(F.length(raw) == 16, F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    base64 = F.base64(F.when(kind == MPU, F.substring(raw, 5, F.length(raw))).otherwise(raw))
    as_bytes = kind.isin(*UPID_BYTES, MPU)
    registrant = F.regexp_extract(eidr, r"^10\.(\d+)/", 1)
    table = F.create_map(*(F.lit(x) for n, name in EIDR_KINDS.items() for x in (str(n), name)))
    return F.struct(
        kind.cast("int").alias("upid_type"), name_of(kind, UPID_TYPES).alias("type_name"), F.when(as_bytes, "base-64").otherwise("text").alias("format"),
        F.when(as_bytes, base64).when(kind == EIDR, eidr).when(kind == TI, number).when(kind == UUID, uuid).otherwise(text).alias("value"),
        F.when(kind == MPU, uint(raw, 0, 4)).alias("format_identifier"), F.when(kind == EIDR, F.try_element_at(table, registrant)).alias("eidr_kind"),
    )


def segmentation_upids(descriptors: DataFrame) -> DataFrame:
    """SCTE-35 0x02: a row for each UPID, those of a list one by one, with event_id and the segment's type."""
    found = segmentations(descriptors).where("upid_type IS NOT NULL")
    raw = F.col("upid")
    spans = walk(raw, 0, F.length(raw), 2, lambda pos: uint(raw, pos + 1) + 2)
    listed = F.transform(spans, lambda e: _upid(uint(raw, e["pos"]), part(raw, e["pos"] + 2, e["size"] - 2)))
    every = F.when(F.col("upid_type") == MID, listed).otherwise(F.array(_upid(F.col("upid_type").cast("long"), raw)))
    rows = found.select(*descriptors.columns, "event_id", "type_id", F.posexplode(every).alias("item", "u"))
    return rows.select(*descriptors.columns, "event_id", "type_id", "item", "u.*")


def cells(descriptors: DataFrame) -> DataFrame:
    return typed(descriptors, "dvb", 0x6C)


def cell_frequencies(descriptors: DataFrame) -> DataFrame:
    return typed(descriptors, "dvb", 0x6D)


#: Columns of delivery_systems: what all systems have, then what only some have.
_DELIVERY = (
    ("system", "string"), ("frequency_mhz", "double"), ("symbol_rate_msym", "double"), ("modulation", "string"), ("fec", "string"), ("fec_outer", "string"), ("polarization", "string"),
    ("orbital_degrees", "double"), ("east", "boolean"), ("roll_off", "string"), ("second_generation", "boolean"), ("bandwidth", "string"), ("hierarchy", "string"), ("fec_low", "string"),
    ("guard_interval", "string"), ("transmission_mode", "string"),
)


def delivery_systems(descriptors: DataFrame) -> DataFrame:
    """0x43, 0x44, 0x5A and T2: a row each, with units and texts; null where a system has no such thing."""
    named = lambda c, table: name_of(F.col(c), table, "reserved")
    mega = lambda c, divisor: F.col(c) / F.lit(float(divisor))
    systems = [
        (("dvb", 0x43), {
            "system": F.lit("satellite"), "frequency_mhz": mega("frequency", 100), "symbol_rate_msym": mega("symbol_rate", 10_000), "modulation": named("modulation_type", names.SATELLITE_MODULATIONS),
            "fec": named("fec_inner", names.INNER_FECS), "polarization": named("polarization", names.POLARIZATIONS), "orbital_degrees": mega("orbital_position", 10), "east": F.col("west_east"),
            "roll_off": F.when(F.col("modulation_system"), named("roll_off", names.ROLL_OFFS)), "second_generation": F.col("modulation_system"),
        }),
        (("dvb", 0x44), {
            "system": F.lit("cable"), "frequency_mhz": mega("frequency", 10_000), "symbol_rate_msym": mega("symbol_rate", 10_000), "modulation": named("modulation", names.CABLE_MODULATIONS),
            "fec": named("fec_inner", names.INNER_FECS), "fec_outer": named("fec_outer", names.OUTER_FECS),
        }),
        (("dvb", 0x5A), {
            "system": F.lit("terrestrial"), "frequency_mhz": mega("centre_frequency", 1_000_000), "modulation": named("constellation", names.CONSTELLATIONS), "fec": named("code_rate_hp", names.CODE_RATES),
            "bandwidth": named("bandwidth", names.BANDWIDTHS), "hierarchy": named("hierarchy", names.HIERARCHIES), "fec_low": named("code_rate_lp", names.CODE_RATES),
            "guard_interval": named("guard_interval", names.GUARD_INTERVALS), "transmission_mode": named("transmission_mode", names.TRANSMISSION_MODES),
        }),
        (("ext", 0x04), {
            "system": F.lit("terrestrial, second generation"), "bandwidth": F.when(F.col("bandwidth").isNotNull(), named("bandwidth", names.T2_BANDWIDTHS)),
            "guard_interval": F.when(F.col("guard_interval").isNotNull(), named("guard_interval", names.T2_GUARDS)),
            "transmission_mode": F.when(F.col("transmission_mode").isNotNull(), named("transmission_mode", names.T2_MODES)), "second_generation": F.lit(True),
        }),
    ]
    own = descriptors.columns
    out = [typed(descriptors, *key).select(*own, *(fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _DELIVERY)) for key, fields in systems]
    return reduce(DataFrame.union, out)


def application_names(descriptors: DataFrame) -> DataFrame:
    """AIT 0x01: a row for each language and name."""
    own = descriptors.where("family = 'ait' AND tag = 1")
    rows = items(own, 0, F.length("data"), 4, lambda pos: uint(_data(), pos + 3) + 4)
    return rows.select(*descriptors.columns, "item", F.decode(part(_data(), F.col("at"), 3), "ISO-8859-1").alias("language"), _text(F.col("at") + 3).alias("application_name"))


_FUNCTIONS = {
    ("dvb", 0x48): services, ("dvb", 0x4D): short_events, ("dvb", 0x4E): extended_events, ("dvb", 0x5C): multilingual_names, ("dvb", 0x6A): ac3,
    ("ait", 0x01): application_names, ("splice", 0x02): segmentations,
}
