"""Queries of every descriptor layout: rows of parts become descriptors, views decode them, and SQL computes the fields from the rows alone.

A template is a descriptor in hexadecimal with places {name:digits} or {name:digits:modulus} for numbers and {name:Tn} for n letters, and its fields
as JSON with <expressions> of these names; of a loop, a line for each item. Numbers and letters follow from p_partkey. Each part makes one descriptor of a group's templates.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions import names
from muxlake.operators import descriptors as desc
from muxlake.operators.ranges import shares
from muxlake.plans.queries import _read, query

#: Factor and offset of the number of each name.
NUMBERS = {"a": (7919, 13), "b": (104_729, 101), "c": (1_299_709, 7), "d": (15_485_863, 3), "e": (31, 5)}
_PLACE = re.compile(r"\{(\w):(T?)(\d+)(?::(\d+))?\}")

#: group: (family, tag, hexadecimal template, fields).
TEMPLATES: dict[str, list[tuple[str, int, str, str]]] = {
    "streams": [
        ("dvb", 0x02, "0203{a:2}{b:2}5F", '{"multiple_frame_rate":<a >= 128>,"frame_rate_code":<a // 8 % 16>,"mpeg1_only":<a // 4 % 2 = 1>,"constrained":<a // 2 % 2 = 1>,"still_picture":<a % 2 = 1>,"profile_and_level":<b>,"chroma_format":1,"frame_rate_extension":false}'),
        ("dvb", 0x03, "0301{a:2}", '{"free_format":<a >= 128>,"id":<a // 64 % 2 = 1>,"layer":<a // 16 % 4>,"variable_rate":<a // 8 % 2 = 1>}'),
        ("dvb", 0x05, "0506{a:8}AABB", '{"format_identifier":<a>,"additional_info":"qrs="}'),
        ("dvb", 0x06, "0601{a:2}", '{"alignment_type":<a>}'),
        ("dvb", 0x09, "0906{a:4:9999}{b:4}CAFE", '{"ca_system_id":<a>,"ca_pid":<b % 8192>,"private_data":"yv4="}'),
        ("dvb", 0x0A, "0A08{t:T3}{a:2}727573{b:2}", '{"item":0,"language":"<t>","audio_type":<a>}\n{"item":1,"language":"rus","audio_type":<b>}'),
        ("dvb", 0x0C, "0C04{a:4}{b:4}", '{"bound_valid":<a >= 32768>,"ltw_lower_bound":<a % 32768>,"ltw_upper_bound":<b % 32768>}'),
        ("dvb", 0x0E, "0E03{a:6}", '{"maximum_bitrate":<a % 4194304>}'),
        ("dvb", 0x0F, "0F04{a:8}", '{"private_data_indicator":<a>}'),
        ("dvb", 0x11, "1101{a:2}", '{"leak_valid":<a % 2 = 1>}'),
        ("dvb", 0x28, "2804{a:2}{b:2}{c:2}3F", '{"profile_idc":<a>,"constraint_set0":<b >= 128>,"constraint_set1":<b // 64 % 2 = 1>,"constraint_set2":<b // 32 % 2 = 1>,"constraint_set3":<b // 16 % 2 = 1>,"constraint_set4":<b // 8 % 2 = 1>,"constraint_set5":<b // 4 % 2 = 1>,"avc_compatible":<b % 4>,"level_idc":<c>,"still_present":false,"picture_24_hour":false,"frame_packing_not_present":true}'),
        ("dvb", 0x38, "380D{a:2}{b:8}900000000000{c:2}5E", '{"profile_space":<a // 64>,"tier":<a // 32 % 2 = 1>,"profile_idc":<a % 32>,"profile_compatibility":<b>,"progressive":true,"interlaced":false,"non_packed":false,"frame_only":true,"copied_44_bits":0,"level_idc":<c>,"temporal_layer_subset":false,"still_present":true,"picture_24_hour":false,"sub_pic_not_present":true,"hdr_wcg_idc":2}'),
        ("dvb", 0x70, "7001{a:2}", '{"adaptation_field_data_id":<a>}'),
        ("dvb", 0x8A, "8A01{a:2}", '{"cue_stream_type":<a>}'),
    ],
    "networks": [
        ("dvb", 0x40, "4006{t:T6}", '{"network_name":"<t>"}'),
        ("dvb", 0x41, "4106{a:4}01{b:4}{c:2}", '{"item":0,"service_id":<a>,"service_type":1}\n{"item":1,"service_id":<b>,"service_type":<c>}'),
        ("dvb", 0x43, "430B011725000192{a:2}02750003", '{"frequency":1172500,"orbital_position":192,"west_east":<a >= 128>,"polarization":<a // 32 % 4>,"roll_off":<a // 8 % 4>,"modulation_system":<a // 4 % 2 = 1>,"modulation_type":<a % 4>,"symbol_rate":275000,"fec_inner":3}'),
        ("dvb", 0x44, "440B03460000FF{a:2}{b:2}0068750F", '{"frequency":3460000,"fec_outer":<a % 16>,"modulation":<b>,"symbol_rate":68750,"fec_inner":15}'),
        ("dvb", 0x47, "4704{t:T4}", '{"bouquet_name":"<t>"}'),
        ("dvb", 0x4A, "4A09{a:4}{b:4}{c:4}{d:2}AABB", '{"ts_id":<a>,"original_network_id":<b>,"service_id":<c>,"linkage_type":<d>,"private_data":"qrs="}'),
        ("dvb", 0x5A, "5A0B02FAF080{a:2}{b:2}{c:2}FFFFFFFF", '{"centre_frequency":500000000,"bandwidth":<a // 32>,"priority":<a // 16 % 2 = 1>,"time_slicing":<a // 8 % 2 = 1>,"mpe_fec":<a // 4 % 2 = 1>,"constellation":<b // 64>,"hierarchy":<b // 8 % 8>,"code_rate_hp":<b % 8>,"code_rate_lp":<c // 32>,"guard_interval":<c // 8 % 4>,"transmission_mode":<c // 2 % 4>,"other_frequency":<c % 2 = 1>}'),
        ("dvb", 0x5C, "5C07{t:T3}03{u:T3}", '{"item":0,"language":"<t>","text":"<u>"}'),
        ("dvb", 0x5F, "5F04{a:8}", '{"private_data_specifier":<a>}'),
        ("dvb", 0x6C, "6C12{a:4}FFFE{b:4:32768}12345608{c:2}00010002ABCDEF", '{"item":0,"cell_id":<a>,"latitude":-2,"longitude":<b>,"extent_latitude":291,"extent_longitude":1110,"subcells":[{"extension":<c>,"latitude":1,"longitude":2,"extent_latitude":2748,"extent_longitude":3567}]}'),
        ("dvb", 0x6D, "6D0C{a:4}{b:8}05{c:2}0000000A", '{"item":0,"cell_id":<a>,"frequency":<b * 10>,"subcells":[{"extension":<c>,"frequency":100}]}'),
        ("dvb", 0x83, "8308{a:4}FC05{b:4}7C06", '{"item":0,"service_id":<a>,"visible":true,"lcn":5}\n{"item":1,"service_id":<b>,"visible":false,"lcn":6}'),
        ("ext", 0x04, "7F0404{a:2}{b:4}", '{"plp_id":<a>,"t2_system_id":<b>,"cells":[]}'),
    ],
    "services": [
        ("dvb", 0x48, "480B{a:2}04{t:T4}04{u:T4}", '{"service_type":<a>,"provider":"<t>","service_name":"<u>"}'),
        ("dvb", 0x4D, "4D0B656E6704{t:T4}02{u:T2}", '{"language":"eng","event_name":"<t>","text":"<u>"}'),
        ("dvb", 0x4E, "4E0D{a:2}656E670602484902796F01{t:T1}", '{"number":<a // 16>,"last_number":<a % 16>,"language":"eng","items":[{"description":"SEk=","item":"eW8="}],"text":"<t>"}'),
        ("dvb", 0x50, "5009{a:2}{b:2}{c:2}656E67{t:T3}", '{"stream_content_ext":<a // 16>,"stream_content":<a % 16>,"component_type":<b>,"component_tag":<c>,"language":"eng","text":"<t>"}'),
        ("dvb", 0x52, "5201{a:2}", '{"component_tag":<a>}'),
        ("dvb", 0x53, "5304{a:4}{b:4}", '{"item":0,"ca_system_id":<a>}\n{"item":1,"ca_system_id":<b>}'),
        ("dvb", 0x54, "5404{a:2}FF{b:2}07", '{"item":0,"nibble1":<a // 16>,"nibble2":<a % 16>,"user_byte":255}\n{"item":1,"nibble1":<b // 16>,"nibble2":<b % 16>,"user_byte":7}'),
        ("dvb", 0x55, "5504{t:T3}{a:2}", '{"item":0,"country":"<t>","rating":<a>}'),
        ("dvb", 0x56, "5605{t:T3}{a:2}{b:2}", '{"item":0,"language":"<t>","teletext_type":<a // 8>,"magazine":<a % 8>,"page":<b>}'),
        ("dvb", 0x58, "580D{t:T3}{a:2}03009E8B0102030400", '{"item":0,"country":"<t>","region_id":<a // 4>,"negative":<a % 2 = 1>,"offset_min":180,"change_sec":3723,"next_offset_min":240}'),
        ("dvb", 0x59, "5908656E67{a:2}{b:4}{c:4}", '{"item":0,"language":"eng","subtitling_type":<a>,"composition_page":<b>,"ancillary_page":<c>}'),
        ("dvb", 0x60, "6006{a:4}{b:4}{c:4}", '{"new_original_network_id":<a>,"new_ts_id":<b>,"new_service_id":<c>}'),
        ("dvb", 0x64, "640C{a:4}{b:2}020102656E6702{t:T2}", '{"data_broadcast_id":<a>,"component_tag":<b>,"selector":"AQI=","language":"eng","text":"<t>"}'),
        ("dvb", 0x66, "6604{a:4}AABB", '{"data_broadcast_id":<a>,"selector":"qrs="}'),
        ("dvb", 0x6A, "6A04A0{a:2}{b:2}09", '{"component_type":<a>,"main_id":<b>,"additional_info":"CQ=="}'),
        ("dvb", 0x7C, "7C04{a:2}C0{b:2}AA", '{"profile_and_level":<a>,"aac_type_present":true,"saoc_de":true,"aac_type":<b>,"additional_info":"qg=="}'),
        ("dvb", 0x6F, "6F03{a:4}{b:2}", '{"item":0,"application_type":<a % 32768>,"ait_version":<b % 32>}'),
    ],
    "carousels": [
        ("dvb", 0x13, "1305{a:8}00", '{"carousel_id":<a>,"format_id":0,"private_data":""}'),
        ("dvb", 0x13, "1317{a:8}01{b:2}{c:4}0100{d:8}05{e:8}0702AABB", '{"carousel_id":<a>,"format_id":1,"module_version":<b>,"module_id":<c>,"block_size":256,"module_size":<d>,"compression_method":5,"original_size":<e>,"time_out":7,"object_key":"qrs=","private_data":""}'),
        ("dvb", 0x14, "140F{a:4}000008{b:8}{c:8}EE01", '{"association_tag":<a>,"use":0,"selector_length":8,"transaction_id":<b>,"time_out":<c>,"private_data":"7gE="}'),
        ("dvb", 0x14, "1407{a:4}00020201FF", '{"association_tag":<a>,"use":2,"selector_length":2,"selector":"Af8=","private_data":""}'),
        ("dvb", 0x2A, "2A0F8100{a:8}{b:8}{c:8}A0", '{"hrd_management_valid":true,"picture_and_timing":true,"flag_90khz":false,"n":<a>,"k":<b>,"num_units_in_tick":<c>,"fixed_frame_rate":true,"temporal_poc":false,"picture_to_display_conversion":true}'),
        ("dvb", 0x2A, "2A020040", '{"hrd_management_valid":false,"picture_and_timing":false,"fixed_frame_rate":false,"temporal_poc":true,"picture_to_display_conversion":false}'),
        ("dvb", 0x45, "45050103{a:2}0805", '{"item":0,"data_service_id":1,"data_service":"EBU teletext","lines":[{"field_parity":<a // 32 % 2 = 1>,"line_offset":<a % 32>},{"field_parity":false,"line_offset":8},{"field_parity":false,"line_offset":5}]}'),
        ("ext", 0x00, "7F06001{a:1}0702AABB", '{"descriptor_number":1,"last_descriptor_number":<a>,"icon_id":7,"icon_data":"qrs="}'),
    ],
    "operators": [
        ("dvb", 0x86, "8606{a:4}{b:4}{c:4}", '{"item":0,"ts_id":<a>,"original_network_id":<b>,"service_id":<c>}'),
        ("dvb", 0x87, "870C{a:2}02{t:T2}52555304{b:4}{c:4}", '{"item":0,"list_id":<a>,"list_name":"<t>","country":"RUS","services":[{"service_id":<b>,"visible":<c >= 32768>,"for_stb":<c // 16384 % 2 = 1>,"for_cam":<c // 8192 % 2 = 1>,"for_tv":<c // 4096 % 2 = 1>,"flag_4":<c // 2048 % 2 = 1>,"flag_5":<c // 1024 % 2 = 1>,"lcn":<c % 1024>}]}'),
        ("dvb", 0x88, "880C7275730803{t:T3}03{u:T3}", '{"item":0,"language":"rus","list_name":"<t>","translation":"<u>"}'),
        ("dvb", 0x89, "891504{t:T4}", '{"region_name":"<t>"}'),
        ("dvb", 0x89, "89150AD09ED180D191D0BB{t:T2}", '{"region_name":"Орёл<t>"}'),
        ("dvb", 0x90, "901503{t:T3}", '{"zone_name":"<t>"}'),
        ("dvb", 0x90, "9008D097D0BED0BD{t:T2}", '{"zone_name":"Зон<t>"}'),
        ("dvb", 0xB0, "B00802{t:T2}82{a:8}", '{"service_version":"<t>","service_status":true,"update_type":2,"update":"forced update in normal mode","last_update_sec":<a>}'),
        ("dvb", 0xB1, "B11001{t:T1}03{a:4}{b:4}{c:4}{e:8}02{d:2}64", '{"service_version":"<t>","service_status":false,"update_type":3,"update":"voluntary update in normal mode","service_id":<a>,"original_network_id":<b>,"ts_id":<c>,"last_update_sec":<e>,"receiver_ids":[<d>,100]}'),
        ("dvb", 0xB2, "B20501{t:T1}02{a:2}02", '{"item":0,"postfix":"<t>","receiver_ids":[<a>,2]}'),
        ("dvb", 0xB4, "B40601{t:T1}{a:4}{b:4}", '{"list_name":"<t>","zones":[<a>,<b>]}'),
        ("dvb", 0xC0, "C00501{t:T1}02{a:2}6E", '{"service_name":"<t>","receiver_ids":[<a>,110]}'),
        ("dvb", 0x09, "09064AE0{a:4}0210", '{"ca_system_id":19168,"ca_pid":<a % 8192>,"private_data":"AhA=","provider_id":2,"service_id":16,"provider":"CAS 3.0","service":"Info cas new"}'),
    ],
    "applications": [
        ("ait", 0x00, "000A05{a:4}{b:2}{c:2}{d:2}9F{e:2}090A", '{"profiles":[{"profile":<a>,"major":<b>,"minor":<c>,"micro":<d>}],"service_bound":true,"visibility":0,"priority":<e>,"protocol_labels":[9,10]}'),
        ("ait", 0x01, "0107{t:T3}03{u:T3}", '{"item":0,"language":"<t>","application_name":"<u>"}'),
        ("ait", 0x02, "0205{a:4}{b:2}AABB", '{"protocol_id":<a>,"protocol_label":<b>,"selector":"qrs="}'),
        ("ait", 0x03, "0303026162", '{"item":0,"parameter":"YWI="}'),
        ("ait", 0x04, "040802{t:T2}02{u:T2}4D61", '{"base_directory":"<t>","classpath_extension":"<u>","initial_class":"Ma"}'),
        ("ait", 0x10, "1007{a:2}A0{c:8}{d:2}", '{"storage_property":<a>,"not_from_broadcast":true,"complete_from_cache":false,"with_older_version":true,"version":<c % 2147483648>,"priority":<d>}'),
        ("ait", 0x15, "1504{t:T4}", '{"initial_path":"<t>"}'),
    ],
    "cues": [
        ("splice", 0x00, "000843554549{a:8}", '{"identifier":1129661769,"provider_avail_id":<a>}'),
        ("splice", 0x01, "010843554549{a:2}5F3132", '{"identifier":1129661769,"preroll":<a>,"dtmf_count":2,"dtmf_chars":"12"}'),
        ("splice", 0x02, "021743554549{a:8}7FFF{b:10}090341424334{c:2}{d:2}", '{"identifier":1129661769,"event_id":<a>,"cancelled":false,"program":true,"has_duration":true,"not_restricted":true,"duration":<b>,"upid_type":9,"upid":"QUJD","type_id":52,"segment":<c>,"segments":<d>}'),
        ("splice", 0x02, "021143554549{a:8}7FBF090036{b:2}{c:2}{d:2}{e:2}", '{"identifier":1129661769,"event_id":<a>,"cancelled":false,"program":true,"has_duration":false,"not_restricted":true,"upid_type":9,"upid":"","type_id":54,"segment":<b>,"segments":<c>,"sub_segment":<d>,"sub_segments":<e>}'),
        ("splice", 0x03, "031043554549{a:12}{b:8}{c:4}", '{"identifier":1129661769,"tai_seconds":<a>,"tai_ns":<b>,"utc_offset":<c>}'),
        ("splice", 0x04, "040A435545491F{a:2}{t:T3}53", '{"identifier":1129661769,"audio_count":1,"channels":[{"component_tag":<a>,"language":"<t>","bit_stream_mode":2,"n_channels":9,"full_service":true}]}'),
        ("splice", 0x05, "0506435545490102", '{"identifier":1129661769,"private_bytes":"AQI="}'),
    ],
}


def _modulus(digits: int, given: str | None) -> int:
    return int(given) if given else 16**digits


def _letters(name: str, n: int, sql: bool):
    """Capital letters that follow from the key: in SQL, or as a Column."""
    shift = ord(name)
    if sql:
        return " || ".join(f"chr(CAST(65 + (p_partkey // {26 ** k} + {shift + k}) % 26 AS INTEGER))" for k in range(n))
    letter = lambda k: F.chr(F.lit(65) + (F.floor(F.col("p_partkey") / 26**k) + shift + k) % 26)
    return F.concat(*(letter(k) for k in range(n)))


def made(template: str) -> Column:
    """The descriptor of a part."""
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        name, kind, n, given = m.groups()
        if kind:
            parts.append(F.hex(_letters(name, int(n), False)))
        else:
            factor, offset = NUMBERS[name]
            parts.append(F.lpad(F.hex((F.col("p_partkey") * factor + offset) % _modulus(int(n), given)), int(n), "0"))
        at = m.end()
    return F.unhex(F.concat(*parts, F.lit(template[at:])))


def expected(template: str, fields: str) -> str:
    """SQL of the fields of a part's descriptor."""
    names = {}
    for m in _PLACE.finditer(template):
        name, kind, n, given = m.groups()
        if kind:
            names[name] = f"({_letters(name, int(n), True)})"
        else:
            factor, offset = NUMBERS[name]
            names[name] = f"((p_partkey * {factor} + {offset}) % {_modulus(int(n), given)})"
    pieces = re.split(r"<([^<>]*(?:>=)?[^<>]*)>(?=[,\]}\"])", fields)
    out = []
    for k, piece in enumerate(pieces):
        if k % 2:
            out.append("CAST(" + re.sub(r"\b([a-etu])\b", lambda m: names[m.group(1)], piece) + " AS VARCHAR)")
        else:
            out.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(out)


def _sql(group: str) -> str:
    every = TEMPLATES[group]
    rows = []
    for k, (family, tag, template, fields) in enumerate(every):
        rows += [f"SELECT p_partkey, '{family} {tag}' AS key, {expected(template, line)} AS fields FROM part WHERE p_partkey % {len(every)} = {k}" for line in fields.split("\n")]
    return " UNION ALL ".join(rows)


def _parts(spark, sf_dir) -> DataFrame:
    """Keys of parts, dealt out before their descriptors are made: a file of few pieces would leave all work to as many tasks."""
    parts = _read(spark, sf_dir, "part").select("p_partkey")
    return parts.repartition(shares(parts), "p_partkey")


def _register(group: str) -> None:
    every = TEMPLATES[group]

    def decoded(spark, sf_dir) -> DataFrame:
        parts = _parts(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % len(every)).alias("k"))
        out = []
        for source, families in (("dvb", ("dvb", "ext")), ("ait", ("ait",)), ("splice", ("splice",))):
            own = [(k, t) for k, t in enumerate(every) if t[0] in families]
            if not own:
                continue
            loop = reduce(lambda c, x: c.when(F.col("k") == x[0], made(x[1][2])), own[1:], F.when(F.col("k") == own[0][0], made(own[0][1][2])))
            rows = desc.split(parts.select("p_partkey", loop.alias("loop")).where("loop IS NOT NULL"), "loop", source)
            for family, tag in dict.fromkeys(t[:2] for _, t in own):
                view = desc.typed(rows, family, tag)
                fields = F.to_json(F.struct(*(c for c in view.columns if c not in rows.columns)))
                out.append(view.select("p_partkey", F.lit(f"{family} {tag}").alias("key"), fields.alias("fields")))
        return reduce(DataFrame.union, out)

    decoded.__name__ = f"descriptors_{group}"
    decoded.__doc__ = f"Descriptors of parts, layouts of the group {group}: their fields as JSON."
    query(_sql(group))(decoded)


for _group in TEMPLATES:
    _register(_group)


def _whole_loops(spark, sf_dir) -> DataFrame:
    """One loop a part and family: of each group the part's descriptor, one behind the other; every tag in one pass."""
    parts, out = _parts(spark, sf_dir), []
    for source, families in (("dvb", ("dvb", "ext")), ("ait", ("ait",)), ("splice", ("splice",))):
        loops = []
        for every in TEMPLATES.values():
            own = [(k, t[2]) for k, t in enumerate(every) if t[0] in families]
            if own:
                k = F.col("p_partkey") % len(every)
                loops.append(F.coalesce(reduce(lambda c, x: c.when(k == x[0], made(x[1])), own[1:], F.when(k == own[0][0], made(own[0][1]))), F.lit(b"")))  # noqa: B023
        rows = desc.split(parts.select("p_partkey", F.concat(*loops).alias("loop")), "loop", source)
        key = F.concat_ws(" ", "family", F.coalesce("ext_tag", "tag").cast("string"))
        out.append(desc.decoded(rows, families, variant=False).select("p_partkey", key.alias("key"), "fields"))
    return reduce(DataFrame.union, out)


_whole_loops.__name__ = "descriptors_in_one_pass"
query(" UNION ALL ".join(_sql(group) for group in TEMPLATES))(_whole_loops)


_UPIDS = "022743554549{a:8}7FBF0D180904{t:T4}0808{b:16:4294967296}0C0641424344010234{c:2}{d:2}"
_UPID_VALUES = {name: expected(_UPIDS, f"<{name}>,").removesuffix(" || ','").removeprefix("'' || ") for name in "abt"}


@query(f"""WITH v AS (SELECT p_partkey, CAST({_UPID_VALUES["a"]} AS BIGINT) AS event_id, {_UPID_VALUES["b"]} AS number, {_UPID_VALUES["t"]} AS letters FROM part)
SELECT p_partkey, event_id, 0 AS item, 9 AS upid_type, 'ADI' AS type_name, 'text' AS format, letters AS value, CAST(NULL AS BIGINT) AS format_identifier FROM v
UNION ALL SELECT p_partkey, event_id, 1, 8, 'TI', 'text', number, NULL FROM v UNION ALL SELECT p_partkey, event_id, 2, 12, 'MPU', 'base-64', 'AQI=', 1094861636 FROM v""")
def upids(spark, sf_dir):
    """The UPIDs of a list, of three kinds."""
    parts = _parts(spark, sf_dir).select("p_partkey", made(_UPIDS).alias("loop"))
    found = desc.segmentation_upids(desc.split(parts, "loop", "splice"))
    return found.select("p_partkey", "event_id", "item", "upid_type", "type_name", "format", "value", "format_identifier")


def _names_sql(code: str, table: dict[int, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{text}'" for k, text in table.items()) + " ELSE 'reserved' END"


@query(f"""WITH s AS (SELECT s_suppkey AS k, CAST(10000 + s_suppkey % 3000 AS BIGINT) AS mhz, s_suppkey % 256 AS a, s_suppkey % 11 AS f, 10000 + s_suppkey % 50000 AS rate FROM supplier)
SELECT k, 'satellite' AS system, CAST(mhz AS DOUBLE) AS frequency_mhz, rate / 10000.0::DOUBLE AS symbol_rate_msym, {_names_sql("a % 4", names.SATELLITE_MODULATIONS)} AS modulation, {_names_sql("f", names.INNER_FECS)} AS fec,
  {_names_sql("a // 32 % 4", names.POLARIZATIONS)} AS polarization, 19.2::DOUBLE AS orbital_degrees, a >= 128 AS east, CASE WHEN a // 4 % 2 = 1 THEN {_names_sql("a // 8 % 4", names.ROLL_OFFS)} END AS roll_off, NULL AS bandwidth FROM s WHERE k % 3 = 0
UNION ALL SELECT k, 'cable', CAST(mhz AS DOUBLE) / 100, rate / 10000.0::DOUBLE, {_names_sql("a % 8", names.CABLE_MODULATIONS)}, {_names_sql("f", names.INNER_FECS)}, NULL, NULL, NULL, NULL, NULL FROM s WHERE k % 3 = 1
UNION ALL SELECT k, 'terrestrial', CAST(mhz AS DOUBLE) / 100, NULL, {_names_sql("a // 64", names.CONSTELLATIONS)}, {_names_sql("a % 8", names.CODE_RATES)}, NULL, NULL, NULL, NULL, {_names_sql("a // 32", names.BANDWIDTHS)} FROM s WHERE k % 3 = 2""")
def delivery_systems(spark, sf_dir):
    """Satellite, cable and terrestrial systems with units and texts."""
    key = F.col("s_suppkey")
    mhz, a, f, rate = (key % 3000 + 10_000), key % 256, key % 11, (key % 50_000 + 10_000).cast("string")
    digits = lambda x, n: F.lpad(x.cast("string"), n, "0")
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    satellite = F.concat(F.lit("430B"), digits(mhz * 100, 8), F.lit("0192"), byte(a), F.lpad(rate, 7, "0"), F.hex(f))
    cable = F.concat(F.lit("440B"), digits(mhz * 100, 8), F.lit("FFF2"), byte(a % 8), F.lpad(rate, 7, "0"), F.hex(f))
    ten_hertz = F.lpad(F.hex(mhz * 1000), 8, "0")
    terrestrial = F.concat(F.lit("5A0B"), ten_hertz, byte(a), byte(a), F.lit("1AFFFFFFFF"))
    loop = F.unhex(F.when(key % 3 == 0, satellite).when(key % 3 == 1, cable).otherwise(terrestrial))
    found = desc.delivery_systems(desc.split(_read(spark, sf_dir, "supplier").select(key.alias("k"), loop.alias("loop")), "loop"))
    return found.select("k", "system", "frequency_mhz", "symbol_rate_msym", "modulation", "fec", "polarization", "orbital_degrees", "east", "roll_off", "bandwidth")
