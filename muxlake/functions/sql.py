"""Functions for SQL: `register_functions(spark)` makes checksums, texts, headers, descriptors, sections and rates callable by name.

Functions of a value are SQL expressions themselves, so that they take part in code generation and in pushed filters: ts_uint(binary, start, size),
ts_crc32_mpeg2(binary), ts_crc8(binary), ts_decode_section(binary), ts_adaptation_field(packet), ts_pes_header(payload); ts_dvb_string(binary) needs Python for alphabets.
Tables: ts_decode_descriptors(binary), also called ts_descriptors, ts_sections(TABLE(...) PARTITION BY source, pid ORDER BY byte_offset), whose input has the columns source, pid,
byte_offset, cc, pusi, discontinuity and payload, and ts_bitrate(TABLE(...) PARTITION BY source ORDER BY byte_offset), of source, byte_offset, n_bytes and ticks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from muxlake.functions.checks import DIGITS, REVERSED
from muxlake.functions.values import PCR_BITS, PCR_RATE, dvb_codec

_STAMP = "(shiftright(ts_uint({d}, {a}, 1), 1) & 7) * 1073741824 + shiftright(ts_uint({d}, {a} + 1, 2), 1) * 32768 + shiftright(ts_uint({d}, {a} + 3, 2), 1)"
_CLOCK = "shiftright(ts_uint({d}, {a}, 5), 7) * 300 + (ts_uint({d}, {a} + 4, 2) & 511)"
#: Signature and expression of each function.
FUNCTIONS = {
    "ts_uint(data BINARY, start INT, size INT) RETURNS BIGINT": "CASE WHEN length(substring(data, start + 1, size)) = size THEN CAST(conv(hex(substring(data, start + 1, size)), 16, 10) AS BIGINT) END",
    "ts_crc32_mpeg2(data BINARY) RETURNS BIGINT": f"CAST(conv(reverse(lpad(bin(crc32(unhex(regexp_replace(translate(hex(data), '{DIGITS}', '{REVERSED}'), '(.)(.)', '$2$1'))) ^ 4294967295L), 32, '0')), 2, 10) AS BIGINT)",
    "ts_crc8(data BINARY) RETURNS INT": """CASE WHEN length(data) > 0 THEN aggregate(sequence(1, length(data)), 0, (crc, k) -> aggregate(sequence(1, 8), crc ^ CAST(conv(hex(substring(data, k, 1)), 16, 10) AS INT),
        (c, i) -> CASE WHEN c >= 128 THEN shiftleft(c, 1) & 255 ^ 213 ELSE shiftleft(c, 1) END)) WHEN data IS NOT NULL THEN 0 END""",
    "ts_decode_section(data BINARY) RETURNS STRUCT<table_id: INT, syntax: BOOLEAN, length: INT, extension: INT, version: INT, current: BOOLEAN, number: INT, last_number: INT, crc_ok: BOOLEAN>": """CASE WHEN length(data) >= 3 THEN
        struct(CAST(ts_uint(data, 0, 1) AS INT), ts_uint(data, 1, 1) >= 128, CAST(ts_uint(data, 1, 2) & 4095 AS INT), CAST(CASE WHEN ts_uint(data, 1, 1) >= 128 THEN ts_uint(data, 3, 2) END AS INT),
        CAST(CASE WHEN ts_uint(data, 1, 1) >= 128 THEN shiftright(ts_uint(data, 5, 1), 1) & 31 END AS INT), CASE WHEN ts_uint(data, 1, 1) >= 128 THEN ts_uint(data, 5, 1) % 2 = 1 END,
        CAST(CASE WHEN ts_uint(data, 1, 1) >= 128 THEN ts_uint(data, 6, 1) END AS INT), CAST(CASE WHEN ts_uint(data, 1, 1) >= 128 THEN ts_uint(data, 7, 1) END AS INT), ts_crc32_mpeg2(data) = 0) END""",
    "ts_adaptation_field(packet BINARY) RETURNS STRUCT<length: INT, discontinuity: BOOLEAN, random_access: BOOLEAN, priority: BOOLEAN, pcr: BIGINT, opcr: BIGINT, splice_countdown: INT>": f"""CASE WHEN shiftright(ts_uint(packet, 3, 1), 5) & 1 = 1 THEN struct(
        CAST(ts_uint(packet, 4, 1) AS INT), {{flag}} & 128 <> 0, {{flag}} & 64 <> 0, {{flag}} & 32 <> 0, CASE WHEN {{flag}} & 16 <> 0 THEN {_CLOCK.format(d="packet", a=6)} END,
        CASE WHEN {{flag}} & 8 <> 0 THEN {_CLOCK.format(d="packet", a="6 + (CASE WHEN {flag} & 16 <> 0 THEN 6 ELSE 0 END)")} END,
        CAST(CASE WHEN {{flag}} & 4 <> 0 THEN {{count}} - CASE WHEN {{count}} > 127 THEN 256 ELSE 0 END END AS INT)) END""",
    "ts_pes_header(payload BINARY) RETURNS STRUCT<stream_id: INT, packet_length: INT, pts: BIGINT, dts: BIGINT>": f"""CASE WHEN ts_uint(payload, 0, 3) = 1 AND length(payload) > 6 THEN struct(
        CAST(ts_uint(payload, 3, 1) AS INT), CAST(ts_uint(payload, 4, 2) AS INT), CASE WHEN {{timed}} AND ts_uint(payload, 7, 1) >= 128 THEN {_STAMP.format(d="payload", a=9)} END,
        CASE WHEN {{timed}} AND ts_uint(payload, 7, 1) >= 192 THEN {_STAMP.format(d="payload", a=14)} END) END""",
}
_PARTS = {
    "{count}": "ts_uint(packet, CAST(6 + (CASE WHEN {flag} & 16 <> 0 THEN 6 ELSE 0 END) + (CASE WHEN {flag} & 8 <> 0 THEN 6 ELSE 0 END) AS INT), 1)",
    "{flag}": "(CASE WHEN ts_uint(packet, 4, 1) > 0 THEN ts_uint(packet, 5, 1) ELSE 0 END)",
    "{timed}": "ts_uint(payload, 3, 1) NOT IN (188, 190, 191, 240, 241, 242, 248, 255)",
}


@F.pandas_udf(StringType())
def ts_dvb_string(data: pd.Series) -> pd.Series:
    return data.map(lambda raw: dvb_codec(bytes(raw)), na_action="ignore")


@F.udtf(returnType="position int, tag int, ext_tag int, data binary")
class DescriptorsOf:
    """The descriptors of a loop, up to the first that does not fit."""

    def eval(self, loop: bytes):
        at, position = 0, 0
        loop = bytes(loop or b"")
        while at + 2 <= len(loop):
            long = loop[at] in (0x89, 0x90) and loop[at + 1] == 0x15 and at + 3 <= len(loop)
            head = 3 if long else 2
            end = at + head + loop[at + head - 1]
            if end > len(loop):
                return
            extended = loop[at] == 0x7F and end > at + head
            yield position, loop[at], loop[at + head] if extended else None, loop[at + head + extended : end]
            at, position = end, position + 1


@F.udtf(returnType="source string, pid int, first_offset bigint, place int, section binary")
class SectionsOf:
    """The sections of a PID whose packets come in order."""

    def __init__(self):
        from muxlake.streaming.live import Assembler

        self.assembler = Assembler()

    def eval(self, row: Row):
        for first, place, section in self.assembler.push(row["byte_offset"], row["cc"], row["pusi"], bool(row["discontinuity"]), bytes(row["payload"])):
            yield row["source"], row["pid"], first, place, section


@F.udtf(returnType="source string, byte_offset bigint, n_bytes bigint, ticks bigint, bps double")
class BitrateOf:
    """Windows of a source's clock: each ends with the first row that is a window's ticks after the last end; rows without ticks only add bytes.

    Input in order: source, byte_offset, n_bytes, ticks. The window is 27 MHz ticks of a second unless a second argument names others.
    """

    def __init__(self):
        self.begin, self.total = None, 0

    def eval(self, row: Row, window: int = PCR_RATE):
        self.total += row["n_bytes"] or 0
        tick = row["ticks"]
        if tick is None:
            return
        if self.begin is None:
            self.begin, self.total = tick, 0
            return
        passed = (tick - self.begin) % (1 << PCR_BITS)
        if passed >= window:
            yield row["source"], row["byte_offset"], self.total, passed, self.total * 8.0 * PCR_RATE / passed
            self.begin, self.total = tick, 0


def register_functions(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        for name, value in _PARTS.items():
            body = body.replace(name, value)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("ts_dvb_string", ts_dvb_string)
    for name in ("ts_descriptors", "ts_decode_descriptors"):
        spark.udtf.register(name, DescriptorsOf)
    spark.udtf.register("ts_sections", SectionsOf)
    spark.udtf.register("ts_bitrate", BitrateOf)
