"""Times, clocks and texts of broadcast streams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from json import dumps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from muxlake.functions.bits import once, part, uint

PCR_RATE, PTS_RATE = 27_000_000, 90_000
PCR_BITS, PTS_BITS = 42, 33


def bcd(data: Column, start, size: int) -> Column:
    """A number in binary-coded decimal; null where a digit is none."""
    digits = F.hex(part(data, start, size))
    return F.when(digits.rlike(f"^[0-9]{{{2 * size}}}$"), digits.cast("long"))


def bcd_seconds(data: Column, start) -> Column:
    """Hours, minutes and seconds in three BCD bytes, as seconds; null where they are no time of day or duration."""
    n = bcd(data, start, 3)
    h, m, s = F.floor(n / 10000), F.floor(n / 100) % 100, n % 100
    return F.when((m < 60) & (s < 60), h * 3600 + m * 60 + s).cast("long")


def bcd_minutes(data: Column, start) -> Column:
    """Hours and minutes in two BCD bytes, as minutes."""
    n = bcd(data, start, 2)
    return (F.floor(n / 100) * 60 + n % 100).cast("long")


def mjd_seconds(data: Column, start) -> Column:
    """A modified Julian date and a BCD time of day as seconds since 1970; null where either is undefined."""
    day = uint(data, start, 2)
    time = bcd_seconds(data, start + 2)
    return F.when((day != 0xFFFF) & (time < 86400), (day - 40587) * 86400 + time)


def utc(seconds: Column) -> Column:
    """Seconds since 1970 as a timestamp without zone."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def tick_delta(before: Column, after: Column, width: int = PCR_BITS) -> Column:
    """Ticks from one time stamp to a later one, over the wrap of so many bits."""
    return F.pmod(after - before, F.lit(1 << width))


def bits_per_second(n_bytes: Column, ticks: Column, rate: int) -> Column:
    return F.when(ticks > 0, n_bytes * F.lit(8.0) * F.lit(float(rate)) / ticks)


# First byte of a DVB text and the part of ISO 8859 that it selects; 0x10 has the part in its third byte.
PARTS = {0x01: 5, 0x02: 6, 0x03: 7, 0x04: 8, 0x05: 9, 0x06: 10, 0x07: 11, 0x09: 13, 0x0A: 14, 0x0B: 15}
# First bytes that select alphabets of more than a byte without a rule of their own.
WIDE = {0x12: "euc_kr", 0x13: "gb2312", 0x14: "big5"}
UTF_16, UTF_8 = "11", "15"
_HIGH = "".join(map(chr, range(0xA0, 0x100)))


def _sql_map(pairs: dict[str, str]) -> str:
    """A map of texts without quotes or backslashes as SQL, which is made in one call."""
    return f"map({', '.join(f"'{x}'" for pair in pairs.items() for x in pair)})"


_LEADS = _sql_map({f"{c:02X}": f"{n:02X}" for c, n in PARTS.items()})
#: What the upper bytes stand for in each part.
_TABLES = _sql_map({f"{n:02X}": bytes(range(0xA0, 0x100)).decode(f"iso8859_{n}", "replace") for n in range(2, 16) if n != 12})
_CONTROL = dict.fromkeys([0, *range(0x80, 0x8A), *range(0x8B, 0xA0), *range(0xE080, 0xE08A), *range(0xE08B, 0xE0A0)])


def dvb_codec(raw: bytes) -> str:
    """One DVB text, as dvb_text reads it; for SQL, where a function is called by its name."""
    lead, n = (raw[0], PARTS.get(raw[0])) if raw else (0x20, None)
    skip = lead < 0x20
    if lead == 0x10 and len(raw) >= 3:
        skip, n = 3, raw[2] if 2 <= raw[2] <= 15 and raw[2] != 12 else None
    codec = {0x11: "utf-16-be", 0x15: "utf-8"}.get(lead) or WIDE.get(lead) or (f"iso8859_{n}" if n else "latin-1")
    return raw[skip:].decode(codec, "replace").translate(_CONTROL).replace("\x8a", "\n")


@F.pandas_udf(StringType())
def _wide_text(data: pd.Series) -> pd.Series:
    """Texts of the alphabets in WIDE; null for null."""
    return data.map(lambda raw: bytes(raw)[1:].decode(WIDE[bytes(raw)[0]], "replace"), na_action="ignore")


#: Set where expressions are built for JSON of many fields, whose texts in wide alphabets one function decodes at last (unmarked).
_MARKING: ContextVar[bool] = ContextVar("marking", default=False)
#: A character that is none, in front of and behind the hexadecimal digits of a text that is not decoded yet.
_MARK = "\ufdd0"


@contextmanager
def marked_wide_texts() -> Iterator[None]:
    token = _MARKING.set(True)
    try:
        yield
    finally:
        _MARKING.reset(token)


@F.pandas_udf(StringType())
def _unmarked(json: pd.Series) -> pd.Series:
    def text(m: re.Match) -> str:
        return dumps(dvb_codec(bytes.fromhex(m.group(1))), ensure_ascii=False)[1:-1]

    return json.map(lambda x: re.sub(f"{_MARK}([0-9A-F]*){_MARK}", text, x), na_action="ignore")


# Filters on the decoded fields must not be pushed below the function, where it can't be evaluated.
_unmarked = _unmarked.asNondeterministic()


def unmarked(json: Column | str) -> Column:
    """JSON whose marked texts are decoded; Python sees rows with such texts only."""
    json = F.col(json) if isinstance(json, str) else json
    marked = F.contains(json, F.lit(_MARK))
    return F.when(marked, _unmarked(F.when(marked, json))).otherwise(json)


def _utf_16(body: Column) -> Column:
    """Big-endian UTF-16; an odd byte at the end goes, and so do halves of pairs where one of them stands alone."""
    units = F.array_join(F.regexp_extract_all(F.hex(body), F.lit("[0-9A-F]{4}"), F.lit(0)), " ")
    paired = units.rlike("^(D[89AB].. D[C-F]..( |$)|(?!D[89A-F]).{4}( |$))*$")
    return F.decode(F.unhex(F.replace(F.when(paired, units).otherwise(F.regexp_replace(units, "D[89A-F]..", "")), F.lit(" "), F.lit(""))), "UTF-16BE")


def dvb_text(data: Column) -> Column:
    """DVB text: a leading byte selects the alphabet, control codes go, and 0x8A is a new line; null for null.

    Built-in functions read the parts of ISO 8859, UTF-8 and UTF-16; Python sees only the other alphabets' texts, and nulls in place of the rest.
    """
    data = F.col(data) if isinstance(data, str) else data
    if _MARKING.get():  # many texts in one expression: each value is in the plan once
        return once(data, lambda d: once(F.hex(F.substring(d, 1, 1)), lambda lead: _dvb_text(d, lead)))
    return _dvb_text(data, F.hex(F.substring(data, 1, 1)))


def _dvb_text(data: Column, lead: Column) -> Column:
    digits = lambda codes: [f"{c:02X}" for c in codes]
    selected = (lead == "10") & (F.length(data) >= 3)
    parts = F.expr(_LEADS)
    key = F.when(selected, F.hex(F.substring(data, 3, 1))).otherwise(F.try_element_at(parts, lead))
    to = F.try_element_at(F.expr(_TABLES), key)
    body = F.substring(data, F.when(selected, 4).when(lead < "20", 2).otherwise(1), F.length(data))
    latin = F.decode(body, "ISO-8859-1")
    single = F.when(to.isNull(), latin).otherwise(F.call_function("translate", latin, F.lit(_HIGH), to))
    is_wide = lead.isin(*digits(WIDE))
    wide = F.concat(F.lit(_MARK), F.hex(data), F.lit(_MARK)) if _MARKING.get() else _wide_text(F.when(is_wide, data))
    text = F.when(lead == UTF_8, F.make_valid_utf8(body.cast("string"))).when(lead == UTF_16, _utf_16(body)).when(is_wide, wide).otherwise(single)
    return F.replace(F.regexp_replace(text, "[\\x00\\x80-\\x89\\x8b-\\x9f\ue080-\ue089\ue08b-\ue09f]", ""), F.lit("\x8a"), F.lit("\n"))


def dvb_text_or_utf8(data: Column) -> Column:
    """DVB text, but UTF-8 where the bytes are that and hold Cyrillic letters, without a leading byte."""
    data = F.col(data) if isinstance(data, str) else data
    plain = F.try_validate_utf8(data.cast("string"))
    return F.when((F.hex(F.substring(data, 1, 1)) != UTF_8) & F.coalesce(plain.rlike("[\u0400-\u04FF]"), F.lit(False)), plain).otherwise(dvb_text(data))


def language(data: Column, start) -> Column:
    """A three-letter code."""
    return F.decode(part(data, start, 3), "ISO-8859-1")


def hex_dump(data: Column, width: int = 16) -> Column:
    """Lines of an offset and so many bytes."""
    n = F.length(data)
    line = lambda k: F.concat(F.lpad(F.hex(k), 4, "0"), F.lit(": "), F.trim(F.regexp_replace(F.hex(part(data, k, width)), "(..)", "$1 ")))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1, F.lit(width)), line), "\n")).otherwise("")


def datagram_packet_size(n: Column) -> Column:
    """188 or 204, if a datagram's length is a multiple of exactly one of them."""
    short, long = n % 188 == 0, n % 204 == 0
    return F.when((n >= 188) & (short != long), F.when(short, 188).otherwise(204))


def pid_list(text: Column) -> Column:
    """PIDs of a list with commas, decimal or 0x hexadecimal, distinct and ascending; null where an item is none."""
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    number = lambda x: F.when(x.rlike("^0[xX][0-9a-fA-F]{1,4}$"), F.conv(F.substring(x, 3, 4), 16, 10).cast("int")).when(x.rlike("^[0-9]{1,4}$"), x.cast("int"))
    pids = F.transform(items, number)
    bad = F.exists(pids, lambda p: p.isNull() | (p > 0x1FFF))
    return F.when(~bad, F.sort_array(F.array_distinct(pids)))


def endpoint(text: Column) -> Column:
    """Host and port of `udp://@239.1.1.1:1234`, with or without the scheme and the at sign; null where it is none."""
    pattern = r"^(?:udp://)?@?([0-9]{1,3}(?:\.[0-9]{1,3}){3}):([0-9]{1,5})$"
    text = F.trim(text)
    octets = F.transform(F.split(F.regexp_extract(text, pattern, 1), r"\."), lambda x: x.try_cast("int"))
    port = F.regexp_extract(text, pattern, 2).try_cast("int")
    sound = F.rlike(text, F.lit(pattern)) & F.forall(octets, lambda x: x <= 255) & port.between(1, 65535)
    return F.when(sound, F.struct(F.regexp_extract(text, pattern, 1).alias("host"), port.alias("port")))


def clock_time(ticks: Column, rate: int = PCR_RATE) -> Column:
    """Ticks of a clock as a day-time interval, to the microsecond."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(ticks / F.lit(float(rate)), 6).cast("decimal(18,6)"))
