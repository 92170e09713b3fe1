"""Names, nested descriptors and exports."""

from xml.etree import ElementTree

from pyspark.sql import functions as F

from muxlake.functions import names
from muxlake.functions.bits import be, join
from muxlake.functions import values
from muxlake.operators import descriptors as desc
from muxlake.operators import export, packets, sections, tables
from muxlake.plans import mux


def loop_rows(spark, family, *items):
    return desc.split(spark.range(1).select(join(*(mux.descriptor(t, F.lit(bytes(d)).cast("binary")) for t, d in items)).alias("loop")), "loop", family)


def test_names(spark):
    row = spark.range(1).select(names.name_of(F.lit(0x1B), names.STREAM_TYPES), names.name_of(F.lit(99), names.GENRES), names.minimum_age(F.lit(9)), names.minimum_age(F.lit(0))).first()
    assert tuple(row) == ("H.264 video", "unknown", 12, None)


def test_segmentation(spark):
    head = b"CUEI" + (77).to_bytes(4, "big")
    whole = head + bytes([0x7F, 0xE0 | 0x00]) + (900_000).to_bytes(5, "big") + bytes([0x09, 3]) + b"abc" + bytes([0x34, 1, 2])
    part = head + bytes([0x7F, 0x0B | 0x00, 1, 5, 0xFE, 0, 0, 0, 9]) + bytes([0, 0, 0x35, 0, 0])
    gone = head + bytes([0xFF])
    rows = desc.segmentations(loop_rows(spark, "splice", (2, whole), (2, part), (2, gone))).orderBy("position").collect()
    assert (rows[0].event_id, rows[0].duration, bytes(rows[0].upid), rows[0].type_id, rows[0].segments) == (77, 900_000, b"abc", 0x34, 2)
    assert rows[0].components is None and rows[0].web_allowed is None
    assert [tuple(c) for c in rows[1].components] == [(5, 9)] and rows[1].type_id == 0x35 and rows[1].duration is None and rows[1].no_regional_blackout
    assert rows[2].cancelled and rows[2].type_id is None


def test_upids(spark):
    head = b"CUEI" + (7).to_bytes(4, "big") + bytes([0x7F, 0xBF])
    made = lambda kind, upid, kind_of=0x10: (2, head + bytes([kind, len(upid)]) + upid + bytes([kind_of, 0, 0]))
    eidr = (5240).to_bytes(2, "big") + bytes.fromhex("7791" "8B32" "4DE9" "1ED0" "5A37")
    nested = bytes([0x09, 3]) + b"abc" + bytes([0x08, 8]) + (2**64 - 1).to_bytes(8, "big") + bytes([0x0C, 6]) + b"ABCD\x01\x02" + bytes([0x0A, 12]) + eidr
    cut = nested[:5] + bytes([0x0E, 9]) + b"zz"
    rows = loop_rows(spark, "splice", made(0x0D, nested), made(0x0D, cut), made(0x06, bytes(range(12))), made(0x0F, "u:\u044f".encode()), made(0x10, bytes(range(16))), made(0x00, b""), made(0x0A, b"10.5237/ABCD-EF01"), made(0x0A, b"short"))
    found = [tuple(r)[-6:] for r in desc.segmentation_upids(rows).orderBy("position", "item").collect()]
    assert found == [
        (9, "ADI", "text", "abc", None, None), (8, "TI", "text", "18446744073709551615", None, None), (12, "MPU", "base-64", "AQI=", 0x41424344, None),
        (10, "EIDR", "text", "10.5240/7791-8B32-4DE9-1ED0-5A37-" + found[3][3][-1], None, "content"),
        (9, "ADI", "text", "abc", None, None), (6, "versioned ISAN", "base-64", "AAECAwQFBgcICQoL", None, None), (15, "URI", "text", "u:\u044f", None, None),
        (16, "UUID", "text", "00010203-0405-0607-0809-0a0b0c0d0e0f", None, None), (0, "not used", "text", "", None, None), (10, "EIDR", "text", "10.5237/ABCD-EF01", None, "party"), (10, "EIDR", "text", None, None, None),
    ]
    p = 36
    for c in "77918B324DE91ED05A37":
        s = (p + int(c, 36)) % 36 or 36
        p = s * 2 % 37
    assert found[3][3][-1] == "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[(37 - p) % 36]


def test_names_in_utf8(spark):
    cyrillic, latin = "\u041e\u0440\u0451\u043b", "\u00c9t\u00e9"
    texts = [cyrillic.encode(), b"\x15" + cyrillic.encode(), b"\x01" + cyrillic.encode("iso8859_5"), latin.encode("latin-1"), latin.encode(), b"\xd0", b"", b"Ore\x8al"]
    rows = desc.split(spark.createDataFrame([(bytearray(bytes([0x89, 0x15, len(t)]) + t),) for t in texts], "loop binary").coalesce(1), "loop")
    names = [r.region_name for r in desc.typed(rows, "dvb", 0x89).collect()]
    assert names == [cyrillic, cyrillic, cyrillic, latin, latin.encode().decode("latin-1").translate({k: None for k in range(0x80, 0xA0)}), "\u00d0", "", "Ore\nl"]
    zones = desc.split(spark.createDataFrame([(bytearray(bytes([0x90, len(texts[0])]) + texts[0]),)], "loop binary"), "loop")
    assert desc.typed(zones, "dvb", 0x90).first().zone_name == cyrillic


def test_texts_of_every_alphabet(spark):
    sample = "".join(map(chr, range(0xA0, 0x100)))
    texts, want = [], []
    for lead, n in [*values.PARTS.items(), *((0x10, n) for n in range(0, 17))]:
        codec = f"iso8859_{n}" if 1 <= n <= 15 and n != 12 else "latin-1"
        texts.append((bytes([lead, 0, n]) if lead == 0x10 else bytes([lead])) + b"a" + bytes(range(0xA0, 0x100)))
        want.append("a" + bytes(range(0xA0, 0x100)).decode(codec, "replace"))
    more = [(b"\x11" + "\u042f\U0001F600x".encode("utf-16-be"), "\u042f\U0001F600x"), (b"\x11\xd8\x00\x00a\x00", "a"), (b"\x12" + "\ud55c".encode("euc_kr"), "\ud55c"), (b"\x13" + "\u4e2d".encode("gb2312"), "\u4e2d"), (b"\x14" + "\u4e2d".encode("big5"), "\u4e2d"), (b"\x15\xff", "\ufffd"), (b"\x1fab", "ab"), (b"a\x86b\x87\x00", "ab")]
    made = spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate([*texts, *(t for t, _ in more)])], "k int, d binary")
    got = [r.t for r in made.select("k", values.dvb_text("d").alias("t")).orderBy("k").collect()]
    assert got == [*want, *(w for _, w in more)] and sample


def test_cells_and_names(spark):
    cell = bytes([0, 7, 0xFF, 0xFE, 0, 3, 0x12, 0x34, 0x56, 0])
    row = desc.cells(loop_rows(spark, "dvb", (0x6C, cell + cell))).orderBy("item").collect()
    assert len(row) == 2 and (row[0].cell_id, row[0].latitude, row[0].longitude, row[0].extent_latitude, row[0].extent_longitude) == (7, -2, 3, 0x123, 0x456)
    row = desc.cell_frequencies(loop_rows(spark, "dvb", (0x6D, bytes([0, 7, 0, 0, 1, 0, 0])))).first()
    assert (row.cell_id, row.frequency) == (7, 2560)
    row = desc.application_names(loop_rows(spark, "ait", (1, b"eng\x03app"))).first()
    assert (row.language, row.application_name) == ("eng", "app")
    row = desc.ac3(loop_rows(spark, "dvb", (0x6A, bytes([0xA0, 1, 2, 9])))).first()
    assert (row.component_type, row.bsid, row.main_id, bytes(row.additional_info)) == (1, None, 2, b"\x09")


def test_splice_xml(spark):
    command = join(be(1 << 39 | 0x7E << 32 | 12345, 5))
    body = join(be(0, 1), be(0, 5), be(0, 1), be((0xFFF << 12) + 5, 3), be(6, 1), command, be(0, 2))
    section = mux.with_crc(join(be(0xFC, 1), be(F.length(body) + 4 + 0x3000, 2), body))
    rows = spark.range(1).select(F.lit("x").alias("source"), F.lit(300).alias("pid"), F.lit(0).cast("long").alias("seq"), section.alias("section"))
    cues = tables.splice(sections.reassemble(packets.decode(mux.section_packets(rows))))
    row = export.splice_xml(cues).first()
    root = ElementTree.fromstring(row.xml)
    assert row.splice_pts == 12345 and root.tag.endswith("SpliceInfoSection")
    assert root.find(".//{*}SpliceTime").attrib == {"ptsTime": "12345"}
    assert export.as_json(cues).count() == 1


def test_cue_documents(spark):
    loops = [
        ["00084355454900000007", "021743554549000000057FFF00000DBBA00903414243340102", "031043554549000000000064000000070025"],
        ["040A435545491F03656E6753", "0506435545490102", "010843554549325F3132"],
        [],
    ]
    rows = []
    for k, loop in enumerate(loops):
        data = bytes.fromhex("".join(loop))
        body = bytes(6) + b"\x00\xff\xf0\x05\x06" + bytes([0xFE]) + (12345 + k).to_bytes(4, "big") + len(data).to_bytes(2, "big") + data
        rows.append(("x", k, bytearray(b"\xfc" + (0x3000 + len(body) + 4).to_bytes(2, "big") + body + bytes(4))))
    made = spark.createDataFrame(rows, "source string, seq long, section binary").select("source", F.lit(300).alias("pid"), F.col("seq").alias("first_offset"), F.lit(0).alias("place"), "section", F.lit(0xFC).alias("table_id"), F.lit(0).cast("long").alias("crc32"), F.lit(True).alias("crc_ok"))
    documents = export.cue_documents(tables.splice(made)).orderBy("first_offset").collect()
    names = []
    for k, r in enumerate(documents):
        assert "/>" not in r.xml and r.splice_pts == 12345 + k
        root = ElementTree.fromstring(r.xml)
        assert root.tag.endswith("SpliceInfoSection") and root[0].tag.endswith("TimeSignal")
        names.append([e.tag.partition("}")[2] for e in root[1:]])
        if k == 0:
            time = root.find(".//{*}TimeDescriptor")
            assert time.attrib == {"taiSeconds": "100", "taiNs": "7", "utcOffset": "37"}
            assert root.find(".//{*}SegmentationDescriptor").attrib["segmentationDuration"] == "900000"
        if k == 1:
            assert root.find(".//{*}AudioChannel").attrib["ISOCode"] == "eng" and root.find(".//{*}PrivateDescriptor").attrib == {"privateTag": "5", "identifier": "1129661769"}
    assert names == [["AvailDescriptor", "SegmentationDescriptor", "TimeDescriptor"], ["AudioDescriptor", "PrivateDescriptor", "DTMFDescriptor"], []]
