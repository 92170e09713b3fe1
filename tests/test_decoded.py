"""All tags in one pass, against vectors, against the views of single tags, and with texts in other alphabets."""

import json
import random

from pyspark.sql import functions as F
from test_nested import rows  # noqa: F401 - a fixture
from vectors import VECTORS

from muxlake.operators import descriptors as desc

ROWS = "position int, family string, tag int, ext_tag int, length int, data binary, name string"


def test_one_pass_gives_every_vector(rows):  # noqa: F811
    found = {}
    for r in desc.decoded(rows).select("vector", "item", F.to_json("fields").alias("j")).orderBy("vector", "item").collect():
        found.setdefault(r.vector, []).append(json.loads(r.j))
    assert found == {k: [json.loads(line) for line in v[3].splitlines()] for k, v in enumerate(VECTORS)}


def test_one_pass_equals_views_on_any_bytes(spark):
    rng = random.Random(11)
    keys = [("dvb", 0x48), ("dvb", 0x4E), ("dvb", 0x54), ("dvb", 0x5C), ("dvb", 0x6C), ("dvb", 0x87), ("dvb", 0x90), ("ext", 0x04), ("ait", 0x00), ("splice", 0x02)]
    made = []
    for k in range(600):
        family, tag = keys[k % len(keys)]
        own = (0x7F, tag) if family == "ext" else (tag, None)
        # Small numbers, so that lengths fit now and then.
        data = bytearray(rng.choice([rng.randrange(12), rng.randrange(256)]) for _ in range(rng.randrange(40)))
        made.append((k, family, *own, len(data), data, "x"))
    frame = spark.createDataFrame(made, ROWS).cache()
    one = desc.decoded(frame, variant=False).select("position", "item", "fields").collect()
    found = {(r.position, r.item): json.loads(r.fields) for r in one}
    want = {}
    for key in keys:
        view = desc.typed(frame, *key)
        fields = F.to_json(F.struct(*(c for c in view.columns if c not in frame.columns)))
        for r in view.select("position", fields.alias("j")).collect():
            value = json.loads(r.j)
            want[r.position, value.get("item")] = value
    assert found == want and len(one) == len(found)


def test_texts_of_other_alphabets_unknown_tags_and_families(spark):
    text = lambda raw: bytearray(bytes([1, 0, len(raw)]) + raw)
    korean, chinese = b"\x12" + "한국 \"방송\"".encode("euc_kr"), b"\x13" + "中国\\".encode("gb2312")
    made = [
        (0, "dvb", 0x48, None, 0, text(korean), "service"), (1, "dvb", 0x48, None, 0, text(chinese), "service"), (2, "dvb", 0x48, None, 0, text(b"\x01\xb2\xd5\xe1\xe2"), "service"),
        (3, "dvb", 0xEE, None, 2, bytearray(b"ab"), None), (4, "splice", 0x77, None, 6, bytearray(b"CUEIab"), None), (5, "ait", 0x15, None, 1, bytearray(b"a"), "simple_location"),
        (6, "dvb", 0x54, None, 0, bytearray(), "content"), (7, "dvb", 0x52, None, 0, bytearray(), "stream_identifier"), (8, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(made, ROWS)
    one = desc.decoded(frame, ("dvb", "splice"))
    got = {r.position: r.j and json.loads(r.j) for r in one.select("position", F.to_json("fields").alias("j")).collect()}
    name = lambda k: got[k]["service_name"]
    assert [name(k) for k in (0, 1, 2)] == ['한국 "방송"', "中国\\", "Вест"]
    assert got[3] is None and got[4] == {"identifier": 0x43554549, "private_bytes": "YWI="} and got[5] is None and 6 not in got and got[7] == {} and got[8] is None
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert one.where("variant_get(fields, '$.identifier', 'long') = 1129661769").count() == 1
