"""Operator 5 against tuples of turns."""

import pytest

from muxlake.llm import op5_chat_collapse as op

SCHEMA = "conv_id long, turn long, role string, text string, place string"
HI, YO, BYE = ("user", "hi"), ("assistant", "yo"), ("user", "bye")
CHATS = {
    1: [HI], 2: [HI, YO], 3: [HI, YO, BYE], 4: [HI, YO, BYE], 5: [YO, HI], 6: [("user", None)], 7: [("user", "")],
    8: [(None, None), HI], 9: [HI, HI], 10: [("user", "h"), ("i", "")], 11: [("system", "x" * 100_000), HI], 12: [("system", "x" * 100_000)],
}


def brute(chats):
    keep = {}
    for c in sorted(chats):
        t = tuple(chats[c])
        if not any(len(o) > len(t) and tuple(o[: len(t)]) == t for o in chats.values()):
            keep.setdefault(t, c)
    return sorted((c, len(t), "".join(f"<|turn|>{r or ''}\n{x or ''}<|end|>\n" for r, x in t)) for t, c in keep.items())


def found(frame):
    return sorted((r.conv_id, r.n_turns, r.rendered) for r in op.render(frame).collect())


def test_snapshots_collapse(spark):
    rows = [(c, k, r, t, "own column") for c, turns in CHATS.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "belongs nowhere", None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(CHATS)


def test_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (2, 0, "user", "a", ""), (3, 5, "user", "c", ""), (3, 5, "user", "c", ""), (4, 1, "user", "c", "")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute({1: [("user", "a"), ("user", "b")], 2: [("user", "a")], 3: [("user", "c")] * 2, 4: [("user", "c")]})


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_tables(spark, scale):
    frame = spark.read.parquet(f"/root/testdata/{scale}/conversations.parquet")
    chats = {}
    for r in frame.orderBy("conv_id", "turn").collect():
        chats.setdefault(r.conv_id, []).append((r.role, r.text))
    assert found(frame) == brute(chats)
    assert op.render(frame.limit(0)).count() == 0
