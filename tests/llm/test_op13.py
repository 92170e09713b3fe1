"""Operator 13: enumeration of all edits, damage by hand, SQL, odd rows, long conversations."""

import hashlib
import re
import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from muxlake.llm import op13_conversation_repair as op

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired rows) over all edits with at most two inserted rows at a place; rows: (role, text, fault)."""
    best = None
    gaps = [[]] + [[r] for r in ("user", "assistant")] + [list(x) for x in product(("user", "assistant"), repeat=2)]
    ways = []
    for role, text, fault in rows:
        own = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own += [("K", more, (role, text)), ("R", 2 + more, ("user", text)), ("R", 2 + more, ("assistant", text))]
        ways.append(own)
    for edits in product(*ways):
        for inserted in product(gaps, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                out += [(r, "") for r in inserted[k]]
                audit += "I" * len(inserted[k])
                cost += 2 * len(inserted[k])
                if k < len(rows):
                    audit += edits[k][0]
                    cost += edits[k][1]
                    out += [edits[k][2]] if edits[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def brute(rows):
    """The contract for the rows of one conversation after damage, in order."""
    seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append((role, text, fault))
        if fault:
            counts[fault] += 1
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    cost, audit, out = cheapest(marks)
    return *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


CASES = [
    [],
    [("user", "Hi."), ("assistant", "Yes.")],
    [("system", "Be."), ("assistant", "Yes.")],
    [("assistant", "a"), ("user", "b")],
    [("user", "x."), ("user", "x."), ("user", "y")],
    [("tool", "x."), ("", "y."), ("agent", "z!")],
    [("system", "s."), ("system", "s2.")],
    [("user", "  "), ("assistant", "\t\n")],
    [("assistant", "a."), ("assistant", "b?")],
    [("user", "q"), ("system", "w."), ("assistant", "e?  ")],
    [(" ", " "), ("user", "The "), ("user", "end.\u0085")],
]


def test_every_case_against_all_edits(spark):
    rows = [(c, t, r, x) for c, case in enumerate(CASES) for t, (r, x) in enumerate(case)]
    ids = spark.createDataFrame([(c,) for c in range(len(CASES))], "conv_id long")
    found = {r.conv_id: r for r in op.repair(spark.createDataFrame(rows, SCHEMA), ids).collect()}
    for c, case in enumerate(CASES):
        r = found[c]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == brute(case), case
        assert r.gaps == 0


def test_automaton_against_all_edits():
    repairs = op.Repairs()
    kinds = [("user", None), ("assistant", None), ("system", None), ("user", "blank"), ("user", "truncated"), ("other", "truncated")]
    for n in (1, 2, 3):
        for case in product(kinds, repeat=n):
            symbols = bytes((1 << "sua".index(r[0]) if r[0] in "sua" else 0) + {"blank": op.MUST_GO, "truncated": op.CUT}.get(f, 0) for r, f in case)
            cost, found = repairs.repair(symbols)
            assert (cost, "".join("I" * len(i) + x for i, x, _ in found)) == cheapest([(r, "t", f) for r, f in case])[:2]
    assert len(repairs.vectors) < 40


def test_damage(spark):
    rows = [(c, t, ["user", "assistant", "system"][t % 3], f"Text {c}. Yes! No? {t}.") for c in range(30) for t in range(8)] + [(None, None, None, None), (None, 3, "user", None)]
    expected = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        expected += [(c, t, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    found = [tuple(r) for r in op.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str) and len({len(r[3]) for r in found}) > 2


def test_sql(spark):
    odd = [(None, 1, "user", "x"), (None, None, "assistant", None), (7, None, None, "y."), (7, 5, "user", "y."), (7, 5, "user", "y."), (7, 9, "assistant", "aé'\n."), (8, -4, "", ""), (9, 3, "system", "")]
    for sf in ("sf0.001", "sf0.01"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").unionByName(spark.createDataFrame(odd, SCHEMA))
        out = op.repair(op.damaged(rows), rows)
        con = duckdb.connect()
        con.register("conversations", rows.toArrow())
        asked = con.execute(op.ORACLE_SQL)
        assert [d[0] for d in asked.description] == out.columns
        assert sorted(asked.fetchall(), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_gaps_and_ids_without_rows(spark):
    rows = spark.createDataFrame([(1, 3, "user", "a."), (1, 9, "assistant", "b."), (1, 9, "user", "c."), (1, None, "user", "d."), (2, None, "user", "e.")], SCHEMA)
    found = {r.conv_id: r for r in op.repair(rows, spark.createDataFrame([(1,), (3,), (None,)], "conv_id long")).collect()}
    assert found[1].gaps == 9 - 3 + 1 - 2 and found[2].gaps == 0 and set(found) == {1, 2, 3, None}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(found[3])[1:] == tuple(found[None])[1:] == (0,) * 6 + ("", empty)


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op.repair(op.damaged(none), none).collect() == []
    rows = spark.createDataFrame([(1, 1, "user", "a."), (1, 2, "user", "b")], SCHEMA)
    more = rows.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("how", "copy", "place", "fault", "symbol", "k", "letter", "cost", "part", "a.b", "Place"))))
    assert op.repair(op.damaged(more), more).collect() == op.repair(op.damaged(rows), rows).collect()


def test_a_long_conversation(spark):
    n = 25_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('Text ', id, '.') AS text")
    r = op.repair(rows).first()
    texts, audit = [], r.audit
    assert r.cost == sum({"D": 3, "I": 2, "R": 2, "K": 0}[x] for x in audit) and len(audit) - audit.count("I") == n
    k = 0
    for x in audit:
        role = "user" if len(texts) % 2 == 0 else "assistant"
        if x == "I":
            texts.append(f"{role}:")
            continue
        if x != "D":
            texts.append(f"{role}:Text {k}.")
        k += 1
    assert r.repaired_sha256 == hashlib.sha256("\n".join(texts).encode()).hexdigest()


@pytest.mark.parametrize("long_text", ["x" * 300_000 + ".", "a\U0001F600é\n." * 5000])
def test_long_texts(spark, long_text):
    rows = spark.createDataFrame([(1, 1, "user", long_text), (1, 2, "assistant", "ok.")], SCHEMA)
    assert op.repair(rows).first().repaired_sha256 == hashlib.sha256(f"user:{long_text}\nassistant:ok.".encode()).hexdigest()
