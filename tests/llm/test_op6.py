"""Operator 6 against re over every text."""

import hashlib
import re
import time

import pytest

from muxlake.llm import op6_secret_scan as op
from muxlake.llm.trigrams import trigram_query


def spans(text):
    text, out = text or "", []
    for place, rule in enumerate(op.RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m[rule.group]) >= rule.min_chars:
                out.append((m.start(), place, m.end(), rule.kind))
    return sorted(out)


def listed(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


@pytest.mark.parametrize("table", ["small", "odd", "empty"])
def test_spans_match_a_full_scan(table, request):
    docs = request.getfixturevalue(table)
    got = sorted(((r.doc_id, r.text, listed(r.found)) for r in op.scan(docs).collect()), key=str)
    want = sorted(((r.doc_id, r.text or "", listed(spans(r.text))) for r in docs.collect()), key=str)
    assert got == want
    assert table != "small" or any(x[2] for x in got)


def test_query_digest(spark):
    rows = op.query(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        found = spans(texts[r.doc_id])
        base = [x for x in found if x[1] < 3]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r.spans == listed(found)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in base) for k in ("assign", "access", "hex"))


def test_redact(spark, odd):
    def cut(text):
        out, at = "", 0
        for a, _, b, _ in spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    got = sorted(((r.doc_id, r.text) for r in op.redact(odd).collect()), key=str)
    assert got == sorted(((r.doc_id, cut(r.text or "")) for r in odd.collect()), key=str)
    assert op.redact(odd).columns == odd.columns


def test_trigram_queries():
    assert trigram_query("[0-9a-f]+") == []
    assert trigram_query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert trigram_query("abcd|bcd") == [[frozenset({"bcd"})]]
    assert trigram_query("abc[0-9]+xyz") == [[frozenset({"abc"})], [frozenset({"xyz"})]]
    assert trigram_query("(?:ab|cde)f?") == []


def test_many_matches_in_one_text(spark):
    few = " ".join(f"password = secret{k:06d}abcdef {k:020x} \U0001F600" for k in range(2000))
    many = "\ufeff" + " ".join(f"password = secret{k:06d}abcdef {k:020x} \U0001F600" for k in range(20_000))
    docs = spark.createDataFrame([(1, few), (2, many)], "doc_id long, text string").repartition(1).cache()
    assert docs.count() == 2
    begin = time.time()
    got = {r.doc_id: r for r in op.scan(docs).collect()}
    middle = time.time()
    assert middle - begin < 20
    for k, text in ((1, few), (2, many)):
        assert listed(got[k].found) == listed(spans(text))
    clean = {r.doc_id: r.text for r in op.redact(docs).collect()}
    assert time.time() - middle < 30
    assert clean[2] == "\ufeff" + " ".join("password = [SECRET] \U0001F600" for _ in range(20_000)).replace("password = [SECRET]", "[SECRET] [SECRET]")
