"""Operator 10 against a brute-force version of the rules."""

import re
from collections import Counter, defaultdict

import pytest

from muxlake.llm import op10_quality_rules as op


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def verdicts(rows, limit):
    contents, own = defaultdict(set), []
    for r in rows:
        lines = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", x.lower())) for x in (r.text or "").split("\n")]
        lines = [x for x in lines if x]
        own.append(lines)
        for x in lines:
            contents[r.source or "", x].add(tuple(lines))
    out = []
    for r, lines in zip(rows, own):
        lost = sum(len(x.split(" ")) for x in lines if len(contents[r.source or "", x]) > limit)
        n, left = base(r.text)[0], base(r.text)[0] - lost
        out.append((lost, not base(r.text)[5] and not (lost and (left < 0.2 * n or left < 5))))
    return out


@pytest.mark.parametrize("table,limit", [("small", 12), ("small", 2), ("odd", 12), ("empty", 12)])
def test_against_brute_force(table, limit, request):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    want = sorted(((r.doc_id, *base(r.text), kept, lost) for r, (lost, kept) in zip(rows, verdicts(rows, limit))), key=str)
    got = [
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words)
        for r in op.judged(docs, limit).collect()
    ]
    got = sorted(got, key=str)
    assert got == want


def test_shared_line_goes_and_copies_stay(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(k, f"{words(k)}\nall rights reserved here\n{words(k + 1000)}", "s") for k in range(20)]
    rows += [(100 + k, f"{words(5000)}\n{words(6000)}", "s") for k in range(20)]
    rows += [(200 + k, f"tail{k} b c d\n" + "\n".join(f"menu {j} " + "z " * 20 + f"{j}" for j in range(3)), "s") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in op.clean_documents(docs).collect()}
    assert all(out[k] == f"{words(k)}\n{words(k + 1000)}" for k in range(20))
    assert all(100 + k in out for k in range(20))


def test_clean_documents_keeps_columns(odd):
    out = op.clean_documents(odd)
    assert out.columns == odd.columns and out.count() == len([r for r in odd.collect() if not base(r.text)[5]])


def test_inner_lines_of_a_shared_block_go(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    block = "\n".join(f"clause {j} of the licence" for j in range(5))
    rows = [(k, f"{words(k)}\n{block}\n{words(k + 1000)}", "s") for k in range(20)]
    rows += [(100 + k, f"{words(k + 2000)}\n{block}", "t") for k in range(12)]
    rows += [(200 + k, f"only{k} a b c d\n" + "\n".join(f"{words(3000 + j)}" for j in range(5)), "u") for k in range(13)]
    rows += [(300 + k, f"{words(5000)}\n{block}\n{words(6000)}", "v") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in op.clean_documents(docs).collect()}
    assert all(out[k] == f"{words(k)}\n{words(k + 1000)}" for k in range(20))
    assert all(out[100 + k] == f"{words(k + 2000)}\n{block}" for k in range(12))
    assert not any(200 + k in out for k in range(13))
    assert all(out[300 + k] == rows[45][1] for k in range(20))


def test_banner_and_two_hosts(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    banner = "first banner line\nmiddle banner line\nlast banner line"
    rows = [(k, f"{words(k)}\n{banner}", "s") for k in range(200)]
    rows += [(500, f"{words(500)}\nmiddle banner line", "s"), (500, f"{words(500)}\nmiddle banner line", "t"), (500, f"{words(500)}\nmiddle banner line", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op.clean_documents(docs).collect()
    assert sorted(r.text for r in out if r.doc_id < 500) == sorted(words(k) for k in range(200))
    assert sorted((r.source, r.text) for r in out if r.doc_id == 500) == [("s", words(500)), *[("t", f"{words(500)}\nmiddle banner line")] * 2]
