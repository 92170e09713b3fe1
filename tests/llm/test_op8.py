"""Operator 8 against the tokenizer library, and its round trip."""

import hashlib

import public_tokenizers as public
import pytest
import tiktoken

from muxlake.llm import op8_byte_bpe as op

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=op.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("table", ["small", "odd", "empty"])
@pytest.mark.parametrize("frequent", [400_000, 50])
def test_digests(table, frequent, request, library, monkeypatch):
    monkeypatch.setattr(op, "FREQUENT", frequent)
    docs = request.getfixturevalue(table)
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r.text or "").encode())]
        want.append((r.doc_id, len(ids), *digests))
    got = [tuple(r) for r in op.encode_digests(docs, PATH, public.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_with_ids(odd, library):
    out = op.with_ids(odd, PATH, public.PATTERN)
    assert out.columns == [*odd.columns, "token_ids", "decoded"]
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.decoded == (r.text or "") and r.token_ids == library.encode_ordinary(r.text or "")


def test_with_ids_refuses_names_that_are_taken(odd):
    with pytest.raises(ValueError):
        op.with_ids(odd, PATH, public.PATTERN, "ids", "ROW")


def test_pieces_and_long_merges(library):
    texts = ["I'll  go\n\n x\t　y  z\x1c\x1f!", "naïve Ωmega 12½ ٠١ don't\xa0stop", "  lead", "trail  ", "á \U0001F600\U0001F600"]
    for t in texts:
        pieces = op.split_pieces(t, public.PATTERN)
        assert "".join(pieces) == t
        ids = [i for p in pieces for i in op.merge_long(p.encode(), op.read_ranks(PATH))]
        assert ids == library.encode_ordinary(t)
    long = "abcabc" * 4000 + "é" * 500
    assert op.merge_long(long.encode(), op.read_ranks(PATH)) == library.encode_ordinary(long)


def test_equal_ranks_and_borders_of_pieces(spark, library, monkeypatch):
    """Overlapping pairs of equal rank, pieces of one byte and of FOLD_BYTES, all through the fold."""
    monkeypatch.setattr(op, "FREQUENT", 1)
    sizes = [1, 2, 3, op.FOLD_BYTES - 1, op.FOLD_BYTES, op.FOLD_BYTES + 1]
    texts = [unit * n for unit in ("a", "ab", "aab", "é", "=", "字") for n in sizes] + ["x", "\U0001F600", "a é ="]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r[1:] for r in op.encode_digests(docs, PATH, public.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        assert got[k] == (len(ids), *(hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), t.encode()))), t


def test_a_step_of_the_fold_is_short(small):
    """Lambdas are interpreted, for each merge of each piece: the step has few of them (29 in the plan took 1,242 CPU seconds a GB, 8 take 641)."""
    plan = op.encode_digests(small, PATH, public.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("lambdafunction(") <= 10
