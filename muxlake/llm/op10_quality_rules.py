"""Operator 10, quality rules: counts of a text, and the lines that too many documents of one host share.

Normalised lines (lower case, single spaces) are hashed, and for each host the distinct documents of a line
are counted. Documents are told apart by their contents (a digest of all normalised lines in their order), so exact copies
count as one and do not condemn the lines of the document they copy; near copies count one by one. Lines above the limit are
removed; a document that loses too much is rejected.

Defined cases: a null text has no words and fails; a null host is the host ''; null and repeated doc_ids
keep one result a row, each by its own host; texts of any length are read whole; an empty table gives an empty result; other
columns are ignored, or carried along by clean_documents whatever their names are.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm.common import cols, documents, fresh, per_batch, saved

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A line that more documents of its host have is removed.
MAX_LINE_DOCS = 12
#: A document that keeps fewer words than this share, or than this number, after a removal is depleted.
MIN_SHARE_LEFT = 0.2
MIN_WORDS_LEFT = 5

_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], np.uint64)
_MEASURES = (
    "doc_id bigint, host string, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, content bigint, lines array<struct<line:bigint,words:int>>"
)


def line_hash(line: str) -> int:
    """xxhash64 (seed 42, signed) of the normalised line; 0 where it has no word."""
    normal = b" ".join(line.lower().encode("utf-8").split())
    return _signed(normal) if normal else 0


def _signed(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that the text has twice or more, the first of them included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = n - WINDOW + 1
    window = h[:m] * _ODD[0]
    for k in range(1, WINDOW):
        window += h[k : m + k] * _ODD[k]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    edge[:m] += twice
    edge[WINDOW : WINDOW + m] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def _measure(text: str):
    words = text.encode("utf-8").split()
    lines = text.split("\n")
    first: set[str] = set()
    dup = 0
    hashes: list[int] = []
    counts: list[int] = []
    for line in lines:
        normal = b" ".join(line.lower().encode("utf-8").split())
        if not normal:
            continue
        if line in first:
            dup += 1
        else:
            first.add(line)
        hashes.append(_signed(normal))
        counts.append(normal.count(b" ") + 1)
    found: dict[int, int] = {}
    for h, n in zip(hashes, counts):
        found[h] = found.get(h, 0) + n
    measures = (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        _signed(np.array(hashes, np.int64).tobytes()),
    )
    return measures, found


def _measures(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, 2000):
        part = batch.slice(at, 2000)
        texts = [t or "" for t in part.column("text").to_pylist()]
        rows = [_measure(t) for t in texts]
        offsets = np.cumsum([0, *(len(f) for _, f in rows)]).astype(np.int32)
        line = list(chain.from_iterable(f for _, f in rows))
        n_words = list(chain.from_iterable(f.values() for _, f in rows))
        entries = pa.StructArray.from_arrays([pa.array(line, pa.int64()), pa.array(n_words, pa.int32())], ["line", "words"])
        columns = [part.column("doc_id"), part.column("host"), part.column("text_hash")]
        columns += [pa.array(c, pa.int64()) for c in zip(*(m for m, _ in rows))]
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), entries))
        names = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines"]
        yield pa.RecordBatch.from_arrays(columns, names)


def judged(docs: DataFrame, max_line_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """A row for each row of docs(doc_id, text, source): its host, measures, base_failed, kept, and the lines to remove.

    The lines above the limit are saved, so Spark knows their size: it broadcasts them where they are few.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host_of("source").alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    measured = saved(per_batch(rows, _measures, _MEASURES).withColumn("row", F.monotonically_increasing_id()), "measures")
    lines = measured.select("row", "host", "content", F.explode("lines").alias("l")).select("row", "host", "content", "l.line", "l.words")
    often = saved(
        lines.select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") > max_line_docs).select("host", "line"),
        "often",
    )
    removed = (
        lines.join(often, ["host", "line"], "left_semi")
        .groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_set("line")).alias("removed"))
    )
    n_removed = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    left = F.col("n_words") - n_removed
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    depleted = (n_removed > 0) & ((left < F.col("n_words") * MIN_SHARE_LEFT) | (left < MIN_WORDS_LEFT))
    return measured.join(removed, "row", "left").select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), n_removed.alias("n_removed_words"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
    )


def host_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def clean_documents(docs: DataFrame, max_line_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """The rows of docs that are kept, all columns, their texts without the removed lines and n_chars counted anew."""
    names = docs.columns
    own, host, text_hash, removed = fresh(docs, "id", "host", "hash", "removed")
    # A verdict depends on host and text alone, so equal rows share one and the join multiplies none.
    verdict = judged(docs, max_line_docs).where("kept").select(
        F.col("doc_id").alias(own), F.col("host").alias(host), F.col("text_hash").alias(text_hash), F.col("removed").alias(removed)
    ).dropDuplicates([own, host, text_hash])
    joined = docs.join(
        verdict,
        F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (host_of("source") == F.col(host)) & (F.xxhash64("text") == F.col(text_hash)),
    )
    place = names.index("text")

    def strip(batch: pa.RecordBatch):
        texts = batch.column(place).to_pylist()
        gone = batch.column(len(names)).to_pylist()
        for k, lost in enumerate(gone):
            if lost:
                drop = set(lost)
                texts[k] = "\n".join(x for x in texts[k].split("\n") if line_hash(x) not in drop)
        kept = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays(kept, names)

    out = per_batch(joined.select(*cols(*names, removed)), strip, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the rules."""
    return judged(documents(spark, sf_dir)).drop("host", "text_hash", "removed")
