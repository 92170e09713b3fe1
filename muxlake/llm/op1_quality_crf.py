"""Operator 1, quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is good or bad. Its features are measures of its own words and of the lines before and after it;
neighbouring lines also share a weight for having the same label. Forward-backward gives each line's
probability of being good, and their mean, weighted by length, is the document's quality. The field is
fitted to documents with a label, whose lines all take it; it sees texts only.

Defined cases: a text without a word, or null, is one blank line; without labels of both kinds every score is the
share of good labels, or 0.5 without any; null and repeated doc_ids keep one result a row; texts are read whole;
an empty table gives an empty result; other columns are ignored. The driver holds the features of SAMPLE documents and SAMPLE_LINES
lines at most; a task holds about LINES_AT_ONCE lines as a few numbers each, or those of one text, and measures CHUNK lines at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.llm.chain import forward_backward
from muxlake.llm.common import documents, fold_of, per_batch, saved

#: Labelled documents that the field is fitted to, chosen by a hash of doc_id.
SAMPLE = 6000
#: Lines of these documents, taken in the order of the hash while they fit; documents of over a hundredth of that are not learned from.
SAMPLE_LINES = 600_000
#: Lines that are labelled at once, lines that are measured at once, and characters that are cut into lines at once.
LINES_AT_ONCE, CHUNK, PIECE = 400_000, 10_000, 1_000_000
STEPS, RATE, RIDGE = 150, 0.15, 1e-3
#: A document whose score is at least this is predicted good.
THRESHOLD = 0.3
N_MEASURES = 12


def line_measures(line: str) -> list[float]:
    """What one line shows of its quality; independent of its language."""
    words = line.split()
    n, chars = len(words), len(line)
    if not n:
        return [0.0] * N_MEASURES
    count = line.count
    marks = count("#") + count("$") + count("%") + count("&") + count("*") + count("<") + count(">")
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    digits = sum(map(count, "0123456789"))
    stops = count(".") + count(",") + count(";") + count("?")
    distinct = len(set(words))
    return [
        min(n, 200) ** 0.5 / 5,
        min(marks / n, 3.0),
        min(count("|") / n, 1.0),
        min(count("!") / n, 2.0),
        upper / n,
        repeats / n,
        distinct / n,
        min((chars - n + 1) / n, 30) / 10,
        digits / chars,
        min(stops / n, 1.0),
        float(line.rstrip()[-1:] in (".", "?", "!", "\"")),
        1.0,
    ]


def text_lines(text: str | None) -> list[str]:
    """The lines with a word, or one blank line."""
    return [x for x in (text or "").split("\n") if x and not x.isspace()] or [""]


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines with those of the lines around them, lines of each text, and characters of each line."""
    lines = [text_lines(t) for t in texts]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = [x for own in lines for x in own]
    own = np.array([line_measures(x) for x in flat], np.float32).reshape(-1, N_MEASURES)
    length = np.fromiter((max(len(x), 1) for x in flat), np.float64, len(flat))
    begin = np.cumsum(sizes) - sizes
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begin] = 0
    after[begin + sizes - 1] = 0
    return np.hstack([own, before, after]), sizes, length


def _line_lists(text: str | None) -> Iterator[list[str]]:
    """text_lines, a piece of the text at a time."""
    text, at, some = text or "", 0, False
    while at < len(text):
        cut = text.find("\n", at + PIECE)
        end = cut if cut >= 0 else len(text)
        lines = [x for x in text[at:end].split("\n") if x and not x.isspace()]
        some |= bool(lines)
        yield lines
        at = end + 1
    if not some:
        yield [""]


@dataclass(frozen=True)
class Field:
    """Weights of the standardised measures, bias, weight of equal labels; or only a constant score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    same: float
    constant: float | None = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The quality of each text, 0 to 1."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        w = self.weights / self.scale
        parts, length, held = [], [], []
        sizes = np.zeros(len(texts), np.int64)

        def flush() -> None:
            own = np.array(list(map(line_measures, held)), np.float32).reshape(-1, N_MEASURES)
            parts.append(own @ w.reshape(3, N_MEASURES).T)
            length.append(np.fromiter((max(len(x), 1) for x in held), np.float64, len(held)))
            held.clear()

        for k, text in enumerate(texts):
            for lines in _line_lists(text):
                sizes[k] += len(lines)
                for at in range(0, len(lines), CHUNK):
                    held += lines[at : at + CHUNK]
                    if len(held) >= CHUNK:
                        flush()
        flush()
        each, length = np.concatenate(parts), np.concatenate(length)
        begin = np.cumsum(sizes) - sizes
        unary = each[:, 0] + (self.bias - self.mean @ w)
        before, after = np.roll(each[:, 1], 1), np.roll(each[:, 2], -1)
        before[begin], after[begin + sizes - 1] = 0.0, 0.0
        unary += before + after
        good = forward_backward(unary, self.same, sizes, pairs=False)[0]
        return np.clip(np.add.reduceat(good * length, begin) / np.add.reduceat(length, begin), 0.0, 1.0)


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood of the labels, each document with weight 1, by Adam steps over all lines."""
    none = np.zeros(0)
    if not len(labels) or labels.min() == labels.max():
        return Field(none, none, none, 0.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0
    z = (x - mean) / scale
    y = np.repeat(labels, sizes).astype(float)
    weight = np.repeat(1.0 / sizes, sizes) / len(sizes)
    first = np.zeros(len(y), bool)
    first[np.cumsum(sizes) - sizes] = True
    p = np.zeros(x.shape[1] + 2)
    p[-1] = 0.5
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        good, equal, _ = forward_backward(z @ p[:-2] + p[-2], p[-1], sizes)
        d = (good - y) * weight
        grad = np.concatenate([d @ z, [d.sum()], [((equal - 1.0) * weight)[~first].sum()]]) + RIDGE * p
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        p[-1] = max(p[-1], 0.0)
    return Field(mean, scale, p[:-2], float(p[-2]), float(p[-1]))


def sampled(docs: DataFrame, labels: DataFrame, sample: int, lines: int) -> DataFrame:
    """(id, quality, text) of the documents to learn from: at most so many rows and lines, in the order of a hash of doc_id.

    Different texts of one doc_id count one by one, equal rows once.
    """
    own = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    marked = own.distinct().withColumn("place", F.xxhash64("id")).orderBy("place", "id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    found = texts.join(F.broadcast(marked), "id").dropDuplicates(["id", "quality", "text_hash"])
    n_lines = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    found = saved(found.withColumn("n_lines", n_lines), "labelled")
    order = ["place", "id", "quality", "text_hash"]
    most = found.where(F.col("n_lines") <= lines // 100).select(*order, "n_lines").orderBy(*order).limit(sample)
    total = F.sum("n_lines").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = most.withColumn("total", total).where(F.col("total") <= lines).select(*order)
    return found.join(F.broadcast(chosen), order, "left_semi").select("id", "quality", "text")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Field:
    """The field of docs(doc_id, text) under labels(doc_id, quality), from a bounded sample of labelled documents.

    Which of them are taken depends on doc_id alone. Labels other than 0 and 1 and null doc_ids are left out.
    """
    texts = sampled(docs, labels, sample, lines)

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            x, sizes, _ = measure(part.column("text").to_pylist())
            rows = [a.tobytes() for a in np.split(x, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("quality"), pa.array(rows, pa.binary())], ["id", "quality", "x"])

    rows = per_batch(texts, run, "id bigint, quality int, x binary").toArrow().sort_by([("id", "ascending"), ("quality", "ascending")])
    each = [np.frombuffer(b, np.float32).reshape(-1, 3 * N_MEASURES) for b in rows.column("x").to_pylist()]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    x = np.concatenate(each).astype(np.float64) if each else np.zeros((0, 3 * N_MEASURES))
    return fit(x, sizes, rows.column("quality").to_numpy())


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and predicted of each row of docs(doc_id, text)."""

    def run(batch: pa.RecordBatch):
        at, texts = 0, batch.column("text")
        while at < batch.num_rows:
            size, lines = 0, 0
            while at + size < batch.num_rows and lines < LINES_AT_ONCE:
                lines += 1 + (texts[at + size].as_py() or "").count("\n")
                size += 1
            part = batch.slice(at, size)
            at += size
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(field.scores(part.column("text").to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return per_batch(rows, run, "doc_id bigint, score double").select("doc_id", "score", predicted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of("doc_id", 5) != 0)
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return score(docs, learn(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
