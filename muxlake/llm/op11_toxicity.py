"""Operator 11, toxicity: a linear-chain conditional random field over the words of a text.

A word's evidence is how much oftener documents marked toxic have it, or one of its beginnings, than others do; it counts where a likelihood-ratio
test leaves no doubt. Words with evidence in toxic documents are the toxic tokens to learn from, and all words of other documents are clean
ones; the field weighs a word's evidence, that of its neighbours and its capitals, and whether neighbouring words have one label. Forward-backward
gives every word's probability of being toxic. Words of 0.5 or more make spans with their offsets, and a document's score is a logistic function
of its marginals: their sum, the highest two and their share.

Defined cases: a text without a word, or null, has no span and the score of no toxic word; without labels of both kinds to learn from every score
is the share of toxic labels, or 0 without any, and there are no spans; so is the evidence of a word that fewer than MIN_DOCS toxic
documents have; rows with a null or repeated doc_id have a result each; texts are read whole, in pieces of PIECE characters cut between words; an
empty table gives an empty result; other columns are ignored. Everything is learned from SAMPLE labelled documents at most, chosen by a hash of doc_id; of these the driver gets LEXICON words at
most, the strongest, the tokens of FIELD_DOCS documents, FIELD_TOKENS at most, and five sums of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm.chain import forward_backward
from muxlake.llm.common import documents, fold_of, map_batches, per_batch, saved, short_batches

WORD = re.compile(r"\w+")
_BREAK = re.compile(r"\W")
#: Words and beginnings with evidence: toxic documents that have them at least, odds, and how many are kept.
MIN_DOCS, MIN_ODDS, LEXICON = 4, 3.0, 20_000
#: Twice the log of the likelihood ratio is this much over twice the log of the number of words that are tested.
MARGIN = 8.0
#: Lengths of beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Labelled documents to learn from, and those of them, and their tokens, that the field is fitted to; chosen by a hash of doc_id.
SAMPLE, FIELD_DOCS, FIELD_TOKENS = 20_000, 4000, 300_000
STEPS, RATE, RIDGE = 120, 0.15, 1e-4
#: A word is tagged, and a document is predicted toxic, from this probability on.
THRESHOLD = 0.5
#: Characters of a text that are cut into words at once, and words that are labelled at once.
PIECE, WORDS_AT_ONCE = 1_000_000, 1_000_000
N_FEATURES = 6


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """Parts of a text, and where they begin; no word is cut."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield at, text[at:end]
        at = end


def keys(word: str) -> list[str]:
    """A lower-case word, and its beginnings, which end in a star."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


class Evidence:
    """Evidence of words, looked up once for each distinct word."""

    def __init__(self, known: dict[str, float]):
        self.known, self.place, self.rows = known, {}, np.zeros((1024, 3), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """Whole-word evidence, the best of the word and its beginnings, and capitals, of each word."""
        place, known = self.place, self.known
        if len(place) > 300_000:
            place.clear()
        for w in [w for w in set(words) if w not in place]:
            low, k = w.lower(), len(place)
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            own = known.get(low, 0.0)
            self.rows[k] = own, max([own, *(known[x] for x in keys(low)[1:] if x in known)]), w.isupper() and len(w) > 1
            place[w] = k
        return self.rows[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]

    def of_text(self, text: str | None) -> np.ndarray:
        parts = [self.of(WORD.findall(p)) for _, p in pieces(text or "")]
        return np.concatenate(parts) if parts else np.zeros((0, 3), np.float32)


def features(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of all words; those before a text's first and after its last count as words without evidence."""
    x = np.zeros((len(own), N_FEATURES), np.float32)
    x[:, :3] = own
    x[1:, 3], x[:-1, 4] = own[:-1, 1], own[1:, 1]
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    x[begin, 3] = 0
    x[begin + sizes[sizes > 0] - 1, 4] = 0
    x[:, 5] = own[:, 1] > 0
    return x


@dataclass(frozen=True)
class Tagger:
    """Evidence, the field's weights, bias and weight of equal labels, and the logistic weights of a document; or only a constant score."""

    known: dict[str, float]
    weights: np.ndarray
    bias: float
    same: float
    document: np.ndarray | None = None
    constant: float | None = None

    def marginals(self, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(toxic) of each word."""
        return forward_backward(features(own, sizes) @ self.weights + self.bias, self.same, sizes, pairs=False)[0]

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(sums) @ self.document, -500, 500)))


def document_sums(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: sum of the marginals, the highest and second highest of them, words tagged, words."""
    out = np.zeros((len(sizes), 5))
    begin = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    out[:, 4] = sizes
    if len(some):
        at = begin[some]
        out[some, 0] = np.add.reduceat(p, at)
        out[some, 1] = np.maximum.reduceat(p, at)
        out[some, 3] = np.add.reduceat((p >= THRESHOLD).astype(float), at)
        text = np.repeat(np.arange(len(sizes)), sizes)
        rest = p.copy()
        order = np.lexsort((-p, text))  # the first of each text in this order is its highest
        rest[order[at]] = 0.0
        out[some, 2] = np.maximum.reduceat(rest, at)
    return out


def document_features(sums: np.ndarray) -> np.ndarray:
    total = sums[:, 0]
    share = total / np.maximum(sums[:, 4], 1)
    return np.column_stack([np.minimum(total, 1), np.minimum(total, 3) / 3, np.log1p(total), sums[:, 1], sums[:, 2], np.minimum(share, 0.1) * 10, np.ones(len(sums))])


def fit_field(known: dict[str, float], own: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> Tagger:
    """Maximum likelihood of the token labels by Adam steps; toxic: labels of the texts."""
    x = features(own, sizes).astype(float)
    y = np.where(np.repeat(toxic, sizes) > 0, own[:, 1] > 0, False).astype(float)
    weight = np.full(len(y), 1.0 / max(len(y), 1))
    weight[own[:, 1] > 0] *= 20.0  # the few words that decide
    first = np.zeros(len(y), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    p = np.zeros(N_FEATURES + 2)
    p[-2] = -3.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        one, equal, _ = forward_backward(x @ p[:-2] + p[-2], p[-1], sizes)
        d = (one - y) * weight
        together = np.zeros(len(y))
        together[1:] = y[1:] == y[:-1]
        grad = np.concatenate([d @ x, [d.sum()], [((equal - together) * weight)[~first].sum()]]) + RIDGE * p
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Tagger(known, p[:-2].astype(np.float32), float(p[-2]), float(p[-1]))


def fit_documents(sums: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights of the documents' sums, by Newton steps."""
    x = document_features(sums)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.01 * len(x) ** 0.5)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - toxic) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def evidence(labelled: DataFrame) -> dict[str, float]:
    """The words and beginnings that toxic documents have more often, with their log odds; counted over all rows of labelled(toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: dict[str, list[int]] = {}

        def flush():
            columns = [pa.array(counts), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "clean", "dirty"])

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                own = {w.lower() for _, p in pieces(text.as_py() or "") for w in set(WORD.findall(p))}
                for key in {k for w in own if len(w) <= 64 for k in keys(w)}:
                    counts.setdefault(key, [0, 0])[toxic] += 1
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, dirty = n.get(0, 0), n.get(1, 0)
    counted = map_batches(labelled.select("toxic", "text"), run, "word string, clean bigint, dirty bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("dirty").alias("dirty"))
    both, share = F.col("clean") + F.col("dirty"), dirty / max(clean + dirty, 1)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * p))).otherwise(0.0)
    odds = F.log((F.col("dirty") + 0.5) / (dirty + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    ratio = 2 * (part("dirty", share) + part("clean", 1 - share))
    tested = saved(counted.where(F.col("dirty") >= MIN_DOCS).select("word", odds.alias("odds"), ratio.alias("ratio")), "evidence")
    least = MARGIN + 2 * float(np.log(max(tested.count(), 1)))
    strong = tested.where((F.col("ratio") >= least) & (F.col("odds") >= float(np.log(MIN_ODDS))))
    return {r.word: min(r.odds, 6.0) / 3 for r in strong.orderBy(F.desc("ratio"), "word").limit(LEXICON).collect()}


def labelled_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, toxic, text, text_hash) of docs(doc_id, text) for so many rows of labels(doc_id, toxic) with 0 or 1; equal rows count once."""
    own = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    few = own.distinct().orderBy(F.xxhash64("id"), "id", "toxic").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.join(F.broadcast(few), "id").dropDuplicates(["id", "toxic", "text_hash"]).select("id", "toxic", "text", "text_hash")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Tagger:
    """The tagger of docs(doc_id, text) under labels(doc_id, toxic), from a bounded sample of them. Labels other than 0 and 1 and null doc_ids are left out."""
    none = np.zeros(N_FEATURES, np.float32)
    short_batches(docs.sparkSession)
    labelled = saved(labelled_texts(docs, labels, sample), "labelled")
    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Tagger({}, none, 0.0, 0.0, None, 1.0 if n.get(1) else 0.0)
    known = Evidence(evidence(labelled))
    order = [F.xxhash64("id"), "id", "toxic", "text_hash"]
    ids = labelled.select("id", "toxic", "text_hash", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    half = [ids.where((F.col("toxic") == t) & (F.col("chars") <= FIELD_TOKENS // 20)).orderBy(*order).limit(FIELD_DOCS // 2) for t in (0, 1)]
    some = labelled.join(F.broadcast(half[0].union(half[1]).drop("chars")), ["id", "toxic", "text_hash"], "left_semi")

    def words(batch: pa.RecordBatch):
        own = [known.of_text(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), batch.column("text_hash"), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "toxic", "text_hash", "x"])

    rows = per_batch(some.repartition(16, "id"), words, "id bigint, toxic int, text_hash bigint, x binary").toArrow().sort_by([("text_hash", "ascending"), ("id", "ascending")]).select(["toxic", "x"])
    each, marks, total = [], [], 0
    for toxic, x in zip(rows.column("toxic").to_pylist(), rows.column("x").to_pylist()):
        own = np.frombuffer(x, np.float32).reshape(-1, 3)
        if total + len(own) <= FIELD_TOKENS and (not toxic or (own[:, 1] > 0).any()):
            each.append(own)
            marks.append(toxic)
            total += len(own)
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    field = fit_field(known.known, np.concatenate(each) if each else np.zeros((0, 3), np.float32), sizes, np.array(marks, int))
    fitted = labelled.join(F.broadcast(ids.orderBy(*order).limit(sample).drop("chars")), ["id", "toxic", "text_hash"], "left_semi")
    sums = tagged(fitted.select("toxic", "text"), field, keep="toxic").select("toxic", "sums").toArrow()
    values = np.array(sums.column("sums").to_pylist(), float).reshape(-1, 5)
    document = fit_documents(values, sums.column("toxic").to_numpy().astype(float))
    return Tagger(field.known, field.weights, field.bias, field.same, document)


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of tagged words: start and end in code points, and the mean of their marginals."""
    out, k, last = [], 0, -2
    hits = p >= THRESHOLD
    for base, part in pieces(text):
        for m in WORD.finditer(part):
            if hits[k]:
                if last == k - 1:
                    a, _, values = out[-1]
                    out[-1] = (a, base + m.end(), [*values, p[k]])
                else:
                    out.append((base + m.start(), base + m.end(), [p[k]]))
                last = k
            k += 1
    return [(a, b, float(np.mean(v))) for a, b, v in out]


def tagged(docs: DataFrame, tagger: Tagger, keep: str = "doc_id") -> DataFrame:
    """keep, sums of the marginals and spans(start, end, p) of each row of docs(keep, text)."""
    kind = docs.schema[keep].dataType.simpleString()
    known = Evidence(tagger.known)

    def run(batch: pa.RecordBatch):
        at = 0
        texts = batch.column("text")
        while at < batch.num_rows:
            own, sizes, own_texts, words = [], [], [], 0
            begin = at
            while at < batch.num_rows and (not own or words < WORDS_AT_ONCE):
                text = texts[at].as_py() or ""
                own_texts.append(text)
                own.append(known.of_text(text))
                sizes.append(len(own[-1]))
                words += sizes[-1]
                at += 1
            n = np.array(sizes, np.int64)
            p = tagger.marginals(np.concatenate(own), n)
            sums = document_sums(p, n)
            begins = np.cumsum(n) - n
            spans = [spans_of(t, p[b : b + k]) if s[3] else [] for t, b, k, s in zip(own_texts, begins, n, sums)]
            columns = [
                batch.column(keep).slice(begin, at - begin),
                pa.array(sums.tolist(), pa.list_(pa.float64())),
                pa.array([[{"start": a, "end": b, "p": q} for a, b, q in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [keep, "sums", "spans"])

    return per_batch(docs.select(keep, "text"), run, f"`{keep}` {kind}, sums array<double>, spans array<struct<start:bigint,end:bigint,p:double>>")


def score(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, score, predicted and spans(start, end, p) of each row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if tagger.constant is not None:
        spans = F.array().cast("array<struct<start:bigint,end:bigint,p:double>>")
        return rows.select("doc_id", F.lit(tagger.constant).alias("score"), F.lit(int(tagger.constant >= THRESHOLD)).alias("predicted"), spans.alias("spans"))
    weights = tagger.document.tolist()
    s = [F.col("sums")[k] for k in range(5)]
    share = s[0] / F.greatest(s[4], F.lit(1.0))
    terms = [F.least(s[0], F.lit(1.0)), F.least(s[0], F.lit(3.0)) / 3, F.log1p(s[0]), s[1], s[2], F.least(share, F.lit(0.1)) * 10, F.lit(1.0)]
    value = 1 / (1 + F.exp(-sum((t * w for t, w in zip(terms, weights)), F.lit(0.0))))
    out = tagged(rows, tagger).select("doc_id", value.alias("score"), "spans")
    return out.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of("doc_id", 5) != 0)
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return score(docs, learn(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
