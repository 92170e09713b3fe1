"""Operator 9, language identification: word scores, script ranges and a Viterbi pass over the words of a text.

The model counts hashed letter trigrams for each language over all texts to learn from. A word's score in a language is the
sum of its trigrams' log probabilities; languages that hardly use the word's script are out. Viterbi with a
penalty for each switch labels every word, so that mixed texts fall into spans; the text's language is the
one with most letters.

Defined cases: a null text and one without a letter give `und` with score 0 and no spans, and so does every text if there
is nothing to learn from; a null doc_id is held out of nothing and not learned from; ties go to the first language in
order of its name; texts are read whole; an empty table gives an empty result; other columns are ignored. The driver holds CELLS counts: trigrams
share buckets, the more the more languages there are, and beyond the thousands of languages that there are (CELLS / LEAST_BUCKETS) it is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm.common import documents, fold_of, per_batch

#: Hashed trigrams: buckets at most and at least, and counts of all languages together.
BUCKETS, LEAST_BUCKETS, CELLS = 1 << 16, 1 << 8, 1 << 23
#: Nats that a change of language costs.
SWITCH = 12.0
#: A language is out for a script that has less than this share of its letters.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
#: Characters that are scored at once, and words that are labelled at once.
CHARS_AT_ONCE, WORDS_AT_ONCE = 1_000_000, 1_500_000

# First code points of script ranges; what lies before is Latin, and gaps count with the range before them.
RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"),
)
_FIRST = np.array([r[0] for r in RANGES])
_SCRIPTS = sorted({r[1] for r in RANGES})
_SCRIPT_OF = np.array([_SCRIPTS.index(r[1]) for r in RANGES])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, each after a space, and the place of each text's first."""
    joined = " " + " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, np.cumsum(lengths + 1) - lengths


def _lower(codes: np.ndarray) -> np.ndarray:
    """Each code point's lower case where that is one code point."""
    high = int(codes.max(initial=0))
    if high < 0x80:
        return np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    distinct, place = np.unique(codes, return_inverse=True)
    small = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in distinct.tolist()]
    return np.array(small, np.uint32)[place]


def _trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters, and the bucket of the trigram around each; other characters count as a space."""
    letter = _is_letter(codes)
    plain = np.where(letter, _lower(codes), 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    mixed = plain[at - 1] * _MIX[0] ^ plain[at] * _MIX[1] ^ plain[at + 1] * _MIX[2]
    mixed ^= mixed >> np.uint64(29)
    return at, ((mixed * _MIX[0]) >> np.uint64(48)).astype(np.int64) % BUCKETS


def _script(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT_OF[np.searchsorted(_FIRST, codes, "right") - 1]


def _slices(texts: list[str], most: int):
    """Ranges of texts with about so many characters, one text at least."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


@dataclass(frozen=True)
class Model:
    """languages; log probability of a bucket in each; whether a language uses a script; log prior."""

    languages: tuple[str, ...]
    scores: np.ndarray
    uses: np.ndarray
    prior: np.ndarray


def n_buckets(languages: int) -> int:
    """The most buckets, a power of two, for which all languages' counts fit CELLS."""
    return max(LEAST_BUCKETS, min(BUCKETS, 1 << (CELLS // languages).bit_length() - 1))


def learn(rows: DataFrame) -> Model | None:
    """The model of rows(text, lang); null texts and languages are left out. None if nothing is left."""

    known = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    most = CELLS // LEAST_BUCKETS
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(most + 1).collect())
    if not languages:
        return None
    if len(languages) > most:
        raise ValueError(f"more than {most} languages to learn from")
    buckets = n_buckets(len(languages))
    place = {x: k for k, x in enumerate(languages)}

    def count(batch: pa.RecordBatch):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        by: dict[str, list[str]] = {}
        for t, lang in zip(texts, langs):
            by.setdefault(lang, []).append(t)
        for lang, own in by.items():
            total = np.zeros(buckets + len(_SCRIPTS), np.int64)
            for a, b in _slices(own, CHARS_AT_ONCE):
                codes, _ = _codes(own[a:b])
                at, bucket = _trigrams(codes)
                total[:buckets] += np.bincount(bucket % buckets, minlength=buckets)
                total[buckets:] += np.bincount(_script(codes[at]), minlength=len(_SCRIPTS))
            some = np.flatnonzero(total)
            columns = [pa.array(np.full(len(some) + 1, place[lang], np.int32)), pa.array([*some.tolist(), -1], pa.int32()), pa.array([*total[some].tolist(), len(own)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "bucket", "n"])

    table = per_batch(known, count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((buckets + len(_SCRIPTS) + 1, len(languages)))
    counts[table.column("bucket").to_numpy(), table.column("k").to_numpy()] = table.column("n").to_numpy()
    grams, scripts, n = counts[:buckets] + SMOOTHING, counts[buckets:-1], counts[-1]
    scores = np.log(grams / grams.sum(0)).astype(np.float32)
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    uses |= ~uses.any(1, keepdims=True)
    return Model(tuple(languages), scores, uses, np.log(n / n.sum()).astype(np.float32))


def word_scores(model: Model, texts: list[str]):
    """For all words of the texts: scores, text, first code point in the text, length."""
    codes, first = _codes(texts)
    at, bucket = _trigrams(codes)
    if not len(at):
        return np.zeros((0, len(model.languages)), np.float32), *(np.zeros(0, np.int64) for _ in range(3))
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    scores = np.add.reduceat(model.scores[bucket % len(model.scores)], begins, axis=0)
    start = at[begins]
    scores[~model.uses[_script(codes[start])]] -= 1e4
    text = np.searchsorted(first, start, "right") - 1
    return scores, text, start - first[text], np.diff(begins, append=len(at))


def viterbi(scores: np.ndarray, sizes: np.ndarray, prior: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of sequences that lie end to end, sizes[k] words in the k-th; all step forward together."""
    n, states = scores.shape
    order = np.argsort(-sizes, kind="stable")
    begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    longest = int(size[0]) if len(size) else 0
    active = len(size) - np.searchsorted(size[::-1], np.arange(longest), "right")
    kind = np.uint8 if states <= 256 else np.uint16
    came = np.zeros((n, states), kind)
    own = np.arange(states, dtype=kind)
    last = np.zeros(len(size), np.int64)
    value = np.zeros((len(size), states))
    for t in range(longest):
        k = active[t]
        rows = begin[:k] + t
        if t:
            value = value[:k]
            best = value.argmax(1)
            top = np.take_along_axis(value, best[:, None], 1) - switch
            came[rows] = np.where(value >= top, own, best[:, None].astype(kind))
            value = np.maximum(value, top) + scores[rows]
        else:
            value = scores[rows] + prior
        done = active[t + 1] if t + 1 < longest else 0
        if done < k:
            last[done:k] = value[done:k].argmax(1)
    labels = np.zeros(n, kind)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = begin[:k] + t
        labels[rows] = last[:k]
        last[:k] = came[rows, last[:k]]
    return labels


def identify(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the letters) and spans(start, end, lang) of docs(doc_id, text)."""
    languages = pa.array([*(model.languages if model else ()), "und"])
    schema = "doc_id bigint, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"

    def label(texts: list[str]):
        parts = [(a, *word_scores(model, texts[a:b])) for a, b in _slices(texts, CHARS_AT_ONCE)]
        scores = np.concatenate([p[1] for p in parts])
        text, start, length = (np.concatenate([p[k] + (p[0] if k == 2 else 0) for p in parts]) for k in (2, 3, 4))
        labels = viterbi(scores, sizes := np.bincount(text, minlength=len(texts)), model.prior, switch)
        states = len(model.languages)
        letters = np.bincount(text * states + labels.astype(np.int64), length, len(texts) * states).reshape(-1, states)
        best, total = letters.argmax(1), letters.sum(1)
        share = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
        new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(labels.astype(np.int32), prepend=-1) != 0))
        end = np.append(new[1:], len(text)) - 1 if len(new) else new
        spans = (start[new], (start + length)[end], labels[new], np.bincount(text[new], minlength=len(texts)))
        return np.where(sizes > 0, best, states), share, spans

    def run(batch: pa.RecordBatch):
        for a, b in _slices(every := [t or "" for t in batch.column("text").to_pylist()], 6 * WORDS_AT_ONCE):
            ids = batch.column("doc_id").slice(a, b - a)
            if model:
                best, share, (start, end, lang, n) = label(every[a:b])
            else:
                best, share, start, end, lang, n = np.zeros(b - a, int), np.zeros(b - a), *(np.zeros(0, int),) * 3, np.zeros(b - a, int)
            fields = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), languages.take(pa.array(lang))]
            spans = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "lang"])
            )
            yield pa.RecordBatch.from_arrays([ids, languages.take(pa.array(best)), pa.array(share, pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of all documents, learned where crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir)
    model = learn(docs.where(fold_of("doc_id", 4) != 2))
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
