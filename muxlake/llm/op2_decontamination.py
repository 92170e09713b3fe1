"""Operator 2, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passages to items.

A seed is a run of SEED words of an item. Spark counts in how many documents each run and each word of the items is. A run that few documents
and few items have is a seed by itself. A common run counts only together with one of the item's rarest words, so many of them that a passage without any of
them cannot reach the threshold; so common runs cost little, and no copy is lost by their being common. The passage around a hit, as long as the item and a margin,
is aligned to the item word by word, and the alignment's score over that of a perfect one decides. Passages that share too few words with the item to
reach the threshold in any order are left out first. Copies, edited and cut items are found where SEED unchanged words in a row are left.

Defined cases: null and empty texts have no hits; items without words, or null, match nothing; an item of fewer than SEED words is one
run of all of them; null and repeated doc_ids are rows like others; equal items each get their rows; empty tables give an
empty result; other columns are ignored, or kept by without_leaks whatever their names are. The items are a stated set, broadcast as sorted arrays of numbers in blocks
of about BLOCK_WORDS words; each block is held against all documents. One item is never cut: at most MAX_ITEM_WORDS words, or an error.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm.common import documents, fresh, map_batches

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of a perfect alignment's score.
THRESHOLD = 0.5
#: Item words that are broadcast at once (their numbers have to fit 21 bits), and of one item.
BLOCK_WORDS, MAX_ITEM_WORDS = 1_000_000, 500_000
#: A run is common if more than so many items have it, or more than so many documents and this share of them.
MANY_ITEMS, MANY_DOCS, MANY_SHARE = 8, 20, 0.001
#: Words of passages that are held against pairs of a common run and a word at once.
WINDOW_WORDS = 1_000_000
#: Cells of the alignments that step together.
CELLS = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, in lower case."""
    return (text or "").lower().encode("utf-8").split()


def item_blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items (item_id, text), dealt by hash to so many frames that each has about so many words; one item is never cut."""
    own = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = own.select(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))).alias("n")).first().n or 0
    blocks = -(-n // block_words)
    return [own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else own for k in range(blocks)]


def read_items(items: DataFrame) -> list[tuple[int | None, list[bytes]]]:
    return [(r.item_id, w) for r in items.collect() if (w := words_of(r.text))]


@dataclass(frozen=True)
class Postings:
    """Sorted keys; those of key k have the (item, place) from starts[k] to starts[k + 1]."""

    keys: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, item: np.ndarray, place: np.ndarray) -> "Postings":
        order = np.lexsort((place, item, keys))
        keys, starts = np.unique(keys[order], return_index=True)
        return cls(keys, np.append(starts, len(order)), item[order].astype(np.int32), place[order].astype(np.int32))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are none."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def of_keys(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places in item and place that some keys have, and for each of them which of the numbers it belongs to."""
        size = self.starts[numbers + 1] - self.starts[numbers]
        owner = np.repeat(np.arange(len(numbers)), size)
        return np.repeat(self.starts[numbers] - np.cumsum(size) + size, size) + np.arange(len(owner)), owner


@dataclass(frozen=True)
class Items:
    """A block of items as numbers of its words (from 1; 0 is any other word); runs of 1 to SEED words, by length."""

    names: list
    coded: list[np.ndarray]
    number: dict[bytes, int]
    runs: dict[int, Postings]

    @classmethod
    def of(cls, known: list) -> "Items":
        number = {w: k for k, w in enumerate(sorted({x for _, ws in known for x in ws}), 1)}
        coded = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for _, ws in known]
        by: dict[int, list] = defaultdict(list)
        for k, own in enumerate(coded):
            size = min(SEED, len(own))
            code = run_codes(own, size, len(number) + 1)
            by[size].append((code, np.full(len(code), k), np.arange(len(code))))
        return cls([i for i, _ in known], [c.astype(np.int32) for c in coded], number, {n: Postings.of(*(np.concatenate(x) for x in zip(*rows))) for n, rows in by.items()})

    def numbers_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))


def run_codes(numbers: np.ndarray, size: int, base: int) -> np.ndarray:
    """One number for each run of so many words; -1 for runs with a word that no item has."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(size):
        code = code * base + numbers[k : k + n]
        known &= numbers[k : k + n] > 0
    return np.where(known, code, -1)


@dataclass(frozen=True)
class Seeds:
    """Which runs of each length are common; and pairs of a common run and a rare word of an item."""

    common: dict[int, np.ndarray]
    pairs: dict[int, Postings]
    reach: dict[int, np.ndarray]


def rare_words(own: np.ndarray, df: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest words of an item, so many that what reaches the threshold has one of them."""
    need = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1
    words, times = np.unique(own, return_counts=True)
    order = np.lexsort((words, df[words]))
    return words[order[: np.searchsorted(np.cumsum(times[order]), need) + 1]]


def choose_seeds(items: Items, run_docs: dict[int, np.ndarray], word_docs: np.ndarray, n_docs: int, threshold: float) -> Seeds:
    """Seeds by how many documents have each run and each word."""
    rare = [rare_words(own, word_docs, threshold) for own in items.coded]
    base, common, pairs, reach = len(items.number) + 1, {}, {}, {}
    sizes = np.array([len(c) for c in items.coded])
    for n, p in items.runs.items():
        docs = run_docs[n]
        many_items = np.array([len(np.unique(p.item[a:b])) if b - a > MANY_ITEMS else 0 for a, b in zip(p.starts, p.starts[1:])]) > MANY_ITEMS
        common[n] = many_items | ((docs > MANY_DOCS) & (docs > MANY_SHARE * n_docs))
        at, owner = p.of_keys(np.flatnonzero(common[n]))
        run = np.flatnonzero(common[n])[owner]
        each = [rare[i] for i in p.item[at]]
        times = np.fromiter(map(len, each), np.int64, len(each))
        words = np.concatenate(each) if each else np.zeros(0, np.int64)
        pairs[n] = Postings.of(np.repeat(run, times) * base + words, np.repeat(p.item[at], times), np.repeat(p.place[at], times))
        reach[n] = np.zeros(len(p.keys), np.int64)
        np.maximum.at(reach[n], run, sizes[p.item[at]])
    return Seeds(common, pairs, reach)


def hits(numbers: np.ndarray, items: Items, seeds: Seeds) -> dict[int, set[int]]:
    """Places in a document where each item would begin, by the seeds that are there."""
    out: dict[int, set[int]] = defaultdict(set)
    base = len(items.number) + 1

    def add(p: Postings, keys: np.ndarray, at: np.ndarray) -> None:
        places, owner = p.of_keys(keys)
        for item, begin in set(zip(p.item[places].tolist(), (at[owner] - p.place[places]).tolist())):
            out[item].add(begin)

    for n, p in items.runs.items():
        found = p.find(run_codes(numbers, n, base))
        at = np.flatnonzero(found >= 0)
        if not len(at):
            continue
        run = found[at]
        often = seeds.common[n][run]
        add(p, run[~often], at[~often])
        at, run = at[often], run[often]
        while len(at):
            # Runs of like reach go together; a passage lies within the item and its margin on both sides.
            wide = int(seeds.reach[n][run].max())
            wide += wide // 2 + 4
            here = slice(0, max(1, WINDOW_WORDS // (2 * wide + 1)))
            window = at[here, None] + np.arange(-wide, wide + 1)
            words = np.where((window >= 0) & (window < len(numbers)), numbers[np.clip(window, 0, len(numbers) - 1)], 0)
            keys = np.where(words > 0, run[here, None] * base + words, -1)
            pair = seeds.pairs[n].find(keys.ravel())
            some = np.flatnonzero(pair >= 0)
            add(seeds.pairs[n], pair[some], at[here][some // (2 * wide + 1)])
            at, run = at[here.stop :], run[here.stop :]
    return out


def most_matches(item: Counter, passage: list[int]) -> int:
    """The words that item and passage have in common, in any order: no alignment has more matches."""
    found = Counter(passage)
    return sum(min(n, found[w]) for w, n in item.items())


def smith_waterman(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of the item in each row of passages, and the passage word after its end; padding matches nothing.

    All passages step through the item together; along a passage, gaps are a running maximum.
    """
    rows, width = passages.shape
    above = np.zeros((rows, width + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    for word in item:
        score = np.where(passages == word, MATCH, MISMATCH).astype(np.int32)
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(above[:, :-1] + score, above[:, 1:] + GAP)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        top = here.argmax(1)
        value = here[np.arange(rows), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above = here
    return best, end


_SCHEMA = "doc_id bigint, item_id bigint, text_hash bigint, score double, first int, last int"


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item that align: doc_id, item_id, text_hash, score, and the passage's words [first, last)."""
    found = [_leaks_of(docs, block, threshold) for block in item_blocks(items, block_words)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], _SCHEMA)


def counts(docs: DataFrame, shared, sizes: list[int], n_words: int) -> DataFrame:
    """(kind, k, n): the number of documents that have run k of a length (kind), or word k (kind 0), and of all documents (kind -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        total = {0: np.zeros(n_words + 1, np.int64), **{n: np.zeros(len(items.runs[n].keys), np.int64) for n in sizes}, -1: np.zeros(1, np.int64)}
        for batch in batches:
            for text in batch.column("text"):
                numbers = items.numbers_of(words_of(text.as_py()))
                total[-1] += 1
                total[0][np.unique(numbers)] += 1
                for n in sizes:
                    found = items.runs[n].find(run_codes(numbers, n, n_words + 1))
                    total[n][np.unique(found[found >= 0])] += 1
        for kind, own in total.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(own[some])], ["kind", "k", "n"])

    return map_batches(docs.select("text"), run, "kind int, k bigint, n bigint").groupBy("kind", "k").agg(F.sum("n").alias("n"))


def _leaks_of(docs: DataFrame, block: DataFrame, threshold: float) -> DataFrame:
    """find_leaks for items that are few enough to broadcast."""
    schema = _SCHEMA
    spark = docs.sparkSession
    known = read_items(block)
    if not known:
        return spark.createDataFrame([], schema)
    if (most := max(len(w) for _, w in known)) > MAX_ITEM_WORDS:
        raise ValueError(f"an item has {most} words, more than {MAX_ITEM_WORDS}")
    items = Items.of(known)
    sizes, n_words = list(items.runs), len(items.number)
    shared = spark.sparkContext.broadcast(items)
    table = counts(docs, shared, sizes, n_words).toArrow()
    found = {kind: np.zeros(size, np.int64) for kind, size in ((0, n_words + 1), (-1, 1), *((n, len(items.runs[n].keys)) for n in sizes))}
    kinds, k, n = (table.column(c).to_numpy() for c in ("kind", "k", "n"))
    for kind, own in found.items():
        own[k[kinds == kind]] = n[kinds == kind]
    chosen = spark.sparkContext.broadcast(choose_seeds(items, found, found[0], int(found[-1][0]), threshold))

    def windows(begins: set[int], size: int, n_words: int) -> list[tuple[int, int]]:
        """Passages of an item's length and a margin around the begins; those that overlap are joined up to twice that."""
        margin, out = size // 2 + 4, []
        for b in sorted(begins):
            low, high = max(0, b - margin), min(n_words, b + size + margin)
            if out and low <= out[-1][1] and high - out[-1][0] <= 3 * size + 4 * margin:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def align(todo: dict[int, list], coded: list) -> Iterator[tuple]:
        for item, passages in todo.items():
            own = coded[item]
            passages.sort(key=lambda p: len(p[1]))
            at = 0
            while at < len(passages):
                # As many as fit beside the widest of them, one at least.
                n = 1
                while at + n < len(passages) and (n + 1) * len(passages[at + n][1]) <= CELLS:
                    n += 1
                part = passages[at : at + n]
                at += n
                width = len(part[-1][1])
                block = np.full((len(part), width), -1, np.int32)
                for k, (_, p, _) in enumerate(part):
                    block[k, : len(p)] = p
                score, end = smith_waterman(own, block)
                for (row, _, low), s, e in zip(part, score.tolist(), end.tolist()):
                    if s >= threshold * MATCH * len(own):
                        yield row, item, s / (MATCH * len(own)), max(0, low + e - len(own)), low + e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = shared.value, chosen.value
        names, coded = items.names, items.coded
        for batch in batches:
            todo: dict[int, list] = defaultdict(list)
            least = {}
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = items.numbers_of(words_of(text))
                for item, begins in hits(words, items, seeds).items():
                    if item not in least:
                        least[item] = Counter(coded[item].tolist()), threshold * len(coded[item])
                    own, enough = least[item]
                    for low, high in windows(begins, len(coded[item]), len(words)):
                        passage = words[low:high].tolist()
                        if most_matches(own, passage) >= enough:
                            todo[item].append((row, passage, low))
            best: dict[tuple[int, int], tuple] = {}
            for row, item, score, first, last in align(todo, coded):
                if score > best.get((row, item), (0.0,))[0]:
                    best[row, item] = (score, first, last)
            if best:
                keys = sorted(best)
                place = pa.array([k[0] for k in keys])
                values = [best[k] for k in keys]
                columns = [batch.column("doc_id").take(place), pa.array([names[k[1]] for k in keys], pa.int64()), batch.column("text_hash").take(place)]
                columns += [pa.array([v[0] for v in values]), *(pa.array([v[j] for v in values], pa.int32()) for j in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "text_hash", "score", "first", "last"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, run, schema)


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that align with no item."""
    own, text_hash = fresh(docs, "id", "hash")
    leaks = find_leaks(docs, items, threshold).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash)).distinct()
    return docs.join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text_hash)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    leaks = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", F.round("score", 6).alias("score"), "first", "last")
