"""Operator 7, n-gram Jaccard join: documents whose sets of word n-grams are similar.

Documents of one set form a node. MinHash bands, their number and rows chosen for a target recall at the threshold, are shuffled on their
hashes; nodes that share a band are tied to the smallest of them, and ties give candidate groups. A small group is one block. A large one is
dealt to blocks in the cheaper of two ways: by hash, and all pairs of its blocks meet; or each node with the largest band bucket it is in, and two
blocks meet only where some bucket has nodes of both. All pairs of blocks that meet are verified on the full sets. A task takes a pair of blocks, so that no
task holds a group and no pair of documents becomes a row: a task returns each node's number of links and a spanning forest of them.

Result: a row for each document with class_id, the smallest doc_id of its connected component, and n_links, the other
documents that are similar to it, copies counted one by one.

Defined cases: a text with fewer than n words, but some, is one n-gram of all of them; a text without words, or null, has no
links and a class of its own; a null doc_id takes part, and class_id is null only where all of a class are null;
repeated rows are copies of each other; an empty table gives an empty result; other columns are ignored or, in
first_of_each_class, kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm.common import cols, documents, fresh, map_batches, per_batch, saved
from muxlake.llm.components import components
from muxlake.llm.shingles import mixed, ngram_sets, slices

N, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9995, 256
#: A block of a candidate group has about so many nodes and n-grams at most.
BLOCK_NODES, BLOCK_NGRAMS = 400, 400_000
_GROUP = ["low", "high"]


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which so many bands find a pair at the threshold with this probability."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p == 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def band_hashes(ngrams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band, of the smallest values of its rows' hash functions; no two bands share hashes."""
    rng = np.random.default_rng(77)
    k = bands * rows
    factor = (rng.integers(0, 1 << 32, k, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
    shift = rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32)[:, None]
    small = np.full(k, 0xFFFFFFFF, np.uint32)
    values = (ngrams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 1024):
        part = values[at : at + 1024] * factor
        part += shift
        part ^= part >> np.uint32(15)
        np.minimum(small, (part * np.uint32(0x2C1B3C6D)).min(1), out=small)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in small.reshape(bands, rows).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def set_key(ngrams: np.ndarray) -> bytes:
    return hashlib.blake2b(ngrams.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, key of the set (null for none), n_ngrams and band hashes of every row."""

    def run(batch: pa.RecordBatch):
        every = batch.column("text").to_pylist()
        for a, b in slices(every):
            sets = ngram_sets(every[a:b], n)
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            signed = pa.array([band_hashes(s, bands, rows).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a), keys, sizes, signed],
                ["doc_id", "text_hash", "key", "n_ngrams", "bands"],
            )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return per_batch(rows_in, run, "doc_id bigint, text_hash bigint, key binary, n_ngrams bigint, bands binary")


def _band_rows(nodes: DataFrame) -> DataFrame:
    """(key, band) of all bands of the nodes."""

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            each = [np.frombuffer(x, np.int64) for x in part.column("bands").to_pylist()]
            place = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([part.column("key").take(place), pa.array(np.concatenate(each))], ["key", "band"])

    return per_batch(nodes.select("key", "bands"), run, "key binary, band bigint")


def _ties(nodes: DataFrame) -> DataFrame:
    """Edges from each node to the smallest node that shares a band hash with it."""
    rows = _band_rows(nodes)
    first = rows.groupBy("band").agg(F.min("key").alias("a"), F.max("key").alias("last")).where("a <> last").select("band", "a")
    return rows.join(first, "band").where("key <> a").select("a", F.col("key").alias("b")).distinct()


def blocks(nodes: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, rep, n_copies, block) of the grouped nodes, and (block, low, high): the pairs of blocks that each block is dealt to."""
    parts = lambda df, key: df.groupBy(key).agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n_ngrams") / BLOCK_NGRAMS)).cast("int").alias("n_parts")
    )
    sized = groups.join(nodes.select(F.col("key").alias("node"), "rep", "n_copies", "n_ngrams"), "node")
    sized = saved(sized.join(parts(sized, "label"), "label"), "grouped")
    whole = lambda df, cut: df.select("node", "rep", "n_copies", cut.alias("block"))
    alone = lambda df: df.select("block", F.col("block").alias("low"), F.col("block").alias("high")).distinct()
    placed = whole(sized.where("n_parts = 1"), F.xxhash64("label"))
    large = sized.where("n_parts > 1")
    if large.isEmpty():
        return placed, alone(placed)
    # One way: a block of each part of a group, and all pairs of them.
    cut = lambda key, part: F.xxhash64(key, part.cast("long"))
    plain = large.select("label", "node", "rep", "n_copies", cut("label", F.pmod(F.xxhash64("node"), F.col("n_parts"))).alias("block"))
    numbers = large.select("label", "n_parts").distinct().select("label", "n_parts", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("k"))
    two = numbers.select("label", "k", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("j"))
    plain_deals = two.select("label", cut("label", F.col("k")).alias("block"), cut("label", F.least("k", "j")).alias("low"), cut("label", F.greatest("k", "j")).alias("high"))
    # The other: blocks of band buckets, and the pairs of them that some bucket has nodes of.
    bands = _band_rows(nodes.join(large.select(F.col("node").alias("key")), "key", "left_semi"))
    counts = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(bands.join(counts, "band").select(F.col("key").alias("node"), "band", "n"), "shared-bands")
    cells = large.drop("n_parts").join(shared.groupBy("node").agg(F.max_by("band", F.struct("n", "band")).alias("cell")), "node")
    by_cell = cells.join(parts(cells, "cell"), "cell")
    by_cell = saved(by_cell.select("label", "node", "rep", "n_copies", cut("cell", F.pmod(F.xxhash64("node"), F.col("n_parts"))).alias("block")), "blocks")
    touched = shared.join(by_cell.select("node", "label", "block"), "node").select("label", "band", "block").distinct()
    sets = touched.groupBy("label", "band").agg(F.sort_array(F.collect_list("block")).alias("b")).where(F.size("b") > 1)
    firsts = sets.select("label", "b", F.explode(F.sequence(F.lit(0), F.size("b") - 2)).alias("k"))
    pairs = firsts.select("label", F.get("b", F.col("k")).alias("low"), F.explode(F.slice("b", F.col("k") + 2, F.size("b"))).alias("high"))
    pairs = saved(pairs.distinct(), "block-pairs")
    own = by_cell.select("label", "block", F.col("block").alias("low"), F.col("block").alias("high")).distinct()
    cell_deals = own.union(pairs.select("label", "low", "low", "high")).union(pairs.select("label", "high", "low", "high"))
    # Each group goes the way that deals fewer texts: a chain of texts by its buckets, a dense group by all pairs.
    texts = by_cell.groupBy("label", "block").agg(F.count("*").alias("n")).join(cell_deals.groupBy("block").agg(F.count("*").alias("d")), "block")
    costs = texts.groupBy("label").agg(F.sum(F.col("n") * F.col("d")).alias("by_cell")).join(large.groupBy("label").agg(F.sum("n_parts").alias("plain")), "label")
    chains = saved(costs.where("by_cell < plain").select("label"), "chains")
    pick = lambda one, other: one.join(chains, "label", "left_semi").union(other.join(chains, "label", "left_anti"))
    return placed.union(whole(pick(by_cell, plain), F.col("block"))), alone(placed).union(pick(cell_deals, plain_deals).drop("label"))


def _similar(sets: list[np.ndarray], block: np.ndarray, two: bool, threshold: float) -> np.ndarray:
    """Which pairs are similar: all of one block, or only those between two blocks."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    if two:
        linked &= block[:, None] != block[None, :]
    return linked


def _verify(keys: list[bytes], copies: np.ndarray, block: np.ndarray, two: bool, texts: list[str], n: int, threshold: float):
    """Rows (node, links, other): links counts copies; other is a node of the same part of the forest, or null.

    two: the task has a pair of blocks. One of them may have no node, and then there is no pair between them.
    """
    if two and block.min() == block.max():
        return [], [], []
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    own = sorted(first.values())
    keys, copies, block = [keys[i] for i in own], copies[own], block[own]
    sets: list[np.ndarray] = []
    picked = [texts[i] for i in own]
    for a, b in slices(picked):
        sets += ngram_sets(picked[a:b], n)
    if len(sets) < 2:
        return [], [], []
    linked = _similar(sets, block, two, threshold)
    links = linked @ copies
    part = np.arange(len(keys))
    while True:
        new = np.minimum(part, np.where(linked, part[None, :], len(keys)).min(1))
        new = new[new]
        if (new == part).all():
            break
        part = new
    some = np.flatnonzero(links > 0)
    return [keys[i] for i in some], links[some].tolist(), [keys[part[i]] if part[i] != i else None for i in some]


def _links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, other) of all tasks; the texts of grouped nodes are read again and dealt to their pairs of blocks."""
    placed, deals = blocks(nodes, groups)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    own = placed.join(deals, "block")
    dealt = own.join(texts, F.col("rep.doc_id").eqNullSafe(F.col("id")) & (F.col("rep.text_hash") == F.col("text_hash"))).select(
        "low", "high", "node", "n_copies", "block", "text"
    )
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(width, *_GROUP).sortWithinPartitions(*_GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def close():
            keys, copies, block, texts = zip(*held)
            found = _verify(list(keys), np.array(copies, np.int64), np.array(block), group[0] != group[1], list(texts), n, threshold)
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary())], ["node", "links", "other"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_GROUP, "node", "n_copies", "block", "text")]
            for row in zip(*columns):
                if row[:2] != group:
                    if held:
                        yield close()
                    held, group = [], row[:2]
                held.append(row[2:])
        if held:
            yield close()

    return map_batches(dealt, run, "node binary, links bigint, other binary")


def similarity_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash, class_id, n_links and label (a class's node, null without words) of each row of docs(doc_id, text)."""
    bands, rows = choose_bands(threshold, recall)
    signed = saved(_signatures(docs, n, bands, rows), "signatures")
    nodes = saved(
        signed.where("key IS NOT NULL").groupBy("key").agg(
            F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "text_hash")).alias("rep"),
            F.max("n_ngrams").alias("n_ngrams"), F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    found = saved(_links(docs, nodes, components(_ties(nodes)), n, threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    forest = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_node = (
        nodes.select(F.col("key").alias("node"), "n_copies", F.col("rep.doc_id").alias("first_doc"))
        .join(forest, "node", "left").join(links, "node", "left")
        .select("node", "n_copies", "first_doc", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    smallest = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_doc"))
    of_node = of_node.drop("first_doc").join(smallest, of_node.node == smallest.key).drop("key")
    classes = of_node.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    known = of_node.join(classes, "label").select("node", "label", "class_id", (F.col("links") + F.col("n_copies") - 1).alias("n_links"))
    return signed.join(known, signed.key == known.node, "left").select(
        "doc_id", "text_hash", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "label",
    )


def first_of_each_class(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, of the smallest doc_id (null: last), and all rows without words; the columns of docs."""
    rows = similarity_classes(docs, n, threshold).groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("n_rows"))
    rows = saved(rows, "class-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n_rows")
    one = rows.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("r")).select("r.doc_id", "r.text_hash", "r.n_rows")
    rest = rows.where("label IS NULL").select("doc_id", "text_hash", F.lit(1).cast("long").alias("n_rows"))
    own, text_hash, n_rows = fresh(docs, "id", "hash", "rows")
    keep = one.union(rest).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash), F.col("n_rows").alias(n_rows))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text_hash))
    kept = docs.join(keep, same)
    single = kept.where(F.col(n_rows) == 1).select(*cols(*docs.columns))
    return single.union(kept.where(F.col(n_rows) > 1).select(*cols(*docs.columns)).dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes and links of all documents."""
    return similarity_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")
