"""Operator 12, hard-negative mining: a pivot table over all vectors, and blocks of anchors held against its chunks.

Components become integers (floor of SCALE times the component), and every vector gets one more coordinate that brings all of them to one length;
an anchor gets 0 there. Then the square of the Euclidean distance is a constant less twice the inner product. The table stores each row's distances to
N_PIVOTS pivots, and its rows lie in chunks of neighbours: nearest pivot, then distance to it. By the triangle inequality the anchor's and the row's pivot distances
bracket their score: a block of anchors skips chunks, an anchor skips chunks and then rows that cannot score high (or low) enough, and the survivors' scores are computed as integers.
What is high enough begins with the scores of a sample's rows and rises with the rows that a task has seen.

An anchor's positives are the first n_positives other rows of its label by score. For each of them the first n_negatives rows of other labels are returned whose score lies between
low and high hundredths of the positive's.

Defined cases: rows with a null vec_id, label, vector or component, or one that is not finite, take no part; rows that are equal in vec_id, label and integers count once, and
different rows of one vec_id count one by one, but are never positives or negatives of each other; ties go to the smaller vec_id, then to the smaller label; of vectors of different lengths the
shorter counts as filled up with zeros; fewer rows than asked for are returned as far as there are any; a score that does not fit a long is an error; an empty table gives an empty result;
other columns are ignored. The driver and the tasks hold SAMPLE rows; GROUP_BYTES of anchors are broadcast at once, and each such group reads the table once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.llm.common import map_batches, new_path, per_batch, saved

SCALE = 256
N_POSITIVES, N_NEGATIVES, LOW, HIGH = 5, 10, 30, 90
N_PIVOTS = 6
#: Rows that pivots are chosen from, and that give the first bounds; by a hash of the row.
SAMPLE = 3000
#: Rows of a chunk or a block of anchors, its bytes of integers, and bytes of anchors that are broadcast at once.
CHUNK_ROWS, CHUNK_BYTES, GROUP_BYTES = 1000, 1_000_000, 20_000_000
#: Scores that are bracketed at once.
SCORES_AT_ONCE = 1_000_000
_LEAST = -(2**63)
CHUNK = "n int, ids array<bigint>, labels array<int>, v array<bigint>, d array<double>, lo array<double>, hi array<double>"
BLOCK = f"{CHUNK}, keys array<bigint>, floors array<bigint>, tops array<bigint>, norm double, least bigint, part int"


def integers(rows: DataFrame, relabel: Column | None = None) -> DataFrame:
    """(vec_id, label, v): the rows of rows(vec_id, label, embedding) that take part, once each."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    label = (F.col("label") if relabel is None else relabel).cast("int")
    return known.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), v.alias("v")).dropDuplicates(["vec_id", "label", "v"])


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists as rows, the shorter filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * width
    if most < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    if any(not -(2**63) <= x < 2**63 for x in whole.ravel()):
        raise OverflowError("a score does not fit a long")
    return whole.astype(np.int64)


def first(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each slot: higher scores first, then smaller ids and labels."""
    order = np.lexsort((labels, ids, -score.astype(float), slot)) if np.abs(score.astype(float)).max(initial=0) < 2**52 else np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -int(score[i]), ids[i], labels[i])), np.int64)
    place = np.arange(len(order)) - np.searchsorted(slot[order], slot[order])
    return order[place < k]


@dataclass(frozen=True)
class Pivots:
    """Pivots of the augmented space: integers and last coordinate; the squared length of all vectors; the sample's ids, labels and integers."""

    points: np.ndarray
    last: np.ndarray
    length2: float
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    def extra(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.length2 - (v.astype(float) ** 2).sum(1), 0.0))

    def _products(self, v: np.ndarray) -> np.ndarray:
        width = min(v.shape[1], self.points.shape[1])
        return v[:, :width].astype(float) @ self.points[:, :width].T

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        return np.sqrt(np.maximum(2 * self.length2 - 2 * self._products(v) - 2 * np.outer(self.extra(v), self.last), 0.0))

    def of_anchors(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((v.astype(float) ** 2).sum(1)[:, None] + self.length2 - 2 * self._products(v), 0.0))


def choose(sample: list, length2: float, n: int = N_PIVOTS) -> Pivots:
    """Pivots far from each other, from a sample's rows: each is the farthest from those before."""
    v = matrix(pa.array([r.v for r in sample], pa.list_(pa.int64())))
    p = Pivots(v[:0].astype(float), np.zeros(0), length2, np.array([r.vec_id for r in sample], np.int64), np.array([r.label for r in sample], np.int64), v)
    x = np.column_stack([v.astype(float), p.extra(v)])
    near, chosen = np.full(len(x), np.inf), [0]
    while True:
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        if len(chosen) == min(n, len(x)):
            break
        chosen.append(int(near.argmax()))
    return Pivots(x[chosen, :-1], x[chosen, -1], length2, p.ids, p.labels, v)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most CHUNK_ROWS rows and about CHUNK_BYTES of integers."""
    width = max(1, int(batch.column("v").value_lengths().to_numpy(zero_copy_only=False).max(initial=1)))
    rows = int(max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * width))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _packed(part: pa.RecordBatch, v: np.ndarray, d: np.ndarray) -> dict:
    return {
        "n": len(v), "ids": part.column("vec_id").to_numpy(), "labels": part.column("label").to_numpy(),
        "v": v.ravel(), "d": d.ravel(), "lo": d.min(0), "hi": d.max(0),
    }


def _row(fields: dict, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    columns = []
    for name, kind in (f.split(" ") for f in schema.split(", ")):
        x = fields[name]
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kinds[kind].value_type)) if kind.startswith("array") else pa.array([x], kinds[kind]))
    return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in schema.split(", ")])


def pivot_table(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """Chunks of neighbouring rows of vectors(vec_id, label, v) with their pivot distances and the bounds of these."""

    def measure(batch: pa.RecordBatch):
        d = pivots.of_rows(matrix(batch.column("v")))
        columns = [*(batch.column(c) for c in ("vec_id", "label", "v")), pa.array(d.tolist(), pa.list_(pa.float64())), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "d", "cell", "near"])

    def pack(batch: pa.RecordBatch):
        for part in _cut(batch):
            yield _row(_packed(part, matrix(part.column("v")), matrix(part.column("d"))), CHUNK)

    measured = per_batch(vectors, measure, "vec_id bigint, label int, v array<bigint>, d array<double>, cell int, near double")
    dealt = measured.repartitionByRange("cell", "near", "vec_id").sortWithinPartitions("cell", "near", "vec_id")
    return per_batch(dealt, pack, CHUNK)


def blocks(anchors: DataFrame, pivots: Pivots, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    """Blocks of anchors(anchor, vec_id, label, v, positives: scores in order, or none, part).

    floors and tops have for each anchor and positive the least and highest score that a row needs; for anchors without positives one floor for the search of positives.
    """
    searching = "positives" in anchors.columns

    def pack(batch: pa.RecordBatch):
        for part in _cut(batch):
            v = matrix(part.column("v"))
            fields = _packed(part, v, pivots.of_anchors(v))
            s = scores(v, pivots.v)
            same = fields["labels"][:, None] == pivots.labels
            other = fields["ids"][:, None] != pivots.ids
            if searching:
                own = part.column("positives").to_pylist()
                floors = np.full((len(v), n_positives), 2**63 - 1)
                tops = np.full((len(v), n_positives), _LEAST)
                for k, found in enumerate(own):
                    usable = np.sort(s[k, ~same[k] & other[k]])
                    for j, p in enumerate(found):
                        floors[k, j], tops[k, j] = -(-low * p // 100), high * p // 100
                        inside = usable[np.searchsorted(usable, floors[k, j]) : np.searchsorted(usable, tops[k, j], "right")]
                        if len(inside) >= n_negatives:
                            floors[k, j] = inside[-n_negatives]
            else:
                tops = np.full((len(v), 1), 2**63 - 1)
                floors = np.full((len(v), 1), _LEAST)
                for k in range(len(v)):
                    usable = s[k, same[k] & other[k]]
                    if len(usable) >= n_positives:
                        floors[k, 0] = np.sort(usable)[-n_positives]
            more = {"keys": part.column("anchor").to_numpy(), "floors": floors.ravel(), "tops": tops.ravel(), "norm": float((v.astype(float) ** 2).sum(1).max()), "least": int(floors.min()), "part": part.column("part")[0].as_py()}
            yield _row(fields | more, BLOCK)

    return per_batch(anchors, pack, BLOCK)


class _Best:
    """The best rows of a block's slots so far; floors rise with them."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.parts, self.size = floors.copy(), k, [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.parts.append((slot, score, ids, labels))
        self.size += len(slot)
        if self.size > 4 * self.k * self.floors.size + 10_000:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, ...]:
        every = tuple(np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 4
        kept = first(*every, self.k)
        out = tuple(x[kept] for x in every)
        self.parts, self.size = [out], len(kept)
        slot, counts = np.unique(out[0], return_counts=True)
        full = slot[counts == self.k]
        last = np.cumsum(counts)[counts == self.k] - 1
        np.maximum.at(self.floors.reshape(-1), full, out[1][last])
        return out


def search(table: DataFrame, groups: DataFrame, pivots: Pivots, same_label: bool, k: int) -> DataFrame:
    """(anchor, place, id, label, score): for each anchor and each of its floors the best k rows of a task's chunks."""
    wide = table.select(*(F.col(c).alias(f"r_{c}") for c in CHUNK.replace(", ", " ").split(" ")[::2]))
    length2 = pivots.length2
    # The nearest that a row of the chunk can be to an anchor of the block has to leave room for the least score that helps.
    gaps = [F.greatest(F.col("lo")[i] - F.col("r_hi")[i], F.col("r_lo")[i] - F.col("hi")[i], F.lit(0.0)) for i in range(len(pivots.points))]
    gap = F.greatest(*gaps, F.lit(0.0))
    near = gap * gap <= (F.col("norm") + length2) * (1 + 1e-6) + 2 - 2 * F.col("least").cast("double")
    pairs = wide.join(F.broadcast(groups), near)

    def run(batches: Iterator[pa.RecordBatch]):
        found: dict[int, tuple[np.ndarray, _Best]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind, i=i: batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)  # noqa: B023, E731
                keys = get("keys", np.int64)
                n = len(keys)
                if keys[0] not in found:
                    found[keys[0]] = (keys, _Best(get("floors", np.int64).reshape(n, -1), k))
                best = found[keys[0]][1]
                rows = [get(f"r_{c}", t) for c, t in (("ids", np.int64), ("labels", np.int64), ("v", np.int64), ("d", float))]
                _compare([get(c, t) for c, t in (("ids", np.int64), ("labels", np.int64), ("v", np.int64), ("d", float), ("tops", np.int64))], rows, get("r_lo", float), get("r_hi", float), best)
        for keys, best in found.values():
            slot, score, ids, labels = best.reduce()
            places = best.floors.shape[1]
            columns = [pa.array(keys[slot // places]), pa.array((slot % places).astype(np.int32)), pa.array(ids), pa.array(labels.astype(np.int32)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "place", "id", "label", "score"])

    def _compare(block: list, rows: list, lo: np.ndarray, hi: np.ndarray, best: _Best) -> None:
        q_ids, q_labels, q, dq, tops = block
        ids, labels, v, d = rows
        n, m = len(q_ids), len(ids)
        q, v, tops = q.reshape(n, -1), v.reshape(m, -1), tops.reshape(n, -1)
        dq, d = dq.reshape(n, -1), d.reshape(m, -1)
        floor, top = best.floors.min(1).astype(float), tops.max(1).astype(float)
        length = (q.astype(float) ** 2).sum(1) + length2
        slack = length * 1e-6 + 1
        gap = np.maximum(np.maximum(dq - hi, lo - dq), 0.0).max(1, initial=0.0)
        alive = np.flatnonzero(((length - gap**2) / 2 + slack >= floor) & (floor <= top))
        for a in range(0, len(alive), step := max(1, SCORES_AT_ONCE // m)):
            k_alive = alive[a : a + step]
            nearest, farthest = np.zeros((len(k_alive), m)), np.full((len(k_alive), m), np.inf)
            for i in range(d.shape[1]):
                own = dq[k_alive, i, None]
                np.maximum(nearest, np.abs(own - d[:, i]), out=nearest)
                np.minimum(farthest, own + d[:, i], out=farthest)
            high = (length[k_alive, None] - nearest**2) / 2 + slack[k_alive, None]
            low = (length[k_alive, None] - farthest**2) / 2 - slack[k_alive, None]
            match = (q_labels[k_alive, None] == labels) == same_label
            maybe = match & (q_ids[k_alive, None] != ids) & (high >= floor[k_alive, None]) & (low <= top[k_alive, None])
            some_q, some_r = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
            if not len(some_q):
                continue
            exact = scores(q[k_alive[some_q]], v[some_r])
            maybe = maybe[np.ix_(some_q, some_r)]
            places = tops.shape[1]
            for j in range(places):
                anchor = k_alive[some_q]
                x, y = np.nonzero(maybe & (exact >= best.floors[anchor, j, None]) & (exact <= tops[anchor, j, None]))
                if len(x):
                    best.add(anchor[x] * places + j, exact[x, y], ids[some_r[y]], labels[some_r[y]])

    return map_batches(pairs, run, "anchor bigint, place int, id bigint, label int, score bigint")


def _searched(table: DataFrame, every: DataFrame, n_groups: int, pivots: Pivots, same_label: bool, k: int, name: str) -> DataFrame:
    """The best k rows of each anchor and place over all chunks, with their rank; a group of blocks at a time."""
    path = new_path(table.sparkSession, name)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "label")
    for g in range(n_groups):
        found = search(table, every.where(F.col("part") % n_groups == g), pivots, same_label, k)
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).write.mode("append").parquet(path)
    return table.sparkSession.read.schema("anchor bigint, place int, id bigint, label int, score bigint, rank int").parquet(path)


def mine(
    rows: DataFrame, is_anchor: Column, relabel: Column | None = None, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH, sample: int = SAMPLE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows(vec_id, label, embedding).

    is_anchor: over vec_id; relabel: the label to take, over vec_id and label.
    """
    spark = rows.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    vectors = saved(integers(rows.select("vec_id", "label", "embedding"), relabel), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    length2, width, n_anchors = vectors.agg(F.max(squares), F.max(F.size("v")), F.count_if(is_anchor)).first()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    some = vectors.orderBy(F.xxhash64("vec_id", "label", "v"), "vec_id", "label").limit(sample).collect()
    pivots = choose(some, length2 + 1.0)
    table = saved(pivot_table(vectors, pivots), "pivots")
    n_groups = -(-n_anchors * (8 * max(width, 1) + 200) // GROUP_BYTES)
    n_parts = max(n_groups, -(-n_anchors // CHUNK_ROWS))
    numbered = vectors.where(is_anchor).repartition(n_parts).withColumn("part", F.spark_partition_id())
    anchors = saved(numbered.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    asked = (n_positives, n_negatives, low, high)
    firsts = saved(blocks(anchors, pivots, *asked), "blocks")
    positives = _searched(table, firsts, n_groups, pivots, True, n_positives, "positives")
    listed = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).getField("score").alias("positives"))
    seconds = saved(blocks(anchors.join(listed, "anchor").repartition(n_parts, "part"), pivots, *asked), "blocks")
    negatives = _searched(table, seconds, n_groups, pivots, False, n_negatives, "negatives")
    pairs = positives.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    pairs = pairs.select("anchor", "anchor_id", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of the embeddings; the label of each seventh vec_id moves on by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, moved)


#: DuckDB SQL of the query, by brute force.
ORACLE_SQL = f"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {N_POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {N_NEGATIVES}"""
