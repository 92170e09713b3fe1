"""Operator 8, byte-level BPE: texts to ids and back by a file of ranked merges.

Words are counted over all documents, and the pieces of the FREQUENT most frequent ones are encoded once and broadcast. A task splits its
documents and keeps each other piece of a block of documents once, as parts of one byte each. Spark's higher-order functions fold the merges
over its array of parts: the pair of lowest rank becomes one part until no pair has a rank. Ranks come from a constant table, looked up by
hash. Decoding takes each id's bytes from a constant array. Only counts are shuffled; memory follows the block, not the partition.

Pieces of more than FOLD_BYTES bytes are merged with a heap instead, because the fold takes quadratic time in them.

Defined cases: a null text is the empty one (no ids); null and repeated doc_ids keep one result a row; texts are read whole; an
empty table gives an empty result; other columns are ignored, or carried along by with_ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from muxlake.llm.common import documents, map_batches, per_batch, short_batches

#: A part of a piece is one number: its id in ID bits, its place among the parts in PLACE bits, and the rank of its pair with the next part.
ID, PLACE = 20, 8
NO_RANK = 1 << ID
#: A pair's key is its first id times KEY plus its second, above ID bits for its rank. It is in one of two places of the rank table, modulo these primes.
KEY, PRIMES = 1_500_007, (262_139, 262_133)
#: What the rank table holds where no pair is: a bit above all keys.
NO_ENTRY = 1 << 62
PLACES = ((1 << PLACE) - 1) << ID
#: What stands before the first part, in place 0: an id that no piece has. It is the least of all numbers when no pair has a rank.
FRONT = NO_RANK << ID + PLACE | NO_RANK - 1
LONGEST = 1 << 30
FOLD_BYTES = 200
#: Bytes of the texts of a block.
BLOCK_BYTES = 8_000_000
#: The most frequent words, whose pieces are encoded once for all blocks: so many at most, whatever the corpus.
FREQUENT = 400_000
#: Distinct words that a task counts before it hands the counts on.
COUNTED_AT_ONCE = 100_000

# The characters of Unicode's White_Space; letters and numbers of the ranges that re splits itself.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(r"[\t\n\r -~\xa0-\u017f]*")
_splitters: dict[str, tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces of a rank file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def split_pieces(text: str, pattern: str) -> list[str]:
    """All matches of the pattern, \\s being Unicode's white space.

    Texts of Latin characters only go through re with the classes written out, which is several times as fast.
    """
    if pattern not in _splitters:
        import regex

        exact = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        latin = exact.replace(r"[^" + _SPACE + r"\p{L}\p{N}]", f"[^{_SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]")
        latin = latin.replace(r"\p{L}", f"[{_LATIN_LETTERS}]").replace(r"\p{N}", f"[{_LATIN_NUMBERS}]")
        _splitters[pattern] = re.compile(latin), regex.compile(exact)
    latin, exact = _splitters[pattern]
    return (latin if _LATIN.fullmatch(text) else exact).findall(text)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: lowest rank first, leftmost of equal ones, with a heap and linked parts."""
    ends = list(range(1, len(piece) + 1))
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    alive = [True] * len(piece)
    heap: list[tuple[int, int, int]] = []

    def offer(k: int) -> None:
        j = after[k]
        if j < len(piece):
            rank = ranks.get(piece[k : ends[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, k, ends[j]))

    for k in range(len(piece) - 1):
        offer(k)
    while heap:
        _, k, end = heapq.heappop(heap)
        j = after[k] if alive[k] else len(piece)
        if j >= len(piece) or ends[j] != end:
            continue
        ends[k], alive[j], after[k] = end, False, after[j]
        if after[k] < len(piece):
            before[after[k]] = k
        offer(k)
        if before[k] >= 0:
            offer(before[k])
    return [ranks[piece[k : ends[k]]] for k in range(len(piece)) if alive[k]]


def _two_places(keys: dict[int, int]) -> np.ndarray:
    """A table with each key and its rank in one of the key's two places; what is in the way moves to its other place."""
    table = [-1] * max(PRIMES)
    for key, rank in keys.items():
        entry, place = key | rank, key % PRIMES[0]
        for _ in range(1000):
            entry, table[place] = table[place], entry
            if entry < 0:
                break
            one, two = ((entry >> ID << ID) % p for p in PRIMES)
            place = two if place == one else one
        else:
            raise ValueError("the rank table is too full")
    return np.where(np.array(table) < 0, NO_ENTRY, table)


class RankMap:
    """Arrays of a rank file: first ids of bytes, ranks of pairs of bytes, the ranks of pairs of ids, and ids in decimal and their bytes.

    An entry of the pairs' table is a key with the rank in its lowest bits; a key is in either of its two places. Every block carries that
    table as a column: as a literal of the query it would be printed, 3 MB at each mention, in every text of its plan.
    """

    SCHEMA = "pairs array<bigint>"
    NAMES = ["pairs"]

    def __init__(self, ranks: dict[bytes, int]):
        by_rank = {r: p for p, r in ranks.items()}
        if max(by_rank) >= NO_RANK - 1:
            raise ValueError(f"ids of more than {ID} bits, or the last of them")
        keys = {
            ranks[piece[:k]] * KEY + ranks[piece[k:]] << ID: rank
            for piece, rank in ranks.items()
            for k in range(1, len(piece))
            if piece[:k] in ranks and piece[k:] in ranks
        }
        self.columns = [pa.array([_two_places(keys)], pa.list_(pa.int64()))]
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), NO_RANK) for b in range(256)] for a in range(256)], np.int32)
        self.decimal = pa.array([b"%d," % r for r in range(max(by_rank) + 1)], pa.binary())
        self.pieces = pa.array([by_rank.get(r, b"") for r in range(max(by_rank) + 1)], pa.binary())

    def parts(self, raw: list[bytes]) -> pa.ListArray:
        """What the fold starts from, for each piece: FRONT and a part for each byte. Nothing for no bytes."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ranks = np.full(len(data), NO_RANK, np.int64)
        ranks[:-1] = self.of_bytes[data[:-1], data[1:]]
        ranks[np.cumsum(sizes)[sizes > 0] - 1] = NO_RANK  # the last byte of a piece has no next one
        sizes += sizes > 0
        ends = np.cumsum(sizes)
        place = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
        out = np.full(len(place), FRONT, np.int64)
        out[place > 0] = (ranks << PLACE | place[place > 0]) << ID | self.first[data]
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))

    @staticmethod
    def encode(parts: Column) -> Column:
        """The ids of a piece, from its parts.

        The fold's state is the array of parts. Its minimum is the pair of lowest rank, the leftmost of equal ones, or FRONT; what
        stands before that pair and what has taken its place get new ranks, what comes after it moves up a place. All of this
        is interpreted, and each let or fold copies its array, so a step has one let and four small arrays.
        """
        above = lambda rank: F.shiftleft(rank, ID + PLACE)
        id_of = lambda x: x.bitwiseAND(NO_RANK - 1)
        key = lambda a, b: F.shiftleft(a * KEY + b, ID)
        none, one = F.lit(NO_RANK).cast("bigint"), F.lit(1 << ID).cast("bigint")
        # An entry with the key taken off is the rank where the keys are equal, and more than NO_RANK elsewhere.
        entry = lambda key, prime: F.get(F.col("pairs"), (key % prime).cast("int")).bitwiseXOR(key)
        ranked = lambda key, rest: above(F.least(*(entry(key, p) for p in PRIMES), none)) + rest

        def merge(s: Column, p: Column) -> Column:
            last, low = F.get(s, p - 1), F.get(s, p)
            new = F.shiftright(low, ID + PLACE)
            keys = F.array(key(id_of(last), new), key(new, id_of(F.get(s, p + 2))))
            rest = F.array(last.bitwiseAND(PLACES | NO_RANK - 1), low.bitwiseAND(PLACES) + new)
            after = F.transform(F.slice(s, p + 3, F.lit(LONGEST)), lambda x: x - one)
            return F.flatten(F.array(F.slice(s, F.lit(1), p - 1), F.zip_with(keys, rest, ranked), after))

        def step(s: Column, _: Column) -> Column:
            place = F.shiftright(F.array_min(s).bitwiseAND(PLACES), ID).cast("int")
            let = lambda body: F.aggregate(F.array(place), F.array().cast("array<bigint>"), lambda _, p: body(p))
            return let(lambda p: F.when(p == 0, s).otherwise(merge(s, p)))

        # So many steps as there are pairs: the array tells no more than that.
        pairs = F.slice(parts, F.lit(3), F.lit(LONGEST))
        return F.transform(F.slice(F.aggregate(pairs, parts, step), F.lit(2), F.lit(LONGEST)), lambda x: id_of(x).cast("int"))

    def decode(self, ids: pa.ListArray) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """For each list of ids: the ids in decimal with a comma behind each, their number, and the bytes that they decode to."""
        bounds, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten()

        def joined(values: pa.Array) -> pa.Array:
            taken = values.take(flat)
            offsets = np.frombuffer(taken.buffers()[1], np.int32)[bounds]
            return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), taken.buffers()[2] or pa.py_buffer(b"")])

        return joined(self.decimal), np.diff(bounds).astype(np.int64), joined(self.pieces)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole texts of docs; words are what stands between ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").encode("utf-8").split())
                if len(counts) >= COUNTED_AT_ONCE:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    parts = map_batches(docs.select("text"), run, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def frequent_pieces(docs: DataFrame, pattern: str, table: RankMap, most: int) -> pa.Table:
    """piece and ids of the pieces of the most frequent words of all texts, as they are after a space.

    The driver holds a few pieces for each of so many words.
    """
    top = count_words(docs).where(F.octet_length("word") < FOLD_BYTES).orderBy(F.desc("n"), "word").limit(most)

    def split(batch: pa.RecordBatch):
        words = [x.decode("utf-8") for x in batch.column(0).to_pylist()]
        pieces = list({p for w in words for p in split_pieces(f" {w}", pattern)})
        whole = pa.array([0, len(pieces)], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, x) for x in (pa.array(pieces, pa.string()), table.parts([x.encode("utf-8") for x in pieces]))]
        yield pa.RecordBatch.from_arrays([*lists, *table.columns], ["piece", "words", *RankMap.NAMES])

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = per_batch(top.select("word").repartition(width), split, f"piece array<string>, words array<array<bigint>>, {RankMap.SCHEMA}")
    each = F.explode(F.arrays_zip("piece", "ids")).alias("x")
    found = _folded(rows, "piece").select(each).select("x.*").toArrow()
    return found.filter(pa.array(~found.column("piece").to_pandas().duplicated()))


def _folded(blocks: DataFrame, *keep: str) -> DataFrame:
    """The ids of the words of every block."""
    return blocks.select(*keep, F.transform("words", lambda w: RankMap.encode(w)).alias("ids"))


_BLOCK = f"docs binary, words array<array<bigint>>, long array<binary>, uses array<binary>, {RankMap.SCHEMA}"
_held: dict[str, tuple] = {}


def _unpacked(broadcast, kind: str, unpack):
    """What a worker makes of a broadcast, made once; that of an earlier query goes."""
    key, value = broadcast.value
    if _held.get(kind, (None,))[0] != key:
        _held[kind] = key, unpack(value)
    return _held[kind][1]


def _numbered(pieces: pa.Array) -> dict[str, int]:
    return {x: k for k, x in enumerate(pieces.to_pylist())}


def _ends(taken: pa.Array, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """All bytes of an array, and where in them each of some ranges of its values ends."""
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1]
    return memoryview(taken.buffers()[2] or b""), offsets[bounds]


def _blocks(docs: DataFrame, pattern: str, table: RankMap, frequent, keep: list[str], block_bytes: int) -> DataFrame:
    """A row for each block: its documents' kept columns, its distinct pieces that are not frequent, and each document's places.

    Places count the frequent pieces first.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            begin = 0
            for k, n in enumerate(pa.compute.binary_length(batch.column(place)).to_pylist(), 1):
                size += n or 0
                if size >= block_bytes:
                    yield block([*held, batch.slice(begin, k - begin)])
                    held, begin, size = [], k, 0
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield block(held)
        _held.clear()

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        known = _unpacked(frequent, "pieces", _numbered)
        first = len(known)
        uses = []
        for t in rows.column(place):
            pieces = split_pieces(t.as_py() or "", pattern)
            for x in set(pieces).difference(known):
                known[x] = len(known)
            uses.append(np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces)).tobytes())
        own = list(islice(known, first, None))
        for x in own:
            del known[x]
        raw = [x.encode("utf-8") for x in own]
        words = table.parts([x if len(x) <= FOLD_BYTES else b"" for x in raw])
        sink = pa.BufferOutputStream()
        kept = rows.select(keep)
        with pa.ipc.new_stream(sink, kept.schema) as w:
            w.write_batch(kept)
        columns = [
            pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), words),
            pa.array([[x for x in raw if len(x) > FOLD_BYTES]], pa.list_(pa.binary())),
            pa.array([uses], pa.list_(pa.binary())),
            *table.columns,
        ]
        return pa.RecordBatch.from_arrays(columns, ["docs", "words", "long", "uses", *RankMap.NAMES])

    return map_batches(docs, run, _BLOCK)


def _encoded(docs: DataFrame, keep: list[str], path: str, pattern: str, schema: str, finish, most: int, block_bytes: int) -> DataFrame:
    """finish(kept columns, numbers of ids, and bytes with the ends of each document: written ids and decoded text) of every block, as batches of the schema, a part of a block at a time."""
    ranks = read_ranks(path)
    table = RankMap(ranks)
    short_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    common, key = frequent_pieces(docs, pattern, table, most), uuid.uuid4().hex
    pieces, encoded = (share((key, common.column(c).combine_chunks())) for c in ("piece", "ids"))
    folded = _folded(_blocks(docs, pattern, table, pieces, keep, block_bytes), "docs", "long", "uses")

    def run(batch: pa.RecordBatch):
        common = _unpacked(encoded, "encoded", table.decode)
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            written, n, data = table.decode(row.column("ids").flatten())
            long = iter(row.column("long")[0].as_py())
            if len(row.column("long")[0]):
                w, d = written.to_pylist(), data.to_pylist()
                for j in np.flatnonzero(n == 0):
                    ids = merge_long(next(long), ranks)
                    w[j], n[j], d[j] = (",".join(map(str, ids)) + ",").encode(), len(ids), b"".join(table.pieces.take(pa.array(ids)).to_pylist())
                written, data = pa.array(w, pa.binary()), pa.array(d, pa.binary())
            rows = pa.ipc.open_stream(row.column("docs")[0].as_buffer()).read_next_batch()
            written, data = (pa.concat_arrays([a, b]) for a, b in ((common[0], written), (common[2], data)))
            n = np.concatenate([common[1], n])
            places = row.column("uses")[0].values
            for at in range(0, rows.num_rows, 500):
                uses = [np.frombuffer(x.as_buffer(), np.int32) for x in places.slice(at, 500)]
                bounds = np.cumsum([0, *map(len, uses)])
                u = np.concatenate(uses)
                counts = np.diff(np.concatenate([[0], np.cumsum(n[u])])[bounds])
                yield finish(rows.slice(at, 500), counts, *(_ends(x.take(pa.array(u)), bounds) for x in (written, data)))

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch)
        _held.clear()

    return map_batches(folded, run_all, schema)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs(doc_id, text)."""

    def finish(rows: pa.RecordBatch, counts: np.ndarray, written: tuple, data: tuple) -> pa.RecordBatch:
        ids = [hashlib.sha256(written[0][a : max(a, b - 1)]).hexdigest() for a, b in pairwise(written[1].tolist())]
        texts = [hashlib.sha256(data[0][a:b]).hexdigest() for a, b in pairwise(data[1].tolist())]
        columns = [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _encoded(rows, ["doc_id"], path, pattern, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", finish, FREQUENT, BLOCK_BYTES)


def with_ids(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """docs with two more columns: ids (array<int>) and decoded (the text that the ids stand for), under names that docs does not have.

    Its blocks hold whole rows, so they and the broadcast pieces are smaller than those of encode_digests.
    """

    def finish(rows: pa.RecordBatch, counts: np.ndarray, written: tuple, data: tuple) -> pa.RecordBatch:
        values = np.fromstring(bytes(written[0][written[1][0] : written[1][-1]]), np.int32, sep=",")
        tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(values))
        texts = [str(data[0][a:b], "utf-8") for a, b in pairwise(data[1].tolist())]
        names = [*rows.schema.names, ids, decoded]
        return pa.RecordBatch.from_arrays([*rows.columns, tokens, pa.array(texts, pa.string())], names)

    if taken := {ids.lower(), decoded.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns called {sorted(taken)}")
    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())])
    return _encoded(docs, docs.columns, path, pattern, schema, finish, FREQUENT // 4, BLOCK_BYTES // 2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents and what they decode to."""
    import public_tokenizers as public

    return encode_digests(documents(spark, sf_dir), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
