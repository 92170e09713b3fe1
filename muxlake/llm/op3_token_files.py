"""Operator 3, token ids as binary files: Arrow IPC files of fixed-size-list batches.

Each file holds the ids of one range of doc_id, end to end, cut into sequences of equal length: a batch has
a row for each sequence, its ids as fixed_size_list<uint16>[L] (uint32 for more than 65,536 ids) and its mask as
fixed_size_list<bool>[L] (true: a token, false: fill at the end of the file; one bit each). All buffers have a fixed place, so sequence k of a memory-mapped
file is read without copying. A second, small Arrow file beside it has a row for each document: doc_id,
first token in the file, tokens.

Defined cases: a null text is the empty one (only the end id); a null doc_id comes first; rows that share a doc_id
are kept, in the order of their text, over as many tasks and files as they need; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.llm.chunk_encoder import ChunkEncoder
from muxlake.llm.common import documents, file_system, map_batches, new_path, shared_dir

#: A file's place is its task's range and its number in it.
MANIFEST = "part int, number int, file string, first_doc bigint, n_docs bigint, n_tokens bigint"
#: Characters of a text that deal rows of one doc_id to ranges; the driver samples them, so they are few.
DEALT_BY = 64


def write_sequences(sink, tokens: np.ndarray, length: int, rows_per_batch: int) -> None:
    """Write ids as an Arrow file of equal-length sequences and masks."""
    schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(tokens.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
    with pa.ipc.new_file(sink, schema) as writer:
        for at in range(0, len(tokens), length * rows_per_batch):
            part = tokens[at : at + length * rows_per_batch]
            rows = -(-len(part) // length)
            ids = np.zeros(rows * length, tokens.dtype)
            mask = np.zeros(rows * length, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)]
            writer.write_batch(pa.record_batch(lists, schema=schema))


def read_tokens(source) -> np.ndarray:
    """All ids under the mask; a view of the file's own memory where it has one batch."""
    reader = pa.ipc.open_file(source)
    parts = []
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids, mask = batch.column("input_ids").flatten(), batch.column("mask").flatten()
        ids = ids.to_numpy(zero_copy_only=True)
        parts.append(ids if mask[-1].as_py() else ids[: mask.true_count])
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def sequence(source, k: int, rows_per_batch: int = 64) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence k, both views of the file's own memory where source is a memory map."""
    batch = pa.ipc.open_file(source).get_batch(k // rows_per_batch)
    ids, mask = (batch.column(c)[k % rows_per_batch].values for c in ("input_ids", "mask"))
    return ids.to_numpy(zero_copy_only=True), mask


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048, rows_per_batch: int = 64, file_bytes: int = 64 << 20
) -> DataFrame:
    """Encode docs(doc_id, text) and write them under folder in ascending doc_id order; returns the manifest.

    A task closes a file after file_bytes of ids, so its memory is bounded whatever its range holds. A file gets its
    name when it is whole; a task that is run again writes new names, and only names in the manifest count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        held: list[bytes] = []
        ids: list[int | None] = []
        encoder, end, size, number = ChunkEncoder.of(tokenizer), np.uint32(end_id).tobytes(), 0, 0
        task = TaskContext.get().partitionId()
        kind = np.uint16 if max(encoder.n_ids - 1, end_id) < 1 << 16 else np.uint32

        def close() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            index = {"doc_id": pa.array(ids, pa.int64()), "first": pa.array(np.cumsum(lengths) - lengths), "n_tokens": pa.array(lengths)}
            with fs.open_output_stream(f"{base}/{name}.index.arrow") as f:
                table = pa.table(index)
                with pa.ipc.new_file(f, table.schema) as w:
                    w.write_table(table)
            with fs.open_output_stream(f"{base}/{name}.part") as f:
                write_sequences(f, np.frombuffer(b"".join(held), np.uint32).astype(kind, copy=False), length, rows_per_batch)
            fs.move(f"{base}/{name}.part", f"{base}/{name}.arrow")
            row = {"part": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "file": [name], "first_doc": pa.array(ids[:1], pa.int64()), "n_docs": [len(ids)], "n_tokens": [int(lengths.sum())]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = encoder.encode(part.column("text").to_pylist())
                for doc_id, x in zip(part.column("doc_id").to_pylist(), packed):
                    held.append(x + end)
                    ids.append(doc_id)
                    size += len(x) + 4
                    if size >= file_bytes:
                        yield close()
                        held, ids, size, number = [], [], 0, number + 1
        if held:
            yield close()

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_docs = ordered.repartitionByRange(parts, "doc_id", F.substring("text", 1, DEALT_BY)).sortWithinPartitions("doc_id", "text")
    manifest = map_batches(sorted_docs, write, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files that the manifest names.

    The manifest has one row a file of tens of MB, so the running total over it is small.
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("file_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("file", "file_start"))):
                path = f"{base}/{name}.arrow"
                local = fs.type_name == "local" and os.path.exists(path)
                with pa.memory_map(path) if local else fs.open_input_file(path) as f:
                    tokens = read_tokens(f)
                    with fs.open_input_file(f"{base}/{name}.index.arrow") as g:
                        index = pa.ipc.open_file(g).read_all().combine_chunks()
                    first, n = (index.column(c).to_numpy() for c in ("first", "n_tokens"))
                    crc = [zlib.crc32(tokens[a : a + m].astype("<u4")) for a, m in zip(first, n)]
                    columns = [index.column("doc_id").combine_chunks(), pa.array(first + start), pa.array(n), pa.array(crc, pa.int64())]
                yield from pa.Table.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches()

    files = starts.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return map_batches(files, read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as token files and read back."""
    import public_tokenizers

    folder = new_path(spark, "token-files")
    assert folder.startswith(shared_dir(spark))
    manifest = write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest, folder)
