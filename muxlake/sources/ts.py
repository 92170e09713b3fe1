"""A data source of transport stream files: `spark.read.format("ts").load(path)` gives (source, byte_offset, raw).

The driver only lists files; they are dealt in byte ranges, and each task probes its file's first bytes for packets of 188 or 204 bytes. A sync is four sync
bytes a packet apart, wherever it is sought: at the file's start, behind a loss, and a little before a range, so that neighbouring ranges agree on what they hold.
From then on packets follow each other as long as each begins with a sync byte. Each packet comes once, from the range that its first byte is in. Paths are
folders, files or patterns of any file system that Arrow knows. Streaming reads new files of a folder as they come.

Options: packet_size (probe if unset), range_mb (64), min_bytes (2040; shorter files are left out, file_report names them), recursive (false). For streams
also max_files and max_mb, which bound a batch; they need log, a folder of one query alone where the lists of its batches are kept. An offset is then a number, whatever the history.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, byte_offset bigint, raw binary"
SYNC, RUN, PROBE = 0x47, 4, 2040
#: Packets that are read at once, and that a range looks back to find its sync.
BATCH, LOOK_BACK = 4096, 64


def probe(head: bytes) -> tuple[int, int] | None:
    """(packet size, offset) of the first place with four sync bytes 204 or 188 apart, the longer size first; None without one."""
    for offset in range(len(head)):
        for size in (204, 188):
            if offset + (RUN - 1) * size < len(head) and all(head[offset + k * size] == SYNC for k in range(RUN)):
                return size, offset
    return None


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def list_files(path: str, recursive: bool = False) -> list[pa.fs.FileInfo]:
    """The .ts files of a folder (and, if told so, of the folders in it), the files of a pattern, or the file itself."""
    fs, base = file_system(path)
    if any(c in base for c in "*?["):
        folder = base.rpartition("/")[0]
        found = fs.get_file_info(pa.fs.FileSelector(folder))
        return sorted((f for f in found if f.is_file and fnmatch.fnmatch(f.path, base)), key=lambda f: f.path)
    info = fs.get_file_info(base)
    if info.type == pa.fs.FileType.Directory:
        return sorted((f for f in fs.get_file_info(pa.fs.FileSelector(base, recursive=recursive)) if f.is_file and f.path.endswith(".ts")), key=lambda f: f.path)
    return [info] if info.is_file else []


@dataclass
class Range(InputPartition):
    """Packets of a file whose first byte is in [begin, end); size 0 is probed."""

    root: str
    path: str
    begin: int
    end: int
    size: int = 0


def _first_sync(is_sync: np.ndarray, size: int) -> int | None:
    """The first place with RUN sync bytes a packet apart."""
    n = len(is_sync) - (RUN - 1) * size
    if n <= 0:
        return None
    every = is_sync[:n].copy()
    for k in range(1, RUN):
        every &= is_sync[k * size : k * size + n]
    at = int(every.argmax())
    return at if every[at] else None


def _batch(path: str, base: int, chunk: bytes, at: np.ndarray, size: int) -> pa.RecordBatch:
    """The packets of 188 bytes at some places of a chunk, which follow each other."""
    n, begin = len(at), int(at[0])
    if size == 188:
        raw = memoryview(chunk)[begin : begin + 188 * n]
    else:
        raw = np.lib.stride_tricks.as_strided(np.frombuffer(chunk, np.uint8)[begin:], (n, 188), (size, 1)).tobytes()
    ends = pa.py_buffer(np.arange(0, 188 * n + 1, 188, dtype=np.int32))
    source = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [path]).cast(pa.string())
    return pa.RecordBatch.from_arrays([source, pa.array(base + at), pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(raw)])], ["source", "byte_offset", "raw"])


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """The packets of a range, a batch at a time; a packet may reach over the range's end."""
    fs, _ = file_system(part.root)
    with fs.open_input_file(part.path) as f:
        found = probe(f.read(PROBE))
        if found is None:
            return
        size, first = part.size or found[0], found[1]
        at, synced = max(first, part.begin - LOOK_BACK * size), False
        while at < part.end:
            f.seek(at)
            chunk = f.read((BATCH + RUN) * size)
            last = len(chunk) < (BATCH + RUN) * size
            data = np.frombuffer(chunk, np.uint8)
            is_sync, k, stop = data == SYNC, 0, len(data) - (0 if last else (RUN - 1) * size)
            while k < stop and at + k < part.end:
                if not synced:
                    step = _first_sync(is_sync[k:], size)
                    if step is None:
                        k = max(k, stop)
                        break
                    k, synced = k + step, True
                places = np.arange(k, min(stop, len(data) - 187), size)
                if not len(places):
                    k = stop
                    break
                held = is_sync[k : places[-1] + 1 : size]
                n = len(places) if held.all() else int(held.argmin())
                own = places[:n]
                own = own[(at + own >= part.begin) & (at + own < part.end)]
                if len(own):
                    yield _batch(part.path, at, chunk, own, size)
                synced, k = n == len(places), k + n * size
            if last:
                return
            at += k


def _recursive(options: dict) -> bool:
    return str(options.get("recursive", "false")).lower() == "true"


def file_report(spark: SparkSession, path: str, recursive: bool = False, min_bytes: int = PROBE) -> DataFrame:
    """A row for each file: size, packet size and place of the first packet, and code: null, TOO_SHORT or NO_SYNC for files that a scan leaves out."""
    files = [(info.path, info.size) for info in list_files(path, recursive)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        for batch in batches:
            out = []
            for name, size in zip(batch.column("source").to_pylist(), batch.column("n_bytes").to_pylist()):
                with fs.open_input_file(name) as f:
                    found = probe(f.read(PROBE))
                out.append((*(found or (None, None)), "TOO_SHORT" if size < min_bytes else None if found else "NO_SYNC"))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["source", "n_bytes", "packet_size", "first_packet", "code"])

    listed = spark.createDataFrame(files, "source string, n_bytes bigint").repartition(max(1, min(len(files), 200)))
    return listed.mapInArrow(run, "source string, n_bytes bigint, packet_size int, first_packet bigint, code string")


class TsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.options = options["path"], options

    def partitions(self) -> list[Range]:
        return self.ranges(list_files(self.path, _recursive(self.options)))

    def ranges(self, files: list[pa.fs.FileInfo]) -> list[Range]:
        step = max(1, int(float(self.options.get("range_mb", 64)) * 1_000_000))
        size, least = int(self.options.get("packet_size", 0)), int(self.options.get("min_bytes", PROBE))
        return [Range(self.path, info.path, b, min(b + step, info.size), size) for info in files if info.size >= least for b in range(0, info.size, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)


class TsStreamReader(DataSourceStreamReader):
    """New files of a folder, whatever their names. A file that is gone before its batch is planned is an error.

    Without bounds the offset is the list of the files that are there. With max_files or max_mb it is the number of a sealed list in the log: a list is sealed
    when the one before has been asked for, and has the files that no list has yet, in order, as far as they fit, one at least.
    """

    def __init__(self, options: dict):
        self.options = options
        self.most_files, self.most_bytes = int(options.get("max_files", 0)), int(float(options.get("max_mb", 0)) * 1_000_000)
        self.bounded = bool(self.most_files or self.most_bytes)
        self.given, self.known, self.listed = 0, set(), 0
        if self.bounded and "log" not in options:
            raise ValueError("max_files and max_mb need a folder for the lists of batches: option log")

    def _log(self) -> tuple[pa.fs.FileSystem, str]:
        return file_system(self.options["log"])

    def _sealed(self, n: int) -> list[str]:
        fs, folder = self._log()
        with fs.open_input_file(f"{folder}/{n}.json") as f:
            return json.loads(f.read())

    def _last(self) -> int:
        fs, folder = self._log()
        fs.create_dir(folder, recursive=True)
        names = [info.base_name for info in fs.get_file_info(pa.fs.FileSelector(folder)) if info.base_name.endswith(".json")]
        return max((int(x[:-5]) for x in names), default=0)

    def _seal(self, n: int) -> bool:
        for k in range(self.listed + 1, n):
            self.known.update(self._sealed(k))
        self.listed = n - 1
        own, size = [], 0
        for info in list_files(self.options["path"], _recursive(self.options)):
            if info.path in self.known:
                continue
            if own and (len(own) == self.most_files or (self.most_bytes and size + info.size > self.most_bytes)):
                break
            own.append(info.path)
            size += info.size
        if own:
            fs, folder = self._log()
            with fs.open_output_stream(f"{folder}/.{n}") as f:
                f.write(json.dumps(own).encode())
            fs.move(f"{folder}/.{n}", f"{folder}/{n}.json")
        return bool(own)

    def initialOffset(self) -> dict:
        return {"list": 0} if self.bounded else {"files": []}

    def latestOffset(self) -> dict:
        if not self.bounded:
            return {"files": [info.path for info in list_files(self.options["path"], _recursive(self.options))]}
        n = self._last()
        if n <= self.given and self._seal(n + 1):
            n += 1
        self.given = n
        return {"list": n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        fs, _ = file_system(self.options["path"])
        if self.bounded:
            paths = [path for n in range(start["list"] + 1, end["list"] + 1) for path in self._sealed(n)]
        else:
            seen = set(start["files"])
            paths = [path for path in end["files"] if path not in seen]
        files = fs.get_file_info(paths)
        if gone := [info.path for info in files if not info.is_file]:
            raise FileNotFoundError(f"files of a planned batch are gone: {gone}")
        return TsReader(self.options).ranges(files)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)

    def commit(self, end: dict) -> None:
        pass


class TsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TsReader:
        return TsReader(dict(self.options))

    def streamReader(self, schema) -> TsStreamReader:
        return TsStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TsSource)
