"""PCM WAV files as rows of short blocks; one file is read by as many tasks as it has byte ranges."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, block bigint, s_us bigint, e_us bigint, n bigint, sum_sq double, lo double, hi double"
ARROW = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("block", "s_us", "e_us", "n")], *[(c, pa.float64()) for c in ("sum_sq", "lo", "hi")]])

#: Blocks turned into one Arrow batch; bounds what a task holds.
BATCH_BLOCKS = 8_192


#: What opening a file counts for beside its bytes when ranges are put into one task.
OPEN_BYTES = 4_096


@dataclass
class ByteRanges(InputPartition):
    """Ranges (path, start, stop) that one task reads."""

    ranges: list[tuple[str, int, int]]


@dataclass(frozen=True)
class Layout:
    rate: int
    channels: int
    data: int
    frames: int


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def read_layout(f, size: int) -> Layout | None:
    """Where the 16-bit samples of a RIFF file lie; None for anything else. A length beyond the file ends with it."""
    head = f.read_at(12, 0)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, rate, channels = 12, 0, 0
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", f.read_at(8, at))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read_at(16, at + 8))
            if kind != 1 or bits != 16 or channels == 0 or rate == 0:
                return None
        if name == b"data":
            if rate == 0:
                return None
            return Layout(rate, channels, at + 8, min(length, size - at - 8) // (2 * channels))
        at += 8 + length + length % 2
    return None


class WavBlocks(DataSource):
    """``spark.read.format("wav_blocks").option("block_ms", 10).option("split_bytes", 67108864).load(folder_or_file)``.

    One row per block of ``block_ms`` with the mean of the channels as the signal: sum of squares (full scale 1),
    smallest and largest sample (of 16 bits). The last block of a file may be shorter and is kept. Paths are URIs or
    paths that executors reach. Files that are no 16-bit PCM give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.block_ms = int(options.get("block_ms", 10))
        self.split = int(options.get("split_bytes", 64 << 20))
        if self.block_ms < 1 or self.split < 1:
            raise ValueError("block_ms and split_bytes must be positive")

    def partitions(self) -> list[ByteRanges]:
        """Byte ranges from the listing alone: no file is opened on the driver. Small files share a task."""
        where, root = locate(self.path)
        info = where.get_file_info(root)
        files = [info] if info.is_file else where.get_file_info(fs.FileSelector(root, recursive=True))
        sizes = sorted((f.path, f.size) for f in files if f.is_file and f.extension.lower() == "wav")
        parts, room = [ByteRanges([])], self.split
        for path, size in sizes:
            for a in range(0, size, self.split):
                stop = min(a + self.split, size)
                room -= stop - a + OPEN_BYTES
                if room < 0 and parts[-1].ranges:
                    parts.append(ByteRanges([]))
                    room = self.split - (stop - a + OPEN_BYTES)
                parts[-1].ranges.append((path, a, stop))
        return parts

    def read(self, part: ByteRanges):
        for path, start, stop in part.ranges:
            yield from self._blocks(path, start, stop)

    def _blocks(self, path: str, start: int, stop: int):
        """Blocks whose first byte lies in the range, so that every block is read by exactly one task."""
        where, _ = locate(self.path)
        with where.open_input_file(path) as f:
            at = read_layout(f, f.size())
            if at is None:
                return
            size, wide = max(1, at.rate * self.block_ms // 1000), 2 * at.channels
            block_bytes = size * wide
            first = max(0, -(-(start - at.data) // block_bytes))
            last = min(-(-at.frames // size), max(0, -(-(stop - at.data) // block_bytes)))
            for b0 in range(first, last, BATCH_BLOCKS):
                b1 = min(last, b0 + BATCH_BLOCKS)
                n_frames = min(b1 * size, at.frames) - b0 * size
                x = np.frombuffer(f.read_at(n_frames * wide, at.data + b0 * block_bytes), dtype="<i2").reshape(-1, at.channels).mean(axis=1)
                starts = np.arange(0, x.size, size)
                n = np.minimum(size, x.size - starts)
                frame = starts + b0 * size
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * starts.size, pa.string()), pa.array(np.arange(b0, b0 + starts.size)), pa.array(frame * 1_000_000 // at.rate),
                    pa.array((frame + n) * 1_000_000 // at.rate), pa.array(n), pa.array(np.add.reduceat((x / 32768.0) ** 2, starts)),
                    pa.array(np.minimum.reduceat(x, starts)), pa.array(np.maximum.reduceat(x, starts)),
                ], schema=ARROW)


def register_audio(spark: SparkSession) -> None:
    spark.dataSource.register(WavBlocks)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono or (frames x channels) 16-bit file."""
    x = np.asarray(samples, dtype="<i2")
    channels = 1 if x.ndim == 1 else x.shape[1]
    data = x.tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(data)) + data
