"""WAV files as a Spark data source: ranges of samples as rows, read by as many tasks as the bytes are worth.

`spark.dataSource.register(PcmSource)`, then `spark.read.format("pcm").option(...).load(folder)`. Options:
range (samples a row, 960,000), every (of the ranges only each n-th; the others are skipped by seeking, never read),
begin and end (seconds; ranges count from begin), split (bytes a task, 64 MB). Files are split as text files are: a task
takes the ranges whose first byte lies in its part, whatever the header says, so that the driver only lists names and sizes.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The widths that recordings have, and what a full swing is in each.
SCALE = {2: 32768.0, 4: 2147483648.0}
SCHEMA = "path string, start long, rate int, channels int, samples array<float>"


@dataclass(frozen=True)
class Sound:
    rate: int
    channels: int
    width: int
    at: int  # first byte of the samples
    n: int  # samples of each channel


@dataclass
class Parts(InputPartition):
    pieces: list[tuple[str, int, int]]  # (path, first byte, byte after the last)


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "/", path))


def header(file, size: int) -> Sound:
    """What a RIFF header says. A data chunk that claims more than the file has (cut, or written as a stream) ends with the file.

    Anything but linear PCM of 16 or 32 bits is an error that says so.
    """
    file.seek(0)
    if (head := file.read(12))[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    sound, at = None, 12
    while at + 8 <= size:
        file.seek(at)
        kind, length = struct.unpack("<4sI", file.read(8))
        if kind == b"fmt ":
            sound = struct.unpack("<HHIIHH", file.read(16))
        elif kind == b"data":
            if sound is None:
                break
            code, channels, rate, _, _, bits = sound
            if code not in (1, 0xFFFE) or bits // 8 not in SCALE or not channels:
                raise ValueError(f"Unsupported sample width: {bits // 8} (format {code}, {channels} channels)")
            return Sound(rate, channels, bits // 8, at + 8, min(length, size - at - 8) // (bits // 8 * channels))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def samples(file, sound: Sound, start: int, n: int) -> np.ndarray:
    """Samples from `start` on as 32-bit floats within [-1, 1], channels averaged; none past the end."""
    n = min(n, sound.n - start)
    if n <= 0 or start < 0:
        return np.empty(0, np.float32)
    frame = sound.width * sound.channels
    file.seek(sound.at + start * frame)
    x = np.frombuffer(file.read(n * frame), f"<i{sound.width}")
    if sound.channels > 1:
        x = x.reshape(-1, sound.channels).mean(1)
    return x.astype(np.float32) / np.float32(SCALE[sound.width])


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcmReader:  # noqa: ANN001
        return PcmReader(dict(self.options))


class PcmReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range, self.every, self.split = int(options.get("range", 960_000)), int(options.get("every", 1)), int(options.get("split", 64 << 20))
        self.begin, self.end = float(options.get("begin", 0)), float(options.get("end", "inf"))
        if min(self.range, self.every, self.split) < 1 or self.begin < 0:
            raise ValueError("range, every and split are at least 1, begin at least 0")

    def partitions(self) -> list[Parts]:
        """Parts of files of at most `split` bytes; small files share one. A folder is listed with all below it."""
        files, at = located(self.path)
        info = files.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
        out, room = [], 0
        for f in sorted((f for f in found if f.is_file and f.extension.lower() == "wav" and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            for low in range(0, f.size, self.split):
                high = min(f.size, low + self.split)
                if high - low > room:
                    out.append(Parts([]))
                    room = self.split
                out[-1].pieces.append((f.path, low, high))
                room -= high - low
        return out or [Parts([])]

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.path)
        names = ["path", "start", "rate", "channels", "samples"]
        for path, low, high in partition.pieces:
            with files.open_input_file(path) as file:
                try:
                    sound = header(file, file.size())
                except ValueError as wrong:
                    raise ValueError(f"{path}: {wrong}") from None
                frame = sound.width * sound.channels
                first = math.ceil(self.begin * sound.rate)
                last = sound.n if self.end == math.inf else min(sound.n, math.ceil(self.end * sound.rate))
                # the ranges whose first byte lies in [low, high)
                near = max(0, -(-(low - sound.at - first * frame) // (self.range * frame)))
                k = -(-near // self.every) * self.every
                while (start := first + k * self.range) < last and sound.at + start * frame < high:
                    x = samples(file, sound, start, min(self.range, last - start))
                    held = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([sound.rate], pa.int32()), pa.array([sound.channels], pa.int32()), held], names)
                    k += self.every


def write_wav(rows: DataFrame, file: str, order: str, channels: list[str], folder: str, width: int = 2, rate: int = 16_000) -> int:
    """A WAV file in the folder for each value of the column `file`, integer columns as channels, in order; the number of files.

    One task holds one file, so give long recordings in pieces. A file becomes visible by one rename: a task that
    runs twice leaves the same file. Nulls are silence; values beyond the width are an error.
    """

    def put(key, x):  # noqa: ANN001
        import uuid

        import pandas as pd

        x = x.sort_values(order, kind="stable")
        values = x[channels].fillna(0).to_numpy("int64")
        if len(values) and max(values.max(), -1 - values.min()) >= SCALE[width]:
            raise ValueError(f"{key[0]}: a value does not fit {8 * width} bits")
        body = values.astype(f"<i{width}").tobytes()
        frame = width * len(channels)
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, len(channels), rate, rate * frame, frame, 8 * width, b"data", len(body))
        files, at = located(folder)
        files.create_dir(at, recursive=True)
        hidden = f"{at}/_{uuid.uuid4().hex}.wav"
        with files.open_output_stream(hidden) as out:
            out.write(head + body)
        files.move(hidden, f"{at}/{key[0]}.wav")
        return pd.DataFrame({"file": [str(key[0])]})

    return rows.select(file, order, *channels).groupBy(file).applyInPandas(put, "file string").count()
