"""Packet captures (pcap files) as tables and streams of frames.

A folder holds captures that other processes write and may still append to, one for each interface and span of time. A stream's
offset is the number of bytes taken of each file, always at the end of a record, so a batch that is run again after a
restart reads the same records and no record is read twice. A record that is not yet whole waits for its rest.

pkt_id holds a file's number, in the order in which the stream met the files (in one listing by name), and the record's place in
it, so records of one time keep their order. iface is the file's name without its ending.
"""

from __future__ import annotations

import json
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..config import FlowConfig
from ..operators.dissect import decode_frames
from ..schema import FRAMES

#: Fixed values of the format: the magic numbers of micro- and nanoseconds, bytes of the file's header and a record's.
MICROS, NANOS, FILE_HEAD, RECORD_HEAD = 0xA1B2C3D4, 0xA1B23C4D, 24, 16
#: Bits of pkt_id for the place in a file; bytes read at once; records of a batch.
PLACE_BITS, READ_BYTES, BATCH = 43, 1 << 22, 1_000


@dataclass
class Share(InputPartition):
    """The bytes from one record's start to another's of a file."""

    path: str
    number: int
    start: int
    end: int | None


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _kind(head: bytes) -> tuple[str, int] | None:
    """Byte order and nanoseconds of a unit of a capture; None for a file that has no whole header or is none."""
    for order in "<>":
        if len(head) >= FILE_HEAD and (magic := struct.unpack_from(f"{order}I", head)[0]) in (MICROS, NANOS):
            return order, 1 if magic == NANOS else 1000
    return None


def _records(file: pa.NativeFile, start: int, end: int | None, bodies: bool) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, time, frame) of the whole records from start up to end; frames only if bodies."""
    file.seek(0)
    kind = _kind(file.read(FILE_HEAD))
    end = min(end, file.size()) if end is not None else file.size()
    if kind is None:
        return
    order, unit = kind
    at, data, base = max(start, FILE_HEAD), b"", 0
    while at + RECORD_HEAD <= end:
        if not (base <= at and at + RECORD_HEAD <= base + len(data)):
            file.seek(at)
            base, data = at, file.read(READ_BYTES)
        seconds, fraction, size, _ = struct.unpack_from(f"{order}IIII", data, at - base)
        body = at + RECORD_HEAD
        if body + size > end:
            return
        frame = b""
        if bodies:
            frame = data[body - base : body - base + size]
            if len(frame) < size:
                file.seek(body)
                frame = file.read(size)
        yield at, body + size, seconds * 1_000_000_000 + fraction * unit, frame
        at = body + size


def _listed(folder: str) -> dict[str, str]:
    """Name and path of the files of a folder, by name."""
    fs, path = _opened(folder)
    found = fs.get_file_info(pafs.FileSelector(path))
    prefix = folder.rstrip("/")
    return {f.base_name: f"{prefix}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}


def _frames(share: Share) -> Iterator[pa.RecordBatch]:
    fs, path = _opened(share.path)
    name = share.path.rpartition("/")[2].rpartition(".")
    rows: list[tuple[int, int, bytes]] = []

    def batch() -> pa.RecordBatch:
        ids, times, frames = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(times, pa.int64()), pa.array(frames, pa.binary()), pa.array([name[0] or name[2]] * len(rows), pa.string())], FRAMES.names)

    with fs.open_input_file(path) as file:
        for at, _, ts, frame in _records(file, share.start, share.end, True):
            rows.append((share.number << PLACE_BITS | at, ts, frame))
            if len(rows) == BATCH:
                yield batch()
                rows.clear()
    if rows:
        yield batch()


class _Table(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[Share]:
        return [Share(path, k, 0, None) for k, path in enumerate(_listed(self.folder).values())]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return _frames(partition)


class _Stream(DataSourceStreamReader):
    """Offsets: {"files": a JSON text of name: [number, bytes taken]}."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        for name, path in _listed(self.folder).items():
            number, end = self.known.get(name, [len(self.known), 0])
            fs, p = _opened(path)
            with fs.open_input_file(p) as file:
                for _, end, _, _ in _records(file, end, None, False):  # noqa: B020
                    pass
            if end:
                self.known[name] = [number, end]
        return {"files": json.dumps(self.known)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        for name, known in after.items():
            if known[1] > self.known.get(name, [0, 0])[1]:
                self.known[name] = known
        return [Share(f"{self.folder.rstrip('/')}/{name}", number, before.get(name, [0, 0])[1], taken) for name, (number, taken) in after.items() if taken > before.get(name, [0, 0])[1]]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return _frames(partition)


class CaptureSource(DataSource):
    """The format "capture" for spark.read and spark.readStream; path names the folder."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> StructType:
        return FRAMES

    def reader(self, schema: StructType) -> _Table:
        return _Table(self.options["path"])

    def streamReader(self, schema: StructType) -> _Stream:  # noqa: N802
        return _Stream(self.options["path"])


def _registered(spark: SparkSession) -> SparkSession:
    """Sends the source by value, as Spark's planning processes do not get the package's archive."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CaptureSource)
    return spark


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of all captures of a folder: pkt_id, ts_ns, frame, iface; a task a file."""
    return _registered(spark).read.format("capture").load(folder)


def stream_captures(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the frames of a folder's captures, and of what is appended to them."""
    return _registered(spark).readStream.format("capture").load(folder)


def stream_captured_packets(spark: SparkSession, folder: str, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """A stream of packets from a folder's captures, decoded like those of other sources."""
    return decode_frames(stream_captures(spark, folder).drop("iface"), cfg)
