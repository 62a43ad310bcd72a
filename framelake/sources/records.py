"""Data sources of raw records: clouds of floats and one-line navigation records, read in parts and written by tasks.

Files are reached through Arrow's file systems (local and mounted folders, object stores). A task writes below a folder
of its own attempt; what tasks have finished is moved into place when all are done, and nothing is left of a job that fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of files that a task reads, points of a batch.
PART, BATCH = 64 << 20, 1 << 16
CLOUD = "frame long, pid long, x float, y float, z float, r float"
#: The fields of a navigation record in their order in a line.
FIELDS = ("lat", "lon", "alt", "roll", "pitch", "yaw", "vn", "ve", "vf", "vl", "vu", "ax", "ay", "az", "af", "al", "au", "wx", "wy", "wz", "wf", "wl", "wu", "pos_accuracy", "vel_accuracy", "navstat", "numsats", "posmode", "velmode", "orimode")
RECORDS = "id long, ts double, " + ", ".join(f"{n} double" for n in FIELDS)


@dataclass
class Files(InputPartition):
    """Files of a part of a folder: number and path."""

    files: list[tuple[int, str]]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: where, and where it belongs."""

    moves: list[tuple[str, str]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))


def _listed(path: str, suffix: str) -> list[fs.FileInfo]:
    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name.endswith(suffix)), key=lambda f: f.base_name)


def _parts(files: list[tuple[int, fs.FileInfo]]) -> list[Files]:
    out, size = [], PART
    for number, f in files:
        if size >= PART:
            out.append(Files([]))
            size = 0
        out[-1].files.append((number, f.path))
        size += f.size
    return out


class _Writer(DataSourceArrowWriter):
    """Files of a task, moved into place at commit. A job that fails leaves none."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def _put(self, store: fs.FileSystem, at: str, name: str, data: bytes, moves: list[tuple[str, str]], root: str) -> None:
        with store.open_output_stream(f"{at}/{name.replace('/', '-')}") as out:
            out.write(data)
        moves.append((f"{at}/{name.replace('/', '-')}", f"{root}/{name}"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        at, moves = f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(at)
        for name, data in self.files(iterator):
            self._put(store, at, name, data, moves, root)
        return Written(moves)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if not f.base_name.startswith("_temporary-"):
                    (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path)
        for folder in {new.rpartition("/")[0] for m in messages if m for _, new in m.moves}:
            store.create_dir(folder)
        for m in messages:
            for old, new in m.moves if m else ():
                store.move(old, new)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        if store.get_file_info(f"{root}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary-{self.job}")


class CloudWriter(_Writer):
    """A file of little-endian floats x, y, z, r for each frame. Rows come by frame and point."""

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        now, held = None, []
        for batch in batches:
            frame = batch.column("frame").to_numpy()
            points = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in "xyzr"], axis=1)
            cuts = np.flatnonzero(np.append(True, frame[1:] != frame[:-1])).tolist() if len(frame) else []
            for a, b in zip(cuts, [*cuts[1:], len(frame)], strict=True):
                if held and frame[a] != now:
                    yield f"{now:010d}.bin", b"".join(held)
                    held = []
                now = int(frame[a])
                held.append(points[a:b].tobytes())
        if held:
            yield f"{now:010d}.bin", b"".join(held)


class CloudReader(DataSourceReader):
    """Frames are numbered by the names of files."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Files]:
        return _parts(list(enumerate(_listed(self.path, ".bin")))) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        names = [c.split()[0] for c in CLOUD.split(", ")]
        for frame, path in partition.files:
            with store.open_input_stream(path) as data:
                first = 0
                while block := data.read(16 * BATCH):
                    a = np.frombuffer(block, "<f4", len(block) // 16 * 4).reshape(-1, 4)
                    pid = np.arange(first, first + len(a))
                    first += len(a)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), frame)), pa.array(pid), *(pa.array(np.ascontiguousarray(a[:, k])) for k in range(4))], names=names)


class CloudSource(DataSource):
    """Format "float_cloud": frame, pid, x, y, z, r."""

    @classmethod
    def name(cls) -> str:
        return "float_cloud"

    def schema(self) -> str:
        return CLOUD

    def reader(self, schema) -> CloudReader:
        return CloudReader(self.options)

    def writer(self, schema, overwrite: bool) -> CloudWriter:
        return CloudWriter(self.options, overwrite)


class RecordWriter(_Writer):
    """data/<first id>.txt with a line of fields a record, and timestamps/<first id>.txt with their times. Rows come by id; `per_file` records in a file."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.per_file = int(options.get("perFile", "1"))

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        now, lines, times = None, [], []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("id", "ts", *FIELDS)]
            for number, ts, *fields in zip(*columns, strict=True):
                if lines and number // self.per_file != now:
                    yield from self._file(now, lines, times)
                    lines, times = [], []
                now = number // self.per_file
                lines.append(" ".join("nan" if x is None else repr(float(x)) for x in fields))
                times.append(str(np.datetime64(round(ts * 1e6), "us")).replace("T", " "))
        if lines:
            yield from self._file(now, lines, times)

    def _file(self, number: int, lines: list[str], times: list[str]) -> Iterator[tuple[str, bytes]]:
        for folder, some in (("data", lines), ("timestamps", times)):
            yield f"{folder}/{number * self.per_file:010d}.txt", "".join(f"{x}\n" for x in some).encode()


class RecordReader(DataSourceReader):
    """The number of a file is its first record's id. Times are in timestamps/ under the same names, or lines of timestamps.txt in order."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Files]:
        return _parts([(int(f.base_name.removesuffix(".txt")), f) for f in _listed(f"{self.path.rstrip('/')}/data", ".txt")]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _opened(self.path)
        lines = lambda path: [x for x in store.open_input_file(path).read().decode().splitlines() if x.strip()]
        single = f"{root}/timestamps.txt"
        every = lines(single) if partition.files and store.get_file_info(single).is_file else None
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for first, path in partition.files:
            data = [x.split() for x in lines(path)]
            times = every[first : first + len(data)] if every is not None else lines(path.replace("/data/", "/timestamps/"))
            if len(times) != len(data) or any(len(x) != len(FIELDS) for x in data):
                raise ValueError(f"{path} has records of another length, or other times than records")
            values = np.array(data, float)
            values[:, :2] = np.radians(values[:, :2])
            ts = np.array([np.datetime64(t.strip().replace(" ", "T")[:26], "us").astype(np.int64) for t in times]) / 1e6
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(data))), pa.array(ts), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], names=names)


class RecordSource(DataSource):
    """Format "navigation_records": id, ts and the fields; latitude and longitude in degrees in the files, in radians in tables."""

    @classmethod
    def name(cls) -> str:
        return "navigation_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (CloudSource, RecordSource):
        spark.dataSource.register(source)


def write_clouds(points: DataFrame, path: str, mode: str = "append") -> None:
    """points: frame, pid, x, y, z, r. A file for each frame, its points by pid."""
    register(points.sparkSession)
    columns = [F.col("frame").cast("long").alias("frame"), F.col("pid").cast("long").alias("pid"), *(F.col(c).cast("float").alias(c) for c in "xyzr")]
    points.select(*columns).repartition("frame").sortWithinPartitions("frame", "pid").write.format("float_cloud").mode(mode).save(path)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("float_cloud").load(path)


def write_records(track: DataFrame, path: str, per_file: int = 1, mode: str = "append") -> None:
    """track: id (0, 1, ...), ts and any of the fields (the others are written as 0); latitude and longitude in radians."""
    register(track.sparkSession)
    have = set(track.columns)
    fields = [(F.degrees(n) if n in ("lat", "lon") else F.col(n).cast("double")).alias(n) if n in have else F.lit(0.0).alias(n) for n in FIELDS]
    rows = track.select(F.col("id").cast("long").alias("id"), F.col("ts").cast("double").alias("ts"), *fields)
    rows.repartition(F.floor(F.col("id") / per_file)).sortWithinPartitions("id").write.format("navigation_records").option("perFile", per_file).mode(mode).save(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("navigation_records").load(path)
