"""A batch source of signal windows: byte ranges of recordings, told by a table of windows.

    signal.register(spark)
    spark.read.format("signal_windows").option("windows", "hdfs:///windows.parquet").load().where("view_id = 'v1'")

windows: the address of a Parquet table with view_id, header, start, stop (samples), or a short list of such rows as JSON. The
driver lists the table's row groups, each of which is a partition; tasks read the windows of theirs, and of the recordings
the bytes of these windows only. Equalities and IN lists on view_id and header are pushed down: row groups that cannot
hold them are no partition, and windows that are not asked for are not read.

Addresses are what pyarrow opens (local paths, file:, hdfs:, viewfs:, s3:, gs:). The option reader names a class
(module:Class) with the methods of ``FloatReader``, for recordings of other formats.
"""

from __future__ import annotations

import importlib
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "view_id string, header string, n_channels int, n_samples int, sfreq double, signal array<array<float>>"
PUSHED = ("view_id", "header")


def opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


class FloatReader:
    """A recording of little-endian float32 samples, all channels of a sample together. Its header has lines key=value, of which
    DataFile, BinaryFormat (IEEE_FLOAT_32), DataOrientation (MULTIPLEXED), NumberOfChannels and SamplingInterval (microseconds) are read."""

    def __init__(self, header: str) -> None:
        system, path = opened(header)
        text = system.open_input_stream(path).read().decode()
        pairs = dict(line.strip().split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith(";"))
        if pairs.get("BinaryFormat") != "IEEE_FLOAT_32" or pairs.get("DataOrientation") != "MULTIPLEXED":
            raise ValueError(f"{header}: only multiplexed float32 recordings can be read")
        self.channels, self.rate = int(pairs["NumberOfChannels"]), 1e6 / float(pairs["SamplingInterval"])
        self.file = system.open_input_file(posixpath.join(posixpath.dirname(path), pairs["DataFile"]))
        self.samples = self.file.size() // (4 * self.channels)

    def read(self, start: int, stop: int) -> np.ndarray:
        """(samples, channels) of a window that lies in the recording."""
        width = 4 * self.channels
        return np.frombuffer(self.file.read_at((stop - start) * width, start * width), "<f4").reshape(-1, self.channels)

    def close(self) -> None:
        self.file.close()


def reader_class(name: str | None) -> type:
    if not name:
        return FloatReader
    module, _, kind = name.partition(":")
    return getattr(importlib.import_module(module), kind)


@dataclass
class RowGroup(InputPartition):
    """One row group of a file of the window table."""

    file: str
    group: int


@dataclass
class Listed(InputPartition):
    rows: list[dict]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.windows, self.kind = options["windows"], options.get("reader")
        self.wanted: dict[str, list[str]] = {}

    def _expression(self) -> pc.Expression | None:
        parts = [pc.field(c).isin(pa.array([v for v in values if v is not None], pa.string())) for c, values in self.wanted.items()]
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def partitions(self) -> list[InputPartition]:
        if self.windows.lstrip().startswith("["):
            return [Listed(json.loads(self.windows))]
        system, path = opened(self.windows)
        out = []
        for part in ds.dataset(path, filesystem=system, format="parquet").get_fragments():
            out += [RowGroup(part.path, g.id) for piece in part.split_by_row_group(self._expression()) for g in piece.row_groups]
        return out

    def _rows(self, partition: InputPartition) -> list[dict]:
        if isinstance(partition, Listed):
            return partition.rows
        system, _ = opened(self.windows)
        piece = ds.ParquetFileFormat().make_fragment(partition.file, system, row_groups=[partition.group])
        return piece.to_table(columns=["view_id", "header", "start", "stop"], filter=self._expression()).to_pylist()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        make, held, recording = reader_class(self.kind), None, None
        for w in sorted(self._rows(partition), key=lambda w: (w["header"], w["start"])):  # a recording is opened once, and read forwards
            if w["header"] != held:
                if recording is not None:
                    recording.close()
                held, recording = w["header"], make(w["header"])
            if not 0 <= w["start"] < w["stop"] <= recording.samples:
                raise ValueError(f"{w['view_id']}: window [{w['start']}, {w['stop']}) of {recording.samples} samples")
            data = recording.read(w["start"], w["stop"])
            yield w["view_id"], w["header"], recording.channels, w["stop"] - w["start"], recording.rate, data.T.tolist()
        if recording is not None:
            recording.close()


class FilteringReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities and IN lists on PUSHED; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = list(f.value) if isinstance(f, In) else [f.value]
                before = self.wanted.get(f.attribute[0], values)
                self.wanted[f.attribute[0]] = [v for v in values if v in before]
            else:
                yield f


class SignalWindows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signal_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        listed = self.options["windows"].lstrip().startswith("[")  # short, and Spark filters its rows
        return (Reader if listed else FilteringReader)(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known; a table of windows is read with filters pushed down, which Spark must be told."""
    spark.dataSource.register(SignalWindows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_recordings(recordings, folder: str) -> None:
    """Writes a header and a data file for each row of recordings (name, rate, signal: an array of samples, each an array of
    channels) into a shared folder. A task that runs again writes the same files again."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                data = np.array(row["signal"], "<f4")
                said = f"DataFile={row['name']}.dat\nBinaryFormat=IEEE_FLOAT_32\nDataOrientation=MULTIPLEXED\nNumberOfChannels={data.shape[1]}\nSamplingInterval={1e6 / row['rate']}\n"
                for end, content in (("dat", data.tobytes()), ("hdr", said.encode())):
                    with system.open_output_stream(f"{path}/{row['name']}.{end}") as f:
                        f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    opened(folder)[0].create_dir(opened(folder)[1])
    recordings.select("name", "rate", "signal").mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()
