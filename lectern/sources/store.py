"""Tables that commit: data files and one manifest, which alone says what the table is.

    store.write(vectors, "hdfs:///vectors", {"model": "a"}, sort=["sentence", "position"])
    store.read(spark, "hdfs:///vectors", {"model": "a"})

Tasks write Parquet files into a folder of the job, and send each file's rows, bytes, hash and first and last key to the driver.
When all have ended, the manifest is written, last and in one piece: files, provenance, schema and the sum of rows. Before that a reader sees no
table, or the former one. A task that fails removes its file, a job that fails its folder; files that a lost executor leaves
behind are in no manifest, so nobody reads them. Writing over a table is refused unless asked for, and then the former files go
after the new manifest stands.

Readers check the provenance that they expect, and read the files with Spark's own reader, in the manifest's order, which is
that of the sort keys. A lookup by the first sort key reads only the files that can hold it.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lectern.functions.common import qualified

from .signal import opened

MANIFEST = "_manifest.json"


@dataclass
class File(WriterCommitMessage):
    name: str | None
    rows: int = 0
    bytes: int = 0
    sha256: str = ""
    first: str | int | None = None
    last: str | int | None = None


class _Hashed:
    """A stream that hashes what it passes on."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.sha, self.size, self.closed = stream, hashlib.sha256(), 0, False

    def write(self, data: bytes) -> int:
        self.sha.update(data)
        self.size += len(data)
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()

    def close(self) -> None:
        self.closed = True
        self.stream.close()

    def writable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.size


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: str, overwrite: bool) -> None:
        self.path, self.key, self.schema, self.overwrite = options["path"], options.get("key"), schema, overwrite
        self.provenance, self.job = json.loads(options.get("provenance", "{}")), f"job-{uuid.uuid4().hex}"
        if not overwrite and _manifest(self.path) is not None:
            raise ValueError(f"{self.path}: a table exists already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> File:
        system, path = opened(self.path)
        out, name, first, last = None, f"{self.job}/{uuid.uuid4().hex}.parquet", None, None
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                if out is None:
                    system.create_dir(f"{path}/{self.job}")
                    stream = _Hashed(system.open_output_stream(f"{path}/{name}"))
                    out, rows = pq.ParquetWriter(pa.PythonFile(stream, mode="w"), batch.schema), 0
                out.write_batch(batch)
                rows += len(batch)
                if self.key:
                    keys = batch.column(batch.schema.get_field_index(self.key))
                    first, last = (keys[0].as_py() if first is None else first), keys[-1].as_py()
            if out is None:
                return File(None)
            out.close()
            stream.close()
            return File(name, rows, stream.size, stream.sha.hexdigest(), first, last)
        except BaseException:
            if out is not None:
                stream.close()
                system.delete_file(f"{path}/{name}")
            raise

    def commit(self, messages: list[File | None]) -> None:
        system, path = opened(self.path)
        before = _manifest(self.path)
        files = sorted((asdict(m) for m in messages if m is not None and m.name), key=lambda f: (f["first"] is not None, f["first"], f["name"]))
        said = {"schema": self.schema, "provenance": self.provenance, "key": self.key, "rows": sum(f["rows"] for f in files), "files": files}
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{MANIFEST}.{self.job}") as f:
            f.write(json.dumps(said, sort_keys=True).encode())
        system.move(f"{path}/{MANIFEST}.{self.job}", f"{path}/{MANIFEST}")
        for job in {posixpath.dirname(f["name"]) for f in (before or {"files": []})["files"]}:
            system.delete_dir(f"{path}/{job}")

    def abort(self, messages: list[File | None]) -> None:
        system, path = opened(self.path)
        if system.get_file_info(f"{path}/{self.job}").type.name == "Directory":
            system.delete_dir(f"{path}/{self.job}")


class Store(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_store"

    def schema(self) -> str:
        raise NotImplementedError("read with lectern.sources.store.read")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema.simpleString(), overwrite)


def _manifest(path: str) -> dict | None:
    system, folder = opened(path)
    if system.get_file_info(f"{folder}/{MANIFEST}").type.name == "NotFound":
        return None
    return json.loads(system.open_input_stream(f"{folder}/{MANIFEST}").read())


def write(df: DataFrame, path: str, provenance: dict[str, str], sort: list[str] | None = None, overwrite: bool = False, ranges: int | None = None) -> dict:
    """Writes df and returns its manifest. sort: the order of the table's rows, over all files; ranges: how many files (else Spark chooses)."""
    spark = df.sparkSession
    path = qualified(spark, path)
    spark.dataSource.register(Store)
    rows = df.repartitionByRange(*([ranges] if ranges else []), *sort).sortWithinPartitions(*sort) if sort else df
    out = rows.write.format("lectern_store").mode("overwrite" if overwrite else "append").option("provenance", json.dumps(provenance))
    (out.option("key", sort[0]) if sort else out).save(path)
    return metadata(path)


def metadata(path: str) -> dict:
    """The manifest of a table; an error where no table was committed."""
    said = _manifest(path)
    if said is None:
        raise ValueError(f"{path} holds no committed table")
    return said


def read(spark: SparkSession, path: str, expected: dict[str, str] | None = None, forbidden: tuple[str, ...] = (), at: str | int | None = None) -> DataFrame:
    """The table, if its provenance has all expected values and names nothing forbidden; else an error. at: rows of that first
    sort key only, from the files that can hold them."""
    path = qualified(spark, path)
    said = metadata(path)
    found = said["provenance"]
    wrong = [f"{k}: {found.get(k)!r} in place of {v!r}" for k, v in sorted((expected or {}).items()) if found.get(k) != v]
    wrong += [f"{k} must not be recorded" for k in sorted(found) if any(x in k for x in forbidden)]
    if wrong:
        raise ValueError(f"stale table {path}: {'; '.join(wrong)}")
    files = [f for f in said["files"] if at is None or f["first"] <= at <= f["last"]]
    schema = said["schema"].removeprefix("struct<").removesuffix(">") if not files else None
    rows = spark.read.parquet(*[f"{path}/{f['name']}" for f in files]) if files else spark.createDataFrame([], schema)
    return rows if at is None else rows.where(F.col(said["key"]) == at)


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """name of files that are gone, or whose content is not what the manifest says."""
    path = qualified(spark, path)
    said = metadata(path)
    want = spark.createDataFrame([(f["name"], f["sha256"]) for f in said["files"]], "name string, sha256 string")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    found = held.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("now"))
    return want.join(found, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("name")
