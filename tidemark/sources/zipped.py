"""CSV members of ZIP archives as a Spark data source, and a sink that writes them."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "archive string, name string, bytes long, is_dir boolean"


def archives(path: str) -> list[str]:
    """The archive that a path or URI names, or those in that folder, by name."""
    store, inner = fs.FileSystem.from_uri(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.lower().endswith(".zip"))
    return [f"{path.rstrip('/')}/{name}" for name in found]


def opened(path: str) -> zipfile.ZipFile:
    """An archive of any file system that Arrow knows, read by ranges: its directory, then the members asked for."""
    store, inner = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(store.open_input_file(inner))


def csv_members(path: str) -> list[zipfile.ZipInfo]:
    with opened(path) as z:
        return [i for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(".csv") and i.file_size]


@dataclass
class Member(InputPartition):
    archive: str
    name: str | None = None


class ZippedCsv(DataSource):
    """Format `zipped_csv`. Options: path, an archive or a folder of them, on a file system that all executors share; member, the only one to read; list, to list all members in place of reading.

    Columns are strings: without a schema, those of the first member's header, trimmed. Each member has its own header and is one partition, read in blocks; a column that it lacks is null, one that the schema lacks is left
    out. Empty fields are null, quoted empty ones empty texts; lines may break within quotes. Members of no bytes have no rows; a row of too few or too many fields is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str | T.StructType:
        if self.options.get("list", "").lower() == "true":
            return LISTING
        for path in archives(self.options["path"]):
            for i in csv_members(path):
                if self.options.get("member", i.filename) == i.filename:
                    return T.StructType([T.StructField(c, T.StringType()) for c in header(path, i.filename)])
        raise ValueError(f"no CSV member in {self.options['path']}")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZippedReader(self.options, schema)


def header(path: str, member: str) -> list[str]:
    with opened(path) as z, z.open(member) as f:
        return [c.strip() for c in next(csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline="")))]


class ZippedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.only, self.columns = options["path"], options.get("member"), schema.names
        self.listing = options.get("list", "").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        if self.listing:
            return [Member(a) for a in archives(self.path)]
        return [Member(a, i.filename) for a in archives(self.path) for i in csv_members(a) if self.only in (None, i.filename)]

    def read(self, part: Member) -> Iterator[pa.RecordBatch | tuple]:
        if self.listing:
            with opened(part.archive) as z:
                yield from [(part.archive.rsplit("/", 1)[-1], i.filename, i.file_size, i.is_dir()) for i in z.infolist()]
            return
        names = header(part.archive, part.name)
        kind = pa.schema([(c, pa.string()) for c in self.columns])
        with opened(part.archive) as z, z.open(part.name) as f:
            rows = pa.csv.open_csv(
                f,
                pa.csv.ReadOptions(column_names=names, skip_rows=1),
                pa.csv.ParseOptions(newlines_in_values=True),
                pa.csv.ConvertOptions(column_types=kind, include_columns=self.columns, include_missing_columns=True, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""]),
            ) if self._has_rows(part) else ()
            yield from rows

    def _has_rows(self, part: Member) -> bool:
        with opened(part.archive) as z, z.open(part.name) as f:
            lines = csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
            next(lines)
            return any(True for _ in lines)  # stops at the first one


def read_zipped(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """All columns, as texts, of CSV members of an archive or of a folder of archives."""
    spark.dataSource.register(ZippedCsv)
    reader = spark.read.format("zipped_csv")
    return (reader if member is None else reader.option("member", member)).load(path)


def zip_listing(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, bytes, is_dir of all members, from the archives' directories alone."""
    spark.dataSource.register(ZippedCsv)
    return spark.read.format("zipped_csv").option("list", "true").load(path)


def write_zipped(df: DataFrame, path: str) -> int:
    """An archive of one CSV member for each partition that has rows, streamed to a folder of the shared file system; the number of rows. A task that runs again replaces its archive whole."""
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        part, n, out = f"part-{TaskContext.get().partitionId():05d}", 0, None
        draft = f"{folder}/_{part}-{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(folder, recursive=True)
                sink = store.open_output_stream(draft)
                archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                member = archive.open(f"{part}.csv", "w", force_zip64=True)
                out = pa.csv.CSVWriter(member, pa.schema([(c, pa.string()) for c in names]))
            if batch.num_rows:
                out.write(pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in batch.columns], names=names))
                n += batch.num_rows
        if out is not None:
            for x in (out, member, archive, sink):
                x.close()
            store.move(draft, f"{folder}/{part}.zip")
        yield pa.RecordBatch.from_pydict({"n": [n]}, schema=pa.schema([("n", pa.int64())]))

    return df.select(*[F.col(f"`{c}`").cast("string") for c in names]).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
