"""A named data source over saved tables: ``spark.read.format("lodestar").load(path)``.

It plans one partition for each file and hands over Arrow batches with the columns and rows that a query asks for. Inside the engine tables are read with ``spark.read.parquet``, which prunes as well and stays in the JVM;
this facade is for code that wants a format name. Its workers have no JVM and reach only pyarrow's file systems; in any
other store ``save`` and ``create_view`` go through Spark's own Parquet writer and reader, over files of the same kind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from lodestar.sources.storage import MODES, hadoop


class _Part(InputPartition):
    def __init__(self, file: str) -> None:
        super().__init__(file)
        self.file = file


def _expression(f: Filter):
    import pyarrow.compute as pc

    if len(f.attribute) != 1:
        return None
    c = pc.field(f.attribute[0])
    match f:
        case EqualTo(value=v):
            return c == v
        case LessThan(value=v):
            return c < v
        case LessThanOrEqual(value=v):
            return c <= v
        case GreaterThan(value=v):
            return c > v
        case GreaterThanOrEqual(value=v):
            return c >= v
        case StringStartsWith(value=v):
            return pc.starts_with(c, v)
        case StringEndsWith(value=v):
            return pc.ends_with(c, v)
        case StringContains(value=v):
            return pc.match_substring(c, v)
        case In(value=v):
            return c.isin(list(v))
        case IsNull():
            return c.is_null()
        case IsNotNull():
            return c.is_valid()
    return None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it; what follows ``file:`` is taken as it is, as in Hadoop."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _dataset(path: str) -> ds.Dataset:
    store, at = _store(path)
    return ds.dataset(at, format="parquet", filesystem=store)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.where = path, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            e = _expression(f)
            if e is None:
                yield f
            else:
                self.where = e if self.where is None else self.where & e

    def partitions(self) -> list[InputPartition]:
        # from the listing alone: no file is opened on the driver
        return [_Part(file) for file in _dataset(self.path).files]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        part = ds.ParquetFileFormat().make_fragment(partition.file, filesystem=_store(self.path)[0])
        yield from part.to_batches(columns=self.schema.names, filter=self.where)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceArrowWriter):
    """Tasks write to a staging folder of this job; ``commit`` moves the files of the attempts that Spark committed, then
    removes those of the table before. A failed job leaves the old table as it was. The folder is made before the job, so
    that tasks which still run after ``abort`` can't make it again."""

    def __init__(self, path: str) -> None:
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"
        store, at = _store(path)
        store.create_dir(f"{at}/{self.staging}", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, at = _store(self.path)
        out, file = None, f"part-{uuid.uuid4().hex}.parquet"
        try:
            for b in batches:
                if out is None:
                    out = pq.ParquetWriter(f"{at}/{self.staging}/{file}", b.schema, filesystem=store)
                out.write_batch(b)
        finally:
            if out:
                out.close()
        return _Written(file if out else None)

    def _drop_staging(self) -> None:
        store, at = _store(self.path)
        if store.get_file_info(f"{at}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/{self.staging}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        before = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
        for m in messages:
            if m is not None and m.file:
                store.move(f"{at}/{self.staging}/{m.file}", f"{at}/{m.file}")
        for file in before:
            store.delete_file(file)
        store.open_output_stream(f"{at}/_SUCCESS").close()
        self._drop_staging()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop_staging()


class LodestarSource(DataSource):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        if "path" not in options:
            raise ValueError("the option 'path' is missing")
        self.path = options["path"]

    @classmethod
    def name(cls) -> str:
        return "lodestar"

    def schema(self) -> StructType:
        return from_arrow_schema(_dataset(self.path).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.path, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite and _exists(self.path):
            raise ValueError("append isn't supported: the table exists")
        return _Writer(self.path)


def _exists(path: str) -> bool:
    store, at = _store(path)
    return store.get_file_info(at).type == fs.FileType.Directory and any(f.is_file for f in store.get_file_info(fs.FileSelector(at)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LodestarSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def save(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a table through the named source with any mode but ``append``: ``error``, ``errorifexists``, ``ignore``, ``overwrite``.

    Spark itself passes only overwrite and append on to a source of this kind, so the other two are settled here, before
    the job: FileExistsError if the table is there under ``error``, nothing written under ``ignore``. A path without a
    scheme lies in the default file system, as elsewhere in Spark.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} isn't supported; use one of {', '.join(MODES)}")
    register(df.sparkSession)
    store, at = hadoop(df.sparkSession, path)
    if mode != "overwrite" and store.exists(at) and any(f.isFile() for f in store.listStatus(at)):
        if mode == "ignore":
            return
        raise FileExistsError(path)
    if _reached(at.toString()):
        df.write.format(LodestarSource.name()).mode("overwrite").save(at.toString())
    else:
        _save_by_spark(df, at.toString())


def _reached(path: str) -> bool:
    try:
        store, at = _store(path)
        store.get_file_info(at)
    except (OSError, pa.ArrowException):
        return False
    return True


def _save_by_spark(df: DataFrame, path: str) -> None:
    """Staged and published as by ``_Writer``, for stores that only the JVM reaches."""
    store, at = hadoop(df.sparkSession, path)
    staging, done = (hadoop(df.sparkSession, f"{path}/{x}")[1] for x in (f"_staging-{uuid.uuid4().hex}", "_SUCCESS"))
    try:
        df.write.parquet(staging.toString())
        before = [f.getPath() for f in store.listStatus(at) if f.isFile()]
        for file in (f.getPath() for f in store.listStatus(staging)):
            if file.getName().startswith("part-") and not store.rename(file, at):
                raise OSError(f"{file.toString()} can't be moved to {path}")
        for file in before:
            store.delete(file, False)
        store.create(done).close()
    finally:
        store.delete(staging, True)


def create_view(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A temporary view over a saved table, by the SQL that a user would write."""
    register(spark)
    path = hadoop(spark, path)[1].toString()
    source, quoted = LodestarSource.name() if _reached(path) else "parquet", path.replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` USING {source} OPTIONS (path '{quoted}')")
    return spark.table(name)
