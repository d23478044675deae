"""The collections a user works with: flat records, keyed values, JSON documents and typed tables.

Each is a thin class around a DataFrame. Methods that give tables are lazy, but for ``build`` and ``bulk_append`` of what
has dense ids, which write the rows in order; those that give one value run a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lodestar.operators import json_docs, literal, records, regex, table
from lodestar.sources import storage


class _Collection:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.df = self.df.persist(level)
        return self

    def cache(self):
        return self.persist()

    def unpersist(self):
        self.df = self.df.unpersist()
        return self

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self):
        return self.df.toLocalIterator()

    def save(self, path: str, mode: str = "error") -> None:
        storage.save(self.df, path, mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str, level: StorageLevel | None = None):
        return cls(storage.load(spark, path, level))


class FlatCollection(_Collection):
    """Records in order: record_id, value, global_offset (bytes, a newline after each record)."""

    @classmethod
    def build(cls, df: DataFrame, value: str = "value", key: str | None = None) -> FlatCollection:
        """From a table; without a key the records keep the order of their files and partitions."""
        if key is None:
            df, key = df.withColumn("__key", F.monotonically_increasing_id()), "__key"
        placed = records.numbered(df.select(F.col(key).alias("__key"), F.col(value).alias("value")), "__key", "value")
        return cls(placed.select("record_id", "value", "global_offset"))

    def count(self, query: str | bytes) -> int:
        return literal.count(self.df, query, binary=True).first()["n"]

    def search(self, query: str | bytes) -> DataFrame:
        return literal.global_offsets(self.df, query)

    def regex_search(self, pattern: str, greedy: bool = True) -> DataFrame:
        return regex.global_matches(self.df, pattern, greedy=greedy)

    def record_ids(self, query: str | bytes) -> DataFrame:
        return literal.containing(self.df, query).select("record_id")

    def record_ids_regex(self, pattern: str) -> DataFrame:
        return regex.matching(self.df, pattern).select("record_id")

    def extract(self, offset: int, length: int) -> bytes:
        records.check_range(self.df, offset, length)
        return bytes(records.extract_global(self.df, offset, length).first()["content"])

    def char_at(self, offset: int) -> str:
        return self.extract(offset, 1).decode("latin-1")

    def get_record(self, record_id: int) -> str | bytes:
        found = self.df.filter(F.col("record_id") == record_id).select("value").first()
        if found is None:
            raise IndexError(f"no record {record_id}")
        return found["value"]

    def extract_record(self, record_id: int, offset: int, length: int) -> str | bytes:
        """Part of a record; what lies beyond its end is left out."""
        found = self.df.filter(F.col("record_id") == record_id).select(F.substring("value", offset + 1, length).alias("v")).first()
        if found is None:
            raise IndexError(f"no record {record_id}")
        return found["v"]

    def offset_to_record(self, positions: DataFrame, position: str = "position") -> DataFrame:
        return records.offset_to_record(self.df, positions, position)

    def size(self) -> int:
        return records.total_size(self.df).first()["n_bytes"]

    def alphabet(self) -> DataFrame:
        return records.alphabet(self.df)

    def bulk_append(self, df: DataFrame, value: str = "value", key: str | None = None) -> FlatCollection:
        """Ids and offsets go on where those of this collection end."""
        end = records.total_size(self.df).first()
        new = FlatCollection.build(df, value, key).df
        moved = new.withColumns({"record_id": F.col("record_id") + end["n_records"], "global_offset": F.col("global_offset") + end["n_bytes"]})
        return FlatCollection(table.append(self.df, moved))


class KVCollection(_Collection):
    """key, value: binary values count in bytes, strings in characters."""

    @classmethod
    def build(cls, df: DataFrame, key: str = "key", value: str = "value", sort: bool = True) -> KVCollection:
        df = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
        return cls(df.repartitionByRange("key").sortWithinPartitions("key") if sort else df)

    def save(self, path: str, mode: str = "error", sort: bool = False) -> None:
        storage.save(self.df, path, mode, order="key" if sort else None)

    @property
    def binary(self) -> bool:
        return self.df.schema["value"].dataType.typeName() == "binary"

    def get(self, key: object) -> str | bytes | None:
        """The key's value, None without one, ValueError if the key occurs twice."""
        found = self.df.filter(F.col("key") == F.lit(key)).select("value").take(2)
        if len(found) > 1:
            raise ValueError(f"key {key!r} occurs twice")
        return found[0]["value"] if found else None

    def multiget(self, keys: list | DataFrame) -> DataFrame:
        """(key, value) of the keys that are there, for a list of keys or a table with a column ``key``."""
        if isinstance(keys, DataFrame):
            return self.df.join(keys.select("key").distinct(), "key", "left_semi")
        return self.df.filter(F.col("key").isin(list(keys)))

    def extract(self, key: object, offset: int, length: int) -> str | bytes | None:
        found = self.df.filter(F.col("key") == F.lit(key)).select(F.substring("value", offset + 1, length).alias("v")).first()
        return None if found is None else found["v"]

    def count(self, query: str | bytes) -> int:
        return literal.count(self.df, query, binary=self.binary).first()["n"]

    def search(self, query: str | bytes) -> DataFrame:
        return literal.containing(self.df, query).select("key")

    def search_offsets(self, query: str | bytes) -> DataFrame:
        return literal.offsets(self.df, query, ["key"], binary=self.binary)

    def filter_by_value(self, query: str | bytes) -> DataFrame:
        return literal.containing(self.df, query)

    def regex_search(self, pattern: str) -> DataFrame:
        return regex.matching(self.df, pattern).select("key")

    def regex_match(self, pattern: str, greedy: bool = True) -> DataFrame:
        return regex.matches(self.df, pattern, ["key"], greedy=greedy, binary=self.binary)

    def bulk_append(self, df: DataFrame) -> KVCollection:
        """The caller gives new keys."""
        return KVCollection(table.append(self.df, df.select("key", "value")))


class JsonCollection(_Collection):
    """id (dense from 0), doc (JSON text)."""

    @classmethod
    def build(cls, df: DataFrame, doc: str = "value", key: str | None = None, first_id: int = 0) -> JsonCollection:
        if key is None:
            df, key = df.withColumn("__key", F.monotonically_increasing_id()), "__key"
        placed = records.numbered(df.select(F.col(key).alias("__key"), F.col(doc).alias("doc")), "__key", first_id=first_id)
        return cls(placed.select(F.col("record_id").alias("id"), "doc"))

    def get(self, doc_id: int) -> str | None:
        found = json_docs.with_id(self.df.filter(F.col("id") == doc_id)).take(2)
        if len(found) > 1:
            raise ValueError(f"id {doc_id} occurs twice")
        return found[0]["doc"] if found else None

    def documents(self) -> DataFrame:
        return json_docs.with_id(self.df)

    def filter(self, field: str, value: str) -> DataFrame:
        return json_docs.filter_field(self.df, field, value).select("id")

    def search(self, query: str) -> DataFrame:
        return json_docs.search(self.df, query)

    def leaves(self) -> DataFrame:
        return json_docs.leaves(self.df, ["id"])

    def bulk_append(self, df: DataFrame, doc: str = "value", key: str | None = None) -> JsonCollection:
        new = JsonCollection.build(df, doc, key, first_id=self.df.count())
        return JsonCollection(table.append(self.df, new.df))


class TableCollection(_Collection):
    """A typed table; all predicates and the projection reach the Parquet scan."""

    def scan(self, columns: list[str] | None = None, where: list[tuple[str, str, object]] = ()) -> DataFrame:
        return table.prune_filter(self.df, columns, where)

    def limits(self, columns: list[str] | None = None) -> DataFrame:
        return table.limits(self.df, columns or self.df.columns)

    def bulk_append(self, df: DataFrame) -> TableCollection:
        return TableCollection(table.append(self.df, df))
