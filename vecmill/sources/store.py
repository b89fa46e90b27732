"""Tables in parquet with append, replace and delete: every change writes a new version, readers keep the one they have."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import conform


class Store:
    """A folder with versions. A version lists, for each of some tables, its parquet folders; so one change of several tables is seen at once,
    and one that fails leaves the last version as it is. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def names(self, folder: str) -> list[str]:
        system, path = self.file(folder)
        return sorted(x.getPath().getName() for x in system.listStatus(path)) if system.exists(path) else []

    def versions(self) -> list[int]:
        return [int(x.split(".")[0]) for x in self.names("versions") if x.endswith(".json") and x[0] != "."]

    def parts(self, version: int | None = None) -> dict[str, list[str]]:
        versions = self.versions()
        if not versions:
            return {}
        system, path = self.file(f"versions/{versions[-1] if version is None else version:08d}.json")
        stream = system.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, changed: dict[str, list[str]]) -> int:
        """A new version: these tables' folders are as given, others as they were."""
        number = (self.versions() or [0])[-1] + 1
        system, draft = self.file(f"versions/.{number:08d}.draft")
        stream = system.create(draft, True)
        stream.write(bytearray(json.dumps({**self.parts(), **changed}).encode()))
        stream.close()
        if not system.rename(draft, self.file(f"versions/{number:08d}.json")[1]):
            raise OSError("another writer published this version")
        return number


class Table:
    """A table of a store. Rows lie in `buckets` folders by a hash of their key, so that a change of some keys reads and writes the buckets
    of these keys only, whatever the size of the table. The number of buckets must not change between changes."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, store: Store | None = None, name: str = "rows", buckets: int = 16) -> None:
        self.spark, self.schema, self.key, self.name, self.buckets = spark, schema, key, name, buckets
        self.store = store or Store(spark, path)
        self.path = self.store.path

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _parts(self, version: int | None = None) -> list[str]:
        return self.store.parts(version).get(self.name, [])

    def stage(self, rows: DataFrame) -> list[str]:
        """Write rows into new folders, one a bucket, that no version lists yet."""
        folder = f"data/{self.name}-{uuid.uuid4().hex}"
        conform(rows, self.schema).withColumn("__bucket", self._bucket()).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        return [f"{folder}/{x}" for x in self.store.names(folder) if x.startswith("__bucket=")]

    def staged(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def stage_without(self, keys: DataFrame) -> list[str]:
        """The table's folders without the rows of these keys. At most `buckets` numbers come to the driver."""
        gone = keys.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        touched = {f"__bucket={r[0]}" for r in gone.select(self._bucket()).distinct().collect()}
        old = self._parts()
        mine = [x for x in old if x.rsplit("/", 1)[1] in touched]
        kept = [x for x in old if x not in set(mine)]
        return kept + self.stage(self.staged(mine).join(gone, self.key, "left_anti")) if mine else kept

    def exists(self) -> bool:
        return self.name in self.store.parts()

    def create(self) -> Table:
        """An empty first version, if there is none yet."""
        if not self.exists():
            self.store.publish({self.name: []})
        return self

    def read(self, version: int | None = None) -> DataFrame:
        return self.staged(self._parts(version))

    def append(self, rows: DataFrame) -> int:
        """Add rows. Columns the schema lacks are dropped, missing ones are null."""
        return self.store.publish({self.name: self._parts() + self.stage(rows)})

    def delete(self, keys: DataFrame) -> int:
        """Remove all rows of the given keys (one column of the key's name); keys that are not there, and null ones, change nothing."""
        return self.store.publish({self.name: self.stage_without(keys)})

    def replace(self, rows: DataFrame) -> int:
        """Remove the rows of all keys in `rows`, then add `rows`; readers see both changes at once. `rows` is evaluated once."""
        new = self.stage(rows)
        return self.store.publish({self.name: self.stage_without(self.staged(new)) + new})

    def compact(self) -> int:
        """The same rows in one folder a bucket, after many changes."""
        return self.store.publish({self.name: self.stage(self.read())})
