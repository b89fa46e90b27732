"""Problem 2: a sample that reruns, partitionings and new records leave as it is, by permanent random numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

SCHEMA = "id string, u double, generation int"


def written_alike(identifier: Column) -> Column:
    """The letters and digits of an identifier, case ignored; null if there are none."""
    bare = F.lower(F.regexp_replace(identifier, r"[^\p{L}\p{N}]+", ""))
    return F.when(bare != "", bare)


class PermanentSample:
    """A registry of identifiers, each with a uniform number in [0, 1) that is fixed when it is first seen.

    The registry is a folder of parquet tables, one for each insert, plus one row for each threshold that was asked for. A number
    is the leading 52 bits of md5(seed + identifier), so that even a lost registry or an insert that runs twice gives the same
    numbers; what is persisted counts, whatever the seed of later inserts. A share below an earlier one is raised to it, so that
    selected identifiers stay selected.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, seed: str = "0") -> None:
        self.spark, self.seed = spark, seed
        self.path = path or new_path(spark, "p2-registry")

    def _hadoop(self, name: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _generations(self) -> list[str]:
        system, target = self._hadoop("ids")
        if not system.exists(target):
            return []
        # a folder without _SUCCESS is an insert that did not end
        return sorted(str(x.getPath()) for x in system.listStatus(target) if system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{x.getPath()}/_SUCCESS")))

    def registry(self) -> DataFrame:
        """(id, u, generation): each identifier once. One that two inserts running at once both gave a number has the same number twice, as
        the number is a hash; the earlier generation counts."""
        return self._written().groupBy("id").agg(F.min(F.struct("generation", "u")).alias("x")).select("id", "x.u", "x.generation")

    def _written(self) -> DataFrame:
        done = self._generations()
        return self.spark.read.schema(SCHEMA).parquet(*done) if done else self.spark.createDataFrame([], SCHEMA)

    def insert(self, identifiers: DataFrame, column: str) -> None:
        """Give a number to every identifier that has none yet (anti-join insert). Null ones get none.

        Each insert has a folder of its own, so none overwrites another, whichever ran at once or was cut off."""
        new = identifiers.select(written_alike(F.col(column).cast("string")).alias("id")).where("id is not null").distinct()
        done = self._generations()
        if done:
            new = new.join(self._written().select("id"), "id", "left_anti")
        head = F.substring(F.md5(F.concat(F.lit(self.seed + "\x1f"), "id").cast("binary")), 1, 13)
        number = F.conv(head, 16, 10).cast("long") / F.lit(float(1 << 52))
        new.select("id", number.alias("u"), F.lit(len(done)).alias("generation")).write.parquet(f"{self.path}/ids/{len(done):06d}-{uuid.uuid4().hex}")

    def threshold(self, share: float) -> float:
        """The share to use: the largest that was ever asked for. It is recorded."""
        if not 0 <= share <= 1:
            raise ValueError("share must be within 0 and 1")
        system, target = self._hadoop("shares")
        known = [float(x.getPath().getName()) for x in system.listStatus(target)] if system.exists(target) else []
        most = max([share, *known])
        if most not in known:
            system.mkdirs(self._hadoop(f"shares/{most!r}")[1])
        return most

    def select(self, df: DataFrame, column: str, share: float) -> DataFrame:
        """The rows of df whose identifier has a number below the threshold, with the number as column `u`.

        All rows of an identifier, however written, come or stay away together. Rows with a null identifier, or one that was never
        inserted, stay away. All columns of df are kept; one named `u` is replaced.
        """
        key, number = (f"{x}_{uuid.uuid4().hex}" for x in "ku")  # names no column of df has
        chosen = self.registry().where(F.col("u") < self.threshold(share)).select(F.col("id").alias(key), F.col("u").alias(number))
        keyed = df.withColumn(key, written_alike(F.col(column).cast("string")))
        # An identifier may hold a third of df: its side of the join has it once, and AQE splits the other.
        return keyed.join(chosen, key).drop("u", key).withColumnRenamed(number, "u")
