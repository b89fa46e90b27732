"""A vector index for stated queries: the table is stored by cells, a query reads only the cells near it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clustering import best, kmeans, nearest
from .knn import DECIMALS, blocks_of, prepared, survivors, unit_rows, vectors_of


class CellIndex:
    """Rows with a usable vector, partitioned by the nearest of some centroids.

    The centroids are fitted on about `sample_rows` rows drawn by hash, or eight a cell if that is more, at most `most_sample_rows` (a bound of the
    fitting; all rows are stored). Searching compares a query exactly
    with all rows of the `probes` cells whose centroids are most similar to it; with as many probes as cells the answer is exact."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.text(f"{self.path}/about").first()
        about = json.loads(row.value)
        self.vector, self.dim, self.metric, self.ties = about["vector"], about["dim"], about["metric"], about["ties"]
        self.schema = about["schema"]
        self.centroids = np.array(about["centroids"], np.float64).reshape(-1, self.dim)

    @classmethod
    def build(cls, df: DataFrame, path: str, vector_column: str, dim: int, ties: list[str], keep: list[str] | None = None, metric: str = "cosine", cell_rows: int = 100_000, sample_rows: int = 65_536, most_sample_rows: int = 1_048_576, piece_rows: int = 250_000, seed: int = 7) -> CellIndex:
        """Write the index of df to `path`, cells of about `cell_rows` rows in pieces of about `piece_rows`. ties: columns that order equally similar rows and tell rows apart; keep: further columns."""
        carried = list(dict.fromkeys([*ties, *(keep or [])]))
        source = df.select(*carried, F.col(vector_column).alias("__vector"))
        good = source.where((F.size("__vector") == dim) & ~F.exists("__vector", lambda x: x.isNull()))
        total = good.count()
        share = min(1.0, min(max(sample_rows, 8 * total // cell_rows), most_sample_rows) / max(1, total))
        drawn = good.select("__vector").where(F.pmod(F.xxhash64("__vector", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).distinct().toArrow()
        sample = unit_rows(vectors_of(drawn.column(0), dim)[1]).astype(np.float32)
        count = max(1, round(total / cell_rows))  # no more than the sample has rows; then a cell holds more
        centroids = kmeans(sample, count, 10, np.random.default_rng(seed), True) if len(sample) else np.eye(1, dim, dtype=np.float32)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), "__cell int"])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = vectors_of(batch.column("__vector"), dim)[1]
                near = unit_rows(v) @ centroids.T
                yield pa.record_batch([*batch.columns, pa.array(near.argmax(axis=1).astype(np.int32))], names=[*batch.schema.names, "__cell"])

        # A cell is cut into as many pieces as it has rows for, so that one that holds much of the table is spread over tasks.
        held = np.bincount(nearest(sample, centroids, True), minlength=len(centroids)) * (total / max(1, len(sample))) if len(sample) else np.zeros(1)
        sizes = df.sparkSession.createDataFrame([(i, max(1, int(np.ceil(n / piece_rows)))) for i, n in enumerate(held)], "__cell int, __pieces int")
        assigned = good.mapInArrow(assign, schema).join(F.broadcast(sizes), "__cell")
        assigned.repartition("__cell", F.pmod(F.xxhash64(*ties), F.col("__pieces"))).drop("__pieces").select(*source.columns, "__cell").write.partitionBy("__cell").option("compression", "zstd").parquet(f"{path}/rows")
        about = {"vector": vector_column, "dim": dim, "metric": metric, "ties": ties, "schema": schema, "centroids": centroids.astype(float).round(9).ravel().tolist()}
        df.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        return cls(df.sparkSession, path)

    def search(self, queries: DataFrame, k: int, probes: int = 8, query_id: str = "query_id", query_vector: str = "vector", block_rows: int = 2048) -> DataFrame:
        """(query_id, hit_rank, similarity, *ties, *keep): like knn_join over the probed cells. Cells no query probes are not read."""
        if k < 1:
            raise ValueError("k must be at least 1")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        carried, ties, dim, metric = [c for c in rows.columns if c not in ("__vector", "__cell")], self.ties, self.dim, self.metric
        schema = ", ".join([f"query_id {queries.schema[query_id].dataType.simpleString()}", "similarity double", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)])
        found = None
        for block in blocks_of(queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")), block_rows):
            right, v = vectors_of(block.column("v"), dim)
            asked = best(unit_rows(v) @ self.centroids.T, probes) if len(v) else np.empty((0, 1), int)
            open_cells = np.zeros((len(self.centroids), len(v)), bool)
            open_cells[asked, np.arange(len(v))[:, None]] = True
            shared = self.spark.sparkContext.broadcast((block.column("q").combine_chunks().take(pa.array(right)), prepared(v, metric), open_cells))
            wanted = rows.where(F.col("__cell").isin([int(c) for c in np.unique(asked)]))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q, cells = shared.value
                for batch in batches:
                    if not batch.num_rows or not len(q):
                        continue
                    rows = pa.Table.from_batches([batch])
                    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ties], null_placement="at_start"))
                    may = cells[rows.column("__cell").to_numpy()]
                    scores = np.where(may, np.round(prepared(vectors_of(rows.column("__vector"), dim)[1], metric) @ q.T, DECIMALS), -np.inf)
                    who, row = survivors(scores, k)
                    real = np.isfinite(scores[row, who])
                    who, row = who[real], row[real]
                    kept = rows.take(pa.array(row))
                    yield from pa.table([ids.take(pa.array(who)), pa.array(scores[row, who]), *(kept.column(c) for c in carried)], names=["query_id", "similarity", *carried]).combine_chunks().to_batches()

            part = wanted.mapInArrow(run, schema)
            found = part if found is None else found.unionByName(part)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *(F.asc_nulls_first(c) for c in ties))
        return found.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= k).select("query_id", "hit_rank", "similarity", *carried)
