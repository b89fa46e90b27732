"""Indexing: chunks into a chunk table, documents into a document and a token table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import late
from ..operators.batches import batch_numbers
from ..operators.encoders import TokenEncoder, encode_column, encode_tokens
from ..operators.pooling import pool_document
from .schema import Kind, VectorColumn, check_precomputed, chunk_schema, document_schema, rejections, token_schema
from .store import Store, Table


class ChunkIndex:
    """A chunk table and its vector columns."""

    def __init__(self, spark: SparkSession, path: str, columns: list[VectorColumn]) -> None:
        self.columns = columns
        self.table = Table(spark, path, chunk_schema(columns), "chunk_id").create()

    def insert(self, chunks: DataFrame) -> int:
        """Encode and append chunks (content, and any precomputed vectors) in one job; without chunk_id they get a new one.

        Missing or short precomputed vectors: ValueError, and nothing is written."""
        check_precomputed(chunks, self.columns)
        rows = chunks if "chunk_id" in chunks.columns else chunks.withColumn("chunk_id", F.uuid())
        encoders = {c.column_name: c.encoder for c in self.columns if c.kind is not Kind.PRECOMPUTED and c.encoder is not None}
        return self.table.append(encode_column(rows, "content", encoders) if encoders else rows)

    def insert_in_batches(self, chunks: DataFrame, order: list[str], size: int = 100) -> DataFrame:
        """insert(), and (batch, inserted): how many rows each batch of `size` chunks in the given order has."""
        numbered = batch_numbers(chunks, order, size)
        self.insert(numbered)
        return numbered.groupBy("batch").agg(F.count("*").alias("inserted"))


@dataclass
class Indexed:
    """What a call of LateIndex.index did. ids: (doc_id) of the indexed documents; rejected: (rejected, rows), why and how many rows were not."""

    version: int
    ids: DataFrame
    rejected: DataFrame


class LateIndex:
    """A document table and a token table, changed together: readers never see tokens of other texts than the documents'."""

    def __init__(self, spark: SparkSession, path: str, encoder: TokenEncoder, pool_factor: int = 2) -> None:
        self.encoder, self.factor = encoder, pool_factor
        self.store = Store(spark, path)
        self.documents = Table(spark, path, document_schema(encoder.supports_images), "doc_id", self.store, "documents").create()
        self.tokens = Table(spark, path, token_schema(encoder.dim), "doc_id", self.store, "tokens").create()
        self._cached: dict[int, DataFrame] = {}

    def token_rows(self, documents: DataFrame) -> DataFrame:
        """(doc_id, token_id, token_embedding): encoded and pooled tokens; a token's id follows from document, page and position."""
        factor = self.factor
        pool = (lambda v: pool_document(v, factor).vectors.astype("float32")) if factor > 1 else None
        rows = encode_tokens(documents.withColumn("page_number", F.coalesce("page_number", F.lit(0))), ["doc_id", "page_number"], "content", self.encoder, pool)
        return rows.select("doc_id", F.concat_ws("-", "doc_id", "page_number", "position").alias("token_id"), "token_embedding").repartition("doc_id").sortWithinPartitions("doc_id", "token_id")

    def index(self, documents: DataFrame, mode: str = "replace") -> Indexed:
        """Index document rows (doc_id, content, perhaps page_number and content_type). Rows without content, or with a null doc_id, are not
        indexed; without a column doc_id they get a new one. mode: 'replace' drops what is stored of these documents, 'append' leaves it."""
        if mode not in ("replace", "append"):
            raise ValueError("mode must be replace or append")
        if "page_number" not in documents.columns:
            documents = documents.withColumn("page_number", F.lit(None).cast("int"))
        documents = documents if "doc_id" in documents.columns else documents.withColumn("doc_id", F.uuid())
        judged = rejections(documents, self.encoder.supports_images).withColumn("rejected", F.coalesce("rejected", F.when(F.col("doc_id").isNull(), F.lit("no doc_id"))))
        # Documents are written, then read: ids are drawn once, and texts encoded once.
        new = self.documents.stage(judged.where("rejected is null").drop("rejected"))
        stored = self.documents.staged(new)
        tokens = self.tokens.stage(self.token_rows(stored))
        keys = stored.select("doc_id")
        before = (self.documents.stage_without(keys), self.tokens.stage_without(keys)) if mode == "replace" else (self.documents._parts(), self.tokens._parts())
        version = self._publish({"documents": before[0] + new, "tokens": before[1] + tokens})
        return Indexed(version, keys.distinct(), judged.where("rejected is not null").groupBy("rejected").agg(F.count("*").alias("rows")))

    def delete(self, keys: DataFrame) -> bool:
        """Remove documents and their tokens; always True."""
        self._publish({"tokens": self.tokens.stage_without(keys), "documents": self.documents.stage_without(keys)})
        return True

    def _publish(self, parts: dict[str, list[str]]) -> int:
        version = self.store.publish(parts)
        self.forget()
        return version

    def forget(self) -> None:
        """Drop cached tokens; every change of the index does so."""
        for df in self._cached.values():
            df.unpersist()
        self._cached.clear()

    def cached_tokens(self) -> DataFrame:
        """The tokens of the newest version, kept in the executors' memory and disks for further searches until the index changes.

        What was kept of an older version, as another writer may have published one, is dropped."""
        version = self.store.versions()[-1]
        if version not in self._cached:
            self.forget()
            self._cached[version] = self.tokens.read(version).persist()
        return self._cached[version]

    def search(self, queries: DataFrame, k: int = 10, text_column: str = "query", pool_distance: float = 0.03, cached: bool = False, **options) -> DataFrame:
        """late.search() for query texts (query_id, text_column): encoded by the index's encoder and pooled."""
        asked = late.query_tokens(queries, self.encoder, text_column, pool_distance)
        return late.search(asked, self.cached_tokens() if cached else self.tokens.read(), self.documents.read(), self.encoder.dim, k, **options)
