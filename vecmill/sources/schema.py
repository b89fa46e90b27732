"""Vector column options, table schemas and validation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(Enum):
    """Where a column's vectors come from: an encoder of ours, a service, or the caller."""

    SENTENCE_TRANSFORMER = "sentence_transformer"
    VECTORIZE = "vectorize"
    PRECOMPUTED = "precomputed"


@dataclass(frozen=True)
class VectorColumn:
    """A vector column: name, dimension, kind, encoder, and the options of its service and index."""

    column_name: str
    dimension: int
    kind: Kind
    encoder: Any = None
    vector_service_options: dict | None = None
    table_vector_index_options: dict | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.kind, Kind):
            raise ValueError("kind must be a Kind")
        if not isinstance(self.column_name, str) or not self.column_name:
            raise ValueError("column_name must be a string that is not empty")
        if isinstance(self.dimension, bool) or not isinstance(self.dimension, int) or self.dimension < 1:
            raise ValueError("dimension must be a positive whole number")
        if self.kind is Kind.SENTENCE_TRANSFORMER and self.encoder is None:
            raise ValueError("this kind needs an encoder")
        if self.kind is Kind.VECTORIZE and not self.vector_service_options:
            raise ValueError("this kind needs the options of its service")

    @classmethod
    def precomputed(cls, column_name: str, dimension: int, index_options: dict | None = None) -> VectorColumn:
        return cls(column_name, dimension, Kind.PRECOMPUTED, None, None, index_options)

    @classmethod
    def encoded(cls, encoder: Any, column_name: str | None = None, index_options: dict | None = None) -> VectorColumn:
        """A column filled by an encoder; its name is the encoder's with all but letters, digits and underscores replaced."""
        name = column_name or re.sub(r"[^\w\d]", "_", getattr(encoder, "name", None) or "default_model")
        return cls(name, encoder.dim, Kind.SENTENCE_TRANSFORMER, encoder, None, index_options)

    @classmethod
    def serviced(cls, column_name: str, dimension: int, service_options: dict, index_options: dict | None = None, encoder: Any = None) -> VectorColumn:
        """A column filled by a service. The encoder stands for the service and turns the raw text into the vector."""
        return cls(column_name, dimension, Kind.VECTORIZE, encoder, service_options, index_options)

    @property
    def metric(self) -> str:
        return (self.table_vector_index_options or {}).get("metric", "cosine")

    def to_dict(self) -> dict:
        return {
            "column_name": self.column_name, "dimension": self.dimension, "type": self.kind.name, "model": getattr(self.encoder, "name", None),
            "vector_service_options": self.vector_service_options, "table_vector_index_options": self.table_vector_index_options,
        }

    def field(self) -> T.StructField:
        return T.StructField(self.column_name, T.ArrayType(T.FloatType()), True, {"vector_column": json.dumps(self.to_dict())})


def chunk_schema(columns: Iterable[VectorColumn]) -> T.StructType:
    """Chunk table: id, content and a vector column for each option."""
    columns = list(columns)
    names = [c.column_name for c in columns]
    if len(set(names)) < len(names) or {"chunk_id", "content"} & set(names):
        raise ValueError("vector columns need names of their own")
    return T.StructType([T.StructField("chunk_id", T.StringType(), False), T.StructField("content", T.StringType()), *(c.field() for c in columns)])


def document_schema(images: bool = False) -> T.StructType:
    """Document table, one row a page; content_type only where images are supported."""
    fields = [T.StructField("doc_id", T.StringType(), False), T.StructField("page_number", T.IntegerType()), T.StructField("content", T.StringType())]
    return T.StructType([*fields, *([T.StructField("content_type", T.StringType())] if images else [])])


def token_schema(dim: int) -> T.StructType:
    """Token table, one row a token vector."""
    vector = T.StructField("token_embedding", T.ArrayType(T.FloatType()), False, {"dimension": dim})
    return T.StructType([T.StructField("doc_id", T.StringType(), False), T.StructField("token_id", T.StringType(), False), vector])


def checked_columns(requested: str | list[str] | None, known: Iterable[str]) -> list[str]:
    """The vector columns to search: all if none is named, one if a name is given. Unknown ones and an empty list are errors."""
    known = list(known)
    chosen = known if requested is None else [requested] if isinstance(requested, str) else list(requested)
    if not chosen:
        raise ValueError("no vector column to search")
    if unknown := [c for c in chosen if c not in known]:
        raise ValueError(f"unknown vector columns: {unknown}")
    return chosen


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema: others are dropped, missing ones are null, types are cast."""
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields))


def schema_difference(df: DataFrame, schema: T.StructType) -> tuple[list[str], list[str]]:
    """Columns the schema lacks (they would be dropped), and columns the rows lack (they would be null)."""
    return [c for c in df.columns if c not in schema.fieldNames()], [c for c in schema.fieldNames() if c not in df.columns]


def rejections(df: DataFrame, images: bool = False) -> DataFrame:
    """df with `rejected`: why a document row can't be indexed, or null."""
    kind = F.coalesce(F.col("content_type"), F.lit("text")) if "content_type" in df.columns else F.lit("text")
    why = F.when(F.col("content").isNull() | (F.trim("content") == ""), "no content").when(~kind.isin("text", "image"), "unknown content type")
    return df.withColumn("rejected", why.when(kind == "image", F.lit(None if images else "the model takes no images")))


def missing_vectors(df: DataFrame, columns: Iterable[VectorColumn]) -> DataFrame:
    """df with `missing_vectors`: names of the precomputed columns whose vector a row lacks or has in another length."""
    bad = [F.when(~F.coalesce(F.size(c.column_name) == c.dimension, F.lit(False)) if c.column_name in df.columns else F.lit(True), F.lit(c.column_name)) for c in columns if c.kind is Kind.PRECOMPUTED]
    return df.withColumn("missing_vectors", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))


def check_precomputed(df: DataFrame, columns: Iterable[VectorColumn]) -> None:
    """ValueError if a row lacks a precomputed vector of the right length."""
    if missing_vectors(df, columns).where(F.size("missing_vectors") > 0).limit(1).count():
        raise ValueError("precomputed vectors are missing or of another length")


def options_from_table(df: DataFrame) -> DataFrame:
    """Stored column options as fields: column_name, dimension, type, model, provider, service_model, metric."""
    service, index = F.col("vector_service_options"), F.col("table_vector_index_options")
    return df.select(
        "book_name", "column_name", "dimension", F.col("column_type").alias("type"), "model", F.get_json_object(service, "$.provider").alias("provider"),
        F.get_json_object(service, "$.model_name").alias("service_model"), F.coalesce(F.get_json_object(index, "$.metric"), F.lit("cosine")).alias("metric"),
    )
