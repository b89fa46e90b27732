"""Sources of texts and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_texts, strip_tags


def questions(spark: SparkSession, path: str, column: str = "Questions") -> DataFrame:
    """One text column of CSV files with a header; quoted values may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(column)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, a file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all *.html files below a folder, without tags."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*html").option("recursiveFileLookup", "true").load(folder)
    return read.select("path", strip_tags(F.decode("content", "UTF-8")).alias("text"))


def book_chunks(texts: DataFrame, book_column: str, text_column: str, size: int = 500) -> DataFrame:
    """(book_name, chunk_no, content): texts cut into chunks, ready to be inserted and partitioned by book."""
    return chunk_texts(texts, book_column, text_column, size).select(F.col("id").alias("book_name"), "chunk_no", F.col("chunk").alias("content"))
