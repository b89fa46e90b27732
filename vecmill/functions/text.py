"""Text expressions and the recursive chunker."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tried in this order.
SEPARATORS = ("\n\n", "\n", " ", "")


def sanitize_identifier(name: Column, default: str = "default_model") -> Column:
    """A column name out of a model's name: everything but letters, digits and underscores becomes an underscore."""
    return F.regexp_replace(F.coalesce(name, F.lit(default)), r"[^\p{L}\p{N}_]", "_")


def words(text: Column) -> Column:
    """Lower-cased runs of letters or digits; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def word_count(text: Column) -> Column:
    """Number of stretches between blanks; 0 for null and blank texts."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def excerpt(text: Column, length: int) -> Column:
    """The beginning of a text, with an ellipsis if something was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def provenance_text(sources: Column, column: str = "column_name", rank: str = "hit_rank") -> Column:
    """`column (rank n)` of each entry, joined by commas; empty for null and empty provenance."""
    parts = F.transform(sources, lambda s: F.concat(F.coalesce(s[column], F.lit("?")), F.lit(" (rank "), F.coalesce(s[rank].cast("string"), F.lit("?")), F.lit(")")))
    return F.coalesce(F.array_join(parts, ", "), F.lit(""))


def strip_tags(html: Column) -> Column:
    """The text of an HTML page: scripts, styles, comments and tags go, blanks are collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def chunks_of(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Stripped pieces of at most `size` characters. Cuts at the first separator that occurs; parts that are still too long are cut at
    the next ones, short neighbours are put together. No piece is blank."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator = separators[at]
    if separator == "":
        return [p.strip() for p in (text[i : i + size] for i in range(0, len(text), size)) if p.strip()]
    out: list[str] = []
    open_parts: list[str] = []
    length = 0

    def close() -> None:
        nonlocal length
        piece = separator.join(open_parts).strip()
        if piece:
            out.append(piece)
        open_parts.clear()
        length = 0

    for part in text.split(separator):
        if len(part) > size:
            close()
            out.extend(chunks_of(part, size, separators[at + 1 :]))
            continue
        if open_parts and length + len(separator) + len(part) > size:
            close()
        length += len(part) + (len(separator) if open_parts else 0)
        open_parts.append(part)
    close()
    return out


def chunk_texts(df: DataFrame, id_column: str, text_column: str, size: int = 500) -> DataFrame:
    """(id, chunk_no, chunk): the chunks of every text; null and blank texts have none."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, nth, out = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                pieces = chunks_of(text, size)
                take += [i] * len(pieces)
                nth += range(len(pieces))
                out += pieces
            yield pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), pa.array(nth, pa.int32()), pa.array(out, pa.string())], names=["id", "chunk_no", "chunk"])

    picked = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("t")).where("t is not null")
    return picked.mapInArrow(run, f"id {kind}, chunk_no int, chunk string")
