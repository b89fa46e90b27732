"""Queries of the training-data operators, and their SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .copies import Copies
from .languages import document_languages, fit, language_passages, unlabelled_languages
from .leakage import leaked_pairs, leaked_spans, without_leaks
from .mixing import Mixture
from .neardup import NearDuplicates
from .neighbours import all_neighbours, neighbour_pairs
from .splitting import split_oversized
from .stable_sample import PermanentSample

SAMPLE_SHARE = 0.1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "astra_multi_vector_table")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(all_neighbours(_chunks(spark, sf_dir)))


def p2_stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The early half of the batches is sampled first, then the rest comes in.

    The registry is a new, empty one on each run; runs agree because a number is the md5 of its id. With a path PermanentSample
    keeps its registry and its largest share from run to run."""
    chunks = _chunks(spark, sf_dir)
    sample = PermanentSample(spark)
    early = F.coalesce(F.col("ingest_batch") <= 5, F.lit(False))
    sample.insert(chunks.where(early), "chunk_id")
    sample.insert(chunks.where(~early), "chunk_id")
    return sample.select(chunks.select("row_id", "chunk_id", "ingest_batch"), "chunk_id", SAMPLE_SHARE).select("row_id", F.round("u", 12).alias("u"), "ingest_batch")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Copies(_chunks(spark, sf_dir)).pairs()


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Copies(_chunks(spark, sf_dir)).collapsed()


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that has a key, with the representative of its record."""
    return Copies(_chunks(spark, sf_dir)).members()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(_chunks(spark, sf_dir)).row_pairs()


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(_chunks(spark, sf_dir)).members()


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = _table(spark, sf_dir, "column_options").where("column_name = 'multi_embeddings'").select(F.col("book_name").alias("group"), "max_chars", "overlap_chars")
    return split_oversized(_chunks(spark, sf_dir), limits)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece = 0 and pieces > 1").select("row_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p5_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row that was cut: how many characters its pieces cover, and whether all are within the limit and share the overlap asked for.

    The SQL has the length of the content and says that both hold."""
    limits = _table(spark, sf_dir, "column_options").where("column_name = 'multi_embeddings'").groupBy("book_name").agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap"))).alias("l"))
    before = F.lag("end_char").over(Window.partitionBy("row_id").orderBy("piece"))
    pieces = _pieces(spark, sf_dir).where("pieces > 1").withColumn("shared", F.coalesce(before, F.lit(0)) - F.col("start_char"))
    found = pieces.join(_chunks(spark, sf_dir).select("row_id", "book_name"), "row_id").join(limits, "book_name")
    due = F.when(F.col("piece") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("l.overlap"), F.col("l.max_chars") - 1)))
    return found.groupBy("row_id").agg(F.max("end_char").alias("chars"), F.every(F.length("piece_text") <= F.col("l.max_chars")).alias("fit"), F.every(F.col("shared") == due).alias("overlap"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(leaked_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p6_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document how many words are cut out, and how many the cleaned text has."""
    left = F.size(F.regexp_extract_all(F.coalesce("clean_text", F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return p6_cleaned(spark, sf_dir).select("doc_id", "removed_words", left.alias("kept_words"))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return Mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mixture_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).drawn


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def p7_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target whether the share of the drawn tokens is within 0.01 of it, the targets being scaled to the sources that have
    documents, and no document is drawn more often than it may. The SQL says which sources those are and that all are reached, which can
    only be where a document is less than a hundredth of what is drawn (not at sf0.001, where 17 documents are)."""
    near = (F.abs(F.col("actual_share") - F.col("scaled_share")) <= 0.01) & (F.coalesce("most_copies", F.lit(0)) <= F.col("max_repeats"))
    return _mixture(spark, sf_dir).shares().select("source", F.round("scaled_share", 9).alias("scaled_share"), near.alias("within"))


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = _table(spark, sf_dir, "documents")
    return documents, language_passages(documents, fit(documents))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return unlabelled_languages(documents, fit(documents))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, found = _languages(spark, sf_dir)
    return document_languages(found, documents)


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_stable_sample, p3_found, p3_collapsed, p3_members, p4_found, p4_members, p5_found, p5_pieces, p5_checked, p6_found, p6_cleaned, p6_removed, p7_mixture, p7_shares, p7_reached, p8_found, p8_documents, p8_passages)}


# Ids and contents without what formatting may change; a content of named fields is its sorted set of them.
_SAME = r"""
    WITH c AS (SELECT row_id, chunk_id, content, trim(content, chr(32) || chr(9) || chr(10) || chr(13)) AS bare FROM astra_multi_vector_table WHERE chunk_id IS NOT NULL AND content IS NOT NULL),
    p AS (SELECT *, CASE WHEN bare LIKE '{%}' AND json_valid(bare) THEN json_keys(bare) END AS names,
        list_filter(str_split(bare, chr(10)), lambda x: trim(x) <> '') AS lines, list_filter(str_split(bare, '|'), lambda x: trim(x) <> '') AS bars, list_filter(str_split(bare, ';'), lambda x: trim(x) <> '') AS semis FROM c),
    f AS (SELECT *, CASE WHEN len(names) >= 3 THEN list_transform(names, lambda x: x || ':' || json_extract_string(bare, '$."' || x || '"'))
        WHEN bare LIKE '{%}' THEN NULL
        WHEN len(lines) >= 3 AND len(list_filter(lines, lambda x: NOT regexp_full_match(trim(x), '[^:;|{}\n\r]{1,80}:.*'))) = 0 THEN lines
        WHEN len(bars) >= 3 AND len(list_filter(bars, lambda x: NOT regexp_full_match(trim(x), '[^:;|{}\n\r]{1,80}:.*', 's'))) = 0 THEN bars
        WHEN len(semis) >= 3 AND len(list_filter(semis, lambda x: NOT regexp_full_match(trim(x), '[^:;|{}\n\r]{1,80}:.*', 's'))) = 0 THEN semis END AS fields FROM p),
    k AS (SELECT row_id, lower(regexp_replace(chunk_id, '[^\p{L}\p{N}]+', '', 'g')) AS id, CASE WHEN fields IS NULL THEN 'T' || lower(regexp_replace(content, '[^\p{L}\p{N}]+', '', 'g')) ELSE
        'F' || array_to_string(list_sort(list_distinct(list_transform(fields, lambda x: lower(regexp_replace(substr(x, 1, instr(x, ':') - 1), '[^\p{L}\p{N}]+', '', 'g')) || ':' ||
          lower(regexp_replace(substr(x, instr(x, ':') + 1), '[^\p{L}\p{N}]+', '', 'g'))))), '|') END AS body FROM f)
    """

# The items' grams, and all windows of as many words of the documents.
_WINDOWS = r"""
    WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
    n AS (SELECT *, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
    g AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS j FROM n)),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT DISTINCT n FROM g),
    t AS (SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(1, CAST(greatest(len(w) - n + 2, 1) AS BIGINT))) AS j FROM d, s))
    """


def oracle_sql() -> dict[str, str]:
    return {
        "p2_stable_sample": """
            WITH k AS (SELECT row_id, ingest_batch, lower(regexp_replace(chunk_id, '[^\\p{L}\\p{N}]+', '', 'g')) AS id FROM astra_multi_vector_table),
            n AS (SELECT row_id, ingest_batch, CAST(CAST('0x' || substr(md5('0' || chr(31) || id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM k WHERE id <> '')
            SELECT row_id, round(u, 12) AS u, ingest_batch FROM n WHERE u < 0.1""",
        "p3_found": _SAME + "SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM k a JOIN k b ON a.id = b.id AND a.body = b.body AND a.row_id < b.row_id",
        "p3_collapsed": _SAME + "SELECT min(row_id) AS row_id, count(*) AS copies FROM k GROUP BY id, body",
        "p3_members": _SAME + "SELECT row_id, min(row_id) OVER (PARTITION BY id, body) AS representative FROM k",
        "p5_checked": """
            SELECT c.row_id, length(c.content)::INT AS chars, true AS fit, true AS overlap FROM astra_multi_vector_table c JOIN column_options o ON o.book_name = c.book_name AND o.column_name = 'multi_embeddings'
            WHERE length(c.content) > o.max_chars""",
        "p6_found": _WINDOWS + "SELECT DISTINCT doc_id, item_id FROM t JOIN g USING (n, gram)",
        "p6_removed": _WINDOWS + """,
            c AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM (SELECT DISTINCT doc_id, j, n FROM t JOIN g USING (n, gram))) GROUP BY doc_id)
            SELECT doc_id, coalesce(c, 0)::INT AS removed_words, (coalesce(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')), 0) - coalesce(c, 0))::INT AS kept_words FROM documents LEFT JOIN c USING (doc_id)""",
        "p7_reached": """
            WITH s AS (SELECT DISTINCT lower(regexp_replace(source, '[^\\p{L}\\p{N}]+', '', 'g')) AS k FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
            t AS (SELECT *, lower(regexp_replace(source, '[^\\p{L}\\p{N}]+', '', 'g')) IN (SELECT k FROM s WHERE k <> '') AS has FROM mixture_targets)
            SELECT source, round(CASE WHEN has THEN target_share / (SELECT sum(target_share) FROM t WHERE has) ELSE 0 END, 9) AS scaled_share, true AS within FROM t""",
        "p5_found": """
            SELECT c.row_id FROM astra_multi_vector_table c JOIN column_options o ON o.book_name = c.book_name AND o.column_name = 'multi_embeddings'
            WHERE length(c.content) > o.max_chars""",
    }
