import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.operators import batches, late, multivector
from vecmill.operators.encoders import HashingEncoder, encode_column, encode_tokens, parallel_map
from vecmill.session import new_path
from vecmill.sources import readers, schema
from vecmill.sources.index import ChunkIndex, LateIndex
from vecmill.sources.schema import Kind, VectorColumn
from vecmill.sources.store import Table
from vecmill.streaming.ingest import index_stream


def test_column_options():
    c = VectorColumn.encoded(HashingEncoder(8, "org/model-1"), index_options={"metric": "dot_product"})
    assert (c.column_name, c.dimension, c.metric) == ("org_model_1", 8, "dot_product")
    assert c.to_dict() == {"column_name": "org_model_1", "dimension": 8, "type": "SENTENCE_TRANSFORMER", "model": "org/model-1", "vector_service_options": None, "table_vector_index_options": {"metric": "dot_product"}}
    assert VectorColumn.serviced("s", 3, {"provider": "p"}).to_dict()["type"] == "VECTORIZE" and VectorColumn.precomputed("p", 3).metric == "cosine"
    for bad in (lambda: VectorColumn("x", 0, Kind.PRECOMPUTED), lambda: VectorColumn("", 3, Kind.PRECOMPUTED), lambda: VectorColumn("x", 3, "precomputed"), lambda: VectorColumn("x", 3, Kind.VECTORIZE), lambda: VectorColumn("x", 3, Kind.SENTENCE_TRANSFORMER), lambda: schema.chunk_schema([VectorColumn.precomputed("content", 3)])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        VectorColumn.precomputed()


def test_chunk_index(spark):
    index = ChunkIndex(spark, new_path(spark, "chunks"), [VectorColumn.encoded(HashingEncoder(4), "e"), VectorColumn.precomputed("p", 2)])
    rows = spark.createDataFrame([("one two", [1.0, 2.0], 5), (None, [1.0, 2.0], 6)], "content string, p array<float>, more int")
    index.insert(rows)
    index.insert(rows.withColumn("chunk_id", F.lit("x")))
    got = index.table.read()
    assert got.columns == ["chunk_id", "content", "e", "p"] and got.count() == 4 and got.where("e is null").count() == 2 and index.table.read(2).count() == 2
    with pytest.raises(ValueError):
        index.insert(rows.withColumn("p", F.array(F.lit(1.0))))
    with pytest.raises(ValueError):
        index.insert(rows.drop("p"))
    assert index.table.read().count() == 4
    index.insert(rows.limit(0))
    assert index.table.read().count() == 4


def test_late_index(spark):
    index = LateIndex(spark, new_path(spark, "late"), HashingEncoder(4), pool_factor=1)
    docs = spark.createDataFrame([("a", 1, "x y z"), ("b", None, "u"), ("c", 1, " "), ("d", 1, None), (None, 1, "lost")], "doc_id string, page_number int, content string")
    index.index(docs)
    count = lambda t: {r.doc_id: r["count"] for r in t.read().groupBy("doc_id").count().collect()}
    assert count(index.tokens) == {"a": 3, "b": 1} and count(index.documents) == {"a": 1, "b": 1}
    index.index(docs.where("doc_id = 'a'").withColumn("content", F.lit("x y")))
    assert count(index.tokens) == {"a": 2, "b": 1}
    index.index(docs.where("doc_id = 'a'"), "append")
    assert count(index.tokens) == {"a": 5, "b": 1}
    assert index.delete(spark.createDataFrame([("a",), ("nobody",), (None,)], "doc_id string"))
    assert count(index.tokens) == count(index.documents) == {"b": 1}
    with pytest.raises(ValueError):
        index.index(docs, "merge")


def test_index_reports_what_it_did(spark):
    index = LateIndex(spark, new_path(spark, "late"), HashingEncoder(4))
    docs = spark.createDataFrame([("a", 1, "x y z"), ("a", 2, "u"), ("c", 1, " "), (None, 1, "lost")], "doc_id string, page_number int, content string")
    done = index.index(docs)
    assert [r.doc_id for r in done.ids.collect()] == ["a"] and {r.rejected: r.rows for r in done.rejected.collect()} == {"no content": 1, "no doc_id": 1}
    assert index.store.versions()[-1] == done.version  # documents and tokens in one
    index.index(docs.drop("doc_id"))
    ids = {r.doc_id for r in index.documents.read().collect()}
    assert ids == {r.doc_id for r in index.tokens.read().collect()} and len(ids) == 4  # new ids are the same in both


def test_a_change_rewrites_its_buckets_only(spark):
    table = Table(spark, new_path(spark, "table"), schema.document_schema(), "doc_id", buckets=8).create()
    rows = spark.createDataFrame([(f"d{i}", 1, "x") for i in range(100)], "doc_id string, page_number int, content string")
    table.append(rows)
    before = set(table._parts())
    table.delete(rows.where("doc_id = 'd7'"))
    after = set(table._parts())
    assert len(before) == 8 and len(before - after) == 1 and table.read().count() == 99
    table.replace(spark.createDataFrame([("d8", 2, "y"), ("new", 1, "z")], "doc_id string, page_number int, content string"))
    assert len(after - set(table._parts())) <= 2 and table.read().count() == 100 and table.read(2).count() == 100
    table.delete(rows.limit(0))
    table.compact()
    assert len(table._parts()) == 8 and {r.page_number for r in table.read().where("doc_id = 'd8'").collect()} == {2}


def test_cached_tokens_follow_the_index(spark):
    index = LateIndex(spark, new_path(spark, "late"), HashingEncoder(4), pool_factor=1)
    docs = spark.createDataFrame([("a", 1, "red green blue"), ("b", 1, "black white grey")], "doc_id string, page_number int, content string")
    index.index(docs)
    asked = spark.createDataFrame([(1, "black white"), (2, None)], "query_id long, query string")
    first = index.search(asked, 1, cached=True).collect()
    assert [(r.query_id, r.doc_id) for r in first] == [(1, "b")] and first[0].score == pytest.approx(2)
    kept = index.cached_tokens()
    assert kept.storageLevel.useMemory and index.cached_tokens() is kept
    index.delete(docs.where("doc_id = 'b'"))
    assert not kept.storageLevel.useMemory and [r.doc_id for r in index.search(asked, 1, cached=True).collect()] == ["a"]
    index.forget()
    half = lambda best: best.groupBy("query_id", "doc_id").agg((F.sum("best") / 2).alias("score"))
    assert index.search(asked, 1, pool_distance=0, scorer=half).first().score == pytest.approx(index.search(asked, 1, pool_distance=0).first().score / 2)


def test_token_matrices_are_checked(spark):
    class Odd(HashingEncoder):
        def encode_tokens(self, texts):
            return [self.made] * len(texts)

    df = spark.createDataFrame([(1, "a b")], "i long, t string")
    for made, error in (([[1.0]], "TypeError"), (np.ones(4), "ValueError"), (np.ones((2, 3)), "ValueError")):
        odd = Odd(4)
        odd.made = made
        with pytest.raises(Exception, match=error):
            encode_tokens(df, ["i"], "t", odd).collect()


def test_stated_queries_are_checked(spark):
    columns = [VectorColumn.encoded(HashingEncoder(4), "e"), VectorColumn.precomputed("p", 2)]
    rows = multivector.query_rows(spark, ["one", "two"], columns, {"p": [[1, 2], [3, 4]]}).orderBy("query_id").collect()
    assert [r.p for r in rows] == [[1, 2], [3, 4]] and all(len(r.e) == 4 for r in rows)
    for wrong in ({"p": [[1, 2]]}, {}, {"p": [[1, 2], [3, 4]], "e": []}):
        with pytest.raises(ValueError):
            multivector.query_rows(spark, ["one", "two"], columns, wrong)


def test_fetch(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "doc_id string, n int")
    ids = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "doc_id string")
    assert sorted(r.n for r in late.fetch(table, ids).collect()) == [1, 2]


def test_stream(spark, tmp_path):
    index = LateIndex(spark, new_path(spark, "stream"), HashingEncoder(4), pool_factor=1)
    spark.createDataFrame([("a", 1, "x y z"), ("b", 1, "u")], "doc_id string, page_number int, content string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        index_stream(spark.readStream.schema("doc_id string, page_number int, content string").parquet(str(tmp_path / "in")), index, str(tmp_path / "c")).awaitTermination()
    assert index.tokens.read().count() == 4


def test_validation(spark):
    df = spark.createDataFrame([("a", "text", "x"), ("b", None, " "), ("c", "image", "u"), ("d", "film", "x")], "doc_id string, content_type string, content string")
    assert [r.rejected for r in schema.rejections(df).orderBy("doc_id").collect()] == [None, "no content", "the model takes no images", "unknown content type"]
    assert [r.rejected for r in schema.rejections(df, True).orderBy("doc_id").collect()][2] is None
    assert schema.schema_difference(df, schema.document_schema()) == (["content_type"], ["page_number"])


def test_encoders_and_map(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "!")], "i long, t string")
    rows = encode_column(df, "t", {"v": HashingEncoder(4), "w": HashingEncoder(2)}).orderBy("i").collect()
    assert len(rows[0].v) == 4 and rows[1].v is None and rows[2].w == [0, 0]
    assert [(r.i, r.position) for r in encode_tokens(df, ["i"], "t", HashingEncoder(4)).collect()] == [(1, 0), (1, 1)]
    assert encode_tokens(df.limit(0), ["i"], "t", HashingEncoder(4)).count() == 0
    assert [r.n for r in parallel_map(df, ["i"], "t", lambda x: [len(v or "") for v in x], "n int").collect()] == [3, 0, 1]


def test_batches_and_summaries(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "i long").repartition(5)
    got = {r.i: r.batch for r in batches.batch_numbers(df, ["i"], 10).collect()}
    assert got == {i: i // 10 + 1 for i in range(25)}
    assert batches.batch_numbers(df.limit(0), ["i"], 10).count() == 0
    row = batches.latency_summary(df, "i").first()
    assert (row.avg_value, row.min_value, row.max_value, row.p50, row.p75) == (12, 0, 24, 12, 18)


def test_quantiles_by_ranks(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=301), "b": np.repeat([5.0, 7.0], [200, 100]), "c": np.array([3.0]), None: rng.normal(size=20)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("empty", None)]
    got = {r.k: r for r in batches.latency_summary(spark.createDataFrame(rows, "k string, v double").repartition(7), "v", ["k"]).collect()}
    assert got.keys() == values.keys()
    for k, x in values.items():
        assert [got[k][f"p{p}"] for p in (50, 75, 90, 95, 99)] == pytest.approx(np.quantile(x, [0.5, 0.75, 0.9, 0.95, 0.99]).tolist())
        assert (got[k].avg_value, got[k].min_value, got[k].max_value) == pytest.approx((x.mean(), x.min(), x.max()))
    none = batches.latency_summary(spark.createDataFrame([], "v double"), "v").collect()
    assert len(none) == 1 and none[0].p50 is None


def test_readers(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Id,Questions\n1,"What, then?"\n2,"Two\nlines"\n')
    assert [r.Questions for r in readers.questions(spark, str(tmp_path / "q.csv")).collect()] == ["What, then?", "Two\nlines"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.html").write_text("<p>Hi</p>")
    assert [r.text for r in readers.html_pages(spark, str(tmp_path)).collect()] == ["Hi"]
    (tmp_path / "b.txt").write_text("one two\n\nthree")
    books = readers.whole_texts(spark, str(tmp_path / "b.txt")).withColumn("book", F.lit("b"))
    assert [r.content for r in readers.book_chunks(books, "book", "text", 8).orderBy("chunk_no").collect()] == ["one two", "three"]
