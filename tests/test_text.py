import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.functions import text


def test_expressions(spark):
    df = spark.createDataFrame([("intfloat/e5-small é",), (None,)], "m string").select(text.sanitize_identifier(F.col("m")).alias("s"))
    assert [r.s for r in df.collect()] == [re.sub(r"[^\w\d]", "_", "intfloat/e5-small é"), "default_model"]
    texts = ["a b  c", " ", None, "one", "\n x\ty "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.n for r in df.select(text.word_count(F.col("t")).alias("n")).collect()] == [3, 0, 0, 1, 2]
    assert [r.e for r in df.select(text.excerpt(F.col("t"), 3).alias("e")).collect()] == ["a b...", " ", None, "one", "\n x..."]
    df = spark.createDataFrame([("<p>A <b>b</b></p><script>x<1</script><!-- c -->d",)], "h string").select(text.strip_tags(F.col("h")).alias("t"))
    assert df.first().t == "A b d"


@given(st.text(alphabet="ab \n.", max_size=200), st.integers(1, 30))
def test_chunks_keep_all_but_blanks_and_fit(t, size):
    pieces = text.chunks_of(t, size)
    assert all(0 < len(p) <= size for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(t.split())


def test_chunk_texts(spark):
    df = spark.createDataFrame([(1, "a b c " * 50), (2, None), (3, "  "), (4, "short")], "i int, t string")
    got = text.chunk_texts(df, "i", "t", 20).collect()
    assert {r.id for r in got} == {1, 4} and max(len(r.chunk) for r in got) <= 20
    assert [r.chunk_no for r in got if r.id == 4] == [0]
    assert text.chunk_texts(df.limit(0), "i", "t").count() == 0
