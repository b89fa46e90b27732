import pytest
from pyspark.sql import functions as F

from vecmill.llm.stable_sample import PermanentSample
from vecmill.session import new_path


def chosen(sample, df, share):
    return {r.row_id for r in sample.select(df, "chunk_id", share).collect()}


def test_sample_is_stable(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.concat(F.lit("Id-"), (F.col("id") % 1500)).alias("chunk_id"), F.lit("mine").alias("u"), F.lit(1).alias("id"))
    early, path = df.where("row_id < 700"), new_path(spark, "reg")
    a = PermanentSample(spark, path)
    a.insert(early, "chunk_id")
    first = chosen(a, early, 0.2)
    assert 90 < len(first) < 190
    a.insert(df, "chunk_id")
    assert a.registry().count() == 1500
    both = chosen(PermanentSample(spark, path, seed="other"), df.repartition(9), 0.2)
    assert first <= both and {r for r in both if r < 700} == first
    assert both == {r for r in range(2000) if r % 1500 in {x % 1500 for x in both}}
    more = chosen(a, df, 0.3)
    assert both < more and chosen(a, df, 0.1) == more  # the share never falls
    assert a.select(df, "chunk_id", 0.3).columns == ["row_id", "chunk_id", "id", "u"]
    b = PermanentSample(spark)
    b.insert(df.repartition(5), "chunk_id")
    assert chosen(b, df, 0.3) == more


def test_spellings_nulls_and_empty_tables(spark):
    rows = [(1, "ab-12"), (2, "{AB12}"), (3, " ab12 "), (4, None), (5, ""), (6, "--")]
    df = spark.createDataFrame(rows, "row_id long, chunk_id string")
    s = PermanentSample(spark)
    assert chosen(s, df, 1.0) == set()  # nothing was inserted
    s.insert(df.limit(0), "chunk_id")
    s.insert(df, "chunk_id")
    s.insert(df, "chunk_id")
    assert s.registry().count() == 1 and chosen(s, df, 1.0) == {1, 2, 3} and chosen(s, df.limit(0), 1.0) == set()
    with pytest.raises(ValueError):
        s.threshold(1.5)
