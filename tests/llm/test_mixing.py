import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.llm.mixing import TOKENIZERS, Mixture, sainte_lague, shard_quotas

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizers")


def test_apportionment():
    assert sainte_lague(7, {"a": 53000, "b": 24000, "c": 23000}, {"a": 9, "b": 9, "c": 9}) == {"a": 3, "b": 2, "c": 2}
    assert sainte_lague(7, {"a": 0.9, "b": 0.1}, {"a": 3, "b": 9}) == {"a": 3, "b": 4}
    assert sainte_lague(50, {"a": 1.0, "b": 1.0}, {"a": 3, "b": 2}) == {"a": 3, "b": 2}
    assert sainte_lague(3, {}, {}) == {}


def one_by_one(seats, weights, capacity):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_parties = [p for p in weights if weights[p] > 0 and got[p] < capacity[p]]
        if not open_parties:
            break
        got[max(open_parties, key=lambda p: (weights[p] / (2 * got[p] + 1), -p))] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 90), st.lists(st.tuples(st.sampled_from([0, 0.1, 0.25, 1.0, 3, 0.37]), st.integers(0, 30)), min_size=1, max_size=6))
def test_apportionment_equals_giving_one_by_one(seats, parties):
    weights, capacity = ({i: p[j] for i, p in enumerate(parties)} for j in (0, 1))
    assert sainte_lague(seats, weights, capacity) == one_by_one(seats, weights, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 50), st.integers(1, 9), st.integers(1, 4), st.floats(0, 1))
def test_shard_quotas_equal_apportionment(blocks, size, repeats, part):
    seats, (full, rest) = round(part * blocks * repeats), divmod(blocks, size)
    weights = {i: size for i in range(full)} | ({full: rest} if rest else {})
    every, more, last = shard_quotas(seats, blocks, size, repeats)
    mine = {i: every + (i < more) for i in range(full)} | ({full: last} if rest else {})
    assert mine == one_by_one(seats, weights, {i: x * repeats for i, x in weights.items()})


def test_many_seats_take_no_time():
    got = sainte_lague(10**12, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10**13, "b": 10**13, "c": 10**11})
    assert sum(got.values()) == 10**12 and got["c"] == 10**11 and abs(got["a"] - 5 / 8 * 9e11) < 2


def tables(spark, n=3000):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), (F.col("id") % 13 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "Big-One").when(F.col("id") % 9 == 0, "small ").otherwise("MID").alias("source"), F.lit(1).alias("tokens"))
    docs = spark.createDataFrame(docs.collect(), "doc_id long, text string, source string, tokens int")
    odd = spark.createDataFrame([(None, "x", "mid", 1), (90001, None, "mid", 1), (90002, "", "mid", 1), (90003, "x", None, 1), (90004, "x", "stranger", 1)], docs.schema)
    targets = spark.createDataFrame([("big_one", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.5, 1), ("nil", None, 1), ("stranger", 0.0, 1)], "source string, target_share double, max_repeats int")
    return docs.unionByName(odd), targets


def test_shares_are_reached(spark):
    docs, targets = tables(spark)
    mix = Mixture(docs, targets)
    shares = {r.source: r for r in mix.shares().collect()}
    assert shares.keys() == {"big_one", "mid", "small", "absent"} and shares["absent"].tokens == 0
    for s in ("big_one", "mid", "small"):
        assert abs(shares[s].actual_share - shares[s].target_share / 0.9) < 0.02 and shares[s].most_copies <= shares[s].max_repeats
    drawn = mix.drawn.collect()
    assert len({r.doc_id for r in drawn}) == len(drawn) and not {r.doc_id for r in drawn} & {None, *range(90001, 90005)}
    assert sum(r.tokens * r.copies for r in drawn) == sum(r.tokens for r in shares.values())
    again = Mixture(docs.repartition(7), targets).drawn.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_total_and_empty(spark):
    docs, targets = tables(spark, 900)
    small = Mixture(docs, targets, total_tokens=2000).shares().agg(F.sum("tokens")).first()[0]
    assert 1500 < small < 2500
    assert Mixture(docs.limit(0), targets).drawn.count() == 0 and Mixture(docs.limit(0), targets).shares().count() == 4
    assert Mixture(docs, targets.limit(0)).drawn.count() == 0


def test_shares_do_not_depend_on_the_number_of_shards(spark):
    docs, targets = tables(spark, 9000)
    for options in ({"shard_blocks": 8, "shard_documents": 1, "bucket_documents": 100}, {"shard_blocks": 50, "shard_documents": 1}, {"least_blocks": 300}):
        shares = {r.source: r for r in Mixture(docs, targets, **options).shares().collect()}
        assert all(abs(r.actual_share - r.scaled_share) < 0.015 and (r.most_copies or 0) <= r.max_repeats for r in shares.values())


def test_a_document_given_often_counts_once(spark):
    docs, targets = tables(spark, 300)
    twice = docs.unionByName(docs.where("doc_id < 3"))
    for _ in range(6):
        twice = twice.unionByName(twice.where("doc_id = 1"))
    same = lambda df: sorted(map(tuple, Mixture(df, targets).drawn.collect()))
    assert same(twice) == same(docs)


def test_every_share_is_reached_on_the_tables(spark):
    from vecmill.llm.queries import queries

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    got = queries()["p7_reached"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 9 and all(r.within for r in got)
