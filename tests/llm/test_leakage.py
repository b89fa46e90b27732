import random

from vecmill.llm.common import words
from vecmill.llm.leakage import build, find, gram_blocks, leaked_pairs, leaked_spans, without_leaks


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        for i, x in items:
            a, b = words(t or ""), words(x or "")
            m = min(n, len(b))
            if m and d is not None and i is not None and {tuple(a[j : j + m]) for j in range(len(a) - m + 1)} & {tuple(b[j : j + m]) for j in range(len(b) - m + 1)}:
                out.add((d, i))
    return out


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, t string, item_id int"), spark.createDataFrame(items, "item_id long, text string")


def test_found_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(40)] + [(90, None), (91, ""), (92, "!?"), (None, "a b")]
    docs = [(i, ", ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(90, None), (91, ""), (1, "A.B-c d e f"), (None, "a b c"), (93, "É " + "x " * 50_000 + "a b c d e f g")]
    d, i = tables(spark, docs, items)
    for block in (500_000, 20, 3):  # the last one splits items over blocks
        got = [tuple(r) for r in leaked_pairs(leaked_spans(d, i, 4, block_grams=block)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, 4)
    assert leaked_spans(d.limit(0), i, 4).count() == leaked_spans(d, i.limit(0), 4).count() == 0


def test_spans_are_cut_out(spark):
    docs = [(1, "Keep this. One, two THREE four five! And this."), (2, "Nothing here"), (3, None), (1, "again one two three four")]
    d, i = tables(spark, docs, [(7, "one two three four five"), (8, "zero")])
    for block in (500_000, 1):
        got = sorted(((r.doc_id, r.clean_text, r.removed_words) for r in without_leaks(d, i, 4, block_grams=block).collect()), key=str)
        assert (1, "Keep this.  ! And this.", 5) in got and (2, "Nothing here", 0) in got and (3, None, 0) in got and len(got) == 4


def test_texts_are_kept_apart():
    g = build([(1, ["a", "b", "c"])], 3)
    assert find(g, [["a", "b"], ["c"], [], ["x", "a", "b", "c"]]) == [(3, 1, 1, 3)]
    assert find(build([], 3), [["a"]]) == []


def test_blocks_hold_no_more_than_they_may(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50))), (2, "a b c"), (3, None), (4, "")], "item_id long, text string")
    blocks = list(gram_blocks(items, 4, "item_id", "text", 10))
    assert [sum(len(h) for h, _, _ in b.by_length.values()) for b in blocks] == [10, 10, 10, 10, 8]
    assert len(list(gram_blocks(items.limit(0), 4, "item_id", "text", 10))) == 1
