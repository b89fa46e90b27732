import json
from itertools import combinations

from hypothesis import given
from hypothesis import strategies as st

from vecmill.llm.copies import Copies, canonical, fields

PAIRS = [("Title", "A pin (2)"), ("page", "7"), ("author note", "x: y, z")]


def test_notations_agree():
    forms = ["\n".join(f"{k}: {v}" for k, v in PAIRS), "; ".join(f"{k.upper()} : {v}" for k, v in PAIRS[::-1]), " | ".join(f"{k}:{v}" for k, v in PAIRS), json.dumps(dict(PAIRS)), json.dumps(dict(PAIRS[::-1]), indent=2).replace("7", "7")]
    assert len({canonical(f) for f in forms}) == 1
    assert canonical("title: a; page: 7") != canonical("page: 7; title: a")  # two fields are running text
    assert canonical("Title A pin 2 page 7 author note x y z") != canonical(forms[0])
    assert fields('{"a": {"b": 1}, "c": 2, "d": 3}') == fields("{broken: a; b: c; d: e") == fields("") == None  # noqa: E711
    assert canonical('{"a": 1, "b": true, "c": null}') == canonical("c: null\nb: TRUE\na: 1")
    assert canonical("a: 1; b: 2; c: 3; a: 1") == canonical("a: 1; b: 2; c: 3")


@given(st.text(alphabet="aB1 .,\nß", max_size=30))
def test_plain_text_ignores_all_but_letters_and_digits(t):
    assert canonical(t) == canonical(" " + t.upper().replace("SS", "ß").lower() + " !?")


def frame(spark, rows):
    return spark.createDataFrame([(r, i, c, "x", 0) for r, i, c in rows], "row_id long, chunk_id string, content string, key string, copies int")


def test_groups_equal_brute_force_hot_or_not(spark):
    contents = ["One two", "one  TWO!", "a: 1; b: 2; c: 3", "c: 3 | b: 2 | a: 1", None, "", " ", "x" * 100_000]
    rows = [(i, [f"ID-{i % 3}", "{id%d}" % (i % 3), None][i % 5 % 3], contents[i % len(contents)]) for i in range(240)] + [(None, "id1", "One two"), (5, "ID-2", " ")]
    groups = {}
    for r, i, c in rows:
        if None not in (r, i, c):
            groups.setdefault(("".join(x for x in i.lower() if x.isalnum()), canonical(c)), []).append(r)
    want = {(a, b) for g in groups.values() for a, b in combinations(sorted(set(g)), 2)}
    for hot, broadcast in ((10_000, 10), (5, 10), (5, 0)):
        c = Copies(frame(spark, rows), hot=hot, salts=3, most_broadcast=broadcast)
        got = [tuple(r) for r in c.pairs().collect()]
        assert set(got) == want and len(got) == len(want)
        assert sorted(tuple(r) for r in c.collapsed().collect()) == sorted((min(g), len(g)) for g in groups.values())
        assert sorted(tuple(r) for r in c.members().collect()) == sorted((r, min(g)) for g in groups.values() for r in g)


def test_empty(spark):
    c = Copies(frame(spark, [(1, "a", "b")]).limit(0))
    assert c.pairs().count() == c.collapsed().count() == c.members().count() == 0
