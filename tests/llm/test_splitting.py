from hypothesis import given, settings
from hypothesis import strategies as st

from vecmill.llm.splitting import split_oversized, split_text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n。", max_size=300), st.integers(1, 60), st.integers(-3, 70))
def test_pieces_fit_overlap_and_cover(text, most, overlap):
    pieces = split_text(text, most, overlap)
    shared = max(0, min(overlap, most - 1))
    assert all(b - a <= most for a, b in pieces)
    if len(text) <= most:
        assert pieces == [(0, len(text))]
    else:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (_, b), (c, d) in zip(pieces, pieces[1:], strict=False):
            assert b - c == shared and d > b


def test_natural_boundaries():
    text = "First part. Second one here.\n\nThird paragraph is here. It ends."
    ends = [text[:b] for _, b in split_text(text, 40, 0)]
    assert ends[0] == "First part. Second one here.\n\n"
    assert ["aaaa bbbb cccc"[a:b] for a, b in split_text("aaaa bbbb cccc", 5, 0)] == ["aaaa ", "bbbb ", "cccc"]
    assert split_text("", 5, 1) == [(0, 0)]


def test_frame(spark):
    rows = [(1, "word " * 400, "a"), (1, "word " * 400, "a"), (2, "short", "a"), (3, None, "a"), (4, "word " * 400, None), (5, "word " * 400, "no limit"), (6, "x" * 200_000, "b"), (7, "word " * 10, "c"), (8, "", "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "row_id long, content string, book_name string, piece int, `group` string")
    limits = spark.createDataFrame([("a", 100, 10), ("a", 500, 0), ("b", 1000, None), ("c", None, 5), (None, 5, 1), ("d", 0, 0)], "`group` string, max_chars int, overlap_chars int")
    for broadcast in (100, 0):
        got = split_oversized(df, limits, most_broadcast=broadcast).collect()
        assert {r.row_id for r in got} == {1, 6}
        ones = sorted((r for r in got if r.row_id == 6), key=lambda r: r.piece)
        assert len(ones) == 200 == ones[0].pieces and "".join(r.piece_text for r in ones) == "x" * 200_000
        assert sum(r.piece == 0 for r in got if r.row_id == 1) == 2 and all(len(r.piece_text) == r.end_char - r.start_char <= 100 for r in got if r.row_id == 1)
    assert split_oversized(df.limit(0), limits).count() == split_oversized(df, limits.limit(0)).count() == 0
