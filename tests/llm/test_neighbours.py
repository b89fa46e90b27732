import numpy as np

from vecmill.llm.neighbours import Cells, Codebooks, Lists, all_neighbours, directions, kmeans, neighbour_pairs, unit


def exact(ids, v, k):
    """{id: [(neighbour, similarity)]} by comparing all with all."""
    order = np.argsort(ids)
    ids, v = np.array(ids)[order], unit(np.array(v, np.float32)[order])
    out = {}
    for i in range(len(ids)):
        s = np.round(v @ v[i], 9)
        s[i] = -9
        top = np.argsort(-s, kind="stable")[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in top]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], "row_id long, multi_embeddings array<float>, vec string, cell int")


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.row_id, []).append((r.neighbour_id, round(r.similarity, 9)))
    return {i: sorted(x, key=lambda p: (-p[1], p[0])) for i, x in out.items()}


def test_dirty_rows_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(20, 8)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(100 + i, good[0]) for i in range(9)]  # more copies than neighbours asked for
    rows += [(200, good[0] * 2), (201, -good[1])]
    bad = [(300, None), (301, []), (302, [1.0] * 7), (303, [0.0] * 8), (304, [float("nan")] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7), (306, [None] + [1.0] * 7), (None, good[2])]
    got = collected(all_neighbours(frame(spark, rows + bad), dim=8, k=5, parts=8))
    assert got == exact([i for i, _ in rows], [v for _, v in rows], 5)


def test_few_rows_and_none(spark):
    assert all_neighbours(frame(spark, [(1, None)]), dim=8).count() == 0
    assert all_neighbours(frame(spark, [(1, [1.0] * 8)]).limit(0), dim=8).count() == 0
    assert all_neighbours(frame(spark, [(1, [1.0] * 8)]), dim=8).count() == 0
    same = all_neighbours(frame(spark, [(i, [1.0] * 8) for i in range(8)]), dim=8, k=5)
    assert collected(same) == exact(range(8), [[1.0] * 8] * 8, 5)
    pairs = {tuple(r) for r in neighbour_pairs(same).collect()}
    assert len(pairs) == len({p for i, x in collected(same).items() for j, _ in x for p in [(min(i, j), max(i, j))]}) and all(a < b for a, b in pairs)


def test_hot_copies_and_overfull_cells(spark):
    """A third of the rows are copies, a third lie close together: more than a cell's rows by far."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    closer = centre + 0.01 * rng.normal(size=(90, 8))
    rows = [(i, centre) for i in range(700)] + [(1000 + i, closer[i % 90] + 0.003 * rng.normal(size=8)) for i in range(700)] + [(3000 + i, rng.normal(size=8)) for i in range(700)]
    want = exact([i for i, _ in rows], [v for _, v in rows], 5)
    for options in ({}, {"sample_rows": 150}):  # with few sampled rows cells can't be cut finely: their slices and portions are asked
        got = collected(all_neighbours(frame(spark, rows), dim=8, k=5, cell_rows=150, list_rows=40, probe_cells=5, far_lists=6, far_rerank=60, parts=8, **options))
        assert all(got[i] == want[i] for i in range(700))
        hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 5 for i in want]
        assert got.keys() == want.keys() and np.mean(hits) >= 0.9


def test_dense_vectors_are_cut_into_cells():
    rng = np.random.default_rng(8)
    dense = rng.normal(size=16) + 0.01 * rng.normal(size=(6000, 16))
    x = unit(np.concatenate([dense, rng.normal(size=(12_000, 16))])).astype(np.float32)
    for flat in (256, 8):
        cells = Cells(x, 60, rng, flat=flat)
        names = cells.nearest(x, 3)
        assert np.bincount(names[:, 0]).max() < 4 * len(x) / 60 and (names[:, 0] >= 0).all()
        brute = np.argmax(x @ cells.centroids.T, axis=1)
        assert (brute == names[:, 0]).mean() > (0.99 if flat == 256 else 0.9)


def test_codes_carry_the_search():
    """Few of the vectors that are scored by their codes are compared exactly, and the answers are right."""
    rng = np.random.default_rng(9)
    centres, scale = rng.normal(size=(60, 64)), rng.choice([0.03, 0.1, 0.3], 60)
    inner = np.repeat(np.arange(60), 20)
    closer = centres[inner] + scale[inner, None] * rng.normal(size=(1200, 64))
    which = rng.integers(0, 1200, 8000)
    v = unit((closer[which] + 0.5 * scale[inner[which], None] * rng.normal(size=(8000, 64))).astype(np.float32))
    x, ids, seen = v.astype(np.float32), np.arange(8000), {}
    fine = Cells(x, 200, rng)
    books = Codebooks(directions(x - fine.centroids[fine.nearest(x, 1)[:, 0]])[0], 32, 128, rng)
    found, _ = Lists(v, ids, 80, books, 1).search(v[:1000], ids[:1000], 5, 7, 48, seen)
    want = exact(range(8000), v, 5)
    assert seen["compared"] < 0.1 * seen["scored"]
    assert np.mean([len({j for j, _ in want[i]} & set(found[i].tolist())) / 5 for i in range(1000)]) >= 0.9


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    v = (centres[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 64))).astype(np.float32)
    got = collected(all_neighbours(frame(spark, list(enumerate(v))), cell_rows=1000))
    want = exact(range(4000), v, 5)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 5 for i in want]) >= 0.9


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, list(enumerate(rng.normal(size=(300, 8)))))
    assert collected(all_neighbours(df.repartition(7), dim=8, parts=8)) == collected(all_neighbours(df.coalesce(1), dim=8, parts=8))


def test_tables_estimate_inner_products():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    book = Codebooks(x, 4, 32, rng)
    codes = book.encode(x)
    decoded = np.concatenate([b[codes[m]] for m, b in enumerate(book.books)], axis=1)
    assert np.allclose(book.scores(x[:20] @ book.turn, codes), decoded @ (x[:20] @ book.turn).T, atol=1e-4)
    assert len(kmeans(x[:3], 10, 2, rng, False)) == 3


def test_samples_are_parameters(spark, monkeypatch):
    from vecmill.llm import neighbours

    rng = np.random.default_rng(6)
    v, ids = unit(rng.normal(size=(900, 8)).astype(np.float32)), np.arange(900)
    fitted = []
    monkeypatch.setattr(neighbours, "kmeans", lambda x, *rest: fitted.append(len(x)) or kmeans(x, *rest))
    for word_rows, centre_rows, sizes in ((64, 40, [256, 256, 400]), (10, 20, [40, 40, 200]), (10**3, 10**6, [2900, 2900, 900])):
        fitted.clear()
        books = Codebooks(v.astype(np.float32), 2, 4, rng, word_rows)
        found, _ = Lists(v, ids, 90, books, 1, centre_rows).search(v, ids, 5, 3, 20)
        assert fitted == sizes and found.shape == (900, 5) and (found >= 0).all()
    df = frame(spark, list(enumerate(v[:40])))
    assert collected(all_neighbours(df, dim=8, parts=2, word_rows=10**3, centre_rows=10**6)) == exact(range(40), v[:40], 5)


def test_ties_at_the_edge_go_to_the_smaller_identifier():
    v = unit(np.array([[1, 0], [0, 1], [0, -1], [1, 1], [1, -1]], np.float32))
    ids = np.array([10, 4, 3, 2, 1])
    books = Codebooks(v.astype(np.float32), 2, 4, np.random.default_rng(1))
    found, similarity = Lists(v, ids, 80, books, 1).search(v[:1], ids[:1], 3, 1, 5)
    assert sorted(ids[found[0]].tolist()) == [1, 2, 3] and np.isclose(sorted(similarity[0])[0], 0)
