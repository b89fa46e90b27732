import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.llm.crf import BUCKETS, LANGUAGES, LEXICON, features, forward_backward
from vecmill.llm.languages import calibrate, document_languages, fit, language_passages, load_model, named_language, passages, save_model, unlabelled_languages

RNG = random.Random(1)
WORDS = {lang: [w for w in LEXICON[lang].split() if len(w) > 1] + [f"{stem}{end}" for stem in ("kor", "bal", "ven", "tis") for end in ends] for lang, ends in {"en": ("ing", "ness"), "de": ("ung", "keit"), "fr": ("eaux", "ement"), "es": ("ción", "ando"), "pt": ("ção", "mente"), "nl": ("ijk", "heid"), "ja": ("です", "ました")}.items()}


def text(lang, n=60):
    return ("" if lang == "ja" else " ").join(RNG.choice(WORDS[lang]) for _ in range(n)) + ". "


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(210):
        lang = LANGUAGES[i % 7]
        label = LANGUAGES[(i + 1) % 7] if i % 10 == 0 else lang
        rows.append((i, text(lang), label))
    mixed = [(1000 + i, text("en") + "HEADING 12\n" + text("de") + text("en"), "en-GB") for i in range(5)]
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, "123 456", "en"), (2003, text("fr", 3), None), (0, rows[0][1], rows[0][2])]
    return spark.createDataFrame([(*r, "x", 1) for r in rows + mixed + odd], "doc_id long, text string, lang string, confidence string, passage int")


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    e, trans, start = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    length = np.array([4, 2])
    post, moves, z = forward_backward(e, length, trans, start)
    expected = np.zeros((3, 3))
    for s, n in enumerate(length):
        paths = list(np.ndindex(*([3] * n)))
        score = np.array([start[p[0]] + sum(e[t, s, p[t]] for t in range(n)) + sum(trans[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        weight = np.exp(score - score.max())
        assert np.isclose(z[s], score.max() + np.log(weight.sum()))
        weight /= weight.sum()
        for t in range(n):
            assert np.allclose(post[t, s], [sum(w for w, p in zip(weight, paths, strict=True) if p[t] == c) for c in range(3)])
        for w, p in zip(weight, paths, strict=True):
            for t in range(n - 1):
                expected[p[t], p[t + 1]] += w
    assert np.allclose(moves, expected)


def test_features_of_a_long_word_are_of_all_of_it():
    import xxhash

    bucket = lambda name: xxhash.xxh3_64_intdigest(name) % BUCKETS
    long = set(features("x" * 60 + "keitq"))
    assert {bucket(n) for n in ("p<x", "sq>", "stq>", "sitq>", "seitq>", "gkei", "gtq>")} <= long and bucket("sxx>") not in long
    assert len(features("ab" * 500_000)) < 30


def test_labels(spark):
    labels = ["EN", "en-GB", "en_US", "deu", "ger", "pt-BR", "n/a", "", None, "xx", "english", "en GB", " fr "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string").select("i", named_language(F.col("l")).alias("n")).orderBy("i")
    assert [r.n for r in df.collect()] == ["en", "en", "en", "de", "de", "pt", None, None, None, None, None, None, "fr"]


def test_stray_words_do_not_interrupt():
    label = np.array([0] * 10 + [1] * 2 + [0] * 10 + [2] * 20)
    post = np.eye(3)[label] * 0.9 + 0.1 / 3
    start = np.arange(len(label)) * 6
    runs = lambda **x: [(lang, a, b) for lang, a, b, _ in passages(post, start, start + 5, **x)]
    assert runs() == runs(least_chars=60, least_mass=0) == [(0, 0, 131), (2, 132, 251)]
    assert len(runs(least_mass=1.8)) == 4 and len(runs(least_mass=0)) == 4
    assert np.isclose(passages(post, start, start + 5)[0][3], 0.9 + 0.1 / 3)  # stray words don't count
    assert passages(post[:1], start[:1], start[:1] + 5, 60)[0][:3] == (0, 0, 5)


def test_a_short_sentence_in_another_language_is_a_passage(spark, labelled):
    model = fit(labelled)
    english = "the of and to in is that for it as was with be by on not he are this or an which from at. "
    german = "das mit sich auf die. "
    df = spark.createDataFrame([(1, english + german + english)], "doc_id long, text string")
    got = language_passages(df, model).orderBy("passage").collect()
    assert [r.lang for r in got] == ["en", "de", "en"] and got[1].end_char - got[1].start_char < 30
    assert unlabelled_languages(df.withColumn("lang", F.lit("en")), model).count() == 0


def test_a_saved_model_is_the_same(spark, labelled, tmp_path):
    model = fit(labelled)
    save_model(spark, model, f"{tmp_path}/model")
    same = load_model(spark, f"{tmp_path}/model")
    of = lambda m: sorted(map(tuple, language_passages(labelled.select("doc_id", "text"), m).collect()))
    assert of(same) == of(model)


def test_calibration():
    from vecmill.llm.crf import train

    rng = np.random.default_rng(3)
    pieces = [(text(lang, 20).replace(".", "").lower().split(), LANGUAGES.index(lang)) for lang in ("en", "de", "fr") for _ in range(60)]
    model = train([[p] for p in pieces], rounds=10)
    wrong = [[(tokens, int(rng.integers(0, 3)))] for tokens, _ in pieces]  # a third are right: confidences of nearly 1 are far too high
    calibrate(model, wrong)
    assert model.slope * 4 + model.shift < 1
    calibrate(model, [])
    assert (model.slope, model.shift) == (1, 0)


def test_held_out_accuracy_and_found(spark, labelled):
    model = fit(labelled)
    fresh = spark.createDataFrame([(i, text(LANGUAGES[i % 7])) for i in range(140)], "doc_id long, text string")
    got = document_languages(language_passages(fresh, model)).collect()
    assert np.mean([r.lang == LANGUAGES[r.doc_id % 7] for r in got]) > 0.97 and all(0 < r.confidence <= 1 for r in got)
    rows = {tuple(r) for r in unlabelled_languages(labelled, model).collect()}
    assert {(1000 + i, "de") for i in range(5)} <= rows and not any(d >= 1000 and lang == "en" for d, lang in rows)
    wrong = {(i, LANGUAGES[i % 7]) for i in range(0, 210, 10) if i % 7 != 6}
    assert len(wrong & rows) > 0.9 * len(wrong) and not any(d in (2000, 2001, 2002) for d, _ in rows)


def test_without_labels_or_rows(spark, labelled):
    model = fit(labelled.limit(0))
    assert language_passages(labelled.limit(0), model).count() == 0
    got = document_languages(language_passages(spark.createDataFrame([(1, "the and of to in is that for it as was with"), (2, "der die und das mit sich auf nicht ein eine werden")], "doc_id long, text string"), model)).collect()
    assert {r.doc_id: r.lang for r in got} == {1: "en", 2: "de"}


def test_every_document_comes_out(spark):
    rows = [(1, "the and of to in is that for it as was with"), (2, None), (3, ""), (4, "123 456"), (4, "123 456"), (None, "the and of")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = document_languages(language_passages(df, fit(df.limit(0).withColumn("lang", F.lit("en")))), df).collect()
    assert {r.doc_id: (r.lang, r.languages) for r in got} == {1: ("en", 1), 2: (None, 0), 3: (None, 0), 4: (None, 0)} and len(got) == 4
    assert all(0 < r.confidence <= 1 if r.lang else r.confidence == 0 for r in got)


def test_every_document_of_the_query_comes_out(spark):
    import os

    from vecmill.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    ids = [r.doc_id for r in queries()["p8_documents"](spark, sf).collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
