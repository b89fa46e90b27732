"""Problem 8: the languages of documents and of their passages, by a conditional random field over words."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .crf import LANGUAGES, LEXICON, TOKEN, Model, forward_backward, train

# Two- and three-letter codes.
CODES = {
    "en": "en", "eng": "en", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr", "es": "es", "spa": "es",
    "pt": "pt", "por": "pt", "nl": "nl", "nld": "nl", "dut": "nl", "ja": "ja", "jpn": "ja",
}


def named_language(label: Column) -> Column:
    """The language a label names by its code, in any case, with or without a region; else null."""
    code = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})([-_][a-z0-9]+)*$", 1)
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return table[F.when(code.isin(list(CODES)), code)]


def lowered(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-cased tokens of a text, where they start and where they end."""
    found = list(TOKEN.finditer(text))
    if not found:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    spans = np.array([m.span() for m in found])
    tokens = "\n".join([m[0] for m in found]).lower().split("\n")
    return tokens, spans[:, 0], spans[:, 1]


Piece = tuple[list[str], int]


def cut(documents: list[tuple[str, str]], rng: np.random.Generator) -> list[Piece]:
    """Pieces of 15 to 69 words of labelled texts, and their label. Labels may be wrong and texts mixed: a piece in which another
    language's function words are more frequent is left out."""
    pieces = []
    for text, lang in documents:
        tokens = lowered(text)[0]
        at = 0
        while at < len(tokens):
            n = int(rng.integers(15, 70))
            if plausible(tokens[at : at + n], lang):
                pieces.append((tokens[at : at + n], LANGUAGES.index(lang)))
            at += n
    return pieces


def teaching(pieces: list[Piece], rng: np.random.Generator) -> list[list[Piece]]:
    """Code-switched sequences of one to three pieces, and each language's lexicon."""
    out, order, at = [], rng.permutation(len(pieces)), 0
    while at < len(order):
        n = int(rng.integers(1, 4))
        out.append([pieces[i] for i in order[at : at + n]])
        at += n
    for lang, text in LEXICON.items():
        out += [[(text.split(), LANGUAGES.index(lang))]] * 2
    return out


def plausible(tokens: list[str], lang: str) -> bool:
    """Whether no language has more function words among the tokens than the given one. Kana stand for Japanese."""
    counts = dict.fromkeys(LANGUAGES, 0)
    for w in tokens:
        for known in _LANGUAGES_OF.get(w, ()):
            counts[known] += 1
    counts["ja"] = sum("\u3040" <= c <= "\u30ff" for w in tokens for c in w)
    return counts[lang] == max(counts.values()) > 0


_LANGUAGES_OF: dict[str, list[str]] = {}
for _lang, _text in LEXICON.items():
    for _word in _text.split():
        _LANGUAGES_OF.setdefault(_word, []).append(_lang)


def fit(df: DataFrame, text_column: str = "text", label_column: str = "lang", per_language: int = 120, most_chars: int = 50_000, seed: int = 1) -> Model:
    """A model fitted on a bounded sample: at most `per_language` of the rows whose label names each language, drawn by hash among those
    of 40 to `most_chars` characters.

    Labels may be wrong: pieces of texts in which another language's function words are more frequent are dropped, then those of
    which a first model takes a fifth of the words or more for another language; the rest are used for the second model. Without
    labelled rows only the fixed lexicons teach. A fifth of the kept pieces is held out: passages found in them tell how often a
    confidence is right, and the model's confidences are set accordingly.
    """
    hashed = df.select(F.col(text_column).cast("string").alias("t"), named_language(F.col(label_column).cast("string")).alias("l")).where(f"l is not null and length(t) between 40 and {most_chars}")
    entry = F.struct(F.xxhash64("t", F.lit(seed)).alias("h"), F.col("t"))
    # For each language the least hashes: each task keeps no more than it may send.
    nth = F.row_number().over(Window.partitionBy("l").orderBy("s.h", "s.t"))
    rows = hashed.select("l", entry.alias("s")).withColumn("nth", nth).where(F.col("nth") <= per_language).select("l", "s.t").orderBy("l", "t").collect()
    rng = np.random.default_rng(seed)
    pieces = cut([(r.t, r.l) for r in rows], rng)
    first = train(teaching(pieces, rng), rounds=20)
    post = posteriors(first, [tokens for tokens, _ in pieces])
    kept = [p for p, x in zip(pieces, post, strict=True) if (x.argmax(axis=1) == p[1]).mean() > 0.8]
    kept = [kept[i] for i in rng.permutation(len(kept))]
    held = len(kept) // 5
    model = train(teaching(kept[held:], rng), rounds=40)
    calibrate(model, teaching(kept[:held], rng))
    return model


def calibrate(model: Model, sequences: list[list[Piece]], weight: float = 4.0) -> None:
    """Fit slope and shift of the confidences' log odds to whether passages of labelled sequences have the right language, by Newton steps.

    weight: of the prior that they are right as they are. Few sequences change little. Confidences are lowered where they were too high, never
    sharpened: the labelled sequences have only languages the model knows."""
    words = [[w for tokens, _ in s for w in tokens] for s in sequences]
    x, y = [], []
    for s, post in zip(sequences, posteriors(model, words), strict=True):
        gold = np.repeat([lang for _, lang in s], [len(tokens) for tokens, _ in s])
        place = np.arange(len(gold))
        for lang, a, z, sure in passages(post, place, place + 1):
            x.append(log_odds(sure))
            y.append((gold[a:z] == lang).mean())
    x, y = np.array(x), np.array(y)
    at = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1) if len(x) else np.empty((0, 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ at))
        slope = design.T @ (y - p) - weight * (at - [1.0, 0.0])
        at = at + np.clip(np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + weight * np.eye(2), slope), -0.3, 0.3)  # short steps can't leap over the best
    model.slope, model.shift = (max(0.1, float(at[0])), float(at[1])) if at[0] <= 1 else (1.0, min(0.0, float(at[1])))


def log_odds(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write a fitted model; an older one at this path is replaced."""
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """A model that save_model wrote. Load only models of your own: unpickling runs what a file says."""
    return pickle.loads(bytes(spark.read.schema("model binary").parquet(path).first().model))


def posteriors(model: Model, texts: list[list[str]], cells: int = 400_000) -> list[np.ndarray]:
    """For each text its words' probabilities of each language."""
    out: list[np.ndarray] = [np.empty((0, len(LANGUAGES)), np.float32)] * len(texts)
    order = [i for i in sorted(range(len(texts)), key=lambda i: len(texts[i])) if texts[i]]
    trans, start = model.trans.astype(np.float32), model.start.astype(np.float32)
    at = 0
    while at < len(order):
        n = max(1, min(2048, cells // len(texts[order[min(len(order) - 1, at + 2047)]])))
        some = order[at : at + n]
        length = np.array([len(texts[i]) for i in some])
        e = np.zeros((length.max(), len(some), len(LANGUAGES)), np.float32)
        flat = model.scores([w for i in some for w in texts[i]])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        e[step, np.repeat(np.arange(len(some)), length)] = flat
        post = forward_backward(e, length, trans, start)[0]
        for j, i in enumerate(some):
            out[i] = post[: length[j], j]
        at += n
    return out


def passages(post: np.ndarray, start: np.ndarray, end: np.ndarray, least_chars: int = 0, least_mass: float = 3.0) -> list[tuple[int, int, int, float]]:
    """(language, start, end, confidence): runs of words of one language.

    Runs with less than `least_mass` are stray words: a run's mass is the sum of its words' probabilities of its language, so three
    words that are certain are none, nor are more that are less certain. They go to the neighbour of more mass, the earlier one if these are
    equal. With least_chars runs with fewer characters go too, by characters. Confidence: the mean probability of the run's language
    over the words that were not put to it as stray.
    """
    first = post.argmax(axis=1)
    label, own = first.copy(), post.max(axis=1)
    for weight, least in ((lambda begin, stop: np.add.reduceat(np.where(label == first, own, 0.0), begin), least_mass), (lambda begin, stop: end[stop - 1] - start[begin], least_chars)):
        while True:
            edge = np.flatnonzero(np.diff(label)) + 1
            begin, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(label)]])
            size = weight(begin, stop)
            if len(begin) == 1 or size.min() >= least:
                break
            # the smallest around go first, so that large ones absorb small ones; no two neighbours go in one round
            before, after = np.concatenate([[-1], size[:-1]]), np.concatenate([size[1:], [-1]])
            go = (size < least) & ((before < 0) | (size < before)) & ((after < 0) | (size <= after))
            for i in np.flatnonzero(go):
                near = i - 1 if before[i] >= after[i] else i + 1
                label[begin[i] : stop[i]] = label[begin[near]]
    out = []
    for b, s in zip(begin, stop, strict=True):
        mine = own[b:s][first[b:s] == label[b]]
        out.append((int(label[b]), int(start[b]), int(end[s - 1]), float(mine.mean()) if len(mine) else 0.0))
    return out


def read_texts(own: Model, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place in the batch, word probabilities, word starts, word ends) of the texts in the second column that have words."""
    for at in range(0, batch.num_rows, 2048):
        read = [lowered(t) for t in batch.column(1).slice(at, 2048).to_pylist()]
        for i, ((tokens, start, end), post) in enumerate(zip(read, posteriors(own, [r[0] for r in read]), strict=True)):
            if tokens:
                yield at + i, post, start, end


def language_passages(df: DataFrame, model: Model, doc_column: str = "doc_id", text_column: str = "text", least_mass: float = 3.0) -> DataFrame:
    """(doc_id, passage, start_char, end_char, lang, confidence): every document cut into passages of one language, however short, but for stray
    words (see passages()). Confidence: how likely the language is right, as calibrated.

    Documents with null id, null text or a text without letters have no passage: no language can be told. Texts are used whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for at, post, start, end in read_texts(own, batch):
                for i, (lang, a, z, sure) in enumerate(passages(post, start, end, 0, least_mass)):
                    for column, value in zip(out, (at, i, a, z, LANGUAGES[lang], sure), strict=True):
                        column.append(value)
            odds = own.slope * np.array([log_odds(x) for x in out[5]]) + own.shift
            yield pa.record_batch([batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, t) for x, t in zip(out[1:5], (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)), pa.array(1 / (1 + np.exp(-odds)), pa.float64())], names=["doc_id", "passage", "start_char", "end_char", "lang", "confidence"])

    picked = df.select(F.col(doc_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t")).dropna()
    return picked.mapInArrow(run, "doc_id long, passage int, start_char int, end_char int, lang string, confidence double")


def document_languages(found: DataFrame, df: DataFrame | None = None, doc_column: str = "doc_id") -> DataFrame:
    """(doc_id, lang, confidence, languages): the language with most characters, its confidence, and how many languages there are.

    df: the documents, of which those without a passage come out too, with null language, confidence 0 and 0 languages; without df
    they don't. Documents with null id don't come out."""
    chars = F.col("end_char") - F.col("start_char")
    each = found.groupBy("doc_id", "lang").agg(F.sum(chars).alias("chars"), (F.sum(F.col("confidence") * chars) / F.greatest(F.sum(chars), F.lit(1))).alias("confidence"))
    most = F.max_by(F.struct("lang", "confidence"), F.struct("chars", "lang"))
    told = each.groupBy("doc_id").agg(most.alias("m"), F.count("*").alias("languages")).select("doc_id", "m.lang", "m.confidence", "languages")
    if df is None:
        return told
    ids = df.select(F.col(doc_column).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(told, "doc_id", "left").select("doc_id", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.lit(0)).alias("languages"))


def unlabelled_languages(df: DataFrame, model: Model, doc_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", least_chars: int = 150, stray_chars: int = 60) -> DataFrame:
    """(doc_id, lang): languages of which a document has at least least_chars characters on end and that its label doesn't name.

    What has fewer than stray_chars characters doesn't interrupt, so it is put to its neighbours here, before characters are counted.
    A document given twice under one id is judged by each row's own label. Null ids and texts without letters have no rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            named = batch.column(2).to_pylist()
            out = [(at, LANGUAGES[lang]) for at, post, start, end in read_texts(own, batch) for lang in {g for g, a, z, _ in passages(post, start, end, stray_chars, 0) if z - a >= least_chars} if LANGUAGES[lang] != named[at]]
            yield pa.record_batch([batch.column(0).take(pa.array([x for x, _ in out], pa.int64())), pa.array([x for _, x in out], pa.string())], names=["doc_id", "lang"])

    picked = df.select(F.col(doc_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t"), named_language(F.col(label_column).cast("string")).alias("named"))
    return picked.where("doc_id is not null and t is not null").mapInArrow(run, "doc_id long, lang string").distinct()
