"""A linear-chain conditional random field that labels words with languages; numpy only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import xxhash

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ja")

# Frequent function words of each language.
LEXICON = {
    "en": "the of and to in is that for it as was with be by on not he are this or an which from at but have they you each when between without because may as first then made",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über zwischen wenn ohne dadurch",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son elle comme mais on lorsque sans entre selon ainsi car aux vu depuis",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este entre cuando cada porque desde hasta según también",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando entre sem cada porque até numa pelo pela são está deste também então",
    "nl": "de en van het een in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft hebben door over wordt tussen wanneer zonder deze daarna omdat waarin elke goed",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ",
}

_CJK = "々぀-ヿ㐀-鿿ｦ-ﾟ"
#: Words: runs of letters; in scripts without blanks, stretches of up to four characters.
TOKEN = re.compile(f"[{_CJK}]{{1,4}}|[^\\W\\d_{_CJK}]+")
BUCKETS = 1 << 16
_KANA, _HAN = re.compile("[぀-ヿｦ-ﾟ]"), re.compile("[㐀-鿿]")


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word's affixes, n-grams, script and the word itself, and of the lexicons that hold it; of whatever length."""
    w = f"<{word}>"
    names = ["w" + word]
    if _KANA.search(word):
        names.append("kana")
    if _HAN.search(word):
        names.append("han")
    names += ["p" + w[:n] for n in (2, 3, 4) if len(w) > n]
    names += ["s" + w[-n:] for n in (2, 3, 4, 5) if len(w) > n]
    names += {"g" + w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)}
    names += ["x" + lang for lang, known in _KNOWN.items() if word in known]
    return sorted({xxhash.xxh3_64_intdigest(n) % BUCKETS for n in names})


_KNOWN = {lang: frozenset(text.split()) for lang, text in LEXICON.items()}


def featurize(types: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids end to end, where each type starts, weight of a feature): weights make long words count no more than short."""
    lists = [features(t) for t in types]
    size = np.array([len(x) for x in lists], np.int64)
    ids = np.fromiter((i for x in lists for i in x), np.int64, int(size.sum()))
    return ids, np.concatenate([[0], np.cumsum(size)])[:-1], np.repeat(1 / np.sqrt(size), size)


def emissions(weights: np.ndarray, ids: np.ndarray, starts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Score of each type under each label."""
    if not len(starts):
        return np.empty((0, weights.shape[1]))
    return np.add.reduceat(weights[ids] * scale[:, None], starts, axis=0)


def forward_backward(e: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (steps x sequences x labels), the sum of expected transitions, and log Z of each sequence.

    e: scores (steps x sequences x labels), padded; length: steps of each sequence, all at least 1.
    """
    steps, n, labels = e.shape
    top = e.max(axis=2, keepdims=True)
    x = np.exp(e - top)
    move, first = np.exp(trans), np.exp(start)
    alpha, norm = np.empty_like(x), np.ones((steps, n))
    a = first * x[0]
    for t in range(steps):
        if t:
            a = (alpha[t - 1] @ move) * x[t]
        norm[t] = a.sum(axis=1)
        alpha[t] = a / norm[t][:, None]
    beta = np.ones((n, labels), e.dtype)
    post, moves = np.empty_like(x), np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            inner = (t + 1 < length)[:, None]
            ahead = x[t + 1] * beta / norm[t + 1][:, None]
            moves += (alpha[t] * inner).T @ (ahead * inner)
            beta = np.where(inner, ahead @ move.T, 1)
        p = alpha[t] * beta
        post[t] = p / p.sum(axis=1, keepdims=True)
    live = np.arange(steps)[:, None] < length[None]
    return post, moves * move, ((np.log(norm) + top[:, :, 0]) * live).sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    slope: float = 1.0  # of the confidences' log odds, see calibrate()
    shift: float = 0.0
    cache: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights.astype(np.float16), "trans": self.trans, "start": self.start, "slope": self.slope, "shift": self.shift}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["weights"].astype(np.float32), state["trans"], state["start"], state["slope"], state["shift"])

    def scores(self, tokens: list[str], most: int = 400_000) -> np.ndarray:
        """Scores of lower-cased words under each label; what was computed is kept up to a bound."""
        if len(self.cache) > most:
            self.cache, self.table = {}, None
        new = list(set(tokens).difference(self.cache))
        if new:
            rows = emissions(self.weights, *featurize(new)).astype(np.float32)
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new)), strict=True))
            self.table = rows if self.table is None else np.concatenate([self.table, rows])
        at = np.fromiter(map(self.cache.__getitem__, tokens), np.int64, len(tokens))
        return self.table[at] if len(at) else np.empty((0, len(self.start)), np.float32)


def train(sequences: list[list[tuple[list[str], int]]], rounds: int = 25, rate: float = 0.5, decay: float = 1e-4, labels: int = len(LANGUAGES)) -> Model:
    """Fit weights and transitions by AdaGrad on the conditional log-likelihood. A sequence is runs of lower-cased words, each run
    with one label."""
    sequences = sorted((s for s in sequences if any(w for w, _ in s)), key=lambda s: sum(len(w) for w, _ in s))
    types: dict[str, int] = {}
    words = [np.array([types.setdefault(w, len(types)) for run, _ in s for w in run]) for s in sequences]
    gold = [np.repeat([y for _, y in s], [len(w) for w, _ in s]) for s in sequences]
    ids, starts, scale = featurize(list(types))
    owner = np.repeat(np.arange(len(types)), np.diff(np.append(starts, len(ids))))
    model = Model(np.zeros((BUCKETS, labels)), np.zeros((labels, labels)), np.zeros(labels))
    square = [np.full_like(x, 1e-8) for x in (model.weights, model.trans, model.start)]
    total = sum(map(len, words))
    observed_moves = np.zeros((labels, labels))
    for y in gold:
        np.add.at(observed_moves, (y[:-1], y[1:]), 1)
    observed_start = np.bincount([y[0] for y in gold], minlength=labels).astype(float)
    for _ in range(rounds):
        e = emissions(model.weights, ids, starts, scale)
        push = np.zeros((len(types), labels))
        moves, begin = np.zeros((labels, labels)), np.zeros(labels)
        at = 0
        while at < len(words):
            some = slice(at, at + 512)
            length = np.array([len(w) for w in words[some]])
            which = np.zeros((length.max(), len(length)), np.int64)
            for i, w in enumerate(words[some]):
                which[: len(w), i] = w
            post, m, _z = forward_backward(e[which], length, model.trans, model.start)
            live = np.arange(length.max())[:, None] < length[None]
            flat, p = which[live], post[live]
            y = np.zeros_like(which)
            for i, g in enumerate(gold[some]):
                y[: len(g), i] = g
            p[np.arange(len(p)), y[live]] -= 1
            for c in range(labels):
                push[:, c] -= np.bincount(flat, p[:, c], minlength=len(types))
            moves += m
            begin += post[0].sum(axis=0)
            at += 512
        grad = np.stack([np.bincount(ids, scale * push[owner, c], minlength=BUCKETS) for c in range(labels)], axis=1) / total
        grads = (grad - decay * model.weights / len(types) ** 0.5, (observed_moves - moves) / total, (observed_start - begin) / max(1, len(words)))
        for x, g, s in zip((model.weights, model.trans, model.start), grads, square, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return model
