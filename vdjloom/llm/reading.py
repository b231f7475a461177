"""Problem 9: the reading level of each document.

Method: a linear pairwise ranker learned from graded document pairs on syntax and
vocabulary features; its scores are calibrated into levels by isotonic regression on cross-fitted
scores (of rankers that have not seen the document).

A document is read by its main text: lines that are not prose (tables, logs, sequences,
numbers) are left out, the rest is cut into sentences, and the document's score is the
median of its sentences' scores, so a few sentences of another register do not move it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter, mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
VOCABULARY = 2048  # hashed word (and Chinese character pair) features
SYNTAX = 18
FULL_SENTENCE = 8  # words from which a sentence has full weight in the median
MAX_LABELLED = 4000  # graded documents that the ranker is trained on at most
PAIRS = 40_000  # pairs of them that the ranker is trained on at most
FOLDS = 5
KNOWN_WORDS = 200_000  # words whose weights a task keeps

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_HAN_RUN = re.compile(r"[㐀-䶿一-鿿豈-﫿]+")
_END = re.compile(r"[.!?](?=\s)|[。！？]")
_MARK = re.compile(r"(?:[-*•+>#]+|\(?\d{1,4}[.)、]|\(?[a-zA-Z][.)])\s+")
_NOT_PROSE = re.compile(r"\|.*|[-=_*#|:\s]+|\[[^\]]*\]\s*\w+=.*|[ACGTUNacgtun\s]{8,}|[^\W\d_]*\d*(?:\t\S+)+")
_CODE = re.compile(r"[\d_/=\\]")  # in names of files, genes and samples
_CODED = re.compile(r"(?<!\S)[^\s\d_/=\\]*+[\d_/=\\]\S*+")  # such a name; each text position is looked at once


def _prose(text: str | None) -> Iterator[str]:
    """The candidate sentences of a text: prose lines without list marks, cut at sentence ends."""
    for line in (text or "").splitlines():
        line = line.strip()
        if line and not _NOT_PROSE.fullmatch(line):
            m, at = _MARK.match(line), 0
            line = line[m.end() :] if m else line
            for end in _END.finditer(line):
                s = line[at : end.end()].strip()
                at = end.end()
                if s:
                    yield s
            s = line[at:].strip()
            if s:
                yield s


def sentences(text: str | None) -> list[str]:
    """The sentences of a text's prose: at least two words, or any Chinese. Null or blank: none."""
    return [s for s in _prose(text) if _HAN.search(s) or len(_WORD.findall(s)) >= 2]


def is_chinese(text: str | None) -> bool:
    """Mainly written in Chinese characters: a character weighs as much as two letters."""
    t = text or ""
    han = len(_HAN.findall(t))
    return han > 0 and 2 * han >= sum(c.isalpha() for c in t) - han


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % VOCABULARY


_slots: dict[str, int] = {}


def _cached(word: str) -> int:
    s = _slots.get(word)
    if s is None:
        if len(_slots) > 200_000:
            _slots.clear()
        s = _slots[word] = _slot(word)
    return s


def _shape(lengths: list[int], size: int, heaviest: int, commas: int, distinct: int, units: int) -> list[float]:
    n = len(lengths) or 1
    return [
        min(size, 80) / 20, math.log1p(size), sum(lengths) / n / 8, heaviest / 16,
        sum(x >= 7 for x in lengths) / n, sum(x >= 10 for x in lengths) / n, sum(x >= 13 for x in lengths) / n,
        commas / 4, distinct / (units or 1),
    ]


_NO_SHAPE = [0.0] * (SYNTAX // 2)
_PUNCTUATION = re.compile(r"[,;:，；、：]")
_CLAUSE = re.compile(r"[，、；：。！？,;\s]+")


def _words(low: str) -> list[str]:
    return _WORD.findall(_CODED.sub(" ", low) if _CODE.search(low) else low)


def _parts(s: str) -> tuple[bool, list[float], list[str]] | None:
    """(Chinese?, syntax values, words or character pairs) of a sentence; None if it is none.
    Upper and lower case are one; names of files, genes and samples are no vocabulary."""
    low = s.lower()
    runs = _HAN_RUN.findall(low) if not low.isascii() else []
    words = _words(low)
    if runs:
        n_han = sum(map(len, runs))
        if 2 * n_han >= sum(c.isalpha() for c in low) - n_han:
            units = [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
            clauses = [len(x) for x in _CLAUSE.split(low) if x] or [0]
            return True, _shape(clauses, n_han, max(map(len, runs)), len(_PUNCTUATION.findall(low)), len(set(units)), len(units)), units
    elif len(words) < 2 and len(_WORD.findall(low)) < 2:
        return None
    lengths = list(map(len, words))
    return False, _shape(lengths, len(words), max(lengths, default=0), len(_PUNCTUATION.findall(low)), len(set(words)), len(words)), words


def sentence_features(s: str) -> tuple[list[float], list[int]] | None:
    """The syntax values and the vocabulary slots of a sentence (Chinese has weights of its own for
    its syntax); None for a text that is no sentence."""
    p = _parts(s)
    if p is None:
        return None
    zh, shape, units = p
    return (_NO_SHAPE + shape if zh else shape + _NO_SHAPE), [_cached(u) for u in units]


def document_features(text: str | None) -> np.ndarray | None:
    """The mean of the sentences' features; None where there is no prose."""
    x, n = np.zeros(SYNTAX + VOCABULARY, np.float32), 0
    for f in map(sentence_features, _prose(text)):
        if f is not None:
            n += 1
            x[:SYNTAX] += f[0]
            if f[1]:
                np.add.at(x, np.asarray(f[1]) + SYNTAX, 1.0 / len(f[1]))
    return x / n if n else None


def weighted_median(x: list[float], weight: list[float]) -> float:
    """The value at which half of the weight is reached; between two values their mean. No weight is below 0.1."""
    pairs = sorted(zip(x, weight), key=itemgetter(0))
    half, c = sum(max(w, 0.1) for w in weight) / 2, 0.0
    for k, (v, w) in enumerate(pairs):
        c += max(w, 0.1)
        if c >= half - 1e-9:
            return (v + pairs[k + 1][0]) / 2 if c <= half + 1e-9 and k + 1 < len(pairs) else v
    return pairs[-1][0]


class _Words(dict):
    """The weights of the words met so far, up to KNOWN_WORDS. A word's weight is its vocabulary slot's and, outside Chinese,
    the syntax values that are means over words: its length, and whether it is long."""

    def __init__(self, value: list[float], by_length: tuple[float, float, float, float]):
        super().__init__()
        self.value, self.by_length = value, by_length

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        n, (a, b, c, d) = len(word), self.by_length
        self[word] = w = self.value[_slot(word)] + a * n / 8 + b * (n >= 7) + c * (n >= 10) + d * (n >= 13)
        return w


@dataclass
class ReadingModel:
    """The ranker's weights and the isotonic fits that turn a score into a level."""

    weights: np.ndarray  # SYNTAX + VOCABULARY
    edges: list[tuple[np.ndarray, np.ndarray]]  # of each level from 2 on: scores and P(level or more)
    n_documents: int
    n_pairs: int
    held_out: dict[str, tuple[float, int]] = field(default_factory=dict)  # measure: share, documents

    def scorer(self):
        """A function from a text to the weighted median score of its sentences, or None without prose; a
        sentence of a few words (a greeting) weighs less than a full one."""
        half = SYNTAX // 2
        plain, chinese = self.weights[:half].tolist(), self.weights[half:SYNTAX].tolist()
        value = self.weights[SYNTAX:].tolist()
        word = _Words(value, (plain[2], plain[4], plain[5], plain[6])).__getitem__
        pair = _Words(value, (0.0, 0.0, 0.0, 0.0)).__getitem__
        sized = [plain[0] * n / 20 + plain[1] * math.log1p(n) for n in range(81)]
        longest, commas, distinct = plain[3] / 16, plain[7] / 4, plain[8]

        def score(text: str | None) -> float | None:
            out, size = [], []
            for s in _prose(text):
                low = s.lower()
                if low.isascii():
                    words, marks = _words(low), low.count(",") + low.count(";") + low.count(":")
                elif _HAN.search(low):
                    p = _parts(s)
                    if p is None:
                        continue
                    if p[0]:
                        _, shape, units = p
                        out.append(sum(map(mul, chinese, shape)) + (sum(map(pair, units)) / len(units) if units else 0.0))
                        size.append(min(len(units), FULL_SENTENCE))
                        continue
                    words, marks = p[2], len(_PUNCTUATION.findall(low))
                else:
                    words, marks = _words(low), len(_PUNCTUATION.findall(low))
                n = len(words)
                if n < 2 and not _HAN.search(low) and len(_WORD.findall(low)) < 2:
                    continue
                x = (sized[n] if n < 81 else sized[80] + plain[1] * (math.log1p(n) - math.log1p(80))) + commas * marks
                if n:
                    x += longest * max(map(len, words)) + distinct * len(set(words)) / n + sum(map(word, words)) / n
                out.append(x)
                size.append(min(n, FULL_SENTENCE))
            return weighted_median(out, size) if out else None

        return score

    def score(self, text: str | None) -> float | None:
        return self.scorer()(text)

    def level(self, score: float) -> int:
        return 1 + sum(int(np.interp(score, x, y) >= 0.5) for x, y in self.edges)

    def expected(self, score: float) -> float:
        return 1.0 + float(sum(np.interp(score, x, y) for x, y in self.edges))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of y over x with least squared error (pool adjacent violators),
    as block centres for interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order], y[order]):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def learn_ranker(x: np.ndarray, grade: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, steps: int = 300, seed: int = 7) -> tuple[np.ndarray, int]:
    """Weights w that put the higher graded document of each pair above the other:
    logistic loss on w (x_i - x_j), full gradient (Adam), over at most `pairs` pairs drawn
    from all pairs whose grades differ."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1])
    i, j = rng.integers(0, len(x), (2, pairs * 2)) if len(x) else (np.zeros(0, int), np.zeros(0, int))
    keep = grade[i] > grade[j]
    i, j = i[keep][:pairs], j[keep][:pairs]
    if not len(i):
        return w, 0
    gap = np.minimum(grade[i] - grade[j], 2.0)
    row, col = np.nonzero(x)  # most words are not in a document
    value = x[row, col].astype(np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = np.bincount(row, value * w[col], len(x))
        g = -gap / (1 + np.exp(np.clip(s[i] - s[j], -30, 30)))
        by = np.bincount(i, g, len(x)) - np.bincount(j, g, len(x))
        grad = np.bincount(col, value * by[row], len(w)) / len(i) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, len(i)


def _edges(score: np.ndarray, grade: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [isotonic(score, (grade >= k - 0.25).astype(float)) for k in range(2, LEVELS + 1)] if len(score) else []


def calibrate(model: ReadingModel, score: np.ndarray, grade: np.ndarray, fold: np.ndarray, agreed: np.ndarray) -> ReadingModel:
    """The model with its isotonic fits on cross-fitted scores, and with what they are worth: each fold's documents get
    their levels from fits on the other folds. agreed: two readers or more gave the document the same level."""
    model.edges = _edges(score, grade)
    level = np.zeros(len(score), int)
    for f in np.unique(fold):
        own = ReadingModel(model.weights, _edges(score[fold != f], grade[fold != f]), 0, 0)
        level[fold == f] = [own.level(s) for s in score[fold == f]]
    demanding_ = (level >= LEVELS - 1) == (grade >= LEVELS - 1.25)
    for name, hit in (("demanding_as_marked", demanding_), ("demanding_as_agreed", demanding_[agreed]), ("within_one_level", np.abs(level - grade) <= 1)):
        model.held_out[name] = (float(hit.mean()) if len(hit) else float("nan"), len(hit))
    return model


def graded(documents: DataFrame, marks: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, grade, agreed, fold): the graded documents with their mean mark, at most max_labelled
    of them (those with the smallest hash, so that the same ones are taken on every run)."""
    m = marks.select("doc_id", "reader", "reading_level").filter("doc_id is not null and reading_level between 1 and 5").distinct()
    same = (F.count(F.lit(1)) > 1) & (F.min("reading_level") == F.max("reading_level"))
    g = m.groupBy("doc_id").agg(F.avg("reading_level").alias("grade"), same.alias("agreed"))
    g = g.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the documented bound of the training sample
    return documents.select("doc_id", "text").join(g, "doc_id", "inner").withColumn("fold", F.pmod(F.hash("doc_id"), F.lit(FOLDS)))


def train(documents: DataFrame, marks: DataFrame, max_labelled: int = MAX_LABELLED, settle=None) -> ReadingModel:
    """Learns the ranker and its calibration. Features and scores are made on the executors; the
    driver receives max_labelled feature rows (of a fixed length) and scores at most. Each fold's documents are scored by a ranker that
    was trained on the other folds, and the levels are calibrated on those scores. Without graded documents
    that differ in grade the model gives every text level 1. settle: a function that writes the sample and reads it back."""
    sample = graded(documents, marks, max_labelled)
    sample = settle(sample) if settle else sample

    def featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(g, f, x.tobytes()) for t, g, f in zip(p["text"], p["grade"], p["fold"]) if (x := document_features(t)) is not None]
            yield pd.DataFrame(rows, columns=["grade", "fold", "x"])

    got = sample.mapInPandas(featured, "grade double, fold int, x binary").toPandas()
    if got.empty:
        return ReadingModel(np.zeros(SYNTAX + VOCABULARY), [], 0, 0)
    got = got.sort_values(["grade", "x"], kind="stable")
    x, grade, fold = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]), got["grade"].to_numpy(float), got["fold"].to_numpy()
    w, n = learn_ranker(x, grade)
    model = ReadingModel(w, [], len(x), n)
    others = {int(f): ReadingModel(learn_ranker(x[fold != f], grade[fold != f])[0], [], 0, 0) for f in np.unique(fold)}

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = {f: o.scorer() for f, o in others.items()}
        for p in parts:
            rows = [(g, f, a, s) for t, g, f, a in zip(p["text"], p["grade"], p["fold"], p["agreed"]) if f in score and (s := score[f](t)) is not None]
            yield pd.DataFrame(rows, columns=["grade", "fold", "agreed", "score"])

    s = sample.mapInPandas(scored, "grade double, fold int, agreed boolean, score double").toPandas().sort_values(["score", "grade"], kind="stable")
    return calibrate(model, s["score"].to_numpy(float), s["grade"].to_numpy(float), s["fold"].to_numpy(), s["agreed"].to_numpy(bool))


def reading_levels(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """(doc_id, n_text, chinese, score, reading_level, expected_level) of every document.

    n_text counts the characters of the whole text. Texts without prose (null, blank, tables
    only) have null score and level. A model without calibration gives level 1. The model
    (a few tens of KB, whatever the corpus) goes to the tasks with the function."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for p in parts:
            score = list(map(scorer, p["text"]))
            yield pd.DataFrame({
                "doc_id": p["doc_id"],
                "n_text": [len(t) if t else 0 for t in p["text"]],
                "chinese": [is_chinese(t) for t in p["text"]],
                "score": pd.array([np.nan if s is None else s for s in score], "Float64"),
                "reading_level": pd.array([None if s is None else model.level(s) for s in score], "Int32"),
                "expected_level": pd.array([None if s is None else model.expected(s) for s in score], "Float64"),
            })

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_text int, chinese boolean, score double, reading_level int, expected_level double"
    return documents.select("doc_id", "text").mapInPandas(read, out)


def demanding(levels: DataFrame, least_level: int = 4, least_chars: int = 300, least_chars_chinese: int = 100) -> DataFrame:
    """The doc_ids of the levels' documents that are at least so demanding and long."""
    long = F.col("n_text") >= F.when(F.col("chinese"), F.lit(least_chars_chinese)).otherwise(F.lit(least_chars))
    return levels.filter((F.col("reading_level") >= least_level) & long).select("doc_id")
