"""Document quality from line labels: a linear-chain conditional random field marks every line good or bad."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import apart, fold, least_by_hash, rejoined, stretches, table

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 30_000
ITERATIONS = 100
CAN_PASS = 0.3
FEATURES = ("bias", "length", "words", "upper", "marks", "digits", "bars", "shouts", "repeated", "adjacent", "word_length",
            "longest", "ends", "beyond_ascii", "stops", "short_words", "seen_before")
ENDS = tuple(".!?:;\"')…")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
UPPER, DIGITS, ASCII = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class LineModel:
    """Emission weights (own line, line before, line after), the transition scores [from, to], and the scaling of features."""

    weights: np.ndarray
    transitions: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features [lines, features] and lengths of the lines that are not blank; a text without any counts as one empty line."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        data = line.encode()
        n, size, distinct = len(words), len(data), len(set(words))
        letters = size - len(data.translate(None, LETTERS))
        beyond = len(data.translate(None, ASCII))
        adjacent = sum(map(str.__eq__, words, words[1:])) if distinct < n else 0
        rows.append((1.0, math.log1p(size), math.log1p(n), (size - len(data.translate(None, UPPER))) / (letters + 1),
                     (size - len(data.translate(None, MARKS))) / size, (size - len(data.translate(None, DIGITS))) / size,
                     data.count(b"|") / n, data.count(b"!") / n, 1 - distinct / n, adjacent / n, size / n,
                     math.log1p(max(map(len, words))), float(line.rstrip().endswith(ENDS)), beyond / size,
                     data.count(b".") / n, sum(len(w) < 4 for w in words) / n, float(line in seen)))
        lengths.append(size)
        seen.add(line)
    if not rows:
        return np.array([[1.0] + [0.0] * (len(FEATURES) - 1)]), np.ones(1)
    return np.array(rows), np.array(lengths, dtype=float)


def with_neighbours(x: np.ndarray, model_mean: np.ndarray, spread: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scaled features of each line beside those of the lines before and after it (zeros at a text's ends).

    ``first`` holds the index of each text's first line, texts lying one after another.
    """
    own = (x - model_mean) / spread
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0.0
    after[np.append(first[1:], len(x)) - 1] = 0.0
    return np.hstack([own, before, after])


def _forward(e: np.ndarray, valid: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log-weights [texts, lines, states] of all labellings up to each line; ``e`` scores state 1 against 0."""
    out = np.zeros((*e.shape, 2))
    out[:, 0, 1] = e[:, 0]
    for t in range(1, e.shape[1]):
        before = out[:, t - 1]
        for s in (0, 1):
            out[:, t, s] = np.logaddexp(before[:, 0] + a[0, s], before[:, 1] + a[1, s]) + s * e[:, t]
        out[:, t] = np.where(valid[:, t, None], out[:, t], before)
    return out


def fit(lines: list[np.ndarray], labels: np.ndarray, iterations: int = ITERATIONS, penalty: float = 1e-3) -> LineModel:
    """Maximum conditional likelihood by Adam over all texts at once; each line carries its text's label.

    ``lines`` are the feature arrays of a bounded sample of texts. With no text, or with texts of
    one label only, the penalised fit still ends and scores lean to that label.
    """
    width = len(FEATURES)
    if not lines:
        return LineModel(np.zeros(3 * width), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    lengths = np.array([len(x) for x in lines])
    order = np.argsort(lengths)
    flat = np.concatenate([lines[i] for i in order])
    mean, spread = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    mean[0], spread[0] = 0.0, 1.0
    first = np.append(0, np.cumsum(lengths[order])[:-1])
    x = with_neighbours(flat, mean, spread, first)
    y = labels[order].astype(float)
    # Texts of like length are padded together.
    groups, start = [], 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and lengths[order[stop]] <= 1.3 * lengths[order[start]] + 2:
            stop += 1
        places = first[start:stop, None] + np.arange(lengths[order[stop - 1]])
        valid = np.arange(places.shape[1]) < lengths[order[start:stop], None]
        groups.append((np.where(valid, places, 0), valid, y[start:stop]))
        start = stop
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, iterations + 1):
        w, a = theta[:-4], theta[-4:].reshape(2, 2)
        emission, grad_e, grad_a = x @ w, np.zeros(len(x)), np.zeros((2, 2))
        for places, valid, label in groups:
            e = np.where(valid, emission[places], 0.0)
            ahead = _forward(e, valid, a)
            n, size = e.shape
            behind = np.zeros((n, size, 2))
            for t in range(size - 2, -1, -1):
                later = behind[:, t + 1] + np.stack([np.zeros(n), e[:, t + 1]], axis=1)
                for s in (0, 1):
                    behind[:, t, s] = np.logaddexp(later[:, 0] + a[s, 0], later[:, 1] + a[s, 1])
                behind[:, t] = np.where(valid[:, t + 1, None], behind[:, t], 0.0)
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            marginal = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
            weight = 1.0 / valid.sum(axis=1)[:, None]  # every text counts once, however long
            np.add.at(grad_e, places[valid], ((label[:, None] - marginal) * weight)[valid])
            if size > 1:
                pair = (ahead[:, :-1, :, None] + a + behind[:, 1:, None, :]
                        + np.stack([np.zeros_like(e), e], axis=2)[:, 1:, None, :] - total[:, None, None, None])
                both = np.where(valid[:, 1:, None, None], np.exp(np.minimum(pair, 0.0)), 0.0) * weight[:, :, None, None]
                grad_a -= both.sum(axis=(0, 1))
                steps = (valid[:, 1:] * weight).sum(axis=1)
                grad_a[0, 0] += steps[label == 0].sum()
                grad_a[1, 1] += steps[label == 1].sum()
        grad = np.append(x.T @ grad_e, grad_a.ravel()) / len(lines) - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineModel(theta[:-4], theta[-4:].reshape(2, 2), mean, spread)


def marginals(emission: list[float], transitions: list[list[float]]) -> list[float]:
    """The probability that each line of one text is good, by forward and backward log-odds messages."""

    def step(odds: float, stay0: float, to1: float, to0: float, stay1: float) -> float:
        top = max(0.0, odds)
        return (math.log(math.exp(to1 - top) + math.exp(odds + stay1 - top))
                - math.log(math.exp(stay0 - top) + math.exp(odds + to0 - top)))

    (a00, a01), (a10, a11) = transitions
    ahead, odds = [], 0.0
    for t, e in enumerate(emission):
        odds = min(500.0, max(-500.0, e + (step(odds, a00, a01, a10, a11) if t else 0.0)))
        ahead.append(odds)
    out, odds = [0.0] * len(emission), 0.0
    for t in range(len(emission) - 1, -1, -1):
        out[t] = 1 / (1 + math.exp(-min(700.0, max(-700.0, ahead[t] + odds))))
        odds = step(min(500.0, max(-500.0, odds + emission[t])), a00, a10, a01, a11)
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> LineModel:
    """Fit on a bounded sample: about ``sample_rows`` labelled texts of each label, chosen by the hash
    of the id. Of a text over ``sample_chars`` characters the whole lines of stretches from all over it are taken. Null labels and null texts
    teach nothing, repeated rows as often as they come; an empty table gives a model that knows nothing. Further columns are not read."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    chosen = least_by_hash(known, "label", "key", sample_rows).distinct()
    # The sample's ids are bounded by its parameters, so the texts stay where they are.
    parts = stretches(F.col("text"), sample_chars, F.col("key"))
    # A stretch within a text gives its whole lines, or itself if it has none.
    whole = F.transform(parts, lambda p: F.when(F.regexp_count(p, F.lit("\n")) > 1, F.regexp_replace(p, r"\A[^\n]*\n|\n[^\n]*\z", "")).otherwise(p))
    taken = F.when(F.size(parts) == 1, F.col("text")).otherwise(F.array_join(whole, "\n"))
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(
        F.broadcast(chosen), "key").select("key", "label", taken.alias("text")).orderBy("key", "label").collect()
    return fit([line_features(r.text)[0] for r in sample], np.array([r.label for r in sample]))


def line_scores(model: LineModel, text: Column) -> Column:
    """A struct of score, n_lines and n_bad_lines: the length-weighted mean of the lines' probabilities of
    being good, the number of lines that are not blank, and how many of them are more likely bad."""
    transitions = model.transitions.tolist()

    @F.pandas_udf("score double, n_lines int, n_bad_lines int")
    def scored(texts: pd.Series) -> pd.DataFrame:
        out = []
        for body in texts:
            x, lengths = line_features(body)
            emission = with_neighbours(x, model.mean, model.spread, np.zeros(1, dtype=int)) @ model.weights
            good = np.array(marginals(emission.tolist(), transitions))
            out.append((float(good @ lengths / lengths.sum()), len(good), int((good < 0.5).sum())))
        return pd.DataFrame(out, columns=["score", "n_lines", "n_bad_lines"])

    return scored(text)


def score_lines(docs: DataFrame, model: LineModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, score, n_lines, n_bad_lines for every row, by whole texts of any length; a null, empty
    or blank text counts as one empty line. Repeated rows and null ids get a row each, an empty table gives none, further columns are not read."""
    rows = docs.select(F.col(key).alias("key"), line_scores(model, F.col(text)).alias("found"))
    return rows.select(F.col("key").alias(key), "found.score", "found.n_lines", "found.n_bad_lines")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return score_lines(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= CAN_PASS).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = CAN_PASS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``; each row is judged where it lies.

    The model learns from the labels of the same folds as the registered query. Columns stay as they are, whatever their names;
    repeated rows are judged alike, an empty table stays empty.
    """
    model = learn(docs, labels.where(fold(F.col(key), 5) != 0), key, text)
    return rejoined(apart(docs, quality=line_scores(model, F.col(text))).where(F.col("quality.score") >= least), docs)


QUERIES = {"op4_line_quality": op4_line_quality}
ORACLE: dict[str, str] = {}
