"""Quality classification by a linear-chain conditional random field over lines (operator 5).

Each line of a text is good or bad. What a line looks like (shares of kinds of characters and of pairs of kinds, repeated
and distinct words, lengths) and what the lines before and after look like weigh on its label, and so does the label of
its neighbours. Forward-backward marginals of "good", weighted by the lines' lengths, give the text's share of good
lines; a logistic curve fitted on the training texts turns that into a score.

The field is fitted by gradient ascent on the likelihood of the training texts. Labels are of texts, those of lines are latent:
at first every line bears its text's label; then, in a few rounds of expectation and maximisation, a line bears what
forward-backward says of it when each line is drawn towards its text's label by log odds of ``DRAWN``. So a good text may hold bad
lines and a bad one good lines, and the chain learns how one follows the other. The training set is a bounded sample of whole texts: up to ``PER_CLASS`` labelled texts of each label, those of the least hash of
their id, as far as they have ``CLASS_CHARS`` characters together. Texts beyond ``TEXT_CHARS`` are left out before that is summed
up, so each label that has shorter texts is learned from twenty of them at least. Scores come from whole texts and from nothing else: no label, language, source
or id is an input.

Defined cases: a null text counts as empty, an empty text is one empty line, and both get a score. Texts whose labels
disagree, null labels and labels of unknown documents teach nothing. If one label is missing altogether, every text gets
the smoothed share of good labels. A null id is not held out and teaches nothing. Repeated rows are scored one by one; of
rows that share an id the least text teaches. A text with more than ``TEXT_CHARS`` characters teaches nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

FOLDS = 3
HELD_OUT = 1
PER_CLASS = 1500
CLASS_CHARS = 6_000_000
TEXT_CHARS = CLASS_CHARS // 20
#: Turns of ascent, and those before which lines are labelled anew.
STEPS = 150
RELABEL = (91, 111, 131)
DRAWN = 2.0
RATE = 0.05
RIDGE = 1e-3
#: Bytes of text whose characters are counted together.
SLICE = 1 << 20

#: Kinds of bytes: 0 lower, 1 upper, 2 digit, 3 blank, 4 above ASCII, 5 other control; each punctuation mark has its own.
KIND = np.full(256, 5, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 4
KIND[[9, 10, 11, 12, 13, 32]] = 3
_MARKS = [b for b in range(33, 127) if KIND[b] == 5]
KIND[_MARKS] = np.arange(6, 6 + len(_MARKS))
KINDS = 6 + len(_MARKS)
#: For pairs: sentence marks and other marks are one kind each.
COARSE = np.where(np.arange(KINDS) < 6, np.arange(KINDS), 7)
COARSE[KIND[[ord(c) for c in ".,;:'-"]]] = 6
PAIRS = 8
OWN = KINDS + PAIRS * PAIRS + 6
WIDTH = 3 * OWN + 3


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each line of each text; how many lines each text has; each line's length in bytes."""
    lists = pc.split_pattern(texts, "\n")
    n_lines = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    lines = lists.flatten()
    lengths = np.asarray(pc.binary_length(lines)).astype(np.int64)
    raw = np.frombuffer(b"".join(lines.cast(pa.binary()).to_pylist()), np.uint8)
    line = np.repeat(np.arange(len(lines)), lengths)
    kind = KIND[raw]
    n = len(lines)
    size = np.maximum(lengths, 1)[:, None]
    out = np.zeros((n, OWN), np.float32)
    out[:, :KINDS] = np.bincount(line * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / size
    coarse = COARSE[kind]
    inside = line[1:] == line[:-1]
    pair = (line[1:] * PAIRS * PAIRS + coarse[:-1] * PAIRS + coarse[1:])[inside]
    out[:, KINDS : KINDS + PAIRS * PAIRS] = np.bincount(pair, minlength=n * PAIRS * PAIRS).reshape(n, -1) / size
    words, offsets = kit.split_words(lines)
    n_words = np.diff(offsets)
    code = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    owner = np.repeat(np.arange(n), n_words)
    again = np.bincount(owner[1:][(code[1:] == code[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    distinct = np.bincount(np.unique(owner * (len(words) + 1) + code) // (len(words) + 1), minlength=n)
    some = np.maximum(n_words, 1)
    out[:, -6:] = np.stack([again / some, distinct / some, np.log1p(n_words), np.log1p(lengths / some), n_words == 0, np.log1p(lengths)], axis=1)
    return out, n_lines, lengths


def text_ends(n_lines: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are the first, and which the last of their text."""
    first = np.zeros(n, bool)
    first[np.cumsum(n_lines) - n_lines] = True
    return first, np.append(first[1:], True)[:n]


def emissions(own: np.ndarray, first: np.ndarray, last: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of good over bad of each line: from its features, those of the lines before and after, the ends, and a constant."""
    here, before, after = (own @ weights[: 3 * OWN].reshape(3, OWN).T).T
    out = here + first * weights[-3] + last * weights[-2] + weights[-1]
    out[1:] += np.where(first[1:], 0, before[:-1])
    out[:-1] += np.where(last[:-1], 0, after[1:])
    return out


def emission_slope(own: np.ndarray, first: np.ndarray, last: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The sum over lines of ``rest`` times the derivative of ``emissions`` by the weights."""
    next_rest, last_rest = np.zeros_like(rest), np.zeros_like(rest)
    next_rest[:-1] = np.where(first[1:], 0, rest[1:])
    last_rest[1:] = np.where(last[:-1], 0, rest[:-1])
    return np.concatenate([(own.T @ np.stack([rest, next_rest, last_rest], axis=1)).T.ravel(), [rest[first].sum(), rest[last].sum(), rest.sum()]])


@dataclass
class Model:
    weights: np.ndarray
    """One weight a feature: the log odds of good over bad that a line's features add."""
    moves: np.ndarray
    """moves[i, j]: the score of label j following label i (0 bad, 1 good)."""
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def emissions(self, own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return emissions(self.scaled(own), *text_ends(n_lines, len(own)), self.weights)

    def scaled(self, own: np.ndarray) -> np.ndarray:
        out = own - self.centre
        out /= self.scale
        return np.clip(out, -8, 8, out=out)


def chains(n_lines: np.ndarray):
    """Texts in groups of like line counts, longest first: (texts, first lines, lengths). A group pads at most twofold."""
    order = np.argsort(-n_lines, kind="stable")
    ends = np.cumsum(n_lines)
    power = np.frexp(n_lines[order].astype(float))[1]
    for group in np.split(order, np.flatnonzero(np.diff(power)) + 1):
        yield group, ends[group] - n_lines[group], n_lines[group]


def forward_backward(odds: np.ndarray, n_lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line; expected numbers of moves (2 x 2); the sum of the log partition functions."""
    step = np.exp(moves)
    marginal, expected, log_z = np.zeros(len(odds)), np.zeros((2, 2)), 0.0
    top = np.maximum(odds, 0)
    emit = np.stack([np.exp(-top), np.exp(odds - top)], axis=1)
    log_z += float(top.sum())
    for _, start, length in chains(n_lines):
        n, steps = len(start), int(length[0]) if len(length) else 0
        alpha, norm = np.zeros((steps, n, 2)), np.ones((steps, n))
        for t in range(steps):
            live = int(np.searchsorted(-length, -t, "left"))
            value = emit[start[:live] + t] if t == 0 else (alpha[t - 1, :live] @ step) * emit[start[:live] + t]
            norm[t, :live] = value.sum(axis=1)
            alpha[t, :live] = value / norm[t, :live, None]
        log_z += float(np.log(norm).sum())
        beta = np.ones((n, 2))
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            if t + 1 < steps:
                more = int(np.searchsorted(-length, -(t + 1), "left"))
                if more:
                    ahead = emit[start[:more] + t + 1] * beta[:more] / norm[t + 1, :more, None]
                    expected += step * (alpha[t, :more].T @ ahead)
                    beta[:more] = ahead @ step.T
            both = alpha[t, :live] * beta[:live]
            marginal[start[:live] + t] = both[:, 1] / both.sum(axis=1)
    return marginal, expected, log_z


def good_share(marginal: np.ndarray, lengths: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Per text: marginals weighted by line length; empty lines weigh as one byte."""
    first = np.cumsum(n_lines) - n_lines
    weight = np.maximum(lengths, 1).astype(float)
    return np.add.reduceat(marginal * weight, first) / np.add.reduceat(weight, first)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(texts: list[str], labels: list[int]) -> Model:
    """The field and the curve, from training texts and their labels. The same texts in the same order give the same model."""
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        flat = np.zeros(OWN, np.float32)
        return Model(np.zeros(WIDTH, np.float32), np.zeros((2, 2)), flat, flat + 1, constant=float((y.sum() + 1) / (len(y) + 2)))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    parts = [line_features(pa.array(texts[a:b], pa.string())) for a, b in kit.row_slices(sizes, SLICE)]
    own, n_lines, lengths = (np.concatenate(p) for p in zip(*parts))
    model = Model(np.zeros(WIDTH, np.float32), np.zeros((2, 2)), own.mean(axis=0), own.std(axis=0) + 1e-3)
    x, ends = model.scaled(own), text_ends(n_lines, len(own))
    label = np.repeat(y, n_lines)
    seen = np.zeros((2, 2))
    for value, n in zip(labels, n_lines):
        seen[value, value] += n - 1
    theta = [np.zeros(WIDTH), np.zeros((2, 2))]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for turn in range(1, STEPS + 1):
        if turn in RELABEL:
            drawn = emissions(x, *ends, theta[0].astype(np.float32)) + DRAWN * (2 * np.repeat(y, n_lines) - 1)
            label, seen, _ = forward_backward(drawn, n_lines, theta[1])
        marginal, expected, _ = forward_backward(emissions(x, *ends, theta[0].astype(np.float32)), n_lines, theta[1])
        slope = [emission_slope(x, *ends, (label - marginal).astype(np.float32)) / len(x) - RIDGE * theta[0], (seen - expected) / len(x) - RIDGE * theta[1]]
        for i, g in enumerate(slope):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] = theta[i] + RATE * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.99**turn)) + 1e-8)
    model.weights, model.moves = theta[0].astype(np.float32), theta[1]
    share = good_share(forward_backward(emissions(x, *ends, model.weights), n_lines, model.moves)[0], lengths, n_lines)
    # Newton's steps for the curve; the two labels weigh alike, and a ridge keeps it finite where they are separable.
    z, w = np.stack([share - 0.5, np.ones(len(share))], axis=1), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    curve = np.zeros(2)
    for _ in range(30):
        p = _sigmoid(z @ curve)
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-1, 1e-1])
        curve = curve + np.linalg.solve(hessian, z.T @ (w * (y - p)) - 1e-1 * curve)
    model.slope, model.shift = float(curve[0]), float(curve[1])
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on the bounded sample of labelled texts. What reaches the driver is that sample."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(kit.hash_fold("doc_id", FOLDS) != HELD_OUT)
    agreed = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    chosen = kit.least_hashed(agreed, "quality", "doc_id", per_class).select(F.col("doc_id").alias("__vx_id"), F.col("quality").alias("__vx_quality"))
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * per_class rows are broadcast.
    found = read.join(F.broadcast(chosen), F.col("id") == F.col("__vx_id")).groupBy("id").agg(F.min("text").alias("text"), F.min("__vx_quality").alias("quality"))
    found = found.filter(F.length("text") <= TEXT_CHARS)
    so_far = F.sum(F.length("text")).over(Window.partitionBy("quality").orderBy(F.xxhash64("id"), "id"))
    sample = found.withColumn("so_far", so_far).filter(F.col("so_far") <= CLASS_CHARS)
    rows = sample.select("id", "text", "quality").orderBy("id").toArrow()
    return fit(rows["text"].to_pylist(), rows["quality"].to_pylist())


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    if model.constant is not None or not len(texts):
        return np.full(len(texts), model.constant or 0.0)
    own, n_lines, lengths = line_features(texts)
    marginal, _, _ = forward_backward(model.emissions(own, n_lines), n_lines, model.moves)
    return _sigmoid(model.slope * (good_share(marginal, lengths, n_lines) - 0.5) + model.shift)


def _score(model: Model, names: list[str]):
    def run(batches):
        for batch in batches:
            for rows, texts in kit.text_slices(batch, most=SLICE):
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(scores(texts, model), pa.float64())], [*names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(kit.hash_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    scored = read.mapInArrow(kit.lean(_score(model, ["doc_id", "held_out"])), "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _accept(model: Model):
    def run(batches):
        for batch in batches:
            for rows, texts in kit.text_slices(batch, most=SLICE):
                yield rows.filter(pa.array(scores(texts, model) >= 0.5))

    return run


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is predicted to be good, with all their columns."""
    return docs.mapInArrow(kit.lean(_accept(model)), docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, kit.table(spark, sf_dir, "labels")))
