"""Line quality by a linear-chain conditional random field.

Every line is good or bad. A line's features are measures of itself and of the lines before and after it; neighbouring
labels are tied by a 2 x 2 transition table. With two states the forward and backward messages are log-odds, computed
for all documents of a batch at once. Marginals, weighted by the lines' lengths, make the document's quality, which a
logistic curve maps to a score. Lines learn from their document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import map_texts
from fathomline.llm.labelled import remainder, sample
from fathomline.llm.toxicity import logistic

PER_CLASS, MAX_CHARS, MAX_LINES = 1500, 20_000, 200

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "mark": b"#*$%&|<>", "shout": b"!?", "stop": b".,;:", "bar": b"|", "other": bytes(range(128, 256))}
_TABLE = np.zeros((len(_CLASSES), 256), bool)
for _k, _members in enumerate(_CLASSES.values()):
    _TABLE[_k, list(_members)] = True


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text."""
    split = [t.encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    lines = [x for s in split for x in s]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"".join(lines), np.uint8)
    at = np.repeat(np.arange(len(lines)), sizes)
    counts = {name: np.bincount(at[_TABLE[k][data]], minlength=len(lines)) for k, name in enumerate(_CLASSES)}
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.int64, len(lines))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(lines))
    seen_before = np.zeros(len(lines), bool)
    k = 0
    for s in split:
        seen: set[bytes] = set()
        for x in s:
            if x and x in seen:
                seen_before[k] = True
            seen.add(x)
            k += 1
    solid, letters = np.maximum(1, sizes - counts["space"]), np.maximum(1, counts["upper"] + counts["lower"])
    own = np.column_stack((
        counts["upper"] / letters, counts["mark"] / solid, counts["bar"] / solid, counts["shout"] / solid, counts["stop"] / solid, counts["digit"] / solid, counts["other"] / solid,
        np.sqrt(counts["mark"] / solid), np.sqrt(counts["shout"] / solid), np.where(n_words > 0, distinct / np.maximum(1, n_words), 1.0), np.minimum(solid / np.maximum(1, n_words), 20) / 10,
        np.log1p(n_words) / 4, n_words == 0, seen_before,
    ))
    lens = np.fromiter(map(len, split), np.int64, len(split))
    first = np.zeros(len(lines), bool)
    first[np.cumsum(lens) - lens] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack((own, before, after, first, last, np.ones(len(lines)))), sizes, lens


def _pad(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    grid = np.zeros((len(lens), lens.max()))
    grid[np.arange(lens.max()) < lens[:, None]] = values
    return grid


def _step(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds after a transition from log-odds ``x``; ``t[a, b]`` is the log weight of going from a to b."""
    return np.logaddexp(t[1, 1] + x, t[0, 1]) - np.logaddexp(t[1, 0] + x, t[0, 0])


def messages(unary: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds (documents x lines, padded)."""
    grid = _pad(unary, lens)
    fore, back = grid.copy(), np.zeros_like(grid)
    order = np.argsort(-lens, kind="stable")
    alive = np.searchsorted(-lens[order], -np.arange(1, grid.shape[1] + 1), side="right")
    for t in range(1, grid.shape[1]):
        d = order[: alive[t]]
        fore[d, t] += _step(fore[d, t - 1], trans)
    for t in range(grid.shape[1] - 2, -1, -1):
        d = order[: alive[t + 1]]
        back[d, t] = _step(grid[d, t + 1] + back[d, t + 1], trans.T)
    return fore, back


def marginals(unary: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Chance of good for every line, by forward-backward, in batches of documents of similar length."""
    out, starts = np.zeros(len(unary)), np.cumsum(lens) - lens
    order = np.argsort(lens, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and lens[order[hi]] <= 2 * lens[order[lo]] + 8:
            hi += 1
        docs = np.sort(order[lo:hi])
        rows = np.repeat(starts[docs], lens[docs]) + np.arange(lens[docs].sum()) - np.repeat(np.cumsum(lens[docs]) - lens[docs], lens[docs])
        fore, back = messages(unary[rows], lens[docs], trans)
        out[rows] = (1 / (1 + np.exp(-(fore + back).clip(-40, 40))))[np.arange(fore.shape[1]) < lens[docs][:, None]]
        lo = hi
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean marginal of each text; a text without characters counts its empty lines alike."""
        if not texts:
            return np.zeros(0)
        x, sizes, lens = line_features(texts)
        p = marginals(((x - self.mean) / self.scale * self.weights).sum(1), lens, self.trans)  # row by row: a matrix product's last bits follow the batch
        doc = np.repeat(np.arange(len(lens)), lens)
        weight = sizes + 1e-3
        return np.bincount(doc, p * weight) / np.bincount(doc, weight)

    def scores(self, texts: list[str]) -> np.ndarray:
        q = self.quality(texts).clip(1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> Model:
    """Maximum conditional likelihood by Adam; the gradient is observed minus expected counts from forward-backward."""
    x, _, lens = line_features(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    doc = np.repeat(np.arange(len(lens)), lens)
    y, line_weight = labels[doc].astype(float), (weight / lens)[doc]
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inside = np.arange(lens.max()) < lens[:, None]
    pair = inside[:, 1:]
    pair_weight = np.broadcast_to((weight / lens)[:, None], pair.shape)[pair]
    pair_label = np.broadcast_to(labels[:, None], pair.shape)[pair]
    for k in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        unary = x @ w
        fore, back = messages(unary, lens, trans)
        p = 1 / (1 + np.exp(-(fore + back)[inside].clip(-40, 40)))
        grad = np.zeros_like(theta)
        grad[:-4] = x.T @ (line_weight * (y - p))
        if pair.any():
            right = (_pad(unary, lens) + back)[:, 1:][pair]
            left = fore[:, :-1][pair]
            joint = np.stack([trans[a, b] + a * left + b * right for a in (0, 1) for b in (0, 1)])
            joint = np.exp(joint - joint.max(0))
            joint /= joint.sum(0)
            for j, (a, b) in enumerate((a, b) for a in (0, 1) for b in (0, 1)):
                grad[len(w) + j] = (pair_weight * ((pair_label == a) * (a == b) - joint[j])).sum()
        grad = grad / weight.sum() - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0))
    q = model.quality(texts).clip(1e-6, 1 - 1e-6)
    slope, shift = logistic(np.column_stack((np.log(q / (1 - q)), np.ones(len(q)))), labels.astype(float), weight)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), (float(slope), float(shift)))


def train(docs: DataFrame, labels: DataFrame, divisor: int = 3, held: int = 1) -> Model:
    """Learn from at most ``PER_CLASS`` documents a class, none with remainder ``held`` or over ``MAX_LINES`` lines.

    With labels of one class only (or none) every score is 1, or 0 if that class is 0.
    """
    rows, counts = sample(docs, labels, "quality", lambda d: remainder(d, divisor) != held, PER_CLASS, MAX_CHARS)
    rows = [(t, y) for t, y in rows if t.count("\n") < MAX_LINES]
    y = np.array([c for _, c in rows], float)
    if len(set(y.tolist())) < 2:
        width = line_features([""])[0].shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), (0.0, -30.0 if counts[0] and not counts[1] else 30.0))
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    return fit([t for t, _ in rows], y, weight)


def score(docs: DataFrame, model: Model, divisor: int = 3, held: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null and empty texts are one empty line.

    Rows with null doc_id (held_out false) or repeated ones stay as they are; other columns are ignored.
    """
    scored = map_texts(docs, ["doc_id"], "score double", lambda: lambda texts: [model.scores(texts)])
    held_out = F.coalesce(remainder(F.col("doc_id"), divisor) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
