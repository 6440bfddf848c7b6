"""Toxicity by compression distance: two zstandard dictionaries, window lengths under each, calibrated thresholds.

The ordinary dictionary is the ``ORDINARY_WORDS`` most frequent words of ordinary documents. The toxic one has, before the
same text, all words of toxic documents with a fragment that stands in many more different contexts there than in ordinary
documents (contexts, not occurrences, so that copies of one document count once). A window whose compressed length drops
under the toxic dictionary holds such words. A document's largest drops go through a logistic curve fitted on the half of
the sample that the dictionaries have not seen.

Dictionaries made of the two kinds of text without that choice do not tell them apart: toxic documents differ by a few
words, whose gain drowns in chance matches of all others. Of the held-out toxic documents of check_s they find 8 to 14 %
(``zstandard.train_dictionary`` on each kind, 32 to 110 KB), 11 to 12 % (256 KB and 1 MB of raw text of each kind) or 12
to 37 % (the toxic text before the ordinary one), with 0.5 to 2.4 % of the others flagged; with the choice 95.6 % and none.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import map_texts, text_column
from fathomline.llm.labelled import remainder, sample

FRAGMENTS = (5, 6, 7, 8)
#: Windows: words in each, words from one to the next, whether ordinary filler goes before (short windows are else stored uncompressed).
WINDOWS = ((8, 4, False), (4, 4, True))
FILLER = 40
LEVEL = 9
TOP = 3
PER_CLASS, MAX_CHARS = 3000, 20_000
ORDINARY_WORDS = 1500


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def _contexts(texts: list[str]) -> Counter:
    """Words by the number of different (previous, next) words around them."""
    seen = set()
    for text in texts:
        words = words_of(text)
        seen.update(zip([b"", *words[:-1]], words, [*words[1:], b""], strict=True))
    return Counter(w for _, w, _ in seen)


def _fragments(words: Counter) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        padded = b" " + word + b" "
        for size in FRAGMENTS:
            for piece in {padded[i : i + size] for i in range(len(padded) - size + 1)}:
                out[piece] += n
    return out


def train_dictionaries(toxic: list[str], ordinary: list[str], least: int = 20, ratio: float = 15.0) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary. ``least`` contexts a thousand toxic documents make a fragment count."""
    bad, good = _contexts(toxic), _contexts(ordinary)
    bad_parts, good_parts = _fragments(bad), _fragments(good)
    n_bad, n_good = max(1, bad.total()), max(1, good.total())
    floor = max(3, least * len(toxic) / 1000)
    marked = {p for p, n in bad_parts.items() if n >= floor and (good_parts[p] + 0.5) / n_good * ratio < (n + 0.5) / n_bad}
    chosen = []
    for word, n in bad.items():
        padded = b" " + word + b" "
        if n >= max(2, floor / 4) and any(padded[i : i + s] in marked for s in FRAGMENTS for i in range(len(padded) - s + 1)):
            chosen.append((n, word))
    common = sorted(good.items(), key=lambda x: (-x[1], x[0]))[:ORDINARY_WORDS]
    plain = b" " + b" ".join(w for w, _ in reversed(common)) + b" "
    return plain, b" " + b" ".join(w for _, w in sorted(chosen)) + plain


class Scorer:
    def __init__(self, plain: bytes, toxic: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        made = []
        for content in (plain, toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress)
        self.plain, self.toxic = made
        self.filler = plain[-FILLER:]

    def features(self, text: str) -> list[float]:
        """The largest drops of compressed length for each kind of window, their excess mean, and the log of the word count."""
        words, out = words_of(text), []
        plain, toxic = self.plain, self.toxic
        for size, step, filled in WINDOWS:
            lead = self.filler if filled else b" "
            drops = [len(plain(w)) - len(toxic(w)) for w in (lead + b" ".join(words[i : i + size]) + b" " for i in range(0, max(1, len(words) - size + step), step))] if words else []
            top = sorted(drops, reverse=True)[:TOP]
            out += [*top, *[0] * (TOP - len(top)), sum(d > 3 for d in drops) / (1 + len(drops))]
        return [*map(float, out), float(np.log1p(len(words)))]


@dataclass(frozen=True)
class Model:
    plain: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = np.column_stack(((np.array(rows).reshape(len(rows), len(self.mean)) - self.mean) / self.scale, np.ones(len(rows))))
        return 1 / (1 + np.exp(-(x * self.weights).sum(1).clip(-30, 30)))  # row by row: a matrix product's last bits follow the batch


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-9
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        g = x.T @ (weight * (p - y)) / weight.sum() + penalty * w
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x / weight.sum() + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0) -> Model:
    """Learn from at most ``PER_CLASS`` labelled documents a class, none with remainder ``held``.

    With labels of one class only (or none) every score is that class's share of the labels (none: 0).
    """
    rows, counts = sample(docs, labels, "toxic", lambda d: remainder(d, divisor) != held, PER_CLASS, MAX_CHARS)
    y = np.array([label for _, label in rows])
    if len(set(y.tolist())) < 2:
        bias = 30.0 if counts[1] else -30.0
        width = len(Scorer(b"  ", b"  ").features(""))
        return Model(b"  ", b"  ", np.zeros(width), np.ones(width), np.array([0.0] * width + [bias]))
    half = np.zeros(len(rows), bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    plain, toxic = train_dictionaries([t for (t, c), h in zip(rows, half, strict=True) if h and c], [t for (t, c), h in zip(rows, half, strict=True) if h and not c])
    own = Scorer(plain, toxic)
    rest = ~half if len(set(y[~half].tolist())) == 2 else np.ones(len(rows), bool)
    x = np.array([own.features(t) for (t, _), use in zip(rows, rest, strict=True) if use])
    y = y[rest]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    return Model(plain, toxic, mean, scale, logistic(np.column_stack(((x - mean) / scale, np.ones(len(x)))), y, weight))


def _work(model: Model):
    own = Scorer(model.plain, model.toxic)
    return lambda texts: model.scores([own.features(t) for t in texts]) if texts else np.zeros(0)


def score(docs: DataFrame, model: Model, divisor: int = 5, held: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null and empty texts have no window and the score of no drop.

    Rows with null doc_id (held_out false) or repeated ones stay as they are; other columns are ignored.
    """

    def make():
        scores = _work(model)
        return lambda texts: [scores(texts)]

    scored = map_texts(docs, ["doc_id"], "score double", make)
    held_out = F.coalesce(remainder(F.col("doc_id"), divisor) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def score_column(model: Model):
    """A column function text -> score; null counts as empty."""
    return text_column(lambda: _work(model), "double")
