"""Quality rules by repetition coverage.

Words are ids within their text, so n-grams are rows of integers: a polynomial rolling hash over the ids (numpy, modulo
2**64) finds equal windows, neighbours in hash order are compared id by id, and the characters of all words that lie
in a window seen twice are measured for several lengths, as are the characters of repeated lines.
"""

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from fathomline.llm.common import map_texts, text_column

SYMBOLS = re.compile(r"[#*$%&|<>]")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Largest allowed share of word characters in repeated n-grams by n, and in repeated lines."""

    grams: tuple[tuple[int, float], ...] = ((5, 0.25), (6, 0.24), (7, 0.23), (8, 0.22), (9, 0.21), (10, 0.20))
    lines: float = 0.25


def prefixes(ids: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes modulo 2**64 (one more than words), from which each window's hash rolls out.

    The ids are spread over 64 bits first. Prefix ``i`` is the sum of ``spread[j] * M**j``; ``M`` is odd.
    """
    with np.errstate(over="ignore"):
        spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        powers = np.full(len(ids), MULTIPLIER)
        powers[:1] = 1
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * np.cumprod(powers))))


def repeated(ids: np.ndarray, n: int, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the words in an n-word window that occurs twice or more, with and without its first occurrence."""
    count = len(ids) - n + 1
    every, later = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64)
    if count > 1:
        prefix = prefixes(ids) if prefix is None else prefix
        with np.errstate(over="ignore"):
            back = np.full(count, pow(int(MULTIPLIER), -1, 1 << 64), np.uint64)
            back[0] = 1
            rolled = (prefix[n:] - prefix[:-n]) * np.cumprod(back)
        order = np.argsort(rolled, kind="stable")
        a, b = order[:-1], order[1:]
        same = rolled[a] == rolled[b]
        if same.any():
            spots = np.flatnonzero(same)
            for k in range(n):
                spots = spots[ids[a[spots] + k] == ids[b[spots] + k]]
            both = np.unique(np.concatenate((a[spots], b[spots])))
            np.add.at(every, both, 1)
            np.add.at(every, both + n, -1)
            tail = b[spots]
            np.add.at(later, tail, 1)
            np.add.at(later, tail + n, -1)
    return np.cumsum(every)[:-1] > 0, np.cumsum(later)[:-1] > 0


def measure(text: str, rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line share, largest n-gram excess.

    Words are runs without ASCII white space; characters are code points. A repeated n-gram covers the words of all its
    occurrences but the first; a repeated line is one with a word that equals an earlier line of the text.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n_words)
    sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in number), np.int64, len(number))
    chars = sizes[ids] if n_words else np.zeros(0, np.int64)
    word_chars = int(chars.sum())
    seen: set[bytes] = set()
    n_dup, dup_chars = 0, 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup += 1
            dup_chars += len(b"".join(line.split()).decode("utf-8", "surrogatepass"))
        elif line and not line.isspace():
            seen.add(line)
    prefix = prefixes(ids)
    marks = {n: repeated(ids, n, prefix) for n in {8, *(n for n, _ in rules.grams)}}
    n_repeat = int(marks[8][0].sum())
    failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    excess = 0.0
    for n, share in rules.grams:
        covered = int(chars[marks[n][1]].sum())
        if word_chars:
            excess = max(excess, covered / word_chars - share)
    line_share = dup_chars / word_chars if word_chars else 0.0
    kept = not failed and excess <= 0 and line_share <= rules.lines
    return n_words, word_chars, len(SYMBOLS.findall(text)), n_dup, n_repeat, failed, kept, line_share, excess


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, dup_line_share double, ngram_excess double"


def repetition(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row: doc_id and the columns of ``measure``. Null and empty texts have no words and fail the base rule.

    Rows with null or repeated doc_id stay as they are; other columns are ignored.
    """
    return map_texts(docs, ["doc_id"], SCHEMA, lambda: lambda texts: [list(c) for c in zip(*(measure(t, rules) for t in texts), strict=True)])


def keeps(rules: Rules = Rules()):
    """A column function text -> boolean for filters: whether the rules keep the text. Null counts as empty, which they reject."""
    return text_column(lambda: lambda texts: [measure(t, rules)[6] for t in texts], "boolean")
