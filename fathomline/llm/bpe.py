"""Byte-level BPE by prefix-sharing trie traversal.

Distinct pre-tokens go into a trie over the byte alphabet. A node's state is the last token of the encoding of its
prefix and the node where that token begins. For merges learnt by BPE (each pair ranks after both its parts) a list of
tokens is the encoding of their text exactly if every two neighbours stay apart when merged on their own, so a node's
state follows from its ancestors' states alone: it is the one vocabulary token that ends there and may follow the
ancestor's last token. Words are inserted in sorted order, which walks the trie depth first; every shared prefix is
encoded once, and the trie is kept between batches of a worker up to a fixed number of nodes. Words beyond ``LONG_WORD``
bytes leave no nodes behind, so a long run of letters does not fill the trie.
"""

from __future__ import annotations

import gc
import hashlib
import json
import math
import re
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import map_texts

MAX_NODES = 1_000_000
#: Bounds of the caches of a worker: pieces and words, and the characters that they have together.
MAX_PIECES = 400_000
MAX_WORDS = 400_000
MAX_CHARS = 8_000_000
MAX_PAIRS = 1_000_000
LONG_WORD = 256
#: Latin letters, of which every version of Unicode says the same.
NOT_LATIN = re.compile("[^\x00-\u024f]")
#: Marks that are a pre-token of their own at the end of a word.
MARKS = ".,;:!?"


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Merges:
    """Which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(pairs)}
        self.known: dict[int, bool] = {}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}

    def _edge(self, token: int, side: int, memo: dict) -> list:
        """The parts of ``token`` that touch its right (side 1) or left (0) end, each with the rank that uses it up."""
        if token not in memo:
            out, now = [], token
            while now in self.made:
                out.append((self.made[now][side], self.made[now][2]))
                now = self.made[now][side]
            memo[token] = out
        return memo[token]

    def merge_across(self, a: int, b: int, before: float) -> bool:
        """Whether a merge over the border of ``a`` and ``b`` comes before the parts at the border are used up."""
        rank = self.rank
        for x, until_x in ((a, before), *self._edge(a, 1, self.right)):
            for y, until_y in ((b, before), *self._edge(b, 0, self.left)):
                r = rank.get((x, y))
                if r is not None and r < until_x and (r <= until_y if y != b else r < until_y):
                    return True
        return False

    def apart(self, pair: int) -> bool:
        """Whether two tokens (packed as first << 20 | second) stay two tokens; remembered up to a fixed number."""
        if len(self.known) > MAX_PAIRS:
            self.known.clear()
        self.known[pair] = found = not self.merge_across(pair >> 20, pair & (1 << 20) - 1, math.inf)
        return found

    def whole(self, token: int, memo: dict[int, bool]) -> bool:
        """Whether the token's own text is encoded as this token."""
        if token not in self.made:
            return True
        if token not in memo:
            a, b, r = self.made[token]
            memo[token] = self.whole(a, memo) and self.whole(b, memo) and not self.merge_across(a, b, r)
        return memo[token]


class Trie:
    """``begin`` is the node where a node's last token begins; ``live`` the length of the longest suffix of its prefix
    that begins some token, which bounds the search for the last token of its children."""

    def __init__(self, vocab: dict[bytes, int], merges: Merges):
        memo: dict[int, bool] = {}
        self.merges = merges
        self.vocab = {t: i for t, i in vocab.items() if merges.whole(i, memo)}
        self.starts = {t[:n] for t in self.vocab for n in range(1, len(t) + 1)}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.begin, self.live = array("i", [-1]), array("i", [-1]), array("i", [0])

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each word; the words are inserted in sorted order, which is depth first."""
        if len(self.last) > MAX_NODES:
            self.clear()
        child, last, begin, live, vocab, starts = self.child, self.last, self.begin, self.live, self.vocab, self.starts
        known, apart = self.merges.known, self.merges.apart
        out: list[tuple[int, ...]] = [()] * len(words)
        path, before = [0], b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del path[same + 1 :]
            node, kept = path[-1], len(last)
            for i in range(same, len(word)):
                key = node << 8 | word[i]
                at = child.get(key)
                if at is None:
                    end = i + 1
                    start = i - live[node]
                    while word[start:end] not in starts:
                        start += 1
                    reach = end - start
                    while True:
                        token = vocab.get(word[start:end])
                        if token is not None:
                            if start == 0:
                                break
                            pair = last[path[start]] << 20 | token
                            fits = known.get(pair)
                            if fits or fits is None and apart(pair):
                                break
                        start += 1
                    at = child[key] = len(last)
                    last.append(token)
                    begin.append(path[start])
                    live.append(reach)
                path.append(at)
                node = at
            tokens = []
            while node:
                tokens.append(last[node])
                node = begin[node]
            out[k] = tuple(tokens[::-1])
            before = word
            if len(word) > LONG_WORD:  # its new nodes go again
                fresh = next((i for i, x in enumerate(path) if x >= kept), len(path))
                for i in range(fresh, len(path)):
                    del child[path[i - 1] << 8 | word[i - 1]]
                del last[kept:], begin[kept:], live[kept:], path[fresh:]
                before = word[: fresh - 1]
        return out


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library (no normaliser, no dropout)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.to_byte = {ord(c): b for c, b in alphabet.items()}
        as_bytes = {t.translate(self.to_byte).encode("latin-1"): i for t, i in vocab.items()}
        self.trie = Trie(as_bytes, Merges(vocab, spec["model"]["merges"]))
        self.words: dict[bytes, tuple] = {}
        self.word_bytes = self.piece_chars = 0
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = re.compile(r"^\s| \s|\s$")
        self.border = re.compile(r" (?=\S)")
        self.bytes_of = {i: t for t, i in as_bytes.items()} | {i: t.encode() for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.first: dict[str, tuple] = {}
        self.later: dict[str, tuple] = {}

    def _ids(self, words: list[bytes]) -> None:
        """Put the ids of pre-tokens into ``words``; those it lacks go through the trie."""
        if len(self.words) > MAX_WORDS or self.word_bytes > MAX_CHARS:
            self.words.clear()
            self.word_bytes = 0
        if new := list(set(words) - self.words.keys()):
            self.words.update(zip(new, self.trie.encode(new), strict=True))
            self.word_bytes += sum(map(len, new))

    def _pre_tokens(self, text: str) -> list[bytes]:
        return [w.translate(self.to_byte).encode("latin-1") for w, _ in self.split(text)]

    def _learn(self, cache: dict[str, tuple], pieces: list[str], lead: str) -> None:
        """Each piece through the pattern on its own, behind ``lead``."""
        split = [self._pre_tokens(lead + p) for p in pieces]
        self._ids([w for ws in split for w in ws])
        for piece, ws in zip(pieces, split, strict=True):
            cache[piece] = tuple(chain.from_iterable(map(self.words.__getitem__, ws)))

    def _learn_later(self, pieces: set[str]) -> None:
        """Latin letters alone, or with one mark behind, have known pre-tokens; all others go to the pattern in one string:
        no piece of those holds a space, so each begins at a pre-token with a space."""
        latin = not NOT_LATIN.search("".join(pieces))
        plain = [p for p in pieces if p.isalpha()] if latin else []
        ended = [p for p in pieces if p[-1] in MARKS and p[:-1].isalpha()] if latin else []
        spaced_out = [p for p in pieces if " " in p]
        order = list(pieces.difference(plain, ended, spaced_out))
        self._learn(self.later, spaced_out, " ")
        spaced, cores = [b" " + p.encode() for p in plain], [b" " + p[:-1].encode() for p in ended]
        words = self._pre_tokens(" " + " ".join(order)) if order else []
        self._ids([*spaced, *cores, *words, *(m.encode() for m in MARKS)])
        ids = self.words.__getitem__
        self.later.update(zip(plain, map(ids, spaced), strict=True))
        marks = {m: ids(m.encode()) for m in MARKS}
        self.later.update((p, ids(c) + marks[p[-1]]) for p, c in zip(ended, cores, strict=True))
        at = [i for i, w in enumerate(words) if w[0] == 32] + [len(words)]
        for piece, lo, hi in zip(order, at, at[1:], strict=False):
            self.later[piece] = tuple(chain.from_iterable(map(ids, words[lo:hi])))

    def _segments(self, texts: list[str]) -> list[list]:
        """Each text as runs: an id of a special token, or a list of pieces of which all but the first follow a space.

        A space before a character that is no white space always begins a pre-token, whatever stands before it, so
        pieces encode alone; other white space stays at the end of the piece before.
        """
        out = []
        for text in texts:
            parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else (text,)
            out.append([self.special.get(p) if p in self.special else (self.border.split(p) if self.odd.search(p) else p.split(" ")) for p in parts if p])
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.first) + len(self.later) > MAX_PIECES or self.piece_chars > MAX_CHARS:
            self.first.clear()
            self.later.clear()
            self.piece_chars = 0
        runs = self._segments(texts)
        lists = [r for rs in runs for r in rs if isinstance(r, list)]
        if new := list({r[0] for r in lists} - self.first.keys()):
            self._learn(self.first, new, "")
            self.piece_chars += sum(map(len, new))
        if new := set().union(*(r[1:] for r in lists)) - self.later.keys():
            self._learn_later(new)
            self.piece_chars += sum(map(len, new))
        first, later = self.first.__getitem__, self.later.__getitem__
        return [list(chain.from_iterable((r,) if isinstance(r, int) else chain(first(r[0]), chain.from_iterable(map(later, r[1:]))) for r in rs)) for rs in runs]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process and file, so that later tasks find its trie filled."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
        gc.freeze()  # its tables stay for good; the collector need not walk them again and again
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded text equals the input).

    Null and empty texts have no tokens and the digests of nothing. Rows with null or repeated doc_id stay as they
    are; other columns are ignored. Very long texts are encoded whole; texts without a space are one piece.
    """

    def make():
        own = codec(path)

        def work(texts: list[str]) -> list:
            ids = own.encode(texts)
            decoded = [own.decode(x) for x in ids]
            return [
                [len(x) for x in ids],
                [hashlib.sha256(",".join(map(own.digits.__getitem__, x)).encode()).hexdigest() for x in ids],
                [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                [x == y for x, y in zip(texts, decoded, strict=True)],
            ]

        return work

    return map_texts(docs, ["doc_id"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean", make)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids array<int>; null and empty texts have no ids, other cases are as in ``encode_decode``."""

    def make():
        own = codec(path)
        return lambda texts: [pa.array(own.encode(texts), pa.list_(pa.int32()))]

    return map_texts(docs, ["doc_id"], "ids array<int>", make)
