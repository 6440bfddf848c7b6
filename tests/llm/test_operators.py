"""Small fixtures: nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import base64
import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomline.llm import ann, bpe, packing, quality, rangecoder, repetition, simhash, substring, tokens, toxicity, warc
from fathomline.llm.queries import tokenizer

BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
LONG = " ".join(f"word{i % 997} é{i}" for i in range(30_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog, twice over.\nAnother line of text stands here today.", None, "", " ", "\n\n x  y\t\n", "It's  a 'test' of <|endoftext|> marks and 日本語 text.", LONG,
    "The quick brown fox jumps over the lazy dog, twice over.", "aaaa " * 400, "The quick brown fox jumps over the lazy dog, twice over.\nAnother line of text stands here today.", "x\u0085y z \x1c q", "ÀÉ naïve café İ ΑΣ",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_tokens string, rank string, block string"


def rows():
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i != 4 else None, len(t or ""), "x", "y", "z", "w") for i, t in enumerate(TEXTS)]
    return [*out, out[0], (None, "A row without an id has some text of its own.", None, "s0", 1, "", "", "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(doc_id, text):
    return (-1 if doc_id is None else doc_id, text or "")


def test_bpe(docs, none):
    library = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    got = bpe.encode_decode(docs, BYTE)
    assert collections.Counter(tuple(r)[:4] for r in got.collect()) == want
    assert got.filter("round_trip").count() == len(rows())
    assert bpe.encode_decode(none, BYTE).count() == 0


def test_bpe_pairs_and_prefixes():
    library, own = Tokenizer.from_file(BYTE), bpe.Codec(BYTE)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aeiou thns'.!\n 019éß"), rng.integers(0, 60))) for _ in range(3000)]
    assert own.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_caches_pieces_and_not_whole_texts(monkeypatch):
    library, rng = Tokenizer.from_file(BYTE), np.random.default_rng(7)
    monkeypatch.setattr(bpe, "MAX_CHARS", 20_000)
    own = bpe.Codec(BYTE)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    most = 0
    for lo in range(0, 5000, 250):
        texts = [" ".join(rng.choice(words, 60)) + ("\n", " \n\n", "  ", "\t x\n")[k % 4] for k in range(250)]
        assert own.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
        most = max(most, sum(map(len, own.first)) + sum(map(len, own.later)))
    assert most < 20_000 + 30_000  # the bound and one batch's pieces; the texts have 1.8 million characters
    long = ["q" * 40_000, "ab" * 20_000 + " tail", "é" * 9000 + "\n", "  \n " * 3000 + "x"]
    nodes = len(own.trie.last)
    assert own.encode(long) == [library.encode(t, add_special_tokens=False).ids for t in long]
    assert len(own.trie.last) < nodes + 200 and len(own.trie.child) == len(own.trie.last) - 1
    assert own.encode(["q" * 300, "q" * 30]) == [library.encode(t, add_special_tokens=False).ids for t in ("q" * 300, "q" * 30)]


def test_bpe_tokenize(docs, none):
    library = Tokenizer.from_file(BYTE)
    want = collections.Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in bpe.tokenize(docs, BYTE).collect()) == want
    assert bpe.tokenize(none, BYTE).count() == 0


def test_packing(docs, none):
    library = Tokenizer.from_file(BYTE)
    got = [r for r in packing.pack(docs, BYTE, window=64).collect() if r.doc_id not in (0, None)]
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(range(1, len(TEXTS)))
    for i, pieces in by_doc.items():
        ids = np.array(library.encode(TEXTS[i] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert packing.pack(none, BYTE).count() == 0


def round_robin(docs, weights, window):
    """Sequential deficit round-robin: (doc, start, length, sequence, offset) of every piece, in order.

    ``docs`` are (doc, source, tokens) in queue order, ``weights`` by source in the order in which queues are served.
    """
    queues = {s: collections.deque() for s in weights}
    for doc, source, n in docs:
        queues[source].extend((doc, lo, min(window, n - lo)) for lo in range(0, n, window))
    whole = sum(weights.values())
    quota = {s: max(1, int(float(window << 16) * w / whole)) for s, w in weights.items()}
    deficit, stream = dict.fromkeys(weights, 0), []
    while any(queues.values()):
        for s, queue in queues.items():
            deficit[s] += quota[s]
            while queue and queue[0][2] << 16 <= deficit[s]:
                deficit[s] -= queue[0][2] << 16
                stream.append(queue.popleft())
    out, at = [], 0
    for doc, start, n in stream:
        while n:
            size = min(n, window - at % window)
            out.append((doc, start, size, at // window, at % window))
            start, n, at = start + size, n - size, at + size
    return out


def test_packing_equals_sequential_round_robin(spark):
    library = Tokenizer.from_file(BYTE)
    data = [(i, f"word number {i} " * (i * 37 % 61), None if i % 9 == 0 else "big" if i % 3 else "small") for i in range(700)]
    some = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    counts = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in data}
    total = collections.Counter()
    for i, _, s in data:
        total[s] += counts[i]
    for targets in (None, {"big": 0.2, "small": 0.7}):
        weights = {s: (targets or {}).get(s, total[s] / sum(total.values())) for s in (None, "big", "small")}
        want = round_robin([(i, s, counts[i]) for i, _, s in data], weights, 128)
        got = packing.pack(some, BYTE, window=128, targets=targets).collect()
        assert sorted((r.sequence_id, r.offset, r.doc_id, r.start, r.length) for r in got) == [(q, o, d, s, n) for d, s, n, q, o in want]
        whole = sum(weights.values())
        sent, at = collections.Counter(), 0
        for d, _, n, _, _ in want[: len(want) // 3]:
            sent[data[d][2]] += n
            at += n
        assert all(abs(sent[s] - at * w / whole) < 3 * 128 for s, w in weights.items())
    with pytest.raises(ValueError):
        packing.pack(some, BYTE, targets={"big": 0.0})


def test_packing_keeps_documents_long_and_blocks_exact(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(packing, "BLOCK_ROUNDS", 2)
    some = spark.createDataFrame([(i if i % 5 else None, "some text " * (i % 90), f"s{i % 20}") for i in range(1500)], "doc_id long, text string, source string")
    pieces = packing.pack(some, BYTE, window=256).toPandas()
    windows = pieces.sort_values("offset").groupby("sequence_id")
    assert all((g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() for _, g in windows)
    sizes = windows.length.sum().sort_index()
    assert (sizes.iloc[:-1] == 256).all() and list(sizes.index) == list(range(len(sizes)))
    library = Tokenizer.from_file(BYTE)
    tokens = [len(library.encode("some text " * n, add_special_tokens=False).ids) + 1 for n in range(90)]
    assert pieces.length.sum() == sum(tokens[i % 90] for i in range(1500))
    assert len(pieces) < 1.6 * 1500


def test_packing_gives_every_source_its_own_queue(spark):
    some = spark.createDataFrame([(i, "some text " * (i % 9), f"s{i % 600}") for i in range(3000)], "doc_id long, text string, source string")
    targets = {"s0": 0.4, "s599": 0.4}
    pieces = packing.pack(some, BYTE, window=64, targets=targets).toPandas()
    assert pieces.doc_id.nunique() == 3000 and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    total = pieces.groupby("source").length.sum()
    rate = {s: pieces[pieces.source == s].sequence_id.max() + 1 for s in targets}
    assert all(rate[s] <= 2 + total[s] / 64 / 0.2 for s in targets)  # at 0.4 of about 1.8 a round


def test_warc_round_trip(spark):
    pages = [(1, "http://a/é b\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\x1f\x8b\x08" * 3), (0, "u", "<p>one</p>"), (0, "u", "<p>one</p>"), (None, "u", "no id")]
    frame = spark.createDataFrame([(*p, "extra", "x") for p in pages], "page_id long, url string, html string, refers_to string, sha string")
    got = sorted(map(tuple, warc.round_trip(frame).collect()), key=str)
    want = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        first = min(p for p, _, h in pages if p is not None and (h or "") == (html or "")) if page_id is not None else None
        revisit = page_id is not None and page_id != first
        want.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(frame.filter("false")).count() == 0


def test_warc_salvage():
    members = [warc.record(i, f"http://h/{i}", b"payload %d" % i * 50, None) for i in range(6)]
    plain = [zlib.decompress(m, 31) for m in members]
    for parts in (members, plain):
        whole = b"".join(parts)
        assert [r.headers["warc-record-id"] for r in warc.salvage(whole)] == [f"<urn:page:{i}>" for i in range(6)]
        at = len(parts[0]) + len(parts[1]) + len(parts[2]) // 2
        for damaged in (whole[:at] + b"\0\0\0\0" + whole[at + 4 :], whole[:at] + whole[at + 30 :]):
            found = list(warc.salvage(damaged))
            ids = [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)]
            gaps = [x for x in found if isinstance(x, warc.Gap)]
            assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
            assert [g.offset for g in gaps] == [len(parts[0]) + len(parts[1])] and gaps[0].reason
            assert sum(x.length for x in found) == len(damaged)
        cut = list(warc.salvage(whole[:-5]))
        assert isinstance(cut[-1], warc.Gap) and len(cut) == 6
    assert list(warc.salvage(b"")) == [] and isinstance(next(warc.salvage(b"junk")), warc.Gap)


def test_warc_reads_in_proportion_to_its_bytes():
    import time

    rng = np.random.default_rng(8)
    some = [warc.record(i, f"http://h/{i}", rng.bytes(1000), None) for i in range(2048)]
    seconds = []
    for times in (1, 8):
        data = b"".join(some) * times
        start = time.process_time()
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(data)) == 2048 * times
        seconds.append(time.process_time() - start)
    assert len(data) > 16 << 20 and seconds[1] < 24 * seconds[0] + 0.2  # eight times the bytes; the whole rest of the file a record took 60 times as long


def test_warc_long_payloads_and_damage(spark):
    long = "<p>é" * 700_000
    frame = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(frame).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == len(long.encode()) and got[2].refers_to == 1 and got[3].payload_bytes == 0
    first = warc.record(1, "u", np.random.default_rng(1).bytes(3_000_000), None)
    whole, at = first + warc.record(2, "u", b"x", None), len(first) // 2
    assert [type(x) for x in warc.salvage(whole[:at] + b"\0\0\0\0" + whole[at + 4 :])] == [warc.Gap, warc.Record]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_repetition(docs, none):
    got = {key(r.doc_id, ""): r for r in repetition.repetition(docs).collect()}
    for doc_id, text, *_ in rows():
        words = words_of(text)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, seen = 0, set()
        for line in (text or "").split("\n"):
            if words_of(line):
                lines += line in seen
                seen.add(line)
        r = got[key(doc_id, "")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(marked))
        assert r.base_failed == (len(words) < 20 or 100 * len(marked) > 30 * len(words)) and (not r.kept or not r.base_failed)
    assert repetition.repetition(none).count() == 0
    rng = np.random.default_rng(2)
    for text in (" ".join(rng.choice(list("abcd"), 120)), " ".join(f"w{i % 31}" for i in range(100)), "one two\n" * 30, "x " * 40, *TEXTS):
        words, rules = words_of(text), repetition.Rules()
        excess = 0.0
        for n, share in rules.grams:
            first, marked = set(), set()
            for i in range(len(words) - n + 1):
                window = tuple(words[i : i + n])
                marked |= set(range(i, i + n)) if window in first else set()
                first.add(window)
            excess = max(excess, sum(len(words[i]) for i in marked) / max(1, sum(map(len, words))) - share)
        measured = repetition.measure(text or "")
        assert abs(measured[8] - excess) < 1e-12 and measured[6] == (not measured[5] and excess <= 0 and measured[7] <= rules.lines)
    fresh = " ".join(f"w{i}" for i in range(100))
    assert repetition.measure(fresh)[6] and not repetition.measure(" ".join([fresh[:200]] * 3 + [fresh]))[6]


def brute_units(text):
    """(normalised unit, begin, end) of paragraphs, runs of short lines, lines and sentences, by begin, longer ones first."""
    def enough(a, b):
        return len(text[a:b].split()) >= substring.MIN_WORDS or sum("\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" for c in text[a:b]) >= substring.MIN_UNSPACED

    paragraphs, base = [[]], 0
    for line in text.split("\n"):
        body = line.strip()
        if body:
            at = base + len(line) - len(line.lstrip())
            paragraphs[-1].append((at, at + len(body)))
        elif paragraphs[-1]:
            paragraphs.append([])
        base += len(line) + 1
    spans = set()
    for lines in filter(None, paragraphs):
        spans.add((lines[0][0], lines[-1][1]))
        run = []
        for a, b in [*lines, (0, 0)]:
            if a < b and not enough(a, b):
                run.append((a, b))
                continue
            if run:
                spans.add((run[0][0], run[-1][1]))
            run = []
            if a < b:
                spans.add((a, b))
                at = a
                for m in re.finditer(r"[.!?。！？](\s+)|[。！？](?=[^\s。！？])", text[a:b]):
                    spans.add((at, a + m.start() + 1))
                    at = a + m.end()
                spans.add((at, b))
    return [(" ".join(text[a:b].lower().split()), a, b) for a, b in sorted(spans, key=lambda s: (s[0], -s[1])) if enough(a, b)]


def brute_removed(doc_id, text, first):
    """Spans that go; ``first`` maps units to the documents that keep them and grows."""
    here, removed = set(), []
    for unit, a, b in brute_units(text):
        if unit in here or first.setdefault(unit, doc_id) != doc_id:
            if not removed or a >= removed[-1][1]:
                removed.append((a, b))
        here.add(unit)
    return removed


def test_substring(spark, docs, none):
    own = docs.dropDuplicates(["doc_id", "text"])
    got = {r.doc_id: r for r in substring.dedup(own).collect()}
    first, texts = {}, {r[0]: r[1] for r in rows()}
    for doc_id in sorted(texts, key=lambda x: (x is None, x)):
        removed = brute_removed(doc_id, texts[doc_id] or "", first)
        r = got[doc_id]
        assert [(s.begin, s.end) for s in r.removed_spans] == removed, doc_id
        if not removed:
            assert r.text == texts[doc_id]
        else:
            kept = "".join(c for i, c in enumerate(texts[doc_id]) if not any(a <= i < b for a, b in removed))
            assert r.text.replace("\n", "").replace(" ", "") == kept.replace("\n", "").replace(" ", "")
    short = "One two. Three four five. Six seven. Eight."
    spans = {r.doc_id: [(s.begin, s.end, s.kept_in) for s in r.removed_spans] for r in substring.dedup(spark.createDataFrame([(1, f"{short}\nown words"), (2, f"a\n  {short} \nb"), (3, short + " And more.")], "doc_id long, text string")).collect()}
    assert spans == {1: [], 2: [(4, 4 + len(short), 1)], 3: []}
    verse = "\n".join("Rose is a rose number".split())
    thai, han = "ก" * 40, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏。"
    rows_of = [(1, f"intro words\n\n{verse}\n more\n\nend"), (2, f"{verse}\n more"), (3, f"A line of six words or more.\n{verse}\nAnother line of six words, or more."), (4, thai), (5, f"x {thai}\n{thai}"), (6, han + han), (7, f"开头。{han}结尾。")]
    spans = {r.doc_id: [r.text[:0] + dict(rows_of)[r.doc_id][s.begin : s.end] for s in r.removed_spans] for r in substring.dedup(spark.createDataFrame(rows_of, "doc_id long, text string")).collect()}
    assert spans == {1: [], 2: [f"{verse}\n more"], 3: [], 4: [], 5: [thai], 6: [han], 7: [han]}
    assert substring.dedup(none).count() == 0 and substring.dedup(none).columns == [*none.columns, "removed_spans"]
    assert substring.dedup(docs).count() == len(rows())


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[7]
    data = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    odd = [(2000, None, 1, ""), (2001, [0.0] * 16, 1, ""), (2002, [float("nan")] * 16, 1, ""), (2003, [None] * 16, 1, ""), (2020, [1.0] * 3, 1, ""), (None, [1.0] * 16, 1, "")]
    frame = spark.createDataFrame(data + odd + data[:3], "vec_id long, embedding array<float>, class int, list string")
    got = collections.defaultdict(list)
    for r in ann.search(frame).collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 1500, 20))
    hits, d = 0, x.astype(float)
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and len({r.vec_id for r in found}) == 20 and q not in {r.vec_id for r in found}
        scores = d @ d[q]
        assert all(abs(scores[r.vec_id] - r.score) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        scores[q] = -np.inf
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(1500), -np.round(scores, 9)))[:20].tolist()))
    assert hits / (20 * len(got)) > 0.9
    assert ann.search(frame.filter("false")).count() == 0
    assert {(r.query_id, r.vec_id) for r in ann.search(frame.filter("vec_id < 3")).collect()} == {(0, 1), (0, 2)}


def test_ann_ids_with_several_vectors_and_large_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    x[5] *= 1e39
    x[6] *= 1e120
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, x[50].tolist()), (20, x[51].tolist()), (20, x[52].tolist()), (7, x[7].tolist())]
    for shuffled in (rows, rows[::-1]):
        frame = spark.createDataFrame(shuffled, "vec_id long, embedding array<double>").repartition(3)
        got = collections.defaultdict(list)
        for r in ann.search(frame, every=20).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        own = {r.vec_id: np.array(r.v) for r in frame.selectExpr("vec_id", "struct(xxhash64(embedding) AS h, embedding) AS s").groupBy("vec_id").agg(F.min("s.h").alias("h"), F.min_by("s.embedding", "s.h").alias("v")).collect()}
        assert set(got) == set(range(0, 300, 20))
        for q, found in got.items():
            want = sorted(((-float(sum(own[q][d] * own[i][d] for d in range(8))), i) for i in own if i != q))[:20]
            assert [v for _, v, _ in sorted(found)] == [i for _, i in want]


def check_exact_neighbours(spark, x, every):
    """The search gives the true 20 best scores of each query, with smaller ids first among equal scores."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.search(frame, every=every).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), every))
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        want = np.sort(scores)[::-1][:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        assert np.allclose([s for _, _, s in sorted(found)], want, rtol=0, atol=1e-12), q
        assert np.allclose([scores[v] for _, v, _ in sorted(found)], want, rtol=0, atol=1e-12), q


def test_ann_searches_every_list_that_may_matter(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 1024)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 64))
    check_exact_neighbours(spark, x / np.linalg.norm(x, axis=1, keepdims=True), 40)


def test_ann_keeps_the_best_of_near_copies():
    rng = np.random.default_rng(6)
    center = rng.normal(size=64) / 8
    x = np.concatenate([rng.normal(size=(3000, 64)) / 8, center + rng.normal(size=(3000, 64)) / 1600])
    index = ann.fit(x[:3100], 50)  # few of the copies are in the sample
    lists = index.assign(x.astype(np.float32))
    codes = index.encode(x.astype(np.float32), lists)
    error = np.linalg.norm(x - index.decode(codes, lists), axis=1)
    names = rng.permutation(len(x))
    cut = 0
    for q in x[3000::100]:
        near = index.scores(q[None], codes, lists)[0].astype(float)
        want = np.sort(x @ q)[::-1][:21]
        for floor in (-np.inf, want[-1]):
            rows, score = ann.best_rows(q, near, (error + 1e-4) * np.linalg.norm(q), floor - 1e-12, x, names, 21)
            assert np.allclose(score, want, rtol=0, atol=1e-12) and np.allclose(x[rows] @ q, want, rtol=0, atol=1e-12)
        cut += len(set(rows) - set(np.argpartition(-near, 199)[:200]))
    assert cut > 0  # 200 rows by PQ score would have lost some


def test_ann_bounds_skip_lists_of_separate_clusters():
    rng = np.random.default_rng(5)
    centroids = rng.normal(size=(40, 16)) * 9
    x = np.repeat(centroids, 50, axis=0) + rng.normal(size=(2000, 16)) / 9
    radius = np.linalg.norm(x - np.repeat(centroids, 50, axis=0), axis=1).reshape(40, 50).max(1)
    scores = x @ x.T
    floor = np.sort(scores, axis=1)[:, -21]
    reached = ann.reaching(x, floor, centroids, radius)
    holding = (scores >= floor[:, None]).reshape(2000, 40, 50).any(2)
    assert reached[holding].all() and reached.mean() < 0.2
    group, blocks = ann.grouped(centroids, [50] * 39 + [1000], 200)
    assert len(group) == 40 and set(group) == set(range(len(blocks))) and blocks[group[39]] == 5


@pytest.mark.parametrize("n", [0, 1, 33, 4096, 9000])
def test_rangecoder_blocks(n):
    rng = np.random.default_rng(n)
    for ids in (np.full(n, 65535), rng.zipf(1.3, n) % 5000, rng.integers(0, 1 << 32, n), np.arange(n) * 70_001 % 90_001):
        ids = ids.astype(np.uint32)
        data = rangecoder.pack_file([3, None], [n, 0], ids)
        names, lengths, back = rangecoder.unpack_file(data)
        assert names == [3, None] and lengths.tolist() == [n, 0] and (back == ids).all()
    assert len(rangecoder.encode_blocks(np.zeros(4096, np.int32), 1)[0]) < 100
    if n > 4096:
        for at in (5, len(data) - 3):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                rangecoder.unpack_file(bytes(broken))


def test_rangecoder_beats_order_0_and_zlib():
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet") if os.path.isdir("/root/testdata/sf0.01") else pytest.skip("tables are not here")
    encoded = Tokenizer.from_file(WORD).encode_batch_fast(table.column("text").to_pylist()[:300], add_special_tokens=False)
    ids = np.concatenate([e.ids for e in encoded]).astype(np.uint32)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = 8 * len(rangecoder.pack_file([1], [len(ids)], ids)) / len(ids)
    assert bits < -(share * np.log2(share)).sum() and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes())) / len(ids)


def test_rangecoder_order_0_learns_what_occurs_together():
    """Two languages, each id as frequent as any other of its language: only what is near tells which ids come."""
    rng = np.random.default_rng(7)
    ids = (rng.integers(0, 300, 400 * 1000) + np.repeat(np.arange(400) % 2 * 300, 1000)).astype(np.uint32)
    data = rangecoder.pack_file([1], [len(ids)], ids)
    assert (rangecoder.unpack_file(data)[2] == ids).all()
    assert 8 * len(data) / len(ids) < np.log2(600)  # what ids cost if all are alike


@pytest.mark.parametrize("symbols", [1, 200, 8192, 8193, 70_000])
def test_rangecoder_lines(symbols):
    """Classes and tables of files with few and many ids, one of which is most of the file, in parts of several sizes."""
    rng = np.random.default_rng(symbols)
    ids = np.concatenate([np.arange(symbols), np.where(rng.random(30_000) < 0.9, symbols - 1, rng.integers(0, symbols, 30_000))]).astype(np.uint32)
    line, order = rangecoder.Line.made_of(np.bincount(ids), np.arange(symbols) % rangecoder.GROUPS)
    assert sorted(order) == list(range(symbols)) and len(line.ends) <= rangecoder.CLASSES and line.mass.max() < 1 << 20
    assert (rangecoder.unpack_file(rangecoder.pack_file([1], [len(ids)], ids))[2] == ids).all()


def test_piece_cache_keeps_what_came_first(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 60)
    monkeypatch.setattr(tokens, "KEEP", 40, raising=False)
    monkeypatch.setattr(tokens, "RENEW", 3, raising=False)
    own, library, kept, cuts = tokens.PieceEncoder(WORD), Tokenizer.from_file(WORD), [], []
    for k in range(12):
        texts = [f"the first words stay w{k}x{j} an'd Word{j}.\u0085É{k}  " for j in range(9)] + ["", " \n", f"a{k}\x1cb <unk>"[: 4 + 9 * (k % 2)]]
        ids, edges = own.encode(texts)
        cuts.append(own.cuts)
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        kept.append("the" in own.first and f"w{k}x0" in own.first and len(own.begin) == len(own.size) == len(own.first) and own.chars == sum(map(len, own.first)))
    assert all(kept) and 0 < max(cuts) <= 3


def test_split_words_is_that_of_python():
    odd = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    texts = [f"a{c}b{c}{c}" for c in odd] + ["", odd, "one", " x y  x "]
    words, order, edges = tokens.split_words(texts)
    assert [[words[k] for k in order[a:b]] for a, b in zip(edges, edges[1:], strict=False)] == [t.split() for t in texts]


def test_rangecoder(docs, none):
    library = Tokenizer.from_file(WORD)
    got = sorted(rangecoder.round_trip(docs, WORD).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc_id, text, *_) in zip(got, sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert rangecoder.round_trip(none, WORD).count() == 0


def test_rangecoder_files_of_lost_attempts(docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = rangecoder.write_files(docs, WORD, folder)
    good = sorted(map(str, rangecoder.read_files(docs.sparkSession, folder, manifest).collect()))
    files = sorted((tmp_path / "ids").glob("*.ids"))
    (tmp_path / "ids" / "left-behind.ids").write_bytes(files[0].read_bytes()[:40])
    assert sorted(map(str, rangecoder.read_files(docs.sparkSession, folder, manifest).collect())) == good
    files[0].write_bytes(files[0].read_bytes()[:-1])
    with pytest.raises(Exception, match="checksum"):
        rangecoder.read_files(docs.sparkSession, folder, manifest).collect()


def test_rangecoder_knows_where_files_begin_before_it_reads_them(docs, tmp_path):
    """Else small tasks wait behind those that read files: with 6 GB of documents for 300 seconds."""
    manifest = rangecoder.write_files(docs, WORD, f"file://{tmp_path}/ids")
    read = rangecoder.read_files(docs.sparkSession, f"file://{tmp_path}/ids", manifest)
    assert read.agg({"n_tokens": "sum"}).first()[0] == manifest.agg({"ids": "sum"}).first()[0]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def brute_fingerprint(text):
    import xxhash

    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(bits):
    """{fingerprint: set of linked fingerprints}, by brute force."""
    left, out = set(bits), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        out |= dict.fromkeys(seen, seen)
    return out


def test_simhash(docs, none):
    bits = {r[0]: brute_fingerprint(r[1]) for r in rows()}
    groups = components(bits.values())
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint == f"{bits[r.doc_id]:016x}"
        ids = [d for d, b in bits.items() if d is not None and b in groups[bits[r.doc_id]]]
        assert r.component_id == min(ids, default=None)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_representatives(spark, docs, none):
    extra = spark.createDataFrame([(None, "Some other text that has no id.", None, None, None, "x", "y", "z", "w"), (None, None, None, None, None, "a", "b", "c", "d"), (1, "A text that shares its id with a null one.", "en", "s", 3, "", "", "", "")], SCHEMA)
    both = docs.union(extra)
    got = sorted(map(tuple, simhash.representatives(both).collect()), key=str)
    everything = [tuple(r) for r in both.collect()]
    bits = {r[1]: brute_fingerprint(r[1]) for r in everything}
    linked = components(bits.values())
    roots = collections.defaultdict(list)
    for r in everything:
        roots[min(linked[bits[r[1]]])].append(r)
    assert len(got) == len(roots) and {min(linked[bits[r[1]]]) for r in got} == set(roots)
    for r in got:
        ids = [x[0] for x in roots[min(linked[bits[r[1]]])]]
        assert r in everything and r[0] == min((i for i in ids if i is not None), default=None)
    assert sorted(map(tuple, simhash.representatives(both.repartition(7)).collect()), key=str) == got
    assert simhash.representatives(none).count() == 0 and simhash.representatives(none).columns == none.columns


@pytest.mark.parametrize("group", [2, 64])
@pytest.mark.parametrize("distance", [0, 1, 2])
def test_simhash_links_large_groups_exactly(spark, monkeypatch, group, distance):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(group + distance)
    bits = {int(b) for b in rng.integers(-(2**63), 2**63 - 1, 40)}
    for b in list(bits)[:20]:
        for _ in range(12):
            flips = sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 4), replace=False))
            bits.add(b ^ flips)
    frame = spark.createDataFrame([(b,) for b in bits], "bits long")
    found = simhash.links(frame, distance).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= max(distance, 0) for r in found)
    near = lambda b: {c for c in bits if ((b ^ c) & mask).bit_count() <= distance}
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(found, "a long, b long")).collect()} if found else {}
    left = set(bits)
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            more = near(x) & left
            left -= more
            todo += more
        assert {roots.get(x, x) for x in seen} == {min(seen)}


def labelled(spark):
    rng = np.random.default_rng(9)
    syllables = ["ba", "co", "du", "fe", "gi", "la", "mo", "nu", "pe", "ri", "sa", "to"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    docs, labels = [], []
    for i in range(1200):
        words = [word() for _ in range(int(rng.integers(20, 120)))]
        toxic, bad = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                words[int(rng.integers(len(words)))] = str(rng.choice(["wretchling", "vermin", "dimwit", "lowlife"]))
        lines = [" ".join(words[j : j + 9]) + "." for j in range(0, len(words), 9)]
        if bad:
            lines = [line.upper().replace(" ", "!! ") if i % 2 else line.replace(" ", "*** ") for line in lines]
        docs.append((i, "\n".join(lines), "en"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame([*docs, (None, "x", None), (5000, None, None), (5001, "", None)], "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark):
    docs, table, labels = labelled(spark)
    for module, column, index, divisor, held in ((quality, "quality", 1, 3, 1), (toxicity, "toxic", 2, 5, 0)):
        got = {r.doc_id: r for r in module.score(docs, module.train(docs, table)).collect()}
        assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held) for r in got.values() if r.doc_id is not None)
        tested = [(got[x[0]].predicted, x[index]) for x in labels if got[x[0]].held_out]
        assert sum(a == b for a, b in tested) / len(tested) > 0.95, column
        assert got[5000].score == got[5001].score
        assert module.score(docs.filter("false"), module.train(docs.filter("false"), table.filter("false"))).count() == 0
        one = module.train(docs, table.filter(f"{column} = 1"))
        assert {r.predicted for r in module.score(docs, one).collect()} == {1}


def naive_line(line, seen):
    """The features of one line by itself, counted byte by byte."""
    raw = line.encode()
    count = lambda members: sum(b in members for b in raw)
    upper, lower = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"abcdefghijklmnopqrstuvwxyz")
    solid, letters, words = max(1, len(raw) - count(b" \t\r\x0b\x0c")), max(1, upper + lower), raw.split()
    mark, shout = count(b"#*$%&|<>") / solid, count(b"!?") / solid
    shares = [upper / letters, mark, count(b"|") / solid, shout, count(b".,;:") / solid, count(b"0123456789") / solid, sum(b > 127 for b in raw) / solid]
    return [*shares, mark**0.5, shout**0.5, len(set(words)) / len(words) if words else 1.0, min(solid / max(1, len(words)), 20) / 10, np.log1p(len(words)) / 4, not words, bool(line) and line in seen]


def test_quality_scores_equal_enumeration(spark):
    from itertools import product

    docs, table, _ = labelled(spark)
    model = quality.train(docs, table)
    texts = ["One line, that is all.", "Two lines:\n*** HERE!! ***", "a\n\na\nB4 | é\n", "", "x" * 400 + "\nshort"]
    got = model.scores(texts)
    for text, score in zip(texts, got, strict=True):
        lines = text.split("\n")
        own = [naive_line(x, lines[:i]) for i, x in enumerate(lines)]
        none = [0.0] * len(own[0])
        features = np.array([[*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), i == 0, i == len(own) - 1, 1.0] for i in range(len(own))], float)
        unary = (features - model.mean) / model.scale @ model.weights
        good, total = np.zeros(len(own)), 0.0
        for labels in product((0, 1), repeat=len(own)):
            weight = np.exp(sum(u * y for u, y in zip(unary, labels, strict=True)) + sum(model.trans[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            good += weight * np.array(labels)
            total += weight
        sizes = np.array([len(x.encode()) for x in lines]) + 1e-3
        share = np.clip((good / total * sizes).sum() / sizes.sum(), 1e-6, 1 - 1e-6)
        assert abs(score - 1 / (1 + np.exp(-(model.curve[0] * np.log(share / (1 - share)) + model.curve[1])))) < 1e-6


def test_classifiers_on_long_and_repeated_texts(spark):
    docs, table, labels = labelled(spark)
    some = "A wretchling spoke of vermin at length. " + LONG
    extra = spark.createDataFrame([(9000, some, "y"), (9000, some, "y"), (9001, "x\n" * 50_000, None), (None, some, None)], "doc_id long, text string, score string")
    for module in (quality, toxicity):
        model = module.train(docs, table)
        got = module.score(docs.limit(50).union(extra), model).collect()
        assert len(got) == 54 and len({r.score for r in got if r.doc_id == 9000 or r.doc_id is None and r.score != got[0].score} - {r.score for r in got[:50]}) <= 2
        alone = {r.score for r in module.score(extra.filter("doc_id = 9000"), model).collect()}
        assert len(alone) == 1 and alone == {r.score for r in got if r.doc_id == 9000}  # the same in any batch
        assert all(r.held_out is False for r in got if r.doc_id is None)


def test_toxicity_drops_equal_plain_compression():
    import zstandard

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(400)]
    say = lambda n: [str(w) for w in rng.choice(words, n)]
    ordinary = [" ".join(say(60)) for _ in range(300)]
    bad = [" ".join([*say(30), "wretchling", *say(15), "dimwit", *say(10)]) for _ in range(300)]
    plain, toxic = toxicity.train_dictionaries(bad, ordinary)
    assert b" wretchling " in toxic and b" dimwit " in toxic and b"wretchling" not in plain and toxic.endswith(plain)
    own = toxicity.Scorer(plain, toxic)
    settings = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda content, data: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress(data))
    for text in (*bad[:4], *ordinary[:4], "", "one"):
        want, ws = [], text.lower().encode().split()
        for n, step, filled in toxicity.WINDOWS:
            windows = [(plain[-toxicity.FILLER :] if filled else b" ") + b" ".join(ws[i : i + n]) + b" " for i in range(0, max(1, len(ws) - n + step), step)] if ws else []
            drops = sorted((size(plain, w) - size(toxic, w) for w in windows), reverse=True)
            want += [*(drops + [0] * toxicity.TOP)[: toxicity.TOP], sum(d > 3 for d in drops) / (1 + len(drops))]
        assert own.features(text)[:-1] == want
    many = [" ".join([f"slur{i:05d}x", *say(20)]) for i in range(3000)] * 3  # all chosen words are kept, whole
    chosen = toxicity.train_dictionaries([t + " " + " ".join(say(1)) + " " + t.split()[0] for t in many], ordinary, least=0)[1]
    assert all(f" slur{i:05d}x ".encode() in chosen for i in range(3000))


def test_crf_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    trans, lens = rng.normal(size=(2, 2)), np.array([1, 4, 3])
    unary = rng.normal(size=8)
    got, at = quality.marginals(unary, lens, trans), 0
    for n in lens:
        total, good = 0.0, np.zeros(n)
        for labels in product((0, 1), repeat=int(n)):
            weight = np.exp(sum(unary[at + i] * y for i, y in enumerate(labels)) + sum(trans[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            total += weight
            good += weight * np.array(labels)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_pieces_of_word_files_have_the_library_ids():
    import random

    own, library, rng = tokens.encoder(WORD), Tokenizer.from_file(WORD), random.Random(2)
    assert own.ended is not None
    for alphabet in ("aeiou tnrs'’.,!\n\t  ñéüßÅœ\x80\xa0\x85ȁ0123½²ªºŉǅİıſ日_-\x01\x1cĲABCZ'sS", "".join(map(chr, range(1, 0x250)))):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(4000)]
        texts += ["it's we'll they've I'd can't 's'S 'Ll", "", "a" * 3000, "<|startoftext|> hi <|endoftext|>"]
        ids, edges = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_whole_texts_have_the_library_ids():
    import random

    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    own, library, rng = tokens.encoder(path), Tokenizer.from_file(path), random.Random(5)
    assert isinstance(own, tokens.WholeEncoder)
    alphabet = "aeiou tnrs'’.,!\n\t  ñéüßÅœ\x80\xa0\x85ȁ0123½²日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(3000)]
    texts += ["", " " * 9000 + "a", "b" * 50_000, "x<|endoftext|>y", *(library.decode([i]) for i in range(0, 50256, 7))]
    ids, edges = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.encode([])[0].size == 0
