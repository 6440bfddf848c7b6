"""Fill-in-the-middle, whitening and the n-gram join against brute force on small fixtures with odd rows."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import infill, jaccard, queries, whitening

SF = "/root/testdata/sf0.001"
LONG = "".join(f"line {i} é日\n" for i in range(40_000))
TEXTS = ["one\ntwo\nthree\nfour", None, "", "\n", "\n\n\n", "no line feed", "has <P> in it\nand more", "half a mark <\nS>\nand < P>\n", LONG, "one\ntwo\nthree\nfour", "a\r\nb\rc d\n\x0be", "<M", "tail\n"]
SCHEMA = "doc_id bigint, text string, n bigint, form string, output string, class string, gram string, root string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "f", "o", "c", "g", "r", "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "x\ny\nz", 2, "", "", "", "", "", "")], SCHEMA).repartition(3)


def cut(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if h[3] % 100 < spm else "psm", len(prefix), len(middle), out


@pytest.mark.parametrize("options", [{}, {"seed": 11, "percent": 60, "spm_percent": 20}])
def test_infill_against_lists(docs, options):
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter(cut(r.doc_id, r.text, options.get("seed", 7), options.get("percent", 100), options.get("spm_percent", 50)) for r in rows)
    made = infill.transform(docs, **options)
    assert collections.Counter(tuple(r) for r in made.collect()) == want
    back = made.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text"))
    assert collections.Counter(tuple(r) for r in back.collect()) == collections.Counter((r.doc_id, r.text or "") for r in rows)
    assert infill.transform(docs.limit(0)).count() == 0


def test_infill_forms_and_units_of_words(spark):
    rows = spark.createDataFrame([(i, f"alpha beta {i}\ngamma") for i in range(200)], "doc_id bigint, text string")
    assert {r.form for r in infill.transform(rows).select("form").distinct().collect()} == {"spm", "psm"}
    words = infill.transform(rows, pattern=r"\S+\s*")
    assert {r.n for r in words.collect()} == {4}
    assert words.filter(infill.restored(F.col("output"), F.col("form")) != F.concat(F.lit("alpha beta "), F.col("doc_id"), F.lit("\ngamma"))).count() == 0


def test_infill_holds_no_units(monkeypatch):
    class Counting:
        def __init__(self):
            self.live = 0

        def finditer(self, text):
            for m in re.finditer(infill.LINES, text):
                self.live += 1
                yield m
                self.live -= 1  # the next match is asked for only when this one has been let go

    pattern = Counting()
    text = "ab\n" * 1000
    assert infill.spots(text, pattern, 300, 700) == (1000, 900, 2100)
    assert pattern.live <= 1


def test_infill_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = duck.execute(queries.ORACLES["op11_infill"])
    names = [c[0] for c in result.description]
    got = queries.op11_infill(spark, SF)
    assert got.columns == names
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(result.fetchall())


VECTORS = "vec_id bigint, embedding array<double>, n string, component string, dims string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


def whitened(frame, k):
    rows = sorted(frame.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component))
    return rows, np.array([r.whitened for r in rows]).reshape(-1, k)


@pytest.mark.parametrize("spread", ["flat", "steep"])
def test_whitening_against_the_whole_covariance(spark, spread):
    rng = np.random.default_rng(3)
    c = rng.standard_normal((500, 48)) * (1.0 if spread == "flat" else 4.0 ** -np.arange(48).clip(0, 8)) @ np.linalg.qr(rng.standard_normal((48, 48)))[0] * 20
    odd = [(900, None), (901, [None] + [0.0] * 47), (902, [float("nan")] * 48), (903, [float("inf")] * 48), (904, [1.0] * 3), (905, []), (906, [1e300] * 48)]
    frame = whitening.whiten(vectors(spark, [*((i, v.tolist()) for i, v in enumerate(c)), *odd]).repartition(5))
    rows, w = whitened(frame, 32)
    x = np.floor(64 * c) + 1_000_000
    n, centred = len(x), x - x.mean(0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ u[:, ::-1][:, :32] / np.sqrt(e[::-1][:32])
    assert [r.vec_id for r in rows[::32]] == list(range(500)) and {r.n for r in rows} == {500}
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-6 if spread == "flat" else np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9
    assert np.allclose([r.explained for r in rows[:32]], e[::-1][:32] / e.sum(), rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    exact, sums = x.astype(int).astype(object), x.astype(int).sum(0).astype(object)
    assert [int(r.deviation) for r in rows[::32]] == [int(((n * v - sums) ** 2).sum()) for v in exact]


def test_whitening_stops_early_or_expands(spark):
    rng = np.random.default_rng(8)
    seen = []
    real = whitening._added

    def count(rows, dims, size, one):
        seen.append(size)
        return real(rows, dims, size, one)

    steep = rng.standard_normal((300, 40)) * 1000 * 8.0 ** -np.arange(40).clip(0, 6)
    flat = rng.standard_normal((300, 40)) * 10
    for data, whole in ((steep, False), (flat, True)):
        seen.clear()
        whitening._added = count
        try:
            model = whitening.fit(whitening.usable(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)])), most=4)
        finally:
            whitening._added = real
        assert (40 * 40 + 1 in seen) == whole
        assert model.error < 1e-9


def test_whitening_small_and_large(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.5]), (2, [0.5, 1.5])])).count() == 0  # copies have no variance
    two = whitening.whiten(vectors(spark, [(1, [0.0, 5.0]), (1, [0.0, 5.0]), (None, [1.0, 5.0])])).collect()
    assert [r.component for r in two] == [1, 1, 1] and sorted(abs(round(r.whitened, 9)) for r in two) == [0.707106781, 0.707106781, 1.414213562]
    assert {r.explained for r in two} == {1.0}
    big = [[2.0**40 + 3.0, 1.0], [-(2.0**40), 2.0], [7.0, 4.0]]  # squares beyond 64 bits
    x = [[int(64 * v) + 1_000_000 for v in row] for row in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    rows = whitening.whiten(vectors(spark, list(enumerate(big))), most=1).orderBy("vec_id").collect()
    assert [int(r.deviation) for r in rows] == [sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def grams(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k=4, percent=85):
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in members.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def corpus(seed=1):
    """Copies, chains of edited copies, a hot passage in a third of all texts, texts of hot passages alone, odd texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    passages = [fresh(60) for _ in range(4)]
    texts = [" ".join(fresh(int(rng.integers(1, 120)))) for _ in range(40)]
    texts += [" ".join([*passages[0], *fresh(int(rng.integers(0, 40)))]) for _ in range(60)]
    texts += [" ".join(passages[a] + passages[b] + fresh(3)) for a in range(4) for b in range(4) for _ in range(3)]
    for length in (5, 12, 40, 150):
        base = fresh(length)
        for _ in range(12):  # each copy differs from the one before
            base = list(base)
            base[int(rng.integers(0, length))] = "x" + str(rng.integers(0, 10**6))
            texts.append(" ".join(base))
    texts += [texts[0], texts[0].upper(), texts[45].replace(" ", " \n\t"), "", None, " \n", "one", "One", "one two", "one  two", "a b c d", "a b c d e", "ÀB c d e", "àb c d e", "x y z a b", "a b a b a b a b"]
    return [*enumerate(texts), (3, texts[3]), (5, "an id that comes twice with another text"), (None, texts[60]), (None, "no id and no partner at all here")]


@pytest.mark.parametrize("options", [{}, {"words_each": 2, "percent": 60}, {"words_each": 3, "percent": 100}])
def test_jaccard_against_all_pairs(spark, options):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "n", "c", "g", "r") for i, t in rows], "doc_id bigint, text string, n string, class string, grams string, root string").repartition(4)
    got = jaccard.similar(frame, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert collections.Counter(map(tuple, got.collect())) == brute(rows, options.get("words_each", 4), options.get("percent", 85))
    assert jaccard.similar(frame.limit(0)).count() == 0


def test_jaccard_large_groups_take_several_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):  # any two of these are further apart than the limit, but chains of them are not
        words = list(base)
        for k in range(i // 6):
            words[4 * k] = f"z{k}"
        words[-1 - i % 6] = f"e{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base[:40], *(f"q{rng.integers(0, 9)}" for _ in range(12))])) for i in range(60)]
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=80)
    assert collections.Counter(map(tuple, got.collect())) == brute(rows, percent=80)


def test_jaccard_compares_few_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Each is near the text that all come from, hardly any two are near each other: only sets whose parities are near are compared."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, 4, replace=False):
            words[at] = f"e{rng.integers(0, 3)}"
        rows.append((i, " ".join(words)))
    made, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert collections.Counter(map(tuple, got.collect())) == brute(rows)
    assert len(made) > 1 and sum(made[1:]) < 100


def test_parities_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 300, 3000):
        both, a, b = (np.unique(rng.integers(0, 1 << 64, k, np.uint64)) for k in (n, n // 7, n // 5))
        bits = [jaccard.parities(np.union1d(both, x)) for x in (a, b)]
        assert len(bits[0]) == jaccard.PLACES // 64
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(np.setxor1d(a, b))


def test_grams_do_not_depend_on_pieces(monkeypatch):
    texts = pa.array(["x" * 300 + " " + "y" * 900, None, "a b\x0bc\x0cd e f", "word " * 700, "", "Ünï çødé tëxt hère ok " * 40, "z" * 300 + " q r s"])
    whole = [x.tolist() for x in jaccard.gram_sets(texts, 4, jaccard._byte_values())]
    assert [len(x) for x in whole] == [len(grams(t, 4)) for t in texts.to_pylist()]
    monkeypatch.setattr(jaccard, "PIECE", 50)
    assert [x.tolist() for x in jaccard.gram_sets(texts, 4, jaccard._byte_values())] == whole
    assert [x.tolist() for x in jaccard.gram_sets(texts.slice(2, 3), 4, jaccard._byte_values())] == whole[2:5]
