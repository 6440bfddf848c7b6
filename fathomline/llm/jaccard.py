"""Jaccard join of documents' word n-grams by prefix filters under several global orders.

Grams are 64-bit hashes, made for a whole batch of texts at once. Equal sets are one class from the start. Two sets A
and B with |A n B| >= t |A u B| leave at most ``spare(|A|)`` grams of A outside B, so

* a class that has more grams of its own than that among a fixed sample of its grams (a quarter, by hash) has no partner,
  and is out after one aggregation of the sample over the corpus;
* under any total order of grams, the first ``spare + 1`` of A and of B share a gram. Three orders are used: by document
  frequency, by its magnitude, and by hash alone, each with grams of one class first and ties broken by another hash.

Classes that share a gram of their first prefixes form a group. A group is never paired out: in the first round all are
compared with one of its members, and in each further round a few of them (``PIVOTS``, then eight times as many each time)
become pivots, are compared with all members of their groups that are not linked to them already, and are done. So a group of thousands of near copies, of
which a pivot links most, costs a few rows a member. From the
second round on a pair is made once by the heads of its prefixes, and not if more comes before the place where the two
meet than they may differ in, nor if the parities of their sets differ in more places than that: each gram flips one of
``PLACES`` bits of its set, so two sets' bits differ in no more places than the sets have grams apart, and for sets of
some hundred grams in hardly fewer. A pair goes on only if its second and third prefixes share a gram too, and is then verified on the whole sets.

What no class of another root has is a class's own. Each round counts own grams and makes the first prefixes anew, among
the classes left: those with more of their own than ``spare`` go, the others' prefixes have fewer grams that form groups,
and as partners together have few of their own, only classes with half of that become pivots. So thousands of texts that
share a long passage, each with some words of its own, are not compared with each other. Only texts made of the same
passages throughout and yet unlike are: they cost a comparison for each two.

Hashes decide: two different grams of one pair of texts have the same 64 bits with a chance of 2^-64, as have two sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import ranges, written
from fathomline.llm.simhash import components

#: The first round has one pivot in each group, the second so many.
PIVOTS = 8
#: Of two classes that share one of their first so many keys, the pair is made on the first such key alone.
HEAD = 6
#: Bits of a set's parities (a power of two, 64 at least).
PLACES = 512
#: One gram of so many (a power of two) is in the sample.
SAMPLE = 4
#: Bytes of text that are hashed at once, and the longest word in the table of byte values.
PIECE, LONGEST = 1 << 20, 256

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random number for each (place in a word, byte)."""
    return np.random.default_rng(20).integers(0, 1 << 64, (LONGEST, 256), np.uint64)


def word_hashes(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of lower-cased ``data``: sums of random numbers by place and byte, mixed with the length."""
    import xxhash

    held = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], held, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if start.size == 0:
        return np.zeros(0, np.uint64), start
    size = end - start
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    sums = np.add.reduceat(values[np.minimum(place, LONGEST - 1), data[held]], first)
    for k in np.flatnonzero(size > LONGEST):
        sums[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return _mixed(sums + size.astype(np.uint64) * _MIX[0]), start


def _combined(h: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` words."""
    n = h.size - length + 1
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out = _mixed(out * _MIX[0] + h[k : k + n])
    return out


def gram_sets(texts: pa.Array, words_each: int, values: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its distinct grams as sorted hashes (fewer words: the whole sequence; none or null: nothing)."""
    texts = pc.binary_join_element_wise(pc.cast(texts, pa.large_string()).fill_null(""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        lo, hi, hashes, starts = int(offsets[row]), int(offsets[last]), [], []
        while lo < hi:  # several pieces only for a single long text, cut behind a word
            cut = min(hi, lo + PIECE)
            while cut < hi and not _SPACE[data[cut]]:
                cut += 1
            h, s = word_hashes(_LOWER[data[lo:cut]], values)
            hashes.append(h)
            starts.append(s + lo)
            lo = cut
        h, s = np.concatenate(hashes), np.concatenate(starts)
        bounds = np.searchsorted(s, offsets[row : last + 1])
        whole = _combined(h, words_each) if h.size >= words_each else h
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(whole[a : b - words_each + 1]) if b - a >= words_each else _combined(h[a:b], int(b - a)) if b > a else h[:0]
        row = last


def _spare(percent: int) -> Column:
    """How many of a set's ``n`` grams a partner may lack: n less the smallest overlap."""
    return F.expr(f"n - ({percent} * n + 99) div 100")


def class_of(grams: np.ndarray) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(grams.tobytes()), "big", signed=True)


def _listed(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as a column of lists of signed ones."""
    ends = np.cumsum([0, *(x.size for x in arrays)])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def parities(grams: np.ndarray) -> np.ndarray:
    """For each of ``PLACES`` places, by the grams' highest bits, whether an odd number of grams falls there; 64 places a number."""
    places = np.bincount((grams >> np.uint64(65 - PLACES.bit_length())).astype(np.int64), minlength=PLACES)
    return np.packbits((places & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def sets(docs: DataFrame, words_each: int, sampled: bool) -> DataFrame:
    """Per row: doc_id, class (null without a gram), n, grams (those in the sample, or all of them and then their parities too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _byte_values()
        for batch in batches:
            for lo, hi in ranges(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                found = list(gram_sets(part.column("text"), words_each, values))
                held = [x[x & np.uint64(SAMPLE - 1) == 0] for x in found] if sampled else found
                more = [] if sampled else [_listed([parities(x) for x in found])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([class_of(x) if x.size else None for x in found], pa.int64()), pa.array([x.size for x in found], pa.int64()), _listed(held), *more],
                    names=["doc_id", "class", "n", "grams", "bits"][: 4 + len(more)],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, class bigint, n bigint, grams array<bigint>{'' if sampled else ', bits array<bigint>'}")


def shared_grams(rows: DataFrame) -> DataFrame:
    """(class, gram): the grams of ``rows`` (class, gram; repeats allowed) that another class has too, once each."""
    common = rows.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("gram")
    return rows.join(common, "gram").select("class", "gram").distinct()


def ranked(whole: DataFrame, percent: int) -> DataFrame:
    """(class, n, own, a, b, c): its grams that no other class of ``whole`` has, counted, and the grams in the prefixes under each order
    that others have too; classes without any are out."""
    rows = whole.select("class", F.explode("grams").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    shared = rows.join(counts, "gram").groupBy("class").agg(F.collect_list(F.struct("gram", "df")).alias("shared"))
    source = whole.select("class", "n").join(shared, "class").select("class", "n", F.col("shared.gram").alias("gram"), F.col("shared.df").alias("df"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k in range(batch.num_rows):
                n = batch.column("n")[k].as_py()
                gram = batch.column("gram").slice(k, 1).flatten().to_numpy().view(np.uint64)
                df = batch.column("df").slice(k, 1).flatten().to_numpy()
                room = n - (percent * n + 99) // 100 + 1 - (n - gram.size)  # grams of this class alone come first under every order
                if room <= 0:
                    continue
                orders = ((_mixed(gram ^ _MIX[0]), df), (_mixed(gram ^ _MIX[1]), np.frexp(df)[1]), (_mixed(gram ^ _MIX[2]), np.zeros_like(df)))
                for column, value in zip(out, (batch.column("class")[k].as_py(), n, n - gram.size, *(gram[np.lexsort(keys)[:room]] for keys in orders)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *map(_listed, out[3:])], names=["class", "n", "own", "a", "b", "c"])

    return source.mapInArrow(run, "class bigint, n bigint, own bigint, a array<bigint>, b array<bigint>, c array<bigint>")


def verified(pairs: DataFrame, prefixes: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are within the similarity; those whose second or third prefixes share nothing go first."""

    def beside(rows: DataFrame, table: DataFrame, *names: str) -> DataFrame:
        for side in ("a", "b"):
            rows = rows.join(table.select(F.col("class").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in names)), side)
        return rows

    near = beside(pairs, prefixes.select("class", F.col("b").alias("second"), F.col("c").alias("third")), "second", "third").filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    both = beside(near.select("a", "b"), whole, "n", "grams").withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))
    return both.filter(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b")


def _groups(classes: DataFrame) -> DataFrame:
    """A row for each key of ``classes`` (class, n, root, own, keys in their order, others).

    ``ahead`` is how many grams of the class come before the key: those of its own and earlier keys.
    """
    others = [c for c in classes.columns if c != "keys"]
    return classes.select(*others, F.posexplode("keys").alias("place", "key")).withColumn("ahead", F.col("own") + F.col("place")).drop("place")


def _apart(percent: int) -> Column:
    """Whether the parities of two sets allow a link: it leaves (100 - percent) of 100 + percent grams of both outside the overlap."""
    differ = " + ".join(f"bit_count(bits[{k}] ^ pivot_bits[{k}])" for k in range(PLACES // 64))
    return F.expr(f"{100 + percent} * ({differ}) <= {100 - percent} * (n + pivot_n)")


def keyed(classes: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(class, n, root, own, keys, head, bits): the first prefixes anew, for the classes (class, n, root) alone.

    Grams of one root come first, then rare ones; a class has ``own`` of the former, and the other ones in its prefix are
    keys, the first ``HEAD`` of them its head.
    """
    grams = whole.select("class", "grams").join(classes, "class").select("class", "n", "root", F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("df")).filter("low < high").select("gram", "df")
    order = F.array_sort(F.collect_list(F.struct("df", F.xxhash64("gram").alias("tie"), "gram")))
    found = grams.join(common, "gram").groupBy("class", "n", "root").agg(order.alias("shared")).withColumn("own", F.col("n") - F.size("shared"))
    left = found.filter(F.col("own") <= _spare(percent)).select("class", "n", "root", "own", F.slice("shared.gram", F.lit(1), (_spare(percent) + 1 - F.col("own")).cast("int")).alias("keys"))
    return left.withColumn("head", F.slice("keys", 1, HEAD)).join(whole.select("class", "bits"), "class")


def joined(prefixes: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all classes that have a link; ``prefixes`` and ``whole`` are written tables."""
    spark = whole.sparkSession
    links = spark.createDataFrame([], "a bigint, b bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    members = _groups(prefixes.select("class", "n", F.col("class").alias("root"), "own", F.col("a").alias("keys")))
    done, most, few = False, 1, PIVOTS
    rank = F.xxhash64("class")
    # two partners differ in at most (100 - percent) / percent of the smaller size: so one has half of that at most as own grams,
    # and no more than that comes before the first key on which they meet
    low, fits = f"{2 * percent} * own <= {100 - percent} * n", f"{percent} * (%s + pivot_%s) <= {100 - percent} * least(n, pivot_n)"
    while True:
        keys = members.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max(F.expr(low)).alias("any")).filter("least < most AND any").select("key")
        members = written(members.join(keys, "key"))
        if members.isEmpty():
            return roots
        first = Window.partitionBy("key").orderBy(rank, "class")
        top = members.filter(low).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)
        chosen = top.select("class").distinct()
        pivots = (members.join(chosen, "class", "left_semi") if done else top).select("key", *(F.col(c).alias(f"pivot_{c}") for c in members.columns if c != "key"))
        able = F.expr(f"root != pivot_root AND 100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)")
        met_before = F.get(F.array_intersect("head", "pivot_head"), 0) != F.col("key") if done else None  # they meet on an earlier key too
        able &= F.expr(fits % ("ahead", "ahead")) & _apart(percent) & F.coalesce(~met_before, F.lit(True)) if done else F.expr(fits % ("own", "own"))
        meet = members.join(pivots, "key").filter(able)
        pairs = meet.select(F.least("class", "pivot_class").alias("a"), F.greatest("class", "pivot_class").alias("b")).distinct()
        fresh = written(verified(pairs, prefixes, whole, percent))
        if not fresh.isEmpty():
            links = links.union(fresh)
            roots = components(links)
        rest = members.select("class", "n").distinct()
        rest = rest.join(chosen, "class", "left_anti") if done else rest
        members = _groups(keyed(rest.join(roots, rest["class"] == roots.node, "left").select("class", "n", F.coalesce("root", "class").alias("root")), whole, percent))
        done, most, few = True, few, 8 * few


def similar(docs: DataFrame, words_each: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable over links, itself included.

    Texts link when the Jaccard similarity of their sets of ``words_each``-word grams is ``percent`` / 100 or more; A-Z
    count as lower case, ASCII white space splits words. A text with fewer words is one gram; null, empty and blank texts
    have none and link with nothing, so their component is their own doc_id. Rows with a null doc_id link, but name a
    component only as null where no other row of it has an id. Repeated rows are returned as often as they occur.
    """
    rows = written(sets(docs, words_each, True))
    slim = rows.select("doc_id", "class", "n")
    classes = rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max(F.size("grams")).alias("sampled"))
    hits = shared_grams(rows.select("class", F.explode("grams").alias("gram"))).groupBy("class").agg(F.count("*").alias("hits"))
    left = written(classes.join(hits, "class", "left").withColumn("open", F.col("sampled") - F.coalesce("hits", F.lit(0)) <= _spare(percent)).drop("hits", "sampled"))
    again = left.filter("open").select(F.col("first").alias("doc_id")).distinct()
    source = docs.select("doc_id", "text").join(again, docs.doc_id.eqNullSafe(again.doc_id), "left_semi")
    whole = sets(source, words_each, False).join(left.filter("open").select("class"), "class", "left_semi").select("class", "n", "grams", "bits").dropDuplicates(["class"])
    whole = written(whole)
    roots = joined(written(ranked(whole, percent)), whole, percent)
    homes = left.join(roots, left["class"] == roots.node, "left").withColumn("root", F.coalesce("root", "class"))
    names = homes.join(homes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("class").alias("of"), "component_id")
    named = slim.filter("n > 0").join(names, F.col("class") == F.col("of")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = slim.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(alone)
