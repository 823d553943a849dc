"""Near-duplicate classes by Order MinHash and banded alignment.

A text's five-word shingles are labelled with their occurrence number, so that all are different.  For each of several
hash functions, the few smallest labelled shingles are taken and kept in text order; texts that agree in one such
sequence are candidates, likelier the less one must edit to turn one into the other.  Candidates are
verified by alignment: with ``m`` shingles matched in order, similarity is ``m / (a + b - m)``.

Links are single linkage: a class is a connected component of verified links.  Within a bucket no pairs are enumerated.
Exact copies stand behind one text.  A text's shingles that no other candidate has bound its similarity to all
others; texts that the bound rules out leave the bucket.  Of the rest, rounds take the text with the
best bound, verify it against those that are not yet in its class, and merge classes.  What the rounds leave open, texts
of different classes that still share a bucket, is joined under a bound from bit maps of their shingles: a pair is
verified only if so few bits are in one map alone that the similarity is possible.  No pair at or above the similarity
is ruled out by any of these bounds; a group of many near copies of a text costs one comparison a copy, and the pairs
on its fringe that are nearly similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, free_name, mix, shingle_hashes, slices, span_hashes, spans, stage, texts_of

SHINGLE, SIMILARITY = 5, 0.8
#: Hash functions, and shingles taken for each; short texts (see ``SHORT``) take fewer.
BANDS, TAKEN, TAKEN_SHORT = 24, 5, 2
#: Texts of up to the second number of shingles use short sequences, those from the first number on long ones: every similar pair shares a kind.
SHORT = (16, 25)
#: Rounds of one leader a bucket, before pairs that are still open meet; it changes the cost and no result.  64-bit words of a bit map.
ROUNDS = 2
MAP_WORDS = 16
#: Rows of a file of the tables that links make (a few numbers a row).
FILE_ROWS = 500_000
_ODD = mix(np.arange(1, 1 + 2 * BANDS, dtype=np.uint64)) | np.uint64(1)
_LOW, _HIGH, _MAX = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' occurrence-labelled shingles, and the number before each text."""
    b, e, first = spans(raw, at)
    h, before = shingle_hashes(span_hashes(raw, b, e), first, SHINGLE)
    if len(h):
        doc = np.repeat(np.arange(len(before) - 1, dtype=np.uint64), np.diff(before))
        with np.errstate(over="ignore"):
            key = mix(h + doc * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            if same.any():
                starts = np.flatnonzero(np.concatenate([[True], ~same]))
                n = np.arange(len(h)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(h)]])))
                occurrence = np.empty(len(h), np.uint64)
                occurrence[order] = n
                h = np.where(occurrence > 0, mix(h + occurrence * np.uint64(0xC2B2AE3D27D4EB4F)), h)
    return h, before


def sketch(h: np.ndarray, before: np.ndarray, taken: int, bands: np.ndarray) -> np.ndarray:
    """For each text (all have shingles) and hash function: a hash of the ``taken`` smallest shingles in text order."""
    starts, counts = before[:-1], np.diff(before)
    position = (np.arange(len(h)) - np.repeat(starts, counts)).astype(np.uint64)
    out = np.empty((len(starts), len(bands)), np.uint64)
    padded = np.concatenate([h, np.zeros(1, np.uint64)])
    with np.errstate(over="ignore"):
        for k, odd in enumerate(bands):
            v = (h * odd) & _HIGH | position
            chosen = np.empty((taken, len(starts)), np.int64)
            for j in range(taken):
                least = np.minimum.reduceat(v, starts)
                index = starts + (least & _LOW).astype(np.int64)
                index[least == _MAX] = len(h)  # none left
                chosen[j] = index
                v[index[index < len(h)]] = _MAX
            chosen.sort(axis=0)
            s = np.full(len(starts), np.uint64(k + 1))
            for row in chosen:
                s = mix(s * np.uint64(0xD6E8FEB86659FD93) + padded[row])
            out[:, k] = s
    return out


def matched(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence whose matches stay within ``band`` of the diagonal, by bit-parallel alignment."""
    begin, least = 0, min(len(a), len(b))
    while begin < least and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < least - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    done = begin + end
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return done
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, width = full, (1 << (2 * band + 1)) - 1
    for j, y in enumerate(b):
        if m := at.get(y):
            m &= width << (j - band) if j >= band else width >> (band - j)
            row = (row + (row & m)) | (row & ~m)
            row &= full
    return done + len(a) - row.bit_count()


def similarity(a: list[int], b: list[int], least: float = 0.0) -> float:
    """Matched shingles over all shingles; below ``least`` it may be reported too low, as only the band counts that ``least`` needs."""
    total = len(a) + len(b)
    if not total:
        return 0.0
    band = int(total * (1 - least) / (1 + least)) + 1
    if abs(len(a) - len(b)) > band:
        return 0.0
    m = matched(a, b, band)
    return m / (total - m)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n (shingles), bands (keys of its sequences) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, at = texts_of(part.column("text"))
            h, before = labelled(raw, at)
            n = np.diff(before)
            some = np.flatnonzero(n)
            keys: list = [[] for _ in range(len(n))]
            for rows, taken, odd, salt in ((some[n[some] <= SHORT[1]], TAKEN_SHORT, _ODD[BANDS:], 1), (some[n[some] >= SHORT[0]], TAKEN, _ODD[:BANDS], 2)):
                if len(rows):
                    pick = np.concatenate([np.arange(before[r], before[r + 1]) for r in rows])
                    found = mix(sketch(h[pick], np.concatenate([[0], np.cumsum(n[rows])]), taken, odd) + np.uint64(salt)).view(np.int64)
                    for r, line in zip(rows.tolist(), found):
                        keys[r] = line if not len(keys[r]) else np.concatenate([keys[r], line])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "bands"])

    return docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, digest binary, n long, bands array<long>")


def _shingles(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            h, before = labelled(*texts_of(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("rid"), lists], names=["rid", "shingles"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, shingles array<long>")


def bit_maps(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A bit map of MAP_WORDS words for each text: the bits that its shingles' hashes choose."""
    maps = np.zeros((len(before) - 1, MAP_WORDS * 8), np.uint8)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    bit = (mix(h) % np.uint64(MAP_WORDS * 64)).astype(np.int64)
    np.bitwise_or.at(maps, (doc, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return maps.view(np.int64)


def _maps(texts: DataFrame) -> DataFrame:
    """rid, rest (shingles that share a bit with another of the text), m0, m1, ... (the bit map) of rows (rid, text)."""
    names = [f"m{i}" for i in range(MAP_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            h, before = labelled(*texts_of(part.column("text")))
            maps = bit_maps(h, before)
            rest = np.diff(before) - np.bitwise_count(maps.view(np.uint64)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(rest, pa.int64()), *(pa.array(np.ascontiguousarray(maps[:, i])) for i in range(MAP_WORDS))], names=["rid", "rest", *names])

    return texts.select("rid", "text").mapInArrow(run, "rid long, rest long, " + ", ".join(f"{n} long" for n in names))


def _maps_may(least: float):
    """Whether the bit maps of sides x and y allow the similarity: a bit in one map alone stands for a shingle, at least, that the other lacks.

    At most ``least(x_rest, y_rest) + bits of both`` shingles are shared; written so that the expression stays small enough to be compiled.
    """
    both = F.bit_count(F.col("x_m0").bitwiseAND(F.col("y_m0")))
    for i in range(1, MAP_WORDS):
        both = both + F.bit_count(F.col(f"x_m{i}").bitwiseAND(F.col(f"y_m{i}")))
    return both >= (F.col("x_n") + F.col("y_n")) * (least / (1 + least)) - F.least("x_rest", "y_rest") - 1e-6


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    joined = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for part in slices(batches, "text_b"):
            out_a, out_b = [], []
            h, before = labelled(*texts_of(part.column("text_b")))
            for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist())):
                if known[0] != a:
                    known = (a, labelled(*texts_of(part.column("text_a").slice(i, 1)))[0].tolist())
                if similarity(known[1], h[before[i] : before[i + 1]].tolist(), least) >= least:
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node of the connected component.

    Each round, labels go along edges and then jump to their label's label; every round is a table in the shared folder, of
    few files if it is small.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    files = 1 + both.count() // FILE_ROWS
    label = written = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")).coalesce(files), "labels")
    while True:
        heard = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        new = label.join(heard, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        moved = stage(new.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")).coalesce(files), "labels")
        free(written)
        label, written = moved.select("node", "comp"), moved
        if moved.filter("old <> comp").isEmpty():
            free(both)
            return label


def _grouped(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, ...) of all documents; and of each different text its digest, smallest id, copies and component."""
    slim = stage(_sketches(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))), "sketches")
    # one row for each different text, with a number of its own
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    reps = stage(first.withColumn("rid", F.monotonically_increasing_id()), "texts")
    keyed = slim.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"), "bands").join(reps, (F.col("d") == F.col("digest")) & F.col("i").eqNullSafe(F.col("first"))).select("rid", "n", "bands")
    entries = stage(keyed.select("rid", "n", F.explode("bands").alias("k")).distinct(), "entries")
    shared = entries.groupBy("k").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo < hi").select("k")
    active = stage(entries.join(shared, "k"), "buckets")
    free(entries)
    links = _linked(active, reps, docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), least)
    named = reps.select("digest", "rid", "first", "copies").join(links, F.col("rid") == F.col("node"), "left").select("digest", "first", "copies", F.coalesce("comp", "rid").alias("comp"))
    free(active)
    return slim, named


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: its id, digest of its text, class_id (the smallest id of its class) and class_size.

    Defined cases: null and empty texts are copies of one another; a text of fewer than five words is one shingle;
    a text without words resembles only its exact copies; rows that repeat an id are members of their own; null ids are
    no class's name unless a class has no other; a very long text is sketched whole, in the memory of one slice; an empty
    table gives an empty result.  Only the id and text columns are read, so others may have any name.
    """
    slim, named = _grouped(docs, id_col, text_col, least)
    # classes are summed over different texts, and the sums dealt out anew: then Spark can split a join's hot keys, on both sides plain exchanges
    sizes = named.groupBy("comp").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size")).repartition("comp")
    of_text = stage(named.join(sizes, "comp").select("digest", "class_id", "class_size"), "classes")
    return slim.select(F.col("doc_id").alias(id_col), "digest").join(of_text, "digest").select(id_col, "digest", "class_id", "class_size")


def _linked(active: DataFrame, reps: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(node, comp) of all texts that verified links join to another."""
    spark = active.sparkSession
    wanted = active.select("rid").distinct().join(reps.select("rid", "digest", "first"), "rid")
    texts = (
        docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("d"), F.col("doc_id").alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .join(wanted, (F.col("d") == F.col("digest")) & F.col("i").eqNullSafe(F.col("first")))
        .select("rid", "text")
    )
    texts = stage(texts, "candidates")
    if active.isEmpty():
        return spark.createDataFrame([], "node long, comp long")
    # shingles that only one candidate has
    own = _shingles(texts).select("rid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("rid").alias("rid")).filter("c = 1").groupBy("rid").agg(F.count(F.lit(1)).alias("own"))
    bounded = active.join(own, "rid", "left").select("k", "rid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("u"))
    left = stage(_possible(bounded, least), "open")
    comp: DataFrame | None = None
    edges: DataFrame | None = None
    met: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        if comp is not None:
            left = left.drop("comp").join(comp, F.col("rid") == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("comp", "rid"))
        else:
            left = left.withColumn("comp", F.col("rid"))
        # buckets in which more than one class is left
        open_ = left.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct((F.col("u") / F.col("n")).alias("share"), F.col("u"), F.col("rid"), F.col("comp"))).alias("best")).filter("lo < hi").select("k", F.col("best.rid").alias("leader"), F.col("best.comp").alias("leader_comp"), F.col("best.u").alias("leader_u"), (F.col("best.u") / F.col("best.share")).alias("leader_n"))
        still, before = left.join(open_, "k"), met
        if turn == ROUNDS:
            still = still.join(_maps(texts.join(still.select("rid").distinct(), "rid")), "rid")
        met = stage(still, "round")
        free(before)
        if met.isEmpty():
            break
        if turn < ROUNDS:
            pairs = met.filter("comp <> leader_comp").filter(_may("u", "n", "leader_u", "leader_n", least)).select(F.col("leader").alias("a"), F.col("rid").alias("b"))
            left = met.filter("rid <> leader").select("k", "rid", "n", "u", "comp")
        else:
            side = lambda t: met.select("k", *(F.col(c).alias(f"{t}_{c}") for c in ("rid", "n", "u", "comp", "rest", *(f"m{i}" for i in range(MAP_WORDS)))))
            x, y = side("x"), side("y")
            pairs = x.join(y, (x["k"] == y["k"]) & (F.col("x_rid") < F.col("y_rid")) & (F.col("x_comp") != F.col("y_comp")) & _may("x_u", "x_n", "y_u", "y_n", least) & _maps_may(least)).select(F.col("x_rid").alias("a"), F.col("y_rid").alias("b"))
        found = stage(_verified(pairs.distinct(), texts, least), "links")
        if not found.isEmpty():
            edges = found if edges is None else edges.union(found)
            comp = components(edges)
    return spark.createDataFrame([], "node long, comp long") if comp is None else comp


def _may(u: str, n: str, v: str, m: str, least: float):
    """Whether two texts' shared shingles (at most the smaller of u and v) allow the similarity."""
    most = F.least(F.col(u), F.col(v))
    return most >= least * (F.col(n) + F.col(m) - most) - 1e-9


def _possible(bounded: DataFrame, least: float) -> DataFrame:
    """Rows of buckets less those that can't be similar to any other of their bucket."""
    smallest = bounded.groupBy("k").agg(F.min("n").alias("n_min"))
    # the other text holds at least u of this one's shingles, and n_min in all
    most = F.col("u") / (F.greatest("n_min", "u") + F.col("n") - F.col("u"))
    return bounded.join(smallest, "k").filter(most >= least - 1e-9).select("k", "rid", "n", "u")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the one whose id names the class (of several texts of that id, the one of least digest).

    Defined cases are those of ``classes``; of rows that repeat id and text one stays, a class of null ids only keeps one row;
    columns of any names pass through, and an empty table stays empty.
    """
    slim, named = _grouped(docs, id_col, text_col, least)
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("first").isNull().alias("nameless"), "first", "digest")).alias("k"))
    names = {n: free_name(docs, f"kept_{n}") for n in ("id", "digest", "own")}
    kept = stage(best.select(F.col("k.first").alias(names["id"]), F.col("k.digest").alias(names["digest"])), "kept")
    same = lambda i, own: i.eqNullSafe(F.col(names["id"])) & (own == F.col(names["digest"]))
    again = slim.select("doc_id", "digest").join(kept, same(F.col("doc_id"), F.col("digest"))).groupBy("digest").count().filter("count > 1").isEmpty()
    out = docs.withColumn(names["own"], F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    out = out.join(kept, same(F.col(f"`{id_col}`").cast("long"), F.col(names["own"])))
    if not again:
        out = out.dropDuplicates([names["own"]])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
