"""Benchmark decontamination by latent semantic retrieval.

Passages of the documents and the benchmark's items become TF-IDF vectors over hashed words.  A randomised
decomposition of the passages' term covariance (one sum over all passages, small enough for one machine whatever the
corpus) gives a latent space in which directions are scaled to equal spread.  Windows of passages near an item by
cosine are candidates; a candidate counts if the item's words come in order in it (longest common subsequence,
weighted by how telling the words are), or most of them and the item's answer, its last sentence, whole.

Items that are longer than the widest window are looked up piece by piece and checked as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, span_hashes, spans, stage, table_of, texts_of, tree_sum

#: Hashed terms, dimensions of the latent space, and extra ones of the random projection.  No direction is left out, however
#: strong: a passage that very many documents share can be one.
TERMS, DIMS, EXTRA = 1 << 14, 64, 12
#: Words of a passage; a window is so many passages.
PASSAGE = 16
WIDTHS = (2, 3, 4, 5)
COSINE = 0.33
#: Share of an item's weight that must come in order; and the share that is enough with the answer whole.
MATCHED, MATCHED_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.9
#: Items, and bytes of their texts, that are sent to all tasks together; more of them are looked for block by block.
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 16_000_000
#: Numbers of a block of cosines.
COSINES = 1 << 22
#: Characters that part words: white space, ASCII controls and punctuation.
_INSIDE = table_of([i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)])


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in lower case, and the number before each text."""
    import pyarrow.compute as pc

    raw, at = texts_of(pc.utf8_lower(texts.cast(pa.large_string())))
    b, e, first = spans(raw, at, _INSIDE)
    return span_hashes(raw, b, e), first


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 14)).astype(np.uint16)


def _passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage of PASSAGE words (the last of a text may be shorter), and passages before each text."""
    n = -(-np.diff(first) // PASSAGE)
    before = np.concatenate([[0], np.cumsum(n)])
    starts = np.repeat(first[:-1] - before[:-1] * PASSAGE, n) + np.arange(before[-1]) * PASSAGE
    return starts, before


def _per_task(docs: DataFrame, text_col: str, length: int, add) -> DataFrame:
    """One vector a task: ``add(total, terms, starts of passages)`` for each slice of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for part in slices(batches, "text"):
            h, first = word_ids(part.column("text"))
            if len(h):
                total = np.zeros(length, np.float32) if total is None else total
                add(total, _terms(h), _passages(first)[0])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "part long, v binary")


class LatentSpace:
    """idf of each term, the scaled loadings of the terms and the mean of a word."""

    def __init__(self, idf: np.ndarray, loadings: np.ndarray, mean: np.ndarray) -> None:
        self.idf, self.mean = idf.astype(np.float32), mean.astype(np.float32)
        self.rows = _with_none((loadings * idf[:, None]).astype(np.float32) - self.mean)


def _with_none(rows: np.ndarray) -> np.ndarray:
    """The terms' rows, and one of zeros for no term."""
    return np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])


def _grid(terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Different terms of each passage, one passage a row; TERMS in the places left."""
    if not len(terms):
        return np.zeros((0, PASSAGE), np.uint16)
    at = starts[:, None] + np.arange(PASSAGE)
    ends = np.append(starts[1:], len(terms))
    grid = np.sort(np.where(at < ends[:, None], terms[np.minimum(at, len(terms) - 1)], np.uint16(TERMS)), axis=1)
    grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = TERMS
    return grid


def _row_sums(rows: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each passage: the sum of its words' rows (``rows`` ends with one of zeros)."""
    out = np.zeros((len(grid), rows.shape[1]), np.float32)
    for i in range(0, len(grid), 512):  # blocks that stay in the cache
        part = grid[i : i + 512]
        for k in range(PASSAGE):
            out[i : i + 512] += rows[part[:, k]]
    return out


def _spread(out: np.ndarray, y: np.ndarray, terms: np.ndarray, passage: np.ndarray) -> None:
    """Adds to each term's row the vectors of the passages of its words."""
    order = np.argsort(terms, kind="stable")
    t, p = terms[order], passage[order]
    for i in range(0, len(t), 4096):
        part = t[i : i + 4096]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out[part[at]] += np.add.reduceat(y[p[i : i + 4096]], at, axis=0)


def fit(docs: DataFrame, text_col: str = "text", *, seed: int = 42) -> LatentSpace | None:
    """The latent space of all passages; None without any word.

    Two passes: how many passages have a term, then (sum over passages x of idf-weighted term vectors) of x (x' W) with a
    random W.  From that product and W alone, a decomposition of the covariance follows.
    """
    def count(total: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> None:
        total[: TERMS + 1] += np.bincount(_grid(terms, starts).ravel(), minlength=TERMS + 1)
        total[TERMS] = 0  # no term
        total[TERMS + 1] += len(starts)

    sums = tree_sum(_per_task(docs, text_col, TERMS + 2, count), kind="f4")
    if not len(sums):
        return None
    df, n = sums[:TERMS], sums[-1]
    idf = np.log((n + 1) / (df + 1)) + 0.1
    size = DIMS + EXTRA
    w = np.random.default_rng(seed).standard_normal((TERMS, size)).astype(np.float32)
    center = df / max(df.sum(), 1)  # a word's mean
    weighted = (w * idf[:, None]).astype(np.float32)
    weighted -= (center @ weighted).astype(np.float32)

    table = _with_none(weighted)

    def multiply(total: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> None:
        grid = _grid(terms, starts)
        y = _row_sums(table, grid)
        _spread(total[: (TERMS + 1) * size].reshape(TERMS + 1, size), y, grid.ravel(), np.repeat(np.arange(len(grid), dtype=np.int32), PASSAGE))
        total[(TERMS + 1) * size :] += (grid < TERMS).sum(axis=1).astype(np.float32) @ y

    z = tree_sum(_per_task(docs, text_col, (TERMS + 2) * size, multiply), kind="f4")
    pulled = z[(TERMS + 1) * size :]
    z = z[: TERMS * size].reshape(TERMS, size) - np.outer(center, pulled)
    z *= idf[:, None]
    # covariance = z (w'z)^-1 z', so its eigenvectors are the left singular vectors of z L'^-1 with w'z = L L'
    core = w.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    # the sums have single precision: what is weaker than this is rounding, which scaling to equal spread would blow up
    good = values > values.max(initial=0) * 1e-6
    if not good.any():
        return LatentSpace(idf, np.zeros((TERMS, 1)), np.zeros(1))
    u, s, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    rank = int((s > s[0] * 1e-3).sum())
    loadings = u[:, : min(DIMS, rank)] / s[: min(DIMS, rank)]
    return LatentSpace(idf, loadings, center @ (loadings * idf[:, None]))


def _in_order(a: list[int], b: list[int], weights: list[float]) -> tuple[float, list[bool]]:
    """Greatest weight of a common subsequence of ``a`` and ``b``, and which of ``a`` it matches."""
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1))
    arr = np.array(b, np.uint64)
    for i in range(n):
        take = best[i, :-1] + np.where(arr == np.uint64(a[i]), weights[i], -np.inf)
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], take))
    hit, i, j = [False] * n, n, m
    while i and j:
        if best[i, j] == best[i, j - 1]:
            j -= 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            hit[i] = True
    return float(best[n, m]), hit


def _length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := at.get(y):
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(a) - row.bit_count()


class Item:
    def __init__(self, item_id: int | None, words: np.ndarray, answer: int, weights: np.ndarray) -> None:
        self.item_id, self.words, self.answer = item_id, words.tolist(), answer
        self.weights = weights.tolist()
        self.total, self.answer_total = sum(self.weights), sum(self.weights[len(self.words) - answer :])
        #: The greatest weight that so many words can have.
        self.most = np.concatenate([[0.0], np.cumsum(sorted(self.weights, reverse=True))])

    def check(self, words: list[int]) -> tuple[float, bool] | None:
        """Share of the item's weight found in order, and whether the answer is; None if that is too little."""
        if self.most[_length(self.words, words)] < MATCHED_WITH_ANSWER * self.total * 0.999:
            return None
        weight, hit = _in_order(self.words, words, self.weights)
        share = weight / self.total
        start = len(self.words) - self.answer
        answered = sum(w for w, x in zip(self.weights[start:], hit[start:]) if x) >= ANSWER * self.answer_total
        return (share, answered) if share >= MATCHED or (share >= MATCHED_WITH_ANSWER and answered) else None


def _items(rows: list, space: LatentSpace) -> list[Item]:
    """Items with words; the answer is the words after the last end of a sentence but one."""
    import re

    out = []
    for item_id, text in rows:
        body = (text or "").rstrip()
        ends = [m.end() for m in re.finditer(r"[.?!]\s+|\n", body)]
        h, first = word_ids(pa.array([body, body[ends[-1] :] if ends else ""], pa.string()))
        words, n_answer = h[: first[1]], int(first[2] - first[1])
        if len(words):
            out.append(Item(item_id, words, n_answer or min(len(words), 5), space.idf[_terms(words)].astype(float)))
    return out


def _queries(items: list[Item], space: LatentSpace) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width of windows: which items (or pieces of items) it is for, and their unit vectors."""
    by: dict[int, tuple[list[int], list[np.ndarray]]] = {w: ([], []) for w in WIDTHS}
    longest = (WIDTHS[-1] - 1) * PASSAGE
    for i, item in enumerate(items):
        words = np.array(item.words, np.uint64)
        for begin in range(0, len(words), longest):
            piece = words[begin : begin + longest] if len(words) - begin >= PASSAGE // 2 or not begin else words[-PASSAGE:]
            need = next((w for w in WIDTHS if (w - 1) * PASSAGE >= len(piece) - 1), WIDTHS[-1])
            v = space.rows[_terms(piece)].sum(axis=0)
            by[need][0].append(i)
            by[need][1].append(v / max(float(np.linalg.norm(v)), 1e-9))
    return {w: (np.array(i), np.array(v, np.float32)) for w, (i, v) in by.items() if i}


def _term_bits(items: list[Item]) -> np.ndarray:
    """For each item, a bit for each of its terms."""
    bits = np.zeros((len(items), TERMS // 8), np.uint8)
    for i, item in enumerate(items):
        t = _terms(np.array(item.words, np.uint64))
        np.bitwise_or.at(bits[i], t >> 3, (1 << (t & 7)).astype(np.uint8))
    return bits


def _held(terms: np.ndarray, begin: np.ndarray, end: np.ndarray, q: np.ndarray, items: list[Item], bits: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """More than the weight of each item's words that the words from begin to end can match: those whose terms it has."""
    n = end - begin
    out = np.zeros(len(q), np.float32)
    for i in range(0, len(q), 2048):
        size = n[i : i + 2048]
        if not size.sum():
            continue
        base = np.concatenate([[0], np.cumsum(size)])
        t = terms[np.repeat(begin[i : i + 2048] - base[:-1], size) + np.arange(base[-1])]
        hit = (bits[np.repeat(q[i : i + 2048], size), t >> 3] >> (t & 7)) & 1
        some = size > 0
        out[i : i + 2048][some] = np.add.reduceat(weight[t] * hit, base[:-1][some])
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """(doc_id, digest of the text, item_id, matched, answered): the items that stand in documents, one row a pair.

    Defined cases: null and empty texts hold nothing; items without words are in no document; repeated rows give
    one row a pair; repeated items count each by its id; of equal matches of a pair either says the same; a very long text is
    looked through whole, in the memory of one slice; only the named columns are read, whatever others are called; an empty table
    on either side gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(F.col(f"`{text_col}`"))).alias("digest"), F.col(f"`{text_col}`").alias("text"))
    space, out = None, spark.createDataFrame([], "doc_id long, digest binary, item_id long, matched double, answered boolean")
    for block in _blocks(benchmark.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{item_text_col}`").cast("string")).toLocalIterator()):
        space = fit(slim, "text") if space is None else space
        if space is None:
            break
        if items := _items(block, space):
            out = out.unionByName(_found(slim, space, items, cosine))
    return out


def _blocks(rows) -> Iterator[list]:
    held, size = [], 0
    for r in rows:
        held.append(tuple(r))
        size += len(r[1] or "")
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(slim: DataFrame, space: LatentSpace, items: list[Item], cosine: float) -> DataFrame:
    """The pairs of a block of items, as a table."""
    asked = slim.sparkSession.sparkContext.broadcast((space, items, _queries(items, space), _term_bits(items)))
    kind = "doc_id long, digest binary, item_id long, matched double, answered boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items, queries, bits = asked.value
        totals, lengths = np.array([x.total for x in items]), np.array([len(x.words) for x in items])
        weight = np.append(space.idf, 0.0).astype(np.float32)
        for part in slices(batches, "text"):
            h, first = word_ids(part.column("text"))
            starts, before = _passages(first)
            if not len(h):
                continue
            terms = _terms(h)
            y = _row_sums(space.rows, _grid(terms, starts))
            doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
            found: dict[tuple[int, int], tuple[float, bool]] = {}
            for width, (which, vectors) in queries.items():
                # windows begin at every passage and end with the text
                w = y.copy()
                for k in range(1, width):
                    w[:-k] += np.where((doc[k:] == doc[:-k])[:, None], y[k:], 0)
                w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
                rows = max(COSINES // len(vectors), 16)
                for i in range(0, len(w), rows):
                    p, q = np.nonzero(w[i : i + rows] @ vectors.T >= cosine)
                    p, q = p + i, which[q]
                    begin = np.maximum(starts[p] - np.where(lengths[q] > width * PASSAGE, lengths[q], PASSAGE), first[doc[p]])
                    end = np.minimum(starts[p] + (width + 1) * PASSAGE + np.where(lengths[q] > width * PASSAGE, lengths[q], 0), first[doc[p] + 1])
                    for k in np.flatnonzero(_held(terms, begin, end, q, items, bits, weight) >= MATCHED_WITH_ANSWER * totals[q] * 0.999):
                        key = int(doc[p[k]]), int(q[k])
                        if found.get(key, (0.0, False))[0] < 0.999 and (got := items[key[1]].check(h[begin[k] : end[k]].tolist())) and got > found.get(key, (0.0, False)):
                            found[key] = got
            if found:
                at = pa.array([d for d, _ in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("digest").take(at), pa.array([items[i].item_id for _, i in found], pa.int64()), pa.array([s for s, _ in found.values()]), pa.array([a for _, a in found.values()])], names=["doc_id", "digest", "item_id", "matched", "answered"])

    out = stage(slim.mapInArrow(run, kind).groupBy("doc_id", "digest", "item_id").agg(F.max("matched").alias("matched"), F.max("answered").alias("answered")), "leaks")
    asked.destroy()
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` less the documents that hold an item.

    Defined cases: null and empty texts stay; rows that repeat id and text stay or go together; columns of any names pass
    through; an empty table on either side leaves ``docs`` as it is.
    """
    names = {n: free_name(docs, f"hit_{n}") for n in ("id", "digest", "own")}
    # a table of known size: where it is small, texts are not dealt out for the join
    hit = stage(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(names["id"]), F.col("digest").alias(names["digest"])).distinct(), "hits")
    marked = docs.withColumn(names["own"], F.unhex(F.md5(F.col(f"`{text_col}`"))))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(names["id"])) & (F.col(names["own"]) == F.col(names["digest"]))
    return marked.join(hit, same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
