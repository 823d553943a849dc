"""Language-model scores by causal self-attention over subword ids, trained and run in numpy.

A position is a subword id.  Embeddings, queries, keys, values, relative places and the output are trained.  Text
is cut into windows that overlap by half: the second half of each is scored, the first half is context, so that each id is
scored once, with at least HALF ids before it (fewer at a text's begin).  Masked attention and the id before give a vector,
and the vector a distribution over all ids in two steps: classes of ids, balanced by their frequency, and the ids of a
class.  Ids that no training text has share a small fixed probability; so every text has one, and all sum to one.

Training goes over every training text once, by gradient descent (Adagrad), in ROUNDS rounds, whatever the size of the input.  Texts are dealt by a hash to groups, groups to
rounds; a round's groups start from the same weights, each goes through its own texts in the order of their hashes, and
the results are averaged.  Groups hang on hashes and the number of training ids alone, so partitions change nothing.
More input makes more groups in each round, of about GROUP_IDS ids at most.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget_powers, free_name, slices, span_hashes, spans, stage, texts_of, tree_sum

#: Words whose counts are kept in memory for the base score.  The others are joined, so this changes the cost and no result.
FREQUENT = 1 << 17
#: Ids of a window, the second half of them scored in it; size of embeddings.
WINDOW, DIM = 32, 16
HALF = WINDOW // 2
#: Windows of a gradient step, its rate, and ids among whose windows the steps choose at random.
BATCH, RATE, BUFFER = 64, 0.2, 1 << 19
#: Windows whose attention is computed together in scoring, and windows whose ids are sorted by class together.
SCORED, SORTED = 256, 4096
#: Rounds of training; training ids of a group, on average at most.
ROUNDS, GROUP_IDS = 8, 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO = np.float32(-1e9)
#: How far each id of the window lies before each scored one; what lies behind is masked.
_FAR = np.arange(HALF, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_DISTANCE = np.clip(_FAR, 0, WINDOW - 1)
_BEHIND = _FAR >= 0
_SCALE = np.float32(DIM**-0.5)


class Vocabulary:
    """Ids in falling order of their training counts, and their classes."""

    def __init__(self, counts: np.ndarray) -> None:
        self.size, total = len(counts), float(counts.sum())
        seen = np.flatnonzero(counts)
        self.order = seen[np.argsort(-counts[seen], kind="stable")]
        self.n = len(self.order)
        self.count = counts[self.order].astype(np.float64)
        #: Places after those of seen ids: the begin of a text, an unseen id, none.
        self.begin, self.unseen, self.none = self.n, self.n + 1, self.n + 2
        self.place = np.full(self.size, self.unseen, np.int32)
        self.place[self.order] = np.arange(self.n)
        root = np.sqrt(self.count)
        if self.n:
            # so many that classes and the ids of a class, on average over the text, are as many
            wanted = int(np.ceil(root.sum() / np.sqrt(self.count.sum())))
            raw = np.minimum(((np.cumsum(root) - root / 2) / root.sum() * wanted).astype(np.int64), wanted - 1)
            self.classes, self.class_of = (x.astype(np.uint16) for x in np.unique(raw, return_inverse=True))
        else:
            self.class_of = np.zeros(0, np.uint16)
        self.n_classes = int(self.class_of.max()) + 1 if self.n else 0
        self.starts = np.searchsorted(self.class_of, np.arange(self.n_classes + 1))
        #: Classes of similar size together, for the few ids of a step, and each alone, for many ids.
        self.bands, self.alone = self._bands(2), self._bands(0)
        # the share of all unseen ids together: as if ids seen once had come as often as new ones will
        once = float((self.count == 1).sum())
        self.new = (once + 1) / (total + once + 1) if self.n < self.size else 0.0
        with np.errstate(divide="ignore"):
            self.log_seen = float(np.log1p(-self.new)) if self.new < 1 else -np.inf
            self.log_unseen = float(np.log(self.new) - np.log(max(self.size - self.n, 1)))

    def _bands(self, times: float) -> list[tuple]:
        """Runs of classes of up to so many times the first one's size: begin, end, a row of ids a class (the last repeated where a class has fewer), where those are, and where the others are."""
        out, width, j = [], np.diff(self.starts), 0
        while j < self.n_classes:
            end = j + 1 + int(np.argmax(np.append(width[j + 1 :] > times * width[j], True)))
            within, most = np.arange(width[j:end].max()), width[j:end, None]
            ids = self.starts[j:end, None] + np.minimum(within, most - 1)
            out.append((j, end, ids, *(np.flatnonzero(x) for x in (within >= most, within < most))))
            j = end
        return out


class Attention:
    """The weights as one vector, and behind them the sums of squared gradients."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None) -> None:
        v = self.vocabulary = vocabulary
        # what is multiplied with the same vectors lies side by side; a bias is the last number of its row
        shapes = {"embed": (v.n + 3, DIM), "kv": (DIM, 2 * DIM), "ql": (DIM, 2 * DIM), "far": (WINDOW,), "tops": (v.n_classes, DIM + 1), "outs": (v.n, DIM + 1)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        fresh = flat is None
        self.flat = np.zeros(2 * size, np.float32) if fresh else flat.astype(np.float32)
        self.w, self.g, at = {}, {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.w[name], self.g[name] = (self.flat[a : a + n].reshape(shape) for a in (at, size + at))
            at += n
        for w in (self.w, self.g):
            w |= {"k": w["kv"][:, :DIM], "v": w["kv"][:, DIM:], "q": w["ql"][:, :DIM], "last": w["ql"][:, DIM:]}
            w |= {"top": w["tops"][:, :DIM], "top_bias": w["tops"][:, DIM], "out": w["outs"][:, :DIM], "out_bias": w["outs"][:, DIM]}
        if fresh:
            self._begin()

    def __reduce__(self) -> tuple:
        return Attention, (self.vocabulary, self.flat)

    def _begin(self) -> None:
        rng, v, w = np.random.default_rng(7), self.vocabulary, self.w
        for name, scale in (("embed", 0.3), ("q", DIM**-0.5), ("k", DIM**-0.5), ("v", 0.5 * DIM**-0.5), ("top", 0.1), ("out", 0.1)):
            w[name][...] = rng.standard_normal(w[name].shape) * scale
        w["embed"][v.unseen :] = 0
        w["last"][...] = np.eye(DIM)
        w["far"][1:4] = 1
        if v.n:
            w["top_bias"][...] = np.log(np.add.reduceat(v.count, v.starts[:-1]) / v.count.sum())
            w["out_bias"][...] = np.log(v.count)
        self.flat[len(self.flat) // 2 :] = 1e-3

    def keys(self, e: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values of embeddings; one number more in the keys (and a one in the queries) masks what is no id."""
        kv = e @ self.w["kv"]
        k = np.empty((*none.shape, DIM + 1), np.float32)
        k[..., :DIM] = kv[..., :DIM]
        k[..., DIM] = none * _NO
        return k, kv[..., DIM:]

    def queries(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and direct contributions of embeddings."""
        ql = e @ self.w["ql"]
        q = np.ones((*e.shape[:-1], DIM + 1), np.float32)
        np.multiply(ql[..., :DIM], _SCALE, out=q[..., :DIM])
        return q, ql[..., DIM:]

    def forward(self, k: np.ndarray, v: np.ndarray, q: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention (WINDOW, windows, HALF) and the vectors of the second half, a one behind each, from keys and values of all places of windows, queries and direct contributions of the second half."""
        # keys first: what is done along them then runs over long rows of memory
        a = np.empty((WINDOW, len(k), HALF), np.float32)
        np.matmul(k, q.transpose(0, 2, 1), out=a.transpose(1, 0, 2))
        a += np.where(_BEHIND, self.w["far"][_DISTANCE], _NO).T[:, None]
        a -= np.maximum.reduce(a, axis=0)
        np.exp(a, out=a)
        a /= np.add.reduce(a, axis=0)
        h = np.ones((len(k), HALF, DIM + 1), np.float32)
        np.add(a.transpose(1, 2, 0) @ v, last, out=h[:, :, :DIM])
        return a, h

    def log_p(self, h: np.ndarray, y: np.ndarray, step: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """ln probability of ids y after vectors h (0 where y is no seen id); with ``step`` the output is moved and the gradient at h comes along."""
        v, tops, outs = self.vocabulary, self.w["tops"], self.w["outs"]
        lp, dh = np.zeros(len(y)), np.zeros_like(h) if step else None
        order = np.flatnonzero((y >= 0) & (y < v.n))
        n = len(order)
        if not n:
            return lp, dh
        c = v.class_of[y[order]]
        by = np.argsort(c, kind="stable")
        order, c = order[by], c[by]
        hs, ys = h.take(order, axis=0), y[order]
        each, share = np.arange(n), np.float32(1 / n)
        own, sums = np.empty(n, np.float32), np.empty(n, np.float32)
        ds, moved = np.empty_like(hs) if step else None, np.zeros_like(tops)
        # a row a class, a column an id to predict: sums and maxima run along memory
        for a in range(0, n, 4096):
            b = min(a + 4096, n)
            z = tops @ hs[a:b].T
            z -= np.maximum.reduce(z, axis=0)
            own[a:b] = z[c[a:b], each[: b - a]]
            np.exp(z, out=z)
            total = np.add.reduce(z, axis=0, out=sums[a:b])
            if step:
                z *= share / total
                z[c[a:b], each[: b - a]] -= share
                np.matmul(z.T, tops, out=ds[a:b])
                moved += z @ hs[a:b]
        if step:
            self._move("tops", moved)
        lp[order] = own - np.log(sums) + v.log_seen
        bounds = np.searchsorted(c, np.arange(v.n_classes + 1))
        c = c.astype(np.int64)
        nth, t = each - bounds[c], ys - v.starts[c]
        for first, end, ids, fill, real in v.bands if step else v.alone:
            a, b = bounds[first], bounds[end]
            if a == b:
                continue
            # a class is a matrix, filled up with nothing to the most ids to predict and the most ids of a class
            m = int(np.diff(bounds[first : end + 1]).max())
            row = c[a:b] - first
            to = row * m + nth[a:b]
            x = hs[a:b]
            if end - first > 1:
                x = np.zeros((len(ids) * m, DIM + 1), np.float32)
                x[to] = hs[a:b]
            x = x.reshape(-1, m, DIM + 1)
            out = outs.take(ids, axis=0)
            out.reshape(-1, DIM + 1)[fill, DIM] = _NO
            z = out @ x.transpose(0, 2, 1)
            z -= np.maximum.reduce(z, axis=1)[:, None]
            mine = (row * ids.shape[1] + t[a:b]) * m + nth[a:b]
            own[a:b] = z.reshape(-1)[mine]
            np.exp(z, out=z)
            sums[a:b] = np.add.reduce(z, axis=1).reshape(-1)[to]
            if step:
                scale = np.zeros(len(ids) * m, np.float32)
                scale[to] = share / sums[a:b]
                z *= scale.reshape(-1, 1, m)
                z.reshape(-1)[mine] -= share
                ds[a:b] += (z.transpose(0, 2, 1) @ out).reshape(-1, DIM + 1).take(to, axis=0)
                self._move("outs", (z @ x).reshape(-1, DIM + 1).take(real, axis=0), slice(v.starts[first], v.starts[end]))
        lp[order] += own - np.log(sums)
        if step:
            dh[order] = ds
        return lp, dh

    def _move(self, name: str, d: np.ndarray, rows=slice(None)) -> None:
        g, w = self.g[name], self.w[name]
        root = d * d
        root += g[rows]
        g[rows] = root
        np.sqrt(root, out=root)
        d /= root
        d *= np.float32(RATE)
        w[rows] -= d

    def fit(self, x: np.ndarray, y: np.ndarray) -> float:
        """One step on windows x and the ids y that their second halves predict (negative: none); the sum of ln p of seen ids before it."""
        v, w, flat = self.vocabulary, self.w, x.ravel()
        e = w["embed"].take(flat, axis=0)
        late = e.reshape(*x.shape, DIM)[:, HALF:].reshape(-1, DIM)
        (k, value), (q, last) = self.keys(e, flat == v.none), self.queries(late)
        k, value, q, last = (t.reshape(len(x), -1, t.shape[-1]) for t in (k, value, q, last))
        a, h = self.forward(k, value, q, last)
        lp, dh = self.log_p(h.reshape(-1, DIM + 1), y.ravel(), step=True)
        dh = dh.reshape(h.shape)[:, :, :DIM]
        da = np.empty_like(a)
        np.matmul(value, dh.transpose(0, 2, 1), out=da.transpose(1, 0, 2))
        da -= np.add.reduce(a * da, axis=0)
        da *= a
        # the last number of queries and keys is the mask's; queries are scaled already
        dkv, dql = np.empty((*x.shape, 2 * DIM), np.float32), np.empty((*y.shape, 2 * DIM), np.float32)
        dkv[:, :, :DIM], dkv[:, :, DIM:] = da.transpose(1, 0, 2) @ q[:, :, :DIM], a.transpose(1, 0, 2) @ dh
        dql[:, :, :DIM], dql[:, :, DIM:] = (da.transpose(1, 2, 0) @ k[:, :, :DIM]) * _SCALE, dh
        dkv, dql = dkv.reshape(-1, 2 * DIM), dql.reshape(-1, 2 * DIM)
        de = dkv @ w["kv"].T
        de.reshape(*x.shape, DIM)[:, HALF:] += (dql @ w["ql"].T).reshape(*y.shape, DIM)
        far = np.bincount(_DISTANCE[_BEHIND], weights=np.add.reduce(da, axis=1).T[_BEHIND], minlength=WINDOW).astype(np.float32)
        order = np.argsort(flat.astype(np.uint16) if v.none < 1 << 16 else flat, kind="stable")
        ids = flat[order]
        at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows, moved = ids[at], np.add.reduceat(de.take(order, axis=0), at, axis=0)
        trained = np.searchsorted(rows, v.unseen)
        steps = {"kv": e.T @ dkv, "ql": late.T @ dql, "far": far}
        self._move("embed", moved[:trained], rows[:trained])
        for name, d in steps.items():
            self._move(name, d)
        return float(lp.sum())

    def score(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """ln probability of each text; ``places``: of all texts' ids in a row, the end among them."""
        v, embed = self.vocabulary, self.w["embed"]
        rows, targets, at, doc = windows_of(places, lengths, v)
        out = np.zeros(len(lengths))
        (key, value), (query, last) = self.keys(embed, np.arange(len(embed)) == v.none), self.queries(embed)
        value, last = np.ascontiguousarray(value), np.ascontiguousarray(last)
        for i in range(0, len(at), SORTED):
            windows = at[i : i + SORTED]
            h = np.empty((len(windows), HALF, DIM + 1), np.float32)
            for j in range(0, len(windows), SCORED):
                w = windows[j : j + SCORED]
                late = rows[w + 1]
                x = np.concatenate([rows[w], late], axis=1)
                h[j : j + SCORED] = self.forward(key.take(x, axis=0), value.take(x, axis=0), query.take(late, axis=0), last.take(late, axis=0))[1]
            y = targets[windows]
            lp = self.log_p(h.reshape(-1, DIM + 1), y.ravel())[0].reshape(y.shape)
            lp[y >= v.n] = v.log_unseen
            out += np.bincount(doc[i : i + SORTED], weights=lp.sum(axis=1), minlength=len(out))
        return out


def windows_of(places: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """Rows of HALF inputs and of HALF targets (-1: none), the first row of each window (its second is the next), and its text.

    A text's inputs are its begin and its ids but the last; before the begin stands a row of nothing.
    """
    n_rows = -(-lengths // HALF) + 1
    base = np.cumsum(n_rows) - n_rows
    rows = np.full((int(n_rows.sum()), HALF), vocabulary.none, np.int32)
    targets = np.full_like(rows, -1)
    first = np.cumsum(lengths) - lengths
    to = np.arange(len(places)) + np.repeat(base * HALF - first, lengths)
    targets.ravel()[to] = places
    last = np.zeros(len(places), bool)
    last[first + lengths - 1] = True
    rows.ravel()[to[~last] + HALF + 1] = places[~last]
    rows.ravel()[base * HALF + HALF] = vocabulary.begin
    ends = np.zeros(len(rows), bool)
    ends[base + n_rows - 1] = True
    return rows, targets, np.flatnonzero(~ends), np.repeat(np.arange(len(lengths)), n_rows - 1)


def _fit_buffer(model: Attention, texts: list[np.ndarray], seed: int) -> None:
    """Steps over all windows of the texts in an order that the seed gives."""
    v = model.vocabulary
    rows, targets, at, _ = windows_of(np.concatenate(texts), np.array([len(t) for t in texts]), v)
    at = np.random.default_rng(seed).permutation(at)
    for i in range(0, len(at), BATCH):
        w = at[i : i + BATCH]
        model.fit(np.concatenate([rows[w], rows[w + 1]], axis=1), targets[w])


def _give_back(encoders: bool = True) -> None:
    """Memory of earlier work back to the system: Python workers outlive stages, and whatever they took counts for their executor."""
    from . import token_output

    if encoders:
        token_output.forget_encoders()
    forget_powers()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _ids(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column in a row, and how many of each."""
    return np.frombuffer(b"".join(column.to_pylist()), _kind(size)), pc.binary_length(column).to_numpy().astype(np.int64) // np.dtype(_kind(size)).itemsize


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, begin, end and hash of each word, and the number before each text."""
    raw, at = texts_of(texts)
    raw = _LOWER[raw]
    b, e, first = spans(raw, at)
    return raw, b, e, span_hashes(raw, b, e), first


def _strings(raw: np.ndarray, b: np.ndarray, e: np.ndarray) -> list[str]:
    data = raw.tobytes()
    return [data[i:j].decode("utf-8", "replace") for i, j in zip(b.tolist(), e.tolist())]


def _word_counts(docs: DataFrame, taught: str, text_col: str) -> DataFrame:
    """All texts' words, a hash of each, and how often the training texts have them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2_000_000):
            raw, b, e, h, first = _words(part.column("text"))
            u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            mine = np.repeat(part.column("taught").to_numpy(zero_copy_only=False), np.diff(first))
            n = np.bincount(inverse[mine], minlength=len(at))
            yield pa.RecordBatch.from_arrays([pa.array(_strings(raw, b[at], e[at]), pa.string()), pa.array(u.view(np.int64)), pa.array(n, pa.int64())], names=["word", "h", "c"])
        _give_back()

    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{taught}`").alias("taught"))
    return stage(texts.mapInArrow(count, "word string, h long, c long").groupBy("word").agg(F.first("h").alias("h"), F.sum("c").alias("c")), "words")


#: What the table of encoded texts has beside the documents' own columns.
_OWN = ("row", "order", "taught", "ids", "n_ids", "n_words", "n_known", "log_known", "rare")


def _encoded(docs: DataFrame, names: dict[str, str], keep: list[str], words: DataFrame, path: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """Each row of ``docs`` without its text, but with its ids, what the frequent words give its base score, and its other words."""
    often = words.filter("c > 0").orderBy(F.desc("c"), "word").limit(FREQUENT).select("h", "c").toPandas().sort_values("h")
    shared = docs.sparkSession.sparkContext.broadcast((often["h"].to_numpy(np.int64), often["c"].to_numpy(np.int64)))
    text = free_name(docs, "lm_text")
    slim = docs.select(
        *(F.col(f"`{c}`") for c in keep), F.monotonically_increasing_id().alias(names["row"]),
        F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).alias(names["order"]), F.col(f"`{names['taught']}`"), F.col(f"`{text_col}`").alias(text),
    )
    head = slim.columns[:-1]
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField(names["ids"], T.BinaryType()), *(T.StructField(names[n], T.LongType()) for n in ("n_ids", "n_words", "n_known")), T.StructField(names["log_known"], T.DoubleType()), T.StructField(names["rare"], T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_output import encoder

        hashes, counts = shared.value
        for part in slices(batches, text):
            texts = part.column(text)
            # the library's special strings are ordinary text here
            ids, at = encoder(path, size - 1, True).arrays(pc.ascii_lower(texts))
            ids = ids.astype(_kind(size))
            raw, b, e, h, first = _words(texts)
            h = h.view(np.int64)
            k = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            known = hashes[k] == h if len(hashes) else np.zeros(len(h), bool)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            logs = np.bincount(doc[known], weights=np.log10(counts[k[known]] + 1.0), minlength=len(n))
            rare = np.flatnonzero(~known)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first), pa.int32()), pa.array(_strings(raw, b[rare], e[rare]), pa.string()))
            data = ids.tobytes()
            bounds = (at * ids.itemsize).tolist()
            cols = [pa.array([data[i:j] for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()), *(pa.array(x, pa.int64()) for x in (np.diff(at), n, np.bincount(doc[known], minlength=len(n)))), pa.array(logs, pa.float64()), lists]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in head), *cols], names=schema.names)
        # the stage's next task encodes with what this one has remembered
        _give_back(encoders=False)

    return stage(slim.mapInArrow(run, schema), "encoded")


def _vocabulary(encoded: DataFrame, names: dict[str, str], size: int) -> Vocabulary:
    column = names["ids"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _give_back()
        total = np.zeros(size)
        for batch in batches:
            total += np.bincount(_ids(batch.column(column), size)[0], minlength=size)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "v": [total.tobytes()]}, schema=pa.schema([("part", pa.int64()), ("v", pa.binary())]))

    counts = tree_sum(encoded.filter(F.col(names["taught"])).select(column).mapInArrow(count, "part long, v binary"))
    return Vocabulary(counts if len(counts) else np.zeros(size))


def _trained(encoded: DataFrame, names: dict[str, str], vocabulary: Vocabulary) -> Attention:
    """The weights after all rounds."""
    model = Attention(vocabulary)
    total = int(vocabulary.count.sum())
    if not total:
        return model
    per_round = -(-total // (ROUNDS * GROUP_IDS))
    spark = encoded.sparkSession
    mine = F.pmod(F.col(names["order"]), F.lit(ROUNDS * per_round))
    texts = encoded.filter(F.col(names["taught"])).select(mine.alias("g"), F.col(names["order"]).alias("order"), F.col(names["ids"]).alias("ids"))
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _give_back()
            start, own, held, waiting, n, seed, now = shared.value, None, [], 0, 0, 0, None

            def flush() -> None:
                nonlocal held, waiting, seed
                if held:
                    _fit_buffer(own, held, seed)
                held, waiting, seed = [], 0, seed + 1

            def done() -> pa.RecordBatch:
                flush()
                return pa.RecordBatch.from_pydict({"part": [now // ROUNDS], "v": [np.append(own.flat * np.float32(n), np.float32(n)).tobytes()]}, schema=pa.schema([("part", pa.int64()), ("v", pa.binary())]))

            for batch in batches:
                size = start.vocabulary.size
                for g, raw in zip(batch.column("g").to_pylist(), batch.column("ids")):
                    if g != now:
                        if own is not None:
                            yield done()
                        own, n, seed, now = Attention(start.vocabulary, start.flat.copy()), 0, g << 20, g
                    ids = start.vocabulary.place[np.frombuffer(raw.as_buffer(), _kind(size))]
                    held.append(ids)
                    n, waiting = n + len(ids), waiting + len(ids)
                    if waiting >= BUFFER:
                        flush()
            if own is not None:
                yield done()

        part = texts.filter(F.col("g") % ROUNDS == r).repartition(per_round, "g").sortWithinPartitions("g", "order", "ids")
        sums = tree_sum(part.mapInArrow(train, "part long, v binary"), per_round, "f4")
        shared.destroy()
        if len(sums):
            model = Attention(vocabulary, sums[:-1] / sums[-1])
    return model


def train_and_score(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held_out: int = 2) -> DataFrame:
    """``docs`` without the text, with held_out, train_tokens, n_tokens, n_known, base_score and score.

    held_out: crc32 of the id as text, modulo ``parts``, is ``held_out``; all other rows are training texts.  base_score:
    log10 of each word's (and the end's) own smoothed frequency in the training texts, summed.  score: log10 of the model's
    probability of the text's subword ids and its end.

    Defined cases: null and empty texts are their end alone; a null id counts as an empty text; repeated rows are scored
    alike and each counts in training; without any training text all ids are equally likely; an empty table gives an empty
    result; existing columns of the new names push underscores before the new ones.  A very long text is encoded and
    scored whole, its windows in batches.
    """
    from tokenizers import Tokenizer

    new = {n: free_name(docs, n) for n in ("held_out", "train_tokens", "n_tokens", "n_known", "base_score", "score")}
    names = {n: free_name(docs, f"lm_{n}") for n in _OWN}
    marked = docs.withColumn(new["held_out"], F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % parts == held_out)
    marked = marked.withColumn(names["taught"], ~F.col(new["held_out"]))
    keep = [c for c in marked.columns if c not in (text_col, names["taught"])]
    size = Tokenizer.from_file(tokenizer).get_vocab_size() + 1  # the last is the end of a text
    words = _word_counts(marked, names["taught"], text_col)
    encoded = _encoded(marked, names, keep, words, tokenizer, size, id_col, text_col)
    ends = encoded.filter(F.col(names["taught"])).count()
    total = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = total.n + ends, total.v + (ends > 0)
    model = _trained(encoded, names, _vocabulary(encoded, names, size))

    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*keep, *(names[n] for n in ("row", "n_words", "n_known", "log_known"))]
    kinds = {f.name: f for f in encoded.schema.fields}
    schema = T.StructType([*(kinds[c] for c in columns), T.StructField(new["score"], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        m = shared.value
        for part in slices(batches, names["ids"]):
            ids, lengths = _ids(part.column(names["ids"]), m.vocabulary.size)
            lp = m.score(m.vocabulary.place[ids], lengths) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(lp)], names=schema.names)

    scored = encoded.select(*(F.col(f"`{c}`") for c in [*columns, names["ids"]])).mapInArrow(run, schema)
    # the words that are not frequent, each place of them
    rest = encoded.select(F.col(names["row"]).alias("r"), F.explode(names["rare"]).alias("word")).groupBy("r", "word").agg(F.count(F.lit(1)).alias("k")).join(words.select("word", "c"), "word")
    rest = rest.groupBy("r").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known")).toDF(*(free_name(scored, f"rare_{n}") for n in ("row", "logs", "known")))
    row, logs, known = rest.columns
    out = scored.join(rest, F.col(names["row"]) == F.col(row), "left")
    per, c_end = float(np.log10(tokens + distinct + 1)), float(np.log10(ends + 1.0))
    n = F.col(names["n_words"]) + 1
    return out.select(
        *(F.col(f"`{c}`") for c in keep), F.lit(tokens).cast("long").alias(new["train_tokens"]), n.alias(new["n_tokens"]),
        (F.col(names["n_known"]) + F.coalesce(F.col(known), F.lit(0)) + int(ends > 0)).cast("long").alias(new["n_known"]),
        (F.col(names["log_known"]) + F.coalesce(F.col(logs), F.lit(0.0)) + c_end - n * per).alias(new["base_score"]), F.col(new["score"]),
    )
