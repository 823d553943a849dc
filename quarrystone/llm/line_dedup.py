"""Line dedup: repeated multi-line chunks with content-defined boundaries.

A rolling hash over the hashes of lines chooses boundaries: after lines whose hash has its low bits zero, and around every
long line.  They hang on the lines themselves, so text inserted above or below a passage moves none inside it.  From
every line, the lines up to the first boundary that leaves a chunk make a chunk, and so do those back to the last such
boundary; so a repeated passage is covered up to its first and its last line, wherever it stands.  A chunk of two lines or
more, or one long line, that stands anywhere before (in the order of document id, digest of the text, place) is removed.

Chunks are first matched by hash.  Chunks of repeated hashes, and the same with a line more before or after that no such
chunk of the text holds, are then grouped by their bytes.  Texts cross the network compressed, and twice: to their repeated places, and to the lines that go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, free_name, mix, slices, span_hashes, spans, stage, texts_of

#: One line in so many ends at a boundary.
MEAN_LINES = 2
#: Words that make a line long, and words that a chunk must have to be removed.
LONG_WORDS, LEAST_WORDS = 25, 10


def chunks_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """All texts' chunks that may be removed, one line's in another's: text, first line, line after the last, first byte, byte after the last, hash."""
    # lines end at line feeds; empty lines count, so bounds come from the feeds and not from spans
    feeds = np.flatnonzero(raw == 10)
    n_lines = np.diff(np.searchsorted(feeds, at)) + 1
    before = np.concatenate([[0], np.cumsum(n_lines)])
    begin = np.empty(before[-1], np.int64)
    begin[before[:-1]] = at[:-1]
    inner = np.ones(before[-1], bool)
    inner[before[:-1]] = False
    begin[inner] = feeds + 1
    end = np.empty_like(begin)
    end[before[1:] - 1] = at[1:]
    last = np.zeros(before[-1], bool)
    last[before[1:] - 1] = True
    end[~last] = feeds
    h = span_hashes(raw, begin, end)
    word_begin, _, _ = spans(raw, at)
    words = np.searchsorted(word_begin, end) - np.searchsorted(word_begin, begin)
    rolled = mix(h)
    long = words >= LONG_WORDS
    cut_after = (rolled % np.uint64(MEAN_LINES) == 0) | long | last
    cut_after[:-1] |= long[1:]
    total = np.concatenate([[0], np.cumsum(words)])
    starts, ends = _candidates(cut_after, last, long, before, total)
    doc = np.searchsorted(before, starts, "right") - 1
    a, b = begin[starts], end[ends - 1]
    return doc, starts - before[doc], ends - before[doc], a, b, span_hashes(raw, a, b)


def _candidates(cut_after: np.ndarray, last: np.ndarray, long: np.ndarray, before: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First lines and lines after the last of all chunks, each once: long lines, and for every line the shortest chunks from it and up to it."""
    n = len(cut_after)
    at = np.arange(n)
    cuts = np.flatnonzero(cut_after) + 1  # lines that begin after a boundary
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    top, bottom = before[doc], before[doc + 1]
    pairs = [(at[long], at[long] + 1)]
    # the first boundary that leaves two lines and words enough, and of long lines none but their own chunk
    k = np.searchsorted(cuts, np.maximum(at + 2, np.searchsorted(total, total[:-1] + LEAST_WORDS)))
    to = cuts[np.minimum(k, max(len(cuts) - 1, 0))] if n else at
    good = (k < len(cuts)) & (to <= bottom)
    pairs.append((at[good], to[good]))
    marks = np.unique(np.concatenate([cuts, before[:-1]]))  # lines that a chunk may begin with
    most = np.minimum(at - 1, np.searchsorted(total, total[1:] - LEAST_WORDS, "right") - 1)
    k = np.searchsorted(marks, most, "right") - 1
    since = marks[np.maximum(k, 0)] if n else at
    good = (k >= 0) & (since >= top)
    pairs.append((since[good], at[good] + 1))
    starts, ends = (np.concatenate(x) for x in zip(*pairs))
    both = np.unique(starts * np.int64(n + 1) + ends)
    return both // (n + 1), both % (n + 1)


def _chunks(docs: DataFrame) -> DataFrame:
    """The text's key, place and hash of every chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, first, after, _, _, h = chunks_of(*texts_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(doc)), pa.array(first, pa.int32()), pa.array(after, pa.int32()), pa.array(h.view(np.int64))], names=["key", "first", "after", "hash"])

    return docs.select("key", "text").mapInArrow(run, "key long, first int, after int, hash long")


def _packed(docs: DataFrame, column: str) -> DataFrame:
    """The rows with the text column compressed: texts cross the network so."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, column):
            z = pa.array([None if t is None else packer.compress(t.encode()) for t in part.column(column).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z if n == column else part.column(n) for n in part.schema.names], names=part.schema.names)

    return docs.mapInArrow(run, schema)


def _unpack(z: bytes | None) -> str | None:
    return None if z is None else zstandard.ZstdDecompressor().decompress(z).decode()


def _small(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The same rows, few enough that their texts together are of bounded size, unless one alone is longer."""
    begin = size = 0
    for i, z in enumerate(batch.column(column)):
        n = zstandard.get_frame_parameters(z.as_py()).content_size if z.is_valid else 0
        if i > begin and size + n > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _bodies(marked: DataFrame) -> DataFrame:
    """The texts of the chunks at the places of each row, and of the chunks with a line more on a side where no chunk holds it."""
    names, kinds = ("doc_id", "digest", "first", "after", "body"), (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for d, g, z, places in zip(*(batch.column(c) for c in ("doc_id", "digest", "z", "places"))):
                lines = _unpack(z.as_py()).split("\n")
                spans_ = {(p["first"], p["after"]) for p in places.as_py() if p["after"] <= len(lines)}
                held = {k for a, b in spans_ for k in range(a, b)} | {-1, len(lines)}
                wider = spans_ | {(a - 1, b) for a, b in spans_ if a - 1 not in held} | {(a, b + 1) for a, b in spans_ if b not in held}
                for a, b in sorted(wider):
                    rows.append((d.as_py(), g.as_py(), a, b, "\n".join(lines[a:b])))
                    size += len(rows[-1][4])
                    if size >= SLICE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
            yield batch_of(rows)

    return marked.mapInArrow(run, "doc_id long, digest binary, first int, after int, body string")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with kept_text, n_lines, n_removed_lines and n_removed_chars.

    Defined cases: null text stays null with no lines; an empty text is one empty line; rows that repeat both id and
    text are one document and treated alike; rows that repeat only the id are documents of their own; null ids come
    first; equal chunks of one document are removed but for the first; an empty table gives an empty result.  Existing columns
    of the new names push underscores before the new ones.  A very long text is cut and rebuilt whole, alone in its worker.
    """
    new = {n: free_name(docs, n) for n in ("kept_text", "n_lines", "n_removed_lines", "n_removed_chars")}
    names = {n: free_name(docs, n) for n in ("r_id", "r_digest", "r_lines", "digest")}
    text = F.col(f"`{text_col}`")
    slim = docs.filter(text.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    # a number stands for id and digest where rows are many; texts of equal numbers get each other's places, which bytes then decide
    slim = slim.withColumn("key", F.xxhash64("doc_id", "digest"))
    chunks = stage(_chunks(slim), "chunks")
    place = F.struct("doc_id", "digest", "first")
    repeated = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash").repartition("hash")
    places = chunks.join(repeated, "hash", "left_semi").groupBy(F.col("key").alias("p_key")).agg(F.collect_set(F.struct("first", "after")).alias("places"))
    z = _packed(slim, "text").withColumnRenamed("text", "z")
    marked = z.join(places, F.col("key") == F.col("p_key")).select("doc_id", "digest", "z", "places")
    some = stage(_bodies(marked), "bodies")
    # equal bytes
    # dealt out anew, so that a body that very many places share is a hot key between two plain exchanges, which Spark splits
    equal = some.groupBy("body").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("NOT (lo <=> hi)").select("body", "lo").repartition("body")
    removed = some.select("doc_id", "digest", "first", "after", "body").join(equal, "body").filter(~place.eqNullSafe(F.col("lo"))).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("first", "after")).alias("r_lines"))
    removed = removed.toDF(names["r_id"], names["r_digest"], names["r_lines"])
    out = _packed(docs.withColumn(names["digest"], F.unhex(F.md5(text))), text_col).join(removed, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(names["r_id"])) & (F.col(names["digest"]) == F.col(names["r_digest"])), "left")
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(names["r_lines"]))
    schema = T.StructType([*docs.schema.fields, T.StructField(new["kept_text"], T.StringType()), *(T.StructField(new[n], T.LongType()) for n in ("n_lines", "n_removed_lines", "n_removed_chars"))])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch, text_col):
                texts = [_unpack(x) for x in part.column(text_col).to_pylist()]
                kept, counts = [], []
                for t, gone in zip(texts, part.column(names["r_lines"]).to_pylist()):
                    lines = [] if t is None else t.split("\n")
                    cut = {k for p in gone or () for k in range(p["first"], p["after"])}
                    kept.append(t if not cut else "\n".join(x for k, x in enumerate(lines) if k not in cut))
                    counts.append((len(lines), len(cut), len(t or "") - len(kept[-1] or "")))
                cols = [pa.array(texts, pa.string()) if n == text_col else part.column(n) for n in docs_columns]
                n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), *n], names=[*docs_columns, *new.values()])

    docs_columns = docs.columns
    return out.mapInArrow(rebuild, schema)
