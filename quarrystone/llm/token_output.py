"""Token ids in binary shards: independent zstandard frames with a trailing seek table.

A shard is, in order:

* data frames: each a complete zstandard frame over little-endian unsigned 32-bit ids.  Documents are cut nowhere,
  unless one alone is longer than a frame;
* one skippable frame (magic 0x184D2A50): a zstandard frame over the document index, 32 bytes a document: id (int64),
  position of its first id in the shard (uint64), number of ids (uint64), crc32 of the id bytes (uint32), flags
  (uint32: 1 for a null id, which stands first and has 0 in its place);
* one skippable frame (magic 0x184D2A5E): the seek table of the public zstandard seekable format, an entry of
  compressed size, decompressed size and checksum (low 32 bits of XXH64 of the content) for each frame before, and a
  footer of 9 bytes.

A reader fetches the table from the end of the file, the index, and then only the frames that hold what it is asked for.
"""

from __future__ import annotations

import json
import os
import re
import struct
import threading
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, slices, texts_of

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL = 1
FRAME_BYTES = 1 << 20
#: Chunks of text whose ids a worker remembers; then it starts anew.  Bytes (or, of one text, characters) encoded together.
REMEMBERED = 600_000
SLICE = 8_000_000
_ENTRY = struct.Struct("<III")
INDEX = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n", "<u8"), ("crc", "<u4"), ("flags", "<u4")])


class ShardWriter:
    """Writes one shard to an open binary file; memory is bounded by one frame or one document."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.size = self.at = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.pending and self.size + len(ids) > self.frame_bytes:
            self._flush()
        self.index.append((doc_id or 0, self.at // 4, len(ids) // 4, zlib.crc32(ids), NULL if doc_id is None else 0))
        self.at += len(ids)
        for i in range(0, len(ids), self.frame_bytes):
            self.pending.append(ids[i : i + self.frame_bytes])
            self.size += len(self.pending[-1])
            if self.size >= self.frame_bytes:
                self._flush()

    def _flush(self) -> None:
        if self.size:
            self._frame(b"".join(self.pending))
        self.pending, self.size = [], 0

    def _frame(self, raw: bytes, skippable: bool = False) -> None:
        packed = self.packer.compress(raw)
        if skippable:
            packed = struct.pack("<II", INDEX_MAGIC, len(packed)) + packed
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, INDEX).tobytes(), skippable=True)
        entries = b"".join(_ENTRY.pack(*e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class ShardReader:
    """Random access to one shard: ``source`` has ``seek`` and ``read``.  Every frame is checked against its checksum."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        source.seek(size - 9 - n * _ENTRY.size)
        self.table = list(_ENTRY.iter_unpack(source.read(n * _ENTRY.size)))
        self.offsets = np.cumsum([0, *(e[0] for e in self.table)])
        self.begins = np.cumsum([0, *(e[1] for e in self.table[:-1])])
        self.index = np.frombuffer(self._read(n - 1, 8), INDEX)
        self._last: tuple[int, bytes] = (-1, b"")

    def _read(self, k: int, skip: int = 0) -> bytes:
        packed, size, check = self.table[k]
        self.source.seek(int(self.offsets[k]) + skip)
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed - skip), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def ids(self, k: int) -> bytes:
        """The id bytes of the index's ``k``-th document; only its frames are read."""
        begin, length = int(self.index["start"][k]) * 4, int(self.index["n"][k]) * 4
        out, end = [], begin + length
        f = int(np.searchsorted(self.begins, begin, "right")) - 1
        while begin < end:
            if self._last[0] != f:
                self._last = (f, self._read(f))
            base = int(self.begins[f])
            out.append(self._last[1][begin - base : end - base])
            begin, f = begin + len(out[-1]), f + 1
        return b"".join(out)

    def find(self, doc_id: int | None) -> Iterator[bytes]:
        """Ids of every document of that id (the index has null ids first, then ascending ones)."""
        nulls = int((self.index["flags"] & NULL).sum())
        a, b = (0, nulls) if doc_id is None else (nulls + np.searchsorted(self.index["doc_id"][nulls:], doc_id, side) for side in ("left", "right"))
        yield from map(self.ids, range(a, b))


#: Pieces that the library's model can take without its splitter.
_UNIT = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")

# Classes of bytes: what parts chunks, ASCII letters, digits, other visible ASCII but the apostrophe, and the rest.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[39]] = _ODD
_CLASS[[10, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def units_of(raw: np.ndarray, at: np.ndarray, special: Sequence[bytes] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, where each piece between spaces begins (and the last ends), and which pieces are spaces.

    Pieces are runs of Latin-1 letters, single digits, runs of other visible ASCII, and spaces; a chunk between spaces that
    holds any other character, or a special token, is one piece, as it is.
    """
    n = len(raw)
    kind = _CLASS[raw]
    low = _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[lead + 1]
    good = (after != 0x97) & (after != 0xB7)
    lead, after = lead[good], after[good]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = np.where(after < 0x9F, after + 32, after)
    odd = kind == _ODD
    data = raw.tobytes() if special else b""
    for token in special:
        k = data.find(token)
        while k >= 0:
            odd[k] = True
            k = data.find(token, k + 1)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut[at] = True
    if odd.any():
        space = np.empty(n + 1, bool)
        space[:n], space[n] = kind == _SPACE, True
        edge = cut & (space | np.concatenate([[True], space[:-1]]))
        edge[at] = True
        edges = np.flatnonzero(edge)
        whole = np.unique(np.searchsorted(edges, np.flatnonzero(odd), "right") - 1)
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, edges[whole] + 1, 1)
        np.add.at(inside, edges[whole + 1], -1)
        cut &= np.cumsum(inside, dtype=np.int8) == 0
        inside[:] = 0
        np.add.at(inside, edges[whole], 1)
        np.add.at(inside, edges[whole + 1], -1)
        low = np.where(np.cumsum(inside[:n], dtype=np.int8) > 0, raw, low)
    begin = np.flatnonzero(cut)
    return low, begin, kind[begin[:-1]] == _SPACE


# The normalizer and the splitter, as tokenizer files write them, of word-level BPE that drops white space.
WORD_LEVEL = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, text by text equal to encoding the text as a whole.

    Word-level tokenizers, known by the rules in their file (``WORD_LEVEL``), split at white space and drop it: a text's
    ids are those of its chunks between spaces or line feeds in a row, and a chunk that comes again need not be encoded
    again.  Chunks of plain letters, digits and punctuation are cut by ``units_of`` as that splitter cuts them, and the
    library's model encodes the pieces, many at a time; every other chunk goes through the whole tokenizer.  Texts of any
    other tokenizer are encoded as a whole.

    Special tokens' strings in a text become the special tokens, as the library has it, unless ``encode_special_tokens``.
    A worker holds the ids of about ``REMEMBERED`` pieces, and those of one slice; a longer text goes through in parts.
    """

    def __init__(self, path: str, end_id: int, encode_special_tokens: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.plain, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens, self.model.encode_special_tokens = encode_special_tokens, True
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        rules = json.loads(self.plain.to_str())
        added = self.plain.get_added_tokens_decoder().values()
        self.special = () if encode_special_tokens else tuple(t.content.encode() for t in added)
        self.by_chunk = (rules["normalizer"], rules["pre_tokenizer"]) == WORD_LEVEL and rules["post_processor"] is None and not any(t.lstrip or t.rstrip or t.single_word or " " in t.content or "\n" in t.content for t in added)
        self.end_id = end_id
        # ids that end a word
        self.last = np.zeros(self.plain.get_vocab_size(), bool)
        for token, i in self.plain.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        """Chunk number k has the ids flat[first[k] : first[k + 1]]; number 0 is the end of a text."""
        self.number: dict[str, int] = {}
        self.flat, self.first = np.array([self.end_id], "<u4"), np.array([0, 1], np.int64)

    def alone(self, chunk: str) -> bytes:
        return np.array(self.plain.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of the pieces that ``units_of`` cuts, as little-endian bytes."""
        out: list[bytes] = [b""] * len(pieces)
        plain = []
        for k, x in enumerate(pieces):
            # a run of one class; what comes from the whole tokenizer holds something else, or a special token
            if x.isalpha() and x.isascii() or _UNIT.fullmatch(x):
                plain.append(k)
            else:
                out[k] = self.alone(x)
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            ids = np.array(self.model.encode_batch_fast([" ".join([pieces[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            for k, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                out[k] = raw[a:b]
        return out

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each of different pieces."""
        if len(self.number) > REMEMBERED:
            self._forget()
        get = self.number.get
        out = np.array([get(x, -1) for x in pieces], np.int64)
        if len(at := np.flatnonzero(out < 0)):
            new = [pieces[i] for i in at.tolist()]
            ids = self.pieces(new)
            out[at] = np.arange(len(new)) + len(self.first) - 1
            self.number.update(zip(new, out[at].tolist()))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) // 4 for x in ids])])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        return out

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of the texts in a row, 0 after each text, and how many before each text."""
        raw, at = texts_of(texts)
        low, begin, space = units_of(raw, at, self.special)
        words = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(low)).dictionary_encode()
        which = self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()][~space]
        before = np.concatenate([[0], np.cumsum(~space)])[np.searchsorted(begin, at)]
        return np.insert(which, before[1:], 0), before + np.arange(len(before))

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, an end after each text, and where each text's begin and the last ends; null: empty."""
        if not self.by_chunk:
            raw = [self.alone(t or "") + self.flat[:1].tobytes() for t in texts.to_pylist()]
            return np.frombuffer(b"".join(raw), "<u4"), np.cumsum([0, *(len(x) // 4 for x in raw)])
        which, at = self.numbered(texts)
        begin = self.first[which]
        length = self.first[which + 1] - begin
        before = np.concatenate([[0], np.cumsum(length)])
        return self.flat[np.repeat(begin - before[:-1], length) + np.arange(before[-1])], before[at]

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text, with the end id, as little-endian bytes; null: empty."""
        column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
        ids, at = self.arrays(column)
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        return [bytes(raw[a:b]) for a, b in zip((at[:-1] * 4).tolist(), (at[1:] * 4).tolist())]

    def encode_long(self, text: str) -> bytes:
        """As ``encode`` for one text that is longer than a slice."""
        if not self.by_chunk:
            return self.encode([text])[0]
        out, at = [], 0
        while at < len(text):
            ends = [k for k in (text.find(" ", at + SLICE), text.find("\n", at + SLICE)) if k >= 0]
            end = min(ends, default=len(text))
            out.append(self.encode([text[at:end]])[0][:-4])
            at = end + 1
        return b"".join([*out, self.flat[:1].tobytes()])


_encoders: dict[tuple, ChunkEncoder] = {}
_timer: threading.Timer | None = None
#: A worker that has encoded nothing for so many seconds gives the memory of its encoder back (workers outlive stages).
IDLE_S = 8.0


def encoder(path: str, end_id: int, encode_special_tokens: bool = False) -> ChunkEncoder:
    """One encoder a Python worker, until another tokenizer is asked for or the worker is idle."""
    global _timer
    key = path, end_id, encode_special_tokens
    if _timer is not None:
        _timer.cancel()
    _timer = threading.Timer(IDLE_S, _encoders.clear)
    _timer.daemon = True
    _timer.start()
    if key not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders.clear()
        _encoders[key] = ChunkEncoder(*key)
    return found if (found := _encoders.get(key)) else ChunkEncoder(*key)


def forget_encoders() -> None:
    """Gives the memory of this worker's encoder back at once, without waiting until it is idle."""
    if _timer is not None:
        _timer.cancel()
    _encoders.clear()


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_shards(docs: DataFrame, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", encode_special_tokens: bool = False, path: str | None = None, n_shards: int | None = None) -> tuple[str, list[dict]]:
    """Encodes every text, with ``end_id`` after it, and writes the shards in ascending order of ids, null first.

    Returns their folder and, for each shard, its number, file, documents and ids.  A shard's file appears whole by
    a rename and is the same whichever attempt wrote it, so lost or repeated tasks do no harm.  ``path`` must be a folder
    that all machines see, as a URI pyarrow can open; by default a new one in the shared folder.

    Defined cases: null and empty texts are their end id alone; rows that repeat an id stand one after another, ordered by a hash of
    the text and the text; null ids stand first; other columns, whatever their names, play no part; a text longer than
    a slice is encoded in pieces cut at spaces, and its ids are cut into frames; an empty table gives no shards.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    n = n_shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        writer = out = None
        for part in slices(batches, "text", SLICE):
            if writer is None:
                fs, root = _open_fs(path)
                fs.create_dir(root, recursive=True)
                name, temporary = f"{root}/shard-{shard:06d}.zst", f"{root}/.shard-{shard:06d}-{attempt}"
                out = fs.open_output_stream(temporary)
                writer = ShardWriter(out)
            own, texts = encoder(tokenizer, end_id, encode_special_tokens), part.column("text")
            long = part.num_rows == 1 and texts[0].is_valid and len(texts[0].as_py()) > SLICE
            for i, raw in zip(part.column("doc_id").to_pylist(), [own.encode_long(texts[0].as_py())] if long else own.encode(texts)):
                writer.add(i, raw)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{path}/shard-{shard:06d}.zst"], "docs": [len(writer.index)], "ids": [writer.at // 4]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    # one row a shard
    shards = ordered.mapInArrow(run, "shard int, file string, docs long, ids long").collect()
    return path, sorted((r.asDict() for r in shards), key=lambda r: r["shard"])


def read_shards(spark: SparkSession, shards: list[dict], with_ids: bool = False) -> DataFrame:
    """What the files hold: doc_id, start (ids before it in all shards), n_tokens, ids_crc32, and the id bytes if asked for.

    No shards give an empty result; a frame or a document that differs from its checksum is an error.
    """
    starts, before = [], 0
    for s in shards:
        starts.append((s["shard"], s["file"], before))
        before += s["ids"]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not starts:
        return spark.createDataFrame([], kind)
    files = spark.createDataFrame(starts, "shard int, file string, before long").repartitionByRange(len(starts), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                fs, at = _open_fs(file)
                with fs.open_input_file(at) as source:
                    reader = ShardReader(source, source.size())
                    step = 256 if with_ids else 4096
                    for i in range(0, len(reader.index), step):
                        rows = reader.index[i : i + step]
                        raws = [reader.ids(k) for k in range(i, i + len(rows))]
                        crcs = [zlib.crc32(x) for x in raws]
                        if crcs != rows["crc"].tolist():
                            raise ValueError(f"{file}: ids differ from the index")
                        cols = [pa.array(rows["doc_id"], pa.int64(), mask=(rows["flags"] & NULL) == 1), pa.array(rows["start"].astype(np.int64) + base), pa.array([len(x) // 4 for x in raws], pa.int64()), pa.array(crcs, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        yield pa.RecordBatch.from_arrays([*cols, *([pa.array(raws, pa.binary())] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

    return files.mapInArrow(run, kind)
