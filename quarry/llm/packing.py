"""Token ids in a bit-plane shuffled binary store.

The store is a table of records in ascending document order, written by Spark's own
writer (any store, committed whole, safe when executors are lost).  A record holds the
ids of consecutive documents, cut into blocks of ``BLOCK`` ids.  Each block is
transposed into bit or byte planes, each plane is compressed with zstandard, and the
record's chunk index says where each plane lies; so any block can be read alone.

Defined results: a null text counts as empty and gives just the end id; rows of one
doc_id follow each other, ordered by a hash of the text, which also parts the rows of a
hot one among tasks; a null doc_id comes first; a very long text is encoded alone; other
columns are not read; an empty table gives an empty store.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import doc_texts, parts
from quarry.llm.kernels import chunks, ranges, strings, utf8

BLOCK = 65536
END_ID = 2
#: Ids in a record before the next document starts another one.
RECORD_IDS = 1 << 20
#: Parts of words whose ids a worker remembers.
CACHE = 400_000
_PUNCTUATION = ".,!?;:#$%&*()"
#: Letters in every Unicode version, none of which combines with what follows; the lower
#: case of U+0130 is two characters, the second a mark, so it is left to the tokenizer.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
#: magic, format version, planes, blocks, ids
_HEAD = struct.Struct("<4sBBII")


def pack(ids: np.ndarray, planes: str = "byte", level: int = 1, block: int = BLOCK) -> bytes:
    """Header, chunk index (compressed bytes of each plane of each block), planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    squeeze = zstandard.ZstdCompressor(level=level)
    width = 4 if planes == "byte" else 32
    sizes, body = [], []
    for a in range(0, len(ids), block):
        part = ids[a : a + block].view(np.uint8).reshape(-1, 4)
        if planes == "bit":
            rows = np.unpackbits(part, axis=1, bitorder="little").T
            cut = [np.packbits(x, bitorder="little").tobytes() for x in rows]
        else:
            cut = [x.tobytes() for x in np.ascontiguousarray(part.T)]
        for x in cut:
            body.append(squeeze.compress(x) if any(x) else b"")  # a plane of zeros takes no bytes
            sizes.append(len(body[-1]))
    head = _HEAD.pack(b"BPSH", 1, width, (len(ids) + block - 1) // block, len(ids)) + struct.pack("<I", block)
    return b"".join([head, np.array(sizes, "<u4").tobytes(), *body])


def unpack(data: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of all blocks, or of the blocks asked for."""
    magic, version, width, n_blocks, n = _HEAD.unpack_from(data)
    if (magic, version) != (b"BPSH", 1):
        raise ValueError("not a packed id record of version 1")
    (block,) = struct.unpack_from("<I", data, _HEAD.size)
    at = _HEAD.size + 4
    sizes = np.frombuffer(data, "<u4", n_blocks * width, at).astype(np.int64)
    begin = at + 4 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)])
    loosen = zstandard.ZstdDecompressor()
    out = []
    for k in blocks if blocks is not None else range(n_blocks):
        rows = min(block, n - k * block)
        planes = []
        for j in range(k * width, (k + 1) * width):
            piece = loosen.decompress(data[begin[j] : begin[j + 1]]) if sizes[j] else bytes(rows if width == 4 else (rows + 7) // 8)
            planes.append(np.frombuffer(piece, np.uint8))
        if width == 32:
            bits = np.stack([np.unpackbits(x, count=rows, bitorder="little") for x in planes], axis=1)
            raw = np.packbits(bits, axis=1, bitorder="little")
        else:
            raw = np.stack(planes, axis=1)
        out.append(np.ascontiguousarray(raw).view("<u4").ravel())
    return np.concatenate(out) if out else np.empty(0, "<u4")


class Encoder:
    """Encodes texts with a tokenizers file whose tokens never cross white space.

    Such a text's ids are those of its space-separated words, one after another, so each
    distinct word is encoded once.  A word of letters and then punctuation is two tokens
    of the file's splitter, and the file drops the case, so both parts are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.clear()

    def clear(self) -> None:
        """Part of a word -> its place; ids of places lie one after another in the pool."""
        self.place: dict[str, int] = {"": 0}
        self.first, self.counts, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str], letters: bool) -> None:
        if not words:
            return
        if letters:
            # one text of many words: each is one token of the splitter, whose last id ends a word
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(words):
                return self._learn(words, False)
            counts = np.diff(ends, prepend=0)
        else:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            ids = np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(counts.sum()))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.pool = np.concatenate([self.pool, ids])

    def _places(self, parts: pa.Array, letters: np.ndarray | None = None) -> np.ndarray:
        found = parts.dictionary_encode()
        spelled = strings(found.dictionary)
        if letters is None:
            self._learn([w for w in spelled if w not in self.place], False)
        else:
            code = np.asarray(found.indices)
            plain = np.zeros(len(spelled), bool)
            plain[code] = letters
            new = [(w, p) for w, p in zip(spelled, plain.tolist()) if w not in self.place]
            plain_words = [w for w, p in new if p]
            for a in range(0, len(plain_words), 2048):
                self._learn(plain_words[a : a + 2048], True)
            self._learn([w for w, p in new if not p], False)
        return np.fromiter(map(self.place.__getitem__, spelled), np.int64, len(spelled))[np.asarray(found.indices)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each text has."""
        if len(self.place) > CACHE:
            self.clear()
        texts = pc.replace_substring(pc.fill_null(column, ""), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        whole = words.dictionary
        core = pc.utf8_rtrim(whole, characters=_PUNCTUATION)
        letters = pc.match_substring_regex(core, _LETTERS)
        flags = np.asarray(letters)
        core = pc.if_else(letters, pc.ascii_lower(core), whole)
        raw, at = utf8(whole)
        tail = np.asarray(pc.binary_length(whole), np.int64) - np.asarray(pc.binary_length(core), np.int64)
        cut = np.concatenate([[0], np.cumsum(tail)])
        data = raw[ranges(at[1:] - tail, tail)]
        suffix = pa.LargeStringArray.from_buffers(len(tail), pa.py_buffer(cut.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
        place = np.stack([self._places(core, flags), self._places(suffix)], axis=1)
        code = np.asarray(words.indices)
        each = place[code].ravel()
        counts = self.counts[each]
        flat = self.pool[ranges(self.first[each], counts)]
        ends = np.concatenate([[0], np.cumsum(counts.reshape(-1, 2).sum(axis=1))])
        at = np.asarray(lists.offsets, np.int64)
        return flat, np.diff(ends[at - at[0]])


_KEPT: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, so that a task goes on with the words that earlier ones learned."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, planes: str = "byte") -> None:
    """Encode whole texts and write the store: part, record, doc_ids, n_tokens, ids."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        part, record, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            docs_, counts, ids = [i for x in held for i in x[0]], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            arrays = [pa.array([part], pa.int32()), pa.array([record], pa.int32()), pa.array([docs_], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, planes)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "record", "doc_ids", "n_tokens", "before", "n_ids", "ids"])

        for batch in batches:
            for a, b in chunks(batch["text"]):
                flat, counts = encoder.encode(batch["text"].slice(a, b - a))
                ids = np.full(len(flat) + len(counts), end_id, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
                held.append((batch["doc_id"].slice(a, b - a).to_pylist(), counts + 1, ids))
                size = sum(len(x[2]) for x in held)
                if size >= RECORD_IDS:
                    yield flush()
                    held, record, before = [], record + 1, before + size
        if held:
            yield flush()

    ordered = doc_texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(parts(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(encode, "part int, record int, doc_ids array<long>, n_tokens array<long>, before long, n_ids long, ids binary").write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, all from the store."""
    store = spark.read.parquet(path)
    # one row per partition of the writer; within one, records know what lies before them
    sizes = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    rows = store.join(F.broadcast(before), "part").select("doc_ids", "n_tokens", (F.col("part_start") + F.col("before")).alias("start"), "ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, n_tokens, start, data in zip(*(b[c] for c in ("doc_ids", "n_tokens", "start", "ids"))):
                ids = unpack(data.as_py())
                counts = np.array(n_tokens.as_py(), np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids.as_py(), pa.int64()), pa.array(ends - counts + start.as_py()), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
