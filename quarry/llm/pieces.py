"""Sampled segmentation over the piece lattice, lossless both ways.

A text is cut before each space; the space belongs to the word that follows (written
as the piece mark).  Within a word the lattice has an edge for every piece of the
vocabulary that spells a substring, and byte pieces for a character that none ends with.  Forward
filtering sums the weights of all paths to each position, once per distinct word;
backward sampling then walks each occurrence from its end, with random numbers that are
a function of the row's key, the word's place and the step alone.  So the same row gives
the same ids wherever and however often it is run.

The model file ranks its pieces, so a piece of rank r gets the Zipf weight
``(r + 1) ** -alpha``; a larger ``alpha`` (an inverse temperature) samples fewer
segmentations other than the likeliest.

Defined results: a null or empty text has no pieces and decodes to the empty text; a
mark character in the text is spelled in bytes, so decoding gives back any text;
repeated rows get equal ids; a null ``doc_id`` counts as the key -1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import doc_texts, release
from quarry.llm.kernels import CHUNK_BYTES, _powers, chunks, lookup, mix, strings, utf8

MARK = "▁"
ALPHA = 1.0
#: Words whose lattices are filtered in one step; the tables stay in the processor's cache.
BLOCK_WORDS = 4096
#: Text at once in the pipeline, whose workers and JVM hold what earlier stages left: tables take about 100 bytes a byte.
STAGE_BYTES = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Lattices:
    """Forward filtering over the lattices of many distinct words at once."""

    SLOT_BITS = 22

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled: list[bytes] = []
        self.byte = np.zeros(256, np.int64)
        pieces: list[tuple[str, int, float]] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.spelled.append(b"")
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.spelled[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or MARK in piece[1:]):
                self.spelled[i] = piece.replace(MARK, " ").encode()
                pieces.append((piece.replace(MARK, " "), i, (1.0 - model.get_score(i)) ** -alpha))
        #: the weight of a byte, below any piece's
        self.byte_weight = (2.0 + len(self.spelled)) ** -alpha
        self.longest = max(len(p) for p, _, _ in pieces)
        hashes = np.zeros(len(pieces), np.uint64)
        for k, (p, _, _) in enumerate(pieces):
            hashes[k] = self._totals(self._points(p))[-1]
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([pieces[k][1] for k in order], np.int32)
        self.weights = np.array([pieces[k][2] for k in order])
        slots = (self.hashes >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        self.slot = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.slot[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]  # the first of a slot
        self.shared = np.bincount(slots, minlength=1 << self.SLOT_BITS) > 1

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), "<u4")

    @staticmethod
    def _totals(points: np.ndarray) -> np.ndarray:
        """Running sums whose differences, divided by a power, are hashes of substrings."""
        p, _ = _powers(len(points) + 1)
        out = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix((points.astype(np.uint64) + np.uint64(1)) * _GOLD) * p[: len(points)], out=out[1:])
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the pieces with these hashes, -1 where there is none."""
        slot = (hashes >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        k = self.slot[slot]
        miss = np.flatnonzero((k >= 0) & (self.hashes[k] != hashes))
        k[miss] = -1
        again = miss[self.shared[slot[miss]]]
        k[again] = lookup(self.hashes, hashes[again])
        return k

    def build(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The node at each word's end, and of all edges, by the node they lead to: the
        cumulative share within the node plus the node's number, the node they start at,
        the piece (or a character's coded bytes, negative) and how many ids it has.

        Nodes count from 1, by place in the word, longer words first; 0 is any word's start.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = self._points("".join(words))
        total = self._totals(points)
        _, inverse = _powers(len(points) + 1)
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(len(points)) - np.repeat(starts, sizes)
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        longest = int(sizes.max(initial=0))
        alive = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
        first = np.concatenate([[0], np.cumsum(alive)])
        at = first[inside] + np.repeat(place, sizes)  # where a character's row is
        wide = self.longest
        weight = np.zeros((len(points), wide), np.float32)
        piece = np.zeros((len(points), wide), np.int32)
        end = np.arange(len(points))
        for n in range(1, wide + 1):
            end = end[inside[end] >= n - 1]
            if not len(end):
                break
            begin = end - (n - 1)
            k = self._find((total[end + 1] - total[begin]) * inverse[begin])
            ok = np.flatnonzero(k >= 0)
            row, k = at[end[ok]], k[ok]
            weight[row, n - 1] = self.weights[k]
            piece[row, n - 1] = self.ids[k]
        lone = np.flatnonzero(~piece.any(axis=1))
        many, coded = np.ones(len(points), np.int64), np.zeros(len(points), np.int64)
        if len(lone):
            point = np.empty(len(points), "<u4")
            point[at] = points
            raw = [chr(c).encode() for c in point[lone].tolist()]
            many[lone] = list(map(len, raw))
            coded[lone] = [-1 - int.from_bytes(r, "big") for r in raw]
            weight[lone, 0] = self.byte_weight ** many[lone].astype(float)
            piece[lone, 0] = -1
        # all words in step; the newest total is scaled to one each time
        recent = np.zeros((len(words), wide))
        recent[:, 0] = 1.0
        for step, n in enumerate(alive.tolist()):
            row = weight[first[step] : first[step] + n]
            part = np.cumsum(row * recent[:n], axis=1)
            whole = part[:, -1:]
            np.divide(part, whole, out=row, casting="same_kind")
            recent[:n, 1:] = recent[:n, :-1] / whole
            recent[:n, 0] = 1.0
        flat = np.flatnonzero(piece)
        to, back = flat // wide, flat % wide
        share = weight.ravel()[flat] + (to + 1.0)
        share[np.append(to[1:] != to[:-1], True)] = to[np.append(to[1:] != to[:-1], True)] + 2.0
        step = np.repeat(np.arange(longest), alive)[to]
        source = np.where(step == back, 0, first[np.maximum(step - 1 - back, 0)] + to - first[step] + 1)
        found = piece.ravel()[flat].astype(np.int64)
        found = np.where(found < 0, coded[to], found)
        ends = np.where(sizes > 0, first[np.maximum(sizes - 1, 0)] + place + 1, 0)
        return ends, [share, source, found, np.where(found < 0, many[to], 1)]


def _draws(seed: np.ndarray, step: int) -> np.ndarray:
    """Uniform in [0, 1), from the seed of each walk and the step."""
    return (mix(seed + np.uint64(step * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Sampler:
    def __init__(self, path: str, alpha: float = ALPHA, seed: int = 0):
        self.lattices = Lattices(path, alpha)
        self.seed = np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        self.spelled = pa.array(self.lattices.spelled, pa.large_binary())
        self.byte = self.lattices.byte

    def encode(self, column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) and how many each text has."""
        texts = pc.fill_null(column, "")
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        code = np.asarray(words.indices, np.int64)
        at = np.asarray(lists.offsets, np.int64)
        at = at - at[0]
        spelled = strings(words.dictionary)
        first = np.zeros(len(code), bool)
        first[at[:-1]] = True
        # a word at the very start of a text has no space before it
        heads = np.unique(code[first])
        tables, size = [], 0
        spell = [" " + w for w in spelled] + [spelled[i] for i in heads]
        ends = []
        for a in range(0, len(spell), BLOCK_WORDS):
            end, table = self.lattices.build(spell[a : a + BLOCK_WORDS])
            # nodes of one block follow those of the blocks before it
            table[0] += size
            table[1][table[1] > 0] += size
            end[end > 0] += size
            size += sum(map(len, spell[a : a + BLOCK_WORDS]))
            ends.append(end)
            tables.append(table)
        ends = np.concatenate(ends)
        share, source, piece, count = (np.concatenate(x) for x in zip(*tables))
        node = ends[: len(spelled)][code]
        plain = np.zeros(len(spelled), np.int64)
        plain[heads] = ends[len(spelled) :]
        node[first] = plain[code[first]]
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(code)) - at[:-1][doc]
        seeds = mix(mix(keys.astype(np.int64).view(np.uint64) + self.seed)[doc] ^ (place.astype(np.uint64) * _GOLD))
        walks, got = [], []
        todo = np.flatnonzero(node)
        todo = todo[np.argsort(node[todo])]  # equal words side by side: the same places of the tables
        step = 0
        while len(todo):
            here = node[todo]
            e = np.searchsorted(share, here + _draws(seeds[todo], step), side="right")
            walks.append(todo)
            got.append(e)
            node[todo] = source[e]
            todo = todo[node[todo] > 0]
            step += 1
        if not walks:
            return np.empty(0, np.int32), np.zeros(len(at) - 1, np.int64)
        steps = np.bincount(np.concatenate(walks), minlength=len(code))
        # walks go backwards: the s-th edge of a walk is the s-th last of its word
        ends = np.cumsum(steps)
        edges = np.empty(ends[-1], np.int64)
        for s, (w, e) in enumerate(zip(walks, got)):
            edges[ends[w] - 1 - s] = e
        ids, n_ids = piece[edges], count[edges]
        word_ids = np.bincount(np.repeat(np.arange(len(code)), steps), weights=n_ids, minlength=len(code)).astype(np.int64)
        if (ids < 0).any():
            ids = self._bytes(ids, n_ids)
        totals = np.concatenate([[0], np.cumsum(word_ids)])
        counts = np.diff(totals[at])
        counts[empty] = 0
        return ids.astype(np.int32), counts

    def _bytes(self, ids: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
        """Characters kept as code are spelled in byte pieces."""
        out = np.repeat(ids, n_ids)
        at = np.cumsum(n_ids) - n_ids
        odd = np.flatnonzero(ids < 0)
        for k in range(4):
            some = odd[n_ids[odd] > k]
            value = (-1 - ids[some]) >> (8 * (n_ids[some] - 1 - k))
            out[at[some] + k] = self.byte[value & 255]
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and ``len + 1`` offsets."""
        pieces = self.spelled.take(pa.array(ids))
        raw, at = utf8_bytes(pieces)
        return raw, at[np.concatenate([[0], np.cumsum(counts)])]


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, at - at[0]


def _worked(batch: pa.RecordBatch, sampler: Sampler, limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(rows, ids, counts, decoded bytes and offsets, texts' bytes and offsets) for each run of rows of so many bytes."""
    for a, b in chunks(batch["text"], limit):
        column = batch["text"].slice(a, b - a)
        keys = np.asarray(pc.fill_null(batch["doc_id"].slice(a, b - a).cast(pa.int64()), -1))
        ids, counts = sampler.encode(column, keys)
        yield slice(a, b), ids, counts, *sampler.decode(ids, counts), *utf8(column)


def segment(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (ids as little-endian unsigned 32-bit), text_crc32 of
    the decoded text, n_bytes of it, lossless (it is the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model, alpha, seed)
        for batch in batches:
            for rows, ids, counts, raw, at, text, text_at in _worked(batch, sampler):
                ends = np.cumsum(counts) * 4
                whole, out, was = ids.astype("<u4").tobytes(), raw.tobytes(), text.tobytes()
                crc = [zlib.crc32(whole[e - 4 * n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
                decoded = [out[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                same = [x == was[i:j] for x, i, j in zip(decoded, text_at[:-1].tolist(), text_at[1:].tolist())]
                arrays = [batch["doc_id"].slice(rows.start, rows.stop - rows.start), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(map(zlib.crc32, decoded), pa.int64()), pa.array(map(len, decoded), pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_pieces", "pieces_crc32", "text_crc32", "n_bytes", "lossless"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_pieces long, pieces_crc32 long, text_crc32 long, n_bytes long, lossless boolean")


def encode_documents(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """The documents with ``text`` as decoded from the sampled ids, and ``piece_ids`` (array<int>)."""
    docs = docs.drop("piece_ids")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model, alpha, seed)
        release()
        for batch in batches:
            for rows, ids, counts, raw, at, _, _ in _worked(batch, sampler, STAGE_BYTES):
                part = batch.slice(rows.start, rows.stop - rows.start)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.large_string()).cast(part["text"].type)
                text = pc.if_else(pc.is_null(part["text"]), pa.scalar(None, text.type), text)
                pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                columns = [text if n == "text" else part[n] for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pieces], names=[*names, "piece_ids"])
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))
