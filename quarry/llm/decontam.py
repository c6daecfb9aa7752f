"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about two megabytes.  Its words become symbols of
the test phrases' alphabet; a word in no phrase becomes a separator, as no occurrence
can cover it.  The shard's FM-index (wavelet matrix over the Burrows-Wheeler transform,
sampled suffix positions) answers all phrases by backward search, occurrences are
located and their word spans merged.  One narrow pass, no exchange; the phrases are
sent in blocks of bounded size.

Defined results: a null or word-free text has no words and no hits; an item without
words has no window; an item of fewer than ``width`` words is one window; repeated
items count each by its ``item_id``, a null one as the string None; a very long text is a
shard of its own; other columns are carried or not read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.kernels import Words, chunks, hash_words, lookup, ranges

WIDTH = 8
#: Bytes of test phrases in one block that is sent to the executors.
BLOCK_BYTES = 32_000_000
#: One text position in so many keeps its suffix position.
SAMPLE = 16
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Phrases:
    """Test phrases: their words as symbols from 1, windows, and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        windows: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = _WORD.findall((text or "").encode().lower())
            for i in range(max(1, len(words) - width + 1) if words else 0):
                windows.setdefault(tuple(words[i : i + width]), set()).add(item)
        vocabulary = sorted({w for x in windows for w in x})
        hashes = hash_words(vocabulary)
        order = np.argsort(hashes, kind="stable")
        self.words = [vocabulary[i] for i in order]
        self.hashes = hashes[order]
        symbol = {w: i + 1 for i, w in enumerate(self.words)}
        self.items = [sorted(x, key=str) for x in windows.values()]
        self.lengths = np.array([len(x) for x in windows], np.int64)
        self.symbols = np.zeros((len(windows), width), np.int64)
        for i, x in enumerate(windows):
            self.symbols[i, : len(x)] = [symbol[w] for w in x]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; each 0 is a sentinel of its own, smaller than any symbol.

    The last value has to be 0, so that any suffix that ties goes on.
    """
    n = len(seq)
    sentinels = np.flatnonzero(seq == 0)
    key = seq.astype(np.int64) + len(sentinels)
    key[sentinels] = np.arange(len(sentinels))
    sa = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = np.diff(key[sa]) != 0
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        tied = ~head
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        i = sa[at]
        one, two = rank[i], rank[i + step]
        order = np.lexsort((two, one))
        i, one, two = i[order], one[order], two[order]
        sa[at] = i
        head[at] = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        rank[i] = np.maximum.accumulate(np.where(head[at], at, 0))
        step *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols, 0 a separator."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        seq = np.concatenate([seq, [0]]).astype(np.int64)
        n = len(seq)
        sa = suffix_array(seq)
        bwt = np.where(sa > 0, seq[sa - 1], 0)
        self.size = n
        self.bits = max(1, int(seq.max()).bit_length())
        self.before = np.zeros((1 << self.bits) + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=1 << self.bits), out=self.before[1:])
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        symbols = np.arange(1 << self.bits)
        self.base = self._down(symbols, np.zeros_like(symbols))
        starts = np.ones(n, bool)
        starts[1:] = seq[:-1] == 0
        kept = starts[sa] | (sa % sample == 0)
        self.kept_before = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=self.kept_before[1:])
        self.samples = sa[kept]

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where rank(c, i) ends in the wavelet matrix."""
        for k in range(self.bits):
            r = self.ones[k][i]
            i = np.where((c >> (self.bits - 1 - k)) & 1, self.zeros[k] + r, i - r)
        return i

    def _step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before[c] + self._down(c, i) - self.base[c]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (which pattern, from, to) of the patterns that occur."""
        alphabet = len(self.before) - 1
        there = np.zeros(max(alphabet, int(patterns.max(initial=0)) + 1), bool)
        there[:alphabet] = np.diff(self.before) > 0
        there[0] = True  # padding
        which = np.flatnonzero(there[patterns].all(axis=1))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.size, np.int64)
        left = lengths[which].copy()
        while len(which) and left.any():
            go = left > 0
            c = patterns[which[go], left[go] - 1]
            lo[go], hi[go] = self._step(c, lo[go]), self._step(c, hi[go])
            left[go] -= 1
            alive = lo < hi
            which, lo, hi, left = which[alive], lo[alive], hi[alive], left[alive]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, i, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            k = self.kept_before[i]
            found = self.kept_before[i + 1] > k
            out[todo[found]] = self.samples[k[found]] + steps
            todo, i = todo[~found], i[~found]
            c, j = np.zeros(len(i), np.int64), i
            for b in range(self.bits):
                r = self.ones[b][j]
                bit = self.ones[b][j + 1] - r
                c = (c << 1) | bit
                j = np.where(bit, self.zeros[b] + r, j - r)
            i = self.before[c] + j - self.base[c]
            steps += 1
        return out


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence of a window in a shard."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(phrases.items) or not len(words.start):
        return none
    symbol = lookup(phrases.hashes, words.hash) + 1
    # runs of symbols that are shorter than the shortest window hold no occurrence
    inside = symbol > 0
    broken = np.ones(len(symbol), bool)
    broken[1:] = ~inside[:-1]
    starts = words.first[:-1]
    broken[starts[starts < len(symbol)]] = True
    run = np.cumsum(broken & inside)
    sizes = np.bincount(run[inside])
    keep = inside & (sizes[np.where(inside, run, 0)] >= phrases.lengths.min()) if len(sizes) else inside
    at = np.flatnonzero(keep)
    if not len(at):
        return none
    fresh = np.concatenate([[0], np.cumsum(run[at][1:] != run[at][:-1])])
    seq = np.zeros(len(at) + fresh[-1] + 1, np.int64)
    where = np.full(len(seq), -1, np.int64)
    seq[np.arange(len(at)) + fresh] = symbol[at]
    where[np.arange(len(at)) + fresh] = at
    index = FMIndex(seq)
    which, lo, hi = index.search(phrases.symbols, phrases.lengths)
    if not len(which):
        return none
    first = where[index.locate(ranges(lo, hi - lo))]
    window = np.repeat(which, hi - lo)
    # the words themselves decide, not their hashes
    covered = np.unique(ranges(first, phrases.lengths[window]))
    raw = words.data.tobytes()
    wrong = [k for k in covered.tolist() if raw[words.start[k] : words.end[k]] != phrases.words[symbol[k] - 1]]
    if wrong:
        bad = np.zeros(len(symbol) + 1, np.int64)
        bad[np.asarray(wrong) + 1] = 1
        bad = np.cumsum(bad)
        good = bad[first + phrases.lengths[window]] == bad[first]
        first, window = first[good], window[good]
    return first, window


class Blocks:
    """Broadcast blocks of phrases, of which a process holds one at a time."""

    def __init__(self, sent: list):
        self.sent = sent

    def __iter__(self) -> Iterator[Phrases]:
        for x in self.sent:
            yield x.value
            if len(self.sent) > 1:
                forget(x)


def forget(sent) -> None:
    """Drop the value that a broadcast variable has read; it can be read again."""
    if getattr(sent, "_path", None):
        sent.__dict__.pop("_value", None)


def scan(column: pa.Array, blocks) -> Iterator[tuple[int, int, list[tuple[int, int]], list[str]]]:
    """(words, hit words, their merged byte spans in the text, items) for each text."""
    for a, b in chunks(column):
        words = Words(column.slice(a, b - a))
        hit = np.zeros(len(words.start) + 1, np.int64)
        items: dict[int, set] = {}
        doc = words.doc_of_word()
        for phrases in blocks:
            first, window = occurrences(words, phrases)
            np.add.at(hit, first, 1)
            np.add.at(hit, first + phrases.lengths[window], -1)
            many = len(phrases.items)
            for pair in np.unique(doc[first] * many + window).tolist():
                items.setdefault(pair // many, set()).update(phrases.items[pair % many])
        covered = np.cumsum(hit[:-1]) > 0
        for d in range(b - a):
            lo, hi = int(words.first[d]), int(words.first[d + 1])
            if d not in items:
                yield hi - lo, 0, [], []
                continue
            at = np.flatnonzero(covered[lo:hi]) + lo
            jump = np.flatnonzero(np.diff(at) != 1)
            heads, tails = at[np.concatenate([[0], jump + 1])], at[np.concatenate([jump, [len(at) - 1]])]
            spans = zip((words.start[heads] - words.at[d]).tolist(), (words.end[tails] - words.at[d]).tolist())
            yield hi - lo, len(at), list(spans), sorted(map(str, items[d]))


def phrase_blocks(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the test phrases, each block of bounded size, read one by one."""
    sc = benchmark.sparkSession.sparkContext
    out, rows, size = [], [], 0

    def send() -> None:
        out.append(sc.broadcast(Phrases(rows, width)))
        forget(out[-1])

    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        if rows and size + len(text or "") > block_bytes:
            send()
            rows, size = [], 0
        rows.append((item, text))
        size += len(text or "")
    send()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    sent = phrase_blocks(benchmark, width)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(sent)
        for batch in batches:
            rows = [(n, hits, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(items) >= min_items) for n, hits, _, items in scan(batch["text"], blocks)]
            n_words, n_hit, n_items, digest, bad = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without byte spans, which are merged and in order."""
    raw, out, last = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]]).decode()


def cut_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = 2) -> DataFrame:
    """The documents without contaminated ones; where less leaks, the merged spans go from the text.

    All columns stay; ``n_chars`` follows the new text if there is such a column.
    """
    sent = phrase_blocks(benchmark, width)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(sent)
        for batch in batches:
            keep, changed = [], {}
            for row, (_, _, spans, items) in enumerate(scan(batch["text"], blocks)):
                keep.append(len(items) < min_items)
                if spans and keep[-1]:
                    changed[row] = spans
            if changed:
                texts = batch["text"].to_pylist()
                for row, spans in changed.items():
                    texts[row] = remove_spans(texts[row], spans)
                arrays = [pa.array(texts, x.type) if n == "text" else x for n, x in zip(names, batch.columns)]
                if "n_chars" in names:
                    counts = batch["n_chars"].to_pylist()
                    counts = [len(texts[i]) if i in changed else x for i, x in enumerate(counts)]
                    arrays[names.index("n_chars")] = pa.array(counts, batch["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(cut, docs.schema)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i : i + 7], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
