"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of rows of one task, up to SHARD_BYTES bytes of text (more only for one longer text), whatever Arrow
batches they came in. Its text is the sequence of the rows' words over the alphabet of the benchmark's words; every stretch that can hold no phrase (words outside the alphabet, or
runs shorter than the shortest phrase) is one separator, which changes no occurrence. The suffix array of that sequence
gives the Burrows-Wheeler transform, kept as a wavelet matrix; all phrases are searched backward at once through its
ranks, occurrences are located by walking back to sampled suffix positions, and overlapping occurrences are merged into
removal spans.

A phrase is a window of `width` consecutive benchmark words; an item of fewer words, but not none, is one phrase.
Phrases go to the executors as one broadcast for each block of about `block_phrases`; every shard is searched for all
blocks, of which a task holds one at a time, in one pass over the documents. The hits of all blocks are united row by
row, and removal cuts them together and looks again for all blocks, so results do not depend on how phrases are dealt.

Defined results: null or empty texts have no words and no hits; empty tables give empty results or no hits; repeated
rows are searched one by one; null item_ids mark words but are not counted as items; repeated item_ids count once; other
columns are ignored (`find`) or passed on (`remove`); texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, numbered, pick, text_bytes

WIDTH = 10
SHARD_BYTES = 1 << 22
BLOCK_PHRASES = 200_000
_SAMPLE = 16
_PIECE = 1 << 22
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
END, GAP = 0, 1


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(_WORD_BYTES).split()


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words in parts of bounded size."""
    raw = text_bytes(text).translate(_WORD_BYTES)
    at = 0
    while at < len(raw):
        end = len(raw) if at + _PIECE >= len(raw) else raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Bits:
    """A bit vector with ranks from 64-bit blocks."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.blocks[block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix over symbols 0..sigma-1: rank of a symbol before a position, and a position's symbol with its rank."""

    def __init__(self, s: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for k in range(self.levels - 1, -1, -1):
            one = (s >> k) & 1 == 1
            self.bits.append(Bits(one))
            self.zeros.append(int(len(s) - one.sum()))
            s = np.concatenate([s[~one], s[one]])
        every = np.arange(sigma)
        self.base = self._down(every, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, b, z in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros, strict=True):
            ones = b.rank(i)
            i = np.where((c >> k) & 1 == 1, z + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.base[c]

    def symbol(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.zeros(len(i), np.int64)
        for b, z in zip(self.bits, self.zeros, strict=True):
            one, ones = b.at(i), b.rank(i)
            i = np.where(one, z + ones, i - ones)
            c = 2 * c + one
        return c, i - self.base[c]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling over the suffixes that still tie. Every GAP sorts by its position, so no tie reaches beyond one."""
    n = len(s)
    gaps = int((s == GAP).sum())
    key = np.where(s > GAP, s.astype(np.int64) + gaps + 1, 0)
    key[s == GAP] = 1 + np.arange(gaps)
    sa = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.repeat(size > 1, size)  # by place in sa
        if not tied.any():
            return sa
        at = np.flatnonzero(tied)
        i = sa[at]
        second = np.where(i + step < n, rank[np.minimum(i + step, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[i]))
        i, second = i[order], second[order]
        first = rank[i]
        sa[at] = i
        new[at] = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[i] = start[at]
        step *= 2


class FMIndex:
    """Count and locate phrases in a sequence of symbols that ends with END and has GAP where no phrase may reach over."""

    def __init__(self, s: np.ndarray, sigma: int) -> None:
        sa = suffix_array(s)
        self.n = len(s)
        bwt = s[sa - 1]  # the symbol before suffix 0 is the last one, END
        self.wavelet = Wavelet(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        starts = np.concatenate([[True], s[:-1] == GAP])
        kept = (sa % _SAMPLE == 0) | starts[sa]  # walks back end at a run's start at the latest
        self.marked, self.samples = Bits(kept), sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each phrase; phrases are right-aligned in the rows of a matrix."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((lengths > phrases.shape[1] - 1 - k) & (lo < hi))
            c = phrases[on, k]
            lo[on] = self.first[c] + self.wavelet.rank(c, lo[on])
            hi[on] = self.first[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, rows, left, back = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(left):
            done = self.marked.at(rows)
            out[left[done]] = self.samples[self.marked.rank(rows[done])] + back
            left, rows = left[~done], rows[~done]
            c, rank = self.wavelet.symbol(rows)
            rows, back = self.first[c] + rank, back + 1
        return out


class Phrases:
    """The windows of a block of benchmark items, as symbols."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]) -> None:
        vocabulary: dict[bytes, int] = {}
        for w in windows:
            for x in w:
                vocabulary.setdefault(x, len(vocabulary) + 2)
        self.vocabulary, self.sigma = vocabulary, len(vocabulary) + 2
        self.items = [sorted(i) for i in windows.values()]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.least = int(self.lengths.min()) if windows else 1
        wide = int(self.lengths.max()) if windows else 1
        self.matrix = np.zeros((len(windows), wide), np.int64)
        for k, w in enumerate(windows):
            self.matrix[k, wide - len(w) :] = [vocabulary[x] for x in w]


def windows_of(items: list[tuple[str | None, str | None]], width: int) -> dict[tuple[bytes, ...], set[str]]:
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(tuple(w[k : k + width]), set()).update([] if item is None else [item])
    return out


def _search_shard(ids: list[np.ndarray], p: Phrases) -> list[tuple[np.ndarray, set[str]]]:
    """For each document's symbols (0: no benchmark word): the indices of its hit words, and the items found."""
    if not ids:
        return []
    none = (np.zeros(0, np.int64), set())
    out = [none] * len(ids)
    sizes = np.array([len(x) + 1 for x in ids])
    flat = np.zeros(int(sizes.sum()), np.int32)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for x, b in zip(ids, begin, strict=True):
        flat[b : b + len(x)] = x
    known = flat > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= p.least]
    if not len(runs):
        return out
    size = runs[:, 1] - runs[:, 0] + 1  # each with a gap behind it
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(runs[:, 0], size)
    s = np.where(np.arange(len(place)) == np.repeat(np.cumsum(size) - 1, size), GAP, flat[place]).astype(np.int64)
    index = FMIndex(np.append(s, END), p.sigma)
    lo, hi = index.search(p.matrix, p.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return out
    times = hi[found] - lo[found]
    rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[found], times)
    which, at = np.repeat(found, times), index.locate(rows)
    cover = np.bincount(at, minlength=len(s) + 1)[: len(s) + 1] - np.bincount(at + p.lengths[which], minlength=len(s) + 1)[: len(s) + 1]
    hit = place[np.flatnonzero(np.cumsum(cover)[: len(s)] > 0)]
    doc = np.searchsorted(begin, hit, side="right") - 1
    for d in np.unique(doc):
        out[d] = (hit[doc == d] - begin[d], set())
    of = np.searchsorted(begin, place[at], side="right") - 1
    for d, k in np.unique(np.stack([of, which], 1), axis=0):
        out[d][1].update(p.items[k])
    return out


class Blocks:
    """All phrases, as blocks on the driver or as one broadcast for each; iterating gives one block at a time."""

    def __init__(self, held: list) -> None:
        self.held = held

    def __iter__(self) -> Iterator[Phrases]:
        if not self.held:
            yield Phrases({})
        for b in self.held:
            if isinstance(b, Phrases):
                yield b
                continue
            yield b.value
            if len(self.held) > 1:
                b.__dict__.pop("_value", None)  # read again from the broadcast's file when its turn comes


def search(texts: list[str | None], blocks: Blocks) -> list[tuple[int, np.ndarray, set[str]]]:
    """(words, indices of hit words, items) of each text, in order; the texts are one shard."""
    out: list[tuple[int, np.ndarray, set[str]]] = []
    for p in blocks:
        get, shard = p.vocabulary.get, []
        for t in texts:
            parts = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in _pieces(t)]
            shard.append(parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts]))
        found = [(len(x), hit, items) for x, (hit, items) in zip(shard, _search_shard(shard, p), strict=True)]
        out = [(n, np.union1d(a, b) if len(a) and len(b) else a if len(a) else b, i | j) for (n, a, i), (_, b, j) in zip(out, found, strict=True)] if out else found
    return out


def shards(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, dealt anew so that column `at` has SHARD_BYTES bytes or ends with the row that fills it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, gone = 0, 0
        while begin < b.num_rows:
            end = int(np.searchsorted(ends, gone + SHARD_BYTES - size)) + 1
            held.append(b.slice(begin, end - begin))
            if end > b.num_rows:
                size += int(ends[-1]) - gone
                break
            yield _one(held)
            held, size, begin, gone = [], 0, end, int(ends[end - 1])
    if held:
        yield _one(held)
    held.clear()
    give_back()


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Removal spans in code points, end exclusive: from the first to the last word of each row of consecutive hit words."""
    spans: list[tuple[int, int]] = []
    wanted, last = set(hit.tolist()), -2
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if k == last + 1:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append(m.span())
            last = k
    return spans


def without(text: str, blocks: Blocks, hit: np.ndarray | None = None) -> str:
    """text with its removal spans replaced by one space each, again until no phrase is left across a cut."""
    while True:
        if hit is None:
            ((_, hit, _),) = search([text], blocks)
        if not len(hit):
            return text
        spans = spans_of(text, hit)
        keep = zip([0, *(e for _, e in spans)], [*(b for b, _ in spans), len(text)], strict=True)
        text, hit = " ".join(text[b:e] for b, e in keep), None


def blocks(benchmark: DataFrame, width: int, block_phrases: int) -> Iterator[Phrases]:
    """The benchmark's windows in blocks of bounded size, streamed through the driver one partition at a time."""
    held: list[tuple[str | None, str | None]] = []
    count = 0
    for row in pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        held.append((row[0], row[1]))
        count += max(1, len(words_of(row[1])))
        if count >= block_phrases:
            yield Phrases(windows_of(held, width))
            held, count = [], 0
    if held:
        yield Phrases(windows_of(held, width))


FOUND = "doc_id long, n_words long, hit array<int>, items array<string>, spans array<struct<start: int, end: int>>"


def shipped(benchmark: DataFrame, width: int, block_phrases: int) -> Blocks:
    """The benchmark's blocks, each broadcast as it is made, so the driver holds one of them as objects."""
    sc = benchmark.sparkSession.sparkContext
    return Blocks([sc.broadcast(p) for p in blocks(benchmark, width, block_phrases)])


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """doc_id, n_words, hit (indices of the words inside occurrences), items and removal spans of every row."""
    every = shipped(benchmark, width, block_phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches, 1):
            texts = b.column(1).to_pylist()
            found = search(texts, every)
            spans = [[{"start": x, "end": y} for x, y in spans_of(t, hit)] if len(hit) else [] for t, (_, hit, _) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([hit.tolist() for _, hit, _ in found], pa.list_(pa.int32())),
                pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ], names=["doc_id", "n_words", "hit", "items", "spans"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """docs with every occurrence cut out of text; all other columns as they were. One pass over docs."""
    d = numbered(docs, "text")
    at, every = d.columns.index("text"), shipped(benchmark, width, block_phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches, at):
            texts = b.column(at).to_pylist()
            new = [without(t, every, hit) if len(hit) else t for t, (_, hit, _) in zip(texts, search(texts, every), strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return d.mapInArrow(run, d.schema).toDF(*docs.columns)
