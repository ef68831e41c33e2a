"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence is a stretch up to `.`, `!`, `?`, `…`, `。` or a line feed; a longer one than PIECE words is taken in pieces.
Its score is logistic in the sum of its distinct words' weights; a word's weight is the sum over its hashed character
4- to 7-grams and the word itself, in lower case. A document is toxic if any of its sentences is: 1 - prod(1 - p). Only
document labels are known, so the loss is the documents' cross-entropy, and its gradient deals the blame to sentences.
AdaGrad steps with a soft threshold (l1) leave a few hundred weights, which is what the executors get. Scores and the
offending sentences of all documents come from one pass over the texts, without a shuffle.

The sample to learn from is bounded by two parameters: at most `max_docs` labelled documents that are not held out, those
of the least hash of their id, whose text has at most `max_chars` characters (4,000 of 40,000; the driver gets these
texts). Scores use every sentence of every text.

Defined results: a null or empty text has no sentence and a score of 0 (0.5 where nothing could be learned, as with labels
of one class); repeated rows score alike, and of rows of one id that of the least text is learned from; an id with both
labels, null ids and null labels are not learned from; an empty table gives an empty result; other columns are ignored;
texts, sentences and words of any length are read whole; the offending sentences of a text are those of 0.5 or more, and
of a toxic text without such a one the worst; of equal worst ones the first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .mil_quality import held_out

MAX_DOCS, MAX_CHARS = 4000, 40_000
PIECE = 64
BITS, GRAMS = 18, (4, 5, 6, 7)
EPOCHS, RATE, L1, BIAS = 180, 0.3, 2e-4, -4.0
CACHE, GROUP, STEP = 200_000, 500_000, 20_000

_SENTENCE = re.compile(r"[^.!?…。\n]+[.!?…。]*")
_WORD = re.compile(r"\w+")
_MASK = np.uint32((1 << BITS) - 1)
_TABLE = np.array([zlib.crc32(bytes([k ^ 0xFF])) ^ 0xFF000000 for k in range(256)], np.uint32)  # of a CRC's step by one byte


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct words in lower case) of every sentence with a word; code points, end exclusive."""
    out, text = [], text or ""
    # Of all characters, only these two change their number or depend on others in lower case: without them the text can be lowered as a whole.
    lowered = "\u0130" not in text and "\u03a3" not in text
    text = text.lower() if lowered else text
    for m in _SENTENCE.finditer(text):
        said = _WORD.findall(text, *m.span())
        if len(said) <= PIECE:
            if said:
                out.append((*m.span(), list(dict.fromkeys(said if lowered else map(str.lower, said)))))
            continue
        words = [(w.start(), w.end(), w.group().lower()) for w in _WORD.finditer(m.group())]
        for k in range(0, len(words), PIECE):
            part = words[k : k + PIECE]
            last = k + PIECE >= len(words)
            begin = m.start() if k == 0 else m.start() + part[0][0]
            out.append((begin, m.end() if last else m.start() + part[-1][1], list(dict.fromkeys(w for _, _, w in part))))
    return out


def grams(word: str) -> list[int]:
    """The hashed features of a word, each once."""
    w = f"<{word}>"
    found = {w, *(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))}
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in found})


def hashed(words: list[str], keep: np.ndarray | None = None) -> np.ndarray:
    """(place of a word << BITS) + feature, ascending, for the features of all words, or those that keep marks; grams() for many words."""
    out = [np.array([], np.int64)]
    for k in range(0, len(words), STEP):
        found = [(word[some] + k << BITS) | g[some] for word, g in _crcs(words[k : k + STEP]) for some in [slice(None) if keep is None else keep[g]]]
        out.append(np.unique(np.concatenate(found)))
    return np.concatenate(out)


def _crcs(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of a word, feature) of all grams, repeats included. The CRCs of the stretches from every code point grow by one at a time."""
    coded = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    yield np.arange(len(words)), np.fromiter(map(zlib.crc32, coded), np.uint32, len(words)) & _MASK
    data, size = np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    width, word = np.diff(begin, append=len(data)), np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[word] - np.arange(len(word))
    at = np.flatnonzero(left >= min(GRAMS))
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        keep = left[at] >= n
        at, crc = at[keep], crc[keep]
        for k in range(4):
            some = np.flatnonzero(width[at + n - 1] > k) if k else slice(None)
            crc[some] = _TABLE[(crc[some] ^ data[begin[at[some] + n - 1] + k]) & 0xFF] ^ (crc[some] >> 8)
        if n in GRAMS:
            yield word[at], ~crc & _MASK


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Bags:
    """Documents as flat arrays: grams of words, words of sentences, sentences of documents."""

    gram: np.ndarray  # feature of each (word, gram)
    gram_word: np.ndarray
    word: np.ndarray  # word of each (sentence, word)
    word_sentence: np.ndarray
    sentence_doc: np.ndarray
    n_words: int
    n_docs: int

    @staticmethod
    def of(texts: list[str | None]) -> Bags:
        ids: dict[str, int] = {}
        word, at, doc = [], [], []
        for k, text in enumerate(texts):
            for _, _, words in sentences(text):
                word += [ids.setdefault(w, len(ids)) for w in words]
                at += [len(doc)] * len(words)
                doc.append(k)
        pairs = hashed(list(ids))
        array = lambda x: np.array(x, np.int64)
        return Bags(pairs & int(_MASK), pairs >> BITS, array(word), array(at), array(doc), len(ids), len(texts))

    def forward(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """z of every sentence, and of every document -log of the probability that no sentence is toxic."""
        per_word = np.bincount(self.gram_word, w[self.gram], self.n_words)
        z = np.bincount(self.word_sentence, per_word[self.word], len(self.sentence_doc)) + b
        return z, np.bincount(self.sentence_doc, np.logaddexp(0, z), self.n_docs)

    def loss(self, w: np.ndarray, b: float, label: np.ndarray) -> tuple[float, np.ndarray, float]:
        """Mean cross-entropy of the documents and its gradient."""
        z, s = self.forward(w, b)
        toxic = np.maximum(-np.expm1(-s), 1e-12)
        value = float(np.mean(np.where(label == 1, -np.log(toxic), s)))
        ds = np.where(label == 1, -np.exp(-s) / toxic, 1.0) / self.n_docs
        dz = ds[self.sentence_doc] * _sigmoid(z)
        per_word = np.bincount(self.word, dz[self.word_sentence], self.n_words)
        return value, np.bincount(self.gram, per_word[self.gram_word], len(w)), float(dz.sum())


@dataclass
class Model:
    """The weights that are not zero, by feature, and the bias of a sentence."""

    weights: dict[int, float]
    bias: float
    known: dict[str, float] = field(default_factory=dict)  # weights of words seen by this task, at most CACHE or those of one group of texts

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def learn(self, words: list[str]) -> None:
        """Puts the weights of words into known: of each, the sum over its features, each once."""
        dense = np.zeros(1 << BITS)
        dense[list(self.weights)] = list(self.weights.values())
        pairs = hashed(words, dense != 0)
        self.known.update(zip(words, np.bincount(pairs >> BITS, dense[pairs & int(_MASK)], len(words)).tolist()))

    def judge(self, texts: list[str | None]) -> Iterator[tuple[float, int, list[tuple[int, int, float]]]]:
        """Each document's score, its number of sentences, and the offending ones with their scores."""
        split = [sentences(t) for t in texts]
        words = dict.fromkeys(w for found in split for _, _, said in found for w in said)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(words)
        self.learn(new)
        for found in split:
            if not found:
                yield 0.0, 0, []
                continue
            z = np.array([sum(map(self.known.__getitem__, said)) for _, _, said in found]) + self.bias
            p, score = _sigmoid(z), float(-np.expm1(-np.logaddexp(0, z).sum()))
            bad = np.flatnonzero(p >= 0.5).tolist() or ([int(p.argmax())] if score >= 0.5 else [])
            yield min(score, 1.0), len(found), [(found[i][0], found[i][1], float(p[i])) for i in bad]
        for w in new:
            if len(w) >= 100:
                del self.known[w]


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> Model | None:
    """The model for labelled texts; None if there is only one class. The same input gives the same weights."""
    if len(set(labels)) < 2:
        return None
    bags, label = Bags.of(texts), np.array(labels)
    w, b = np.zeros(1 << BITS), BIAS
    acc, acc_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(epochs):
        _, g, gb = bags.loss(w, b, label)
        acc += g * g
        acc_b += gb * gb
        rate = RATE / np.sqrt(acc)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        b -= RATE * gb / acc_b**0.5
    return Model({int(k): float(w[k]) for k in np.flatnonzero(w)}, float(b))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model | None:
    """Learns from a bounded sample of the labelled documents that are not held out."""
    known = (
        pick(labels, "doc_id", target)
        .filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("label"), F.min(target).cast("int").alias("other"))
        .filter("label = other")
    )
    sample = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # bounded, so it may be broadcast
    d = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").filter(F.length(F.coalesce("text", F.lit(""))) <= max_chars)
    one = d.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = sorted(one.collect(), key=lambda r: r.doc_id)  # max_docs texts of max_chars characters at most
    return fit([r.text for r in rows], [r.label for r in rows]) if rows else None


def _groups(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """texts in order, as many together as make up GROUP characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= GROUP:
            yield some
            some, size = [], 0
    if some:
        yield some


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, the number of sentences and the offending ones of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for texts in _groups(t.as_py() for t in b.column(1)):
                got += [(0.5, len(sentences(t)), []) for t in texts] if model is None else model.judge(texts)
            spans = pa.array([[{"start": s, "end": e, "score": p} for s, e, p in x[2]] for x in got], _SPANS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64()), spans], names=["doc_id", "score", "n_sentences", "offending"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = d.mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
