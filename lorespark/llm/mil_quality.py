"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A passage is a stretch of PASSAGE words (the last one of a text may be shorter). Its features are its own: shares of byte
classes and of class pairs, hashed byte trigrams (the lexical part), word lengths, repetition within the passage, and
the share of its bytes in lines that the text has more than once. The network encodes every passage, h = tanh(Wx), gives
it a gated attention weight, softmax over the document of w . (tanh(Vh) * sigmoid(Uh)), and scores the weighted sum of
the encodings with a logistic unit. Weights are learned from document labels only, by Adam on the driver. The scores of
all documents are computed where the texts are read, without a shuffle.

The sample to learn from is bounded by two parameters: at most `max_docs` labelled documents, those of the least hash of
their id, and of each at most `max_passages` passages, evenly spaced over the whole text. So the driver gets at most
max_docs * max_passages rows of features (4,000 * 32 * 1.4 KB), however long texts are and however often rows repeat.
Scores use every passage of every text.

Defined results: a null text is empty; an empty text is one passage of zeros and gets a score, too; with labels of one
class or none the score is 0.5 everywhere; repeated rows score alike, and of rows of one id that of the least text hash
is learned from; an id with both labels, null ids and null labels are not learned from; an empty table gives an empty
result; other columns are ignored; every passage of a text counts in its score, however long it is.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_bytes

PASSAGE = 64
MAX_DOCS, MAX_PASSAGES = 4000, 32
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 16, 25, 64, 0.01, 1e-3, 7

# Byte classes: lower case, upper case, digit, space, line feed, . , other quotes and brackets, each of # * $ % & | !, other
_CLASSES = 18
_CLASS = np.full(256, _CLASSES - 1, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"\"'()[]{}", b"#", b"*", b"$", b"%", b"&", b"|", b"!", b"<>=/\\", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _k
_PAIRS = 8  # pairs of the classes merged into 8
_MERGED = np.array([0, 1, 2, 3, 4, 5, 5, 5, 6, 6, 6, 6, 6, 6, 6, 5, 0, 7])
_GRAMS = 256  # classes of hashed byte trigrams, letters in lower case
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)
_LINES, _GRAMS_AT = _CLASSES + _PAIRS * _PAIRS, _CLASSES + _PAIRS * _PAIRS + 5
FEATURES = _GRAMS_AT + _GRAMS
#: Added to a feature's deviation when it is scaled: many rare trigrams together weigh no more than the few other features
FLOOR = np.where(np.arange(FEATURES) < _GRAMS_AT, 1e-3, 2e-2)


def features(text: str | None) -> np.ndarray:
    """A row of features for every passage of the whole text; one row of zeros for a text without words."""
    raw = text_bytes(text)
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(words) // PASSAGE)
    b = np.frombuffer(raw, np.uint8)
    c = _CLASS[b]
    solid = (c != 3) & (c != 4) & (b != 11) & (b != 12)
    start = solid & np.concatenate([[True], ~solid[:-1]])
    at = np.maximum(np.cumsum(start) - 1, 0) // PASSAGE  # the passage of every byte
    out = np.zeros((n, FEATURES), np.float32)
    size = np.bincount(at, minlength=n).astype(np.float32)[:, None]
    out[:, :_CLASSES] = np.bincount(at * _CLASSES + c, minlength=n * _CLASSES).reshape(n, _CLASSES) / size
    m = _MERGED[c]
    pair = at[1:] * _PAIRS * _PAIRS + m[:-1] * _PAIRS + m[1:]
    k = _CLASSES + _PAIRS * _PAIRS
    out[:, _CLASSES:k] = np.bincount(pair, minlength=n * _PAIRS * _PAIRS).reshape(n, -1) / size
    for i in range(n):
        w = words[i * PASSAGE : (i + 1) * PASSAGE]
        lengths = list(map(len, w))
        out[i, k : k + 4] = (sum(lengths) / len(w) / 10, max(lengths) / 40, len(set(w)) / len(w), len(w) / PASSAGE)
    out[:, k + 4] = np.bincount(at, _repeated(raw), minlength=n) / size[:, 0]
    if len(b) > 2:
        low = _LOWER[b]
        gram = ((low[:-2] * np.uint32(65599) + low[1:-1]) * np.uint32(65599) + low[2:]) * np.uint32(2654435761) >> np.uint32(24)
        out[:, _GRAMS_AT:] = np.bincount(at[1:-1] * _GRAMS + gram, minlength=n * _GRAMS).reshape(n, _GRAMS) / size
    return out


def _repeated(raw: bytes) -> np.ndarray:
    """For every byte whether it is in a line with a word that the text has more than once."""
    lines = raw.split(b"\n")
    times = Counter(lines)
    twice = np.array([times[x] > 1 and not x.isspace() and len(x) > 0 for x in lines])
    sizes = np.array([len(x) + 1 for x in lines])
    sizes[-1] -= 1
    return np.repeat(twice, sizes)


@dataclass
class Net:
    """The learned network; about FEATURES * HIDDEN numbers, whatever the size of the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        begin = np.cumsum([0] + [len(x) for x in bags[:-1]])
        x = (np.concatenate(bags) - self.mean) / self.scale
        return _forward(self.p, x, begin, np.repeat(np.arange(len(bags)), [len(b) for b in bags]))["y"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["bw"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
    a = e / np.add.reduceat(e, begin)[bag]
    z = np.add.reduceat(a[:, None] * h, begin)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}


def _gradient(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, bag: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(p, x, begin, bag)
    dy = (f["y"] - label) / len(label)
    dz = dy[:, None] * p["c"]
    da = (f["h"] * dz[bag]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, begin)[bag])
    tg = f["t"] * f["g"]
    dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "bw": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": tg.T @ de, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Net | None:
    """The network for labelled bags of passages; None if there is only one class. The same input gives the same weights."""
    if len(set(labels.tolist())) < 2:
        return None
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + FLOOR
    bags = [(b - mean) / scale for b in bags]
    rng = np.random.default_rng(SEED)
    init = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    p = {"W": init(FEATURES, HIDDEN), "bw": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "b": np.zeros(1, np.float32)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(order), BATCH):
            part = [bags[i] for i in order[k : k + BATCH]]
            begin = np.cumsum([0] + [len(b) for b in part[:-1]])
            bag = np.repeat(np.arange(len(part)), [len(b) for b in part])
            step += 1
            for name, d in _gradient(p, np.concatenate(part), begin, bag, labels[order[k : k + BATCH]]).items():
                d = d + DECAY * p[name]
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.999 * v[name] + 0.001 * d * d
                p[name] = p[name] - (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Net(mean, scale, p)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(x: np.ndarray, most: int) -> np.ndarray:
    """At most `most` rows, evenly spaced."""
    return x if len(x) <= most else x[np.arange(most) * len(x) // most]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> Net | None:
    """Learns from a bounded sample of the labelled documents that are not held out."""
    known = (
        pick(labels, "doc_id", target)
        .filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("label"), F.min(target).cast("int").alias("other"))
        .filter("label = other")
    )
    sample = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # bounded, so it may be broadcast
    d = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [sampled(features(t.as_py()), max_passages) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), b.column("label").cast(pa.int32()), b.column("hash").cast(pa.int64()), pa.array([y.astype("<f4").tobytes() for y in x], pa.binary()),
            ], names=["doc_id", "label", "hash", "x"])

    each = d.select("doc_id", "label", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text").mapInArrow(run, "doc_id long, label int, hash long, x binary")
    one = each.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("x", F.struct("hash", "x")).alias("x"))
    rows = sorted(one.collect(), key=lambda r: r.doc_id)  # max_docs rows of max_passages passages at most
    if not rows:
        return None
    return fit([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in rows], np.array([r.label for r in rows], np.float32))


def score(docs: DataFrame, net: Net | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of passages of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, max(1, b.num_rows), 500):
                part = b.slice(k, 500)
                bags = [features(t.as_py()) for t in part.column(1)]
                y = np.full(len(bags), 0.5) if net is None or not bags else net.scores(bags).astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(y, pa.float64()), pa.array([len(x) for x in bags], pa.int64())], names=["doc_id", "score", "n_passages"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = d.mapInArrow(run, "doc_id long, score double, n_passages long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")
