import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def same(codec, other, texts):
    got = codec.encode(texts)
    assert [g == np.array(other.encode_ordinary(t or ""), dtype="<u4").tobytes() for t, g in zip(texts, got, strict=True)] == [True] * len(texts)
    assert codec.decode(got, "bytes") == [(t or "").encode() for t in texts]
    assert codec.decode(got) == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]


def test_plain_texts(codec, other):
    same(codec, other, [None, "", " ", "Hello world's", "<|endoftext|>", "tab\tand\n\n  lines  ", "héllo ☃ 日本語 🙂🙂", "a" * 300, "x\r\ny", "'ll 'S it'll", "0123456789" * 9])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40).filter(lambda t: t.isprintable() or "\n" in t), max_size=4))
def test_any_text(codec, other, texts):
    same(codec, other, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_long_words(codec, other):
    r = random.Random(1)
    pick = lambda parts, n: "".join(r.choice(parts) for _ in range(n))
    same(codec, other, ["a" * 5000, "the" * 900, pick("aeiou", 2500), pick(["the", "ing", "tion", "er"], 1200), "é" * 1500, "#" * 2049, " " * 2000 + "x"])


def test_cuts_are_where_no_token_reaches_over():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"cd": 258, b"xyz": 259}
    assert bpe.Trie(ranks).cuts(b"ababcdxyxyz") == [0, 2, 6, 7, 8, 11]
    assert bpe.Trie(ranks).cuts(b"ab") == [0, 2] and bpe.Trie(ranks).cuts(b"a") == [0, 1]


def test_very_long_words(codec, tmp_path, monkeypatch):
    """A million letters take seconds and leave no file behind."""
    monkeypatch.chdir(tmp_path)
    r = random.Random(2)
    for text, n in (("a" * 1_000_000, 250_000), ("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), None)):
        begin = time.time()
        (ids,) = codec.encode([text])
        assert time.time() - begin < 30 and (n is None or len(ids) == 4 * n)
        assert codec.decode([ids], "bytes") == [text.encode()] and codec.decode([ids]) == [hashlib.sha256(text.encode()).hexdigest()]
    assert not list(tmp_path.iterdir())


def test_long_parts_in_many_queries(other, monkeypatch):
    """Long parts whose contractions make pairs of lesser rank, with words carried over between queries."""
    r = random.Random(3)
    monkeypatch.setattr(bpe, "LONG_BYTES", 8)
    for rows in (50, 5000):
        monkeypatch.setattr(bpe, "RECURSION_ROWS", rows)
        c = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
        same(c, other, ["".join(r.choices(["the", "ing", "a", "tion", "er", "st"], k=r.randint(5, 40))) for _ in range(40)] + ["=" * 300, "é" * 50])


def test_a_pattern_of_ones_own(other):
    """A second pattern for the same ranks gets a codec of its own."""
    bpe.codec(PATH, public_tokenizers.PATTERN)
    got = bpe.codec(PATH, r"[a-z]+|[^a-z]+").encode(["Hello world"])[0]
    want = tiktoken.Encoding("two", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}).encode_ordinary("Hello world")
    assert got == np.array(want, dtype="<u4").tobytes() != np.array(other.encode_ordinary("Hello world"), dtype="<u4").tobytes()


def test_bounds_change_nothing(other, monkeypatch):
    texts = [" ".join(f"word{i}ing thé" for i in range(k, k + 40)) for k in range(12)]
    for name, value in (("BATCH_ROWS", 50), ("RECURSION_ROWS", 100), ("CACHE_WORDS", 20), ("DECODE_IDS", 30)):
        monkeypatch.setattr(bpe, name, value)
    same(bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN), other, texts)


def test_on_frames(make, clash, other):
    rows = [(1, "one text"), (1, "one text"), (2, None), (3, ""), (None, "no id"), (4, "long " * 4000)]
    d = clash(make(rows))
    got = bpe.tokenize(d, PATH, public_tokenizers.PATTERN).collect()
    by = {(r.doc_id, r.n_tokens): r for r in got}
    assert len(got) == 6 and by[2, 0].ids == [] and by[3, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    want = other.encode_ordinary("long " * 4000)
    assert by[4, len(want)].ids == want and by[4, len(want)].ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
    assert bpe.tokenize(d.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_a_batch_of_words_is_one_query_within_the_bound_of_rows(other):
    """The recursion's rows are bounded by what words can make, so words of usual lengths are not carried over."""
    lengths = random.Random(4).choices(range(1, 70), k=30)
    for bound in (1, 900, 5000, 40_000, 10**6):
        rows = [sum(max(n - i, 0) for n in lengths for i in range(r + 1)) for r in range(65)]
        assert bpe.rounds_within(np.array(lengths), bound) == max([1, *(r for r in range(1, 65) if rows[r] <= bound)])

    class Counting:
        def __init__(self, db):
            self.db, self.seen = db, []

        def execute(self, query, *a):
            self.seen.append(query)
            return self.db.execute(query, *a)

        def __getattr__(self, name):
            return getattr(self.db, name)

    c = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    c._db = Counting(c.db)
    letters = random.Random(5)
    text = "".join(" " + "".join(letters.choices(["the", "ing", "er", "a", "st"], k=12))[:15] for _ in range(8_000))
    same(c, other, [text])
    assert c._db.seen.count(bpe._ENCODE) == 1
