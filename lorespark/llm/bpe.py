"""Byte-level BPE by DuckDB queries inside each task: recursive encoding, ordered-aggregation decoding.

Each match of the split pattern is a word. A task collects the words it has not met yet and, in batches of bounded
size, turns them into token-position rows (one for each byte) in a DuckDB database of its own. A recursive query joins
the rows with the merge table, finds each word's leftmost pair of least rank and contracts it, until no pair of the
word is in the table. Words are carried over from one query of at most `rounds` contractions to the next, so that the
recursion's rows stay bounded: a word has a row less after each round, which tells how many rounds the bound allows.
Ids are decoded by joining DECODE_STEP neighbours at a time with the vocabulary; their bytes are aggregated in order.

A word of over LONG_BYTES bytes is first cut where no token of the vocabulary that occurs in it reaches over: nothing is
ever contracted across such a place, so the parts are encoded like words of their own. A part that is still longer
takes a recursive query that contracts many places in each round. The database keeps all in memory and writes no file.

The word cache of a worker has two generations of CACHE_WORDS entries at most: words that are met again move to the
younger one, and the older one goes when that is full. This bounds memory and changes no result.
There is no shuffle: every document is encoded where it is read, and a lost task is simply run again.

Defined results: a null text is empty; an empty text has no ids and decodes to no bytes; an empty table gives an empty
result; repeated rows are encoded alike; strings of special tokens are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pick

#: Position rows for each recursive query, and rows it may make; words in the cache; ids decoded by one query.
BATCH_ROWS, RECURSION_ROWS, CACHE_WORDS, DECODE_IDS = 150_000, 1_200_000, 200_000, 300_000
#: Neighbouring ids that a row of the decoding query holds
DECODE_STEP = 4
#: The database's memory, and what a row of a long word's part may add to it
MEMORY_MB, LONG_ROW_BYTES = 150, 1200

_ENCODE = """
with recursive step(round, word, pos, tok) as (
    select 0, word, pos, tok from fresh
  union all
    (with best as (
        select a.word, min(m.rank * 4294967296 + a.pos) as b
        from step a join step n on n.word = a.word and n.pos = a.pos + 1 join merges m on m.l = a.tok and m.r = n.tok
        where a.round < ? group by a.word)
    select s.round + 1, s.word, case when s.pos > b.b % 4294967296 then s.pos - 1 else s.pos end,
        case when s.pos = b.b % 4294967296 then (b.b // 4294967296)::int else s.tok end
    from step s join best b on b.word = s.word where s.pos <> b.b % 4294967296 + 1)
)
select s.word, s.round, s.pos, s.tok from step s join (select word, max(round) as round from step group by word) using (word, round) order by s.word, s.pos
"""


#: For long words: a round contracts all places of the word's pair of least rank, every second one within a run.
#: That equals contracting them one by one, leftmost first, unless a contraction makes a pair of lesser rank with what
#: stands, or will stand, beside it; where such a pair exists, only the leftmost place is contracted in this round.
_ENCODE_LONG = """
with recursive step(round, word, pos, tok) as (
    select 0, word, pos, tok from fresh
  union all
    (with pairs as (
        select a.round, a.word, a.pos, a.tok, n.tok as then, m.rank
        from step a join step n on n.word = a.word and n.pos = a.pos + 1 join merges m on m.l = a.tok and m.r = n.tok
        where a.round < ?),
    least as (select word, min(rank) as rank from pairs group by word),
    spots as (select p.word, p.pos, p.rank, row_number() over (partition by p.word order by p.pos) as i from pairs p join least l on l.word = p.word and l.rank = p.rank),
    places as (select word, pos, rank::int as tok, rank from (select *, row_number() over (partition by word, pos - i order by pos) as k from spots) where k % 2 = 1),
    beside as (
        select p.word, b.tok as l, p.tok as r, p.rank from places p join step b on b.word = p.word and b.pos = p.pos - 1
        union all select p.word, p.tok, f.tok, p.rank from places p join step f on f.word = p.word and f.pos = p.pos + 2
        union all select word, rank::int, rank::int, rank from least),
    risky as (select distinct b.word from (select distinct * from beside) b join merges m on m.l = b.l and m.r = b.r where m.rank < b.rank),
    first as (select word, min(pos) as pos from places group by word),
    chosen as (
        select p.* from places p left join risky r on r.word = p.word left join first f on f.word = p.word and f.pos = p.pos
        where r.word is null or f.pos is not null),
    marked as (
        select s.round, s.word, s.pos, coalesce(c.tok, s.tok) as tok, lag(c.tok) over (partition by s.word order by s.pos) is not null as eaten
        from step s join least l on l.word = s.word left join chosen c on c.word = s.word and c.pos = s.pos)
    select round + 1, word, (row_number() over (partition by word order by pos) - 1)::bigint, tok from marked where not eaten)
)
select s.word, s.round, s.pos, s.tok from step s join (select word, max(round) as round from step group by word) using (word, round) order by s.word, s.pos
"""
LONG_BYTES = 1024

_DECODE = f"""
select i.doc, string_agg(concat({", ".join(f"v{k}.hex" for k in range(DECODE_STEP))}), '' order by i.pos) as hex
from ids i {" ".join(f"join vocab v{k} on v{k}.id = i.id{k}" for k in range(DECODE_STEP))} group by i.doc
"""


def rounds_within(lengths: np.ndarray, rows: int) -> int:
    """The rounds, 64 at most and 1 at least, in which words of so many tokens make `rows` rows or fewer, even if each loses but one token a round."""
    count = np.bincount(lengths)
    longer = np.cumsum(count[::-1])[::-1]  # words of k tokens or more
    made = np.cumsum(np.cumsum(longer[:0:-1])[::-1])  # at place r: rows of the rounds up to r
    return max(1, 64 if made[-1] <= rows else min(64, int(np.searchsorted(made, rows, "right")) - 1))


class Trie:
    """The vocabulary's prefixes, to find where in a long word no token reaches over."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        node = {b"": 0}
        for t in ranks:
            for k in range(1, len(t) + 1):
                node.setdefault(t[:k], len(node))
        keys = np.array([node[p[:-1]] * 256 + p[-1] for p in node if p], np.int64)
        to = np.array([v for p, v in node.items() if p], np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.whole = keys[order], to[order], np.array([p in ranks for p in node])

    def cuts(self, raw: bytes) -> list[int]:
        """The places in raw that no token of the vocabulary occurring in it reaches over, with both ends."""
        b = np.frombuffer(raw, np.uint8).astype(np.int64)
        n = len(b)
        reach = np.arange(1, n + 1)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            key = node * 256 + b[at + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[k] == key
            at, node, depth = at[on], self.to[k[on]], depth + 1
            reach[at[self.whole[node]]] = at[self.whole[node]] + depth
            if depth > 1 and (np.maximum.accumulate(reach)[:-1] > np.arange(1, n)).all():
                return [0, n]
            more = at + depth < n
            at, node = at[more], node[more]
        free = np.flatnonzero(np.maximum.accumulate(reach)[:-1] <= np.arange(1, n)) + 1
        return [0, *free.tolist(), n]


class Codec:
    """An encoder and decoder for one rank file; made once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._db: duckdb.DuckDBPyConnection | None = None
        self._trie: Trie | None = None
        self.ranks = ranks
        pairs = [(r, ranks[t[:k]], ranks[t[k:]]) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        rank, left, right = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        self.tables = {
            "merges": pa.table({"rank": rank.cast(pa.int64()), "l": left, "r": right}),
            "vocab": pa.table({"id": pa.array([-1, *ranks.values()], pa.int32()), "hex": pa.array(["", *(t.hex() for t in ranks)])}),  # -1 fills a row up
        }

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        """The task's database, opened when it is first needed."""
        if self._db is None:
            self._db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "", "max_temp_directory_size": "0B"})
            for name, t in self.tables.items():
                self._db.register("_new", t)
                self._db.execute(f"create table {name} as select * from _new")
                self._db.unregister("_new")
        return self._db

    def close(self) -> None:
        """Gives the database's memory back at the end of a task; the word cache stays for the worker's next one."""
        if self._db is not None:
            self._db.close()
            self._db = None

    def _learn(self, words: list[str]) -> None:
        """Encodes new words into the cache, in batches of bounded size; long ones by their parts."""
        long = [w for w in words if len(w) * 4 > LONG_BYTES and len(w.encode("utf-8", "surrogatepass")) > LONG_BYTES]
        if long:
            apart = set(long)
            self._learn_raw([(w, w.encode("utf-8", "surrogatepass")) for w in words if w not in apart], self.cache)
            for w in long:
                self._learn_long(w)
        else:
            self._learn_raw([(w, w.encode("utf-8", "surrogatepass")) for w in words], self.cache)

    def _learn_long(self, word: str) -> None:
        """Cuts one long word where no token reaches over, encodes its different parts, and puts their ids in a row."""
        raw = word.encode("utf-8", "surrogatepass")
        self._trie = self._trie or Trie(self.ranks)
        ends = self._trie.cuts(raw)
        parts = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        found: dict[bytes, bytes] = {}
        self._learn_raw([(p, p) for p in sorted(set(parts))], found)
        self.cache[word] = b"".join(map(found.__getitem__, parts))

    def _learn_raw(self, words: list[tuple], found: dict) -> None:
        """The ids of (name, bytes) by name, in batches of bounded size."""
        batch: list[tuple] = []
        size = 0
        for name, raw in words:
            if len(raw) > LONG_BYTES:
                self.db.execute(f"set memory_limit = '{MEMORY_MB + len(raw) * LONG_ROW_BYTES // 1_000_000}MB'")
                self._encode([(name, raw)], found, _ENCODE_LONG)
                self.db.execute(f"set memory_limit = '{MEMORY_MB}MB'")
                continue
            batch.append((name, raw))
            size += len(raw)
            if size >= BATCH_ROWS:
                self._encode(batch, found, _ENCODE)
                batch, size = [], 0
        if batch:
            self._encode(batch, found, _ENCODE)

    def _encode(self, batch: list[tuple], found: dict, query: str) -> None:
        lengths = np.array([len(b) for _, b in batch])
        word = np.repeat(np.arange(len(batch), dtype=np.int32), lengths)
        begin = np.cumsum(lengths) - lengths
        pos = (np.arange(len(word)) - np.repeat(begin, lengths)).astype(np.int64)
        tok = np.array(self.byte_id, np.int32)[np.frombuffer(b"".join(b for _, b in batch), np.uint8)]
        while len(word):
            rounds = rounds_within(np.bincount(word), RECURSION_ROWS)
            self.db.register("fresh", pa.table({"word": word, "pos": pos, "tok": tok}))
            out = self.db.execute(query, [rounds]).fetchnumpy()
            self.db.unregister("fresh")
            word, made, pos, tok = (np.asarray(out[k]) for k in ("word", "round", "pos", "tok"))
            done = made < rounds  # those that used all rounds may have more to contract
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            ids = tok.astype("<u4")
            for a, b in zip(at.tolist(), np.append(at[1:], len(word)).tolist(), strict=True):
                if done[a]:
                    found[batch[word[a]][0]] = ids[a:b].tobytes()
            word, pos, tok = word[~done], pos[~done].astype(np.int64), tok[~done]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        new: set[str] = set()
        held = 0

        def flush() -> None:
            nonlocal held
            self._learn(sorted(new))
            out.extend(b"".join(map(self.cache.__getitem__, w)) for w in waiting)
            waiting.clear()
            new.clear()
            held = 0
            if len(self.cache) > CACHE_WORDS:
                self.older, self.cache = self.cache, {}

        for t in texts:
            words = self.pattern.findall(t or "")
            waiting.append(words)
            held += len(words)
            for w in set(words).difference(self.cache):
                if (ids := self.older.get(w)) is None:
                    new.add(w)
                else:
                    self.cache[w] = ids
            if len(new) >= CACHE_WORDS // 4 or held >= 2_000_000:
                flush()
        flush()
        return out

    def decode(self, ids: list[bytes], want: str = "sha") -> list:
        """The decoded bytes of each row of ids (want='bytes'), or their SHA-256 (want='sha')."""
        out: list = []
        batch: list[np.ndarray] = []
        size = 0
        for x in ids:
            if len(x) > 4 * DECODE_IDS:  # a long text is decoded by pieces
                out += self._decode(batch, want)
                pieces = (self._decode([np.frombuffer(x[k : k + 4 * DECODE_IDS], "<u4")], "bytes")[0] for k in range(0, len(x), 4 * DECODE_IDS))
                out.append(_sha(pieces) if want == "sha" else b"".join(pieces))
                batch, size = [], 0
                continue
            batch.append(np.frombuffer(x, "<u4"))
            size += len(batch[-1])
            if size >= DECODE_IDS:
                out += self._decode(batch, want)
                batch, size = [], 0
        return out + self._decode(batch, want)

    def _decode(self, batch: list[np.ndarray], want: str) -> list:
        lengths = np.array([len(x) for x in batch], np.int64)
        rows = -(-lengths // DECODE_STEP)
        begin = (np.cumsum(rows) - rows) * DECODE_STEP - (np.cumsum(lengths) - lengths)  # how far each row of ids moves
        flat = np.full(int(rows.sum()) * DECODE_STEP, -1, np.int32)
        flat[np.arange(int(lengths.sum())) + np.repeat(begin, lengths)] = np.concatenate([np.zeros(0, np.uint32), *batch])
        out: list = [hashlib.sha256(b"").hexdigest() if want == "sha" else b""] * len(batch)
        columns = {f"id{k}": np.ascontiguousarray(flat[k::DECODE_STEP]) for k in range(DECODE_STEP)}
        self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(batch), dtype=np.int32), rows), "pos": np.arange(int(rows.sum()), dtype=np.int32)} | columns))
        for doc, x in self.db.execute(f"select doc, {'sha256(unhex(hex))' if want == 'sha' else 'unhex(hex)'} from ({_DECODE})").fetchall():
            out[doc] = x
        self.db.unregister("ids")
        return out


def _sha(pieces: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p)
    return h.hexdigest()


_CODECS: dict[tuple[str, str], Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file on the executors' disks; a tokenizer file is part of the cluster's image."""
    return _CODECS.get((path, pattern)) or _CODECS.setdefault((path, pattern), Codec(read_ranks(path), pattern))


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, ids_sha256, decoded_sha256) of every document's whole text."""
    schema = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        try:
            for b in batches:
                for k in range(0, max(1, b.num_rows), 500):
                    part = b.slice(k, 500)
                    ids = c.encode(part.column(1).to_pylist())
                    decoded = c.decode(ids)
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string()),
                    ], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        finally:
            c.close()
            give_back()

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
