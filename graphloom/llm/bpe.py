"""Byte-level BPE by a pair occurrence index.

The distinct pre-tokens of a partition's texts lie end to end in one symbol array. An index maps each mergeable
pair to all its positions in it. Active ranks (pairs that have positions) are applied in ascending
order: a rank's pair is merged at all its positions at once, and the pairs that this makes with the left and
right neighbours are added to their lists. A merged symbol's pairs always have later ranks than its own, so
one ascending sweep gives what merging word by word gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty, to_arrow

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a partition's texts whose words share an index; of a larger partition one portion follows the other.
PARTITION_BYTES = 64 << 20
#: Words, and bytes of their ids, that a task remembers from one portion to the next; beyond that it forgets all and starts anew.
MEMORY, MEMORY_BYTES = 300_000, 64 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: as_bytes(s) for s, i in model["vocab"].items() if s not in self.added}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.n_base = max(self.bytes_of) + 1
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.byte_ids = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        if not ((self._made_at(left) < np.arange(len(left))) & (self._made_at(right) < np.arange(len(left)))).all():
            raise ValueError("a merge uses a symbol that only a later merge makes")
        self.splitter = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        lengths = np.zeros(self.n_base + 1, dtype=np.int64)
        for i, b in self.bytes_of.items():
            lengths[i] = len(b)
        self.lengths = lengths
        self.starts = np.concatenate([[0], lengths.cumsum()])
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(self.n_base)), dtype=np.uint8)

    def _made_at(self, symbols: np.ndarray) -> np.ndarray:
        made = np.full(self.n_base + 1, -1, dtype=np.int64)
        made[self.merged] = np.arange(len(self.merged))
        return made[symbols]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, end to end."""
        n = self.lengths[ids]
        ends = n.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(total)].tobytes()


def encode_words(words: Iterable[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each word (little-endian, unsigned 32-bit), by one pair occurrence index over all of them."""
    words = list(words)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    symbol = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    n = len(symbol)
    if not n:
        return [b"" for _ in words]
    last = np.zeros(n, dtype=bool)
    last[sizes.cumsum()[sizes > 0] - 1] = True
    after = np.arange(1, n + 1, dtype=np.int64)
    after[last] = -1
    before = np.arange(-1, n - 1, dtype=np.int64)
    before[1:][last[:-1]] = -1
    before[0] = -1
    alive = np.ones(n, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(positions: np.ndarray) -> None:
        """Put pairs that begin at the positions into the index."""
        ranks = vocabulary.rank(symbol[positions], symbol[after[positions]])
        known = ranks >= 0
        positions, ranks = positions[known], ranks[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for r, start, end in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(positions[start:end])

    add(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        a, b = vocabulary.left[r], vocabulary.right[r]
        at = at[alive[at] & (symbol[at] == a)]
        following = after[at]
        fits = following >= 0
        fits[fits] = symbol[following[fits]] == b
        at = at[fits]
        if a == b and len(at) > 1:
            at = leftmost(at, after)
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = vocabulary.merged[r]
        alive[gone] = False
        beyond = after[gone]
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        left = before[at]
        add(np.concatenate([left[left >= 0], at[linked]]))
    word = np.repeat(np.arange(len(words)), sizes)
    ends = (4 * np.bincount(word[alive], minlength=len(words)).cumsum()).tolist()
    ids = symbol[alive].astype("<u4").tobytes()
    return [ids[start:end] for start, end in zip([0, *ends], ends, strict=False)]


def leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of one symbol (aaa) the leftmost, then every second, as merging from the left does."""
    chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
    starts = np.flatnonzero(~chained)
    offset = np.arange(len(at)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(at)]])))
    return at[offset % 2 == 0]


class Numbers(dict):
    """Word -> its number, in the order of meeting."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Encoder:
    """Encodes texts: reads them into word numbers, puts the new words through one index, and joins the words' ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(PATTERN).findall
        self.number = Numbers()
        self.codes: list[bytes] = []

    def read(self, text: str) -> list[int | np.ndarray]:
        """A text's pieces: ids of added tokens, and numbers of words."""
        v, number = self.vocabulary, self.number.__getitem__
        numbers = lambda words: np.fromiter(map(number, words), dtype=np.int32, count=len(words))
        if v.splitter is None or not any(t in text for t in v.added):
            return [numbers(self.words(text))]
        return [v.added[p] if p in v.added else numbers(self.words(p)) for p in v.splitter.split(text) if p]

    def learn(self) -> None:
        """Encode the words that were met since the last time, all by one index."""
        fresh = list(islice(self.number, len(self.codes), None))
        self.codes += encode_words((w.encode() for w in fresh), self.vocabulary)

    def forget(self) -> None:
        """Start anew if too many words, or bytes of words, are remembered."""
        if len(self.codes) > MEMORY or sum(map(len, self.codes)) > MEMORY_BYTES:
            self.number, self.codes = Numbers(), []

    def ids(self, pieces: list[int | np.ndarray]) -> np.ndarray:
        """The ids, unsigned 32-bit, of what ``read`` gave, after ``learn``."""
        code = self.codes.__getitem__
        parts = [p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(code, p.tolist())) for p in pieces]
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        read = [self.read(t) for t in texts]
        self.learn()
        return [self.ids(p) for p in read]

    def decode(self, ids: np.ndarray) -> str:
        return self.vocabulary.decode(ids.astype(np.int64)).decode("utf-8", errors="replace")


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """A partition's batches, all at once or, of a larger partition, in portions of about PARTITION_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PARTITION_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Every whole text encoded, and decoded again from its ids.

    Returns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (UTF-8), and on
    request ``ids`` array<bigint>. A null text is empty and has no ids; added tokens in a text become their own
    ids; repeated rows repeat. No shuffle: the distinct words of a partition (of PARTITION_BYTES of it at a time, as texts wait in
    memory for their words) go through one index. ``path`` is the vocabulary file; the driver reads it, and its
    tables reach the tasks as one broadcast, so executors need not have the file. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = docs.sparkSession.createDataFrame([], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * ids).schema
    arrow = to_arrow(schema)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for held in portions(batches):
            encoder.forget()
            read = [[encoder.read(text) for text in batch.column(1).to_pylist()] for batch in held]
            encoder.learn()
            for batch, texts in zip(held, read, strict=True):
                found = [encoder.ids(pieces) for pieces in texts]
                columns = [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([hashlib.sha256(f.tobytes()).hexdigest() for f in found], pa.string())]
                columns.append(pa.array([hashlib.sha256(encoder.decode(f).encode()).hexdigest() for f in found], pa.string()))
                columns += [pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))] * ids
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def op4_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_pair_index_bpe": op4_pair_index_bpe}
SQL: dict[str, str] = {}
