"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, by an agenda of adjacent symbol pairs.

A text gets a word mark in front and one for each space. Its symbols are characters first; the agenda holds the adjacent pairs whose
joined text is a piece, by score, then by place. The best pair is merged, which puts the pairs with its neighbours on the agenda; pairs
whose symbols have changed meanwhile are skipped. Symbols that are no piece become their bytes.

If no piece has a word mark behind another character, nothing merges across the place before a run of marks, so each
segment (a run of marks and what follows it) has an agenda of its own, and equal segments are encoded once. The fresh segments of an
Arrow batch are encoded together: short ones as rows of a matrix, a row being an agenda in place whose best pair is found by a scan, long ones
each by a heap. Then the sentencepiece library encodes them, too, and must agree.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty, to_arrow

MARK = "▁"
#: Segments a task remembers, and characters of the longest that it remembers; beyond the first it forgets all and starts anew.
MEMORY, LONGEST = 400_000, 64
#: Up to so many symbols a scan beats a heap. Rows that are merged together, about. Segments that the library is asked about in one text.
FEW, ROWS, ASKED = 24, 8192, 500
#: What is added to the code of a character that is no piece, to give its symbol; and the rank of a pair that is no piece.
OTHER, NONE = 1 << 21, np.iinfo(np.int32).max


class Pieces:
    """Scores, ids and bytes of a SentencePiece model's pieces; read on the driver, broadcast to the tasks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            self.model = file.read()
        library = SentencePieceProcessor(model_proto=self.model)
        if library.normalize("  a ") != f"{MARK * 3}a{MARK}":
            raise ValueError("only models that keep texts as they are, with a word mark in front, are supported")
        if not library.encode("a") or library.get_piece_size() < 256:
            raise ValueError("not a model with pieces")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i):
                self.bytes.append(b"" if library.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.scores[piece] = library.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.across = any(MARK in p.lstrip(MARK) for p in self.ids)
        # All ways to make a piece of two symbols, sorted by their key; ranks are places in the order of scores, equal for equal scores.
        place = {score: n for n, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        symbol = lambda part: self.ids.get(part, OTHER + ord(part) if len(part) == 1 else None)
        ways = [(a << 22 | b, place[self.scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None]
        self.keys, ranks, made = np.array(sorted(ways), dtype=np.int64).reshape(-1, 3).T.copy()
        self.ranks, self.made = ranks.astype(np.int32), made.astype(np.int32)

    def segments(self, text: str) -> list[str]:
        """The text with its marks, cut before each run of marks if no piece lies across such a place."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.across else SEGMENT(marked)

    def of_symbol(self, symbol: str) -> list[int]:
        found = self.ids.get(symbol)
        return [found] if found is not None else [self.byte_ids[b] for b in symbol.encode()]

    def symbols(self) -> np.ndarray:
        """The symbol of each character by its code."""
        out = np.arange(0x110000, dtype=np.int64) + OTHER
        for piece, i in self.ids.items():
            if len(piece) == 1:
                out[ord(piece)] = i
        return out

    def decode(self, ids: list[int]) -> str:
        """The pieces' text without the mark in front; bytes that make no character become U+FFFD."""
        first = bool(ids) and self.bytes[ids[0]].startswith(b" ") and ids[0] not in self.byte_ids
        return b"".join([self.bytes[i] for i in ids])[first:].decode("utf-8", errors="replace")


SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def merged_rows(rows: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Rows of symbols (padded with -1 on the right) after all merges; symbols that went into another are -1.

    ``rank`` has the agenda of each row: the ranks of the pairs that begin at each place. In each round every row that has a
    pair merges its best one, of equal ones the leftmost.
    """
    n, width = rows.shape
    symbol = np.full((n, width + 1), -1, dtype=np.int64)
    symbol[:, :width] = rows
    rank, way = np.full((n, width + 1), NONE, dtype=np.int32), np.zeros((n, width + 1), dtype=np.int32)
    after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))

    def look(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Put the pairs (i, j) of the rows on their agendas."""
        a, b = symbol[r, i], symbol[r, j]
        key = np.where((a >= 0) & (b >= 0), a << 22 | b, -1)
        at = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
        known = pieces.keys[at] == key
        rank[r, i] = np.where(known, pieces.ranks[at], NONE)
        way[r, i] = at

    every = np.arange(n)
    for i in range(width - 1):
        look(every, np.full(n, i), np.full(n, i + 1))
    left = every
    while len(left):
        i = rank[left].argmin(axis=1)
        going = rank[left, i] != NONE
        left, i = left[going], i[going]
        j = after[left, i]
        k = after[left, j]
        symbol[left, i] = pieces.made[way[left, i]]
        symbol[left, j] = -1
        rank[left, i] = rank[left, j] = NONE
        after[left, i] = k
        inside = k < width
        before[left[inside], k[inside]] = i[inside]
        look(left[inside], i[inside], k[inside])
        h = before[left, i]
        inside = h >= 0
        look(left[inside], h[inside], i[inside])
    return symbol[:, :width]


def merged_many(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """For many symbols the agenda is a heap."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list[tuple[float, int, int, int]] = []

    def add(i: int, j: int) -> None:
        piece = symbols[i] + symbols[j]
        score = scores.get(piece)
        if score is not None:
            heapq.heappush(agenda, (-score, i, j, len(piece)))

    for i in range(n - 1):
        add(i, i + 1)
    while agenda:
        _, i, j, size = heapq.heappop(agenda)
        # A symbol only grows or is emptied, so unchanged lengths mean unchanged symbols.
        if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            add(i, k)
        if before[i] >= 0:
            add(before[i], i)
    return [s for s in symbols if s]


class Encoder:
    """Encodes the texts of a batch; remembers segment -> (ids in decimal with a comma after each, decoded bytes)."""

    def __init__(self, pieces: Pieces):
        from sentencepiece import SentencePieceProcessor

        self.pieces, self.library, self.symbols = pieces, SentencePieceProcessor(model_proto=pieces.model), pieces.symbols()
        self.decimal = [b"%d," % i for i in range(len(pieces.bytes))]
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def segment_ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment; those of ROWS segments of like lengths are merged together."""
        ids: list[list[int]] = [[]] * len(segments)
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        order, many = order[sizes[order] <= FEW], order[sizes[order] > FEW].tolist()
        for n in many:
            ids[n] = [i for s in merged_many(list(segments[n]), self.pieces.scores) for i in self.pieces.of_symbol(s)]
        for start in range(0, len(order), ROWS):
            part = order[start : start + ROWS]
            codes = np.frombuffer("".join([segments[n] for n in part.tolist()]).encode("utf-32-le"), dtype="<u4")
            row, first = np.repeat(np.arange(len(part)), sizes[part]), np.cumsum(sizes[part]) - sizes[part]
            rows = np.full((len(part), int(sizes[part[-1]])), -1, dtype=np.int64)
            rows[row, np.arange(len(codes)) - np.repeat(first, sizes[part])] = self.symbols[codes]
            found = merged_rows(rows, self.pieces)
            alive = found >= 0
            flat, ends = found[alive].tolist(), alive.sum(axis=1).cumsum().tolist()
            plain = (found[alive].max() if flat else 0) < OTHER
            for n, i, j in zip(part.tolist(), [0, *ends], ends, strict=False):
                ids[n] = flat[i:j] if plain else [x for s in flat[i:j] for x in ([s] if s < OTHER else self.pieces.of_symbol(chr(s - OTHER)))]
        return ids

    def check(self, segments: list[str], ids: list[list[int]]) -> None:
        """Ask the library about the segments; a difference raises. Segments that end in no mark follow each other in one text, as they do in texts."""
        alone = [self.pieces.across or s[-1] == MARK for s in segments]
        marks, words = [n for n, x in enumerate(alone) if x], [n for n, x in enumerate(alone) if not x]
        asked = [words[i : i + ASKED] for i in range(0, len(words), ASKED)] + [[n] for n in marks if segments[n] != MARK]
        texts = ["".join([segments[n] for n in part])[1:].replace(MARK, " ") for part in asked]  # the library puts the mark in front
        for part, found in zip(asked, self.library.encode(texts, num_threads=1), strict=True):
            if found != list(chain.from_iterable([ids[n] for n in part])):
                raise ValueError(f"the library encodes otherwise: {[segments[n] for n in part][:10]!r}")

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """(number of ids, ids in decimal joined by commas, decoded text) of each text."""
        split = [self.pieces.segments(t) for t in texts]
        met = set(chain.from_iterable(split))
        if len(self.known) > MEMORY:
            self.known.clear()
        fresh = list(met - self.known.keys())
        ids = self.segment_ids(fresh)
        self.check(fresh, ids)
        decimal, own, known = self.decimal, self.pieces.bytes, self.known
        for segment, x in zip(fresh, ids, strict=True):
            known[segment] = b"".join([decimal[i] for i in x]), b"".join([own[i] for i in x])
        out = []
        for segments in split:
            parts, texts = zip(*map(known.__getitem__, segments), strict=True) if segments else ((), ())
            joined, decoded = b"".join(parts), b"".join(texts)[1:]  # without the mark in front
            out.append((joined.count(b","), joined[:-1], decoded.decode("utf-8", errors="replace")))
        for segment in fresh:
            if len(segment) > LONGEST:
                del known[segment]
        return out


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Every whole text encoded by the model at ``path``, without begin or end ids, and decoded again from its ids.

    Returns doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256 (UTF-8), and on request
    ``ids`` array<bigint> and ``decoded`` string. A null text is empty and has no ids; the word mark (U+2581) in a text counts as one and is
    decoded as a space, as in the library; texts of control symbols are ordinary text; null ids stay null, repeated rows repeat, an empty
    table gives an empty result, other columns are ignored. Very long texts without spaces are one segment, whose
    agenda takes n log n. No shuffle. The driver reads the model, which reaches the tasks as one broadcast.
    """
    small_batches(docs.sparkSession)
    schema = docs.sparkSession.createDataFrame([], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * ids).schema
    arrow = to_arrow(schema)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found = encoder.encode(batch.column(1).to_pylist())
            digest = lambda b: hashlib.sha256(b).hexdigest()
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([digest(f[1]) for f in found], pa.string()), pa.array([digest(f[2].encode()) for f in found], pa.string())]
            if ids:
                columns += [pa.array([np.array(f[1].split(b",") if f[1] else [], dtype=np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def op12_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_piece_agenda": op12_piece_agenda}
SQL: dict[str, str] = {}
