"""Packing documents into training sequences: Karmarkar-Karp multiway differencing over pieces of token ids."""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CAPACITY = 2048
SEPARATOR = 1
#: Fixed values of the vocabulary: its one special token and that token's id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Windows that are differenced together, and words whose ids a worker remembers: both bound memory, neither drops input.
WINDOWS = 8
REMEMBERED = 200_000
#: Characters of a very long text that are split into words at once.
SLICE = 1 << 20
#: Two white-space characters in a row; there a blank need not begin a token.
_BLANKS = re.compile(r"\s\s")


class _Words(dict):
    """Ids, as bytes, of a word with its leading blank."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = np.asarray(self.encode(" " + word), "<u4").tobytes()
        return ids


class Encoder:
    """The ids that ``tokenizers`` gives with byte_bpe_50k.json, special strings recognized, none added.

    The rank file of the same vocabulary gives the same ids at a fraction of the time. A single blank between two
    other characters always begins a token there, so ids of such words are remembered and joined.
    """

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("quire", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self.plain)

    def _part(self, text: str) -> bytes:
        if not text:
            return b""
        if text[-1].isspace() or text[0].isspace() or _BLANKS.search(text):
            return np.asarray(self.plain(text), "<u4").tobytes()
        at = text.find(" ")
        if at < 0:
            return np.asarray(self.plain(text), "<u4").tobytes()
        out = [np.asarray(self.plain(text[:at]), "<u4").tobytes()]
        while at >= 0:
            to = text.find(" ", at + SLICE)
            out.append(b"".join(map(self.words.__getitem__, (text[at + 1 : to] if to >= 0 else text[at + 1 :]).split(" "))))
            at = to
        return b"".join(out)

    def __call__(self, text: str) -> np.ndarray:
        special = np.array([SPECIAL_ID], "<u4").tobytes()
        return np.frombuffer(special.join(map(self._part, text.split(SPECIAL))), "<u4")


@cache
def encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


def differenced(lengths: list[int], ways: int) -> list[list[int]]:
    """Indexes of ``lengths`` in ``ways`` sets with near-equal sums: Karmarkar-Karp multiway differencing.

    A partial partition holds ``ways`` sums. The two partitions with the widest spreads are merged again and again,
    the largest sums of one with the smallest of the other, so that their imbalances oppose each other.
    """
    heap = [(-n, i, [(0, ())] * (ways - 1) + [(n, (i,))]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(ways)]
    ticket = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sums = sorted(((x + y, (s, t)) for (x, s), (y, t) in zip(a, reversed(b), strict=True)), key=lambda p: p[0])
        low = sums[0][0]
        spread = sums[-1][0] - low
        heapq.heappush(heap, (-spread, ticket, sums))
        ticket += 1

    def flat(tree) -> list[int]:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                out.append(x)
            else:
                todo.extend(reversed(x))
        return out

    return [flat(tree) for _, tree in heap[0][2]]


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of uncut pieces; their number rises whenever one would exceed ``capacity``.

    Each piece must fit in a window by itself.
    """
    if any(n > capacity for n in lengths):
        raise ValueError("a piece exceeds the capacity")
    ways = max(1, -(-sum(lengths) // capacity))
    while True:
        found = differenced(lengths, ways)
        if max(sum(lengths[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        ways += 1


class _Packer:
    """Packs one task's documents as they come; holds the pieces of ``WINDOWS`` sequences at most."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next, self.rows = capacity, task << 33, []
        self.held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, tokens of the document
        self.total = 0

    def sequence(self, pieces: list[tuple[int | None, int, np.ndarray, int]]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        c, n = self.capacity, len(ids)
        whole = n - n % c
        for at in range(0, whole, c):
            self.sequence([(doc_id, at, ids[at : at + c], n)])
        if whole < n:
            self.held.append((doc_id, whole, ids[whole:], n))
            self.total += n - whole
        if self.total >= (WINDOWS + 1) * c:
            self.flush()

    def flush(self) -> None:
        """As many full sequences as what is held allows; less than one stays held.

        Whole pieces are shared out over windows by :func:`windows`, whose number rises where one would overflow. What
        room the windows have left is filled with cuts of the pieces after them, then of the emptiest windows.
        """
        n = size = 0
        while n < len(self.held) and size + len(self.held[n][2]) <= WINDOWS * self.capacity:
            size += len(self.held[n][2])
            n += 1
        some, rest = self.held[:n], self.held[n:][::-1]
        found = [[some[i] for i in w] for w in windows([len(p[2]) for p in some], self.capacity)]
        found.sort(key=lambda w: -sum(len(p[2]) for p in w))
        left: list[tuple[int | None, int, np.ndarray, int]] = []
        while found:
            window = found.pop(0)
            room = self.capacity - sum(len(p[2]) for p in window)
            while room and (rest or found):
                if not rest:
                    rest = found.pop()
                doc_id, start, ids, tokens = rest.pop()
                take = min(room, len(ids))
                window.append((doc_id, start, ids[:take], tokens))
                if take < len(ids):
                    rest.append((doc_id, start + take, ids[take:], tokens))
                room -= take
            if room:
                left = window
            else:
                self.sequence(window)
        self.held = left + rest[::-1]
        self.total = sum(len(p[2]) for p in self.held)

    def close(self) -> None:
        """What is left: full sequences, then lengths that are powers of two, which need no padding."""
        while self.total >= self.capacity:
            self.flush()
        pieces = self.held[::-1]
        for power in reversed(range(self.capacity.bit_length())):
            if not self.total >> power & 1:
                continue
            room, own = 1 << power, []
            while room:
                doc_id, start, ids, n = pieces.pop()
                take = min(room, len(ids))
                own.append((doc_id, start, ids[:take], n))
                if take < len(ids):
                    pieces.append((doc_id, start + take, ids[take:], n))
                room -= take
            self.sequence(own)
        self.held, self.total = [], 0


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens; no sequence needs padding.

    A document is its text's ids and then id 1. Full-length pieces are sequences by themselves; the remainders of
    consecutive documents are shared out by multiway differencing, over more windows where one would overflow, and cuts
    fill what room is left. Each task packs what it reads: no shuffle, and a
    repeated task gives the same rows. Null and empty texts are one id; repeated rows and null ids are documents of
    their own; other columns are ignored; an empty table gives no rows. ``capacity`` is a power of two.
    """
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    types = [pa.int64()] * 7
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(ranks_path), _Packer(TaskContext.get().partitionId(), capacity)
        end = np.array([SEPARATOR], "<u4")
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), end]))
                if len(packer.rows) >= 8192:
                    yield table(packer.rows)
                    packer.rows = []
        packer.close()
        if packer.rows:
            yield table(packer.rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
