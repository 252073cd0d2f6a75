"""Operator 8: byte-level BPE encoding and decoding over length-bucketed padded matrices."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this merge by a heap instead: a matrix row costs the square of its length.
WIDEST = 256
#: Entries that a worker's memory of pieces holds at most; it starts anew beyond.
MEMORY = 400_000


class Codec:
    """Encodes pieces of text by ranks. A pair of ids merges if its joined bytes have a rank; the lowest rank merges first, the leftmost of equals."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # White space is Unicode's, as in the Rust engine; Python's \s holds four more control characters.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        vals = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.shift = np.uint64(64 - 21)
        self.slots, self.vals, self.probes = np.full(1 << 21, 2**64 - 1, np.uint64), np.full(1 << 21, NONE, np.int32), 0
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # every round places one key of each free slot that is asked for
            self.probes += 1
            free = self.slots[at] == np.uint64(2**64 - 1)
            first = np.unique(at[free], return_index=True)[1]
            won = left[free][first]
            self.slots[at[free][first]], self.vals[at[free][first]] = keys[won], vals[won]
            stay = ~np.isin(left, won)
            left, at = left[stay], (at[stay] + np.uint64(1)) & np.uint64((1 << 21) - 1)
        self.memory: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if they don't merge; negative ids are padding."""
        keys = (a.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (b.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.vals[at], NONE)
        for _ in range(1, self.probes):
            at = (at + np.uint64(1)) & np.uint64((1 << 21) - 1)
            hit = self.slots[at] == keys
            out[hit] = self.vals[at[hit]]
        out[(a < 0) | (b < 0)] = NONE
        return out

    def encode_bucket(self, found: list[bytes], width: int) -> list[bytes]:
        """The ids of each piece of at most `width` bytes, as little-endian 32-bit integers."""
        n = len(found)
        sizes = np.fromiter(map(len, found), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in found), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.of_byte[raw], -1).astype(np.int32)
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows, out, col = np.arange(n), [b""] * n, np.arange(width)
        while len(rows):
            at = ranks.argmin(1)  # the first of equals: the leftmost
            i = np.arange(len(rows))
            low = ranks[i, at]
            done = low == NONE
            if done.any():
                for r, x, m in zip(rows[done].tolist(), ids[done], sizes[done].tolist(), strict=True):
                    out[r] = x[:m].tobytes()
                go = ~done
                rows, ids, ranks, sizes, at, low = rows[go], ids[go], ranks[go], sizes[go], at[go], low[go]
                i = np.arange(len(rows))
                if not len(rows):
                    break
            # Closes the gap behind the merged pair.
            move = np.minimum(col + (col > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, move, 1), np.take_along_axis(ranks, move, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            ids[i, at] = low
            sizes = sizes - 1
            after = np.where(at + 1 < width, ids[i, np.minimum(at + 1, width - 1)], -1)
            ranks[i, at] = self.rank(low, after)
            prev = at > 0
            ranks[i[prev], at[prev] - 1] = self.rank(ids[i[prev], at[prev] - 1], low[prev])
            most = int(sizes.max())
            if most < width // 2 and width > 4:  # rows have grown short: narrower matrices
                width = max(most, 2)
                ids, ranks, col = ids[:, :width], ranks[:, :width], np.arange(width)
        return out

    def encode_long(self, piece: bytes) -> bytes:
        """As encode_bucket, for a piece of any length: a heap of pairs over a linked list."""
        ids, n = self.of_byte[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] < n and (q := self.pairs.get((ids[x], ids[nxt[x]]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[nxt[x]]))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def learn(self, asked: set[str]) -> None:
        """Adds the ids of pieces to the memory, bucket by bucket of like lengths."""
        buckets: dict[int, list[str]] = {}
        for p in asked:
            n = len(p.encode())
            buckets.setdefault(1 << max(1, (n - 1).bit_length()) if n <= WIDEST else 0, []).append(p)
        for width, found in buckets.items():
            if not width:
                self.memory.update((p, self.encode_long(p.encode())) for p in found)
                continue
            rows = max(1, (1 << 20) // width)
            for k in range(0, len(found), rows):
                part = found[k : k + rows]
                self.memory.update(zip(part, self.encode_bucket([p.encode() for p in part], width), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        missing = {p for parts in split for p in parts if p not in self.memory}
        if len(missing) + len(self.memory) > MEMORY:
            self.memory.clear()
            missing = {p for parts in split for p in parts}
        self.learn(missing)
        get = self.memory.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): the ids of every whole text (null: empty) and, of those ids, the bytes again.

    path: a file of ranks, readable on the executors; pattern: splits texts before the merges. Rows stay as they
    are, repeated ones too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in pieces(batches):
            found = own.encode(batch.column(1).to_pylist())
            flat = np.frombuffer(b"".join(found), "<i4")
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            back = pa.array([own.decode(np.frombuffer(x, "<i4")) if decoded else None for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, back], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
