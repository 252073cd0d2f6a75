"""Operator 2: best-fit-decreasing packing of token pieces into sequences."""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces

#: Words that a worker remembers about at most.
MEMORY = 500_000
#: Bytes of text that are split into chunks at a time.
SPLIT_BYTES = 2 << 20
#: Signs that no piece of the tokenizer shares with a letter before them: no apostrophe (contractions), nothing that composes.
SIGNS = ".,;:!?%&|$#*)]}\""
#: Words of Latin letters; a dotted capital I has no lower-case letter of its own.
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
#: Pieces of one length are numbered in so many parts.
PARTS = 512


class Bins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest capacity that still fits.

    Bins of one capacity are runs of consecutive numbers, so the tree's size depends on the capacity alone.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)  # bins below each node
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # of each capacity: (first bin, bins)

    def add(self, capacity: int, first: int, n: int) -> None:
        self.runs[capacity].append((first, n))
        self._count(capacity, n)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Up to `most` bins of one run of that capacity: (first, bins)."""
        first, n = self.runs[capacity].pop()
        if n > most:
            self.runs[capacity].append((first + most, n - most))
            n = most
        self._count(capacity, -n)
        return first, n

    def _count(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.tree[i] += n
            i //= 2

    def tightest(self, size: int) -> int | None:
        """The least capacity of at least `size` with an open bin."""
        i = self.leaves + size
        if self.tree[i]:
            return size
        while i > 1:  # up until a right neighbour holds bins, then down to its first
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over `counts` pieces of each length: moves (length, first rank, pieces, first bin, pieces a bin, offset).

    Pieces of one length are alike, and the bin that has just taken one is still the tightest while another fits;
    so a whole run of bins is filled in one step, with the same result as one piece after another. The plan's size
    follows the distinct lengths (at most the capacity), not the pieces.
    """
    bins, moves, opened = Bins(capacity), [], 0
    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            room = bins.tightest(size)
            if room is None:
                room, per = capacity, capacity // size
                first, n = opened, -(-left // per)
                opened += n
            else:
                per = room // size
                first, n = bins.take(room, -(-left // per))
            full = min(left // per, n)
            if full:
                moves.append((size, rank, full * per, first, per, capacity - room))
                if room > per * size:
                    bins.add(room - per * size, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n:  # the last bin takes fewer
                moves.append((size, rank, left, first + full, left, capacity - room))
                if room > left * size:
                    bins.add(room - left * size, first + full, 1)
                rank, left = rank + left, 0
    return moves


#: The tokenizer's own tokens begin and end so.
OWN = ("<|", "|>")


class Memory(dict):
    """Ids by string; starts anew once it holds MEMORY strings."""

    def trim(self) -> None:
        if len(self) > MEMORY:
            self.clear()


def plain(word: str) -> bool:
    """Small Latin letters alone: a single piece of the tokenizer, whose last id alone ends a word."""
    return word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0250")


class Tokens:
    """Ids of texts. Chunks between spaces and line ends are encoded by themselves: the tokenizer drops white space and none of its pieces spans it.

    A chunk of Latin letters with signs behind is encoded as the lower-case word and the signs: the tokenizer folds
    case and splits there as well. A text that may hold one of the tokenizer's own tokens is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memory()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _together(self, words: list[str]) -> None:
        """Encodes plain words in one text and cuts its ids where words end."""
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            coded, start = ids.tobytes(), 0
            for c, stop in zip(part, stops.tolist(), strict=True):
                self.words[c] = coded[start:stop]
                start = stop

    def _look_up(self, asked: list[str]) -> list[bytes]:
        """The ids of each string, from memory or the tokenizer."""
        words = self.words
        words.trim()
        found = list(map(words.get, asked))
        missing = [x for x, ids in zip(asked, found, strict=True) if ids is None]
        self._together([x for x in missing if plain(x)])
        rest = [x for x in missing if not plain(x)]
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                words[c] = struct.pack(f"<{len(ids)}I", *ids) if (ids := e.ids) else b""
        return [words[x] if ids is None else ids for x, ids in zip(asked, found, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        word = pc.utf8_rtrim(chunks, SIGNS)
        latin = pc.match_substring_regex(word, LATIN)
        keys = pc.if_else(latin, pc.utf8_lower(word), chunks).dictionary_encode()
        ids = self._look_up(keys.dictionary.to_pylist())
        ids = list(map(ids.__getitem__, keys.indices.to_numpy().tolist()))
        signed = pc.indices_nonzero(pc.and_(latin, pc.not_equal(pc.binary_length(word), pc.binary_length(chunks))))
        signs = [c[len(w) :] for c, w in zip(chunks.take(signed).to_pylist(), word.take(signed).to_pylist(), strict=True)]
        distinct = list(set(signs))
        behind = dict(zip(distinct, self._look_up(distinct), strict=True))
        for i, x in zip(signed.to_pylist(), signs, strict=True):
            ids[i] += behind[x]
        at, get = coded.indices.to_numpy().tolist(), ids.__getitem__
        sizes = pc.list_value_length(split).to_pylist()
        out = [b"".join(map(get, at[stop - n : stop])) for n, stop in zip(sizes, itertools.accumulate(sizes), strict=True)]
        for i in pc.indices_nonzero(pc.and_(*(pc.match_substring(texts, x).fill_null(False) for x in OWN))).to_pylist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


@functools.lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part[, ids]): each text's ids and the end id, cut every `capacity` ids.

    A null text is an empty one: a single piece that holds the end id. part: a stable number below PARTS.
    """
    import os

    tail = int(end).to_bytes(4, "little")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, step = tokens(path), 4 * capacity
        for batch in pieces(batches, limit=SPLIT_BYTES):
            row, piece, length, crc, ids = [], [], [], [], []
            for i, x in enumerate(own.encode(batch.column(1))):
                x += tail
                for k in range(0, len(x), step):
                    part = x[k : k + step]
                    row.append(i)
                    piece.append(k // step)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            at = pa.array(piece, pa.int32())
            cols = [batch.column(0).take(pa.array(row, pa.int64())), at, pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.split(" ")[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def assign(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """items (length, ...) with sequence_id and offset, by best-fit decreasing over all of them.

    Only the number of pieces of each length (at most `capacity` rows) reaches the driver. A piece's rank among those
    of its length is its rank in one of PARTS parts plus the pieces in parts before; the plan turns ranks to places.
    items must be a written table: it is read three times.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")
    dealt = items.withColumn("part", part)
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    # Lengths are at most `capacity`, so this table has at most capacity * PARTS rows, however many pieces there are.
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves = plan(counts, capacity)
    by: dict[int, np.ndarray] = {}
    for m in moves:
        by.setdefault(m[0], []).append(m)
    by = {k: np.array(v, np.int64) for k, v in by.items()}
    ranked = dealt.withColumn("local", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("local") + F.col("before")).drop("local", "before", "part")
    names = [f for f in ranked.columns if f != "rank"]
    schema = ", ".join(f"`{f}` {ranked.schema[f].dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            bins, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length).tolist():
                at = np.flatnonzero(length == s)
                m = by[s][np.searchsorted(by[s][:, 1], rank[at], "right") - 1]
                inside = rank[at] - m[:, 1]
                bins[at], offset[at] = m[:, 3] + inside // m[:, 4], m[:, 5] + inside % m[:, 4] * s
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f)) for f in names] + [pa.array(bins), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Every text's token pieces with their place: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Repeated rows are packed as often as they occur; ties among pieces of one length go by doc_id and piece.
    """
    found = materialize(token_pieces(docs, path, capacity, end, with_ids), "packing-pieces")
    return assign(found, capacity, ["doc_id", "piece", "ids_crc32"])
