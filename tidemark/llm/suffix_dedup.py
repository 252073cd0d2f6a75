"""Operator 3: exact removal of repeated byte strings, by suffixes sorted deep-shallow.

A string of `length` bytes that occurs twice holds, in both places, the same anchor: the k-byte gram of the least
hash in it. Anchors are found text by text; those whose hash occurs once drop out; the suffixes at the others (and,
to the left, the reversed prefixes) are sorted by multikey quicksort to a shallow depth, and by blind tries below.
Two strings around anchors are equal iff their parts left and right of the anchor are, which the two orders with
their common-prefix lengths tell for every offset.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces

LENGTH = 400
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 64
#: Contexts of one anchor that a task compares at most; beyond, every string is counted by its hash, in parts.
GROUP = 200_000
#: Suffixes sorted at once, and text bytes they may hold.
BATCH = 20_000
#: Bits of a ranked hash that hold the position: texts of up to a gigabyte.
PLACE = np.uint64(30)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse (mod 2**64) to the powers 0 to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        m = max(1 << 17, 1 << int(n).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(m, b, np.uint64)))) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes of data, by prefix sums of a polynomial."""
    power, inverse = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * power[: len(data)])))
    h = (sums[k:] - sums[:-k]) * inverse[: len(data) - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-byte grams (k = length / 2) that are the leftmost least of some `length` bytes of data."""
    k = length // 2
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, k)
    w = length - k + 1  # grams in a string
    n = len(h)
    # The leftmost least of every window of w, by running minima from both ends of blocks of w. The upper bits of a
    # hash decide and the position breaks ties, alike in every text.
    ranked = (h >> PLACE << PLACE) | np.arange(n, dtype=np.uint64)
    block = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    block[:n] = ranked
    block = block.reshape(-1, w)
    left = np.minimum.accumulate(block, 1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    found = np.unique(least[np.concatenate(([True], least[1:] != least[:-1]))] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    return found, h[found]


def lcp(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - -(-x.bit_length() // 8)


class BlindTrie:
    """Orders strings by a trie of branching depths alone: a search reads one byte at each branch, and one string in full."""

    def __init__(self, texts: list[bytes], members: list[int]) -> None:
        self.texts, self.root = texts, None
        for i in members:
            self.insert(i)

    def insert(self, i: int) -> None:
        text, node = self.texts[i], self.root
        if node is None:
            self.root = [i]
            return
        byte = lambda d: text[d] if d < len(text) else -1
        while isinstance(node, tuple):  # blind: to any leaf that agrees on the branching bytes so far
            depth, kids = node
            node = kids.get(byte(depth)) or next(iter(kids.values()))
        other = self.texts[node[0]]
        d = lcp(text, other)
        if d == len(text) == len(other):
            node.append(i)  # equal strings share a leaf
            return
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < d:
            parent, key = node, byte(node[0])
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == d:
            node[1][byte(d)] = [i]
            return
        fresh = (d, {byte(d): [i], (other[d] if d < len(other) else -1): node})
        if parent is None:
            self.root = fresh
        else:
            parent[1][key] = fresh

    def walk(self) -> Iterator[tuple[int, int]]:
        """Members in order, each with its common-prefix length with the one before (the first: -1)."""
        stack, depth = [(self.root, -1)], -1
        while stack:
            node, before = stack.pop()
            if isinstance(node, tuple):
                d, kids = node
                for n, key in enumerate(sorted(kids, reverse=True)):
                    stack.append((kids[key], before if n == len(kids) - 1 else d))
            else:
                depth = before
                for i in node:
                    yield i, depth
                    depth = len(self.texts[i])


def deep_shallow(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of texts, and each one's common-prefix length with the one before it in that order (the first: 0)."""
    order, prefix = [], []
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.frombuffer(b"".join(t[:SHALLOW].ljust(SHALLOW, b"\0") for t in texts), ">u8").reshape(len(texts), SHALLOW // 8).astype(np.uint64)
    stack: list[tuple[np.ndarray, int]] = [(np.arange(len(texts)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 1 or depth == words.shape[1] or len(rows) <= 8:
            for i, d in BlindTrie(texts, rows.tolist()).walk():
                prefix.append(d if d >= 0 else (lcp(texts[order[-1]], texts[i]) if order else 0))
                order.append(i)
            continue
        key = words[rows, depth]
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]  # multikey quicksort: less, equal (one word deeper), more
        for part, deeper in ((rows[key > pivot], depth), (rows[key == pivot], depth + 1), (rows[key < pivot], depth)):
            if len(part):
                stack.append((part, deeper))
    return np.array(order, np.int64), np.array(prefix, np.int64)


def repeated_offsets(left: list[bytes], right: list[bytes], times: np.ndarray, length: int) -> np.ndarray:
    """For contexts around anchors (left reversed): a matrix whether the `length` bytes that start o before the anchor occur elsewhere, o = 0 to length / 2."""
    k, n = length // 2, len(left)
    out = np.zeros((n, k + 1), bool)
    n_left, n_right = np.fromiter(map(len, left), np.int64, n), np.fromiter(map(len, right), np.int64, n)
    by_right, lcp_right = deep_shallow(right)
    by_left, lcp_left = deep_shallow(left)
    cls_right, cls_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(k + 1):
        cls_right[by_right] = np.cumsum(lcp_right < length - o)
        cls_left[by_left] = np.cumsum(lcp_left < o)
        ok = np.flatnonzero((n_left >= o) & (n_right >= length - o))
        if not len(ok):
            continue
        key = cls_left[ok] * (n + 1) + cls_right[ok]
        _, which, many = np.unique(key, return_inverse=True, return_counts=True)
        out[ok, o] = (many[which] > 1) | (times[ok] > 1)
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of every run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, l, r, n, places): of each distinct context (c: a hash of it) in a piece of work one row.

    n: how often it occurs there. places: where, as runs of positions of one text at most `length` apart, which
    remove one run of bytes whatever the context's offsets are; so periodic texts have few.
    """
    k = length // 2
    for batch in pieces(batches):
        found: dict[tuple[int, bytes, bytes], list] = {}
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for dk, th, text, hashes in zip(*cols, strict=True):
            data, asked = (text or "").encode(), set(hashes)
            at, h = anchors(data, length)
            for p, v in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                if v in asked:
                    own = found.setdefault((v, data[max(0, p - k) : p][::-1], data[p : p + length]), [0, []])
                    own[0] += 1
                    if own[1] and own[1][-1][:2] == (dk, th) and own[1][-1][2] <= p <= own[1][-1][3] + length:
                        own[1][-1] = (*own[1][-1][:3], p)
                    else:
                        own[1].append((dk, th, p, p))
        place = pa.list_(pa.struct([("dk", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
        rows = [(h, int.from_bytes(hashlib.blake2b(left + b"/" + right, digest_size=8).digest(), "big", signed=True), left, right, n, [dict(zip(("dk", "th", "first", "last"), x, strict=True)) for x in at]) for (h, left, right), (n, at) in found.items()]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), place)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=["h", "c", "l", "r", "n", "places"])


def _offsets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From contexts (h, c, l, r, n) sorted by h: (h, c, low, high), the runs of offsets whose strings occur again.

    Groups of one h are held whole, many at a time; the places of a context stay outside.
    """
    held: dict[tuple[int, bytes, bytes], list] = {}

    def flush() -> pa.RecordBatch:
        keys, times = list(held), np.array([x[1] for x in held.values()], np.int64)
        group = Counter(x[0] for x in keys)
        # An anchor with one context needs no sorting: all its strings occur as often as it does.
        alone = np.array([group[x[0]] == 1 for x in keys])
        offsets = np.arange(length // 2 + 1)
        flags = np.array([(offsets <= len(x[1])) & (offsets >= length - len(x[2])) for x in keys]) & (times > 1)[:, None]
        some = np.flatnonzero(~alone).tolist()
        flags[some] = repeated_offsets([keys[i][1] for i in some], [keys[i][2] for i in some], times[some], length)
        out = [(keys[i][0], held[keys[i]][0], a, b) for i in np.flatnonzero(flags.any(1)).tolist() for a, b in runs(flags[i])]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["h", "c", "low", "high"])

    last = None
    for batch in batches:
        for h, c, left, right, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if h != last and len(held) >= BATCH:
                yield flush()
            last = h
            held.setdefault((h, left, right), [c, 0])[1] += n
    if held:
        yield flush()


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts of hot anchors to (h, c, n, w, o): a 128-bit hash of each string around the anchor."""
    for batch in batches:
        for h, c, left, right, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            whole, p = left[::-1] + right, len(left)
            offs = [o for o in range(min(length // 2, p) + 1) if p - o + length <= len(whole)]
            keys = [hashlib.blake2b(whole[p - o : p - o + length], digest_size=16).digest() for o in offs]
            yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(offs), pa.int64()) for x in (h, c, n)), pa.array(keys, pa.binary()), pa.array(offs, pa.int64())], names=["h", "c", "n", "w", "o"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Byte runs to remove, (dk, th, runs array<struct<s, e>>), unmerged, and the keyed documents.

    A row's key: dk, its doc_id, and th, a hash of its text; rows that share it are copies and each counts.
    """
    dk = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select("doc_id", "text", dk.alias("dk"), F.xxhash64("text").alias("th"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            who, hs, ns = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                h, n = np.unique(anchors((text or "").encode(), length)[1], return_counts=True)
                who.append(np.full(len(h), i))
                hs.append(h)
                ns.append(n)
            rows = pa.array(np.concatenate(who).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ns).astype(np.int64))], names=["dk", "th", "h", "n"])

    long = keyed.where(F.octet_length("text") >= length)
    found = materialize(long.select("dk", "th", "text").mapInArrow(grams, "dk long, th long, h long, n long"), "suffix-anchors")
    again = materialize(found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "suffix-repeated")
    asked = found.join(again.select("h"), "h", "left_semi").groupBy("dk", "th").agg(F.collect_set("h").alias("hs"))
    texts = long.select("dk", "th", "text").join(asked, ["dk", "th"])
    place = "places array<struct<dk:long,th:long,first:long,last:long>>"
    near = materialize(texts.mapInArrow(lambda b: _contexts(b, length), f"h long, c long, l binary, r binary, n long, {place}"), "suffix-contexts")
    contexts = near.select("h", "c", "l", "r", "n")
    hot = near.groupBy("h").count().where(F.col("count") > GROUP).select("h")
    offsets = "h long, c long, low long, high long"
    if hot.isEmpty():
        again = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _offsets(b, length), offsets)
    else:
        hot = materialize(hot, "suffix-hot")
        again = contexts.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _offsets(b, length), offsets)
        seen = materialize(contexts.join(hot, "h", "left_semi").mapInArrow(lambda b: _windows(b, length), "h long, c long, n long, w binary, o long"), "suffix-windows")
        # One string shows around each of its anchors: it counts by anchor and offset, once a place.
        many = seen.groupBy("h", "o", "w").agg(F.sum("n").alias("n")).where("n > 1").select("h", "o", "w")
        again = again.union(seen.join(many, ["h", "o", "w"], "left_semi").select("h", "c", "o", F.col("o")).distinct())
    places = near.select("h", "c", F.explode("places").alias("p")).select("h", "c", "p.*")
    spans = places.join(again, ["h", "c"]).select("dk", "th", (F.col("first") - F.col("high")).alias("s"), (F.col("last") - F.col("low") + length).alias("e"))
    return spans.distinct().groupBy("dk", "th").agg(F.collect_list(F.struct("s", "e")).alias("runs")), keyed


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs as the fewest disjoint ones, touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<s, e>>, kept binary) for every row of docs; texts without spans have kept null.

    Texts are UTF-8 bytes, null an empty one; spans are the removed runs. Texts of under `length` bytes lose nothing.
    Copies remove each other, rows of the same doc_id too. doc_id is an integer.
    """
    spans, keyed = repeated_spans(docs, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kept, gone = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, parts = text.encode(), 0, []
                own = merge([(x["s"], x["e"]) for x in found])
                for s, e in own:
                    parts.append(data[at:s])
                    at = e
                kept.append(b"".join([*parts, data[at:]]))
                gone.append([{"s": s, "e": e} for s, e in own])
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in batch.column(1).to_pylist()], pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    spans = materialize(spans, "suffix-spans")
    hit = keyed.where(F.octet_length("text") >= length).join(spans, ["dk", "th"]).select("doc_id", "text", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut_rows = hit.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<s:long,e:long>>, kept binary").select("doc_id", "n_bytes", "spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")
    # The rest keep their bytes: hashed where they are read, only keys are shuffled.
    bare = keyed.select("doc_id", "dk", "th", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    rest = bare.join(spans.select("dk", "th"), ["dk", "th"], "left_anti")
    return cut_rows.unionByName(rest.select("doc_id", "n_bytes", F.array().cast("array<struct<s:bigint,e:bigint>>").alias("spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept")))
