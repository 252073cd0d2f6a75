"""Operator 6: language-model scores by logistic mixing of hashed-context bit predictors.

A text is a run of units: words with the white space behind them, cut after SPAN bytes, the last one with the end of
the text. A unit's bytes are predicted bit by bit. Two predictors count, over all training texts, the units that begin
as this one does: among all units, and among those of texts alike in their words that follow the same kind of unit.
Three more have hashed contexts of one to three bytes. A gate (how often the contexts were seen) selects the weights that mix the predictors' log odds; the
weights are trained online, predicting each unit without one of its own occurrences, and an adaptive table over the
byte so far refines the mixed probability. The counts grow with the corpus and stay in written tables: every distinct
unit is predicted once, beside those that begin alike, and texts meet their units' costs in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fold, materialize, pieces, release
from .suffix_dedup import _powers

#: Bytes of a unit at most.
SPAN = 16
#: Bytes before a bit in the hashed contexts, and slots of each (as powers of two): so short contexts fill up at some size.
ORDERS, SLOT_BITS = (1, 2, 3), (16, 18, 21)
#: What is before a unit: an end (of a line, a sentence, or nothing), anything else, the same word.
KINDS = 3
#: Classes of texts by their words (so languages fall apart); slots that words are hashed to; passes over all training texts, and starts that share them.
TOPICS, TOPIC_BITS, TOPIC_PASSES, TOPIC_STARTS = 8, 9, 10, 8
#: Tasks of such a pass at most: each sends its sums to the driver.
TOPIC_TASKS = 64
#: Lengths of a text's direction and of a class's: their products stay below 2**24, so single precision is exact in any order.
UNIT, CENTRE = 255, 4_095
#: Of units and words, the most common that every scorer knows; the rest meet their costs and counts in a join.
HOT_UNITS, HOT_WORDS = 1_000_000, 500_000
#: Distinct units and words that a counting task holds before it passes their counts on.
HELD = 1_200_000
#: Bytes of text that a task takes apart at once: what it holds beside them is some 60 times as much.
PIECE = 1 << 20
#: Units to an online stream, and to one of its steps, about.
STREAM, STEP = 200_000, 16_384
TRIES = len(ORDERS) + 2
GATES = 32
RATE = 0.05
_PRIOR, _CLIP, _BUCKETS, _APM_PRIOR = 0.4, 12.0, 33, 8.0
_TOP = np.uint64(1 << 63)
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LETTER = np.random.default_rng(6).integers(1, 2**63, 256).astype(np.uint64)
_LETTER[np.frombuffer(UPPER.encode(), np.uint8)] = _LETTER[np.frombuffer(LOWER.encode(), np.uint8)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of numbers."""
    h = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        h = (h ^ x.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX2
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Units:
    """The units of texts: up to SPAN bytes as two big-endian numbers, their size, the kind of unit before; where each text's begin."""

    a: np.ndarray
    b: np.ndarray
    size: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    # Words of the same texts: a hash of the folded word, and the text it is in.
    word: np.ndarray
    word_text: np.ndarray

    def key(self) -> np.ndarray:
        return mixed(self.a, self.b, self.size, self.kind)


def _flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts with their ends, SPAN more, the size of each, and which bytes are white space."""
    data = [((t or "").encode().replace(b"\0", b"\0\1") if t and "\0" in t else (t or "").encode()) + b"\0\0" for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join([*data, b"\0" * SPAN]), np.uint8)
    return flat, sizes, _SPACE[flat[: int(sizes.sum())]]


def _words(flat: np.ndarray, ends: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, runs of what is neither white space nor the end, folded; the text that each is in."""
    n = len(space)
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = ~space
    letter[ends] = letter[ends - 1] = False
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    low, high = edge[::2], edge[1::2]
    power, inverse = _powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[flat[:n]] * power[:n])))
    return mixed((sums[high] - sums[low]) * inverse[low], high - low), np.searchsorted(ends, low, "right")


def units(texts: list[str | None]) -> Units:
    flat, sizes, space = _flat(texts)
    n, ends = len(space), np.cumsum(sizes)
    stop = space.copy()
    stop[ends - 1] = True
    start = np.concatenate(([0], np.flatnonzero(stop)[:-1] + 1)) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    if len(size) and size.max() > SPAN:
        parts = (size - 1) // SPAN + 1
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + inside * SPAN
        size = np.diff(np.append(start, n))
    eight = np.lib.stride_tricks.sliding_window_view(flat, 8)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    a = np.ascontiguousarray(eight[start]).view(">u8").ravel().astype(np.uint64) & (every << (64 - 8 * np.minimum(size, 8)).astype(np.uint64))
    more = np.maximum(size - 8, 0)
    b = np.ascontiguousarray(eight[start + 8]).view(">u8").ravel().astype(np.uint64) & np.where(more > 0, every << (64 - 8 * np.maximum(more, 1)).astype(np.uint64), np.uint64(0))
    last, before = flat[start - 1], flat[start - 2]
    kind = np.where(_SPACE[last], np.where(_ENDS[last] | _ENDS[before], 0, 1), 2).astype(np.int8)
    first = np.searchsorted(start, ends - sizes)
    kind[first] = 0
    return Units(a, b, size.astype(np.int8), kind, first, *_words(flat, ends, space))


def directions(word: np.ndarray, word_text: np.ndarray, texts: int) -> np.ndarray:
    """The roots of each text's counts of words by slot, whole numbers, UNIT long; zeros for a text without words."""
    m = 1 << TOPIC_BITS
    at = (word >> np.uint64(64 - TOPIC_BITS)).astype(np.int64)
    counts = np.bincount(word_text * m + at, minlength=texts * m).reshape(texts, m)
    return np.rint(UNIT * np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))).astype(np.float32)


def _centres(sums: np.ndarray) -> np.ndarray:
    """Sums of directions (whole numbers) as directions of their own, CENTRE long."""
    size = np.sqrt((sums.astype(float) ** 2).sum(-1, keepdims=True))
    return np.rint(CENTRE * sums / np.maximum(size, 1e-12)).astype(np.float32)


@dataclass
class Topics:
    """Classes of texts: each one's direction over the slots of words."""

    centres: np.ndarray

    def label(self, u: Units, texts: int) -> Units:
        """The units with kinds told apart by their texts' classes; a text without words is in the first."""
        own = (directions(u.word, u.word_text, texts) @ self.centres.T).argmax(1)
        kind = u.kind + KINDS * np.repeat(own, np.diff(np.append(u.first, len(u.a)))).astype(np.int8)
        return Units(u.a, u.b, u.size, kind, u.first, u.word, u.word_text)


def topics(docs: DataFrame) -> Topics:
    """Classes of all of docs (text) by spherical means, repeated rows as often as they occur.

    Every pass reads the directions of all texts and moves the centres of all starts; those of the start whose texts
    are nearest to their centres stay. Sums are whole numbers, so the result doesn't depend on partitions.
    """
    m = 1 << TOPIC_BITS

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE):
            flat, sizes, space = _flat(batch.column(0).to_pylist())
            x = directions(*_words(flat, np.cumsum(sizes), space), batch.num_rows).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[x.any(1)]], pa.binary())], names=["x"])

    written = materialize(docs.mapInArrow(told, "x binary"), "mixing-directions")
    # Starts are the directions of the least hashes.
    least = written.select("x", F.xxhash64("x").alias("h")).groupBy("h").agg(F.min("x").alias("x")).orderBy("h").limit(TOPICS * TOPIC_STARTS).collect()
    starts = np.array([np.frombuffer(r["x"], np.uint8) for r in least], np.int64).reshape(-1, m)
    if not len(starts):
        release(written)
        return Topics(np.zeros((TOPICS, m), np.float32))
    centres = _centres(np.resize(starts, (TOPIC_STARTS, TOPICS, m)))
    for _ in range(TOPIC_PASSES):

        def moved(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums, near = np.zeros((TOPIC_STARTS, TOPICS, m)), np.zeros(TOPIC_STARTS)
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, m).astype(np.float32)
                like = (x @ centres.reshape(-1, m).T).reshape(len(x), TOPIC_STARTS, TOPICS)
                own = like.argmax(2)
                near += like.max(2).sum(0, dtype=float)
                # Up to 65,793 rows of a batch, single precision is exact here too.
                sums += ((own[:, :, None] == np.arange(TOPICS)).reshape(len(x), -1).T.astype(np.float32) @ x).reshape(sums.shape)
            yield pa.RecordBatch.from_arrays([pa.array([y.astype("<i8").tobytes()], pa.binary()) for y in (sums, near)], names=["sums", "near"])

        rows = written.coalesce(TOPIC_TASKS).mapInArrow(moved, "sums binary, near binary").collect()
        sums, near = (sum(np.frombuffer(r[c], "<i8") for r in rows) for c in ("sums", "near"))
        sums = sums.reshape(centres.shape)
        before, centres = centres, np.where(sums.any(2, keepdims=True), _centres(sums), centres)
        if (before == centres).all():
            break
    release(written)
    return Topics(centres[near.argmax()])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of hashes, and where in it runs of equal ones begin; if others share its high bits, a hash may have several runs."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & low).astype(np.int64)
    own = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])


def _summed(kind: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The same rows, (nearly) each once, with the sum of n."""
    order, first = _runs(mixed(a, b, size, kind))
    at = order[first]
    return [kind[at], size[at], a[at], b[at], np.add.reduceat(n[order], first)]


def count_texts(docs: DataFrame, classes: Topics) -> DataFrame:
    """(kind, size, a, b, n) over all of docs (text, trains): units with their counts in training texts (0: elsewhere alone);
    kind -1: hashes of words (as a; 0 for the end of a text) in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            kind, size, a, b, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            for s in range(0, len(n), 1 << 16):
                part = slice(s, s + (1 << 16))
                cols = (kind[part].astype(np.int8), size[part].astype(np.int8), (a[part] ^ _TOP).view(np.int64), (b[part] ^ _TOP).view(np.int64), n[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["kind", "size", "a", "b", "n"])

        for batch in pieces(batches, limit=PIECE):
            u = classes.label(units(batch.column(0).to_pylist()), batch.num_rows)
            trains = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            own = np.repeat(trains, np.diff(np.append(u.first, len(u.a)))).astype(np.int64)
            word = np.concatenate((u.word[trains[u.word_text]], np.zeros(int(trains.sum()), np.uint64)))
            none = np.zeros(len(word), np.int8)
            held.append(_summed(u.kind, u.size, u.a, u.b, own))
            held.append(_summed(none - 1, none, word, none.astype(np.uint64), np.ones(len(word), np.int64)))
            if sum(len(x[0]) for x in held[1:]) > HELD // 2:
                held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > HELD:
                    yield from told()
        if held:
            yield from told()

    return docs.mapInArrow(run, "kind byte, size byte, a long, b long, n long")


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -_CLIP, _CLIP)))


def bit_length(x: np.ndarray) -> np.ndarray:
    high = (x >> np.uint64(32)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits each unit shares with the one before it (the first: -1)."""
    x = a[1:] ^ a[:-1]
    found = np.where(x != 0, 64 - bit_length(x), 128 - bit_length(b[1:] ^ b[:-1]))
    return np.concatenate(([-1], found))


def slots(gram: np.ndarray, order: int, place: np.ndarray) -> np.ndarray:
    """Of contexts (the last bytes before a byte, `place` bytes into a unit): what their slots are hashed with."""
    context = gram & np.uint64((1 << (8 * order)) - 1)
    return mixed(context | (np.minimum(place, order).astype(np.uint64) << np.uint64(32)), np.full(len(gram), order, np.uint64))


def slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    return (((context ^ (node.astype(np.uint64) * _MIX)) * _MIX2) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Mixer:
    """Counts of zeros and ones by slot for each order, totals by first two bytes; weights by gate, the adaptive table."""

    zeros: list[np.ndarray]
    ones: list[np.ndarray]
    prefixes: np.ndarray  # by kind in its class of texts and first two bytes
    weights: np.ndarray
    apm: np.ndarray

    @staticmethod
    def untrained(prefixes: np.ndarray) -> Mixer:
        """prefixes: (TOPICS * KINDS, 65536) counts of units by kind and first two bytes."""
        centre = squash(np.linspace(-8, 8, _BUCKETS))
        size = [1 << k for k in SLOT_BITS]
        return Mixer([np.zeros(k, np.float32) for k in size], [np.zeros(k, np.float32) for k in size], prefixes, np.full((GATES, TRIES), 0.3), np.tile(centre, (256, 1)))

    def depths(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For depths 0 to 16, counts by the first bits: of all units, by kind."""
        if not hasattr(self, "_depths"):
            out = []
            for d in range(17):
                own = self.prefixes.reshape(TOPICS * KINDS, 1 << d, -1).sum(2, dtype=np.float64)
                out.append((own.sum(0)[None], own))
            self._depths = out
        return self._depths

    def predictions(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, kind: np.ndarray, n: np.ndarray, without: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """For each bit of units sorted by (a, b), all that share a prefix of two bytes among them: the rows it is a bit of, which prediction is whose, and of each prediction how often it is made, node, bit, log odds of what comes (by predictor), gate.

        Units of a kind that begin alike up to the end of a byte share its predictions.
        without: as if each unit had occurred once less.
        """
        rows = np.argsort(kind.astype(np.int8), kind="stable")
        every, share = n.astype(np.float64), shared_bits(a, b)
        at = rows  # of units in order of their kinds: their places in the order of bytes
        a, b, kind, times = a[rows], b[rows], kind[rows], every[rows]
        own = shared_bits(a, b)
        own[1:][kind[1:] != kind[:-1]] = -1
        # Units that never occur, once, or more often: without one of their own occurrences, they are predicted apart.
        often = np.minimum(n[rows], 2).astype(np.int64) if without else np.zeros(len(rows), np.int64)
        size_all, size = size, size[rows]
        for j in range(SPAN):
            keep = size > j
            if not keep.any():
                return
            if not keep.all():  # no other unit begins with all of one, so what ends here takes its whole run along
                keep_all = size_all > j
                every, share, size_all = every[keep_all], share[keep_all], size_all[keep_all]
                at = (np.cumsum(keep_all) - 1)[at[keep]]
                rows, a, b, size, kind, times, own, often = (x[keep] for x in (rows, a, b, size, kind, times, own, often))
            new = own < 8 * (j + 1)
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            code = 3 * group + often
            found = np.bincount(code, minlength=3 * len(first)) > 0
            which = (np.cumsum(found) - 1)[code]
            of, sort = np.divmod(np.flatnonzero(found), 3)
            made = np.bincount(which, times, len(of))
            unit = first[of]
            two, kinds = (a[unit] >> np.uint64(48)).astype(np.int64), kind[unit]
            minus, once = (sort > 0).astype(np.float64), (sort == 1).astype(np.float32)
            among = (np.zeros(len(unit), np.int64), kinds)
            if j > 1:
                new_all = share < 8 * (j + 1)
                first_all = np.flatnonzero(new_all)
                begins = (share[first_all], np.add.reduceat(every, first_all), (np.cumsum(new_all) - 1)[at[unit]]), (own[first], np.add.reduceat(times, first), of)

            def totals(d: int) -> list[np.ndarray]:
                if d <= 16:
                    return [table[own_, two >> (16 - d)] for table, own_ in zip(self.depths()[d], among, strict=True)]
                fresh = [(share_ < d, counts, place) for share_, counts, place in begins]
                return [np.add.reduceat(counts, np.flatnonzero(new_))[(np.cumsum(new_) - 1)[place]] for new_, counts, place in fresh]

            high, low = a[unit], b[unit]
            byte = ((high >> np.uint64(56 - 8 * j)) if j < 8 else (low >> np.uint64(120 - 8 * j))).astype(np.int64) & 255
            gram = (high >> np.uint64(64 - 8 * j) if j else np.zeros(len(unit), np.uint64)) if j <= 8 else (high << np.uint64(8 * j - 64)) | (low >> np.uint64(128 - 8 * j))
            contexts = [slots(gram, o, np.full(len(unit), j)) for o in ORDERS]
            seen = totals(8 * j)
            for i in range(8):
                node, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
                after, ones = totals(8 * j + i + 1), bit == 1
                x = np.empty((TRIES, len(unit)), np.float32)
                gate = np.zeros(len(unit), np.int64)
                for k in range(2):
                    x[k] = (after[k] - minus + _PRIOR) / (seen[k] - after[k] + _PRIOR)
                for k, context in enumerate(contexts):
                    where = slot(context, node, SLOT_BITS[k])
                    one, none = self.ones[k][where], self.zeros[k][where]
                    this, other = np.where(ones, one, none), np.where(ones, none, one)
                    this = np.maximum(this - once, 0)
                    x[2 + k] = (this + np.float32(_PRIOR)) / (other + np.float32(_PRIOR))
                gate += (this + other) >= 4
                for k in range(2):
                    times_seen = seen[k] - minus
                    gate = gate * 4 + (times_seen >= 1) + (times_seen >= 4) + (times_seen >= 32)
                yield rows, which, made, node, bit, np.log(x, out=x), gate
                seen = after

    def inputs(self, *unit: np.ndarray, without: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """The same for every row by itself: for each bit the rows it is a bit of, node, bit, log odds of what comes, gate."""
        for rows, which, _, node, bit, x, gate in self.predictions(*unit, without=without):
            yield rows, node[which], bit[which], x.T[which], gate[which]

    def refine(self, node: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The adaptive table's probability of a one at log odds z, between its places."""
        pos = (np.clip(z, -8, 8) + 8) * ((_BUCKETS - 1) / 16)
        low = np.minimum(pos.astype(np.int64), _BUCKETS - 2)
        up = pos - low
        return self.apm[node, low] * (1 - up) + self.apm[node, low + 1] * up

    def cost(self, *unit: np.ndarray) -> np.ndarray:
        """log10 of the probability of each unit (a, b, size, kind, n), sorted by (a, b)."""
        total = np.zeros(len(unit[0]))
        byte = 0.0
        for rows, which, _, node, bit, x, gate in self.predictions(*unit, without=False):
            z = self.odds(x, gate)
            fine = self.refine(node, np.where(bit == 1, z, -z))
            p = 0.5 * squash(z) + 0.5 * np.where(bit == 1, fine, 1 - fine)
            byte = np.log10(np.clip(p, 1e-6, 1 - 1e-6)) + (byte if node[0] > 1 else 0.0)
            if node[0] > 127:
                total[rows] += byte[which]
        return total

    def odds(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The log odds of predictors as mixed by their gates' weights."""
        return sum(self.weights[:, k][gate] * x[k] for k in range(TRIES))

    def learn(self, pace: np.ndarray, used: np.ndarray, hits: np.ndarray, total: np.ndarray, *unit: np.ndarray) -> None:
        """Online steps over the bits of units; pace: squares of earlier steps; used: counts by gate; hits and total: by place in the adaptive table."""
        for _, _, times, node, bit, x, gate in self.predictions(*unit, without=True):
            z = self.odds(x, gate)
            err, weight = (1 - squash(z)) * times, np.bincount(gate, times, GATES)
            step = np.stack([np.bincount(gate, err * x[k], GATES) for k in range(TRIES)], 1) / np.maximum(weight, 1)[:, None]
            pace += step * step
            self.weights += RATE * step / np.sqrt(pace + 1e-9)
            used += weight
            place = np.round((np.clip(np.where(bit == 1, z, -z), -8, 8) + 8) * ((_BUCKETS - 1) / 16)).astype(np.int64)
            at = node * _BUCKETS + place
            total += np.bincount(at, times, 256 * _BUCKETS).reshape(256, _BUCKETS)
            hits += np.bincount(at, times * bit, 256 * _BUCKETS).reshape(256, _BUCKETS)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """a, b, size, kind and n of rows (kind, size, a, b, n)."""
    kind, size, a, b, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    return [a.view(np.uint64) ^ _TOP, b.view(np.uint64) ^ _TOP, size, kind.astype(np.int64), n]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n): three bytes of context, a byte, and how far into a unit; counted once for every distinct unit, HELD of them together at most."""
    held: list[list[np.ndarray]] = []

    def summed() -> list[np.ndarray]:
        g, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = _runs(mixed(g))
        return [g[order[first]], np.add.reduceat(n[order], first)]

    def told() -> pa.RecordBatch:
        g, n = summed()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])

    for batch in batches:
        a, b, size, _, _ = _columns(batch)
        gram, found = np.zeros(len(a), np.uint64), []
        for j in range(SPAN):
            own = ((a >> np.uint64(56 - 8 * j)) if j < 8 else (b >> np.uint64(120 - 8 * j))) & np.uint64(255)
            gram = ((gram << np.uint64(8)) | own) & np.uint64(0xFFFFFFFF)
            found.append((gram | np.uint64(min(j, 3) << 32))[size > j])
        held.append(list(np.unique(np.concatenate(found), return_counts=True)))
        if sum(len(x[0]) for x in held[1:]) > HELD // 2:
            held[:] = [summed()]
            if len(held[0][0]) > HELD // 2:
                yield told()
    if held:
        yield told()


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From grams (g, n), for each order (o): the slots met, as packed numbers, with their zeros and ones."""
    zeros, ones = ([np.zeros(1 << k) for k in SLOT_BITS] for _ in range(2))
    for batch in batches:
        g, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(float)
        place, byte = (g >> np.uint64(32)).astype(np.int64), (g & np.uint64(255)).astype(np.int64)
        before = (g >> np.uint64(8)) & np.uint64(0xFFFFFF)
        for k, o in enumerate(ORDERS):
            context = slots(before, o, place)
            for i in range(8):
                at = slot(context, (1 << i) | (byte >> (8 - i)), SLOT_BITS[k])
                bit = (byte >> (7 - i)) & 1
                np.add.at(zeros[k], at, n * (1 - bit))
                np.add.at(ones[k], at, n * bit)
    for k in range(len(ORDERS)):
        every = np.flatnonzero(zeros[k] + ones[k])
        for s in range(0, len(every), 1 << 16):
            met = every[s : s + (1 << 16)]
            cols = [met.astype("<i4").tobytes(), zeros[k][met].astype("<f4").tobytes(), ones[k][met].astype("<f4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], names=["o", "at", "zeros", "ones"])


def _streams(found: DataFrame, count: int) -> DataFrame:
    """Units dealt by their first two bytes to streams of about STREAM, whatever the partitions; sorted within each."""
    two = F.shiftright("a", 48)
    dealt = found.withColumn("stream", F.pmod(F.xxhash64(two), F.lit(max(1, -(-count // STREAM)))).cast("int"))
    return dealt.repartition("stream").sortWithinPartitions("stream", "a", "b", "kind").select("kind", "size", "a", "b", "n", "stream")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """Each stream with its steps: about STEP units, cut where the first two bytes change."""
    held, last = [], -1

    def steps() -> list[list[np.ndarray]]:
        own = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        two = own[0] >> np.uint64(48)
        edges, cuts = np.flatnonzero(two[1:] != two[:-1]) + 1, [0]
        for e in edges.tolist():
            if e - cuts[-1] >= STEP:
                cuts.append(e)
        return [[x[s:e] for x in own] for s, e in zip(cuts, [*cuts[1:], len(two)], strict=True)]

    for batch in batches:
        stream = batch.column(5).to_numpy()
        cuts = [0, *(np.flatnonzero(stream[1:] != stream[:-1]) + 1).tolist(), len(stream)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if held and stream[s] != last:
                yield last, steps()
            last = int(stream[s])
            held.append(_columns(batch.slice(s, e - s)))
    if held:
        yield last, steps()


def train(found: DataFrame) -> tuple[Mixer, int]:
    """The mixer of all units (kind, size, a, b, n), a written table, and how many units there are.

    What reaches the driver is bounded: counts by two bytes, by slot, and a few thousand numbers for each stream.
    """
    spark, seen = found.sparkSession, found.where("n > 0")
    counts = seen.groupBy("kind", (F.shiftright("a", 48) + 32768).alias("two")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).toPandas()
    # Double precision: a total that is rounded can be less than the counts of what follows it.
    prefixes = np.zeros((TOPICS * KINDS, 65536))
    prefixes[counts["kind"].to_numpy(int), counts["two"].to_numpy(int)] = counts["n"].to_numpy(float)
    mixer = Mixer.untrained(prefixes)
    grams = seen.select("kind", "size", "a", "b", "n").mapInArrow(_grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    for o, at, zeros, ones in grams.repartition(4).mapInArrow(_slot_counts, "o int, at binary, zeros binary, ones binary").toLocalIterator():
        where = np.frombuffer(at, "<i4")
        mixer.zeros[o][where] += np.frombuffer(zeros, "<f4")
        mixer.ones[o][where] += np.frombuffer(ones, "<f4")
    count = int(counts["rows"].sum())
    told = spark.sparkContext.broadcast(mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream, steps in _steps(batches):
            whole = told.value
            own = Mixer(whole.zeros, whole.ones, whole.prefixes, whole.weights.copy(), whole.apm)
            pace, used, hits, total = np.zeros((GATES, TRIES)), np.zeros(GATES), np.zeros((256, _BUCKETS)), np.zeros((256, _BUCKETS))
            for step in steps:
                own.learn(pace, used, hits, total, *step)
            cols = [x.astype("<f8").tobytes() for x in (own.weights, used, hits, total)]
            yield pa.RecordBatch.from_arrays([pa.array([stream], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], names=["stream", "weights", "used", "hits", "total"])

    weights, used = np.zeros((GATES, TRIES)), np.zeros((GATES, 1))
    hits, total = np.zeros((256, _BUCKETS)), np.zeros((256, _BUCKETS))
    rows = _streams(found.where("n > 0"), count).mapInArrow(run, "stream int, weights binary, used binary, hits binary, total binary").collect()
    for row in sorted(rows, key=lambda r: r["stream"]):
        own = np.frombuffer(row["used"], "<f8")[:, None]
        weights += np.frombuffer(row["weights"], "<f8").reshape(GATES, TRIES) * own
        used += own
        hits += np.frombuffer(row["hits"], "<f8").reshape(256, _BUCKETS)
        total += np.frombuffer(row["total"], "<f8").reshape(256, _BUCKETS)
    mixer.weights = np.where(used > 0, weights / np.maximum(used, 1e-9), mixer.weights)
    mixer.apm = (hits + _APM_PRIOR * mixer.apm) / (total + _APM_PRIOR)
    told.destroy()
    return mixer, count


def costs(found: DataFrame, mixer: Mixer, count: int) -> DataFrame:
    """(key, cost, n): log10 of the probability of every unit after its kind of unit."""
    told = found.sparkSession.sparkContext.broadcast(mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, steps in _steps(batches):
            for a, b, size, kind, n in steps:
                key = mixed(a, b, size, kind)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(told.value.cost(a, b, size, kind, n)), pa.array(n)], names=["key", "cost", "n"])

    written = materialize(_streams(found, count).mapInArrow(run, "key long, cost double, n long"), "mixing-costs")
    told.destroy()
    return written


@dataclass
class Table:
    """Values by 64-bit hash, in two levels of slots; of keys that meet in a slot, the commonest is held."""

    levels: list[tuple[int, int, np.ndarray, np.ndarray]]
    held: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        """keys: the commonest first."""
        levels, total = [], 0
        for shift in (0, 24):
            bits = max(4, (len(keys) * (1 + (shift > 0))).bit_length())
            at = ((keys << np.uint64(shift)) >> np.uint64(64 - bits)).astype(np.int64)
            slots_, first = np.unique(at, return_index=True)
            # What an empty slot holds belongs to another slot.
            own = ((~np.arange(1 << bits, dtype=np.uint64)) << np.uint64(64 - bits)) >> np.uint64(shift)
            found = np.zeros(1 << bits)
            own[slots_], found[slots_] = keys[first], values[first]
            levels.append((shift, bits, own, found))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            total += len(first)
            keys, values = keys[rest], values[rest]
        return Table(levels, total)

    def look_up(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the asked keys (0 where there is none), and which are held."""
        out, known = np.zeros(len(asked)), np.zeros(len(asked), bool)
        left = np.arange(len(asked))
        for shift, bits, own, values in self.levels:
            key = asked[left]
            at = ((key << np.uint64(shift)) >> np.uint64(64 - bits)).astype(np.int64)
            hit = own[at] == key
            out[left[hit]], known[left[hit]] = values[at[hit]], True
            left = left[~hit]
        return out, known


def _most(df: DataFrame, key: str, value: str, most: int) -> Table:
    """The commonest rows: those above the lowest step of n that leaves at most `most`."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    sizes, cut, held = {r["level"]: r["count"] for r in df.where("n > 0").groupBy(level.alias("level")).count().collect()}, 1 << 20, 0
    for step in sorted(sizes, reverse=True):
        held += sizes[step]
        if held > most:
            break
        cut = step
    some = df.where((F.col("n") > 0) & (level >= cut)).select(key, value, "n").toArrow()
    keys, values, n = (some.column(i).to_numpy() for i in range(3))
    order = np.lexsort((keys, n))[::-1]
    return Table.of(keys[order].view(np.uint64), values[order])


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row of docs.

    Learns from the texts outside the held-out fold (rows of a null doc_id too), repeated rows as often as they occur.
    A null text is an empty one: its only token is the end. base_score: the sum over tokens of log10((c+1)/(N+V+1));
    score: the model's log10 probability of the text's bytes and its end, the same however docs is partitioned; null
    bits_per_byte for an empty text. Words and units are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    classes = topics(docs.where(~out).select("text"))
    partial = count_texts(docs.select("text", (~out).alias("trains")), classes)
    # Tasks have summed their own rows, so sums before the exchange would gain nothing.
    counted = materialize(partial.repartition("kind", "size", "a", "b").groupBy("kind", "size", "a", "b").agg(F.sum("n").alias("n")), "mixing-counts")
    words = counted.where("kind = -1").select(F.col("a").bitwiseXOR(F.lit(-(1 << 63))).alias("key"), "n", F.log10(F.col("n").cast("double") + 1).alias("cost"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = counted.where("kind >= 0")
    mixer, count = train(found)
    priced = costs(found, mixer, count)
    common = _most(priced, "key", "cost", HOT_UNITS), _most(words, "key", "cost", HOT_WORDS)
    told = spark.sparkContext.broadcast(common)
    least = math.log10(total + distinct + 1)
    whole = common[1].held == distinct  # then words that aren't among the common ones aren't known at all
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["rid", "doc_id", "n_tokens", "n_known", "base", "score", "n_bytes", "what", "key", "tf"]

    def rare(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(Nearly) distinct (text, key), and how often each occurs."""
        order, first = _runs(mixed(text, key))
        at = order[first]
        return text[at], key[at], np.diff(np.append(first, len(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_table, word_table = told.value
        rid = (TaskContext.get().partitionId() + 1) << 33
        for batch in pieces(batches, limit=PIECE):
            texts, m = batch.column(1).to_pylist(), batch.num_rows
            u = classes.label(units(texts), m)
            sizes = np.diff(np.append(u.first, len(u.a)))
            key, of_text = u.key(), np.repeat(np.arange(m), sizes)
            cost, known = unit_table.look_up(key)
            scores = np.bincount(of_text, cost, m)
            missed = [(0, *rare(of_text[~known], key[~known]))]
            end, end_known = word_table.look_up(np.zeros(1, np.uint64))
            logs, known = word_table.look_up(u.word)
            tokens = np.bincount(u.word_text, minlength=m) + 1
            hits = np.bincount(u.word_text, known, m).astype(np.int64) + int(end_known[0])
            base = np.bincount(u.word_text, logs, m) + end[0] - tokens * least
            if not whole:
                missed.append((1, *rare(u.word_text[~known], u.word[~known])))
                if not end_known[0]:
                    missed.append((1, np.arange(m), np.zeros(m, np.uint64), np.ones(m, np.int64)))
            ids = np.arange(rid, rid + m)
            rid += m
            null = lambda k, t: pa.nulls(k, t)
            n_bytes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0), pa.array(tokens), pa.array(hits), pa.array(base), pa.array(scores), n_bytes, null(m, pa.int32()), null(m, pa.int64()), null(m, pa.int64())], names=names)
            for what, text, keys, tf in missed:
                if k := len(keys):
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[text]), null(k, batch.column(0).type), *(null(k, x) for x in kinds), pa.array(np.full(k, what, np.int32)), pa.array(keys.view(np.int64)), pa.array(tf.astype(np.int64))], names=names)

    schema = f"rid long, doc_id {kind}, n_tokens long, n_known long, base double, score double, n_bytes long, what int, key long, tf long"
    scored = materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "mixing-scores")
    values = priced.select(F.lit(0).alias("what"), "key", "cost").union(words.select(F.lit(1), "key", "cost"))
    rest = scored.where("what is not null").select("rid", "what", "key", "tf").join(values, ["what", "key"])
    sums = lambda what, x: F.sum(F.when(F.col("what") == what, x))
    rest = rest.groupBy("rid").agg(sums(0, F.col("tf") * F.col("cost")).alias("units"), sums(1, F.col("tf") * F.col("cost")).alias("words"), sums(1, F.col("tf")).alias("more"))
    zero = F.lit(0.0)
    found_score = F.col("score") + F.coalesce("units", zero) - math.log10(TOPICS)  # a text's class comes first
    return scored.where("what is null").join(rest, "rid", "left").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("words", zero)).alias("base_score"),
        found_score.alias("score"),
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -found_score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
