"""Repeated passages: windows of WINDOW words that occur earlier in the corpus, wherever they lie in their lines.

Two equal windows hold the same anchor, the GRAM words of the least hash in them. Anchors are found text by text; those
whose hash occurs once drop out; around the others every window is looked up by its hash. Words are folded as in
paragraphs, so letter case and white space, line ends too, make no difference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, pieces, release
from .suffix_dedup import PLACE, _powers, merge, runs

WINDOW, GRAM = 50, 25
#: Parts that the windows of one hash are dealt to.
SALTS = 16
#: Windows that a task gathers before it hands them on.
TOLD = 1 << 16
_FOLD = bytes.maketrans(UPPER.encode() + b"\t\n\x0b\x0c\r", LOWER.encode() + b"     ")
_WORD = re.compile(rb"[^ ]+")
_BLANKS = re.compile(rb"[ \t\x0b\x0c\r]*")


def word_hashes(text: str | None) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in (text or "").encode().translate(_FOLD).split(b" ") if w], np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k words, by prefix sums of a polynomial."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(words))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])))
    h = (sums[k:] - sums[:-k]) * inverse[: len(words) - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of words, the position and the hash of its leftmost least gram; equal windows have equal hashes."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(words, GRAM)
    ranked = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(ranked, WINDOW - GRAM + 1).min(1)
    found = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    return found, h[found]


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the leftmost least of some window of words."""
    found, h = window_anchors(words)
    found, at = np.unique(found, return_index=True)
    return found, h[at]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows, hs, ns = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            h, n = np.unique(anchors(word_hashes(text))[1], return_counts=True)
            rows.append(np.full(len(h), i))
            hs.append(h)
            ns.append(n)
        at = pa.array(np.concatenate(rows).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ns).astype(np.int64))], names=["dk", "th", "h", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, h, dk, th, at): every window whose anchor (h) is asked."""
    for batch in pieces(batches):
        rows, ws, hs, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (text, hashes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            words = word_hashes(text)
            h = window_anchors(words)[1]
            found = np.flatnonzero(np.isin(h.view(np.int64), np.array(hashes, np.int64)))
            rows.append(np.full(len(found), i))
            ws.append(gram_hashes(words, WINDOW)[found])
            hs.append(h[found])
            ats.append(found)
        take = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ws).view(np.int64)), pa.array(np.concatenate(hs).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(ats))], names=["w", "h", "dk", "th", "at"])


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (w, part, later, dk, th, at) sorted within their anchors by w and later: (dk, th, at, source) of windows that follow
    their first place and don't overlap it, those of a document that come near each other in one row."""
    held: list[list[np.ndarray]] = []

    def told() -> pa.RecordBatch:
        dk, th, at, source = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((at, th, dk))
        dk, th, at, source = dk[order], th[order], at[order], source[order]
        first = np.flatnonzero(np.concatenate(([True], (dk[1:] != dk[:-1]) | (th[1:] != th[:-1])))[: len(dk)])
        ends = pa.array(np.append(first, len(dk)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at, source)]
        return pa.RecordBatch.from_arrays([pa.array(dk[first]), pa.array(th[first]), *lists], names=["dk", "th", "at", "source"])

    head = np.zeros((4, 1), np.int64)  # w, dk, th, at of the last first place; at start none
    some = False
    for batch in batches:
        w, _, later, dk, th, at = (batch.column(i).to_numpy() for i in range(6))
        first = np.flatnonzero(later == 0)
        heads = np.concatenate((head, np.stack([w[first], dk[first], th[first], at[first]])), 1)
        mine = np.cumsum(later == 0)  # which head is before each row
        hw, hdk, hth, hat = heads[:, mine]
        keep = (later == 1) & (hw == w) & ((mine > 0) | some) & ((hdk != dk) | (hth != th) | (at >= hat + WINDOW))
        held.append([x[keep] for x in (dk, th, at, hdk)])
        if sum(len(x[0]) for x in held) >= TOLD:
            yield told()
        some, head = some or len(first) > 0, heads[:, -1:]
    if held:
        yield told()


def repeats(docs: DataFrame) -> DataFrame:
    """(dk, th, at, sources) for keyed docs (dk, th, text): the words at which a window starts that occurs earlier, and the dk of first places.

    A window that overlaps its own first place is no repeat.
    """
    docs = docs.select("dk", "th", "text")
    found = materialize(docs.mapInArrow(_asked, "dk long, th long, h long, n long"), "passage-anchors")
    again = materialize(found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "passage-repeated")
    asked = found.join(again, "h", "left_semi").groupBy("dk", "th").agg(F.collect_set("h").alias("hs"))
    windows = materialize(docs.join(asked, ["dk", "th"]).mapInArrow(_windows, "w long, h long, dk long, th long, at long"), "passage-windows")
    release(found, again)
    first = windows.groupBy("w").agg(F.min(F.struct("dk", "th", "at")).alias("f"), F.min("h").alias("h"), F.count("*").alias("n")).where("n > 1").select("w", "h", "f")
    # Windows of an anchor meet, dealt by document to SALTS parts, each with the place of the first before them.
    part = F.pmod(F.xxhash64("dk", "th"), F.lit(SALTS)).cast("int")
    heads = first.select("h", "w", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"), F.lit(0).alias("later"), "f.dk", "f.th", "f.at")
    both = heads.union(windows.select("h", "w", part, F.lit(1), "dk", "th", "at")).repartition("h", "part").sortWithinPartitions("h", "part", "w", "later")
    late = both.select("w", "part", "later", "dk", "th", "at").mapInArrow(_late, "dk long, th long, at array<long>, source array<long>")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    cuts = materialize(late.groupBy("dk", "th").agg(every("at").alias("at"), every("source").alias("sources")), "passage-cuts")
    release(windows)
    return cuts


def cut(text: str, at: list[int]) -> tuple[str, int]:
    """The text without the windows that start at these words, and the number of passages cut; the lines' ends stay."""
    data = text.encode()
    words = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    parts, end, own = [], 0, merge([(a, b + WINDOW) for a, b in runs(np.bincount(np.array(at)) > 0)])
    for a, b in own:
        parts += [data[end : words[a][0]], b"\n" * data.count(b"\n", words[a][0], words[b - 1][1])]
        end = _BLANKS.match(data, words[b - 1][1]).end()
    return b"".join([*parts, data[end:]]).decode(), len(own)


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(dk, th, text, n_passages, passage_chars): the keyed docs that lose passages, once each, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(2).to_pylist()
            new = [cut(t, at) for t, at in zip(texts, batch.column(3).to_pylist(), strict=True)]
            counts = [pa.array(x, pa.int64()) for x in ([n for _, n in new], [len(t) - len(s) for t, (s, _) in zip(texts, new, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in new], pa.string()), *counts], names=["dk", "th", "text", "n_passages", "passage_chars"])

    hit = docs.select("dk", "th", "text").join(found.select("dk", "th", "at"), ["dk", "th"])
    return hit.mapInArrow(run, "dk long, th long, text string, n_passages long, passage_chars long").dropDuplicates(["dk", "th"])
