"""Operator 7: near-duplicate paragraphs by MinHash banding, exact Jaccard and components; then repeated passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import passages
from .common import LOWER, UPPER, components, materialize, packed, pieces, placed, release, unpacked

#: Paragraphs are lines of this many blanks-separated words or more.
MIN_WORDS = 20
SHINGLE, JACCARD = 5, 0.8
KEYS = ["dk", "th"]
#: 12 bands of 4 rows: paragraphs of similarity 0.8 meet with probability 0.998, of 0.9 with 0.99999.
BANDS, ROWS = 12, 4
#: The least of a bucket of more members is found by partial minima.
BUCKET = 50_000
#: Members on one side of a block in which all pairs are compared, and shared shingles looked at at once there.
BLOCK, SHARED = 2_000, 1 << 21
_FOLD = bytes.maketrans(UPPER.encode() + b"\t\n\x0b\x0c\r", LOWER.encode() + b"     ")
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS).astype(np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS).astype(np.uint64)


def shingles(text: str | None, size: int = SHINGLE, least: int = 0) -> list[int] | None:
    """Hashes of the word shingles of text, repeats included; a text of fewer words is one shingle. None under `least` words."""
    words = [w for w in (text or "").encode().translate(_FOLD).split(b" ") if w]
    if len(words) < least:
        return None
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [h(joined[a:b]) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For runs of shingle hashes: a matrix (runs, BANDS) of 64-bit bucket keys."""
    keys = np.empty((BANDS, len(starts)), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            mixed = hashes * _MUL[r] + _ADD[r]
            key = (key ^ np.minimum.reduceat(mixed, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        keys[b] = key
    return keys.T


def _scan(docs: DataFrame) -> DataFrame:
    """(dk, th, idx, lh, chars, bands) for every paragraph: its place, a hash of it, its length, its bucket keys (null, if the same piece of work has told them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, idx, chars, hashes, starts = [], [], [], [], []
            lh, seen, keyed_at = [], set(), []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    # At least as many blanks as words need; then what lies between them is counted.
                    if len(line) < 2 * MIN_WORDS - 1 or (found := shingles(line, SHINGLE, MIN_WORDS)) is None:
                        continue
                    h = xxhash.xxh64_intdigest(line.encode(), 42)
                    if h not in seen:
                        seen.add(h)
                        keyed_at.append(len(lh))
                        starts.append(len(hashes))
                        hashes += found
                    row.append(i)
                    idx.append(k)
                    chars.append(len(line))
                    lh.append(h)
            bands: list = [None] * len(lh)
            if starts:
                keys = band_keys(np.array(hashes, np.uint64), np.array(starts)).view(np.int64)
                for i, x in zip(keyed_at, keys, strict=True):
                    bands[i] = x
            at = pa.array(row, pa.int64())
            cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(idx, pa.int32()), pa.array(np.array(lh, np.uint64).view(np.int64)), pa.array(chars, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["dk", "th", "idx", "lh", "chars", "bands"])

    return docs.select("dk", "th", "text").mapInArrow(run, "dk long, th long, idx int, lh long, chars long, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with dk (doc_id, a null one as the least long) and th (a hash of the text); rows that share both count as one document."""
    return docs.withColumns({"dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "th": F.xxhash64("text")})


def bucketed(lines: DataFrame) -> DataFrame:
    """(lh, bands): every distinct text's hash with its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "line"):
            own = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            hashes, starts, ids = [], [], []
            for lh, line in own.items():
                if found := shingles(line):
                    starts.append(len(hashes))
                    ids.append(lh)
                    hashes += found
            if not ids:
                continue
            keys = band_keys(np.array(hashes, np.uint64), np.array(starts)).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), bands], names=["lh", "bands"])

    return lines.select("lh", "line").mapInArrow(run, "lh long, bands array<long>")


def by_band(written: DataFrame) -> DataFrame:
    """(bk, lh) of a table with lh and bands."""
    return written.select(F.explode("bands").alias("bk"), "lh")


def in_buckets(buckets: DataFrame) -> DataFrame:
    """(bk, lh, low): the members of buckets of two or more, with the least of the bucket."""
    # Every 64th member tells which buckets are large; either way gives the same rows.
    hot = buckets.where(F.pmod(F.xxhash64("lh", F.lit(5)), F.lit(64)) == 0).groupBy("bk").count().where(F.col("count") > BUCKET / 128).select("bk")
    low = F.min("lh").over(Window.partitionBy("bk"))
    high = F.max("lh").over(Window.partitionBy("bk"))

    def in_windows(rows: DataFrame) -> DataFrame:
        return rows.repartition("bk").dropDuplicates(["bk", "lh"]).withColumns({"low": low, "high": high}).where("low <> high").select("bk", "lh", "low")

    rows = buckets.select("bk", "lh")
    if hot.isEmpty():
        return in_windows(rows)
    hot = materialize(hot, "paragraph-hot")
    dealt = rows.join(F.broadcast(hot), "bk", "left_semi").distinct()
    least = dealt.groupBy("bk").agg(F.min("lh").alias("low"))
    return in_windows(rows.join(F.broadcast(hot), "bk", "left_anti")).union(dealt.join(F.broadcast(least), "bk").select("bk", "lh", "low"))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(lh, sh): the sorted distinct shingle hashes of texts (lh, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "line"):
            found = [np.unique(np.array(shingles(t), np.uint64)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["lh", "sh"])

    return texts.select("lh", "line").mapInArrow(run, "lh long, sh array<long>")


def _lists(col: pa.Array) -> list[np.ndarray]:
    values, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles have a Jaccard similarity of JACCARD or more."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True):
                same = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) >= JACCARD * max(len(s), len(t)) else 0
                keep.append(same > 0 and same >= JACCARD * (len(s) + len(t) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) where left[i] and right[j], sorted distinct shingles, have a Jaccard similarity of JACCARD or more."""
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    values, owner = np.concatenate(right), np.repeat(np.arange(len(right)), n_right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    asked = np.concatenate(left)
    low, high = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
    starts = np.concatenate(([0], np.cumsum(n_left)))
    shared = np.concatenate(([0], np.cumsum(high - low)))[starts]
    i = 0
    while i < len(left):
        k = max(i + 1, int(np.searchsorted(shared, shared[i] + SHARED, "right")) - 1)
        part = slice(starts[i], starts[k])
        many = high[part] - low[part]
        at = np.repeat(low[part] - np.cumsum(many) + many, many) + np.arange(many.sum())
        code, same = np.unique(np.repeat(np.repeat(np.arange(i, k), n_left[i:k]), many) * len(right) + owner[at], return_counts=True)
        a, b = code // len(right), code % len(right)
        ok = same >= JACCARD * (n_left[a] + n_right[b] - same)
        yield a[ok], b[ok]
        i = k


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bk, i, j, side, lh, class, sh) sorted by block (bk, i, j): links (a, b) from side 0 to side 1 across classes.

    All pairs of a block are compared; of links between the same classes, directly or over others, one is handed on.
    """
    held: list[tuple[int, int, int, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        left, right = [x for x in held if x[0] == 0], [x for x in held if x[0] == 1]
        held.clear()
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        if left and right:
            for a, b in similar_pairs([x[3] for x in left], [x[3] for x in right]):
                found = []
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if (c := top(left[i][2])) != (d := top(right[j][2])):
                        root[c] = d
                        found.append((left[i][1], right[j][1]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(2)], names=["a", "b"])

    last = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in range(6)]
        for bk, i, j, side, lh, label, sh in zip(*cols, _lists(batch.column(6)), strict=True):
            if (bk, i, j) != last:
                yield from flush()
                last = (bk, i, j)
            held.append((side, lh, label, sh))
    yield from flush()


def links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of JACCARD or more that join all such pairs of a bucket, directly or over others; more: further pairs to verify.

    Every member is first compared with the least of its bucket. Where a bucket's members are in several classes after
    that, all its pairs across classes are compared, in blocks; the class with the most members need not meet itself.
    members is a written table of in_buckets(); sets_of gives (lh, sh) for a table of lh.
    """
    pairs = members.where("lh <> low").select(F.col("low").alias("a"), F.col("lh").alias("b"))
    pairs = materialize((pairs if more is None else pairs.union(more)).distinct(), "paragraph-pairs")
    sets = materialize(sets_of(pairs.select(F.col("a").alias("lh")).union(pairs.select("b")).distinct()), "paragraph-sets")
    found = materialize(_verified(pairs, sets), "paragraph-stars")
    labels = components(found).toDF("lh", "class")
    rows = materialize(members.select("bk", "lh").join(labels, "lh", "left").withColumn("class", F.coalesce("class", "lh")), "paragraph-labelled")
    # Buckets of the same members, in other bands, count once.
    sign = [F.bit_xor(F.xxhash64("lh", F.lit(k))).alias(f"s{k}") for k in range(2)]
    open_ = rows.groupBy("bk").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), *sign).where("n > 2 and low <> high")
    open_ = materialize(open_.groupBy("s0", "s1", "n").agg(F.min("bk").alias("bk")).select("bk", "n"), "paragraph-open")
    if open_.isEmpty():
        return found
    rows = rows.join(open_, "bk")
    most = rows.groupBy("bk", "class").agg(F.count("*").alias("n")).groupBy("bk").agg(F.max(F.struct("n", "class")).alias("most"))
    rows = rows.join(most, "bk").withColumns({"nl": F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int"), "nr": F.ceil(F.col("n") / BLOCK).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("lh"), F.col(n)).cast("int")
    left = rows.where("class <> most.class").select("bk", own("nl").alias("i"), every("nr").alias("j"), F.lit(0).alias("side"), "lh", "class")
    right = rows.select("bk", every("nl").alias("i"), own("nr").alias("j"), F.lit(1).alias("side"), "lh", "class")
    dealt = left.union(right).join(sets, "lh").select("bk", "i", "j", "side", "lh", "class", "sh")
    block = ["bk", "i", "j"]
    across = dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_blocks, "a long, b long")
    across = materialize(across.distinct(), "paragraph-across")
    release(members, pairs, sets)
    return found.union(across)


def _sets_of_lines(lines: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(lh, sh) of the asked paragraphs, each read in one of its places."""
    place = lines.join(asked, "lh").groupBy("lh").agg(F.min(F.struct("dk", "th", "idx")).alias("p"))
    by_doc = place.select("lh", "p.*").groupBy("dk", "th").agg(F.collect_list(F.struct("idx", "lh")).alias("asked"))
    texts = docs.select("dk", "th", F.split("text", "\n").alias("l")).join(by_doc, ["dk", "th"])
    texts = texts.select("l", F.explode("asked").alias("x")).select(F.col("x.lh").alias("lh"), F.get("l", F.col("x.idx")).alias("line")).dropDuplicates(["lh"])
    return shingle_sets(texts)


def repeats(docs: DataFrame) -> DataFrame:
    """(dk, th, idx, chars, class, first, n) for every paragraph of keyed docs.

    class: the least paragraph hash among near-duplicates (links of JACCARD or more, closed over components);
    first: the place (dk, th, idx) of the class's first paragraph; n: the paragraphs in the class.
    """
    scan = materialize(_scan(docs), "paragraph-scan")
    lines = materialize(scan.drop("bands"), "paragraph-lines")
    members = materialize(in_buckets(by_band(scan)), "paragraph-members")
    release(scan)
    classes = components(links(members, lambda asked: _sets_of_lines(lines, docs, asked))).toDF("lh", "class")
    classed = materialize(lines.join(classes, "lh", "left").withColumn("class", F.coalesce("class", "lh")).drop("lh"), "paragraph-classes")
    place = F.struct("dk", "th", "idx")
    first = classed.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count_distinct("dk", "th", "idx").alias("n"))
    # A table of its own: so a common class's paragraphs are not dealt by class for both the sums and the join.
    first = materialize(first.where("first <> last").drop("last"), "paragraph-firsts")
    return classed.join(first, "class", "left").withColumns({"first": F.coalesce("first", place), "n": F.coalesce("n", F.lit(1).cast("long"))})


def _is_copy() -> Column:
    return F.col("first") != F.struct("dk", "th", "idx")


def _without_lines(own: DataFrame, found: DataFrame) -> DataFrame:
    """own (keyed) with repeated paragraphs cut from text; a text that loses nothing stays as it is, byte for byte."""
    gone = found.where(_is_copy()).groupBy("dk", "th").agg(F.collect_set("idx").alias("_gone"))
    cut = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return own.join(gone, ["dk", "th"], "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut)).select(*own.columns)


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_repeated, n_removed, removed_chars, copy_of, n_passages, passage_chars, cut_chars) for every row of docs (doc_id, text).

    n_repeated: paragraphs with a near-duplicate, firsts included; n_removed: those that aren't the first of their
    class by doc_id and line; copy_of: the doc_ids that hold the firsts of what is removed. Lines of under MIN_WORDS
    words aren't paragraphs. n_passages: runs of words cut from the rest since they repeat earlier windows of
    passages.WINDOW words, in any lines; passage_chars: what they take; cut_chars: removed_chars and passage_chars. Null and empty texts have zeros. Rows of the
    same doc_id and text are one document.
    """
    own = placed(keyed(docs.select("doc_id", "text")), KEYS, "paragraph-documents")
    found = materialize(repeats(own), "paragraph-repeats")
    rest = placed(_without_lines(own, found).select("dk", "th", "text"), KEYS, "paragraph-rest")
    cuts = passages.repeats(rest)
    cut = passages.without(rest, cuts).select("dk", "th", "n_passages", "passage_chars").join(cuts.select("dk", "th", "sources"), ["dk", "th"])
    copy = _is_copy()
    sums = found.groupBy("dk", "th").agg(
        F.count_distinct("idx").alias("n_paragraphs"),
        F.count_distinct(F.when(F.col("n") > 1, F.col("idx"))).alias("n_repeated"),
        F.sort_array(F.collect_set(F.when(copy, F.struct("idx", "chars")))).alias("gone"),
        F.collect_set(F.when(copy, F.col("first.dk"))).alias("copy_of"),
    )
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    return own.select("doc_id", "dk", "th").join(sums, ["dk", "th"], "left").join(cut, ["dk", "th"], "left").select(
        "doc_id",
        F.coalesce("n_paragraphs", zero).alias("n_paragraphs"),
        F.coalesce("n_repeated", zero).alias("n_repeated"),
        F.coalesce(F.size("gone").cast("long"), zero).alias("n_removed"),
        F.coalesce(F.aggregate("gone", zero, lambda a, x: a + x["chars"]), zero).alias("removed_chars"),
        F.sort_array(F.array_union(F.coalesce("copy_of", none), F.coalesce("sources", none))).alias("copy_of"),
        F.coalesce("n_passages", zero).alias("n_passages"),
        F.coalesce("passage_chars", zero).alias("passage_chars"),
        (F.coalesce(F.aggregate("gone", zero, lambda a, x: a + x["chars"]), zero) + F.coalesce("passage_chars", zero)).alias("cut_chars"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with repeated paragraphs cut from text, then repeated passages; a text that loses nothing stays as it is, byte for byte.

    Null and empty texts stay, and so do repeated rows: rows that share doc_id and text lose the same. The first of
    equal passages is that of the smallest doc_id (null before all), then the least text hash and place.
    """
    own = placed(keyed(packed(docs)), KEYS, "paragraph-documents")
    rest = placed(_without_lines(own, repeats(own.select("dk", "th", "text"))), KEYS, "paragraph-rest")
    cut = passages.without(rest, passages.repeats(rest)).select("dk", "th", F.col("text").alias("_cut"))
    return unpacked(rest.join(cut, ["dk", "th"], "left").withColumn("text", F.coalesce("_cut", "text")), docs.columns)
