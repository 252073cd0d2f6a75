"""Operator 10: SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, components, materialize, packed, pieces, unpacked

#: A-Z to a-z, and every white-space byte to a space.
_FOLD = bytes.maketrans(UPPER.encode() + b"\t\n\x0b\x0c\r", LOWER.encode() + b"     ")
_WORD = re.compile(rb"[^ ]+")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of text, unsigned; 0 without words."""
    words = (text or "").encode().translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 255):  # sums of 255 bits fit a byte
        ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.fromiter((fingerprint(t, size) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) at most 2 bits apart.

    Every fingerprint emits itself and its 64 one-bit variants. Two that share a variant are at most 2 bits apart,
    and any two at most 2 bits apart share one; so all that meet at a variant (65 at most) link to the least of them.
    """
    fp = F.col("fp")
    ball = F.array(fp, *(fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    met = prints.select("fp", F.explode(ball).alias("v"))
    low = met.withColumn("low", F.min("fp").over(Window.partitionBy("v"))).where("fp <> low")
    links = low.select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay, with one component;
    a null doc_id keeps its row and is never the smallest. Exact copies meet in one fingerprint first (a partial
    minimum), so groups of copies of any size cost one row in the links.
    """
    prints = materialize(fingerprints(docs, size), "simhash-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(ball_links(classes.select("fp"))).toDF("fp", "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(low, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of docs, one of each component: that of the smallest doc_id (of rows that share it, the one with the least text hash)."""
    keep = near_duplicates(docs, size).where("doc_id = component_id").select("doc_id").distinct()
    kept = packed(docs).join(keep, "doc_id", "left_semi")
    again = kept.groupBy("doc_id").count().where("count > 1").select("doc_id")
    # Only ids that occur more than once are numbered, so the texts of the rest are not sorted.
    once = kept.join(again, "doc_id", "left_anti")
    twice = kept.join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_n = 1").drop("_n")
    return unpacked(once.unionByName(twice), docs.columns)
