"""Near-duplicate documents of the pipeline: SimHash and MinHash candidates, exact Jaccard of 5-word shingles, components.

64-bit SimHashes of documents of similarity 0.8 differ by about 10 bits, of 64, which no ball reaches. So documents
that share a MinHash band are candidates too, and both are verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import components, materialize, packed, release, unpacked
from .line_rules import blank
from .paragraph_dedup import SHINGLE, bucketed, by_band, in_buckets, links, shingle_sets


def _near_prints(units: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (lh, line) whose fingerprints link."""
    prints = materialize(simhash.fingerprints(units.toDF("doc_id", "text"), SHINGLE).toDF("lh", "fp"), "near-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("lh").alias("low")), "near-print-classes")
    same = prints.join(classes, "fp").where("lh <> low").select(F.col("low").alias("a"), F.col("lh").alias("b"))
    balls = simhash.ball_links(classes.select("fp")).toDF("fa", "fb")
    return same.union(balls.join(classes.toDF("fa", "a"), "fa").join(classes.toDF("fb", "b"), "fb").select("a", "b")).distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.

    That of the smallest doc_id stays, null last; of rows that share it, the one with the least text hash. Texts without
    words count as one. The doc_id alone decides nothing: rows of one id with different texts stay in their components.
    """
    keyed = packed(docs).withColumn("_th", F.when(blank(F.coalesce("text", F.lit(""))), F.lit(0).cast("long")).otherwise(F.xxhash64("text")))
    keys = materialize(keyed.select("doc_id", "_th"), "near-keys")
    place = materialize(keys.where("_th <> 0").groupBy("_th").agg(F.min("doc_id").alias("_id")), "near-places")

    def texts_of(asked: DataFrame) -> DataFrame:
        one = place.join(asked, place["_th"] == asked["lh"]).select("_th", "_id")
        found = keyed.alias("k").join(one.alias("o"), (F.col("k._th") == F.col("o._th")) & F.col("k.doc_id").eqNullSafe(F.col("o._id")))
        return found.select(F.col("k._th").alias("lh"), F.col("k.text").alias("line")).dropDuplicates(["lh"])

    units = keyed.where("_th <> 0").select(F.col("_th").alias("lh"), F.col("text").alias("line"))
    buckets = materialize(bucketed(units), "near-buckets")
    members = materialize(in_buckets(by_band(buckets)), "near-members")
    release(buckets)
    found = links(members, lambda asked: shingle_sets(texts_of(asked)), _near_prints(units))
    classes = components(found).toDF("_th", "class")
    classed = keys.join(classes, "_th", "left").withColumn("class", F.coalesce("class", "_th"))
    first = classed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("f"))
    keep = materialize(first.select(F.col("f.doc_id").alias("_id"), F.col("f._th").alias("_h")), "near-keep")
    kept = keyed.join(keep, (F.col("_th") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_h")
    # Only what occurs more than once is numbered, so the texts of the rest are not sorted.
    again = materialize(keys.groupBy("doc_id", "_th").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h")), "near-again")
    is_again = (F.col("_th") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    once = kept.join(again, is_again, "left_anti")
    twice = kept.join(again, is_again, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy(F.xxhash64("text")))).where("_n = 1").drop("_n")
    return unpacked(once.unionByName(twice), docs.columns)
