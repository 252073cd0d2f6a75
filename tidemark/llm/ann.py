"""Operator 1: nearest neighbours over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors that the centroids are fitted on at most, those of the least hashes.
MAX_SAMPLE = 16_384
#: Rows to a posting list, about, as long as the sample tells so many lists apart.
ROWS = 128
#: A vector goes to the lists whose centroids are at most (1 + BOUNDARY) times as far as its nearest, REPLICAS at most.
BOUNDARY, REPLICAS = 0.03, 2
#: A query reads the lists whose centroids are at most (1 + PRUNE) times as far as its nearest.
PRUNE = 0.27
#: Rows of lists, and queries to them, that one task compares at once; more are dealt to several.
CHUNK, ASKED = 20_000, 4_096
DEGREE = 24


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of groups of equal size: the sample is halved at the median between two means, again and again."""
    rng, groups = np.random.default_rng(5), [np.arange(len(x))]
    while len(groups) < lists:
        groups.sort(key=len)
        own = groups.pop()
        if len(own) < 2:
            groups.append(own)
            break
        a, b = x[rng.choice(own, 2, replace=False)]
        for _ in range(4):
            side = x[own] @ (a - b)
            order = np.argsort(side, kind="stable")
            low, high = own[order[: len(own) // 2]], own[order[len(own) // 2 :]]
            a, b = unit(x[high].mean(0)), unit(x[low].mean(0))
        groups += [low, high]
    return unit(np.stack([x[g].mean(0) for g in groups]))


class CentroidGraph:
    """Centroids linked to their nearest and to a few random ones; a search walks from fixed entries, best first."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids, k = centroids, len(centroids)
        near = np.empty((k, min(DEGREE, k)), np.int64)
        for s in range(0, k, 512):
            near[s : s + 512] = np.argsort(-(centroids[s : s + 512] @ centroids.T), 1, kind="stable")[:, : near.shape[1]]
        self.links = np.concatenate((near, np.random.default_rng(6).integers(0, k, (k, 8))), 1)
        self.entries = np.arange(0, k, max(1, k // 16))[:16]

    def search(self, x: np.ndarray, width: int, ratio: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The `width` centroids found nearest to each unit vector: ids (-1: none) and squared distances, nearest first.

        The walk ends where no open centroid is within (1 + ratio) times the distance of the nearest found.
        """
        n, k = len(x), len(self.centroids)
        width = min(width, k)
        seen = np.zeros((n, k), bool)
        sims = np.full((n, width), -np.inf)
        ids = np.full((n, width), -1)
        open_ = np.zeros((n, width), bool)
        rows = np.arange(n)

        def add(rows: np.ndarray, found: np.ndarray) -> None:
            fresh = ~seen[rows[:, None], found]
            order = np.argsort(found, 1, kind="stable")  # the same centroid twice in a row counts once
            ranked = np.take_along_axis(found, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            fresh &= ~twice
            seen[rows[:, None], found] = True
            s = np.einsum("nd,nmd->nm", x[rows], self.centroids[found])
            s[~fresh] = -np.inf
            all_s = np.concatenate((sims[rows], s), 1)
            all_i = np.concatenate((ids[rows], found), 1)
            all_o = np.concatenate((open_[rows], fresh), 1)
            top = np.argsort(-all_s, 1, kind="stable")[:, :width]
            sims[rows], ids[rows], open_[rows] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_o))

        add(rows, np.broadcast_to(self.entries, (n, len(self.entries))))
        open_ &= np.isfinite(sims)
        while len(rows):
            best = np.where(open_[rows], sims[rows], -np.inf).argmax(1)
            go = open_[rows, best] & (np.isinf(ratio) | (1 - sims[rows, best] <= (1 + min(ratio, 1e6)) ** 2 * (1 - sims[rows, 0]) + 1e-12))
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            open_[rows, best] = False
            add(rows, self.links[ids[rows, best]])
            open_[rows] &= np.isfinite(sims[rows])
        ids[~np.isfinite(sims)] = -1
        return ids, np.maximum(2 - 2 * sims, 0)


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, v) without null, zero, and non-finite vectors, null ids, and vectors of another length than dim."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    ok = F.col("vec_id").isNotNull() & F.coalesce(~bad & some, F.lit(False))
    return vectors.where(ok if dim is None else ok & (F.size(v) == dim)).select("vec_id", v.alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), np.float64)
    return flat.reshape(len(col), -1)


def _lists(rows: DataFrame, centroids: np.ndarray, ratio: float, most: int, name: str, together: bool = False) -> DataFrame:
    """(list, id, v): each row once for each list whose centroid's distance is within the ratio of the nearest's; together: (lists, id, v)."""
    graph: list[CentroidGraph] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                if not graph:
                    graph.append(CentroidGraph(centroids))
                ids, dist = graph[0].search(unit(_matrix(part.column(1))), most, ratio)
                take = (ids >= 0) & (np.isinf(ratio) | (np.sqrt(dist) <= (1 + min(ratio, 1e6)) * np.sqrt(dist[:, :1]) + 1e-12))
                take[:, 0] = True
                row, col = np.nonzero(take)
                at = pa.array(row)
                if together:
                    ends = np.concatenate(([0], np.cumsum(take.sum(1)))).astype(np.int32)
                    found = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[row, col].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([found, part.column(0), part.column(1)], names=["lists", "id", "v"])
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), part.column(0).take(at), part.column(1).take(at)], names=["list", "id", "v"])

    return materialize(rows.mapInArrow(run, f"{'lists array<int>' if together else 'list int'}, id long, v array<double>"), name)


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k nearest ids of x to each query, without its own; ties to smaller ids, an id counts by its nearest row."""
    raw = np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel()
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, group))
    again = np.concatenate(([False], (ids[order][1:] == ids[order][:-1]) & (group[order][1:] == group[order][:-1])))
    order = order[~again]  # equal rows are one
    # Of equal vectors the k + 1 smallest ids are all that can be among a query's k nearest.
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    order = order[place <= k]
    order = order[np.argsort(ids[order], kind="stable")]
    ids, x = ids[order], x[order]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    ends, own = np.append(starts[1:], len(ids)), ids[starts]
    norm, out = np.sqrt((x * x).sum(1)), []
    for s in range(0, len(q), 256):
        part = q[s : s + 256]
        sims = part @ x.T / (np.sqrt((part * part).sum(1))[:, None] * norm)
        best = sims if len(starts) == len(ids) else np.maximum.reduceat(sims, starts, axis=1)
        best[q_ids[s : s + 256, None] == own] = -np.inf
        at = max(0, len(own) - k)
        cut = np.partition(best, at, 1)[:, at]
        for i in range(len(part)):
            some = np.flatnonzero((best[i] >= cut[i] - 1e-9) & np.isfinite(best[i]))
            rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[some], ends[some], strict=True)]) if len(some) else some
            # Scores row by row, in one order of sums: equal vectors score equally.
            exact = (x[rows] * part[i]).sum(1) / (np.sqrt((part[i] * part[i]).sum()) * norm[rows])
            top = np.lexsort((ids[rows], -exact))
            top = top[np.sort(np.unique(ids[rows][top], return_index=True)[1])][:k]
            out.append((np.full(len(top), q_ids[s + i]), ids[rows][top], exact[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _compared(asked: DataFrame, posted: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query in the lists it asks (id, v, lists).

    Lists are dealt to shards of about CHUNK rows; those longer than that are spread over all shards. A shard meets
    ASKED queries at a time, list by list, and hands on the k nearest of each.
    """
    # There are no more lists than the sample allows, so their sizes fit the driver.
    shards, chunks = max(1, -(-sum(sizes.values()) // CHUNK)), F.lit(max(1, -(-asked.count() // ASKED)))
    long_ = F.array(*[F.lit(i) for i, n in sizes.items() if n > CHUNK]).cast("array<int>")
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    left = asked.withColumn("shard", F.explode(F.when(F.arrays_overlap("lists", long_), every).otherwise(F.array_distinct(F.transform("lists", dealt)))))
    left = left.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), chunks).cast("int"))
    right = posted.withColumn("shard", F.when(F.array_contains(long_, F.col("list")), dealt(F.col("id"))).otherwise(dealt(F.col("list"))))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))

    def near(one: pa.Table, other: pa.Table) -> pa.Table:
        found = []
        if one.num_rows and other.num_rows:
            q_ids, q, lists = one.column("id").to_numpy(), _matrix(one.column("v").combine_chunks()), one.column("lists").combine_chunks()
            ids, x, own = other.column("id").to_numpy(), _matrix(other.column("v").combine_chunks()), other.column("list").to_numpy()
            who = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            wants = lists.flatten().to_numpy()
            by_list, by_row = np.argsort(wants, kind="stable"), np.argsort(own, kind="stable")
            for name in np.unique(own).tolist():
                mine = who[by_list[slice(*np.searchsorted(wants[by_list], [name, name + 1]))]]
                rows = by_row[slice(*np.searchsorted(own[by_row], [name, name + 1]))]
                if len(mine):
                    found.append(_nearest(q_ids[mine], q[mine], ids[rows], x[rows], k))
        query, vec, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        once = np.sort(np.unique(np.stack([query, vec]), axis=1, return_index=True)[1])  # a row may be in several lists
        query, vec, score = query[once], vec[once], score[once]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.table({"query_id": pa.array(query[keep], pa.int64()), "vec_id": pa.array(vec[keep], pa.int64()), "score": pa.array(score[keep], pa.float64())})

    key = ["shard", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(near, "query_id long, vec_id long, score double")
    return materialize(_top(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k), "ann-found")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 50, k: int = 5, prune: float = PRUNE) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows whose vec_id is divisible by `every`, the k found nearest by cosine.

    Centroids are fitted on a bounded sample; every usable row is in a list, boundary rows in several. Queries that find fewer than k in the
    lists within the ratio ask again with a larger one, at last all lists. Rows of one vec_id count by their nearest
    and are returned once, never as a result of their own id; each vector of a query's id asks, the nearest found
    counts. Vectors of another length than the sample's first take no part.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = usable(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).toPandas()
    if not len(sample):
        return empty
    dim = len(sample["v"].iloc[0])
    fitted = np.stack([v for v in sample["v"] if len(v) == dim])
    rows = usable(vectors, dim)
    n = rows.count()
    lists = int(max(1, min(round(n / ROWS), len(fitted) // 8)))
    centroids = balanced_centroids(unit(np.unique(fitted, axis=0)), lists)
    posted = _lists(rows, centroids, BOUNDARY, REPLICAS, "ann-lists")
    sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
    queries = rows.where(F.col("vec_id") % every == 0)
    found: DataFrame | None = None
    for ratio in (prune, 2 * prune, np.inf):
        asked = _lists(queries, centroids, ratio, len(centroids), "ann-queries", True)
        new = _compared(asked, posted, sizes, k)
        found = new if found is None else found.join(queries.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").union(new)
        full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        queries = materialize(queries.join(full, "vec_id", "left_anti"), "ann-short")
        if queries.isEmpty():
            break
    return found
