"""What the corpus operators share: tables in the cluster's shared folder, components, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, in every operator: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of text that a Python worker holds as one piece of work.
PIECE_BYTES = 8 << 20
#: Edges, each both ways, whose components one task finds.
FEW = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a fresh temporary one on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(*written: DataFrame) -> None:
    """Deletes what materialize() wrote, once all that was made of it is written itself."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def placed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """As materialize(), in buckets of the keys: joins on them deal out the other side alone."""
    spark = df.sparkSession
    n, short = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tidemark_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{short}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(short)
    out = spark.table(short)
    spark.sql(f"DROP TABLE {short}")  # the files stay: they were given a path of their own
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the other columns in one, so that their names clash with nothing."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in columns])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text, so that memory doesn't follow the rows of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all edges (a, b) of a graph, each both ways: (a, m), every node with the least of its component."""
    root: dict = {}

    def top(c):
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            root.setdefault(a, a)
            root[max(a, b)] = min(a, b)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(c) for c in nodes], kind)], names=["a", "m"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): (node, component), component the smallest node.

    Each round maps every node to the least of its neighbourhood and contracts the graph; every other round
    ranks nodes by a fresh hash, so that chains shrink geometrically too. Rounds are joins and partial minima
    on written tables; only the number of edges left reaches the driver. What has come down to FEW edges, if its nodes
    are numbers, is joined in one task: rounds of many small tasks cost the driver more than the edges do.
    """
    both = edges.where("a <> b").select("a", "b")
    graph = materialize(both.union(both.select("b", "a")).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    number = graph.schema["a"].dataType.simpleString() in ("bigint", "int") and graph.schema["a"].dataType == graph.schema["b"].dataType
    while True:
        if number and graph.count() <= FEW:
            kind = graph.schema["a"].dataType.simpleString()
            maps.append(materialize(graph.select("a", "b").coalesce(1).mapInArrow(_least, f"a {kind}, m {kind}"), "cc-map"))
            break
        rank = (lambda c: c) if len(maps) % 2 == 0 else (lambda c, k=len(maps): F.xxhash64(c, F.lit(k)))
        pair = lambda c: F.struct(rank(c).alias("r"), c.alias("n"))
        least = graph.groupBy("a").agg(F.min(pair(F.col("b"))).alias("m")).select("a", F.least("m", pair(F.col("a")))["n"].alias("m"))
        least = materialize(least, "cc-map")
        maps.append(least)
        left, right = least.toDF("a", "ma"), least.toDF("b", "mb")
        rest = graph.join(left, "a").join(right, "b").where("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct()
        graph = materialize(rest, "cc-edges")
        if graph.isEmpty():
            break
    label = maps.pop()
    while maps:
        up = label.toDF("m", "root")
        label = maps.pop().join(up, "m", "left").select("a", F.coalesce("root", "m").alias("m"))
    low = label.groupBy("m").agg(F.min("a").alias("component"))
    return label.join(low, "m").select(F.col("a").alias("node"), "component")
