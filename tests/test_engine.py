"""Parts of the engine that no query with SQL reaches."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import joins, prepare
from tidemark.plans import ensemble as ens
from tidemark.plans import model as models
from tidemark.plans.query import Predicate, Range, parse, parse_what_if, ranges
from tidemark.schema import SchemaGraph, TableSpec, star_schema
from tidemark.sources import tables as files
from tidemark.streaming import incremental

SCHEMA = star_schema()


def leaf(spark, values):
    m = models.Model(models.number_nodes(models.Node("leaf", ("x",))), models.Columns(["x"], {}, {"x": 0.0}, {"x": 1.0}, {}))
    models.absorb(m, [], reset=True)
    return incremental.update(m, spark.createDataFrame([(float(v),) for v in values], "x double"))


@pytest.mark.parametrize("text", [
    "SELECT COUNT(*) FROM orders WHERE o_totalprice LIKE 'a%'",
    "SELECT COUNT(*) FROM orders WHERE o_totalprice > 1 OR o_totalprice < 0",
    "SELECT MEDIAN(o_totalprice) FROM orders",
    "SELECT COUNT(*) FROM orders, customer WHERE o_orderkey = c_custkey",
    "SELECT COUNT(*) FROM orders WHERE o_totalprice <> 1",
    "SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderpriority",
    "SELECT COUNT(*) FROM orders ORDER BY nothing",
    "SELECT SUM(o_totalprice + 1) FROM orders",
    "SELECT COUNT(*) FROM orders HAVING 1",
    "SELECT COUNT(*) + COUNT(*) FROM orders",
])
def test_refused(text):
    with pytest.raises(ValueError):
        parse(SCHEMA, text)


def test_ranges_of_texts():
    r = ranges([Predicate("t", "c", ">=", "b"), Predicate("t", "c", "<", "d"), Predicate("t", "c", "NOT IN", ("c",))])["t__c"]
    assert [v for v in "abcd" if r.allows(v)] == ["b"] and not r.empty and not r.allows(None)
    assert Range().also(Predicate("t", "c", ">", "z")).also(Predicate("t", "c", "<", "a")).empty


def test_samples_of_any_rate(spark):
    df = spark.range(100_000)
    assert 300 < joins.hash_sample(df, ["id"], 0.005).count() < 700 and joins.hash_sample(df, ["id"], 1e-12).count() == 0
    assert sorted(r[0] for r in joins.hash_sample(df.repartition(7), ["id"], 0.005).collect()) == sorted(r[0] for r in joins.hash_sample(df, ["id"], 0.005).collect())
    m = models.learn(df.select("id", (F.col("id") % 9).alias("x"), (F.col("id") % 9 * 2).alias("y")), ["x", "y"], ["id"], sample_rows=1)
    assert m.size == 100_000 and math.isclose(models.expectation(m.root, ranges([Predicate("t", "c", "=", 3)]) and {"x": Range(values=frozenset([3.0]))}), 1 / 9, rel_tol=1e-3)


def test_models_leave_out_what_is_not_relevant(spark):
    df = spark.range(12_000).select("id", F.col("id").cast("string").alias("free"), F.lit(None).cast("string").alias("none"), (F.col("id") % 3).cast("string").alias("few"), (F.col("id") * 1.5).alias("wide"))
    m = models.learn(df, ["free", "none", "few", "wide"], ["id"], sample_rows=500)
    assert m.scope() == {"few", "wide"} and "wide" in m.columns.step
    assert math.isclose(models.expectation(m.root, {"wide": Range(high=9_000.0)}), 0.5, abs_tol=0.01)


def test_batch_is_one_group_at_a_time(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a := rng.integers(0, 4)), str(int(a) // 2) if i % 10 else None, float(rng.normal() + a)) for i in range(3_000)]
    m = models.learn(spark.createDataFrame(rows, "id long, a double, s string, v double"), ["a", "s", "v"], ["id"], sample_rows=3_000)
    groups = models.distinct(m.root, ["a", "s"], {})
    codes = {c: (np.arange(len(groups)), [(g[i],) for g in groups]) for i, c in enumerate(c for c in m.root.scope if c in ("a", "s"))}
    where = {"v": Range(low=0.5)}
    got = models.batch_expectation(m.root, where, {"v": 1.0}, codes)
    for k, _ in enumerate(groups):
        own = {c: Range(null_only=True) if sets[k][0] is None else Range(values=frozenset(sets[k])) for c, (_, sets) in codes.items()}
        assert math.isclose(got[k], models.expectation(m.root, {**where, **own}, {"v": 1.0}), rel_tol=1e-9, abs_tol=1e-12)


def test_trees(spark):
    one, two = models.Node("leaf", ("a",)), models.Node("leaf", ("b",))
    assert models.prune(models.Node("product", ("a", "b"), [models.Node("product", ("a",), [one]), two])).children == [one, two]
    with pytest.raises(ValueError):
        models.check(models.Node("product", ("a", "b"), [one]))
    with pytest.raises(ValueError):
        models.check(models.Node("sum", ("a",), [one], []))
    m = leaf(spark, [1, 1, 2, 4])
    assert models.expectation(m.root, {"x": Range(high=2.0)}, None, {"leaf": lambda n, w, p, of: 0.25}) == 0.25
    assert models.cumulative(m.root) == [(1.0, 0.5), (2.0, 0.75), (4.0, 1.0)]
    far = np.concatenate((np.random.default_rng(2).normal(size=(200, 2)), np.random.default_rng(3).normal(size=(200, 2)) + 8))
    which, _ = models.two_gaussians(far)
    assert len({*which[:200]}) == len({*which[200:]}) == 1 and which[0] != which[-1]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, store = str(tmp_path / "in"), "file://" + str(tmp_path / "store")
    rows = lambda *v: spark.createDataFrame([(float(x),) for x in v], "x double").coalesce(1).write.mode("append").parquet(source)
    rows(1, 2)
    stream = lambda: spark.readStream.schema("x double").parquet(source)
    incremental.follow(leaf(spark, []), stream(), str(tmp_path / "a"), store).awaitTermination()
    rows(2, 3)
    again, last = incremental.stored(spark, store)
    assert last == 0 and again.size == 2
    # A new checkpoint sends batch 0 again, as a driver that died before the commit would: it is left out.
    incremental.follow(again, stream(), str(tmp_path / "b"), store).awaitTermination()
    assert incremental.stored(spark, store)[0].size == 2
    incremental.follow(again, stream(), str(tmp_path / "a"), store).awaitTermination()
    found, last = incremental.stored(spark, store)
    assert last == 1 and dict(zip(found.root.values.tolist(), found.root.counts.tolist(), strict=True)) == {1.0: 1.0, 2.0: 2.0, 3.0: 1.0}


def test_files(spark, tmp_path):
    base = "file://" + str(tmp_path)
    files.write_scores(spark, {("a", "b"): 0.5}, base + "/scores")
    assert files.read_scores(spark, base + "/scores") == {("a", "b"): 0.5, ("b", "a"): 0.5}
    (tmp_path / "q.sql").write_text("SELECT 1;\n\nSELECT 2\n")
    assert files.read_queries(str(tmp_path / "q.sql")) == ["SELECT 1", "SELECT 2"]
    files.write_csv(spark.range(3), base + "/csv")
    assert spark.read.option("header", True).csv(base + "/csv").count() == 3


def test_schema_helpers():
    edges = SCHEMA.find("lineitem", False)
    assert joins.start_table(SCHEMA, {"lineitem", "orders", "part", "supplier"}, edges) in {"orders", "part", "supplier"}
    sampled = SchemaGraph({**SCHEMA.tables, "lineitem": replace(SCHEMA.tables["lineitem"], sample_rate=0.1)}, SCHEMA.edges)
    assert joins.start_table(sampled, {"lineitem", "orders"}, edges[:1]) == "lineitem"
    assert joins.key_tables(edges) == {("lineitem", t) for t in ("orders", "part", "supplier")}
    for seed in range(5):
        tree = joins.random_tree(SCHEMA, 4, seed)
        assert not tree or len(SCHEMA.tree(tree)) == len(tree) <= 3  # none from a table without edges


def test_dependencies(spark):
    g = SchemaGraph({"t": TableSpec("t", ("k",), ("k", "city", "state", "land"), dependencies=(("city", "state"), ("state", "land")))})
    rows = [(i, f"c{i % 6}", f"s{i % 6 // 2}", f"l{i % 6 // 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, city string, state string, land string")
    assert prepare.holds(df, "city", "state") and not prepare.holds(df, "state", "city")
    e = ens.single_tables(g, {"t": df}, ["t"])
    assert e.models[0].scope() - {"t__nn"} == {"t__city"}
    for text, want in (("SELECT land, COUNT(*) FROM t GROUP BY land", {("l0",): 400, ("l1",): 200}), ("SELECT state, city, COUNT(*) FROM t WHERE land = 'l1' GROUP BY state, city", {("s2", "c4"): 100, ("s2", "c5"): 100})):
        assert {tuple(r)[:-3]: round(r["value"]) for r in e.answer(parse(g, text), spark).collect()} == want


def test_searched_ensemble(spark):
    t = {k: df.limit(500) if k in ("orders", "customer") else df for k, df in catalog._tables(spark, "/root/testdata/sf0.001").items()}
    e = ens.searched(SCHEMA, t, ["customer", "orders"], 4.0, rows=300, tries=20, sample_rows=300)
    assert len(e.models) > 2 and e.scores and e.models[-1].edges
    assert e.cardinality(parse(SCHEMA, "SELECT COUNT(*) FROM customer, orders WHERE o_custkey = c_custkey")) > 0
    assert e.what_if(parse_what_if(SCHEMA, "WHAT IF orders.o_orderstatus = 'F' INCREASE BY 10%")).dictionaries == e.dictionaries
