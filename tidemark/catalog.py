"""The library's queries by name, with the same results in DuckDB's SQL where it can express them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import evaluation, metrics
from .operators import exact, joins, prepare
from .plans import ensemble as ens
from .plans import model as models
from .plans.query import Predicate, QuerySpec, parse, parse_what_if, ranges
from .schema import FkEdge, SchemaGraph, TableSpec, star_schema
from .sources import tables as files
from .sources.tables import read_parquet
from .streaming.incremental import update

SCHEMA = star_schema()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read_parquet(spark, sf_dir, s) for t, s in SCHEMA.tables.items()}


def _edge(child: str, parent: str) -> FkEdge:
    return next(e for e in SCHEMA.edges if e.child == child and e.parent == parent)


# --- exact queries: one SQL text through the library's reader ---------------------------------------------------------


def _exact(name: str, text: str, oracle: str, out: str = "value", digits: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = exact.run(SCHEMA, _tables(spark, sf_dir), parse(SCHEMA, text), out)
        return df if digits is None else df.withColumn(out, F.round(F.col(out).cast("double"), digits))

    run.__name__ = name
    query(oracle)(run)


_exact("count_join_filter", "SELECT COUNT(*) FROM customer, orders, lineitem WHERE o_custkey = c_custkey AND l_orderkey = o_orderkey AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND l_quantity < 25 AND o_totalprice >= 1000",
       "SELECT count(*) AS value FROM customer, orders, lineitem WHERE o_custkey = c_custkey AND l_orderkey = o_orderkey AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND l_quantity < 25 AND o_totalprice >= 1000")
_exact("sum_product_join", "SELECT SUM(l_extendedprice * l_discount) FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_quantity < 25 AND l_discount >= 0.01 AND l_discount <= 0.06",
       "SELECT round(sum(l_extendedprice * l_discount), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 25 AND l_discount >= 0.01 AND l_discount <= 0.06", digits=2)
_exact("avg_filter", "SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal < 0", "SELECT round(avg(c_acctbal), 6) AS value FROM customer WHERE c_acctbal < 0", digits=6)
_exact("group_count", "SELECT l_returnflag, COUNT(*) FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS value FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_returnflag")
_exact("group_sum_diff", "SELECT o_orderpriority, SUM(l_extendedprice) - SUM(l_quantity) FROM lineitem, orders WHERE l_orderkey = o_orderkey GROUP BY o_orderpriority",
       "SELECT o_orderpriority, round(sum(l_extendedprice) - sum(l_quantity), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority", digits=2)
_exact("group_multi_join", "SELECT p_brand, o_orderpriority, SUM(l_extendedprice) FROM lineitem, part, supplier, orders WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND l_orderkey = o_orderkey AND p_size < 20 AND s_acctbal > 0 GROUP BY p_brand, o_orderpriority",
       "SELECT p_brand, o_orderpriority, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size < 20 AND s_acctbal > 0 GROUP BY p_brand, o_orderpriority", digits=2)
_exact("group_three_roles", "SELECT nation_c.n_name, o_orderpriority, COUNT(*) FROM lineitem, orders, customer, nation_c, region_c, supplier, nation_s WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = nation_c.n_nationkey AND nation_c.n_regionkey = region_c.r_regionkey AND l_suppkey = s_suppkey AND s_nationkey = nation_s.n_nationkey AND r_name IN ('ASIA', 'EUROPE') GROUP BY nation_c.n_name, o_orderpriority",
       "SELECT nc.n_name, o_orderpriority, count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region ON nc.n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY nc.n_name, o_orderpriority")
_exact("range_intersection", "SELECT COUNT(*) FROM lineitem WHERE l_quantity <= 5 AND l_quantity < 5 AND l_quantity > 1 AND l_returnflag IN ('A', 'R') AND l_returnflag IN ('R', 'N')",
       "SELECT count(*) AS value FROM lineitem WHERE l_quantity < 5 AND l_quantity > 1 AND l_returnflag = 'R'")
_exact("empty_range", "SELECT COUNT(*) FROM lineitem WHERE l_quantity > 30 AND l_quantity < 20", "SELECT count(*) AS value FROM lineitem WHERE l_quantity > 30 AND l_quantity < 20")
_exact("in_not_in", "SELECT l_returnflag, COUNT(*) FROM lineitem WHERE l_linestatus NOT IN ('F', 'X') AND l_returnflag IN ('A', 'N') GROUP BY l_returnflag",
       "SELECT l_returnflag, count(*) AS value FROM lineitem WHERE l_linestatus NOT IN ('F', 'X') AND l_returnflag IN ('A', 'N') GROUP BY l_returnflag")
_exact("order_limit", "SELECT p_brand, COUNT(*) FROM part GROUP BY p_brand ORDER BY value DESC, p_brand LIMIT 7", "SELECT p_brand, count(*) AS value FROM part GROUP BY p_brand ORDER BY value DESC, p_brand LIMIT 7")
_exact("rare_tail", "SELECT o_orderpriority, COUNT(*) FROM orders WHERE o_totalprice > 490000 GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS value FROM orders WHERE o_totalprice > 490000 GROUP BY o_orderpriority")
_exact("avg_by_group", "SELECT c_mktsegment, AVG(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20 GROUP BY c_mktsegment",
       "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS value FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20 GROUP BY c_mktsegment", digits=6)
_exact("events_avg", "SELECT event_type, AVG(value) FROM events WHERE user_id < 100 GROUP BY event_type", "SELECT event_type, round(avg(value), 6) AS value FROM events WHERE user_id < 100 GROUP BY event_type", digits=6)
_exact("documents_labels", "SELECT lang, COUNT(*) FROM documents, labels WHERE labels.doc_id = documents.doc_id AND toxic = 0 GROUP BY lang",
       "SELECT lang, count(*) AS value FROM documents JOIN labels ON labels.doc_id = documents.doc_id WHERE toxic = 0 GROUP BY lang")


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd, count(*) AS n FROM lineitem WHERE l_quantity < 30 GROUP BY l_returnflag")
def truth_with_stddev(spark, sf_dir):
    spec = parse(SCHEMA, "SELECT l_returnflag, SUM(l_extendedprice) FROM lineitem WHERE l_quantity < 30 GROUP BY l_returnflag")
    df = exact.with_spread(SCHEMA, _tables(spark, sf_dir), spec)
    return df.select("l_returnflag", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


# --- preparation ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, count(l_orderkey)::DOUBLE AS mul, greatest(count(l_orderkey), 1)::DOUBLE AS mul_nn FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def multiplier_orders(spark, sf_dir):
    t, e = _tables(spark, sf_dir), _edge("lineitem", "orders")
    return prepare.multipliers(t["orders"], [(e, t["lineitem"], 1.0)]).select("o_orderkey", F.col(e.multiplier).alias("mul"), F.greatest(e.multiplier, F.lit(1.0)).alias("mul_nn"))


@query("WITH m AS (SELECT o_orderkey, greatest(count(l_orderkey), 1) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT 'lineitem.l_orderkey = orders.o_orderkey' AS edge, round(avg(m), 9) AS mean_mul_nn FROM m")
def multiplier_mean(spark, sf_dir):
    t, e = _tables(spark, sf_dir), _edge("lineitem", "orders")
    return prepare.mean_multiplier(prepare.multipliers(t["orders"], [(e, t["lineitem"], 1.0)]), e).withColumn("mean_mul_nn", F.round("mean_mul_nn", 9))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def null_partner(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return prepare.null_partners(t["orders"], t["lineitem"], _edge("lineitem", "orders")).select("o_orderkey", "o_custkey")


@query("SELECT 'lineitem.l_orderkey = orders.o_orderkey' AS edge, count(*) FILTER (WHERE l_orderkey IS NULL)::DOUBLE AS n_null FROM lineitem UNION ALL SELECT 'lineitem.l_partkey = part.p_partkey', count(*) FILTER (WHERE l_partkey IS NULL)::DOUBLE FROM lineitem UNION ALL SELECT 'lineitem.l_suppkey = supplier.s_suppkey', count(*) FILTER (WHERE l_suppkey IS NULL)::DOUBLE FROM lineitem")
def null_fk_count(spark, sf_dir):
    return prepare.null_keys(_tables(spark, sf_dir)["lineitem"], SCHEMA.find("lineitem", False))


@query("SELECT p_brand AS value, dense_rank() OVER (ORDER BY p_brand) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def dictionary_encoding(spark, sf_dir):
    return prepare.codes(_tables(spark, sf_dir)["part"], "p_brand")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) AS p_type_code FROM part")
def dictionary_applied(spark, sf_dir):
    part = _tables(spark, sf_dir)["part"]
    return prepare.encode(part, "p_type", prepare.codes(part, "p_type")).select("p_partkey", "p_type_code")


def _nations(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return t["nation_c"].join(t["region_c"], F.col("n_regionkey") == F.col("r_regionkey"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS sources FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def fd_dictionary(spark, sf_dir):
    return prepare.dependency(_nations(spark, sf_dir), "n_name", "r_name").select("r_name", F.array_join("sources", ",").alias("sources"))


#: Customers with their nation and region in one table: the nation's name determines the region's.
FD_SCHEMA = SchemaGraph()
FD_SCHEMA.add_table(TableSpec("customers", ("c_custkey",), ("c_custkey", "c_acctbal", "c_mktsegment", "n_name", "r_name"), dependencies=(("n_name", "r_name"),)))


def _with_dependency(spark, sf_dir) -> ens.Ensemble:
    nations = _nations(spark, sf_dir).select("n_nationkey", "n_name", "r_name")
    customers = {"customers": _tables(spark, sf_dir)["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(*FD_SCHEMA.tables["customers"].columns)}
    return ens.single_tables(FD_SCHEMA, customers, ["customers"], sample_rows=10_000)


@query("SELECT count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name > 'ASIA'")
def fd_predicate(spark, sf_dir):
    # The model holds the determining column alone; the predicate on the determined one is translated.
    e = _with_dependency(spark, sf_dir)
    return spark.createDataFrame([(round(e.cardinality(parse(FD_SCHEMA, "SELECT COUNT(*) FROM customers WHERE r_name > 'ASIA'"))),)], "value long")


@query("SELECT r_name, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def fd_group_merge(spark, sf_dir):
    # Groups of the determined column gather those of the determining one.
    got = _with_dependency(spark, sf_dir).answer(parse(FD_SCHEMA, "SELECT r_name, COUNT(*) FROM customers GROUP BY r_name"), spark)
    return got.select("r_name", F.round("value").cast("long").alias("value"))


@query("SELECT 'o_orderstatus' AS column_name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus IS NULL) AS n_null, count(DISTINCT o_orderstatus) AS n_distinct FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) FILTER (WHERE o_custkey IS NULL), count(DISTINCT o_custkey) FROM orders")
def column_profile(spark, sf_dir):
    return prepare.exact_profile(_tables(spark, sf_dir)["orders"], ["o_orderstatus", "o_custkey"])


@query("SELECT name AS column_name, n, n_null, FALSE AS all_null, TRUE AS near FROM (SELECT 'l_quantity' AS name, count(*) AS n, count(*) FILTER (WHERE l_quantity IS NULL) AS n_null FROM lineitem UNION ALL SELECT 'l_partkey', count(*), count(*) FILTER (WHERE l_partkey IS NULL) FROM lineitem UNION ALL SELECT 'l_returnflag', count(*), count(*) FILTER (WHERE l_returnflag IS NULL) FROM lineitem)")
def column_profile_approximate(spark, sf_dir):
    """Approximate distinct counts within a twentieth of the exact ones."""
    li = _tables(spark, sf_dir)["lineitem"].select("l_quantity", "l_partkey", "l_returnflag")
    sure = prepare.exact_profile(li, li.columns).select("column_name", F.col("n_distinct").alias("sure"))
    found = prepare.profile(li).withColumnRenamed("column", "column_name").join(sure, "column_name")
    return found.select("column_name", "n", "n_null", "all_null", (F.abs(F.col("n_distinct") - F.col("sure")) <= 0.05 * F.col("sure")).alias("near"))


@query("SELECT * FROM (VALUES ('code'), ('number'), ('few')) t(column_name)")
def relevant_columns(spark, sf_dir):
    """Neither a column without values, nor strings of over 10,000 values, nor what is dropped by name."""
    wide = spark.range(20_000).select((F.col("id") % 7).alias("code"), F.col("id").alias("number"), (F.col("id") % 5).cast("string").alias("few"), F.col("id").cast("string").alias("many"), F.lit(None).cast("string").alias("none"), F.lit("x").alias("comment"))
    return spark.createDataFrame([(c,) for c in prepare.relevant(wide, dropped=("comment",))], "column_name string")


# --- joins and samples -------------------------------------------------------------------------------------------------


def _foj(spark, sf_dir):
    return joins.full_outer(SCHEMA, _tables(spark, sf_dir), [_edge("lineitem", "orders")], [])


_FOJ = "f AS (SELECT orders.*, lineitem.*, (o_orderkey IS NOT NULL)::INT AS o_nn, (l_orderkey IS NOT NULL)::INT AS l_nn, greatest(coalesce(m, 1), 1)::DOUBLE AS mul_nn FROM orders FULL JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey AS k, count(*) AS m FROM lineitem GROUP BY 1) ON k = o_orderkey)"


@query(f"WITH {_FOJ} SELECT count(*) AS n, sum(o_nn)::BIGINT AS with_orders, sum(l_nn)::BIGINT AS with_lineitem, sum(o_nn * l_nn)::BIGINT AS with_both FROM f")
def full_outer_profile(spark, sf_dir):
    o, li = F.col("orders__nn"), F.col("lineitem__nn")
    return _foj(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(o).alias("with_orders"), F.sum(li).alias("with_lineitem"), F.sum(o * li).alias("with_both"))


@query("SELECT round((SELECT count(*) FROM customer) * (SELECT avg(m) FROM (SELECT greatest(count(o_orderkey), 1) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)) * (SELECT avg(m) FROM (SELECT greatest(count(l_orderkey), 1) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)), 4) AS size")
def join_size_estimate(spark, sf_dir):
    t = _tables(spark, sf_dir)
    edges = [_edge("orders", "customer"), _edge("lineitem", "orders")]
    means = {e.id: prepare.mean_multiplier(prepare.multipliers(t[e.parent], [(e, t[e.child], 1.0)]), e).first()["mean_mul_nn"] for e in edges}
    size = joins.size_estimate(SCHEMA, {"customer": float(t["customer"].count())}, means, edges, "customer")
    return spark.createDataFrame([(round(size, 4),)], "size double")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 5 = 0)")
def semi_join_sample(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return joins.consistent_sample(t["orders"].where("o_orderkey % 3 = 0"), t["lineitem"].where("l_partkey % 5 = 0"), ("o_orderkey", "l_orderkey")).select("o_orderkey")


@query(f"WITH {_FOJ} SELECT round(sum(CASE WHEN o_nn = 1 AND o_totalprice > 250000 THEN 1 / mul_nn ELSE 0 END), 4) AS value FROM f")
def foj_indicator_cardinality(spark, sf_dir):
    # Orders, counted in the outer join with their fan-out taken out.
    hit = (F.col("orders__nn") == 1) & (F.col("orders__o_totalprice") > 250000)
    return _foj(spark, sf_dir).agg(F.round(F.sum(F.when(hit, 1 / F.col(_edge("lineitem", "orders").multiplier)).otherwise(F.lit(0.0))), 4).alias("value"))


@query(f"WITH {_FOJ} SELECT count(*) AS value FROM f WHERE o_nn = 1 AND l_nn = 1 AND o_totalprice > 250000 AND l_quantity < 10")
def foj_join_cardinality(spark, sf_dir):
    f = _foj(spark, sf_dir)
    return f.where("orders__nn = 1 AND lineitem__nn = 1 AND orders__o_totalprice > 250000 AND lineitem__l_quantity < 10").agg(F.count("*").alias("value"))


@query("SELECT sum(m)::DOUBLE AS value FROM (SELECT count(l_orderkey) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 250000 GROUP BY o_orderkey)")
def foj_multiplier_cardinality(spark, sf_dir):
    # The join's size from the parent alone.
    t, e = _tables(spark, sf_dir), _edge("lineitem", "orders")
    return prepare.multipliers(t["orders"].where("o_totalprice > 250000"), [(e, t["lineitem"], 1.0)]).agg(F.sum(e.multiplier).alias("value"))


@query(f"WITH {_FOJ} SELECT round(sum(o_totalprice / mul_nn) / sum(1 / mul_nn), 4) AS value FROM f WHERE o_nn = 1 AND o_orderstatus = 'F'")
def foj_normalised_avg(spark, sf_dir):
    m = F.col(_edge("lineitem", "orders").multiplier)
    return _foj(spark, sf_dir).where("orders__nn = 1 AND orders__o_orderstatus = 'F'").agg(F.round(F.sum(F.col("orders__o_totalprice") / m) / F.sum(1 / m), 4).alias("value"))


@query("SELECT l_returnflag, count(*) * 4.0::DOUBLE AS value FROM lineitem WHERE l_orderkey % 4 = 1 GROUP BY l_returnflag")
def weighted_sample_scaleup(spark, sf_dir):
    sampled = SchemaGraph(dict(SCHEMA.tables), SCHEMA.edges)
    sampled.tables["lineitem"] = replace(SCHEMA.tables["lineitem"], sample_rate=0.25)
    tables = {"lineitem": _tables(spark, sf_dir)["lineitem"].where("l_orderkey % 4 = 1")}
    return exact.run(sampled, tables, parse(sampled, "SELECT l_returnflag, COUNT(*) FROM lineitem GROUP BY l_returnflag"))


@query("SELECT sum(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END)::BIGINT AS early, sum(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0 ELSE 1 END)::BIGINT AS late FROM orders")
def split_condition(spark, sf_dir):
    early, late = joins.split_by_condition(_tables(spark, sf_dir)["orders"], "o_orderdate < TIMESTAMP '1996-01-01'")
    return early.agg(F.count("*").alias("early")).crossJoin(late.agg(F.count("*").alias("late")))


# --- leaves and fixed trees --------------------------------------------------------------------------------------------


@query("SELECT l_discount AS value, count(*) AS n FROM lineitem GROUP BY 1")
def leaf_histogram(spark, sf_dir):
    n = _single(spark, sf_dir, "lineitem", ["l_discount"]).root
    return spark.createDataFrame([(v, int(c)) for v, c in zip(n.values.tolist(), n.counts.tolist(), strict=True)], "value double, n long")


@query("WITH h AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, round(sum(n) OVER (ORDER BY value) / sum(n) OVER (), 9)::DOUBLE AS cdf FROM h")
def leaf_cdf(spark, sf_dir):
    return spark.createDataFrame([(v, round(p, 9)) for v, p in models.cumulative(_single(spark, sf_dir, "lineitem", ["l_quantity"]).root)], "value double, cdf double")


@query("SELECT round(avg(l_quantity), 9) AS mean, round(avg(l_quantity * l_quantity), 6) AS mean_square, round(avg(CASE WHEN l_quantity <> 0 THEN 1.0::DOUBLE / l_quantity END), 9) AS mean_inverse, round(avg(CASE WHEN l_quantity <> 0 THEN 1.0::DOUBLE / (l_quantity * l_quantity) END), 9) AS mean_inverse_square FROM lineitem")
def leaf_moments(spark, sf_dir):
    m = models.leaf_moments(_single(spark, sf_dir, "lineitem", ["l_quantity"]).root)
    return spark.createDataFrame([tuple(round(m[k], 6 if k == "mean_square" else 9) for k in ("mean", "mean_square", "mean_inverse", "mean_inverse_square"))], "mean double, mean_square double, mean_inverse double, mean_inverse_square double")


@query("SELECT floor(o_totalprice / 1000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def leaf_binned(spark, sf_dir):
    n = _single(spark, sf_dir, "orders", ["o_totalprice"], {"orders__o_totalprice": 1000.0}).root
    return spark.createDataFrame([(int(v // 1000), int(c)) for v, c in zip(n.values.tolist(), n.counts.tolist(), strict=True)], "bin long, n long")


def _single(spark, sf_dir, table: str, columns: list[str], step: dict[str, float] | None = None) -> models.Model:
    """A model of one leaf a column, all independent: exact for single columns."""
    df = _tables(spark, sf_dir)[table].select(*[F.col(c).alias(f"{table}__{c}") for c in columns])
    names, kinds = df.columns, {f.name: f.dataType.simpleString() for f in df.schema}
    leaves = [models.Node("leaf", (c,)) for c in names]
    root = leaves[0] if len(leaves) == 1 else models.Node("product", tuple(names), leaves)
    strings = {c: {} for c in names if kinds[c] == "string"}
    still = dict.fromkeys(names, 0.0)
    m = models.Model(models.number_nodes(root), models.Columns(names, strings, still, dict.fromkeys(names, 1.0), step or {}, kinds), frozenset([table]))
    return models.absorb(m, models.collected(models.leaf_counts(models.flattened(df), m)), reset=True)


@query("SELECT round(avg(CASE WHEN l_quantity >= 10 AND l_quantity < 20 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS p FROM lineitem")
def leaf_interval_prob(spark, sf_dir):
    m = _single(spark, sf_dir, "lineitem", ["l_quantity"])
    where = ranges([Predicate("lineitem", "l_quantity", ">=", 10), Predicate("lineitem", "l_quantity", "<", 20)])
    return spark.createDataFrame([(round(models.expectation(m.root, where), 9),)], "p double")


@query("SELECT round(avg(CASE WHEN l_quantity >= 10 AND l_quantity < 20 THEN l_quantity ELSE 0.0 END)::DOUBLE, 6) AS e FROM lineitem")
def leaf_interval_expectation(spark, sf_dir):
    m = _single(spark, sf_dir, "lineitem", ["l_quantity"])
    where = ranges([Predicate("lineitem", "l_quantity", ">=", 10), Predicate("lineitem", "l_quantity", "<", 20)])
    return spark.createDataFrame([(round(models.expectation(m.root, where, {"lineitem__l_quantity": 1.0}), 6),)], "e double")


@query("SELECT round(avg((l_returnflag = 'R')::INT::DOUBLE) * avg((l_quantity < 10)::INT::DOUBLE), 9) AS p FROM lineitem")
def product_independent(spark, sf_dir):
    m = _single(spark, sf_dir, "lineitem", ["l_returnflag", "l_quantity"])
    where = ranges([Predicate("lineitem", "l_returnflag", "=", "R"), Predicate("lineitem", "l_quantity", "<", 10)])
    return spark.createDataFrame([(round(models.expectation(m.root, where), 9),)], "p double")


def _mixture(spark, sf_dir) -> models.Model:
    """A mixture of three independent parts, by return flag."""
    df = _tables(spark, sf_dir)["lineitem"].select(*[F.col(c).alias(f"lineitem__{c}") for c in ("l_returnflag", "l_linestatus", "l_quantity")])
    names = df.columns
    m = models.Model(models.Node("sum", tuple(names)), models.Columns.of(df.groupBy(*names).count().drop("count").toPandas()), frozenset(["lineitem"]))
    codes = m.columns.codes["lineitem__l_returnflag"]
    for code in codes.values():
        centre = [(code - m.columns.middle[c]) / m.columns.scale[c] if c.endswith("l_returnflag") else 0.0 for c in names]
        m.root.children.append(models.Node("product", tuple(names), [models.Node("leaf", (c,)) for c in names]))
        m.root.centres.append(centre)
    models.number_nodes(m.root)
    return models.absorb(m, [tuple(r) for r in models.leaf_counts(df, m).collect()], reset=True)


_MIX = "g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, avg((l_linestatus = 'O')::INT::DOUBLE) AS a, avg((l_quantity < 10)::INT::DOUBLE) AS b, avg(CASE WHEN l_quantity < 10 THEN l_quantity ELSE 0 END) AS x FROM lineitem GROUP BY 1)"


@query(f"WITH {_MIX} SELECT round(sum(n * a * b) / sum(n), 9) AS p FROM g")
def mixture_expectation(spark, sf_dir):
    m = _mixture(spark, sf_dir)
    where = ranges([Predicate("lineitem", "l_linestatus", "=", "O"), Predicate("lineitem", "l_quantity", "<", 10)])
    return spark.createDataFrame([(round(models.expectation(m.root, where), 9),)], "p double")


@query(f"WITH {_MIX} SELECT round(sum(n * a * x) / sum(n * a * b), 6) AS mean FROM g")
def conditional_expectation(spark, sf_dir):
    m = _mixture(spark, sf_dir)
    where = ranges([Predicate("lineitem", "l_linestatus", "=", "O"), Predicate("lineitem", "l_quantity", "<", 10)])
    p, e = models.expectation(m.root, where), models.expectation(m.root, where, {"lineitem__l_quantity": 1.0})
    return spark.createDataFrame([(round(e / p, 6),)], "mean double")


@query(f"WITH {_MIX}, p AS (SELECT sum(n * a * b) / sum(n) AS p, sum(n) AS n FROM g) SELECT round(p * n, 4) AS value, round(n * sqrt(p * (1 - p) / n), 4) AS sd, round(p * n - 1.6448536269514715 * n * sqrt(p * (1 - p) / n), 4) AS low, round(p * n + 1.6448536269514715 * n * sqrt(p * (1 - p) / n), 4) AS high FROM p")
def confidence_interval(spark, sf_dir):
    m = _mixture(spark, sf_dir)
    e, sd = models.moments(m, ranges([Predicate("lineitem", "l_linestatus", "=", "O"), Predicate("lineitem", "l_quantity", "<", 10)]))
    df = spark.createDataFrame([(e * m.size, sd * m.size)], "value double, sd double")
    low, high = metrics.interval(F.col("value"), F.col("sd"))
    return df.select(*[F.round(c, 4).alias(n) for n, c in (("value", F.col("value")), ("sd", F.col("sd")), ("low", low), ("high", high))])


@query("SELECT l_returnflag, l_linestatus FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT DISTINCT l_linestatus FROM lineitem)")
def model_group_distinct(spark, sf_dir):
    m = _single(spark, sf_dir, "lineitem", ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame(models.distinct(m.root, list(m.root.scope), {}), "l_returnflag string, l_linestatus string")


@query("WITH g AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), s AS (SELECT l_returnflag AS f, l_linestatus, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), q AS (SELECT l_returnflag AS f, avg((l_quantity < 10)::INT::DOUBLE) AS b FROM lineitem GROUP BY 1) SELECT s.f AS l_returnflag, l_linestatus, round(g.n * (s.n / g.n) * b, 6) AS value FROM g JOIN s USING (f) JOIN q USING (f)")
def model_group_estimate(spark, sf_dir):
    # One row a group; the tree is one Column expression over them.
    m = _mixture(spark, sf_dir)
    where = ranges([Predicate("lineitem", "l_quantity", "<", 10)])
    groups = spark.createDataFrame(models.distinct(m.root, ["lineitem__l_returnflag", "lineitem__l_linestatus"], where), "l_returnflag string, l_linestatus string")
    tests = {"lineitem__l_returnflag": lambda v: F.col("l_returnflag") == v, "lineitem__l_linestatus": lambda v: F.col("l_linestatus") == v, "lineitem__l_quantity": lambda v: F.lit(where["lineitem__l_quantity"].allows(v))}
    return groups.select("*", F.round(F.lit(m.size) * models.probability_column(m.root, tests), 6).alias("value")).where("value > 0")


@query("SELECT round(avg(l_quantity) FILTER (WHERE l_quantity < 10) * count(*) FILTER (WHERE l_quantity < 10), 4) AS value FROM lineitem")
def sum_as_avg_times_count(spark, sf_dir):
    e = ens.Ensemble(SCHEMA, [_single(spark, sf_dir, "lineitem", ["l_quantity"])])
    df = e.answer(parse(SCHEMA, "SELECT SUM(l_quantity) FROM lineitem WHERE l_quantity < 10"), spark)
    return df.select(F.round("value", 4).alias("value"))


@query("WITH co AS (SELECT c_mktsegment, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS m FROM customer JOIN orders ON o_custkey = c_custkey) SELECT round((SELECT sum(m) FROM co WHERE c_mktsegment = 'BUILDING') * (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 10)::DOUBLE / (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey), 4) AS value")
def factor_two_models(spark, sf_dir):
    # |customer, orders, lineitem| from two overlapping joins: fan-out out of the first, conditions in the second given the overlap.
    t = _tables(spark, sf_dir)
    e1, e2 = _edge("orders", "customer"), _edge("lineitem", "orders")
    a = joins.full_outer(SCHEMA, t, [e1], [e2]).where("customer__nn = 1 AND orders__nn = 1 AND customer__c_mktsegment = 'BUILDING'").agg(F.sum(e2.multiplier).alias("fan"))
    b = joins.full_outer(SCHEMA, t, [e2], []).where("orders__nn = 1 AND lineitem__nn = 1").agg(F.avg(F.when(F.col("lineitem__l_quantity") < 10, 1.0).otherwise(0.0)).alias("share"))
    return a.crossJoin(b).select(F.round(F.col("fan") * F.col("share"), 4).alias("value"))


@query("SELECT cluster, count(*) AS n FROM (SELECT CASE WHEN (l_quantity - 10) ** 2 + (l_discount * 100 - 2) ** 2 <= (l_quantity - 40) ** 2 + (l_discount * 100 - 8) ** 2 THEN 0 ELSE 1 END AS cluster FROM lineitem) GROUP BY 1")
def route_nearest_centre(spark, sf_dir):
    cols = models.Columns(["l_quantity", "l_discount"], {}, {"l_quantity": 0.0, "l_discount": 0.0}, {"l_quantity": 1.0, "l_discount": 0.01}, {})
    kids = [models.Node("product", ("l_quantity", "l_discount"), [models.Node("leaf", (c,)) for c in ("l_quantity", "l_discount")]) for _ in range(2)]
    root = models.number_nodes(models.Node("sum", ("l_quantity", "l_discount"), kids, [[10.0, 2.0], [40.0, 8.0]]))
    reach = models.route(root, cols)
    return _tables(spark, sf_dir)["lineitem"].select(F.when(reach[kids[0].id], 0).otherwise(1).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"))


@query("SELECT l_quantity AS value, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1")
def incremental_merge(spark, sf_dir):
    # Learned before a date, updated with the rest: the histogram of all rows.
    li = _tables(spark, sf_dir)["lineitem"].withColumn("q", F.col("l_quantity"))
    old, new = joins.split_by_condition(li, "l_shipdate < TIMESTAMP '1997-01-01'")
    m = models.Model(models.number_nodes(models.Node("leaf", ("q",))), models.Columns(["q"], {}, {"q": 0.0}, {"q": 1.0}, {}))
    models.absorb(m, [], reset=True)
    update(update(m, old), new)
    return spark.createDataFrame(list(zip(m.root.values.tolist(), m.root.counts.tolist(), strict=True)), "value double, n double")


@query("SELECT l_returnflag, round(sum(l_extendedprice * CASE WHEN l_quantity < 10 AND l_linestatus = 'O' THEN 1.1 ELSE 1.0 END::DOUBLE), 2) AS value FROM lineitem GROUP BY l_returnflag")
def what_if_reweight(spark, sf_dir):
    scenario = parse_what_if(SCHEMA, "WHAT IF lineitem.l_quantity < 10 AND lineitem.l_linestatus = 'O' INCREASE BY 10%")
    spec = parse(SCHEMA, "SELECT l_returnflag, SUM(l_extendedprice) FROM lineitem GROUP BY l_returnflag")
    return exact.run(SCHEMA, _tables(spark, sf_dir), spec, scenario=scenario).withColumn("value", F.round("value", 2))


# --- accuracy ----------------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    return _tables(spark, sf_dir)["orders"].groupBy("o_custkey").agg(F.count("*").alias("t"), (F.sum(F.col("o_orderkey") % 7) + 1).alias("e"))


_PAIRS = "p AS (SELECT o_custkey, count(*)::DOUBLE AS t, (sum(o_orderkey % 7) + 1)::DOUBLE AS e FROM orders GROUP BY 1)"


@query(f"WITH {_PAIRS}, q AS (SELECT greatest(greatest(e, 1) / greatest(t, 1), greatest(t, 1) / greatest(e, 1)) AS q FROM p) SELECT round(quantile_cont(q, 0.5), 6) AS p50, round(quantile_cont(q, 0.9), 6) AS p90, round(quantile_cont(q, 0.95), 6) AS p95, round(quantile_cont(q, 0.99), 6) AS p99, round(avg(q), 6) AS mean, round(max(q), 6) AS max FROM q")
def qerror_percentiles(spark, sf_dir):
    df = metrics.q_error_summary(_pairs(spark, sf_dir), "e", "t")
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query(f"WITH {_PAIRS} SELECT o_custkey, round(abs(t - e) / abs(t), 9) AS error FROM p")
def relative_error(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_custkey", F.round(metrics.relative_error(F.col("e").cast("double"), F.col("t").cast("double")), 9).alias("error"))


@query("WITH t AS (SELECT p_brand, count(*)::DOUBLE AS t FROM part WHERE p_size < 40 GROUP BY 1), e AS (SELECT p_brand, count(*) * 2.0::DOUBLE AS e FROM part WHERE p_size > 10 AND p_brand > 'Brand#15' GROUP BY 1), j AS (SELECT * FROM t FULL JOIN e USING (p_brand)) SELECT round(avg(abs(t - e) / t), 9) AS mean_error, round(max(abs(t - e) / t), 9) AS max_error, round(count(*) FILTER (WHERE t IS NOT NULL AND e IS NOT NULL)::DOUBLE / count(t), 9) AS completeness, round(count(*) FILTER (WHERE t IS NULL)::DOUBLE / count(e), 9) AS false_share FROM j")
def bin_metrics(spark, sf_dir):
    part = _tables(spark, sf_dir)["part"]
    t = part.where("p_size < 40").groupBy("p_brand").agg(F.count("*").cast("double").alias("value"))
    e = part.where("p_size > 10 AND p_brand > 'Brand#15'").groupBy("p_brand").agg((F.count("*") * F.lit(2.0)).alias("value"))
    df = metrics.group_metrics(t, e, ["p_brand"])
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query(f"WITH {_PAIRS} SELECT round(avg(CASE WHEN t >= e - 8 AND t <= e + 8 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS precision, round(avg(16.0::DOUBLE / abs(t)), 9) AS relative_length FROM p")
def ci_metrics(spark, sf_dir):
    df = _pairs(spark, sf_dir).select(F.col("t").cast("double").alias("t"), (F.col("e") - F.lit(8.0)).alias("low"), (F.col("e") + F.lit(8.0)).alias("high"))
    df = metrics.interval_metrics(df, "low", "high", "t")
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query("WITH g AS (SELECT l_returnflag, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, count(*)::DOUBLE AS n, (SELECT count(*)::DOUBLE FROM lineitem) AS total FROM lineitem GROUP BY 1) SELECT l_returnflag, round(sd / sqrt(n), 6) AS sd_avg, round(sqrt(total * (n / total) * (1 - n / total)), 6) AS sd_count FROM g")
def theory_standard_errors(spark, sf_dir):
    li = _tables(spark, sf_dir)["lineitem"]
    g = li.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("sd"), F.count("*").cast("double").alias("n")).crossJoin(li.agg(F.count("*").cast("double").alias("total")))
    args = [F.col(c) for c in ("mean", "sd", "n", "total")]
    return g.select("l_returnflag", F.round(metrics.theory_sd("AVG", *args), 6).alias("sd_avg"), F.round(metrics.theory_sd("COUNT", *args), 6).alias("sd_count"))


# --- learned models: no SQL can express them ---------------------------------------------------------------------------

_LEARNED: dict[tuple[str, str], ens.Ensemble] = {}


def learned(spark: SparkSession, sf_dir: str) -> ens.Ensemble:
    """Models of customers with orders, orders with line items, and parts; learned once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEARNED:
        t = _tables(spark, sf_dir)
        some = {k: t[k] for k in ("customer", "orders", "lineitem", "part")}
        e = ens.each_edge(SCHEMA, some, [_edge("orders", "customer"), _edge("lineitem", "orders"), _edge("lineitem", "part")], sample_rows=10_000)
        _LEARNED[key] = e
    return _LEARNED[key]


COUNTS = (
    "SELECT COUNT(*) FROM orders WHERE o_totalprice > 250000",
    "SELECT COUNT(*) FROM customer, orders WHERE o_custkey = c_custkey AND c_acctbal < 0 AND o_orderstatus = 'F'",
    "SELECT COUNT(*) FROM orders, lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 10 AND o_orderpriority = '1-URGENT'",
    "SELECT COUNT(*) FROM customer, orders, lineitem WHERE o_custkey = c_custkey AND l_orderkey = o_orderkey AND c_mktsegment = 'BUILDING' AND l_quantity < 10",
    "SELECT COUNT(*) FROM orders, lineitem, part WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND p_size < 20 AND o_totalprice > 100000",
    "SELECT COUNT(*) FROM orders WHERE o_orderdate >= '1994-01-01' AND o_orderdate < '1996-07-01' AND o_orderpriority >= '3'",
)
#: Their truths in DuckDB, numbered.
COUNTS_SQL = " UNION ALL ".join(f"SELECT {i} AS query_no, count(*)::DOUBLE AS truth, TRUE AS near FROM{t.split('FROM', 1)[1]}" for i, t in enumerate(COUNTS))


@query(COUNTS_SQL)
def rspn_count(spark, sf_dir):
    """Counts of joins of one to three tables, exact, and whether the estimate is within a q-error of 2."""
    e, t = learned(spark, sf_dir), _tables(spark, sf_dir)
    found = evaluation.cardinalities(spark, e, evaluation.truths(e, t, COUNTS))
    return found.select("query_no", "truth", (F.col("q_error") < 2).alias("near"))


@query(COUNTS_SQL)
def rspn_count_from_files(spark, sf_dir):
    """The same with models and truths that were written and read again."""
    e, folder = learned(spark, sf_dir), _folder(spark)
    files.write_truth(spark, evaluation.truths(e, _tables(spark, sf_dir), COUNTS), f"{folder}/truth")
    models.save(spark, e.models[:1], f"{folder}/one")
    models.save(spark, e.models[1:], f"{folder}/others")
    again = ens.Ensemble(SCHEMA, models.load(spark, f"{folder}/one", f"{folder}/others"))
    rows = [(r["query_no"], r["query"], r["cardinality_true"], 0.0) for r in files.read_truth(spark, f"{folder}/truth").collect()]
    return evaluation.cardinalities(spark, again, rows, variants=2).select("query_no", "truth", (F.col("q_error") < 2).alias("near"))


def _folder(spark) -> str:
    """A new folder beside the session's other tables; a temporary one where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp()
    return f"{found.rstrip('/')}/catalog-{uuid.uuid4().hex}"


def _near(spark, sf_dir, text: str, error: float, e: ens.Ensemble | None = None, digits: int = 2) -> DataFrame:
    """The exact groups and values, and whether the estimate is within the relative error and its interval in order."""
    spec = parse(SCHEMA, text)
    truth = exact.run(SCHEMA, _tables(spark, sf_dir), spec, "truth")
    found = (e or learned(spark, sf_dir)).answer(spec, spark).withColumnRenamed("value", "estimate")
    near = (metrics.relative_error(F.col("estimate"), F.col("truth").cast("double")) < error) & (F.col("low") <= F.col("estimate")) & (F.col("estimate") <= F.col("high"))
    return truth.join(found, spec.group_names, "left").select(*spec.group_names, F.round(F.col("truth").cast("double"), digits).alias("truth"), F.coalesce(near, F.lit(False)).alias("near"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS truth, TRUE AS near FROM lineitem WHERE l_quantity < 25 GROUP BY 1")
def rspn_group_sum(spark, sf_dir):
    return _near(spark, sf_dir, "SELECT l_returnflag, SUM(l_extendedprice) FROM lineitem WHERE l_quantity < 25 GROUP BY l_returnflag", 0.2)


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS truth, TRUE AS near FROM lineitem WHERE l_quantity < 40 GROUP BY 1")
def rspn_group_sum_product(spark, sf_dir):
    return _near(spark, sf_dir, "SELECT l_returnflag, SUM(l_extendedprice * l_discount) FROM lineitem WHERE l_quantity < 40 GROUP BY l_returnflag", 0.25)


@query("SELECT c_mktsegment, round(avg(c_acctbal), 2) AS truth, TRUE AS near FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def rspn_avg_negative(spark, sf_dir):
    return _near(spark, sf_dir, "SELECT c_mktsegment, AVG(c_acctbal) FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment", 0.3)


@query("SELECT o_orderpriority, count(*)::DOUBLE AS truth, TRUE AS near FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def rspn_ci(spark, sf_dir):
    return _near(spark, sf_dir, "SELECT o_orderpriority, COUNT(*) FROM customer, orders WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING' GROUP BY o_orderpriority ORDER BY o_orderpriority", 0.3)


@query("SELECT o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.5 ELSE 1.0 END::DOUBLE AS ratio FROM orders GROUP BY 1")
def rspn_what_if(spark, sf_dir):
    """Groups under a scenario over the same groups without it."""
    e, spec = learned(spark, sf_dir), parse(SCHEMA, "SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority")
    more = e.what_if(parse_what_if(SCHEMA, "WHAT IF orders.o_orderpriority = '1-URGENT' INCREASE BY 50%")).answer(spec, spark).select("o_orderpriority", F.col("value").alias("more"))
    return e.answer(spec, spark).join(more, "o_orderpriority").select("o_orderpriority", F.round(F.col("more") / F.col("value"), 1).alias("ratio"))


@query("SELECT count(*)::DOUBLE AS truth, TRUE AS near FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity < 10 AND c_acctbal > 0")
def variant_median(spark, sf_dir):
    spec = parse(SCHEMA, "SELECT COUNT(*) FROM customer, orders, lineitem WHERE o_custkey = c_custkey AND l_orderkey = o_orderkey AND l_quantity < 10 AND c_acctbal > 0")
    truth = float(exact.run(SCHEMA, _tables(spark, sf_dir), spec).first()["value"])
    estimate = learned(spark, sf_dir).cardinality(spec, 3)
    return spark.createDataFrame([(truth, max(estimate / truth, truth / estimate) < 2)], "truth double, near boolean")


@query("SELECT a AS col_a, b AS col_b, a = b AS same, TRUE AS in_range, TRUE AS symmetric FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) x(a), (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) y(b)")
def rdc_matrix(spark, sf_dir):
    li = _tables(spark, sf_dir)["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = joins.exact_sample(li, ["l_orderkey", "l_linenumber", "l_extendedprice"], 10_000).toPandas()
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    m = models.rdc_matrix(part[cols].to_numpy(float), 10_000)
    rows = [(a, b, bool(abs(m[i, j] - 1) < 1e-9), bool(0 <= m[i, j] <= 1), bool(m[i, j] == m[j, i])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return spark.createDataFrame(rows, "col_a string, col_b string, same boolean, in_range boolean, symmetric boolean")


@query("SELECT 'customer,orders' AS tables, count(*)::DOUBLE AS size, TRUE AS valid FROM customer FULL JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'lineitem,orders', count(*)::DOUBLE, TRUE FROM orders FULL JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'lineitem,part', count(*)::DOUBLE, TRUE FROM part FULL JOIN lineitem ON l_partkey = p_partkey")
def learn_tree(spark, sf_dir):
    """The learned models' sizes are those of the full outer joins; their trees are valid and took time to learn."""
    found = learned(spark, sf_dir).models
    for m in found:
        models.check(m.root)
    df = models.statistics(spark, found)
    return df.select("tables", "size", ((F.col("n_leaves") >= F.col("n_columns")) & (F.col("seconds") > 0)).alias("valid"))


@query("SELECT TRUE AS found, TRUE AS trees, TRUE AS within_budget, TRUE AS at_least_each_edge")
def ensemble_search(spark, sf_dir):
    """The search's result against the budget and every single edge that it allows."""
    t, names, budget = _tables(spark, sf_dir), ["customer", "orders", "lineitem", "part"], 4.0
    columns, scores = ens.modelled(SCHEMA, names), ens.pairwise(SCHEMA, t, names)
    found = ens.search(SCHEMA, scores, columns, budget)
    cost = lambda ts: sum(len(columns[x]) for x in ts) ** 2
    over = [{x for e in tree for x in (e.child, e.parent)} for tree in found]

    def worth(ts: set[str]) -> float:
        cols = [c for x in sorted(ts) for c in columns[x]]
        pairs = [scores.get((a, b), 0.0) for i, a in enumerate(cols) for b in cols[:i]]
        return sum(pairs) / len(pairs)

    edges = [e for e in SCHEMA.edges if e.child in names and e.parent in names]
    best = max(worth({e.child, e.parent}) for e in edges if cost((e.child, e.parent)) <= budget * sum(cost([n]) for n in names))
    row = (bool(found), all(len(SCHEMA.tree(tree)) == len(ts) - 1 for tree, ts in zip(found, over, strict=True)), sum(map(cost, over)) <= budget * sum(cost([n]) for n in names), sum(map(worth, over)) >= best - 1e-9)
    return spark.createDataFrame([row], "found boolean, trees boolean, within_budget boolean, at_least_each_edge boolean")


# --- dialect ----------------------------------------------------------------------------------------------------------

_exact("group_two_roles", "SELECT nation_c.n_name, nation_s.n_name, COUNT(*) FROM lineitem, orders, customer, nation_c, supplier, nation_s WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = nation_c.n_nationkey AND l_suppkey = s_suppkey AND s_nationkey = nation_s.n_nationkey AND l_quantity < 10 GROUP BY nation_c.n_name, nation_s.n_name ORDER BY nation_c.n_name, value DESC",
       "SELECT nc.n_name AS nation_c_n_name, ns.n_name AS nation_s_n_name, count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey WHERE l_quantity < 10 GROUP BY 1, 2")
_exact("order_by_alias", "SELECT p_brand AS brand, SUM(p_size) AS total FROM part GROUP BY p_brand ORDER BY total DESC, brand LIMIT 5", "SELECT p_brand AS brand, sum(p_size)::BIGINT AS total FROM part GROUP BY 1 ORDER BY total DESC, brand LIMIT 5", None)
_exact("date_range", "SELECT COUNT(*) FROM orders WHERE o_orderdate >= '1994-01-01' AND o_orderdate < '1996-07-01'", "SELECT count(*) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")


# --- models of single columns are exact, so their answers are ----------------------------------------------------------


def _answer(spark, sf_dir, table: str, columns: list[str], text: str) -> DataFrame:
    e = ens.Ensemble(SCHEMA, [_single(spark, sf_dir, table, columns)])
    return e.answer(parse(SCHEMA, text), spark).drop("low", "high").withColumn("value", F.round("value", 4))


@query("SELECT count(*)::DOUBLE AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def model_date_range(spark, sf_dir):
    return _answer(spark, sf_dir, "orders", ["o_orderdate"], "SELECT COUNT(*) FROM orders WHERE o_orderdate >= '1994-01-01' AND o_orderdate < '1996-07-01'")


@query("SELECT count(*)::DOUBLE AS value FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4' AND o_orderpriority NOT IN ('2-HIGH')")
def model_string_range(spark, sf_dir):
    return _answer(spark, sf_dir, "orders", ["o_orderpriority"], "SELECT COUNT(*) FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4' AND o_orderpriority NOT IN ('2-HIGH')")


@query("SELECT o_orderdate, count(*)::DOUBLE AS value FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' GROUP BY 1")
def model_group_dates(spark, sf_dir):
    return _answer(spark, sf_dir, "orders", ["o_orderdate"], "SELECT o_orderdate, COUNT(*) FROM orders WHERE o_orderdate < '1993-01-01' GROUP BY o_orderdate")


@query("SELECT l_linenumber, count(*)::DOUBLE AS value FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1")
def model_group_integers(spark, sf_dir):
    return _answer(spark, sf_dir, "lineitem", ["l_linenumber"], "SELECT l_linenumber, COUNT(*) AS value FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY l_linenumber ORDER BY value DESC")


@query("WITH q AS (SELECT avg(l_quantity) AS a, count(*)::DOUBLE AS m FROM lineitem WHERE l_quantity > 20), t AS (SELECT count(*)::DOUBLE AS n FROM lineitem) SELECT l_returnflag, round(count(*) * m / n * a, 4) AS value FROM lineitem, q, t GROUP BY l_returnflag, m, n, a")
def model_group_batch(spark, sf_dir):
    """All groups in one evaluation: flag and quantity are independent in this model."""
    return _answer(spark, sf_dir, "lineitem", ["l_returnflag", "l_quantity"], "SELECT l_returnflag, SUM(l_quantity) FROM lineitem WHERE l_quantity > 20 GROUP BY l_returnflag")


@query("WITH c AS (SELECT c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY 1), p AS (SELECT DISTINCT p_brand FROM part) SELECT c_mktsegment, p_brand FROM c, p")
def model_group_cross(spark, sf_dir):
    """Groups of two models cross."""
    e = ens.Ensemble(SCHEMA, [_single(spark, sf_dir, "customer", ["c_mktsegment"]), _single(spark, sf_dir, "part", ["p_brand"])])
    spec = QuerySpec(["customer", "part"], groups=[("customer", "c_mktsegment"), ("part", "p_brand")])
    return spark.createDataFrame(e.groups(spec), "c_mktsegment string, p_brand string")


@query("SELECT 'customer' AS name, count(*)::DOUBLE AS n FROM customer UNION ALL SELECT 'part', count(*)::DOUBLE FROM part")
def single_table_models(spark, sf_dir):
    t = _tables(spark, sf_dir)
    e = ens.single_tables(SCHEMA, {k: t[k] for k in ("customer", "part")}, ["customer", "part"], sample_rows=5_000, rows="gmm")
    return spark.createDataFrame([(k, e.cardinality(parse(SCHEMA, f"SELECT COUNT(*) FROM {k}"))) for k in ("customer", "part")], "name string, n double")


@query(f"WITH {_MIX}, v AS (SELECT l_returnflag, avg(CASE WHEN l_quantity < 10 THEN l_quantity * l_quantity ELSE 0 END) AS xx FROM lineitem GROUP BY 1), s AS (SELECT sum(n * a * b) AS low, sum(n * a * x) AS e, sum(n * a * xx) AS ee FROM g JOIN v USING (l_returnflag)) SELECT round(e / low, 6) AS mean, round(sqrt((ee / low - (e / low) * (e / low)) / low), 6) AS sd FROM s")
def conditional_deviation(spark, sf_dir):
    e = ens.Ensemble(SCHEMA, [_mixture(spark, sf_dir)])
    mean, sd = e._mean(parse(SCHEMA, "SELECT AVG(l_quantity) FROM lineitem WHERE l_quantity < 10 AND l_linestatus = 'O'"), (("lineitem", "l_quantity"),))
    return spark.createDataFrame([(round(float(mean), 6), round(float(sd), 6))], "mean double, sd double")


@query(f"WITH {_MIX}, h AS (SELECT sum(n * a) AS half, sum(n) AS n, sum(n * a * b) AS hits FROM g) SELECT round((n + 0.5::DOUBLE * half) / n, 6) AS size_ratio, round((hits * 1.5::DOUBLE) / hits, 6) AS hit_ratio FROM h")
def model_what_if(spark, sf_dir):
    e = ens.Ensemble(SCHEMA, [_mixture(spark, sf_dir)])
    more = e.what_if(parse_what_if(SCHEMA, "WHAT IF lineitem.l_linestatus = 'O' INCREASE BY 50%"))
    count = lambda x, text: x.cardinality(parse(SCHEMA, text))
    every, hit = "SELECT COUNT(*) FROM lineitem", "SELECT COUNT(*) FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 10"
    return spark.createDataFrame([(round(count(more, every) / count(e, every), 6), round(count(more, hit) / count(e, hit), 6))], "size_ratio double, hit_ratio double")


@query("SELECT l_returnflag, count(*)::DOUBLE AS n FROM lineitem WHERE NOT (l_quantity < 10) GROUP BY 1")
def incremental_delete(spark, sf_dir):
    """All rows, less those of a condition."""
    m = _single(spark, sf_dir, "lineitem", ["l_returnflag"])
    gone = _tables(spark, sf_dir)["lineitem"].where("l_quantity < 10").select(F.col("l_returnflag").alias("lineitem__l_returnflag"))
    update(m, gone, sign=-1)
    return spark.createDataFrame(list(zip(m.root.values.tolist(), m.root.counts.tolist(), strict=True)), "l_returnflag string, n double")


@query("SELECT l_returnflag, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS weight FROM lineitem GROUP BY 1")
def incremental_weights(spark, sf_dir):
    """A sum node's weights after rows came in two batches."""
    m, li = _mixture(spark, sf_dir), _tables(spark, sf_dir)["lineitem"].select(*[F.col(c).alias(f"lineitem__{c}") for c in ("l_returnflag", "l_linestatus", "l_quantity")])
    models.absorb(m, [], reset=True)
    early, late = joins.split_by_share(li, ["lineitem__l_quantity", "lineitem__l_returnflag"], 0.3)
    update(update(m, early), late)
    flag = {code: v for v, code in m.columns.codes["lineitem__l_returnflag"].items()}
    rows = [(next(v for leaf in c.children if leaf.scope == ("lineitem__l_returnflag",) for v in leaf.values.tolist()), c.total / m.root.total) for c in m.root.children]
    assert len(flag) == len(rows)
    return spark.createDataFrame(rows, "l_returnflag string, weight double")


# --- samples, sources and accuracy --------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, TRUE AS late_share FROM orders")
def split_share(spark, sf_dir):
    early, late = joins.split_by_share(_tables(spark, sf_dir)["orders"], ["o_orderkey"], 0.25)
    both = early.agg(F.count("*").alias("a")).crossJoin(late.agg(F.count("*").alias("b")))
    return both.select((F.col("a") + F.col("b")).alias("n"), (F.abs(F.col("b") / (F.col("a") + F.col("b")) - 0.25) < 0.05).alias("late_share"))


@query("SELECT 200::BIGINT AS n, 0::BIGINT AS strangers")
def two_stage_sample(spark, sf_dir):
    """Exactly so many rows of a join; none that the join doesn't hold."""
    t, edges = _tables(spark, sf_dir), [_edge("orders", "customer"), _edge("lineitem", "orders")]
    got = joins.two_stage_sample(SCHEMA, t, edges, 200, float(t["lineitem"].count()), factor=4.0, cap=5_000)
    cols = [c for c in got.columns if c in ("orders__o_orderkey", "orders__o_custkey", "customer__c_custkey")]
    whole = joins.tree_join(SCHEMA, {k: t[k] for k in ("customer", "orders", "lineitem")}, edges, "full").select(*cols)
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    strangers = got.select(*cols).alias("a").join(whole.alias("b"), same, "left_anti")
    return got.agg(F.count("*").alias("n")).crossJoin(strangers.agg(F.count("*").alias("strangers")))


@query("SELECT 0::BIGINT AS wrong, TRUE AS mean_kept")
def rounding(spark, sf_dir):
    """Random rounding goes to a neighbour and keeps the mean."""
    x = F.col("l_extendedprice") / 1000
    df = _tables(spark, sf_dir)["lineitem"].select(x.alias("x"), joins.rounded(x, ["l_orderkey", "l_linenumber", "l_extendedprice"]).alias("y"))
    return df.agg(F.count_if((F.col("y") < F.floor("x")) | (F.col("y") > F.ceil("x"))).alias("wrong"), (F.abs(F.avg("y") - F.avg("x")) < 0.05).alias("mean_kept"))


@query("SELECT TRUE AS near")
def sampled_truth(spark, sf_dir):
    """TABLESAMPLE: a tenth of the rows, scaled, is near the whole."""
    li = _tables(spark, sf_dir)["lineitem"]
    return joins.table_sample(li, 10).agg((F.count("*") * 10).alias("e")).crossJoin(li.agg(F.count("*").alias("t"))).select((F.abs(F.col("e") / F.col("t") - 1) < 0.1).alias("near"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'a \"quoted\", name', -1")
def csv_scan(spark, sf_dir):
    """A headerless file with quotes and escapes; what isn't a number is null."""
    path, spec = f"{_folder(spark)}/nation", TableSpec("nation", ("n_nationkey",), irrelevant=("n_comment",))
    rows = _tables(spark, sf_dir)["nation_c"].select(F.format_string('%s,"%s",%s,dropped', "n_nationkey", "n_name", "n_regionkey").alias("line"))
    odd = spark.createDataFrame([('100,"a \\"quoted\\", name",none,dropped',)], "line string")
    rows.union(odd).write.text(path)
    df = files.read_csv(spark, path, StructType.fromDDL("n_nationkey long, n_name string, n_regionkey long, n_comment string"), spec)
    return df.toDF(*[c.split(".")[1] for c in df.columns]).fillna(-1)


@query("SELECT o_orderkey, count(l_orderkey)::DOUBLE AS mul FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def prepared_tables(spark, sf_dir):
    """Tables with multipliers, written and read again."""
    t, path = _tables(spark, sf_dir), f"{_folder(spark)}/orders"
    ready = prepare.prepare_all(SCHEMA, {k: t[k] for k in ("orders", "lineitem", "customer")})
    files.write_prepared(ready["orders"], path)
    files.write_metadata(spark, {"path": path}, f"{path}-metadata")
    return spark.read.parquet(files.read_metadata(spark, f"{path}-metadata")["path"]).select("o_orderkey", F.col(_edge("lineitem", "orders").multiplier).alias("mul"))


@query("SELECT 500::BIGINT AS n FROM orders LIMIT 1")
def prepared_sample(spark, sf_dir):
    path = f"{_folder(spark)}/orders"
    files.write_prepared(_tables(spark, sf_dir)["orders"], path, most=500, key="o_orderkey")
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("SELECT round(sqrt((0.25::DOUBLE + 4) * (0.01::DOUBLE + 9) - 4 * 9), 9) AS sd")
def product_deviation(spark, sf_dir):
    return spark.range(1).select(F.round(metrics.product_sd([F.lit(2.0), F.lit(3.0)], [F.lit(0.5), F.lit(0.1)]), 9).alias("sd"))


@query("WITH g AS (SELECT l_returnflag, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, count(*)::DOUBLE AS n, (SELECT count(*)::DOUBLE FROM lineitem) AS total FROM lineitem GROUP BY 1) SELECT l_returnflag, round(sqrt((sd * sd / n + mean * mean) * (total * (n / total) * (1 - n / total) + n * n) - mean * mean * n * n) / 1e6, 6) AS sd_sum FROM g")
def theory_standard_error_of_sums(spark, sf_dir):
    li = _tables(spark, sf_dir)["lineitem"]
    g = li.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("sd"), F.count("*").cast("double").alias("n")).crossJoin(li.agg(F.count("*").cast("double").alias("total")))
    return g.select("l_returnflag", F.round(metrics.theory_sd("SUM", *[F.col(c) for c in ("mean", "sd", "n", "total")]) / 1e6, 6).alias("sd_sum"))


@query("SELECT 0 AS query_no, TRUE AS found_all, TRUE AS near UNION ALL SELECT 1, TRUE, TRUE")
def aggregate_evaluation(spark, sf_dir):
    """Error, completeness and false groups of estimates with groups against the exact answers."""
    texts = ["SELECT l_returnflag, SUM(l_quantity) FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag", "SELECT c_mktsegment, COUNT(*) FROM customer, orders WHERE o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_mktsegment"]
    found = evaluation.aggregates(spark, learned(spark, sf_dir), _tables(spark, sf_dir), texts)
    return found.select("query_no", ((F.col("completeness") == 1) & (F.col("false_share") == 0)).alias("found_all"), (F.col("mean_error") < 0.2).alias("near"))


@query("SELECT 0 AS query_no, 'COUNT' AS kind, count(*)::DOUBLE AS truth, TRUE AS within FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT 1, 'AVG', round(avg(l_quantity), 4), TRUE FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 2, 'SUM', round(sum(l_quantity), 4), TRUE FROM lineitem WHERE l_discount > 0.05")
def interval_evaluation(spark, sf_dir):
    """Intervals of a model of independent columns hold the truth of conditions on one of them, and theory's hold it too."""
    e = ens.Ensemble(SCHEMA, [_single(spark, sf_dir, "lineitem", ["l_quantity", "l_discount"])])
    texts = ["SELECT COUNT(*) FROM lineitem WHERE l_quantity < 10", "SELECT AVG(l_quantity) FROM lineitem WHERE l_discount > 0.05", "SELECT SUM(l_quantity) FROM lineitem WHERE l_discount > 0.05"]
    t = _tables(spark, sf_dir)
    found = evaluation.intervals(spark, e, t, texts, {"lineitem": float(t["lineitem"].count())})
    near = F.abs(F.col("value") / F.col("truth") - 1) < 0.05
    return found.select("query_no", "kind", F.round("truth", 4).alias("truth"), (near & (F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high")) & (F.col("theory_low") <= F.col("truth")) & (F.col("truth") <= F.col("theory_high"))).alias("within"))


@query("SELECT l_returnflag, sum(CASE WHEN l_quantity < 10 THEN 2.0 ELSE 1.0 END)::DOUBLE AS value FROM lineitem WHERE l_tax IS NOT NULL GROUP BY 1")
def what_if_count_column(spark, sf_dir):
    """Under a scenario too, COUNT of a column leaves out its nulls."""
    t = _tables(spark, sf_dir)
    spec = parse(SCHEMA, "SELECT l_returnflag, COUNT(l_tax) FROM lineitem GROUP BY l_returnflag")
    return exact.run(SCHEMA, t, spec, scenario=parse_what_if(SCHEMA, "WHAT IF lineitem.l_quantity < 10 INCREASE BY 100%"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def pair_filter(spark, sf_dir):
    """Group tuples that a model of independent columns crosses, less those that don't occur."""
    m = _single(spark, sf_dir, "lineitem", ["l_returnflag", "l_linestatus"])
    crossed = spark.createDataFrame(models.distinct(m.root, list(m.root.scope), {}), "l_returnflag string, l_linestatus string")
    return crossed.join(joins.pair_filter(_tables(spark, sf_dir)["lineitem"], ["l_returnflag", "l_linestatus"]), ["l_returnflag", "l_linestatus"], "left_semi")


@query("SELECT count(*)::DOUBLE AS size FROM orders FULL JOIN lineitem ON l_orderkey = o_orderkey")
def join_size_with_unmatched(spark, sf_dir):
    """The size from means and rows without partners is that of the full join."""
    t, e = _tables(spark, sf_dir), _edge("lineitem", "orders")
    mean = prepare.mean_multiplier(prepare.multipliers(t["orders"], [(e, t["lineitem"], 1.0)]), e).first()["mean_mul_nn"]
    alone = float(t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count())
    size = joins.size_estimate(SCHEMA, {"orders": float(t["orders"].count())}, {e.id: mean}, [e], "orders", {e.id: alone})
    return spark.createDataFrame([(round(size, 3),)], "size double")
