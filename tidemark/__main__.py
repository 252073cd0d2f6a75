"""python -m tidemark: stages of the engine over the tables of a folder; several may run in one call, in this order."""

from __future__ import annotations

import argparse
import json
import time

from . import catalog
from .functions import evaluation
from .operators import exact, prepare
from .plans import ensemble as ens
from .plans import model as models
from .plans.query import parse
from .sources import tables as files


def main(argv: list[str] | None = None) -> None:
    """Reads --data (Parquet files), and does what the flags ask for; models are kept in --models."""
    a = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    a.add_argument("--data", required=True)
    a.add_argument("--models", default="models")
    a.add_argument("--tables", default="customer,orders,lineitem,part")
    a.add_argument("--prepare", metavar="FOLDER", help="write tables with multipliers, and how long that took")
    a.add_argument("--learn", choices=("single", "edges", "search"))
    a.add_argument("--rows", type=int, default=10_000, help="rows that a model's structure is learned from")
    a.add_argument("--budget", type=float, default=4.0, help="cost of searched models, in that of the single tables")
    a.add_argument("--queries", help="file of queries, one a line")
    a.add_argument("--truth", metavar="FILE", help="with --queries: execute them and store results and times")
    a.add_argument("--evaluate", choices=("cardinality", "aggregates"))
    a.add_argument("--out", default="results")
    a.add_argument("--sql", help="a query to answer from the models")
    a.add_argument("--exact", action="store_true", help="answer --sql from the tables")
    flags = a.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    names = flags.tables.split(",")
    tables = {t: files.read_parquet(spark, flags.data, catalog.SCHEMA.tables[t]) for t in names}
    edges = [e for e in catalog.SCHEMA.edges if e.child in names and e.parent in names]
    if flags.prepare:
        took = {}
        for t, df in prepare.prepare_all(catalog.SCHEMA, tables).items():
            began = time.perf_counter()
            files.write_prepared(df, f"{flags.prepare}/{t}")
            took[t] = time.perf_counter() - began
        files.write_metadata(spark, {"seconds": took}, f"{flags.prepare}/metadata")
    if flags.learn:
        if flags.learn == "single":
            e = ens.single_tables(catalog.SCHEMA, tables, names, sample_rows=flags.rows)
        elif flags.learn == "edges":
            e = ens.each_edge(catalog.SCHEMA, tables, edges, sample_rows=flags.rows)
        else:
            e = ens.searched(catalog.SCHEMA, tables, names, flags.budget, rows=flags.rows, sample_rows=flags.rows)
            files.write_scores(spark, e.scores, f"{flags.models}/scores")
        models.save(spark, e.models, f"{flags.models}/ensemble")
        files.write_csv(models.statistics(spark, e.models), f"{flags.models}/statistics")
    if flags.truth:
        files.write_truth(spark, evaluation.truths(ens.Ensemble(catalog.SCHEMA), tables, files.read_queries(flags.queries)), flags.truth)
    if flags.evaluate or (flags.sql and not flags.exact):
        e = ens.Ensemble(catalog.SCHEMA, models.load(spark, f"{flags.models}/ensemble"))
    if flags.evaluate == "cardinality":
        rows = files.read_truth(spark, flags.truth).orderBy("query_no").collect()
        files.write_csv(evaluation.cardinalities(spark, e, [(r["query_no"], r["query"], r["cardinality_true"], 0.0) for r in rows]), flags.out)
    elif flags.evaluate:
        files.write_csv(evaluation.aggregates(spark, e, tables, files.read_queries(flags.queries)), flags.out)
    if flags.sql:
        spec = parse(catalog.SCHEMA, flags.sql)
        found = exact.run(catalog.SCHEMA, tables, spec) if flags.exact else e.answer(spec, spark)
        for row in found.toLocalIterator():
            print(json.dumps(row.asDict(), default=str))


if __name__ == "__main__":
    main()
