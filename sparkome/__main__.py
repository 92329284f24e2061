"""Command line: list and explain reports, run one over a snapshot; verify, describe and copy a snapshot, keep its dictionary of names; states of loads; run a query of the catalog."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import catalog, kg, nlp
from .plans.etl import framework
from .sources import snapshot, tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkome")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("reports")
    sub.add_parser("explain").add_argument("name")
    sub.add_parser("verify").add_argument("path")
    sub.add_parser("info").add_argument("path")
    copy = sub.add_parser("download")
    copy.add_argument("path")
    copy.add_argument("target")
    names = sub.add_parser("dictionary")
    names.add_argument("path")
    names.add_argument("--overwrite", action="store_true")
    sub.add_parser("status").add_argument("folder", help="the folder of a manager of loads")
    rep = sub.add_parser("report")
    rep.add_argument("name")
    rep.add_argument("path", help="a snapshot with the graph's tables and the report's own (master, isoforms, pfam, go_relations)")
    rep.add_argument("values", nargs="*", help="identifiers, or @file with one a line; none for all entities")
    rep.add_argument("--columns", nargs="*")
    rep.add_argument("--option", action="append", default=[], metavar="NAME=VALUE")
    rep.add_argument("--out")
    run = sub.add_parser("query")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out")
    a = p.parse_args(argv)
    if a.command == "reports":
        print("\n".join(kg.list_reports()))
        return 0
    if a.command == "explain":
        print(kg.explain(a.name))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "verify":
        bad = snapshot.verify(spark, a.path)
        print("\n".join(bad) or "all tables are as the manifest says")
        return bool(bad)
    if a.command == "info":
        for name, df in snapshot.open_snapshot(spark, a.path).items():
            print(f"{name}\t{df.count()}\t{', '.join(df.columns)}")
        return 0
    if a.command == "download":
        print(f"{snapshot.download(spark, a.path, a.target)} files copied")
        return 0
    if a.command == "dictionary":
        t = snapshot.open_snapshot(spark, a.path)
        graph = kg.KnowledgeGraph(*[t[n] for n in ("entity_types", "entities", "aliases", "relationships", "locations")])
        nlp.save_dictionary(spark, a.path, nlp.dictionary(graph), nlp.version(graph), a.overwrite)
        return 0
    if a.command == "status":
        framework.Manager(spark, a.folder).status().show(200, truncate=False)
        return 0
    if a.command == "report":
        t = snapshot.open_snapshot(spark, a.path)
        graph = kg.KnowledgeGraph(*[t[n] for n in ("entity_types", "entities", "aliases", "relationships", "locations")])
        files = [v[1:] for v in a.values if v.startswith("@")]
        inputs = spark.createDataFrame([(v,) for v in a.values if not v.startswith("@")], "id string") if a.values else None
        for f in files:
            inputs = inputs.unionByName(tables.read_identifiers(spark, f))
        own = {o: t[n] for o, n in (("master", f"{a.name.split('_')[0]}_master"), ("isoforms", "isoforms"), ("pfam", "pfam"), ("relations", "go_relations")) if n in t}
        df = kg.run_report(graph, a.name, inputs, columns=a.columns, **own, **dict(x.split("=", 1) for x in a.option))
    else:
        df = catalog.queries()[a.name](spark, a.folder)
    if a.out:
        tables.write_csv(df, a.out)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
