"""Command line: ``python -m linkloom build SRC OUT [--dataflow]`` and ``python -m linkloom reason KB REQUIREMENTS OUT``."""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import SparkSession, functions as F

from .operators import graph
from .plans import build as B, reason as R
from .providers import embed, judge
from .sources import sinks, tree


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkloom")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="code graph of a source tree")
    b.add_argument("source")
    b.add_argument("out")
    b.add_argument("--dataflow", action="store_true")
    b.add_argument("--width", type=int, default=1024, help="numbers in a vector; 0 for no vectors")
    b.add_argument("--json", action="store_true", help="write metadata and edges as documents of JSON too")
    r = commands.add_parser("reason", help="trace requirement texts over a built knowledge base")
    r.add_argument("knowledge", help="folder of a build, or with metadata.json and knowledge_graph.json or edges.json")
    r.add_argument("requirements", help="folder of .txt files")
    r.add_argument("out")
    r.add_argument("--graph", help="another document of edges")
    r.add_argument("--width", type=int, default=1024)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    embedder = partial(embed, width=args.width) if args.width else None
    if args.command == "build":
        made = B.build(tree.read_tree(spark, args.source), args.dataflow, embedder)
        sinks.write_build(made, args.out)
        if args.json:
            sinks.write_json_array(made["metadata"], f"{args.out}/metadata.json")
            sinks.write_json_array(made["edges"], f"{args.out}/edges.json")
        return 0
    functions, edges = tree.read_knowledge(spark, args.knowledge, args.graph)
    if functions.where("vector is not null").limit(1).count() == 0:  # no index: it is rebuilt from the metadata
        functions = functions.drop("vector").join(B.vectors_of(functions.drop("vector"), embedder).select("id", F.col("embedding").alias("vector")), "id", "left")
    texts = tree.read_requirements(spark, args.requirements)
    parts = embedder(R.requirement_chunks(texts), "text").select("doc_id", "chunk_index", F.col("embedding").alias("vector"))
    R.reason(texts, parts, functions, graph.calls(edges), graph.flows(edges), judge=judge, embedder=embedder).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
