"""python -m orrery.cli [-world NAME] [-split] [-gravity] [-out FOLDER] REPO..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from orrery.emit import graph_lines, gravity_json, gravity_report, write_tables
from orrery.operators.resolve import resolve
from orrery.operators.split import split_worlds
from orrery.sources.files import Graph, build, world_name
from orrery.tables import drop, scratch, stored


def extracted(spark: SparkSession, repos: list[tuple[str, str]], split: bool = False) -> Graph:
    """The resolved graph of (world, directory) pairs."""
    graph = build(spark, repos)
    if split:
        nodes, edges, cross = split_worlds(graph.nodes, graph.edges, graph.cross_edges, graph.dirs)
        worlds = graph.worlds.union(nodes.select("world")).distinct().orderBy("world")
        graph = replace(graph, nodes=stored(nodes, "nodes"), edges=edges, cross_edges=cross, worlds=worlds)
    return replace(graph, cross_edges=stored(resolve(graph.nodes), "cross-edges"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orrery", description=__doc__)
    parser.add_argument("-world", default="")
    parser.add_argument("-split", action="store_true")
    parser.add_argument("-gravity", action="store_true")
    parser.add_argument("-out", default="", help="write the graph's tables here, from the executors, instead of printing it")
    parser.add_argument("repos", nargs="*")
    args = parser.parse_args(argv)
    if not args.repos or (args.world and len(args.repos) > 1):
        parser.print_usage(sys.stderr)
        return 2
    spark = SparkSession.builder.appName("orrery").getOrCreate()
    with scratch() as made:
        try:
            graph = extracted(spark, [(args.world or world_name(r), r) for r in args.repos], args.split)
            if args.out:
                write_tables(graph, args.out)
            else:
                sys.stdout.writelines(graph_lines(graph))
            if args.gravity:
                print(f"--- gravity ---\n{gravity_json(gravity_report(graph))}", file=sys.stderr)
        except OSError as e:
            print(e, file=sys.stderr)
            return 1
        finally:
            drop(*made)
    return 0


__all__ = ["extracted", "main"]

if __name__ == "__main__":
    sys.exit(main())
