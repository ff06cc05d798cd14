"""Sinks: one JSON document as the command line prints it, or a table per part."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

from pyspark.sql import DataFrame

from orrery.operators import gravity
from orrery.sources.files import Graph


def _dump(value) -> str:
    text = json.dumps(value, indent=2, ensure_ascii=False)
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _entries(rows: Iterator[object]) -> Iterator[str]:
    """An indented array, or null for none, from values as they come."""
    opened = False
    for value in rows:
        yield ",\n" if opened else "[\n"
        yield textwrap.indent(_dump(value), "    ")
        opened = True
    yield "\n  ]" if opened else "null"


def graph_lines(graph: Graph) -> Iterator[str]:
    """The whole graph in one document, piece by piece: the driver holds one partition at a time."""

    def node(r):
        out = {"id": r["id"], "world": r["world"], "kind": r["kind"], "name": r["name"]}
        return out | ({"metadata": dict(sorted(r["metadata"].items()))} if r["metadata"] else {})

    parts = {
        "worlds": (r[0] for r in graph.worlds.toLocalIterator()),
        "nodes": (node(r) for r in graph.nodes.orderBy("repo_ord", "rel_path", "seq", "id").toLocalIterator()),
        "edges": (r.asDict() for r in graph.edges.orderBy("src", "dst", "rel").toLocalIterator()),
        "cross_edges": (r.asDict() for r in graph.cross_edges.orderBy("protocol", "contract_key", "src", "dst").toLocalIterator()),
    }
    for k, (name, rows) in enumerate(parts.items()):
        yield ("{\n" if k == 0 else ",\n") + f'  "{name}": '
        yield from _entries(rows)
    meta = [] if graph.world_meta is None else sorted(graph.world_meta.collect())  # a row per repository
    if meta:
        found = {r["world"]: {k: r[k] for k in ("repo_origin", "ref") if r[k]} for r in meta}
        yield ',\n  "world_meta": ' + textwrap.indent(_dump(found), "  ").lstrip()
    yield "\n}\n"


def graph_json(graph: Graph) -> str:
    """The document as one string, for graphs that fit the driver."""
    return "".join(graph_lines(graph))


def gravity_json(report: DataFrame) -> str:
    row = report.first().asDict(recursive=True)
    return _dump(row | {"worlds": row["worlds"] or None, "galaxies": row["galaxies"] or None})


def write_tables(graph: Graph, path: str) -> None:
    """One Parquet table per part of the graph."""
    for name in ("nodes", "edges", "cross_edges", "worlds", "world_meta"):
        if (table := getattr(graph, name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def gravity_report(graph: Graph) -> DataFrame:
    return gravity.report(graph.nodes, graph.cross_edges, graph.worlds)
