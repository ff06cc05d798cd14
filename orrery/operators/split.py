"""Splitting a repository into the services under its service roots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery import model
from orrery.functions import scalars as S


@dataclass(frozen=True)
class Options:
    roots: tuple[str, ...] = ("cmd/*", "charts/*")
    gates: tuple[str, ...] = ("charts/*",)
    generic: frozenset[str] = field(default_factory=lambda: frozenset(model.GENERIC_ROOTS))


def matches(path, globs: tuple[str, ...]):
    """Whether a directory path matches one of the globs, in which ``*`` stands for one segment's characters."""
    patterns = ["^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else f"\\Q{c}\\E" for c in g) + r"\z" for g in globs]
    return F.lit(False) if not patterns else path.rlike("|".join(patterns))


def directories(files: DataFrame) -> DataFrame:
    """Each world's directories that hold a file, at any depth."""
    parts = F.split("rel", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.where(F.col("rel").contains("/")).select("world", F.explode(ups).alias("dir")).distinct()


def service_roots(dirs: DataFrame, options: Options = Options()) -> DataFrame:
    """(world, dir, name) of the service roots among a world's directories.

    If any directory matches a gate, only names that a gate bears are roots.
    """
    name = F.element_at(F.split("dir", "/"), -1)
    roots = dirs.where(matches(F.col("dir"), options.roots)).withColumn("name", name).where(~F.lower("name").isin(*sorted(options.generic)))
    gates = dirs.where(matches(F.col("dir"), options.gates)).select("world", name.alias("name")).distinct()
    gated = gates.select("world").distinct().withColumn("gated", F.lit(True))
    open_ = roots.join(gated, "world", "left_anti")
    held = roots.join(gates, ["world", "name"], "left_semi")
    return open_.select("world", "dir", "name").union(held.select("world", "dir", "name"))


def renamed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, new_id, sub) of the nodes that lie under a root.

    Roots and files meet by (world, root directory): a file has one candidate per
    depth that roots have (no more than the longest path has), so the prefix test is an equi-join.
    """
    rel = S.rel_of(F.col("id"))
    depths = [r[0] for r in roots.select(F.size(F.split("dir", "/"))).distinct().orderBy(F.lit(1)).collect()]
    if not depths:
        return nodes.select("id", F.lit("").alias("new_id"), F.lit("").alias("sub")).limit(0)
    parts = F.split(rel, "/")
    prefixes = F.array(*[F.when(F.size(parts) > d, F.array_join(F.slice(parts, 1, d), "/")) for d in depths])
    keyed = nodes.select("id", "world", F.posexplode(prefixes).alias("depth", "dir")).where("dir is not null")
    met = keyed.join(roots, ["world", "dir"]).groupBy("id", "world").agg(F.min_by("name", "dir").alias("name"))
    # the id's first part is the world; what follows stays
    return met.select("id", F.concat(F.col("name"), F.expr("substring(id, length(world) + 1)")).alias("new_id"), F.col("name").alias("sub"))


def split_worlds(nodes: DataFrame, edges: DataFrame, cross_edges: DataFrame, dirs: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes under service roots move to worlds of their own; all edges follow."""
    moved = renamed(nodes, service_roots(dirs, options))
    out = nodes.join(moved, "id", "left")
    out = out.withColumn("id", F.coalesce("new_id", "id")).withColumn("world", F.coalesce("sub", "world")).select(nodes.columns)
    return out, remapped(edges, moved), remapped(cross_edges, moved)


def remapped(edges: DataFrame, moved: DataFrame) -> DataFrame:
    out = edges
    for end in ("src", "dst"):
        out = out.join(moved.select(F.col("id").alias(end), F.col("new_id").alias("__new")), end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return out.select(edges.columns)
